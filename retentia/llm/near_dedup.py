"""Near-duplicate groups by a chosen-path set similarity join.

A document is the set of its five-word shingles. Equal sets are one class from the start. In each of
several independent trees the classes branch by the minwise token of one coordinate after the other:
classes with the same token share a node.

The first walk joins what is plainly alike: nodes of up to ``LEAF`` classes give a spanning forest of their likeliest
pairs by sketch, larger ones pair each class with one of them; full sets confirm, and linked classes become
one component. Later walks compare the nodes that still hold several components exhaustively. Large nodes
branch on until they are of moderate size, at the last level they are cut into pairs of blocks. Sketches
find the classes of a node that may be linked with another component; what hangs together by such classes in any of the
trees is one group, up to a size, so that a set travels once. The full sets of a group come together, are
compared in one product of matrices, and only the links of a spanning forest leave the task. So neither links nor
candidates grow with the square of a group, however alike its members are.

A pair of similarity s stays together in one tree with probability s per level and is compared where it
ends. Classes branch twice before nodes are looked at, which leaves most unlike texts alone. 16 trees miss a pair of
similarity 0.75 with probability (1 - 0.75 ** 2) ** 16, about 2e-6, if its nodes are of moderate size then, and with
(1 - 0.75 ** 4) ** 16, about 0.0023, in each walk if all of them stay larger to the last. Only in that case there
is more to find, so walks on other coordinates follow until one finds no link.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.llm.batches import on_workers, pieces_of, staged

WORDS, PERCENT = 5, 75
#: Trees, the first level whose nodes are looked at, and the last one.
TREES, FIRST, LEVELS = 16, 2, 4
#: Classes of a node that the first walk compares with each other, and that later walks do before a node branches on.
LEAF, MODERATE = 1024, 4096
#: Classes and shingles of a block; larger nodes of the last level are compared by pairs of blocks.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 20
#: Classes of the largest group that is put together from those of several nodes; it has a block's shingles at most, too.
WHOLE = 1024
#: Share of equal sketch positions below which a pair is not confirmed: 4.6 standard errors under 0.75.
LEAST_SKETCH = 0.5
#: Bits of the filter that picks the texts whose sets are needed; a full filter costs work, not results.
FILTER_BITS = 1 << 23
#: Columns of shingles that are multiplied at once.
COLUMNS = 4096
FACTORS = np.array([xxhash.xxh3_64_intdigest(f"minwise {i}") | 1 for i in range(TREES * LEVELS)], np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; of all words if there are fewer than five."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(WORDS, len(h))
    key = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        key = (key ^ h[k : len(key) + k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return np.unique(key * np.uint64(0xD6E8FEB86659FD93))


def minwise(shingle_set: np.ndarray) -> np.ndarray:
    """For each coordinate the shingle that a multiplication puts first."""
    parts = [(shingle_set[s : s + 2048, None] * FACTORS).min(axis=0) for s in range(0, len(shingle_set), 2048)]
    return reduce(np.minimum, parts)


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, mark, sketch, tokens): the set's 128-bit mark, one byte of each minwise token, and 32 bits of each. Null for an empty set."""
    on_workers(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text"):
            rows = []
            for text in batch.column(1).to_pylist():
                s = shingles(text)
                if len(s):
                    tokens = minwise(s)
                    rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), (tokens >> np.uint64(20)).astype(np.uint8).tobytes(), (tokens >> np.uint64(16)).astype(np.uint32).view(np.int32)))
                else:
                    rows.append((0, None, None, None))
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows), kinds)]], ["doc_id", "n_shingles", "mark", "sketch", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, mark binary, sketch binary, tokens array<int>")


def likely(a: np.ndarray, b: np.ndarray, size_a, size_b) -> np.ndarray:
    """Sketches agree enough, and the sizes allow the similarity at all."""
    return ((a == b).mean(axis=-1) >= LEAST_SKETCH) & (100 * np.minimum(size_a, size_b) >= PERCENT * np.maximum(size_a, size_b))


def groups_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows that come sorted by their first column, in whole groups: tables, and where their groups begin and end."""
    held = None
    for batch in chain(batches, [None]):
        if batch is not None:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
        if held is None:
            return
        key = held.column(0).to_numpy()
        cut = held.num_rows if batch is None else int(np.searchsorted(key, key[-1]))
        if cut:
            yield held.slice(0, cut).combine_chunks(), np.r_[0, np.flatnonzero(np.diff(key[:cut])) + 1, cut]
            held = held.slice(cut) if cut < held.num_rows else None


def by_group(rows: DataFrame) -> DataFrame:
    """Rows of a group together in one task, one after the other."""
    return rows.repartition("group").sortWithinPartitions("group")


def agreements(sketch: np.ndarray, size: np.ndarray, comp: np.ndarray | None = None, block: np.ndarray | None = None) -> np.ndarray:
    """Number of equal positions of every two sketches, 0 where that is too few, the sizes forbid a link, or component or block are the same."""
    parts, places = [], np.arange(len(sketch))
    for a in range(0, len(sketch), 64):
        own = slice(a, a + 64)
        same = (sketch[own, None, :] == sketch[None, :, :]).sum(axis=2, dtype=np.int16)
        ok = (same >= LEAST_SKETCH * sketch.shape[1]) & (places[own, None] != places) & (
            100 * np.minimum(size[own, None], size) >= PERCENT * np.maximum(size[own, None], size))
        for tag in (comp, block):
            if tag is not None:
                ok &= tag[own, None] != tag
        parts.append(np.where(ok, same, 0).astype(np.int16))
    return np.concatenate(parts)


def forest(weight: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the heaviest edges of a graph; 0 is no edge."""
    n, edges = len(weight), []
    left, best, parent = np.ones(n, bool), np.zeros(n, np.int16), np.zeros(n, np.int32)
    for _ in range(n):
        x = int(np.where(left, best, -1).argmax())
        if best[x] > 0:
            edges.append((int(parent[x]), x))
        left[x] = False
        better = weight[x] > best
        best, parent = np.where(better, weight[x], best), np.where(better, x, parent)
    return edges


def parted(n: int, edges: list[tuple[int, int]]) -> list[list[int]]:
    """Members of the components with at least one edge."""
    root = list(range(n))
    members = {i: [i] for i in range(n)}
    for a, b in edges:
        a, b = root[a], root[b]
        if a != b:
            if len(members[a]) < len(members[b]):
                a, b = b, a
            for x in members[b]:
                root[x] = a
            members[a] += members.pop(b)
    return [m for m in members.values() if len(m) > 1]


def sketch_rows(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def pairs_of_nodes(members: DataFrame) -> DataFrame:
    """Candidates inside nodes: a spanning forest of the likeliest pairs. ``members``: node, id, size, sketch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in groups_of(batches):
            ids, size, sketch = table.column("id").to_numpy(), table.column("size").to_numpy(), sketch_rows(table.column("sketch"))
            two = edges[:-1][np.diff(edges) == 2]
            two = two[likely(sketch[two], sketch[two + 1], size[two], size[two + 1])]
            left, right = [ids[two]], [ids[two + 1]]
            for a, b in zip(edges[:-1], edges[1:]):
                if b - a > 2:
                    order = a + np.argsort(ids[a:b])
                    found = np.array(forest(agreements(sketch[order], size[order])), np.int64).reshape(-1, 2)
                    left.append(ids[order][found[:, 0]])
                    right.append(ids[order][found[:, 1]])
            left, right = np.concatenate(left), np.concatenate(right)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(left, right)), pa.array(np.maximum(left, right))], ["a", "b"])

    rows = by_group(members.select(F.col("node").alias("group"), "id", "size", "sketch"))
    return rows.mapInArrow(run, "a long, b long")


def pairs_with_pivot(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Candidates of large nodes: each class with the node's pivot."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
            ok = likely(a, b, batch.column(4).to_numpy(zero_copy_only=False), batch.column(5).to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in batch.columns[:2]], ["a", "b"])

    pivots = classes.select(F.col("id").alias("pivot"), F.col("sketch").alias("pivot_sketch"), F.col("size").alias("pivot_size"))
    pairs = members.join(pivots, "pivot").filter("id <> pivot")
    return pairs.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"), "sketch", "pivot_sketch", "size", "pivot_size").mapInArrow(run, "a long, b long")


def coordinate(tree, level: int, round_: int):
    """Number from 0 of the coordinate on which a tree branches at a level from 0; each round puts others together."""
    return (tree + level * round_) % TREES * LEVELS + (level + round_) % LEVELS


def roots_of(classes: DataFrame, round_: int) -> DataFrame:
    """(id, comp, size, tree, node): the nodes of level ``FIRST``; most texts are alone there."""
    nodes = F.array(*[F.xxhash64(F.lit(t), *[F.element_at("tokens", coordinate(t, level, round_) + 1) for level in range(FIRST)]) for t in range(TREES)])
    return classes.select("id", "comp", "size", F.posexplode(nodes).alias("tree", "node"))


def first_pairs(classes: DataFrame) -> DataFrame:
    """Distinct candidate pairs of the first walk, at most one a class and node. ``classes``: id, comp, size, sketch, tokens."""
    frontier = roots_of(classes, 0).select("id", "node")
    nodes = frontier.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min_by("id", F.xxhash64("id", F.lit(0))).alias("pivot")).filter("n > 1")
    members = frontier.join(nodes, "node").join(classes.select("id", "size", "sketch"), "id")
    small = pairs_of_nodes(members.filter(F.col("n") <= LEAF))
    return small.unionByName(pairs_with_pivot(members.filter(F.col("n") > LEAF), classes)).distinct()


def involved(classes: DataFrame, round_: int) -> tuple[DataFrame, DataFrame | None]:
    """(group, id, comp) of the classes that may be linked with another component of their node, and the classes of nodes that have branched, if any.

    A group holds what hangs together by such pairs in a node, or in two blocks of a large one; groups of several nodes are put ``together``.
    """
    found, branched = [], None
    frontier = roots_of(classes, round_)
    for level in range(FIRST, LEVELS + 1):
        nodes = staged(frontier.groupBy("node").agg(
            F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"), F.min("comp").alias("least"), F.max("comp").alias("most")
        ).filter((F.col("n") > 1) & (F.col("least") != F.col("most"))).drop("least", "most"))
        last = level == LEVELS or nodes.filter(F.col("n") > MODERATE).isEmpty()
        whole = nodes if last else nodes.filter(F.col("n") <= MODERATE)
        found.append(apart(frontier.join(whole, "node").join(classes.select("id", "sketch"), "id")))
        if last:
            break
        large = staged(frontier.join(nodes.filter(F.col("n") > MODERATE).select("node"), "node"))
        branched = branched or large.select("id").distinct()
        at = F.element_at("tokens", (coordinate(F.col("tree"), level, round_) + 1).cast("int"))
        frontier = large.select("id", "comp", "size", "tree", "node").join(classes.select("id", "tokens"), "id").select("id", "comp", "size", "tree", F.xxhash64("node", at).alias("node"))
    return together(reduce(DataFrame.unionByName, found).dropDuplicates(["group", "id"])), branched


def mark_of(ids: np.ndarray) -> int:
    """A number for a set of classes."""
    return xxhash.xxh3_64_intdigest(np.sort(ids).tobytes())


def apart(members: DataFrame) -> DataFrame:
    """(group, id, comp, size) of one level's nodes, see ``involved``: every part of a node, in all trees."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in groups_of(batches):
            of_one, block, ids, comp, size = (table.column(c).to_numpy() for c in ("of_one", "block", "id", "comp", "size"))
            sketch = sketch_rows(table.column("sketch"))
            two = edges[:-1][np.diff(edges) == 2]
            ok = likely(sketch[two], sketch[two + 1], size[two], size[two + 1]) & (comp[two] != comp[two + 1]) & (of_one[two] | (block[two] != block[two + 1]))
            two = two[ok]
            marks = np.array([mark_of(ids[[x, x + 1]]) for x in two], np.uint64).view(np.int64)
            rows, group = [two, two + 1], [marks, marks]
            for a, b in zip(edges[:-1], edges[1:]):
                if b - a > 2:
                    own = slice(a, b)
                    same = agreements(sketch[own], size[own], comp[own], None if of_one[a] else block[own])
                    if same.any():
                        for part in parted(b - a, forest(same)):
                            rows.append(a + np.array(part))
                            group.append(np.full(len(part), mark_of(ids[rows[-1]]), np.uint64).view(np.int64))
            rows, group = np.concatenate(rows), np.concatenate(group)
            yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(ids[rows]), pa.array(comp[rows]), pa.array(size[rows])], ["group", "id", "comp", "size"])

    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    cut = members.withColumn("blocks", F.when((F.col("n") <= MODERATE) & (F.col("shingles") <= 2 * BLOCK_SHINGLES), F.lit(1)).otherwise(blocks))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    rows = cut.select(F.xxhash64("node", low, high).alias("group"), (low == high).alias("of_one"), "block", "id", "comp", "size", "sketch")
    return by_group(rows).mapInArrow(run, "group long, id long, comp long, size long")


def together(rows: DataFrame) -> DataFrame:
    """(group, id, comp): groups that hang together by common classes are one, and a class is in it once.

    What would have more than ``WHOLE`` classes or a block's shingles keeps its groups. ``rows``: group, id, comp, size.
    """
    rows = staged(rows)
    if rows.isEmpty():
        return rows.drop("size")
    firsts = rows.groupBy("group").agg(F.min("id").alias("first"))
    roots = smallest_reachable(rows.join(firsts, "group").select(F.col("id").alias("a"), F.col("first").alias("b")))
    placed = staged(rows.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")))
    sums = placed.dropDuplicates(["id"]).groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"))
    whole = sums.filter((F.col("n") <= WHOLE) & (F.col("shingles") <= BLOCK_SHINGLES)).select("root", F.xxhash64("root", F.lit("whole")).alias("whole"))
    return placed.join(whole, "root", "left").select(F.coalesce("whole", "group").alias("group"), "id", "comp").dropDuplicates(["group", "id"])


def links_of(ids: np.ndarray, comp: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links between components, by full sets: shingles that two sets share become columns of a matrix that is multiplied with itself."""
    n, size = len(sets), np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), size)
    column, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    owner, column = owner[many[column] > 1], column[many[column] > 1]
    column = np.unique(column, return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((n, n), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        dense = np.zeros((n, COLUMNS), np.float32)
        dense[owner[a:b], column[a:b] - first] = 1
        both += dense @ dense.T
    # Counts below 2**24 are exact in floats of four bytes; a block has no more shingles than that.
    links = [(comp[x] != comp) & ((100 + PERCENT) * both[x].astype(np.int64) >= PERCENT * (size[x] + size)) for x in range(n)]
    return [(int(ids[x]), int(ids[y])) for x, y in forest(np.array(links, np.int16))]


def exact_links(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): the links inside groups of classes, as far as they join components. ``rows``: group, id, comp."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in groups_of(batches):
            ids, comp, found = table.column("id").to_numpy(), table.column("comp").to_numpy(), []
            raw = table.column("shingles").to_pylist()
            for a, b in zip(edges[:-1], edges[1:]):
                found += links_of(ids[a:b], comp[a:b], [np.frombuffer(x, np.uint64) for x in raw[a:b]])
            pairs = np.sort(np.array(found, np.int64).reshape(-1, 2), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    full = by_group(rows.join(sets, "id").select("group", "id", "comp", "shingles"))
    return full.mapInArrow(run, "a long, b long").distinct()


def needed_bits(wanted: DataFrame) -> np.ndarray:
    """Filter of the documents to read again, as bytes: ``FILTER_BITS`` bits whatever their number."""
    ids = wanted.select(F.pmod(F.xxhash64("first_doc"), F.lit(FILTER_BITS)).alias("bit"))
    rows = ids.groupBy(F.expr("bitmap_bucket_number(bit)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("bits")).collect()
    out = np.zeros((FILTER_BITS >> 15) + 2, "V4096")
    for bucket, bits in rows:
        out[bucket] = bytes(bits)
    return out.view(np.uint8)


def sets_of(docs: DataFrame, owners: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, shingles) of some classes, made again from the text of the document that stands for each.

    A task gives every set once. They are dealt by id and no more: joins on it find them in place.
    """
    wanted = staged(owners.join(ids.select("id").distinct(), "id").select("id", "first_doc"))
    bits = needed_bits(wanted)
    bucket, place = F.expr("bitmap_bucket_number(bit)"), F.expr("bitmap_bit_position(bit)")
    wide = docs.select("doc_id", "text").filter("doc_id is not null").withColumn("bit", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))).select("doc_id", "text", (bucket * 32768 + place).cast("long").alias("bit"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = set()
        for batch in pieces_of(batches, "text"):
            bit = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1))
            sets = [s.tobytes() for s in map(shingles, batch.column(1).to_pylist())]
            new = {m: s for m, s in zip(map(xxhash.xxh3_128_digest, sets), sets) if m not in given}
            given.update(new)
            yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.binary()), pa.array(list(new.values()), pa.binary())], ["mark", "shingles"])

    made = wide.mapInArrow(run, "mark binary, shingles binary").select(F.xxhash64("mark").alias("id"), "shingles")
    return made.join(wanted.select("id"), "id", "left_semi").dropDuplicates(["id"])


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    with_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    both = with_a.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """(id, root) of every id in (a, b): stars are made larger and smaller in turn until all point to the smallest id of their component."""
    edges = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while not stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        wide = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = wide.groupBy("u").agg(F.min("v").alias("m"))
        deep = wide.join(least, "u")
        edges = staged(deep.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(deep.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))


def stars(edges: DataFrame) -> bool:
    """Whether every ``u`` has one ``v``, and no ``v`` is a ``u``."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("at")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("at")))
    return ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("at").alias("at")).filter("out > 1 or (out > 0 and at > 0)").isEmpty()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Texts without words have an empty set and are linked with nothing. Rows that repeat a doc_id are
    compared by their own texts; rows with equal sets share a component. Rows without a doc_id are alone, with a null
    component, and stay. ``kept`` is doc_id = component_id.
    """
    described_ = staged(described(docs))
    full = described_.filter("n_shingles > 0 and doc_id is not null")
    own = staged(full.groupBy("mark").agg(F.xxhash64("mark").alias("id"), F.min("doc_id").alias("first_doc"), F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch"), F.first("tokens").alias("tokens")))
    labels = None
    pairs = staged(first_pairs(own.withColumn("comp", F.col("id"))))
    if not pairs.isEmpty():
        links = staged(confirmed(pairs, sets_of(docs, own, pairs.select(F.explode(F.array("a", "b")).alias("id")))))
        labels = None if links.isEmpty() else smallest_reachable(links)
    round_, rest = 0, None
    while True:
        sought = own if rest is None else own.join(rest, "id", "left_semi")
        labelled = sought.withColumn("comp", F.col("id")) if labels is None else staged(sought.join(labels, "id", "left").withColumn("comp", F.coalesce("root", "id")).drop("root"))
        rows, branched = involved(labelled, round_)
        rows = staged(rows)
        links = staged(exact_links(rows, sets_of(docs, own, rows))) if not rows.isEmpty() else None
        if links is None or links.isEmpty():
            break
        old = [] if labels is None else [labels.select(F.col("id").alias("a"), F.col("root").alias("b"))]
        labels = smallest_reachable(reduce(DataFrame.unionByName, [links, *old]))
        if branched is None:
            break
        # Two classes that met, but never in a whole node, are both in nodes that have branched.
        rest = staged(branched) if rest is None else staged(branched.join(rest, "id", "left_semi"))
        round_ += 1
    rooted = own.withColumn("root", F.col("id")) if labels is None else own.join(labels, "id", "left").withColumn("root", F.coalesce("root", "id"))
    smallest = rooted.groupBy("root").agg(F.min("first_doc").alias("smallest"))
    roots = rooted.select("mark", "root").join(smallest, "root").select("mark", "smallest")
    out = described_.select("doc_id", "n_shingles", "mark").join(roots, "mark", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("smallest", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stand for their component, columns as given. Rows that share a doc_id stay or go together; rows without one stay."""
    found = near_duplicates(docs.select("doc_id", "text")).filter("doc_id is not null").groupBy("doc_id").agg(F.bool_or("kept").alias("kept"))
    return docs.join(staged(found.filter(~F.col("kept")).select("doc_id")), "doc_id", "left_anti").select(docs.columns)
