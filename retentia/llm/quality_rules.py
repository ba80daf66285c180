"""Quality rules: counts of a text, and how far its letters and words diverge from its language.

For each language the whole table gives a reference: shares of character classes, and of its most
common words. A document's own histograms are compared with the reference of its language by the
Jensen-Shannon distance. Short texts are too noisy for that and are judged by the counts alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from retentia.llm.batches import on_workers, pieces_of, staged, texts_of

BLANKS, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
WINDOW = 5
#: Words a reference keeps, and languages whose references the workers get at the start; those of further ones are joined to their documents.
COMMON_WORDS, LANGUAGES = 64, 256
#: A text with fewer words is not compared.
LEAST_WORDS = 50
#: Largest distances of a document that stays; what chance adds for n characters or words is granted besides (as squares, like the divergences).
MOST_CHAR_DISTANCE, MOST_WORD_DISTANCE = 0.25, 0.42
#: Distinct words a task holds before it hands on their counts.
HELD_WORDS = 200_000

# Character classes by UTF-8 byte: a letter a-z each, capitals, digits, blanks, line feed, three groups of signs, other bytes.
CLASSES = np.full(256, 33, np.int64)
CLASSES[np.arange(ord("a"), ord("z") + 1)] = np.arange(26)
CLASSES[np.arange(ord("A"), ord("Z") + 1)] = 26
CLASSES[np.arange(ord("0"), ord("9") + 1)] = 27
CLASSES[[ord(c) for c in BLANKS]] = 28
CLASSES[ord("\n")] = 29
CLASSES[[ord(c) for c in ".,;:?'\"()-"]] = 30
CLASSES[[ord(c) for c in SYMBOLS]] = 31
CLASSES[[b for b in range(33, 127) if CLASSES[b] == 33]] = 32
N_CLASSES = 34
ALL = "*"


def char_histogram(raw: bytes) -> np.ndarray:
    return np.bincount(CLASSES[np.frombuffer(raw, np.uint8)], minlength=N_CLASSES)


def distance(a: np.ndarray, b: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms, from 0 to 1; 0 if one is empty."""
    if not a.sum() or not b.sum():
        return 0.0
    p, q = a / a.sum(), b / b.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        total = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(0.0, total / 2)))


def counts_of(text: str, raw: bytes, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    chars = len(text) - sum(raw.count(c) for c in BLANKS.encode())
    symbols = sum(raw.count(c) for c in SYMBOLS.encode())
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    repeated = 0
    if len(words) > WINDOW:
        # Words are told apart by 64-bit hashes within one text.
        h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
        key = np.zeros(len(words) - WINDOW + 1, np.uint64)
        for k in range(WINDOW):
            key = (key ^ h[k : len(key) + k]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        if same.any():
            twice = np.zeros(len(key), bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            covered = np.zeros(len(words), bool)
            for k in range(WINDOW):
                covered[k : len(key) + k] |= twice
            repeated = int(covered.sum())
    return chars, symbols, len(lines) - len(set(lines)), repeated


def language_counts(docs: DataFrame) -> DataFrame:
    """(lang, kind, item, n): character classes (kind c) and words in lower case (kind w) of each language and, under ``*``, of all. Exact, over all rows."""
    on_workers(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars: dict[str | None, np.ndarray] = {}
        words: dict[str | None, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [(lang, "c", str(i).encode(), n) for lang, h in chars.items() for i, n in enumerate(h.tolist()) if n]
            rows += [(lang, "w", w, n) for lang, c in words.items() for w, n in c.items()]
            chars.clear()
            words.clear()
            for a in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 50_000]), (pa.string(), pa.string(), pa.binary(), pa.int64()))], ["lang", "kind", "item", "n"])

        for batch in pieces_of(batches, "text"):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = text.encode()
                chars[lang] = chars.get(lang, 0) + char_histogram(raw)
                words.setdefault(lang, Counter()).update(raw.lower().split())
            if sum(map(len, words.values())) > HELD_WORDS:
                yield from flush()
        yield from flush()

    given = texts_of(docs, "lang")
    return given.mapInArrow(run, "lang string, kind string, item binary, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))


def reference(rows: Iterable[tuple]) -> tuple[np.ndarray, dict[bytes, int], np.ndarray]:
    """A language's character histogram, the numbers of its most common words, and their counts and that of all other words."""
    h, words, total = np.zeros(N_CLASSES, np.int64), {}, 0
    for kind, item, n in rows:
        if kind == "c":
            h[int(bytes(item))] = n
        elif kind == "w":
            words[bytes(item)] = n
        else:
            total = n
    names = sorted(words)
    kept = [words[w] for w in names]
    return h, {w: i for i, w in enumerate(names)}, np.array([*kept, total - sum(kept)])


def references(docs: DataFrame) -> tuple[dict[str, tuple], DataFrame | None]:
    """The references of the languages with most words and, as ``*``, of the whole table; and a table (lang, rows) of all further ones, None if there are none.

    At most ``LANGUAGES`` + 1 times (34 + 64 + 1) rows reach the driver.
    """
    counts = staged(language_counts(docs))
    both = counts.filter(F.col("lang").isNotNull() & (F.col("lang") != ALL)).unionByName(
        counts.groupBy("kind", "item").agg(F.sum("n").alias("n")).withColumn("lang", F.lit(ALL)))
    common = both.filter(F.col("kind") == "w").withColumn("nth", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "item"))).filter(F.col("nth") <= COMMON_WORDS).drop("nth")
    sums = both.groupBy("lang", "kind").agg(F.sum("n").alias("n"))
    rows = common.unionByName(both.filter(F.col("kind") == "c")).unionByName(sums.filter(F.col("kind") == "w").select("lang", F.lit("t").alias("kind"), F.lit(None).cast("binary").alias("item"), "n"))
    of_lang = sums.filter(F.col("kind") == "w").orderBy(F.desc("n"), "lang").limit(LANGUAGES + 2).select("lang").collect()
    largest = [r.lang for r in of_lang[: LANGUAGES + 1]]
    found: dict[str, list] = {}
    for lang, *row in rows.filter(F.col("lang").isin(largest)).select("lang", "kind", "item", "n").collect():
        found.setdefault(lang, []).append(row)
    further = None
    if len(of_lang) > len(largest):
        further = staged(rows.filter(~F.col("lang").isin(largest)).groupBy("lang").agg(F.collect_list(F.struct("kind", "item", "n")).alias("rows")))
    return {lang: reference(r) for lang, r in found.items()}, further


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance, kept.

    ``base_failed``: under 10 words, or over a fifth of them in repeated windows. Of the others those are
    kept that are short or near their language. A missing or empty text has no words and fails. A
    missing language is compared with the whole table. Rows with equal ids stay apart.
    """
    on_workers(docs.sparkSession)
    known, further = references(docs)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text"):
            rows = []
            joined = batch.column(3) if batch.num_columns > 3 else None
            for at, (lang, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                raw = text.encode()
                words = raw.split()
                n = len(words)
                chars, symbols, lines, repeated = counts_of(text, raw, words)
                failed = n < 10 or 100 * repeated > 20 * n
                of_chars = of_words = 0.0
                if n >= LEAST_WORDS and known:
                    own_rows = joined[at].as_py() if joined is not None else None
                    ref_chars, index, ref_words = reference((r["kind"], r["item"], r["n"]) for r in own_rows) if own_rows else known.get(lang) or known[ALL]
                    other = len(index)
                    own = np.bincount(np.fromiter((index.get(w, other) for w in raw.lower().split()), np.int64, n), minlength=other + 1)
                    of_chars, of_words = distance(char_histogram(raw), ref_chars), distance(own, ref_words)
                near = of_chars <= np.hypot(MOST_CHAR_DISTANCE, chance(N_CLASSES, len(raw))) and of_words <= np.hypot(MOST_WORD_DISTANCE, chance(COMMON_WORDS, n))
                rows.append((n, chars, symbols, lines, repeated, failed, of_chars, of_words, bool(not failed and near)))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 9, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], NAMES)

    shape = (
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, char_distance double, word_distance double, kept boolean")
    given = texts_of(docs, "doc_id", "lang")
    if further is None:
        return given.mapInArrow(run, shape)
    # Only texts of further languages are joined; the others have their references already.
    at_hand = F.coalesce(F.col("lang").isin(list(known)), F.lit(True))
    return given.filter(at_hand).mapInArrow(run, shape).unionByName(given.filter(~at_hand).join(further, "lang", "left").select("doc_id", "lang", "text", "rows").mapInArrow(run, shape))


NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"]


def chance(bins: int, n: int) -> float:
    """Distance that drawing n items alone makes likely: the root of the divergence's mean (bins - 1) / (8 n ln 2)."""
    return float(np.sqrt((bins - 1) / (8 * max(n, 1) * np.log(2))))
