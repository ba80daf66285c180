"""Dropping lines that many documents share, with DataFrame functions only.

Long lines become 128-bit hashes. (hash, document, position) rows are placed by range and sorted, so
that one very common line spreads over many tasks; the first row of each (hash, document) run is a
first occurrence. Counts and the largest document are summed per partition before they meet. The
answer is a bitmap of dropped lines per document that stores only the words with a set bit; texts
are never moved by the search.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from retentia.llm.batches import staged

BLANKS = " \t\n\x0b\x0c\r"
#: Parts that the lines of one key are split into when they meet the common keys.
SALTS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z as a-z."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def lines_of(text: Column) -> Column:
    """Lines between line feeds; a missing or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def long_lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """(doc_id, mark, pos, key) of the lines that may be dropped, the key hashed."""
    line = F.posexplode(lines_of(F.col("text"))).alias("pos", "line")
    lines = docs.select("doc_id", text_mark().alias("mark"), line).filter(F.char_length("line") >= least_chars)
    keyed = lines.select("doc_id", "mark", "pos", line_key(F.col("line")).alias("line")).filter(F.char_length("line") >= least_chars)
    return keyed.select("doc_id", "mark", "pos", F.unhex(F.md5("line")).alias("key"))


def text_mark() -> Column:
    """Tells rows apart that share a doc_id; rows of equal text lose the same lines anyway."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def common_lines(lines: DataFrame, least_docs: int) -> DataFrame:
    """(key, keeper): keys in at least ``least_docs`` documents and the largest document that holds each."""
    placed = lines.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id", "pos")
    first = placed.withColumn("nth", F.row_number().over(W.partitionBy("key", "doc_id").orderBy("pos")))
    seen = first.groupBy("key").agg(F.count_if(F.col("nth") == 1).alias("n_docs"), F.max("doc_id").alias("keeper"))
    return seen.filter(F.col("n_docs") >= least_docs).select("key", "keeper")


def dropped_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """Bitmaps of the lines to drop, for documents that lose any: doc_id, mark, n_dropped, ``words array<struct<word, bits>>``.

    Bit ``b`` of word ``w`` stands for line ``64 * w + b``; words without a set bit are left out.
    Rows without a doc_id are in no bitmap. Rows that share a doc_id count as one document for the
    number of documents; each text of them, told by the hash ``mark``, has bits of its own.
    """
    lines = staged(long_lines(docs.filter(F.col("doc_id").isNotNull()), least_chars))  # read three times: to choose ranges, to count, to mark
    # The lines of one very common key meet it in several tasks.
    common = common_lines(lines, least_docs).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id", "mark", "pos"), F.lit(SALTS)).cast("int"))
    lost = salted.join(common, ["key", "salt"]).filter(F.col("doc_id") != F.col("keeper"))
    bit = F.expr("shiftleft(1L, cast(pos % 64 as int))")
    words = lost.groupBy("doc_id", "mark", F.expr("cast(pos div 64 as int)").alias("word")).agg(F.bit_or(bit).alias("bits"))
    return words.groupBy("doc_id", "mark").agg(
        F.sum(F.bit_count("bits")).alias("n_dropped"), F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words")
    )


def kept_flags(words: Column, n_lines: Column) -> Column:
    """The bitmap unpacked: one boolean per line, true if it stays."""
    dense = F.flatten(F.transform(words, lambda w, i: F.concat(
        F.array_repeat(F.lit(0).cast("long"), w["word"] - F.when(i == 0, 0).otherwise(F.get(words, i - 1)["word"] + 1)), F.array(w["bits"])
    )))
    return F.transform(F.sequence(F.lit(0), n_lines - 1), lambda i: F.coalesce(
        F.getbit(F.get(dense, F.shiftright(i, 6)), i % 64), F.lit(0).cast("tinyint")) == 0)


def with_kept_text(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """The documents with ``n_lines``, ``n_dropped`` and ``kept_text``: the lines that stay, joined by line feeds.

    A missing or empty text is one empty line and stays empty. Repeated doc_ids each keep a row and lose lines by their
    own text; rows without a doc_id lose none. Given columns stay as they are: an added one whose name is taken gets
    underscores behind it. An empty table gives an empty one.
    """
    names = docs.columns
    plain = docs.toDF(*[c if c in ("doc_id", "text") else f"_{i}" for i, c in enumerate(names)])
    marks = dropped_lines(plain.select("doc_id", "text"), least_chars, least_docs)
    lines = plain.withColumn("mark", text_mark()).join(marks, ["doc_id", "mark"], "left").withColumn("lines", lines_of(F.col("text")))
    flags = kept_flags(F.col("words"), F.size("lines"))
    stay = F.transform(F.filter(F.arrays_zip(F.col("lines").alias("line"), flags.alias("keep")), lambda x: x["keep"]), lambda x: x["line"])
    text = F.when(F.col("words").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(stay, "\n"))
    added = {"n_lines": F.size("lines").cast("long"), "n_dropped": F.coalesce("n_dropped", F.lit(0)).cast("long"), "kept_text": text}
    out = lines.withColumns({f"_{name}": value for name, value in added.items()}).select(*plain.columns, *[f"_{name}" for name in added])
    final = list(names)
    for name in added:
        while name in final:
            name += "_"
        final.append(name)
    return out.toDF(*final)


def drop_common_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """The documents with the common lines gone from ``text``; all columns as given otherwise. A missing text stays missing."""
    kept = with_kept_text(docs, least_chars, least_docs)
    text = F.when(F.col("text").isNotNull(), F.col(kept.columns[-1]))
    return kept.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
