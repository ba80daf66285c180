"""Chat formatting with a grammar that is read back, with DataFrame functions only.

A turn is written as ``### role: body</turn>`` and a line feed. The reader cuts at every ``</turn>`` and
undoes backslashes; it takes a piece for a turn only if that begins with a head, holds no second ``### `` and
does not end inside an escape. A body is the text itself if the reader gives back role and text from it.
Otherwise it is escaped: ``\\`` becomes ``\\\\`` and the control strings get a backslash inside (``#\\## ``,
``<\\/turn>``); the escaped turn is read and compared again, and so is the whole conversation at the
end. What still differs is an error, not a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN, CLOSE = "### ", "</turn>"


def escaped(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit(OPEN), F.lit("#\\## ")), F.lit(CLOSE), F.lit("<\\/turn>"))


def unescaped(body: Column) -> Column:
    return F.when(F.contains(body, F.lit("\\")), F.regexp_replace(body, r"(?s)\\(.)", "$1")).otherwise(body)


def head(role: Column) -> Column:
    """Start of a turn: the role, its colons and control strings escaped."""
    name = F.replace(escaped(role), F.lit(":"), F.lit("\\:"))
    return F.concat(F.lit(OPEN), name, F.lit(": "))


def read_turns(formatted: Column) -> Column:
    """The reader: ``array<struct<role, text, body>>`` of a formatted conversation, null members for what is no turn."""
    pieces = F.split(formatted, CLOSE, -1)
    cut = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p, i: F.struct(
        F.when(i == 0, p).when(F.startswith(p, F.lit("\n")), F.substring(p, F.lit(2), F.char_length(p))).alias("piece"),
        # After the last turn only a line feed may follow.
        (F.element_at(pieces, -1) == "\n").alias("ends"),
    ))
    headed = F.transform(cut, lambda t: F.struct(F.regexp_extract(t["piece"], r"(?s)^### ((?:[^\\:]|\\.)*): ", 1).alias("role"), t["piece"].alias("piece"), t["ends"].alias("ends")))
    bodies = F.transform(headed, lambda t: F.struct(
        t["role"].alias("role"), F.substring(t["piece"], F.char_length(t["role"]) + F.lit(len(OPEN) + 3), F.char_length(t["piece"])).alias("body"),
        (t["ends"] & F.startswith(t["piece"], F.concat(F.lit(OPEN), t["role"], F.lit(": ")))).alias("ok"),
    ))
    return F.transform(bodies, lambda t: F.when(
        t["ok"] & ~F.contains(t["body"], F.lit(OPEN)) & ((F.char_length(t["body"]) - F.char_length(F.rtrim(t["body"], F.lit("\\")))) % 2 == 0),
        F.struct(unescaped(t["role"]).alias("role"), unescaped(t["body"]).alias("text"), t["body"].alias("body")),
    ))


def rendered(turns: DataFrame) -> DataFrame:
    """Adds ``body`` and ``piece``: the text as it is if the reader gives role and text back from that, else escaped, which must read back too."""
    wrap = lambda body: F.concat(head(F.col("role")), body, F.lit(CLOSE + "\n"))
    raw, safe = F.col("text"), escaped(F.col("text"))
    source = F.array(F.struct("role", "text"))
    body = F.when(gives(read_turns(wrap(raw)), source), raw).when(gives(read_turns(wrap(safe)), source), safe)
    body = F.coalesce(body, F.raise_error(F.lit("a turn does not read back")).cast("string"))
    return turns.withColumn("body", body).withColumn("piece", wrap(F.col("body")))


def gives(found: Column, source: Column) -> Column:
    """Whether the turns that were read are the source's, role and text, one by one."""
    return F.transform(found, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))) == source


def format_chats(conversations: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, n_turns, ``formatted`` and the loss mask ``loss_spans``.

    Spans are (start, length) in bytes of the UTF-8 text and cover the bodies of the trained role.
    Turns are in the order of turn, then role and text (missing turns first). A missing role or text
    is empty; rows without conv_id form one conversation; repeated rows are turns of their own; other
    columns are not read. An empty table gives no rows. Stops with an error if a conversation does not read back.
    """
    given = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = rendered(given)
    in_order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = in_order.rowsBetween(W.unboundedPreceding, -1)
    placed = turns.select(
        "conv_id", F.row_number().over(in_order).alias("nth"), "piece", "role", "text",
        F.when(F.col("role") == trained_role, F.struct(
            (F.coalesce(F.sum(F.octet_length("piece")).over(before), F.lit(0)) + F.octet_length(head(F.col("role")))).alias("start"),
            F.octet_length("body").alias("length"),
        )).alias("span"),
    )
    chats = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("nth", "piece", "span", "role", "text"))).alias("turns"))
    whole = chats.withColumn("formatted", F.array_join(F.col("turns.piece"), ""))
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    checked = F.when(gives(read_turns(F.col("formatted")), source), F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not read back")).cast("string"))
    return whole.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), checked.alias("formatted"),
        F.filter(F.col("turns.span"), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_back(chats: DataFrame) -> DataFrame:
    """What the reader finds in formatted conversations: conv_id, ``turns`` and ``loss_text``, unescaped."""
    raw = F.encode("formatted", "UTF-8")
    texts = F.transform("loss_spans", lambda s: unescaped(F.decode(F.substring(raw, (s["start"] + 1).cast("int"), s["length"]), "UTF-8")))
    return chats.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), F.array_join(texts, "").alias("loss_text"))
