"""Chat formatting with prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns as context, and only that reply
trainable. A turn is ``<s>role[INST]text[/INST]</s>``. Control strings inside roles and texts get a
backslash after their first character, one more if they have some already, so no escaped text holds a
control string and dropping one backslash restores it.

A conversation whose last turn is no reply also gets one row without trainable characters, so that the
rows hold every turn. Turns with the same number are ordered by role and text. Null roles and texts are
empty. A row with a null conversation id belongs to no other row: it is a conversation of one turn, formatted where
it is read. Other columns are ignored, an empty table gives no rows. A conversation is windowed, not collected: its
rows are sorted and spill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, HEAD, TAIL = "<s>", "[INST]", "[/INST]</s>"
#: First character, backslashes, rest of a control string.
CONTROL = r"(<|\[)(\\*)(/?s>|/?INST\])"
ESCAPED = r"(<|\[)\\(\\*)(/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def format_chats(turns: DataFrame, reply_role: str = "assistant") -> DataFrame:
    """(conv_id, turn, role, text) to (conv_id, example, formatted, loss_start, loss_chars, is_last).

    The trainable characters of ``formatted`` are loss_chars from the 0-based loss_start on.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    pieces = (
        turns.select("conv_id", "turn", role, text)
        .withColumn("head", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(HEAD)))
        .withColumn("body", escape(F.col("text")))
        .withColumn("piece", F.concat("head", "body", F.lit(TAIL)))
    )
    reply = F.col("role") == reply_role
    own = ("role", F.length("head").alias("head"), F.length("body").alias("body"))
    size = F.length("piece").cast("long")
    placed = (
        pieces.where("conv_id IS NOT NULL")
        .select(
            "conv_id",
            *own,
            F.row_number().over(order).alias("example"),
            F.lead("role").over(order).isNull().alias("is_last"),
            F.sum(size).over(upto).alias("end"),
            F.collect_list("piece").over(upto).alias("prefix"),
        )
        .where(reply | F.col("is_last"))
    )
    nothing = F.lit(None).cast(turns.select("conv_id").schema[0].dataType).alias("conv_id")  # a literal, so that plans by id leave these rows out
    alone = pieces.where("conv_id IS NULL").select(nothing, *own, F.lit(1).alias("example"), F.lit(True).alias("is_last"), size.alias("end"), F.array("piece").alias("prefix"))
    return placed.unionByName(alone).select(
        "conv_id",
        "example",
        F.array_join("prefix", "").alias("formatted"),
        F.when(reply, F.col("end") - len(TAIL) - F.col("body")).otherwise(F.col("end")).cast("int").alias("loss_start"),
        F.when(reply, F.col("body")).otherwise(0).alias("loss_chars"),
        "is_last",
    )


def trainable(formatted: str = "formatted") -> Column:
    """The unescaped text under the loss mask of an example."""
    return unescape(F.substring(F.col(formatted), F.col("loss_start") + 1, F.col("loss_chars")))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of the turns in a formatted text."""
    pieces = F.filter(F.split(formatted, r"\[/INST\]</s>"), lambda p: p != "")
    start = len(OPEN) + 1
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring_index(F.substring(p, F.lit(start), F.length(p)), HEAD, 1)).alias("role"),
            unescape(F.substring(p, F.instr(p, F.lit(HEAD)) + len(HEAD), F.length(p))).alias("text"),
        ),
    )


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation (of rows with a null id: per row), read back from the examples: turns and trainable text as digests."""
    parts = examples.select(
        "conv_id",
        "example",
        F.length("formatted").cast("long").alias("chars"),
        F.when(F.col("loss_chars") > 0, trainable()).alias("loss"),
        F.when(F.col("is_last"), read_turns(F.col("formatted"))).alias("turns"),
    )
    whole = parts.where("conv_id IS NOT NULL").groupBy("conv_id").agg(
        F.sum("chars").alias("formatted_chars"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))), lambda x: x["loss"]), "").alias("loss"),
        F.first("turns", ignorenulls=True).alias("turns"),
    )
    alone = parts.where("conv_id IS NULL").select("conv_id", F.col("chars").alias("formatted_chars"), F.coalesce("loss", F.lit("")).alias("loss"), "turns")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return whole.unionByName(alone).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CASE WHEN conv_id IS NULL THEN row_number() OVER () ELSE 0 END AS own FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]', 0 UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]', 0),
e AS (SELECT *, length(regexp_replace(role, '(<|\[)(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) + length(regexp_replace(text, '(<|\[)(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) + 20 AS n FROM t),
c AS (SELECT *, sum(n) OVER w AS upto, lead(role) OVER w IS NULL AS is_last FROM e WINDOW w AS (PARTITION BY conv_id, own ORDER BY turn, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(upto) FILTER (WHERE role = 'assistant' OR is_last)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id, own
"""
