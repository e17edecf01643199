"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log holds events (conv_id, seq, message, role, kind, text), in any order. Per conversation they are sorted by seq and
folded: ``delta`` appends to its message, ``edit`` replaces the message's text, ``regenerate`` replaces it and drops what
later messages had been told by then, ``delete`` removes it. The final messages are rendered as

    <s>{<|turn|>role<|text|>text<|end|>}...</s>

Control strings inside roles and texts are escaped by a backslash after their first character (one more where there are
backslashes already), which is undone exactly by taking one away. One shuffle by conversation serves all steps; a
conversation is one row of the result, so it must fit in a row.

Edge cases: null text and null role are empty; a null conv_id is a conversation of its own and a null message one before the
others; a null seq comes before all others, and events equal in seq are taken in the order of text, kind, role and message,
so that of a tie the later one takes effect as anywhere else; repeated events count each time; after a delete, deltas are
lost until the next edit or regenerate; a conversation whose messages are all deleted has no row; an empty log gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

BOS, TURN, TEXT, END, EOS = "<s>", "<|turn|>", "<|text|>", "<|end|>", "</s>"
_AFTER_ANGLE = r"(?:/?s>|<SYS>>|</SYS>>|\|(?:turn|text|end)\|>)"
_AFTER_SQUARE = r"/?INST\]"
_ESCAPE = rf"(?<=<)(?=\\*{_AFTER_ANGLE})|(?<=\[)(?=\\*{_AFTER_SQUARE})"
_UNESCAPE = rf"(?<=<)\\(?=\\*{_AFTER_ANGLE})|(?<=\[)\\(?=\\*{_AFTER_SQUARE})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_ESCAPE), F.lit(r"\\"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_UNESCAPE), F.lit(""))


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text): what the log's events leave of each message."""
    so_far = Window.partitionBy("conv_id").orderBy("message").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = Window.partitionBy("conv_id", "message")
    kind, at = F.col("kind"), F.col("at")
    e = events.select("conv_id", "seq", "message", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("kind", F.lit("delta")).alias("kind"), F.coalesce("text", F.lit("")).alias("text"))
    e = e.withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy("seq", "text", "kind", "role", "message")))
    e = e.withColumn("_cut", F.max(F.when(kind == "regenerate", at)).over(so_far)).where(F.col("_cut").isNull() | (at >= F.col("_cut")))
    e = e.withColumn("_reset", F.max(F.when(kind != "delta", at)).over(own)).where(F.col("_reset").isNull() | (at >= F.col("_reset")))
    pieces = F.sort_array(F.collect_list(F.struct("at", "text", "kind", "role")))
    m = e.groupBy("conv_id", "message").agg(pieces.alias("p"))
    m = m.where(~F.exists("p", lambda x: x.kind == "delete"))
    role = F.coalesce(F.try_element_at(F.filter("p", lambda x: x.role != ""), F.lit(-1)).role, F.lit(""))
    return m.select("conv_id", "message", role.alias("role"), F.array_join(F.transform("p", lambda x: x.text), "").alias("text"))


def render(messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """Per conversation: formatted, and loss_spans (code points of formatted, end exclusive) over the texts of ``trained``."""
    role, text = escape(F.col("role")), escape(F.col("text"))
    t = messages.select("conv_id", "message", "role", role.alias("r"), text.alias("t"))
    t = t.withColumn("turn", F.concat(F.lit(TURN), "r", F.lit(TEXT), "t", F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = (F.sum(F.length("turn").cast("long")).over(order) + len(BOS) - len(END)).alias("end")
    t = t.select("conv_id", "message", "turn", (F.col("role") == trained).alias("loss"), F.length("t").alias("n"), end)
    packed = F.sort_array(F.collect_list(F.struct("message", "turn", "loss", (F.col("end") - F.col("n")).alias("start"), "end")))
    c = t.groupBy("conv_id").agg(packed.alias("p"))
    spans = F.transform(F.filter("p", lambda x: x.loss), lambda x: F.struct(x.start.alias("start"), x.end.alias("end")))
    return c.select("conv_id", F.concat(F.lit(BOS), F.array_join(F.transform("p", lambda x: x.turn), ""), F.lit(EOS)).alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    inner = F.substring(formatted, len(BOS) + 1 + len(TURN), F.length(formatted) - len(BOS) - len(TURN) - len(EOS))
    parts = F.transform(F.split(inner, r"<\|turn\|>"), lambda x: F.split(x, r"<\|text\|>", 2))
    return F.transform(parts, lambda p: F.struct(unescape(p[0]).alias("role"), unescape(F.substring(p[1], F.lit(1), F.length(p[1]) - len(END))).alias("text")))


def turns_as_events(rows: DataFrame) -> DataFrame:
    """A table of (conv_id, turn, role, text) as a log: each row is a message of one delta, in the order of turn, role, text."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    e = rows.select("conv_id", "turn", "role", "text", F.row_number().over(w).cast("long").alias("message"))
    return e.select("conv_id", F.col("message").alias("seq"), "message", "role", F.lit("delta").alias("kind"), "text")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    out = render(fold_events(turns_as_events(rows.unionByName(more))))
    out = out.withColumn("turns", read_back(F.col("formatted")))
    told = F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring("formatted", s.start.cast("int") + 1, (s.end - s.start).cast("int")))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


_SQL_ESCAPED = r"regexp_replace(regexp_replace({}, '(<)(\\*(?:/?s>|</?SYS>>|\|(?:turn|text|end)\|>))', '\1\\\2', 'g'), '(\[)(\\*/?INST\])', '\1\\\2', 'g')"
ORACLE = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, {_SQL_ESCAPED.format("role")} AS er, {_SQL_ESCAPED.format("text")} AS et FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
             coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
             sum(length(er) + length(et) + 23) + 7 AS n FROM o GROUP BY conv_id)
SELECT conv_id::BIGINT AS conv_id, n_turns, sha256(told) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, n::BIGINT AS formatted_chars
FROM g"""
