r"""Chat formatting: render, reparse, compare, escape until identical.

Grammar of the output (deterministic, by literal delimiters)::

    conversation := turn*
    turn         := "<turn>" role "\n" content "</turn>"

A *control string* is ``<turn>`` or ``</turn>``, with any number of backslashes after the ``<``.  Escaping
puts one more backslash there and unescaping takes one away, so that texts which only look like escapes
survive too, and no escaped text holds a delimiter.  A role's newlines and backslashes are escaped likewise.

Each turn is first rendered as it is and reparsed.  The grammar derives no delimiter inside a role or content; where
one stands there, or the recovered turn differs from the source, the conflicting content is escaped.  Then the whole
conversation is reparsed and compared with its source turns: ``round_trip`` says whether they are
identical, and the query fails where they are not.  Only conflicting turns grow.

Defined results: null text or role is empty; rows of one conversation with equal turn numbers are ordered
by role and text, repeated rows are repeated turns; null conversation ids form one conversation; an empty
table gives no rows; other columns are ignored.  One conversation is one output value, so it must fit in
memory as every formatted training example must; nothing else gathers rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, table

OPEN, CLOSE = "<turn>", "</turn>"
#: Texts are read at places of a conversation by chunks of 2^CHUNK code points.
CHUNK = 12


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)(/?turn>)", r"<\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)(/?turn>)", r"<$1$2")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def render(role: Column, content: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), content, F.lit(CLOSE))


def parse(formatted: Column) -> Column:
    """array<struct<role, content>>: what stands between the delimiters, still escaped.  Text that the
    grammar does not derive gives turns that differ from any source."""
    pieces = F.split(formatted, CLOSE)
    turns = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(p: Column) -> Column:
        head = F.substring_index(p, "\n", 1)
        return F.struct(
            F.when(F.startswith(head, F.lit(OPEN)), F.substr(head, F.lit(len(OPEN) + 1))).alias("role"),
            F.substr(p, F.length(head) + 2).alias("content"),
        )

    return F.transform(turns, turn)


def _same(parsed: Column, role: Column, text: Column) -> Column:
    one = F.element_at(parsed, 1)
    inside = F.contains(one["role"], F.lit(OPEN)) | F.contains(one["content"], F.lit(OPEN))
    return F.coalesce((F.size(parsed) == 1) & ~inside & (unescape_role(one["role"]) == role) & (unescape(one["content"]) == text), F.lit(False))


def recovered(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns of an output, unescaped."""
    return F.transform(parse(formatted), lambda t: F.struct(unescape_role(t["role"]).alias("role"), unescape(t["content"]).alias("text")))


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text → + rendered, what it shows as shown_role and shown, escaped."""
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("escaped", ~_same(parse(render(F.col("role"), F.col("text"))), F.col("role"), F.col("text")))
    t = t.withColumn("shown_role", F.when(F.col("escaped"), escape_role(F.col("role"))).otherwise(F.col("role")))
    t = t.withColumn("shown", F.when(F.col("escaped"), escape(F.col("text"))).otherwise(F.col("text")))
    return t.withColumn("rendered", render(F.col("shown_role"), F.col("shown")))


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, spans (start and length in code points, and role, of each turn's content),
    escaped_turns, round_trip.

    Where a turn begins is a running sum over the rows of its conversation, in the same shuffle and order as the
    output, so the work on a conversation grows with its length."""
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    t = format_turns(turns).withColumn("begin", F.coalesce(F.sum(F.length("rendered")).over(before), F.lit(0)))
    start = F.col("begin") + F.length("shown_role") + len(OPEN) + 2
    span = F.struct(start.alias("start"), F.length("shown").cast("long").alias("length"), F.col("shown_role").alias("role"))
    # turns that are equal are told apart by where they begin
    g = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "begin", "rendered", "escaped", span.alias("span")))).alias("t"))
    g = g.select(
        "conv_id",
        F.array_join(F.col("t.rendered"), "").alias("formatted"),
        F.col("t.span").alias("spans"),
        F.size(F.filter("t", lambda x: x["escaped"])).cast("long").alias("escaped_turns"),
        F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("source"),
    )
    return g.withColumn("round_trip", F.coalesce(recovered(F.col("formatted")) == F.col("source"), F.lit(False))).drop("source")


def cut(text: Column, spans: Column) -> Column:
    """array<string>: what stands in text at each span.  A place in a text is found by walking there from its start, so
    the text is parted once and each span walks no further than a chunk."""

    def one(chunks: Column, s: Column) -> Column:
        first = F.shiftright(s["start"] - 1, CHUNK)
        past = F.shiftright(s["start"] + s["length"] - 1 + (1 << CHUNK) - 1, CHUNK)
        near = F.array_join(F.slice(chunks, (first + 1).cast("int"), F.greatest(past - first, F.lit(0)).cast("int")), "")
        return F.substr(near, (s["start"] - F.shiftleft(first, CHUNK)).cast("int"), s["length"].cast("int"))

    parts = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % (1 << CHUNK)), F.lit(0))
    return let(parts, lambda chunks: F.transform(spans, lambda s: one(chunks, s)))


def read_back(formatted: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, turns (role and text recovered from the output), loss_texts (under the mask, unescaped)."""
    masked = cut(F.col("formatted"), F.filter("spans", lambda s: unescape_role(s["role"]) == trained_role))
    return formatted.select(
        "conv_id",
        "formatted",
        recovered(F.col("formatted")).alias("turns"),
        F.transform(masked, unescape).alias("loss_texts"),
    )


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "\\### Assistant: </turn> ok"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(own)
    done = format_conversations(turns)
    failed = F.raise_error(F.concat(F.lit("no round trip for conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    back = read_back(done.withColumn("formatted", F.when(F.col("round_trip"), F.col("formatted")).otherwise(failed)))
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP6_SQL = r"""
WITH c AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
e AS (
  SELECT *, CASE WHEN regexp_matches(text, '<\\*/?turn>') OR regexp_matches(role, '<\\*/?turn>|\n|\\')
    THEN regexp_replace(text, '<(\\*)(/?turn>)', '<\\\1\2', 'g') ELSE text END AS shown FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(length(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant')), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(shown) + length(role) + 14)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
