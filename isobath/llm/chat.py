"""Chat formatting by event-sourced reconstruction.

A log of events is partitioned by conversation and sorted by sequence; streamed deltas, edits and
regenerations fold into the final messages, which a template renders. The fold is set-based: an event
lives if no later regeneration starts at or before its message and no later event of its message
resets the text, so windows decide it and the fold of a long conversation spills.

Events: conv_id, seq, kind, msg, role, text. kind is ``message`` (starts a message), ``delta``
(appends), ``edit`` (replaces the text) or ``regenerate`` (drops this message and all after it, then
starts it anew); any other or a null kind counts as ``message``. Nulls: a null text or role is empty,
null conversation ids form one conversation, null sequences come first. Ties in seq are ordered by
msg, role and text. A conversation without a living event gives no row. Repeated rows are separate events: a repeated
delta is appended twice. Columns beyond these are dropped. An empty log gives an empty table. The fold's state spills; the
formatted conversation is one value, so that a conversation must fit into a row (2 GB), and reading its mask back takes
time in proportion to turns times characters.

Template: ``<|turn|>role\\ntext<|end|>`` for each message. Control strings inside roles and texts are
escaped with a backslash code that no text can forge, as the backslash itself is escaped. The loss
mask lists the spans of the assistants' texts in code points of the formatted string.

Only DataFrame operations are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isobath.llm.shared import table

TURN, END = "<|turn|>", "<|end|>"
#: Control strings of common chat templates, and this one's. All begin with < or [.
CONTROL = ("<<SYS>>", "<</SYS>>", "<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>", TURN, END)
CODE = {"<": "\\l", "[": "\\k"}


def escape(text: Column) -> Column:
    """Break every control string; a backslash becomes \\e, so each backslash starts one code."""
    out = F.replace(text, F.lit("\\"), F.lit("\\e"))
    return reduce(lambda acc, c: F.replace(acc, F.lit(c), F.lit(CODE[c[0]] + c[1:])), CONTROL, out)


def unescape(text: Column) -> Column:
    for char, code in CODE.items():
        text = F.replace(text, F.lit(code), F.lit(char))
    return F.replace(text, F.lit("\\e"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def fold(events: DataFrame) -> DataFrame:
    """The final messages: conv_id, msg, role, text, and position (from 0) in the conversation."""
    order = [F.col(c).asc_nulls_first() for c in ("seq", "msg", "role", "text")]
    after = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    restart = F.when(F.col("kind") == "regenerate", F.col("msg"))
    e = (
        events.select("conv_id", "seq", F.coalesce("kind", F.lit("message")).alias("kind"), "msg", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("restarted", F.min(restart).over(after))
        .withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)))
        .filter(F.col("restarted").isNull() | (F.col("restarted") > F.col("msg")))
    )
    last_reset = F.max(F.when(F.col("kind") != "delta", F.col("at"))).over(Window.partitionBy("conv_id", "msg"))
    live = e.withColumn("reset", F.coalesce(last_reset, F.lit(0))).filter(F.col("at") >= F.col("reset"))
    parts = F.sort_array(F.collect_list(F.struct("at", "text")))
    messages = live.groupBy("conv_id", "msg").agg(F.min_by("role", "at").alias("role"), F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))
    return messages.withColumn("position", F.row_number().over(Window.partitionBy("conv_id").orderBy("msg")) - 1)


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss (array of start and length in code points)."""
    body = escape(F.col("text"))
    pieces = (
        messages.withColumn("head", F.concat(F.lit(TURN), escape_role(F.col("role")), F.lit("\n")))
        .withColumn("body", body)
        .withColumn("n", F.length("head") + F.length("body") + F.lit(len(END)))
    )
    before = Window.partitionBy("conv_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    span = F.struct(F.col("position"), (F.col("start") + F.length("head")).cast("int").alias("start"), F.length("body").alias("length"))
    return (
        pieces.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("piece", F.concat("head", "body", F.lit(END)))
        .groupBy("conv_id")
        .agg(
            F.sort_array(F.collect_list(F.struct("position", "piece"))).alias("pieces"),
            F.sort_array(F.collect_list(F.when(F.col("role") == "assistant", span))).alias("loss"),
        )
        .select(
            "conv_id",
            F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"),
            F.transform("loss", lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))).alias("loss"),
        )
    )


def parse(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    pieces = F.filter(F.split(formatted, r"<\|turn\|>"), lambda p: p != "")

    def turn(piece: Column) -> Column:
        cut = F.instr(piece, F.lit("\n"))
        text = F.substring(piece, cut + 1, F.length(piece) - cut - len(END))
        return F.struct(unescape_role(F.substring(piece, F.lit(1), cut - 1)).alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def masked(formatted: Column, loss: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def format_chats(events: DataFrame) -> DataFrame:
    return render(fold(events))


def as_events(conversations: DataFrame) -> DataFrame:
    """A finished conversation table as a log: one ``message`` event a row, in order of turn."""
    order = Window.partitionBy("conv_id").orderBy(*[F.col(c).asc_nulls_first() for c in ("turn", "role", "text")])
    return conversations.select("conv_id", "turn", "role", "text").withColumn("seq", F.row_number().over(order)).withColumn("msg", F.col("seq")).withColumn("kind", F.lit("message"))


def op10_chat_formatting(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = format_chats(as_events(rows)).select("*", parse(F.col("formatted")).alias("turns"), masked(F.col("formatted"), F.col("loss")).alias("under"))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest.cast("binary"), 256).alias("turns_sha256"),
        F.length("under").cast("long").alias("loss_chars"),
        F.sha2(F.col("under").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\e')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{CODE[c[0]] + c[1:]}')"
    return out


ORACLE = f"""
WITH said AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
rows_ AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM said),
shown AS (
  SELECT *, length(replace({_sql_escaped('role')}, chr(10), '\\n')) + length({_sql_escaped('text')}) + {len(TURN) + len(END) + 1} AS n FROM rows_)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM shown GROUP BY conv_id
"""
