"""Chat formatting: event-sourced reconstruction, then rendering.

A conversation log is a table of events (conv_id, seq, turn, kind, role, text).
Kinds: ``message`` starts the text of a turn, ``delta`` appends a streamed part,
``edit`` replaces the text, ``regenerate`` starts it anew; an edit or a
regeneration of a turn discards all that was logged before it for later turns.
Unknown or null kinds count as ``message``, null texts as empty.

Everything is DataFrame expressions: one shuffle by conversation, window
functions find the events that still hold, and two nested aggregations (by turn,
then by conversation) fold them. No state lives in Python.

Defined results: a null conv_id is a conversation of its own; equal seq values
are ordered by kind, role and text; null roles are written as the empty role;
an empty log gives no row; columns beyond the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_of

# Fixed values of the template. Every marker starts with < or [, and no text
# holds either character once it is escaped.
OPEN = {"system": "<<SYS>>", "user": "[INST]", "assistant": "<s>"}
CLOSE = {"system": "<</SYS>>", "user": "[/INST]", "assistant": "</s>"}
ESCAPES = [("\\", "\\s"), ("<", "\\l"), ("[", "\\b")]
RESETS = ("message", "edit", "regenerate")
#: The bar in a role; an escaped text holds no backslash but those of its codes.
BAR = "\\p"
TURN = r"(?s)(<<SYS>>|\[INST\]|<s>|<\|[^<\[]*?\|>)([^<\[]*)"


def escaped(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _role(role: Column) -> Column:
    """A role as its marker holds it: without the bar that ends the marker."""
    return F.replace(escaped(role), F.lit("|"), F.lit(BAR))


def _marker(role: Column, known: dict[str, str], other: Column) -> Column:
    out = F.when(role == "", other)
    for name, mark in known.items():
        out = out.when(role == name, F.lit(mark))
    return out.otherwise(other)


def fold_events(events: DataFrame) -> DataFrame:
    """The final messages: (conv_id, turn, role, text), one row per turn that
    still stands. The role is that of the turn's last starting event."""
    kind = F.coalesce(F.col("kind"), F.lit("message"))
    log = events.select(
        "conv_id", "seq", "turn", F.when(kind == "delta", "delta").when(kind.isin("edit", "regenerate"), kind).otherwise("message").alias("kind"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text_of().alias("text"),
    )
    earlier_turns = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first()).rangeBetween(Window.unboundedPreceding, -1)
    same_turn = Window.partitionBy("conv_id", "turn")
    cut = F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("seq"))).over(earlier_turns)
    standing = log.withColumn("cut", cut).filter(F.col("cut").isNull() | (F.col("seq") >= F.col("cut"))).drop("cut")
    start = F.max(F.when(F.col("kind").isin(*RESETS), F.struct("seq", "kind", "role", "text"))).over(same_turn)
    return (
        standing.withColumn("start", start)
        .filter(F.col("start").isNull() | ((F.col("kind") == "delta") & (F.col("seq") >= F.col("start.seq"))) | (F.struct("seq", "kind", "role", "text") == F.col("start")))
        .withColumn("first", (F.col("kind") != "delta"))
        .groupBy("conv_id", "turn")
        .agg(
            F.coalesce(F.max("start.role"), F.max("role")).alias("role"),
            F.max(F.when(F.col("first"), F.col("text"))).alias("head"),
            F.sort_array(F.collect_list(F.when(~F.col("first"), F.struct("seq", "text")))).alias("deltas"),
        )
        .select("conv_id", "turn", "role", F.concat(F.coalesce("head", F.lit("")), F.array_join(F.col("deltas.text"), "")).alias("text"))
    )


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans) of messages (conv_id, turn,
    role, text). loss_spans are the code points, end exclusive, of the escaped
    assistant texts in ``formatted``."""
    role = F.col("role")
    other = F.concat(F.lit("<|"), _role(role), F.lit("|>"))
    head, tail = _marker(role, OPEN, other), _marker(role, CLOSE, F.lit("</>"))
    parts = messages.select("conv_id", "turn", "role", head.alias("head"), escaped(F.col("text")).alias("body"), F.concat(tail, F.lit("\n")).alias("tail"))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    length = F.length("head") + F.length("body") + F.length("tail")
    begin = F.coalesce(F.sum(length).over(before), F.lit(0)) + F.length("head")
    span = F.struct(begin.alias("start"), (begin + F.length("body")).alias("end"))
    placed = parts.withColumn("span", F.when(role == "assistant", span))
    return (
        placed.groupBy("conv_id")
        .agg(
            F.sort_array(F.collect_list(F.struct("turn", F.concat("head", "body", "tail").alias("piece")))).alias("pieces"),
            F.sort_array(F.collect_list("span")).alias("loss_spans"),
        )
        .select("conv_id", F.size("pieces").cast("long").alias("n_turns"), F.array_join(F.col("pieces.piece"), "").alias("formatted"), "loss_spans")
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    marks = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(1))
    bodies = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(2))

    def turn(mark: Column, body: Column) -> Column:
        role = F.when(F.lit(False), mark)
        for name, opening in OPEN.items():
            role = role.when(mark == opening, F.lit(name))
        role = role.otherwise(unescaped(F.replace(F.substring(mark, F.lit(3), F.length(mark) - 4), F.lit(BAR), F.lit("|"))))
        return F.struct(role.alias("role"), unescaped(body).alias("text"))

    return F.zip_with(marks, bodies, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    cut = F.transform(spans, lambda s: unescaped(F.substring(formatted, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))))
    return F.array_join(cut, "")


def format_chats(events: DataFrame) -> DataFrame:
    """Folds the log and renders every conversation of it."""
    return render(fold_events(events))


def as_events(turns: DataFrame) -> DataFrame:
    """A table of whole turns as a log: each row is one message. Rows that
    repeat a turn number stay messages of their own, ordered by role and text."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return turns.select("conv_id", "turn", "role", "text").withColumn("seq", F.row_number().over(order).cast("long")).select(
        "conv_id", "seq", F.col("seq").alias("turn"), F.lit("message").alias("kind"), "role", "text")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    chats = format_chats(as_events(turns.unionByName(probe)))
    read = chats.withColumn("turns", read_turns(F.col("formatted"))).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
