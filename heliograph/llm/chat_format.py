"""Chat formatting by event-sourced reconstruction, with DataFrame functions only.

A conversation's log holds events: (conv_id, seq, kind, message_id, role, text), kind one of
``message`` (a whole text), ``delta`` (appended to the message), ``edit`` (replaces its text) and
``regenerate`` (empties it, deltas or a message follow).  Events are partitioned by conversation
and message, sorted by sequence and folded to final messages: what counts is the last event that
sets a text, and the deltas after it.  Messages stand in the order of their first event.

Messages are rendered one by one and joined in parts of at most PART messages, so that no task
ever holds more of a conversation than its finished text.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``.  A control string inside a role or text (such as
``<|im_end|>``, ``</s>``, ``[INST]``) gets a backslash after its first character; one that
already has k backslashes there gets one more, which makes the escape reversible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

START, END = "<|im_start|>", "<|im_end|>\n"
#: Messages in a rendered part.
PART = 256
# What follows < or [ in control strings of common chat templates.
TAILS = r"(?:\||/?s>|</?SYS>>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)(?={TAILS})", r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)\\(?={TAILS})", "$1$2")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, first_seq, message_id, role, text.

    A null text adds nothing, a null message_id stands for the event's own sequence number, the
    role is the last one given (none: empty), and an unknown kind is taken as ``message``.
    Repeated events count as often as they occur.  Ties in seq: by kind, then role and text.
    A message deleted by ``regenerate`` with nothing after it keeps an empty text.
    """
    log = events.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("seq").cast("long").alias("seq"), F.coalesce(F.col("kind"), F.lit("message")).alias("kind"),
        F.coalesce(F.col("message_id").cast("string"), F.concat(F.lit("seq:"), F.coalesce(F.col("seq").cast("string"), F.lit("")))).alias("message_id"), F.col("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    rank = F.when(F.col("kind") == "regenerate", 0).when(F.col("kind") == "delta", 2).when(F.col("kind") == "edit", 3).otherwise(1)
    sets = F.col("kind") != "delta"
    place = F.struct("seq", "rank", "role", "text")
    log = log.withColumn("rank", rank).withColumn("place", place)
    last = log.groupBy("conv_id", "message_id").agg(
        F.min("seq").alias("first_seq"), F.max(F.when(sets, F.col("place"))).alias("base"), F.max_by("role", F.when(F.col("role").isNotNull(), F.col("place"))).alias("role"),
        F.array_sort(F.collect_list(F.when(~sets, F.col("place")))).alias("deltas"),
    )
    kept = F.filter("deltas", lambda d: F.col("base").isNull() | (d > F.col("base")))
    start = F.when(F.col("base").isNull() | (F.col("base.rank") == 0), F.lit("")).otherwise(F.col("base.text"))
    return last.select("conv_id", "first_seq", "message_id", F.coalesce("role", F.lit("")).alias("role"), F.concat(start, F.array_join(F.transform(kept, lambda d: d["text"]), "")).alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """Parts of formatted conversations: conv_id, part, n_turns, formatted, loss_spans.

    ``loss_spans``: array of (start, end) in code points of the part's text, end exclusive, of
    the assistants' texts.  Joined by part, the parts' texts are the conversation.  Messages of
    a part have first_seq div PART in common; equal ones are ordered by role, text, message_id.
    A conversation becomes one text in the end, so what a task holds is bounded by that text alone.
    """
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit("\n"))
    rows = messages.select("conv_id", F.floor(F.coalesce("first_seq", F.lit(0)) / PART).cast("long").alias("part"), F.struct("first_seq", "role", "text", "message_id").alias("place"), head.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("loss"))
    rows = rows.withColumn("whole", F.concat("head", "body", F.lit(END)))
    before = F.sum(F.length("whole").cast("long")).over(Window.partitionBy("conv_id", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("start", F.coalesce(before, F.lit(0)) + F.length("head"))
    span = F.when(F.col("loss"), F.struct(F.col("start"), (F.col("start") + F.length("body")).alias("end")))
    turn = F.struct("place", "start", "whole")
    parts = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n_turns"), F.array_sort(F.collect_list(turn)).alias("turns"), F.array_sort(F.collect_list(span)).alias("loss_spans"))
    return parts.select("conv_id", "part", "n_turns", F.array_join(F.transform("turns", lambda t: t["whole"]), "").alias("formatted"), "loss_spans")


def read_back(parts: DataFrame) -> DataFrame:
    """Of each part, read from its formatted text and spans: the turns as text, and the text under the loss mask."""
    pieces = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda p: p != "")
    turn = lambda p: F.concat(unescape(F.regexp_extract(p, r"^<\|im_start\|>([^\n]*)\n", 1)), F.lit("\n"), unescape(F.regexp_replace(p, r"^<\|im_start\|>[^\n]*\n", "")), F.lit("\n"))
    masked = lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    return parts.select("conv_id", "part", F.size(pieces).cast("long").alias("turns"), F.array_join(F.transform(pieces, turn), "").alias("turns_text"), F.array_join(F.transform("loss_spans", masked), "").alias("loss_text"), F.length("formatted").cast("long").alias("chars"))


def conversation_events(rows: DataFrame) -> DataFrame:
    """Rows of conversations as a log: each row is a message of its own, repeated and tied rows too (ties: by role, then text)."""
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("seq"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    tied = F.row_number().over(Window.partitionBy("conv_id", "seq", "role", "text").orderBy(F.lit(0)))
    same = F.sha2(F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}), 256)
    return rows.select("conv_id", "seq", F.lit("message").alias("kind"), F.concat_ws(":", F.coalesce(F.col("seq").cast("string"), F.lit("")), F.coalesce("role", F.lit("")), same, F.lpad(tied.cast("string"), 10, "0")).alias("message_id"), "role", "text")


def digests(parts: DataFrame) -> DataFrame:
    """Per conversation the contract's columns, from what is read back of its parts."""
    whole = lambda c: F.array_join(F.transform(F.array_sort("parts"), lambda p: p[c]), "")
    joined = read_back(parts).groupBy("conv_id").agg(F.sum("turns").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.collect_list(F.struct("part", "turns_text", "loss_text")).alias("parts"))
    joined = joined.select("conv_id", "n_turns", whole("turns_text").alias("turns_text"), whole("loss_text").alias("loss_text"), "formatted_chars")
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return joined.select("conv_id", "n_turns", sha("turns_text").alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), sha("loss_text").alias("loss_sha256"), "formatted_chars")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(told)
    return digests(render(fold_events(conversation_events(rows))))
