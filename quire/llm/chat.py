"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Template of a turn: ``<s>[INST]`` role ``[/INST]`` text ``</s>``. Inside roles and texts a backslash is doubled
and each control string gets a backslash after its first character, so no control string is left and
``unescape`` gives the text back exactly.

Every assistant turn becomes one example: all turns before it as context, then its own header and
text, of which only the text is under the loss mask [loss_start, loss_end) in code points. A
conversation that does not end with an assistant turn also gets one example without target, so that
no turn is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The control strings of the template.
OPEN, MID, CLOSE = "<s>[INST]", "[/INST]", "</s>"


def escape(text: Column) -> Column:
    doubled = F.regexp_replace(text, F.lit(r"\\"), F.lit(r"\\\\"))
    angled = F.regexp_replace(doubled, F.lit(r"<(/?s>)"), F.lit(r"<\\$1"))
    return F.regexp_replace(angled, F.lit(r"\[(/?INST\])"), F.lit(r"[\\$1"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"(?s)\\(.)"), F.lit("$1"))


def expand_prefix_targets(conversations: DataFrame) -> DataFrame:
    """One row per example: conv_id, target (index of the last turn in it, from 1), n_turns, formatted, loss_start, loss_end, has_loss.

    conversations: conv_id, turn, role, text and any other columns, which are ignored. Null roles and
    texts count as empty. Turns are ordered by turn (nulls first), ties by role, then text; repeated
    rows are turns of their own. Null conv_ids form one conversation. An empty table gives no rows.
    """
    turns = conversations.select(
        "conv_id",
        F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    made = whole.select(
        "conv_id",
        F.transform("ts", lambda t: t["role"] == "assistant").alias("is_target"),
        F.transform("ts", lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MID))).alias("heads"),
        F.transform("ts", lambda t: escape(t["text"])).alias("bodies"),
    )
    targets = F.filter(F.sequence(F.lit(1), F.size("heads")), lambda i: F.element_at("is_target", i) | (i == F.size("heads")))
    one = made.select("*", F.explode(targets).alias("target"))
    context = F.array_join(F.zip_with(F.slice("heads", 1, F.col("target") - 1), F.slice("bodies", 1, F.col("target") - 1), lambda h, b: F.concat(h, b, F.lit(CLOSE))), "")
    parts = one.select(
        "conv_id", "target", F.size("heads").cast("long").alias("n_turns"),
        F.element_at("is_target", F.col("target")).alias("has_loss"),
        F.concat(context, F.element_at("heads", F.col("target"))).alias("lead"),
        F.element_at("bodies", F.col("target")).alias("body"),
    )
    start = F.length("lead")
    return parts.select(
        "conv_id", "target", "n_turns",
        F.concat("lead", "body", F.lit(CLOSE)).alias("formatted"),
        start.alias("loss_start"),
        F.when(F.col("has_loss"), start + F.length("body")).otherwise(start).alias("loss_end"),
        "has_loss",
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation what the examples hold: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars (of all its examples)."""
    parts = F.split("formatted", r"<s>\[INST\]")
    pieces = F.slice(parts, F.lit(2), F.size(parts))

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, MID, 1)
        text = F.substring(piece, F.length(role) + 1 + len(MID), F.length(piece) - F.length(role) - len(MID) - len(CLOSE))
        return F.concat(unescape(role), F.lit("\n"), unescape(text), F.lit("\n"))

    last = F.col("target") == F.col("n_turns")
    each = examples.select(
        "conv_id", "target",
        F.when(last, F.size(pieces).cast("long")).alias("n"),
        F.when(last, F.sha2(F.array_join(F.transform(pieces, turn), "").cast("binary"), 256)).alias("turns"),
        F.when(F.col("has_loss"), unescape(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))).alias("loss"),
        F.length("formatted").cast("long").alias("chars"),
    )
    whole = each.groupBy("conv_id").agg(
        F.max("n").alias("n_turns"), F.max("turns").alias("turns_sha256"),
        F.array_sort(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("target", "loss")))).alias("losses"),
        F.sum("chars").alias("formatted_chars"),
    )
    loss = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    return whole.select("conv_id", "n_turns", "turns_sha256", F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
