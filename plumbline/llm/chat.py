"""Chat formatting by perspective rotation.

Every participant of a dialogue gets a rendering of the whole of it in which
that participant's turns are the assistant's, all others are named users, and
only the assistant's text and its end mark are trained on.  The result is one
row per dialogue, perspective and turn with the rendered piece and its place in
the dialogue's text.  No dialogue is ever gathered in one task: turns are put in
order by ranges, each range is written down as a chunk, and places are running
sums within the chunks of a dialogue plus the totals of its chunks before.

Defined results: system turns are rendered as such and are no participant; a
turn without a speaker is by the user `unknown`, who has no perspective either;
a null text is empty; turns without a number come first; turns of equal number
keep the order of speaker and text, repeated rows are repeated turns; a dialogue
without a participant has no row; a null dialogue id is one dialogue; other
columns are left out.  Marks inside a text or a name are broken up by a space
after their first sign, and a name stays on one line, so neither can begin or
end a turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SYSTEM, UNKNOWN = "system", "unknown"


def _broken(x):
    return F.replace(x, F.lit("<|"), F.lit("< |"))


def _name(x):
    return F.replace(_broken(F.translate(x, "\r\n", "  ")), F.lit("|>"), F.lit("| >"))


def in_chunks(turns: DataFrame, conv: str, turn: str, speaker: str, text: str) -> DataFrame:
    """(conv_id, turn, speaker, content, times, chunk): different turns in order by ranges; equal ones are counted before they are moved."""
    base = turns.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(speaker), F.lit(UNKNOWN)).alias("speaker"), _broken(F.coalesce(F.col(text), F.lit(""))).alias("content"))
    counted = base.groupBy("conv_id", "turn", "speaker", "content").agg(F.count(F.lit(1)).alias("times"))
    # a text's first signs order it as the whole does, and the bounds of the ranges stay small
    ranged = counted.repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), "speaker", F.substring("content", 1, 64))
    return materialize(ranged.withColumn("chunk", F.spark_partition_id()), "turns")


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    base = in_chunks(turns, conv, turn, speaker, text)
    people = base.where(~F.col("speaker").isin(SYSTEM, UNKNOWN)).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    chunks = base.select("conv_id", "chunk").distinct()
    here = chunks.join(people, F.col("conv_id").eqNullSafe(F.col("_conv"))).select("_conv", F.col("chunk").alias("_chunk"), "perspective")
    role = F.when(F.col("speaker") == SYSTEM, SYSTEM).when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    head = F.concat(F.lit("<|"), F.col("chat_role"), F.when(F.col("chat_role") == "user", F.concat(F.lit(" name="), _name(F.col("speaker")))).otherwise(""), F.lit("|>\n"))
    each = (
        base.join(here, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("chunk") == F.col("_chunk")))
        .drop("_conv", "_chunk")
        .withColumn("chat_role", role)
        .withColumn("head", head)
        .withColumn("rendered", F.concat("head", "content", F.lit("<|end|>\n")))
        .withColumn("chars", F.length("rendered") * F.col("times"))
    )
    group = ["conv_id", "perspective"]
    order = [F.col("turn").asc_nulls_first(), F.col("speaker"), F.col("content")]
    inside = Window.partitionBy(*group, "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = each.withColumn("place", F.coalesce(F.sum("chars").over(inside), F.lit(0)))
    totals = each.groupBy(*group, "chunk").agg(F.sum("chars").alias("total"))
    before = Window.partitionBy(*group).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("conv_id").alias("_conv"), F.col("perspective").alias("_who"), F.col("chunk").alias("_chunk"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    joined = placed.join(bases, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("perspective") == F.col("_who")) & (F.col("chunk") == F.col("_chunk")))
    again = joined.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    start = F.col("base") + F.col("place") + F.col("nth") * F.length("rendered")
    mine = F.col("chat_role") == "assistant"
    return again.select(
        *group,
        "turn",
        "chat_role",
        "rendered",
        start.alias("start"),
        (start + F.length("rendered")).alias("end"),
        F.when(mine, start + F.length("head")).alias("train_start"),
        F.when(mine, start + F.length("rendered") - 1).alias("train_end"),
    )
