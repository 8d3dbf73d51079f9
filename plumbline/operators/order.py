"""Global order without a window over the whole table: ranges, ranks within them, and one base per range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut


def ranged(df: DataFrame, keys: list) -> DataFrame:
    """`df` dealt by ranges of `keys`, with the range's number as `_range`; written down, so the numbers hold."""
    return cut(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()))


def bases(parts: DataFrame, amount: Column, name: str) -> DataFrame:
    """(_range, name): the sum of `amount` over all ranges before.  One row per range reaches the driver."""
    total, rows = 0, []
    for r in parts.groupBy("_range").agg(F.sum(amount).alias("n")).orderBy("_range").collect():
        rows.append((r["_range"], total))
        total += r["n"] or 0
    return parts.sparkSession.createDataFrame(rows, f"_range int, {name} long")


def indexed(df: DataFrame, keys: list, name: str, carry: dict[str, Column] | None = None) -> DataFrame:
    """`df` with its place (from 0) in the order of `keys`; `carry`: names of running sums over all rows before, and what they add up (whole numbers)."""
    parts = ranged(df, keys)
    inside = Window.partitionBy("_range").orderBy(*keys)
    out = parts.withColumn(name, F.row_number().over(inside) - 1).join(F.broadcast(bases(parts, F.lit(1), "_base")), "_range").withColumn(name, (F.col(name) + F.col("_base")).cast("long")).drop("_base")
    for k, amount in (carry or {}).items():
        before = F.coalesce(F.sum(amount).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        out = out.withColumn(k, before).join(F.broadcast(bases(parts, amount, "_base")), "_range").withColumn(k, (F.col(k) + F.col("_base")).cast("long")).drop("_base")
    return out.drop("_range")


def with_previous(rows: DataFrame, place: str, columns: list[str]) -> DataFrame:
    """`rows` with `prev_*`: the columns of the row one place before, null at the first."""
    before = rows.select((F.col(place) + 1).alias(place), *[F.col(c).alias(f"prev_{c}") for c in columns])
    return rows.join(before, place, "left")


def medians(df: DataFrame, by: str, value: str, step: float) -> DataFrame:
    """(by, median): exact, without holding a group's values: a first pass counts them in steps, a second looks only into the step or two that the middle lies in.

    Memory is one row for each step and, of the middle ones, each different value.
    """
    bins = df.where(F.col(value).isNotNull()).select(by, value, F.floor(F.col(value) / F.lit(step)).alias("_bin"))
    n = bins.groupBy(by, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("_n").over(Window.partitionBy(by))
    low, high = F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)  # places from 0
    spans = n.select(by, "_bin", "_n", upto.alias("_upto"), total.alias("_total")).where((F.col("_upto") > low) & (F.col("_upto") - F.col("_n") <= high))
    middle = cut(spans.groupBy(by).agg(F.min("_bin").alias("_from"), F.max("_bin").alias("_to"), F.min(F.col("_upto") - F.col("_n")).alias("_before"), F.first("_total").alias("_total")))
    some = bins.join(F.broadcast(middle), by).where(F.col("_bin").between(F.col("_from"), F.col("_to"))).groupBy(by, "_before", "_total", value).agg(F.count(F.lit(1)).alias("_n"))  # one row a group
    last = F.col("_before") + F.sum("_n").over(Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    at = lambda k: F.min(F.when(F.col("_last") > k, F.col(value)))
    return some.withColumn("_last", last).groupBy(by).agg(((at(low) + at(high)) / 2).alias("median"))
