"""As-of bracketing on both sides, safe for a track that holds most of the rows.

Rows are windowed within (track, time bucket); what lies beyond a bucket comes
from one row per bucket, so no window spans a whole track.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bracket(left: DataFrame, right: DataFrame, by: str, t: str, payload: list[str], width: float, strict: bool = True) -> DataFrame:
    """`left` with structs `before` and `after`: the nearest rows of `right` (t and payload) of the same `by`.

    strict: `before` is earlier than t and `after` is at or past it; else `before` may be at t and `after` is past it.
    Null where a side has no row.  Of equal times the one with the least payload counts as first.
    """
    row = F.struct(F.col(t).alias("t"), *payload)
    bucket = F.floor(F.col("_t") / F.lit(width)).alias("_b")
    none = F.lit(None).cast(right.select(row.alias("x")).schema["x"].dataType)
    # each different time once on both sides: rows of equal times share what is around them
    l = left.select(F.col(by).alias("_by"), F.col(t).alias("_t")).distinct().select("_by", "_t", bucket, none.alias("_least"), none.alias("_most"), F.lit(0).alias("_side"))
    r = right.select(F.col(by).alias("_by"), F.col(t).alias("_t"), row.alias("_row")).groupBy("_by", "_t").agg(F.min("_row").alias("_least"), F.max("_row").alias("_most")).select("_by", "_t", bucket, "_least", "_most", F.lit(1).alias("_side"))
    both = l.unionByName(r)
    side = F.col("_side") if strict else -F.col("_side")
    # both sides look back, one in the reverse order: a frame that looks ahead reads the rest of its bucket for every row
    back = lambda *order: Window.partitionBy("_by", "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumns({"_before": F.last("_most", True).over(back("_t", side)), "_after": F.last("_least", True).over(back(F.desc("_t"), -side))}).where("_side = 0")
    ends = both.groupBy("_by", "_b").agg(F.max("_most").alias("_last"), F.min("_least").alias("_first"))
    chain = lambda order: Window.partitionBy("_by").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    beyond = ends.select(F.col("_by").alias("_by2"), F.col("_b").alias("_b2"), F.last("_last", True).over(chain("_b")).alias("_carry"), F.last("_first", True).over(chain(F.desc("_b"))).alias("_next"))
    joined = inside.join(beyond, F.col("_by").eqNullSafe(F.col("_by2")) & F.col("_b").eqNullSafe(F.col("_b2")))
    found = joined.select("_by", "_t", F.coalesce("_before", "_carry").alias("before"), F.coalesce("_after", "_next").alias("after"))
    return left.join(found, left[by].eqNullSafe(F.col("_by")) & left[t].eqNullSafe(F.col("_t"))).select(*[left[k] for k in left.columns], "before", "after")


def share(t: Column) -> Column:
    """Where t lies between before and after, 0 at a clamped end."""
    span = F.col("after.t") - F.col("before.t")
    return F.when(span > 0, (t - F.col("before.t")) / span).otherwise(0.0)


def between(name: str, w: Column) -> Column:
    """A payload column at share w; at a clamped end the only side there is."""
    a, b = F.col(f"before.{name}"), F.col(f"after.{name}")
    return F.when(F.col("before").isNull(), b).when(F.col("after").isNull(), a).otherwise(a * (1 - w) + b * w)
