"""Progress events: prefixed JSON lines to job fractions, in batch and as a stream."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX = "@progress "


def fractions(lines: DataFrame, spans: dict[str, tuple[float, float]]) -> DataFrame:
    """Works on a batch and on a stream of lines alike; lines without the prefix are other output."""
    e = lines.where(F.col("line").startswith(PREFIX)).select(F.from_json(F.substring("line", len(PREFIX) + 1, 1 << 30), "event_id long, stage string, f double").alias("e"))
    start, width = (F.create_map(*[F.lit(x) for k, v in spans.items() for x in (k, v[n])]) for n in (0, 1))
    return e.select("e.event_id", "e.stage", (F.element_at(start, F.col("e.stage")) + F.element_at(width, F.col("e.stage")) * F.col("e.f")).alias("fraction"))


def job_states(spark: SparkSession, path: str, spans: dict[str, tuple[float, float]]) -> DataFrame:
    """A stream over a growing folder of logs: the furthest fraction per stage."""
    lines = spark.readStream.text(path).withColumnRenamed("value", "line")
    return fractions(lines, spans).groupBy("stage").agg(F.max("fraction").alias("fraction"), F.count(F.lit(1)).alias("events"))


def telemetry_rate(stream: DataFrame, window: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Samples per track and event-time window; later ones than the watermark are left out."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window), "track").agg(F.count(F.lit(1)).alias("n"))


def throttled(events: DataFrame, job: str, clock, interval: int, state: str) -> DataFrame:
    """(job, slot, newest, seen): of each interval of `clock` only the newest state is kept; on a stream one batch of it is written a trigger."""
    return events.groupBy(job, F.floor(clock / interval).alias("slot")).agg(F.max(state).alias("newest"), F.count(F.lit(1)).alias("seen"))


def changes(stream: DataFrame, job: str, order: str, state: str, ended: tuple[str, ...]) -> DataFrame:
    """(job, order, state): each change of a job's state once, nothing once it has ended; state is kept per job across batches."""
    key, at, what = (stream.schema[k].dataType.simpleString() for k in (job, order, state))

    def run(name, batches, held):
        last, done = held.get if held.exists else (None, False)
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for k, s in zip(rows[order], rows[state]):
            if done:
                break
            if s != last:
                out.append((name[0], k, s))
            last, done = s, s in ended
        held.update((last, bool(done)))
        yield pd.DataFrame(out, columns=[job, order, state])

    return stream.groupBy(job).applyInPandasWithState(run, f"{job} {key}, {order} {at}, {state} {what}", f"last {what}, done boolean", "append", "NoTimeout")
