"""Streams: sequential assimilation as reports arrive, and windowed misfits of an event stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.plans.assimilation import Problem, enkf


class SequentialFilter:
    """Updates a state by each batch of observations that arrives: the only thing kept is the last state.

    Give `self.batch` to writeStream.foreachBatch. A batch that is delivered again is not applied again."""

    def __init__(self, problem: Problem) -> None:
        self.problem, self.last_batch, self.updates = problem, -1, 0

    def batch(self, observations: DataFrame, number: int) -> None:
        if number <= self.last_batch or observations.isEmpty():
            return
        p = self.problem
        reports = [r["report"] for r in observations.select("report").distinct().orderBy("report").collect()]
        step = Problem(p.state, p.forward, observations, p.members, p.limits, p.energy, f"{p.seed}|{number}")
        self.problem = Problem(enkf(step, [reports]).state, p.forward, p.obs, p.members, p.limits, p.energy, p.seed)
        self.last_batch, self.updates = number, self.updates + 1


def windowed(events: DataFrame, width: str = "1 hour", lateness: str = "1 hour", slide: str | None = None, zone: str = "UTC") -> DataFrame:
    """begin, event_type, n, total, mean of an event table or stream (ts, event_type, value); a stream's windows close
    when the watermark has passed them."""
    stamped = events.withColumn("at", F.to_utc_timestamp(F.col("ts").cast("timestamp"), zone) if zone != "UTC" else F.col("ts").cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark("at", lateness)
    window = F.window("at", width, slide) if slide else F.window("at", width)
    grouped = stamped.groupBy(window, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"))
    return grouped.select(F.col("window.start").cast("timestamp_ntz").alias("begin"), "event_type", "n", "total", "mean")


def start(observations: DataFrame, step: SequentialFilter | Callable, checkpoint: str):
    """A query that feeds a stream of observations to a filter until what is there is used up."""
    call = step.batch if isinstance(step, SequentialFilter) else step
    return observations.writeStream.foreachBatch(call).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
