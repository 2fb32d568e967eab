"""Streams with event-time windows and timers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lakeledger.operators.ordered import carried, running_sums, trailing_sums
from lakeledger.runtime import ship


def stream_metrics(events: DataFrame, window: str = "1 hour", watermark: str = "2 hours") -> DataFrame:
    """Rows and bytes per dataset and tumbling window; works on a stream and on a table.

    ``events``: dataset, ts, bytes. Rows beyond the watermark are dropped on a stream.
    """
    g = events.withWatermark("ts", watermark).groupBy(F.window("ts", window).alias("w"), "dataset")
    return g.agg(F.count("*").alias("row_count"), F.sum("bytes").alias("byte_size")).select("dataset", F.col("w.start").alias("ts"), "row_count", "byte_size")


def stream_daily_moments(metrics: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Count, sum and sum of squares of row_count per dataset and day (T4).

    Thirty-day windows sliding by a day would hold every row thirty times; one row per day
    holds it once, and ``rolling_stats`` adds the days up.
    """
    x = F.col("row_count").cast("decimal(19,0)")
    g = metrics.withWatermark("ts", watermark).groupBy(F.window("ts", "1 day").alias("w"), "org_id", "dataset")
    return g.agg(
        F.count("row_count").alias("n"), F.sum(x).cast("decimal(38,0)").alias("s"), F.sum((x * x).cast("decimal(38,0)")).cast("decimal(38,0)").alias("q")
    ).select("org_id", "dataset", F.col("w.start").alias("day"), "n", "s", "q")


def rolling_stats(daily: DataFrame, days: int = 30) -> DataFrame:
    """Mean and deviation of the ``days`` before each day, that day excluded (T4)."""
    span = days + 1
    m = trailing_sums(daily, ["org_id", "dataset"], "day", ["n", "s", "q"], span * 86_400_000_000, block_us=30 * 86_400_000_000)
    own = daily.select("org_id", "dataset", "day", *[F.col(c).alias(f"_{c}") for c in ("n", "s", "q")])
    j = m.join(own, ["org_id", "dataset", "day"])
    n = F.col("n") - F.col("_n")
    s, q = (F.col("s") - F.col("_s")).cast("double"), (F.col("q") - F.col("_q")).cast("double")
    var = F.when(n > 1, F.greatest((q - s * s / n) / (n - 1), F.lit(0.0)))
    return j.select("org_id", "dataset", "day", n.alias("points"), F.when(n > 0, s / n).alias("mean"), F.sqrt(var).alias("std"))


def stream_sessions(query_events: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """Runs of an application told apart by gaps between its queries (T9), for streams."""
    g = query_events.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap).alias("w"), "app_id")
    return g.agg(F.count("*").alias("queries"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at")).drop("w")


def run_sessions(query_events: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """The same for a table; an application with very many queries is split by day."""
    gap = gap_minutes * 60_000_000
    e = query_events.groupBy("app_id", "ts").agg(F.count("*").alias("n"))
    e = carried(e.withColumn("_t", F.col("ts")), ["app_id"], "ts", [], "_t", "_prev")
    new = F.coalesce(F.unix_micros("ts") - F.unix_micros("_prev") >= gap, F.lit(True)).cast("bigint")
    e = running_sums(e.withColumn("session", new), ["app_id"], "ts", [], ["session"])
    return e.groupBy("app_id", "session").agg(F.sum("n").alias("queries"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"))


_BREACH = "org_id string, dataset string, last_updated timestamp, sla_hours int"


def _watch(key, frames, state: GroupState):
    """Every gap between a dataset's updates that is longer than agreed, and the last one once its time runs out.

    The state is the last update, the agreed hours and whether its breach is reported already.
    """

    def breaches(times, hours):
        n = len(times)
        return pd.DataFrame({"org_id": [key[0]] * n, "dataset": [key[1]] * n, "last_updated": pd.to_datetime(times, unit="us"), "sla_hours": [hours] * n})

    if state.hasTimedOut:
        last, hours, reported = state.get
        state.update((last, hours, True))
        if not reported:
            yield breaches([last], hours)
        return
    pdf = pd.concat(list(frames), ignore_index=True)
    hours = int(pdf["sla_hours"].min())
    us = sorted(pdf["us"].unique().tolist())
    reported = False
    if state.exists:
        last, _, reported = state.get
        us = [last, *(u for u in us if u > last)]
    gaps = [a for k, (a, b) in enumerate(zip(us, us[1:])) if b - a > hours * 3_600_000_000 and not (reported and k == 0)]
    yield breaches(gaps, hours)
    state.update((us[-1], hours, reported and len(us) == 1))
    if not (reported and len(us) == 1):
        state.setTimeoutTimestamp(max(us[-1] // 1000 + hours * 3_600_000, state.getCurrentWatermarkMs() + 1))


def stream_freshness(updates: DataFrame, slas: DataFrame, watermark: str = "0 seconds", default_hours: int = 24) -> DataFrame:
    """A row for each update after which the next one came later than agreed, or not yet.

    Event time; the same rows however the updates are cut into batches, as long as none is older than the
    watermark when it comes. Of several agreed times of
    one dataset the shortest counts. A gap that ends is reported when it ends, the last update when
    the watermark has passed its time.
    """
    agreed = slas.groupBy("org_id", "dataset").agg(F.min("sla_hours").alias("sla_hours"))
    u = updates.withWatermark("ts", watermark).join(agreed, ["org_id", "dataset"], "left")
    u = u.select("org_id", "dataset", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.coalesce("sla_hours", F.lit(default_hours)).cast("int").alias("sla_hours"))
    return u.groupBy("org_id", "dataset").applyInPandasWithState(_watch, _BREACH, "last bigint, hours int, reported boolean", "append", GroupStateTimeout.EventTimeTimeout)


ship(__name__)
