"""Counters and statistics over facts (A*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lakeledger.functions.paths import country_of
from lakeledger.operators.listing import since
from lakeledger.operators.ordered import join_null_safe, quantiles


def metric_stats(metrics: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Row count and byte size statistics per dataset over the last ``days`` (A1)."""
    m = metrics.filter(F.col("row_count").isNotNull() & since("ts", as_of, 24 * days))
    key = ["org_id", "dataset"]
    g = m.groupBy(*key).agg(
        F.count("*").alias("data_points"),
        F.coalesce(F.avg("row_count"), F.lit(0.0)).alias("mean"),
        F.coalesce(F.stddev_samp("row_count"), F.lit(0.0)).alias("stddev"),
        F.min("row_count").alias("min"),
        F.max("row_count").alias("max"),
        F.coalesce(F.avg("byte_size"), F.lit(0.0)).alias("mean_bytes"),
        F.min("byte_size").alias("min_bytes"),
        F.max("byte_size").alias("max_bytes"),
    )
    return join_null_safe(g, quantiles(m, key, "row_count", {"p5": 0.05, "p95": 0.95}), key)


def anomaly_summary(anomalies: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Total and counts by severity, status and type per organisation, in long form (A2).

    One pre-aggregation over the facts, then grouping sets over its few rows.
    """
    a = anomalies.filter(since("detected_at", as_of, hours))
    cube = a.groupBy("org_id", "severity", "status", "anomaly_type").agg(F.count("*").alias("n"))
    sets = [[F.col("org_id")], [F.col("org_id"), F.col("severity")], [F.col("org_id"), F.col("status")], [F.col("org_id"), F.col("anomaly_type")]]
    g = cube.groupingSets(sets, "org_id", "severity", "status", "anomaly_type").agg(
        F.sum("n").alias("n"), F.grouping("severity").alias("gs"), F.grouping("status").alias("gt"), F.grouping("anomaly_type").alias("ga")
    )
    dim = F.when(F.col("gs") == 0, "severity").when(F.col("gt") == 0, "status").when(F.col("ga") == 0, "type").otherwise("total")
    return g.select("org_id", dim.alias("dimension"), F.coalesce("severity", "status", "anomaly_type", F.lit("")).alias("value"), "n")


def job_summary(jobs: DataFrame, as_of: str, hours: int = 24, country: str | None = None) -> DataFrame:
    """Total, succeeded and failed jobs per organisation (A3)."""
    j = jobs.filter(since("started_at", as_of, hours))
    if country:
        j = j.filter(F.col("partition_key").like(f"%country={country}%"))
    return j.groupBy("org_id").agg(
        F.count("*").alias("total_jobs"),
        F.count_if(F.col("status") == "SUCCESS").alias("success_count"),
        F.count_if(F.col("status") == "FAILED").alias("failed_count"),
    )


def job_countries(jobs: DataFrame) -> DataFrame:
    """Countries that occur in partition keys (A4)."""
    c = jobs.filter(F.col("partition_key").like("%country=%"))
    return c.select("org_id", country_of(F.col("partition_key")).alias("country")).distinct().orderBy("org_id", "country")


def overview(datasets: DataFrame, anomalies: DataFrame, history: DataFrame, rules: DataFrame, as_of: str, hours: int = 168) -> DataFrame:
    """Dashboard counters in long form."""
    a = anomalies.filter(since("detected_at", as_of, hours))
    h = history.filter(since("sent_at", as_of, hours))
    total = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("counter"), "n")
    by = lambda df, c, name: df.groupBy(c).agg(F.count("*").alias("n")).select(F.concat(F.lit(f"{name}:"), c).alias("counter"), "n")
    parts = [
        total(datasets, "datasets"),
        total(a, "anomalies"),
        by(a, "severity", "anomalies"),
        total(h, "alerts"),
        by(h.filter(F.col("status").isin("SENT", "FAILED")), "status", "alerts"),
        total(rules.filter("enabled"), "active_rules"),
    ]
    return reduce(DataFrame.unionByName, parts)


def measure(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Count rows while ``df`` is written, without a second pass (A10).

    Read the result from the observation after the write.
    """
    seen = Observation(f"rows_{name}")
    return df.observe(seen, F.count(F.lit(1)).alias("row_count")), seen


def measured(df: DataFrame, name: str) -> DataFrame:
    """The row count of a dataset as a metric row (A10)."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(name).alias("dataset"), "row_count", F.lit("direct-df-metrics").alias("job_id"), F.lit("Success").alias("status")
    )


def output_metrics(job_runs: DataFrame) -> DataFrame:
    """Each output of a run gets the run's rows, bytes, end time and status.

    ``job_runs``: job_id, outputs array<string>, rows_written, bytes_written, ended_at, status.
    """
    return job_runs.select(
        F.explode("outputs").alias("dataset"),
        F.col("rows_written").alias("row_count"),
        F.col("bytes_written").alias("byte_size"),
        F.col("ended_at").alias("last_updated"),
        "job_id", "status",
    )
