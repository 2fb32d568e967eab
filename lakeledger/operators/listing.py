"""Lists, lookups and paging over the fact tables (P*, O*, views)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeledger.functions.units import duration_ms


def since(ts: str, as_of: str, hours: int) -> Column:
    """``ts`` lies in the ``hours`` before ``as_of``."""
    return F.col(ts) > F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(hours)} HOURS")


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of an ordered list (O1); give a unique last order key."""
    out = df.orderBy(*order)
    return (out.offset(offset) if offset else out).limit(limit)


def list_datasets(datasets: DataFrame, org: str, dataset_type: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    d = datasets.filter(F.col("org_id") == org)
    if dataset_type:
        d = d.filter(F.col("dataset_type") == dataset_type)
    return page(d, [F.desc("updated_at"), F.asc("name")], limit, offset)


def get_dataset(datasets: DataFrame, org: str, name: str) -> DataFrame:
    return datasets.filter((F.col("org_id") == org) & (F.col("name") == name))


def metric_series(metrics: DataFrame, org: str, dataset: str, as_of: str, hours: int = 168, limit: int = 1000) -> DataFrame:
    m = metrics.filter((F.col("org_id") == org) & (F.col("dataset") == dataset) & since("ts", as_of, hours))
    return page(m, [F.desc("ts"), F.asc_nulls_first("job_id")], limit)


def list_anomalies(
    anomalies: DataFrame, org: str, as_of: str, dataset: str | None = None, severity: str | None = None,
    status: str | None = None, hours: int | None = 24, limit: int = 100, offset: int = 0,
) -> DataFrame:
    a = anomalies.filter(F.col("org_id") == org)
    for c, v in (("dataset", dataset), ("severity", severity), ("status", status)):
        if v:
            a = a.filter(F.col(c) == v)
    if hours:
        a = a.filter(since("detected_at", as_of, hours))
    return page(a, [F.desc("detected_at"), F.desc("anomaly_id")], limit, offset)


def get_by_id(df: DataFrame, column: str, value) -> DataFrame:
    """Point lookup of an anomaly, a job or a rule."""
    return df.filter(F.col(column) == value)


def list_jobs(
    jobs: DataFrame, org: str, as_of: str | None = None, status: str | None = None, job_name: str | None = None,
    application_id: str | None = None, country: str | None = None, hours: int | None = None, limit: int = 50, offset: int = 0,
) -> DataFrame:
    """Jobs with their duration; the status test ignores case."""
    j = jobs.filter(F.col("org_id") == org)
    if status:
        j = j.filter(F.upper("status") == status.upper())
    if job_name:
        j = j.filter(F.col("job_name").ilike(f"%{job_name}%"))
    if application_id:
        j = j.filter(F.col("app_id") == application_id)
    if country:
        j = j.filter(F.col("partition_key").like(f"%country={country}%"))
    if hours:
        j = j.filter(since("started_at", as_of, hours))
    j = j.withColumn("duration_ms", duration_ms(F.col("started_at"), F.col("ended_at")))
    return page(j, [F.desc("started_at"), F.asc("app_id")], limit, offset)


def list_alert_history(
    history: DataFrame, rules: DataFrame, org: str, as_of: str, hours: int = 24, status: str | None = None, limit: int = 100
) -> DataFrame:
    mine = rules.filter((F.col("org_id") == org) | F.col("org_id").isNull()).select("rule_id", "rule_name")
    h = history.filter(since("sent_at", as_of, hours))
    if status:
        h = h.filter(F.col("status") == status)
    return page(h.join(mine, "rule_id"), [F.desc("sent_at"), F.desc("alert_id")], limit)


def list_alert_rules(rules: DataFrame, org: str | None = None, enabled: bool | None = None) -> DataFrame:
    r = rules
    if org:
        r = r.filter((F.col("org_id") == org) | F.col("org_id").isNull())
    return r if enabled is None else r.filter(F.col("enabled") == enabled)


def recent_anomalies(anomalies: DataFrame, as_of: str) -> DataFrame:
    """Anomalies of the last seven days, newest first (P10)."""
    return anomalies.filter(since("detected_at", as_of, 24 * 7)).orderBy(F.desc("detected_at"), F.desc("anomaly_id"))


def lineage_graph_view(edges: DataFrame, datasets: DataFrame) -> DataFrame:
    """Edges whose two ends are known datasets of the same organisation."""
    s = datasets.select("org_id", F.col("name").alias("source"), F.col("dataset_type").alias("source_type"))
    t = datasets.select("org_id", F.col("name").alias("target"), F.col("dataset_type").alias("target_type"))
    return edges.join(s, ["org_id", "source"]).join(t, ["org_id", "target"])


def scoped_metrics(metrics: DataFrame, datasets: DataFrame) -> DataFrame:
    """Metrics of known datasets with their type."""
    return metrics.join(datasets.select("org_id", F.col("name").alias("dataset"), "dataset_type"), ["org_id", "dataset"])


def sort_jobs(jobs: DataFrame, field: str, ascending: bool = True) -> DataFrame:
    """Jobs by any field, text regardless of case."""
    c = F.lower(field) if dict(jobs.dtypes)[field] == "string" else F.col(field)
    return jobs.orderBy(c.asc() if ascending else c.desc(), F.asc("app_id"))


def register_views(spark, **frames: DataFrame) -> None:
    """Publish fact views under their names for SQL users."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
