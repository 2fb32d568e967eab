"""Queries that run a stream to its end and return what it wrote."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeledger.operators import alerts as al
from lakeledger.plans.q_alerts import _GREEDY, _MATCH
from lakeledger.plans.q_anomalies import _FOUND, _SCOPED
from lakeledger.plans.q_schema import _s
from lakeledger.plans.q_tables import _BASE, _OUT
from lakeledger.plans.registry import ORACLES, query
from lakeledger.runtime import scratch
from lakeledger.streaming import facts as fa
from lakeledger.streaming import windows as wi


def _in_steps(t, df: DataFrame, order: str, run: Callable[[DataFrame], None], steps: int = 2) -> None:
    """Let ``df`` arrive in ``steps`` parts along ``order``; after each one ``run`` works off what has come.

    Each part is written by all tasks; the stream takes up where it stopped.
    """
    path = scratch(t.spark, "arrivals")
    lo, hi = df.agg(F.min(order), F.max(order)).first()
    cuts = [lo + (hi - lo) * i / steps for i in range(1, steps)]
    for i in range(steps):
        part = df
        if i > 0:
            part = part.filter(F.col(order) >= F.lit(cuts[i - 1]))
        if i < steps - 1:
            part = part.filter(F.col(order) < F.lit(cuts[i]))
        part.write.mode("append").parquet(path)
        run(t.spark.readStream.schema(df.schema).parquet(path))


def _events(t) -> DataFrame:
    schema = t("events").schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)


def _append(stream: DataFrame, root: str) -> None:
    """Run an append stream into a table under ``root``."""
    w = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/progress").outputMode("append")
    fa.run_available(w)


def _to_table(t, stream: DataFrame) -> DataFrame:
    """Run an append stream into a table and read it back."""
    root = scratch(t.spark, "stream")
    _append(stream, root)
    return t.spark.read.schema(stream.schema).parquet(f"{root}/out")


@query("t1_stream_ingest", ORACLES["m4_latest_jobs"])
def _(t):
    root = scratch(t.spark, "ingest")
    _in_steps(t, t("v_payload_json"), "received_at", lambda raw: fa.run_available(fa.stream_ingest(raw, root)))
    return fa.read_facts(t.spark, root)["jobs"].select("org_id", "job_name", "partition_key", "status", "last_execution_id")


@query("t2_stream_schema_versions", """WITH m AS (SELECT 'cust' || (o_custkey % 200) AS dataset, (CAST(o_orderdate AS TIMESTAMP) + to_seconds(o_orderkey % 86400)) AS at_,
   'id:' || CASE WHEN o_orderkey % 3 = 0 THEN 'int' ELSE 'bigint' END || ':true' || CASE WHEN o_orderkey % 3 = 2 THEN ',email:string:false' ELSE '' END AS txt FROM {orders})
 SELECT dataset, sha256(txt) AS schema_hash, strftime(min(at_), '%Y-%m-%d %H:%M:%S') AS valid_from FROM m GROUP BY dataset, txt""")
def _(t):
    root = scratch(t.spark, "schemas")
    _in_steps(t, t("v_schema_payload_json"), "received_at", lambda raw: fa.run_available(fa.stream_schema_versions(raw, root)))
    return fa.read_versions(t.spark, root).select("dataset", "schema_hash", _s("valid_from").alias("valid_from"))


@query("t3_stream_metrics", """SELECT dataset, strftime(h, '%Y-%m-%d %H:%M:%S') AS ts, row_count, byte_size FROM (SELECT event_type AS dataset, date_trunc('hour', ts) AS h, count(*) AS row_count, CAST(sum(length(props)) AS BIGINT) AS byte_size FROM {events} GROUP BY ALL) x
 WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) FROM {events}) - INTERVAL 2 HOUR""")
def _(t):
    e = _events(t).select(F.col("event_type").alias("dataset"), F.col("ts").cast("timestamp").alias("ts"), F.length("props").alias("bytes"))
    out = _to_table(t, wi.stream_metrics(e))
    return out.select("dataset", _s("ts").alias("ts"), "row_count", "byte_size")


@query("t4_rolling_stats", """WITH m AS (SELECT dataset, date_trunc('day', ts) AS day, row_count FROM {v_metrics_hourly}), top AS (SELECT max(ts) - INTERVAL 1 DAY AS w FROM {v_metrics_hourly}),
 d AS (SELECT DISTINCT dataset, day FROM m, top WHERE day + INTERVAL 1 DAY <= w)
 SELECT d.dataset, strftime(d.day, '%Y-%m-%d') AS day, count(m.row_count) AS points, round(avg(m.row_count), 6) AS mean, round(stddev_samp(m.row_count), 6) AS std FROM d LEFT JOIN m ON m.dataset = d.dataset AND m.day < d.day AND m.day >= d.day - INTERVAL 30 DAY GROUP BY ALL""")
def _(t):
    root = scratch(t.spark, "stream")
    _in_steps(t, t("v_metrics_hourly"), "ts", lambda m: _append(wi.stream_daily_moments(m), root))
    daily = t.spark.read.parquet(f"{root}/out")
    r = wi.rolling_stats(daily)
    return r.select("dataset", F.date_format("day", "yyyy-MM-dd").alias("day"), "points", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("t5_stream_anomalies", f"""WITH {_SCOPED}, {_FOUND} SELECT org_id, dataset, job_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, measure, way FROM hits WHERE way IS NOT NULL""")
def _(t):
    root = scratch(t.spark, "loads")
    _in_steps(t, t("v_metrics"), "ts", lambda m: fa.run_available(fa.stream_anomalies(m, root)))
    a = t.spark.read.parquet(f"{root}/anomalies")
    measure = F.when(F.col("anomaly_type").like("Row%"), "row_count").otherwise("byte_size")
    way = F.when(F.col("anomaly_type").like("%Spike"), "up").otherwise("down")
    return a.select("org_id", "dataset", "job_id", _s("ts").alias("ts"), measure.alias("measure"), way.alias("way"))


@query("t6_stream_dedup", f"WITH RECURSIVE {_GREEDY} SELECT rule_id, anomaly_id, status FROM d")
def _(t):
    root = scratch(t.spark, "dedup")
    _in_steps(t, al.match_rules(t("v_anomalies"), t("v_rules")).drop("status"), "detected_at", lambda m: fa.run_available(fa.stream_dedup(m, root)))
    return t.spark.read.parquet(f"{root}/alerts").select("rule_id", "anomaly_id", "status")


@query("t7_stream_match_rules", f"WITH {_MATCH} SELECT rule_id, anomaly_id FROM m")
def _(t):
    root = scratch(t.spark, "matches")
    rules = lambda: t("v_rules")
    _in_steps(t, t("v_anomalies"), "detected_at", lambda a: fa.run_available(fa.stream_match_rules(a, rules, root)))
    return t.spark.read.parquet(f"{root}/matches").select("rule_id", "anomaly_id")


@query("t8_stream_freshness", """WITH u AS (SELECT DISTINCT 'u' || user_id AS dataset, ts FROM {events}), n AS (SELECT *, lead(ts) OVER (PARTITION BY dataset ORDER BY ts) AS later FROM u)
 SELECT dataset, strftime(ts, '%Y-%m-%d %H:%M:%S') AS last_updated, 2 AS sla_hours FROM n WHERE later > ts + INTERVAL 2 HOUR OR (later IS NULL AND epoch_ms(ts) + 7200000 < (SELECT epoch_ms(max(ts)) FROM u))""")
def _(t):
    e = t("events").select(F.lit("o1").alias("org_id"), F.concat(F.lit("u"), "user_id").alias("dataset"), F.col("ts").cast("timestamp").alias("ts"))
    slas = e.select("org_id", "dataset", F.lit(2).alias("sla_hours")).distinct()
    root = scratch(t.spark, "stream")
    _in_steps(t, e, "ts", lambda u: _append(wi.stream_freshness(u, slas), root), 3)
    return t.spark.read.parquet(f"{root}/out").select("dataset", _s("last_updated").alias("last_updated"), "sla_hours")


_RUN = "SELECT 'app' || CAST(user_id % 20 AS STRING) AS app_id, CAST(ts AS TIMESTAMP) AS ts FROM {events}"


@query("t9_run_sessions", f"""WITH e AS ({_RUN}), f AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY app_id ORDER BY ts) > ts - INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM e),
 g AS (SELECT *, sum(s) OVER (PARTITION BY app_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM f) SELECT app_id, count(*) AS queries, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ended_at FROM g GROUP BY app_id, n""")
def _(t):
    s = wi.run_sessions(t.sql(_RUN))
    return s.select("app_id", "queries", _s("started_at").alias("started_at"), _s("ended_at").alias("ended_at"))


@query("t9_stream_sessions", f"""WITH e AS ({_RUN}), f AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY app_id ORDER BY ts) > ts - INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM e),
 g AS (SELECT *, sum(s) OVER (PARTITION BY app_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM f) SELECT app_id, count(*) AS queries, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started_at FROM g GROUP BY app_id, n
 HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM e) - INTERVAL 1 HOUR""")
def _(t):
    e = _events(t).select(F.concat(F.lit("app"), (F.col("user_id") % 20).cast("string")).alias("app_id"), F.col("ts").cast("timestamp").alias("ts"))
    out = _to_table(t, wi.stream_sessions(e))
    return out.select("app_id", "queries", _s("started_at").alias("started_at"))
