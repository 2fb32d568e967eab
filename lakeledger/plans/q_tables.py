"""Queries: message parsing, upserts, latest rows, retention."""

from pyspark.sql import functions as F

from lakeledger.operators import tables as tb
from lakeledger.plans.registry import query
from lakeledger.sources.payloads import parse_ingest, parse_schema_ingest

_OK = "o_orderkey % 97 <> 5"
_OUT = "'out' || CAST(o_custkey % 50 AS VARCHAR)"
_OUTLOC = "'hdfs://nn:8020/out' || CAST(o_custkey % 50 AS VARCHAR) || CASE WHEN o_orderkey % 2 = 0 THEN '/country=C' || CAST(o_custkey % 3 AS VARCHAR) ELSE '' END || '/dt=20240101'"
_REF = "'lake:ref' || CAST(o_orderkey % 7 AS VARCHAR)"
_RECV = "(CAST(o_orderdate AS TIMESTAMP) + to_seconds(o_orderkey % 86400))"
_ORG = "'o' || CAST(1 + o_custkey % 2 AS VARCHAR)"
_JN = "CASE WHEN o_orderkey % 10 = 3 THEN NULL ELSE o_orderpriority END"
_BASE = f"""p AS (SELECT *, {_ORG} AS org_id, {_RECV} AS received_at, 'run-' || o_orderkey AS job_id, {_JN} AS job_name FROM {{orders}} WHERE {_OK})"""
_REFS = f"""refs AS (SELECT org_id, received_at, job_id, 'customer:' || o_custkey AS name, 'table' AS dataset_type, CAST(NULL AS VARCHAR) AS location FROM p
  UNION ALL SELECT org_id, received_at, job_id, {_REF}, 's3', 's3a://lake/ref' || (o_orderkey % 7) || '/date=2024-01-0' || (1 + o_orderkey % 9) FROM p
  UNION ALL SELECT org_id, received_at, job_id, {_OUT}, 'hdfs', {_OUTLOC} FROM p)"""


def _good(t):
    return parse_ingest(t("v_payload_json"))[0]


def _f(c):
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def _s(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


@query("s7_parse_ingest", f"""WITH {_BASE} SELECT org_id, job_id, job_name, 'app-' || o_custkey AS application_id, CASE o_orderstatus WHEN 'F' THEN 'Failed' ELSE 'Success' END AS status,
  strftime(o_orderdate, '%Y-%m-%d') || ' 01:02:03' AS started_at, {_OUT} AS output, CAST(floor(o_totalprice / 100) AS BIGINT) AS row_count, CASE WHEN o_orderkey % 4 <> 1 THEN o_orderkey END AS rows_written FROM p""")
def _(t):
    g = _good(t)
    out = F.col("outputs")[0]["name"]
    return g.select(
        "org_id", "job_id", "job_name", "application_id", "status", _s("started_at"), out.alias("output"),
        F.try_element_at("metrics", out)["row_count"].alias("row_count"), F.try_element_at("execution_metrics", F.lit("rows_written")).alias("rows_written"),
    )


@query("s7_unreadable_messages", "SELECT 'o' || CAST(1 + o_custkey % 2 AS VARCHAR) AS org_id, '{\"job_id\": \"broken-' || o_orderkey AS value FROM {orders} WHERE o_orderkey % 97 = 5")
def _(t):
    return parse_ingest(t("v_payload_json"))[1].select("org_id", "value")


@query("s8_parse_schema_ingest", """SELECT 'o1' AS org_id, 'cust' || (o_custkey % 200) AS dataset, 'run-' || o_orderkey AS job_id, 'h' || (o_orderkey % 3) AS version_hash,
  'id:' || CASE WHEN o_orderkey % 3 = 0 THEN 'int' ELSE 'bigint' END || ':true' || CASE WHEN o_orderkey % 3 = 2 THEN ',email:string:false' ELSE '' END AS fields FROM {orders}""")
def _(t):
    g, _bad = parse_schema_ingest(t("v_schema_payload_json"))
    text = F.array_join(F.transform("fields", lambda f: F.concat_ws(":", f["name"], f["type"], f["nullable"].cast("string"))), ",")
    return g.select("org_id", "dataset", "job_id", "version_hash", text.alias("fields"))


@query("u5_payload_datasets", f"WITH {_BASE}, {_REFS} SELECT org_id, job_id, name, dataset_type, location FROM refs")
def _(t):
    return tb.payload_datasets(_good(t)).select("org_id", "job_id", "name", "dataset_type", "location")


@query("m9_explode_payload", f"""WITH {_BASE}, {_REFS} SELECT 'datasets' AS fact, org_id, count(*) AS n FROM refs GROUP BY ALL UNION ALL SELECT 'edges', org_id, 2 * count(*) FROM p GROUP BY ALL UNION ALL SELECT 'column_edges', org_id, count(*) FROM p GROUP BY ALL
  UNION ALL SELECT 'jobs', org_id, count(*) FROM p WHERE o_orderkey % 4 <> 1 GROUP BY ALL UNION ALL SELECT 'metrics', org_id, count(*) FROM p GROUP BY ALL UNION ALL SELECT 'anomalies', org_id, count(*) FROM p WHERE o_orderkey % 8 = 0 GROUP BY ALL""")
def _(t):
    parts = [df.groupBy("org_id").agg(F.count("*").alias("n")).select(F.lit(k).alias("fact"), "org_id", "n") for k, df in tb.explode_payload(_good(t)).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("m1_upsert_datasets", f"""WITH {_BASE}, {_REFS}, c AS (SELECT org_id, name, last(dataset_type ORDER BY received_at, job_id, dataset_type) AS dt, last(location ORDER BY received_at, job_id, location) FILTER (location IS NOT NULL) AS loc, min(received_at) AS f, max(received_at) AS l FROM refs GROUP BY ALL),
  b AS (SELECT * FROM {{v_datasets}})
  SELECT coalesce(b.org_id, c.org_id) AS org_id, coalesce(b.name, c.name) AS name, coalesce(c.dt, b.dataset_type) AS dataset_type, coalesce(c.loc, b.location, '-') AS stored_location, {_f('coalesce(b.created_at, c.f)')} AS created_at, {_f('coalesce(c.l, b.updated_at)')} AS updated_at
  FROM b FULL JOIN c ON b.org_id = c.org_id AND b.name = c.name""")
def _(t):
    d = tb.upsert_datasets(t("v_datasets"), tb.payload_datasets(_good(t)))
    return d.select("org_id", "name", "dataset_type", F.coalesce("location", F.lit("-")).alias("stored_location"), _s("created_at"), _s("updated_at"))


@query("m2_upsert_edges", f"""WITH {_BASE}, e AS (SELECT org_id, received_at, job_id, job_name, 'customer:' || o_custkey AS source, {_OUT} AS target FROM p UNION ALL SELECT org_id, received_at, job_id, job_name, {_REF}, {_OUT} FROM p)
  SELECT org_id, source, target, job_id, job_name FROM (SELECT *, row_number() OVER (PARTITION BY org_id, source, target ORDER BY received_at DESC, job_id DESC) AS rn FROM e) x WHERE rn = 1""")
def _(t):
    return tb.upsert_edges(None, tb.payload_edges(_good(t))).select("org_id", "source", "target", "job_id", "job_name")


@query("m3_upsert_column_edges", f"""WITH {_BASE}, e AS (SELECT org_id, received_at, job_id, 'customer:' || o_custkey AS source_dataset, 'c' || (o_orderkey % 3) AS source_column, {_OUT} AS target_dataset, 't' || (o_orderkey % 2) AS target_column,
   CASE WHEN o_orderkey % 2 = 0 THEN 'DIRECT' ELSE 'EXPRESSION' END AS transform_type, 'e' || (o_orderkey % 4) AS expression FROM p)
  SELECT org_id, source_dataset, source_column, target_dataset, target_column, transform_type, expression FROM (SELECT *, row_number() OVER (PARTITION BY org_id, source_dataset, source_column, target_dataset, target_column ORDER BY received_at DESC, job_id DESC) AS rn FROM e) x WHERE rn = 1""")
def _(t):
    return tb.upsert_column_edges(None, tb.payload_column_edges(_good(t))).drop("received_at", "job_id")


@query("m4_latest_jobs", f"""WITH {_BASE}, j AS (SELECT org_id, coalesce(job_name, job_id) AS job_name, CASE WHEN o_orderkey % 6 = 0 THEN 'region=r' || (o_custkey % 4) WHEN o_orderkey % 2 = 0 THEN 'country=C' || (o_custkey % 3) ELSE 'GLOBAL' END AS partition_key,
   CASE o_orderstatus WHEN 'F' THEN 'FAILED' ELSE 'SUCCESS' END AS status, job_id AS last_execution_id, received_at FROM p WHERE o_orderkey % 4 <> 1)
  SELECT org_id, job_name, partition_key, status, last_execution_id FROM (SELECT *, row_number() OVER (PARTITION BY org_id, job_name, partition_key ORDER BY received_at DESC, last_execution_id DESC) AS rn FROM j) x WHERE rn = 1""")
def _(t):
    return tb.latest_jobs(None, tb.payload_jobs(_good(t))).select("org_id", "job_name", "partition_key", "status", "last_execution_id")


@query("m5_append_metrics", f"""WITH {_BASE} SELECT org_id, {_OUT} AS dataset, job_id, job_name, 'hdfs://nn:8020/out' || (o_custkey % 50) || CASE WHEN o_orderkey % 2 = 0 THEN '/country=C' || (o_custkey % 3) ELSE '' END || '/dt=*' AS partition_key,
  CAST(floor(o_totalprice / 100) AS BIGINT) AS row_count, CAST(floor(o_totalprice) AS BIGINT) AS byte_size FROM p""")
def _(t):
    return tb.append_rows(None, tb.payload_metrics(_good(t))).drop("ts")


@query("m6_append_anomalies", f"""WITH {_BASE} SELECT org_id, {_OUT} AS dataset, 'RowCountSpike' AS anomaly_type, 'WARNING' AS severity, '{{"value":5.5}}' AS actual_value, 3.0::DOUBLE AS deviation_score, 'm' || o_orderkey AS description, job_id FROM p WHERE o_orderkey % 8 = 0""".replace('{"value":5.5}', "' || chr(123) || '\"value\":5.5' || chr(125) || '"))
def _(t):
    return tb.append_rows(None, tb.payload_anomalies(_good(t))).drop("detected_at", "expected_value")


@query("s10_fact_upsert", f"""WITH {_BASE}, e AS (SELECT org_id, source, target, 'job' AS job_id, TIMESTAMP '1990-01-01 00:00:00' AS received_at FROM {{v_edges}} WHERE target LIKE 'customer%' UNION ALL SELECT org_id, 'customer:' || o_custkey, {_OUT}, job_id, received_at FROM p UNION ALL SELECT org_id, {_REF}, {_OUT}, job_id, received_at FROM p)
  SELECT org_id, source, target, job_id FROM (SELECT *, row_number() OVER (PARTITION BY org_id, source, target ORDER BY received_at DESC, job_id DESC) AS rn FROM e) x WHERE rn = 1""")
def _(t):
    base = t("v_edges").filter("target LIKE 'customer%'").select("org_id", F.timestamp_seconds(F.lit(631152000)).alias("received_at"), F.lit("job").alias("job_id"), "job_name", "source", "target")
    return tb.upsert_edges(base, tb.payload_edges(_good(t))).select("org_id", "source", "target", "job_id")


_KEEP = "SELECT org_id, dataset, job_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, row_count FROM (SELECT *, row_number() OVER (PARTITION BY org_id, dataset, job_name, partition_key ORDER BY ts DESC, job_id DESC) AS rn FROM {v_metrics}) x WHERE rn <= "


@query("m7_retention", _KEEP + "30")
def _(t):
    return tb.retain_last(t("v_metrics"), 30).select("org_id", "dataset", "job_id", _s("ts"), "row_count")


@query("w1_retain_last", _KEEP + "200")
def _(t):
    return tb.retain_last(t("v_metrics"), 200).select("org_id", "dataset", "job_id", _s("ts"), "row_count")


@query("w2_latest_per_key", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM {events}) x WHERE rn = 1")
def _(t):
    return tb.latest_per_key(t("events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("m10_rule_changes", """WITH log AS (SELECT rule_id, 'upsert' AS op, -1 AS seq, rule_name, org_id, dataset_pattern, severity, enabled FROM {v_rule_book} UNION ALL SELECT rule_id, op, seq, rule_name, org_id, dataset_pattern, severity, enabled FROM {v_rule_changes}),
  del AS (SELECT rule_id, max(seq) AS d FROM log WHERE op = 'delete' GROUP BY 1), live AS (SELECT l.* FROM log l LEFT JOIN del USING (rule_id) WHERE op = 'upsert' AND (d IS NULL OR seq > d))
  SELECT rule_id, max_by(rule_name, seq) FILTER (rule_name IS NOT NULL) AS rule_name, max_by(org_id, seq) FILTER (org_id IS NOT NULL) AS org_id, max_by(dataset_pattern, seq) FILTER (dataset_pattern IS NOT NULL) AS dataset_pattern,
   max_by(severity, seq) FILTER (severity IS NOT NULL) AS severity, max_by(enabled, seq) FILTER (enabled IS NOT NULL) AS enabled FROM live GROUP BY rule_id""")
def _(t):
    return tb.apply_rule_changes(t("v_rule_book"), t("v_rule_changes"))
