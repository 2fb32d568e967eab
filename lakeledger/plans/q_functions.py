"""Queries that run the scalar functions over whole tables."""

from pyspark.sql import functions as F

from lakeledger.functions import naming, paths, schema_text, units
from lakeledger.plans.registry import query

_EXT = r"\.(parquet|csv|json|orc|avro)$"


@query("f1_generalize_path", r"""
SELECT path_id, CASE WHEN coalesce(path, '') = '' THEN 'UNKNOWN' ELSE
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(path,
   '(?i)/(date|dt|year|month|day|hour|minute|timestamp|ts)=[^/]+', '/\1=*', 'g'), '\d[0-9]{7}-\d[0-9]{7}', '*', 'g'), '\d\d\d\d-\d\d-\d\d', '*', 'g'),
   '/(\d\d\d\d\d\d\d?\d?)/', '/*/', 'g'), '/\d\d\d\d/\d\d/\d\d/', '/*/*/*/', 'g'), '/\d\d\d\d/\d\d/', '/*/*/', 'g'),
   '\d\d[:\-]\d\d[:\-]\d\d', '*', 'g'), '_attempt_\d+', '*', 'g'), '_temporary', '*', 'g') END AS signature FROM {v_paths}""".replace("[0-9]{7}", r"\d\d\d\d\d\d\d"))
def _(t):
    return t("v_paths").select("path_id", paths.generalize_path(F.col("path")).alias("signature"))


_SEG = r"""CASE WHEN regexp_matches(s, '^(date|year|month|day|hour|dt|partition_date)=.+') THEN split_part(s, '=', 1) || '=*'
 WHEN regexp_matches(s, '^(\d\d\d\d-\d\d-\d\d|\d\d\d\d\d\d\d\d|\d\d\d\d\d\d|\d\d\d\d\d\d\d\d-\d\d\d\d\d\d\d\d|\d\d\d\d|0[1-9]|1[0-2]|[12][0-9]|3[01]|[a-z][a-z]-[a-z]+-\d+|staging|prod|dev|test)$') THEN '*' ELSE s END"""


@query("f2_generalize_location", rf"""
SELECT path_id, sch || CASE WHEN length(body) > 1 THEN rtrim(body, '/') ELSE body END AS location FROM (
 SELECT path_id, sch, array_to_string([{_SEG} for s in string_split(substr(path, length(sch) + 1), '/')], '/') AS body
 FROM (SELECT *, regexp_extract(path, '^([a-z0-9]*://|file:)', 1) AS sch FROM {{v_paths}} WHERE path IS NOT NULL) p) q""")
def _(t):
    return t("v_paths").filter("path IS NOT NULL").select("path_id", paths.generalize_location(F.col("path")).alias("location"))


_PART = r"""regexp_matches(s, '^(date|year|month|day|hour|dt|partition_date|country|region|zone|geo|location|market)=.+')
 OR regexp_matches(s, '^(\d\d\d\d-\d\d-\d\d|\d\d\d\d\d\d\d\d|\d\d\d\d\d\d|\d\d\d\d\d\d\d\d-\d\d\d\d\d\d\d\d|\d\d\d\d|0[1-9]|1[0-2]|[12][0-9]|3[01]|[A-Z][A-Z]|[a-z][a-z]|[a-z][a-z]-[a-z]+-\d+|staging|prod|dev|test)$')"""


@query("f3_dataset_name", rf"""
SELECT path_id, CASE WHEN bucket <> '' THEN bucket || ':' ELSE '' END || regexp_replace(coalesce([s for s in parts if NOT ({_PART})][-1], parts[-1], 'unknown_dataset'), '{_EXT}', '') AS name
FROM (SELECT *, [s for s in string_split(CASE WHEN bucket <> '' AND inside <> '' THEN inside ELSE bare END, '/') if s <> ''] AS parts
 FROM (SELECT *, regexp_replace(substr(bare, length(bucket) + 1), '^/', '') AS inside
  FROM (SELECT path_id, path, regexp_replace(path, '^[a-z][a-z0-9+.-]*://', '') AS bare,
     CASE WHEN path LIKE 'file:%' THEN '' ELSE regexp_extract(path, '^[a-z][a-z0-9+.-]*://([^/]+)', 1) END AS bucket FROM {{v_paths}} WHERE path IS NOT NULL) a) b) c""")
def _(t):
    return t("v_paths").filter("path IS NOT NULL").select("path_id", paths.dataset_name_from_path(F.col("path")).alias("name"))


_GEO = r"""(SELECT path_id, k, v FROM (
   SELECT path_id, lower(k) AS k, v, row_number() OVER (PARTITION BY path_id, lower(k) ORDER BY i DESC) AS rn FROM (
     SELECT path_id, unnest(regexp_extract_all(path, '(?i)/(country|region|zone|geo|location|market)=([^/]+)', 1)) AS k,
            unnest(regexp_extract_all(path, '(?i)/(country|region|zone|geo|location|market)=([^/]+)', 2)) AS v,
            unnest(range(len(regexp_extract_all(path, '(?i)/(country|region|zone|geo|location|market)=([^/]+)', 1)))) AS i
     FROM {v_paths} WHERE path IS NOT NULL) a WHERE v <> '*') b WHERE rn = 1)"""
_GEO_ALL = rf"""(SELECT * FROM {_GEO} UNION ALL
   SELECT path_id, 'country', [s for s in string_split(path, '/') if regexp_matches(s, '^[A-Z][A-Z]$')][1] FROM {{v_paths}} p
   WHERE len([s for s in string_split(path, '/') if regexp_matches(s, '^[A-Z][A-Z]$')]) > 0 AND NOT EXISTS (SELECT 1 FROM {_GEO} g WHERE g.path_id = p.path_id AND g.k = 'country'))"""


@query("f4_extract_geo", f"SELECT path_id, k, v FROM {_GEO_ALL} g")
def _(t):
    return t("v_paths").select("path_id", F.explode(paths.extract_geo(F.col("path"))).alias("k", "v"))


@query("f5_geo_partition_key", f"SELECT p.path_id, coalesce(string_agg(k || '=' || v, ',' ORDER BY k || '=' || v), 'GLOBAL') AS partition_key FROM {{v_paths}} p LEFT JOIN {_GEO_ALL} g ON g.path_id = p.path_id GROUP BY p.path_id")
def _(t):
    return t("v_paths").select("path_id", paths.geo_partition_key(F.col("path")).alias("partition_key"))


_TYPE = r"""CASE WHEN upper(coalesce({d}, '')) IN ('TABLE', 'VIEW') THEN lower({d})
 WHEN regexp_matches(lower({l}), '^s3[an]?://') THEN 's3' WHEN lower({l}) LIKE 'gs://%' THEN 'gcs' WHEN regexp_matches(lower({l}), '^(wasbs?|abfss?|adl)://') THEN 'azure'
 WHEN lower({l}) LIKE 'hdfs://%' THEN 'hdfs' WHEN lower({l}) LIKE 'dbfs:/%' THEN 'dbfs' WHEN lower({l}) LIKE 'file:/%' OR {l} LIKE '/%' THEN 'file'
 WHEN regexp_matches(lower({n}), '\.(parquet|csv|json|orc|avro)$') THEN 'file' WHEN lower({n}) LIKE '%iceberg%' OR lower({l}) LIKE '%iceberg%' THEN 'iceberg'
 WHEN lower({n}) LIKE '%delta%' OR lower({l}) LIKE '%delta%' THEN 'delta' WHEN {n} LIKE '/%' OR regexp_matches({n}, '^[a-z][a-z0-9+.-]*://') THEN 'file'
 WHEN upper({d}) = 'FILE' THEN 'file' WHEN coalesce({d}, '') <> '' THEN lower({d}) ELSE 'table' END"""


@query("f6_infer_dataset_type", "SELECT path_id, " + _TYPE.replace("{d}", "declared").replace("{l}", "path").replace("{n}", "('t' || CAST(path_id % 3 AS VARCHAR) || coalesce(path, 'x.csv'))") + " AS by_location, "
       + _TYPE.replace("{d}", "declared").replace("{l}", "NULL").replace("{n}", "coalesce(path, '')") + " AS by_name FROM {v_paths}")
def _(t):
    p = t("v_paths")
    odd = F.concat(F.lit("t"), (F.col("path_id") % 3).cast("string"), F.coalesce("path", F.lit("x.csv")))
    return p.select(
        "path_id",
        paths.infer_dataset_type(odd, F.col("path"), F.col("declared")).alias("by_location"),
        paths.infer_dataset_type(F.coalesce("path", F.lit("")), F.lit(None).cast("string"), F.col("declared")).alias("by_name"),
    )


@query("f7_infer_location", "SELECT path_id, CASE WHEN path LIKE '/%' OR regexp_matches(path, '^[a-z][a-z0-9+.-]*://') THEN path END AS location FROM {v_paths}")
def _(t):
    return t("v_paths").select("path_id", paths.infer_location(F.col("path")).alias("location"))


@query("f8_extract_file_path", """SELECT path_id, CASE path_id % 16 WHEN 9 THEN '/a/20240101/20240102/b/10' WHEN 7 THEN NULL WHEN 12 THEN NULL ELSE path END AS found FROM {v_paths}""")
def _(t):
    node = F.concat(F.lit("InsertIntoHadoopFsRelationCommand "), F.coalesce("path", F.lit("none")), F.lit(", false, [k=v], Parquet"))
    return t("v_paths").select("path_id", paths.extract_file_path(node).alias("found"))


_TBL = """CASE path_id % 4 WHEN 0 THEN 'Create `spark_catalog`.`default`.`t' || CAST(path_id AS STRING) || '`, x' WHEN 1 THEN 'Append `db`.`u' || CAST(path_id AS STRING) || '`'
 WHEN 2 THEN 'Relation spark_catalog.sales.v' || CAST(path_id AS STRING) || '[a#1] parquet' ELSE 'nothing here' END"""


@query("f9_table_from_plan", "SELECT path_id, CASE path_id % 4 WHEN 0 THEN 't' || path_id WHEN 1 THEN 'u' || path_id WHEN 2 THEN 'v' || path_id END AS table_name FROM {v_paths}")
def _(t):
    return t.sql(f"SELECT path_id, {_TBL} AS node FROM {{v_paths}}").select("path_id", naming.table_from_plan(F.col("node")).alias("table_name"))


@query("s4_source_tables", "SELECT path_id, CASE path_id % 5 WHEN 0 THEN 'users' || path_id WHEN 1 THEN 'snow' WHEN 2 THEN 'bq' WHEN 3 THEN 'rs' END AS name FROM {v_paths}")
def _(t):
    rel = t.sql("""SELECT path_id, CASE path_id % 5 WHEN 0 THEN 'JDBCRelation(public.users' || CAST(path_id AS STRING) || ') [url=jdbc:postgresql://host/db]'
      WHEN 1 THEN 'SnowflakeRelation(db.s.snow)' WHEN 2 THEN 'GoogleBigQueryRelation[x](proj.bq)' WHEN 3 THEN 'Generic dbtable=rs, user=u' ELSE 'LocalRelation [a#1]' END AS node FROM {v_paths}""")
    return rel.select("path_id", naming.last_part(naming.source_table(F.col("node"))).alias("name"))


@query("f10_schema_hash", """SELECT org_id, dataset, strftime(captured_at, '%Y-%m-%d') AS day,
  sha256(string_agg(name || ':' || type || ':' || CAST(nullable AS VARCHAR), ',' ORDER BY pos)) AS hash_comma,
  sha256(string_agg(name || ':' || type || ':' || CAST(nullable AS VARCHAR), '|' ORDER BY pos)) AS hash_pipe FROM {v_snapshot_fields} GROUP BY ALL""")
def _(t):
    from lakeledger.operators.schema_history import snapshots_from_fields

    s = snapshots_from_fields(t("v_snapshot_fields"))
    return s.select(
        "org_id", "dataset", F.date_format("captured_at", "yyyy-MM-dd").alias("day"),
        schema_text.schema_hash(F.col("fields")).alias("hash_comma"), schema_text.schema_hash(F.col("fields"), "|").alias("hash_pipe"),
    )


_MEM = "CAST(1 + o_custkey % 4000 AS STRING) || CASE o_orderkey % 5 WHEN 0 THEN 'g' WHEN 1 THEN 'm' WHEN 2 THEN 'K' WHEN 3 THEN 'G' ELSE '000000' END"


@query("f11_parse_memory", """SELECT o_orderkey, CAST(CASE o_orderkey % 5 WHEN 0 THEN (1 + o_custkey % 4000) * 1024 WHEN 1 THEN 1 + o_custkey % 4000 WHEN 2 THEN (1 + o_custkey % 4000) // 1024
  WHEN 3 THEN (1 + o_custkey % 4000) * 1024 ELSE (1 + o_custkey % 4000) * 1000000 // 1048576 END AS BIGINT) AS mb FROM {orders}""")
def _(t):
    m = t.sql(f"SELECT o_orderkey, {_MEM} AS mem FROM {{orders}}")
    return m.select("o_orderkey", units.parse_memory_mb(F.col("mem")).alias("mb"))


_EXPR = """CASE event_id % 8 WHEN 0 THEN 'user_id#' || CAST(event_id AS STRING) WHEN 1 THEN 'sum(amount)' WHEN 2 THEN 'CASE WHEN a THEN b END'
 WHEN 3 THEN 'a > 5' WHEN 4 THEN 'upper(name#7)' WHEN 5 THEN 'minute(ts)' WHEN 6 THEN '(x + 1)' ELSE 'if(a, count(b), 0)' END"""


@query("f12_transform_type", """SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'DIRECT' WHEN 1 THEN 'AGGREGATE' WHEN 2 THEN 'CASE' WHEN 3 THEN 'FILTER' WHEN 7 THEN 'AGGREGATE' ELSE 'EXPRESSION' END AS kind FROM {events}""")
def _(t):
    e = t.sql(f"SELECT event_id, {_EXPR} AS e FROM {{events}}")
    return e.select("event_id", naming.transform_type(F.col("e")).alias("kind"))


_PROPS = """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'custom' END AS c, CASE WHEN event_id % 5 = 1 THEN 'descr' END AS d, CASE WHEN event_id % 5 = 2 THEN 'site' END AS s,
  CASE WHEN event_id % 7 <> 6 THEN 'app' || CAST(user_id AS STRING) END AS a, CASE WHEN event_id % 2 = 0 THEN event_id END AS q FROM {events}"""


@query("f13_job_name", f"SELECT event_id, coalesce(c, d, s, a || ' [SQL-' || CAST(q AS VARCHAR) || ']', a) AS job_name FROM ({_PROPS}) p")
def _(t):
    p = t.sql(_PROPS)
    return p.select("event_id", naming.job_name(*[F.col(x) for x in "cdsaq"]).alias("job_name"))


_RATIO = """WITH x AS (SELECT *, CASE WHEN coalesce(execution_time_ms, 0) <> 0 THEN execution_time_ms ELSE coalesce(epoch_ms(ended_at) - epoch_ms(started_at), 0) END AS run_ms FROM {v_job_runs})
SELECT app_id, round(CASE WHEN run_ms <> 0 AND coalesce(executor_cpu_time_ns, 0) <> 0 THEN executor_cpu_time_ns / (run_ms * 1e6) END, 6) AS cpu,
 round(CASE WHEN run_ms <> 0 THEN coalesce(jvm_gc_time_ms, 0) / run_ms END, 6) AS gc,
 round(CASE WHEN coalesce(max_memory_per_executor_bytes, 0) <> 0 AND executor_memory_mb IS NOT NULL THEN max_memory_per_executor_bytes / (executor_memory_mb * 1048576.0) END, 6) AS mem FROM x"""


def _ratios(t):
    run = units.run_time_ms(F.col("execution_time_ms"), units.duration_ms(F.col("started_at"), F.col("ended_at")))
    return t("v_job_runs").withColumn("run_ms", run).select(
        "*",
        units.cpu_utilisation(F.col("executor_cpu_time_ns"), F.col("run_ms")).alias("cpu"),
        units.gc_ratio(F.col("jvm_gc_time_ms"), F.col("run_ms")).alias("gc"),
        units.memory_utilisation(F.col("max_memory_per_executor_bytes"), F.col("executor_memory_mb")).alias("mem"),
    )


@query("f14_cpu_utilisation", f"SELECT app_id, cpu FROM ({_RATIO}) r")
def _(t):
    return _ratios(t).select("app_id", F.round("cpu", 6).alias("cpu"))


@query("f15_gc_ratio", f"SELECT app_id, gc FROM ({_RATIO}) r")
def _(t):
    return _ratios(t).select("app_id", F.round("gc", 6).alias("gc"))


@query("f16_memory_utilisation", f"SELECT app_id, mem, CASE WHEN mem IS NULL THEN 'info' WHEN mem > 0.9 THEN 'critical' WHEN mem > 0.75 THEN 'warning' ELSE 'success' END AS severity FROM ({_RATIO}) r")
def _(t):
    r = _ratios(t).select("app_id", F.round("mem", 6).alias("mem"))
    return r.withColumn("severity", units.memory_severity(F.col("mem")))


@query("f17_percent_change", "SELECT anomaly_id, round(CASE WHEN expected_value = 0 THEN 0 ELSE (actual_value - expected_value) / expected_value * 100 END, 4) AS pct FROM {v_anomalies}")
def _(t):
    return t("v_anomalies").select("anomaly_id", F.round(units.percent_change(F.col("actual_value"), F.col("expected_value")), 4).alias("pct"))


@query("f18_fmt_bytes", """SELECT o_orderkey, CASE WHEN b < 1024 THEN printf('%.1fB', CAST(b AS DOUBLE)) WHEN b < 1048576 THEN printf('%.1fKB', b / 1024) WHEN b < 1073741824 THEN printf('%.1fMB', b / 1048576)
  WHEN b < 1099511627776 THEN printf('%.1fGB', b / 1073741824) ELSE printf('%.1fTB', b / 1099511627776) END AS short,
  CASE WHEN b < 1024 THEN CAST(b AS VARCHAR) || ' B' WHEN b < 1048576 THEN printf('%.2f KB', round(b / 1024, 2)) WHEN b < 1073741824 THEN printf('%.2f MB', round(b / 1048576, 2)) ELSE printf('%.2f GB', round(b / 1073741824, 2)) END AS long
  FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_custkey % 1024 WHEN 1 THEN o_custkey * 1024 WHEN 2 THEN o_custkey * 1048576 WHEN 3 THEN o_custkey * 1073741824 ELSE o_custkey * 1099511627776 END AS b FROM {orders}) x""")
def _(t):
    x = t.sql("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_custkey % 1024 WHEN 1 THEN o_custkey * 1024 WHEN 2 THEN o_custkey * 1048576 WHEN 3 THEN o_custkey * 1073741824 ELSE o_custkey * 1099511627776 END AS b FROM {orders}")
    return x.select("o_orderkey", units.fmt_bytes(F.col("b")).alias("short"), units.fmt_bytes_long(F.col("b")).alias("long"))


@query("f19_duration_ms", "SELECT app_id, CAST(epoch_ms(ended_at) - epoch_ms(started_at) AS BIGINT) AS duration_ms FROM {v_job_runs}")
def _(t):
    return t("v_job_runs").select("app_id", units.duration_ms(F.col("started_at"), F.col("ended_at")).alias("duration_ms"))


@query("f20_split_dataset_name", """SELECT name, CASE WHEN strpos(name, ':') > 1 AND strpos(name, '://') = 0 THEN split_part(name, ':', 1) END AS bucket,
  CASE WHEN strpos(name, ':') > 1 AND strpos(name, '://') = 0 THEN substr(name, strpos(name, ':') + 1) ELSE name END AS display_name FROM {v_datasets}
  UNION ALL SELECT url, NULL, url FROM {pages}""")
def _(t):
    names = t("v_datasets").select("name").unionByName(t("pages").select(F.col("url").alias("name")))
    return names.select("name", naming.split_dataset_name(F.col("name")).alias("x")).select("name", "x.*")


@query("f21_country_of", "SELECT app_id, nullif(regexp_extract(partition_key, 'country=([^,]+)', 1), '') AS country FROM {v_job_runs}")
def _(t):
    return t("v_job_runs").select("app_id", paths.country_of(F.col("partition_key")).alias("country"))


_SUBJ = """SELECT a.anomaly_id, r.rule_id, r.subject_template AS tpl, a.dataset, a.anomaly_type, a.severity FROM {v_anomalies} a JOIN {v_rules} r ON r.rule_id = a.anomaly_id % 25"""


@query("f22_alert_subject", f"""SELECT anomaly_id, CASE WHEN tpl IS NULL THEN '[' || severity || '] Data Anomaly: ' || dataset ELSE severity || ' on ' || dataset || ' (' || anomaly_type || ')' END AS subject FROM ({_SUBJ}) s""")
def _(t):
    s = t.sql(_SUBJ)
    return s.select("anomaly_id", naming.alert_subject(*[F.col(c) for c in ("tpl", "dataset", "anomaly_type", "severity")]).alias("subject"))


@query("f23_display_name", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Freshness SLA Breach' WHEN 1 THEN 'Schema Change' WHEN 2 THEN 'Rowcountspike' ELSE 'My Custom Check' END AS display FROM {events}""")
def _(t):
    x = t.sql("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'freshness_sla_breach' WHEN 1 THEN 'schema_change' WHEN 2 THEN 'RowCountSpike' ELSE 'my_custom_check' END AS k FROM {events}")
    return x.select("event_id", naming.anomaly_display_name(F.col("k")).alias("display"))


@query("f24_normalise_path", r"SELECT path_id, regexp_replace(regexp_replace(regexp_replace(path, '/$', ''), '/\*$', ''), '\*', '', 'g') AS p FROM {v_paths} WHERE path IS NOT NULL")
def _(t):
    return t("v_paths").filter("path IS NOT NULL").select("path_id", paths.normalise_path(F.col("path")).alias("p"))


@query("f26_json_fields", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, value AS wrapped FROM {events}""")
def _(t):
    e = t("events")
    wrapped = schema_text.json_value(schema_text.value_json(F.col("value")))
    return e.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), wrapped.alias("wrapped"))


@query("x9_capped_expression", """SELECT doc_id, CASE WHEN length(text) > 3000 THEN left(text, 2997) || '...' ELSE text END AS expression FROM {documents}""")
def _(t):
    return t("documents").select("doc_id", naming.capped(F.col("text")).alias("expression"))
