"""Queries: profiling, quality rules, freshness, file sources and sinks, sample pipelines."""

from pyspark.sql import functions as F

from lakeledger.operators import anomalies as an
from lakeledger.operators import quality as qu
from lakeledger.operators import schema_diff as sd
from lakeledger.operators import schema_history as sh
from lakeledger.plans import medallion as md
from lakeledger.plans.registry import query
from lakeledger.runtime import scratch
from lakeledger.sources import files as fs

_JCOLS = ["status", "partition_key", "ended_at", "executor_memory_mb", "rows_written", "jvm_gc_time_ms"]


@query("q1_null_counts", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS row_count, count(*) FILTER ({c} IS NULL) AS null_count FROM {{v_job_runs}}" for c in _JCOLS))
def _(t):
    return qu.profile(t("v_job_runs"), _JCOLS).select("column", "row_count", "null_count")


@query("q2_distinct_counts", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_count FROM {{v_job_runs}}" for c in _JCOLS))
def _(t):
    return qu.profile(t("v_job_runs"), _JCOLS).select("column", "distinct_count")


_RULES = [
    {"name": "memory set", "type": "NOT_NULL", "column": "executor_memory_mb"},
    {"name": "rows in range", "type": "RANGE", "column": "rows_written", "min": 10, "max": 200},
    {"name": "key form", "type": "PATTERN", "column": "partition_key", "pattern": "^country="},
    {"name": "ends after start", "type": "CUSTOM", "expression": "ended_at >= started_at"},
    {"name": "one run a minute", "type": "UNIQUE", "column": "started_at"},
]


@query("q3_quality_rules", """WITH j AS (SELECT *, CAST(substr(app_id, 5) AS BIGINT) AS id FROM {v_job_runs}), dup AS (SELECT started_at, min(id) AS f FROM j GROUP BY 1 HAVING count(*) > 1),
 h AS (SELECT id, 'memory set' AS rule FROM j WHERE executor_memory_mb IS NULL UNION ALL SELECT id, 'rows in range' FROM j WHERE rows_written < 10 OR rows_written > 200 UNION ALL SELECT id, 'key form' FROM j WHERE NOT starts_with(partition_key, 'country=')
   UNION ALL SELECT id, 'ends after start' FROM j WHERE NOT (ended_at >= started_at) UNION ALL SELECT id, 'one run a minute' FROM j JOIN dup USING (started_at) WHERE id <> f),
 names AS (SELECT unnest(['memory set', 'rows in range', 'key form', 'ends after start', 'one run a minute']) AS rule)
 SELECT n.rule, count(h.id) AS violation_count, count(h.id) = 0 AS passed, coalesce(array_to_string(list(h.id ORDER BY h.id)[1:3], ','), '') AS sample_violations FROM names n LEFT JOIN h ON h.rule = n.rule GROUP BY n.rule""")
def _(t):
    j = t("v_job_runs").withColumn("id", F.substr("app_id", F.lit(5)).cast("bigint"))
    r = qu.evaluate_rules(j, _RULES, "id")
    return r.withColumn("sample_violations", F.coalesce(F.array_join(F.transform("sample_violations", lambda x: x.cast("string")), ","), F.lit("")))


_SLA = "SELECT DISTINCT org_id, dataset, CAST(6 * length(dataset) AS INT) AS sla_hours FROM {v_metrics} WHERE dataset <> 'view' AND dataset <> 'li_AF'"


@query("q4_freshness", f"""SELECT m.org_id, m.dataset, strftime(max(m.ts), '%Y-%m-%d %H:%M:%S') AS last_updated, coalesce(any_value(s.sla_hours), 24) AS sla_hours, round((epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(max(m.ts))) / 3.6e9, 4) AS age_hours,
  (epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(max(m.ts))) / 3.6e9 > coalesce(any_value(s.sla_hours), 24) AS stale FROM {{v_metrics}} m LEFT JOIN ({_SLA}) s ON s.org_id = m.org_id AND s.dataset = m.dataset GROUP BY m.org_id, m.dataset""")
def _(t):
    f = qu.freshness(t("v_metrics"), t.sql(_SLA), "2024-02-01 00:00:00")
    return f.select("org_id", "dataset", F.date_format("last_updated", "yyyy-MM-dd HH:mm:ss").alias("last_updated"), "sla_hours", F.round("age_hours", 4).alias("age_hours"), "stale")


_PROF = """SELECT 'o1' AS org_id, event_type AS dataset, 'value' AS col, date_trunc('hour', ts) AS ts, CAST(NULL AS STRING) AS job_id, count(*) AS row_count, CAST(sum(CASE WHEN value < 3 OR (day(ts) = 20 AND event_type = 'click') THEN 1 ELSE 0 END) AS BIGINT) AS null_count FROM {events} GROUP BY event_type, date_trunc('hour', ts)"""


@query("q5_null_rate", f"""WITH p AS (SELECT *, CAST(round(null_count * 1000000 / row_count) AS BIGINT) AS ppm FROM ({_PROF}) x),
 s AS (SELECT a.org_id, a.dataset, a.ts, a.ppm, count(*) AS n, avg(b.ppm) AS m, coalesce(stddev_samp(b.ppm), 0) AS sd FROM p a JOIN p b ON b.dataset = a.dataset AND b.ts <= a.ts AND b.ts > a.ts - INTERVAL 30 DAY GROUP BY ALL)
 SELECT org_id, dataset || '.value' AS column_path, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, ppm AS null_ppm, round(m, 3) AS expected_ppm, CAST(n AS BIGINT) AS hist_count, CASE WHEN ppm > m + 3 * sd THEN 'null_rate_spike' ELSE 'completeness_gain' END AS anomaly_type
 FROM s WHERE n >= 5 AND (ppm > m + 3 * sd OR ppm < greatest(0, m - 3 * sd))""")
def _(t):
    p = t.sql(_PROF).withColumnRenamed("col", "column")
    r = an.detect_null_rate(p)
    return r.select("org_id", "column_path", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "null_ppm", F.round("expected_ppm", 3).alias("expected_ppm"), "hist_count", "anomaly_type")


@query("q6_file_stats", "SELECT 1::BIGINT AS file_count, 1::BIGINT AS partition_count, count(*) AS row_count FROM {lineitem}")
def _(t):
    return qu.file_stats(t("lineitem"))


# --- sources and sinks ------------------------------------------------------------------


@query("s1_parquet_scan", "SELECT l_orderkey, l_quantity FROM {lineitem} WHERE l_quantity > 45")
def _(t):
    return fs.read_parquet(t.spark, f"{t.sf_dir}/lineitem.parquet").filter("l_quantity > 45").select("l_orderkey", "l_quantity")


@query("s2_csv_round_trip", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM {orders}")
def _(t):
    path = scratch(t.spark, "csv")
    fs.write_files(t("orders").select("o_orderkey", "o_totalprice", "o_orderpriority"), path, "csv")
    return fs.read_csv(t.spark, path).select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "o_totalprice", "o_orderpriority")


def _as_table(t, name: str):
    """A given table saved in the catalog and read back from it; its entry goes, the plan keeps the files."""
    import uuid

    entry = f"lakeledger_{name}_{uuid.uuid4().hex}"
    fs.write_table(t(name), entry, path=scratch(t.spark, "table"))
    df = fs.read_table(t.spark, entry)
    t.spark.sql(f"DROP TABLE {entry}")
    return df


@query("s3_catalog_scan", "SELECT n_name, count(*) AS customers FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name")
def _(t):
    c, n = _as_table(t, "customer"), _as_table(t, "nation")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("customers"))


@query("s5_table_sink", "SELECT c_mktsegment, count(*) AS n FROM {customer} GROUP BY 1")
def _(t):
    return _as_table(t, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("s6_file_sinks", " UNION ALL ".join(f"SELECT '{f}' AS format, c_mktsegment, count(*) AS n FROM {{customer}} GROUP BY 2" for f in ("parquet", "csv", "json", "orc")))
def _(t):
    out = None
    for f in ("parquet", "csv", "json", "orc"):
        path = scratch(t.spark, f)
        fs.write_files(t("customer"), path, f, partition_by=["c_mktsegment"])
        part = t.spark.read.format(f).option("header", "true").load(path).groupBy("c_mktsegment").agg(F.count("*").alias("n")).select(F.lit(f).alias("format"), "c_mktsegment", "n")
        out = part if out is None else out.unionByName(part)
    return out


# --- sample pipelines -------------------------------------------------------------------

_TRIP = "idx, 'taxi' AS source, idx % 15 + 1 + 0.5 AS mi, (idx % 15 + 1 + 0.5) * 2.5 + 2.5 AS fare, idx % 4 + 1 AS pax, idx % 24 AS h, ((idx % 24 + 1) % 24) * 60 + (idx + 15) % 60 - (idx % 24) * 60 - idx % 60 AS dur"
_RIDE = "idx, 'rideshare' AS source, idx % 12 + 1 + 0.3 AS mi, (idx % 12 + 1 + 0.3) * 2.0 + 3.0 AS fare, idx % 3 + 1 AS pax, idx % 24 AS h, ((idx % 24 + 1) % 24) * 60 + (idx + 40) % 60 - (idx % 24) * 60 - (idx + 30) % 60 AS dur"
_BOR = "['Manhattan', 'Brooklyn', 'Queens', 'Bronx', 'Staten Island'][idx % 5 + 1]"
_ALL = f"tr AS (SELECT {_TRIP}, {_BOR} AS borough FROM {{v_trip_ids}} UNION ALL SELECT {_RIDE}, {_BOR} FROM {{v_trip_ids}})"


def _silver(t):
    ids = t("v_trip_ids")
    return md.all_trips(md.bronze(md.taxi_rows(ids), "taxi"), md.bronze(md.ride_rows(ids), "rideshare"))


def _with_weather(t):
    return md.trip_weather(_silver(t), md.bronze_weather(md.weather_rows(t("v_weather_ids"))))


@query("z1_bronze", f"SELECT 'taxi_' || idx AS trip_id, round(mi, 4)::DOUBLE AS distance_miles, round(fare, 4)::DOUBLE AS fare_amount, source FROM (SELECT {_TRIP} FROM {{v_trip_ids}}) x WHERE fare > 0 AND mi > 0")
def _(t):
    return md.bronze(md.taxi_rows(t("v_trip_ids")), "taxi").select("trip_id", F.round("distance_miles", 4).alias("distance_miles"), F.round("fare_amount", 4).alias("fare_amount"), "source")


@query("p13_positive_filter", "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_discount > 0 AND l_tax > 0")
def _(t):
    raw = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("fare_amount"), F.col("l_tax").alias("distance_miles"))
    return md.bronze(raw, "x").select("l_orderkey", "l_linenumber")


@query("z2_silver", f"WITH {_ALL} SELECT CASE source WHEN 'taxi' THEN 'taxi_' ELSE 'ride_' END || idx AS trip_id, CAST(h AS INTEGER) AS hour_of_day, round(dur, 4)::DOUBLE AS trip_duration_min, round(fare / mi, 6) AS fare_per_mile FROM tr")
def _(t):
    return _silver(t).select("trip_id", "hour_of_day", F.round("trip_duration_min", 4).alias("trip_duration_min"), F.round("fare_per_mile", 6).alias("fare_per_mile"))


@query("u2_all_trips", f"WITH {_ALL} SELECT source, borough, count(*) AS n FROM tr GROUP BY ALL")
def _(t):
    return _silver(t).groupBy("source", "borough").agg(F.count("*").alias("n"))


@query("f25_builtins", f"WITH {_ALL} SELECT borough, CAST(h AS INTEGER) AS hour_of_day, sum(dur)::DOUBLE AS minutes FROM tr GROUP BY ALL")
def _(t):
    return _silver(t).groupBy("borough", "hour_of_day").agg(F.sum("trip_duration_min").alias("minutes"))


@query("j7_trip_weather", f"WITH {_ALL} SELECT CASE source WHEN 'taxi' THEN 'taxi_' ELSE 'ride_' END || tr.idx AS trip_id, (w.idx % 30 + 25)::DOUBLE AS temperature_f, ['Clear', 'Cloudy', 'Rain', 'Snow', 'Fog'][w.idx % 5 + 1] AS condition FROM tr LEFT JOIN {{v_weather_ids}} w ON w.idx = tr.h")
def _(t):
    return _with_weather(t).select("trip_id", "temperature_f", "condition")


@query("z3_gold_borough", f"WITH {_ALL} SELECT borough, count(*) AS trip_count, round(sum(fare), 2)::DOUBLE AS total_revenue, round(avg(fare), 6) AS avg_fare, round(avg(mi), 6) AS avg_distance, round(avg(dur), 6) AS avg_duration_min, CAST(sum(pax) AS BIGINT) AS total_passengers FROM tr GROUP BY borough")
def _(t):
    g = md.gold_borough(_with_weather(t))
    r = {"total_revenue": 2, "avg_fare": 6, "avg_distance": 6, "avg_duration_min": 6}
    return g.select(*[F.round(c, r[c]).alias(c) if c in r else c for c in g.columns])


@query("a12_gold_hourly", f"WITH {_ALL} SELECT CAST(h AS INTEGER) AS hour_of_day, source, count(*) AS trip_count, round(avg(fare), 6) AS avg_fare, round(avg(dur), 6) AS avg_duration FROM tr GROUP BY ALL")
def _(t):
    return md.gold_hourly(_with_weather(t)).select("hour_of_day", "source", "trip_count", F.round("avg_fare", 6).alias("avg_fare"), F.round("avg_duration", 6).alias("avg_duration"))


_RAW = "SELECT o_orderkey AS id, o_orderpriority AS name, o_totalprice AS value, o_orderstatus AS category FROM {orders}"


@query("z4_quick_tables", f"SELECT category, count(*) AS row_count, round(sum(value * 2), 2) AS total_value, round(avg(value * 2), 4) AS avg_value FROM ({_RAW}) r WHERE value > 0 GROUP BY category")
def _(t):
    s = md.quick_pipeline(t.sql(_RAW))[1]
    return s.select("category", "row_count", F.round("total_value", 2).alias("total_value"), F.round("avg_value", 4).alias("avg_value"))


@query("z5_schema_evolution", "SELECT 'demo_customers_' || c_custkey AS dataset, v.n::BIGINT AS version_no, v.ct AS change_type, v.d::BIGINT AS deviation FROM {customer}, (VALUES (2, 'NON_BREAKING', 2), (3, 'BREAKING', 1), (4, 'BREAKING', 1), (5, 'BREAKING', 2)) v(n, ct, d)")
def _(t):
    v = sh.build_schema_versions(md.evolution_snapshots(t("customer").select(F.col("c_custkey").alias("idx"))))
    a = sd.schema_change_anomalies(sd.version_pairs(v), ["org_id", "dataset", "version_no"])
    return a.select("dataset", "version_no", "change_type", F.col("deviation").cast("bigint").alias("deviation"))


@query("z6_spike", "SELECT 'trips_' || c_custkey AS dataset, 'RowCountSpike' AS anomaly_type, 1000.0::DOUBLE AS current_value, 100.0::DOUBLE AS expected_value FROM {customer}")
def _(t):
    d = an.detect_row_count_anomalies(md.spike_metrics(t("customer").select(F.col("c_custkey").alias("idx"))))
    return d.select("dataset", "anomaly_type", "current_value", "expected_value")


_U = "SELECT c_custkey AS user_id, 'mail' || CAST(c_custkey AS STRING) AS email, c_name AS name, c_mktsegment AS country, c_nationkey AS age FROM {customer}"
_P = "SELECT o_orderkey AS purchase_id, o_custkey AS user_id, o_totalprice AS amount, CAST(CAST(o_orderdate AS DATE) AS STRING) AS purchase_date FROM {orders}"


@query("j8_user_purchases", f"SELECT user_id, email, country, purchase_id, amount FROM ({_U}) u JOIN ({_P}) p USING (user_id)")
def _(t):
    return md.user_purchases(t.sql(_U), t.sql(_P)).select("user_id", "email", "country", "purchase_id", "amount")


@query("z7_column_lineage_cases", f"""SELECT 'users_copy' AS tbl, country, count(*) AS n FROM ({_U}) u GROUP BY ALL UNION ALL SELECT 'user_purchases', country, count(*) FROM ({_U}) u JOIN ({_P}) p USING (user_id) GROUP BY ALL
 UNION ALL SELECT 'user_purchases_enhanced', country, count(DISTINCT upper(email)) FROM ({_U}) u JOIN ({_P}) p USING (user_id) GROUP BY ALL UNION ALL SELECT 'country_stats', country, count(*) FROM ({_U}) u JOIN ({_P}) p USING (user_id) GROUP BY ALL""")
def _(t):
    c = md.column_lineage_cases(t.sql(_U), t.sql(_P))
    n = lambda k: c[k].groupBy("country").agg(F.count("*").alias("n")).select(F.lit(k).alias("tbl"), "country", "n")
    e = c["user_purchases_enhanced"].groupBy("country").agg(F.count_distinct("email_upper").alias("n")).select(F.lit("user_purchases_enhanced").alias("tbl"), "country", "n")
    s = c["country_stats"].select(F.lit("country_stats").alias("tbl"), "country", F.col("purchase_count").alias("n"))
    return n("users_copy").unionByName(n("user_purchases")).unionByName(e).unionByName(s)


@query("z8_generated_rows", f"SELECT 'taxi_' || idx AS trip_id, CAST(h AS INTEGER) AS hour, CAST(pax AS INTEGER) AS passenger_count, {_BOR} AS borough FROM (SELECT {_TRIP} FROM {{v_trip_ids}}) x")
def _(t):
    return md.taxi_rows(t("v_trip_ids")).select("trip_id", F.hour("pickup_datetime").alias("hour"), "passenger_count", "borough")
