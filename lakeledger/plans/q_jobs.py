"""Queries: counters, statistics, job signals."""

from pyspark.sql import functions as F

from lakeledger.operators import jobs as jb
from lakeledger.operators import summaries as su
from lakeledger.plans.registry import query

_AS_OF = "2024-01-31 00:00:00"


@query("a1_metric_stats", f"""SELECT org_id, dataset, count(*) AS data_points, round(avg(row_count), 6) AS mean, round(coalesce(stddev_samp(row_count), 0), 6) AS stddev, min(row_count) AS min, max(row_count) AS max,
  round(quantile_cont(row_count, 0.05), 6) AS p5, round(quantile_cont(row_count, 0.95), 6) AS p95, round(coalesce(avg(byte_size), 0), 3) AS mean_bytes, min(byte_size) AS min_bytes, max(byte_size) AS max_bytes
  FROM {{v_metrics}} WHERE row_count IS NOT NULL AND ts > TIMESTAMP '{_AS_OF}' - INTERVAL 9000 DAY GROUP BY ALL""")
def _(t):
    s = su.metric_stats(t("v_metrics"), _AS_OF, 9000)
    r = {"mean": 6, "stddev": 6, "p5": 6, "p95": 6, "mean_bytes": 3}
    return s.select(*[F.round(c, r[c]).alias(c) if c in r else c for c in s.columns])


@query("a2_anomaly_summary", f"""WITH a AS (SELECT * FROM {{v_anomalies}} WHERE detected_at > TIMESTAMP '{_AS_OF}' - INTERVAL 600 HOUR)
 SELECT org_id, 'total' AS dimension, '' AS value, count(*) AS n FROM a GROUP BY org_id UNION ALL SELECT org_id, 'severity', severity, count(*) FROM a GROUP BY ALL
 UNION ALL SELECT org_id, 'status', status, count(*) FROM a GROUP BY ALL UNION ALL SELECT org_id, 'type', anomaly_type, count(*) FROM a GROUP BY ALL""")
def _(t):
    return su.anomaly_summary(t("v_anomalies"), _AS_OF, 600)


@query("a3_job_summary", "SELECT org_id, count(*) AS total_jobs, count(*) FILTER (status = 'SUCCESS') AS success_count, count(*) FILTER (status = 'FAILED') AS failed_count FROM {v_job_runs} WHERE started_at > TIMESTAMP '2001-01-01 00:00:00' - INTERVAL 40000 HOUR AND partition_key LIKE '%country=N2%' GROUP BY org_id")
def _(t):
    return su.job_summary(t("v_job_runs"), "2001-01-01 00:00:00", 40000, "N2")


@query("a4_job_countries", "SELECT DISTINCT org_id, regexp_extract(partition_key, 'country=([^,]+)', 1) AS country FROM {v_job_runs} WHERE partition_key LIKE '%country=%'")
def _(t):
    return su.job_countries(t("v_job_runs"))


@query("a10_measured", "SELECT 'lineitem' AS dataset, count(*) AS row_count FROM {lineitem} UNION ALL SELECT 'events', count(*) FROM {events}")
def _(t):
    m = su.measured(t("lineitem"), "lineitem").unionByName(su.measured(t("events"), "events"))
    return m.select("dataset", "row_count")


_RUNS = "SELECT app_id, 'out' || CAST(executor_cores AS STRING) AS o1, job_name AS o2, rows_written, bytes_written, status, ended_at FROM {v_job_runs}"


@query("a11_output_metrics", f"WITH r AS ({_RUNS}) SELECT app_id AS job_id, o1 AS dataset, rows_written AS row_count, bytes_written AS byte_size, status FROM r UNION ALL SELECT app_id, o2, rows_written, bytes_written, status FROM r")
def _(t):
    r = t.sql(_RUNS).select(F.col("app_id").alias("job_id"), F.array("o1", "o2").alias("outputs"), "rows_written", "bytes_written", "ended_at", "status")
    return su.output_metrics(r).drop("last_updated")


@query("a14_overview", f"""WITH a AS (SELECT * FROM {{v_anomalies}} WHERE detected_at > TIMESTAMP '{_AS_OF}' - INTERVAL 168 HOUR), h AS (SELECT * FROM {{v_alert_history}} WHERE sent_at > TIMESTAMP '{_AS_OF}' - INTERVAL 168 HOUR)
 SELECT 'datasets' AS counter, count(*) AS n FROM {{v_datasets}} UNION ALL SELECT 'anomalies', count(*) FROM a UNION ALL SELECT 'anomalies:' || severity, count(*) FROM a GROUP BY severity
 UNION ALL SELECT 'alerts', count(*) FROM h UNION ALL SELECT 'alerts:' || status, count(*) FROM h WHERE status IN ('SENT', 'FAILED') GROUP BY status UNION ALL SELECT 'active_rules', count(*) FROM {{v_rules}} WHERE enabled""")
def _(t):
    return su.overview(t("v_datasets"), t("v_anomalies"), t("v_alert_history"), t("v_rules"), _AS_OF)


_B = "CASE WHEN {x} < 1024 THEN CAST({x} AS VARCHAR) || ' B' WHEN {x} < 1048576 THEN printf('%.2f KB', round({x} / 1024, 2)) WHEN {x} < 1073741824 THEN printf('%.2f MB', round({x} / 1048576, 2)) ELSE printf('%.2f GB', round({x} / 1073741824, 2)) END"


def _p(x):
    return f"printf('%.1f', round({x} * 100, 1))"


@query("n8_job_signals", f"""WITH j AS (SELECT *, CASE WHEN coalesce(execution_time_ms, 0) <> 0 THEN execution_time_ms ELSE coalesce(epoch_ms(ended_at) - epoch_ms(started_at), 0) END AS run_ms FROM {{v_job_runs}}),
 k AS (SELECT org_id, app_id, coalesce(disk_bytes_spilled, 0) AS disk, coalesce(memory_bytes_spilled, 0) AS mem, coalesce(failed_tasks, 0) AS failed, coalesce(total_tasks, 0) AS total,
   CASE WHEN run_ms <> 0 THEN coalesce(jvm_gc_time_ms, 0) / run_ms END AS gc, CASE WHEN run_ms <> 0 AND coalesce(executor_cpu_time_ns, 0) <> 0 THEN executor_cpu_time_ns / (run_ms * 1e6) END AS cpu,
   CASE WHEN process_local_tasks + node_local_tasks + rack_local_tasks + any_locality_tasks > 0 THEN any_locality_tasks / (process_local_tasks + node_local_tasks + rack_local_tasks + any_locality_tasks) END AS anyw FROM j)
 SELECT org_id, app_id, 'Disk Spill' AS type, 'critical' AS severity, {_B.replace('{x}', 'disk')} || ' spilled to disk during job execution' AS message FROM k WHERE disk > 0
 UNION ALL SELECT org_id, app_id, 'Memory Spill', 'warning', {_B.replace('{x}', 'mem')} || ' spilled from memory (remained in-memory)' FROM k WHERE mem > 0 AND disk = 0
 UNION ALL SELECT org_id, app_id, 'GC Pressure', CASE WHEN gc > 0.25 THEN 'critical' ELSE 'warning' END, 'GC time is ' || {_p('gc')} || CASE WHEN gc > 0.25 THEN '% of total execution time' ELSE '% of execution time' END FROM k WHERE gc > 0.10
 UNION ALL SELECT org_id, app_id, 'CPU Underutilization', CASE WHEN cpu < 0.25 THEN 'warning' ELSE 'info' END, CASE WHEN cpu < 0.25 THEN 'CPU utilization is only ' ELSE 'CPU utilization is ' END || {_p('cpu')} || '%' FROM k WHERE cpu < 0.50
 UNION ALL SELECT org_id, app_id, CASE WHEN anyw * 100 > 30 THEN 'Poor Task Locality' ELSE 'Task Locality' END, CASE WHEN anyw * 100 > 30 THEN 'critical' ELSE 'warning' END, {_p('anyw')} || CASE WHEN anyw * 100 > 30 THEN '% of tasks had ANY locality (data fetched remotely)' ELSE '% of tasks had ANY locality' END FROM k WHERE anyw * 100 > 10
 UNION ALL SELECT org_id, app_id, 'Task Failures', 'critical', failed || ' out of ' || total || ' tasks failed (' || {_p('CASE WHEN total > 0 THEN failed / total ELSE 0 END')} || '%)' FROM k WHERE failed > 0""")
def _(t):
    return jb.job_signals(t("v_job_runs")).select("org_id", "app_id", "type", "severity", "message")
