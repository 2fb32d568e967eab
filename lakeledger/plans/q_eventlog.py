"""Queries over event logs: run metrics and lineage.

The log lines are derived from customers, orders and line items; the checks work on
those tables directly and never see a log line.
"""

from pyspark.sql import functions as F

from lakeledger.operators import plan_lineage as pl
from lakeledger.operators import run_metrics as rm
from lakeledger.plans.registry import query
from lakeledger.runtime import checkpoint
from lakeledger.sources.eventlog import EVENTS, event_tables

_NAME = "'out' || (o_custkey % 50)"
_GENERAL = "'hdfs://nn:8020/out' || (o_custkey % 50) || CASE WHEN o_custkey % 4 = 0 THEN '/country=C' || (o_orderkey % 3) ELSE '' END || '/dt=*'"
_LOGID = "'log-' || o_custkey AS log_id"
# Which orders write into a table, as the log lines have it.
_T = "(o_orderkey % 2 = 0 OR o_orderkey % 6 = 3)"


def _tables(t, *kinds):
    return event_tables(t.staged_log(*kinds))


def _nodes(t, only=None):
    x = _tables(t, "sql_start")
    return pl.plan_nodes(x["plans"], partitions=x.partitions("sql_start"), only=only)


def _written(t):
    """The plan nodes that columns are read off."""
    return checkpoint(_nodes(t, pl.COLUMNS))


def _read_and_written(t):
    """The plan nodes that inputs and outputs are read off."""
    return checkpoint(pl.table_nodes(_nodes(t, pl.SCANS)))


@query("s9_event_counts", """SELECT kind, CAST(n AS BIGINT) AS n FROM (SELECT 'app_start' AS kind, count(*) AS n FROM {customer} UNION ALL SELECT 'app_end', count(*) FROM {customer} UNION ALL SELECT 'environment', count(*) FROM {customer}
 UNION ALL SELECT 'job_start', count(*) FROM {orders} UNION ALL SELECT 'job_end', count(*) FROM {orders} UNION ALL SELECT 'stage', 2 * count(*) FROM {orders} UNION ALL SELECT 'task', count(*) FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
 UNION ALL SELECT 'sql_start', sum(CASE o_orderkey % 6 WHEN 3 THEN 3 WHEN 5 THEN 1 ELSE 2 END) FROM {orders} UNION ALL SELECT 'accums', count(*) FROM {orders} WHERE o_orderkey % 2 = 0 OR o_orderkey % 6 = 3) x""")
def _(t):
    kinds = F.create_map(*[F.lit(x) for k, v in EVENTS.items() for x in (v, k)])
    return t.staged_log().groupBy("event").agg(F.count("*").alias("n")).select(kinds[F.col("event")].alias("kind"), "n")


@query("x1_task_table", """SELECT 'log-' || o_custkey AS log_id, l_orderkey * 2 + l_linenumber % 2 AS stage_id, count(*) AS tasks, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'O') AS failed, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS run_ms
 FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY ALL""")
def _(t):
    return _tables(t)["tasks"].groupBy("log_id", "stage_id").agg(F.count("*").alias("tasks"), F.count_if("failed").alias("failed"), F.sum("execution_time_ms").alias("run_ms"))


@query("x2_plan_nodes", f"""SELECT node_name, CAST(sum(n) AS BIGINT) AS n FROM (SELECT unnest(['Execute CreateDataSourceTableAsSelectCommand', 'CreateDataSourceTableAsSelectCommand', 'LogicalRelation', 'LogicalRelation', 'Join', 'Project', 'Aggregate', 'Scan parquet', 'WriteFiles', 'Execute InsertIntoHadoopFsRelationCommand']) AS node_name, 1 AS n FROM {{orders}} WHERE {_T}
 UNION ALL SELECT 'Scan parquet spark_catalog.default.src' || (o_custkey % 9), 1 FROM {{orders}} WHERE {_T}
 UNION ALL SELECT unnest(['Scan parquet spark_catalog.default.alt' || (o_custkey % 5), 'Scan parquet spark_catalog.default.hist' || (o_custkey % 3), 'Project', 'Project', 'Union', 'Window', 'AppendData']), 1 FROM {{orders}} WHERE o_orderkey % 6 = 1
 UNION ALL SELECT unnest(['Scan parquet', 'WriteFiles', 'Execute InsertIntoHadoopFsRelationCommand']), 1 FROM {{orders}} WHERE o_orderkey % 2 = 1 UNION ALL SELECT 'Scan parquet', 1 FROM {{orders}} WHERE o_orderkey % 2 = 1 AND o_orderkey % 5 = 0) x GROUP BY node_name""")
def _(t):
    return _nodes(t).groupBy("node_name").agg(F.count("*").alias("n"))


_IN = f"""(SELECT {_LOGID}, o_orderkey * 3 AS root_execution_id, o_orderkey * 3 + 1 AS write_id, 'src' || (o_custkey % 9) AS name, 'Table' AS table_type, CAST(NULL AS VARCHAR) AS location FROM {{orders}} WHERE {_T}
 UNION ALL SELECT {_LOGID}, o_orderkey * 3, o_orderkey * 3 + 1, 'lake:ref' || (o_orderkey % 7), 'File', 's3a://lake/ref' || (o_orderkey % 7) || '/dt=*' FROM {{orders}} WHERE {_T}
 UNION ALL SELECT {_LOGID}, o_orderkey * 3, o_orderkey * 3, 'lake:ref' || (o_orderkey % 7), 'File', 's3a://lake/ref' || (o_orderkey % 7) || '/dt=*' FROM {{orders}} WHERE o_orderkey % 2 = 1
 UNION ALL SELECT {_LOGID}, o_orderkey * 3, o_orderkey * 3, 'nn:8020:' || {_NAME}, 'File', {_GENERAL} FROM {{orders}} WHERE o_orderkey % 2 = 1 AND o_orderkey % 5 = 0
 UNION ALL SELECT {_LOGID}, o_orderkey * 3, o_orderkey * 3 + 1, unnest(['alt' || (o_custkey % 5), 'hist' || (o_custkey % 3)]), 'Table', NULL FROM {{orders}} WHERE o_orderkey % 6 = 1)"""
_OUT = f"""(SELECT {_LOGID}, o_orderkey * 3 AS root_execution_id, o_orderkey * 3 + 1 AS write_id, 'tab' || (o_custkey % 50) AS name, 'Table' AS table_type, CAST(NULL AS VARCHAR) AS location FROM {{orders}} WHERE {_T}
 UNION ALL SELECT {_LOGID}, o_orderkey * 3, o_orderkey * 3, 'nn:8020:' || {_NAME}, 'File', {_GENERAL} FROM {{orders}} WHERE o_orderkey % 2 = 1
 UNION ALL SELECT {_LOGID}, o_orderkey * 3, o_orderkey * 3 + 1, 'side' || (o_custkey % 10), 'Table', NULL FROM {{orders}} WHERE o_orderkey % 6 = 1)"""
_EDGE = f"""(SELECT DISTINCT i.log_id, i.root_execution_id, i.name AS source, o.name AS target FROM {_IN} i JOIN {_OUT} o USING (log_id, root_execution_id, write_id) WHERE i.name <> o.name)"""
_COLS = ["log_id", "root_execution_id", "write_id", "name", "table_type", "location"]


@query("x3_query_inputs", f"SELECT * FROM {_IN} x")
def _(t):
    return pl.query_inputs(_nodes(t, pl.SCANS)).select(*_COLS)


@query("u6_distinct_tables", f"SELECT name, table_type, count(*) AS n FROM {_IN} x GROUP BY ALL")
def _(t):
    return pl.query_inputs(_nodes(t, pl.SCANS)).groupBy("name", "table_type").agg(F.count("*").alias("n"))


@query("x4_query_outputs", f"SELECT * FROM {_OUT} x")
def _(t):
    return pl.query_outputs(_nodes(t, pl.NOTHING)).select(*_COLS)


@query("p11_drop_self_reads", f"SELECT i.* FROM {_IN} i WHERE NOT EXISTS (SELECT 1 FROM {_OUT} o WHERE o.log_id = i.log_id AND o.write_id = i.write_id AND o.name = i.name)")
def _(t):
    n = _read_and_written(t)
    return pl.drop_self_reads(pl.query_inputs(n), pl.query_outputs(n)).select(*_COLS)


@query("j4_query_edges", f"SELECT * FROM {_EDGE} x")
def _(t):
    n = _read_and_written(t)
    return pl.query_edges(pl.query_inputs(n), pl.query_outputs(n))


@query("x5_table_edges", f"SELECT source, target, count(*) AS queries FROM {_EDGE} x GROUP BY ALL")
def _(t):
    n = _read_and_written(t)
    return pl.query_edges(pl.query_inputs(n), pl.query_outputs(n)).groupBy("source", "target").agg(F.count("*").alias("queries"))


@query("x6_attribute_origins", f"""SELECT {_LOGID}, o_orderkey * 3 AS root_execution_id, o_orderkey * 3 + e.w AS write_id, e.expr_id::BIGINT AS expr_id,
 CASE e.d WHEN 'src' THEN 'src' || (o_custkey % 9) WHEN 'old' THEN 'nn:8020:' || {_NAME} WHEN 'ref' THEN 'lake:ref' || (o_orderkey % 7) WHEN 'alt' THEN 'alt' || (o_custkey % 5) ELSE 'hist' || (o_custkey % 3) END AS dataset, e.c AS "column"
 FROM {{orders}}, (VALUES (1, 'src', 'id', 'T', 1), (2, 'src', 'price', 'T', 1), (3, 'src', 'status', 'T', 1), (4, 'ref', 'ref', 'T', 1), (5, 'ref', 'id2', 'T', 1), (4, 'ref', 'ref', 'P', 0), (5, 'ref', 'id2', 'P', 0), (9, 'old', 'old', 'O', 0), (21, 'alt', 'k', 'V', 1), (22, 'alt', 'v', 'V', 1), (24, 'hist', 'hk', 'V', 1), (25, 'hist', 'hw', 'V', 1)) e(expr_id, d, c, k, w)
 WHERE CASE e.k WHEN 'T' THEN {_T} WHEN 'P' THEN o_orderkey % 2 = 1 WHEN 'O' THEN o_orderkey % 2 = 1 AND o_orderkey % 5 = 0 ELSE o_orderkey % 6 = 1 END""")
def _(t):
    return pl.attribute_origins(_nodes(t, pl.SCANS)).drop("write_no")


_CE = f"""(SELECT {_LOGID}, o_orderkey * 3 AS root_execution_id, 'src' || (o_custkey % 9) AS source_dataset, e.s AS source_column, 'tab' || (o_custkey % 50) AS target_dataset, e.t AS target_column, e.k AS transform_type, e.x AS expression
  FROM {{orders}}, (VALUES ('id', 'id', 'DIRECT', NULL), ('price', 'total', 'AGGREGATE', 'sum(dbl)'), ('status', 'flag', 'DIRECT', NULL), ('id', 'id', 'JOIN', '(id = id2)')) e(s, t, k, x) WHERE {_T}
 UNION ALL SELECT {_LOGID}, o_orderkey * 3, CASE WHEN e.d = 'alt' THEN 'alt' || (o_custkey % 5) ELSE 'hist' || (o_custkey % 3) END, e.s, 'side' || (o_custkey % 10), e.t, CASE e.t WHEN 'k' THEN 'DIRECT' ELSE 'AGGREGATE' END, CASE e.t WHEN 'run' THEN 'sum(w) windowspecdefinition(k, k ASC NULLS FIRST)' END
  FROM {{orders}}, (VALUES ('alt', 'k', 'k'), ('hist', 'hk', 'k'), ('alt', 'k', 'run'), ('hist', 'hk', 'run'), ('alt', 'v', 'run'), ('hist', 'hw', 'run')) e(d, s, t) WHERE o_orderkey % 6 = 1
 UNION ALL SELECT {_LOGID}, o_orderkey * 3, 'lake:ref' || (o_orderkey % 7), e.s, 'nn:8020:' || {_NAME}, e.s, 'DIRECT', NULL FROM {{orders}}, (VALUES ('ref'), ('id2')) e(s) WHERE o_orderkey % 2 = 1)"""
_CCOLS = ["log_id", "root_execution_id", "source_dataset", "source_column", "target_dataset", "target_column", "transform_type", "expression"]


@query("x7_column_edges", f"SELECT * FROM {_CE} x")
def _(t):
    return pl.column_edges(_nodes(t)).select(*_CCOLS)


@query("x8_implicit_edges", f"SELECT way, source_dataset, source_column, target_dataset, target_column, count(*) AS n FROM {_CE} x, (VALUES ('id'), ('name')) w(way) WHERE target_dataset LIKE 'nn:%' GROUP BY ALL")
def _(t):
    n = _written(t)
    w, o = checkpoint(pl.written_columns(n)), checkpoint(pl.attribute_origins(n))
    tgt = pl.query_outputs(n).filter("table_type = 'File'").select(*pl.WRITE, F.col("name").alias("target_dataset"))
    by_id = w.join(o, [*pl.WRITE, "expr_id"]).select(*pl.WRITE, o["dataset"].alias("source_dataset"), o["column"].alias("source_column"), w["column"].alias("target_column"))
    by_id = checkpoint(by_id.withColumns({"transform_type": F.lit("DIRECT"), "expression": F.lit(None).cast("string")}))
    none = by_id.filter("1 = 0")
    # passed through by expression id; and, where no id is known, by equal name
    i = pl.implicit_column_edges(w, none, by_id, o).withColumn("way", F.lit("id")).unionByName(pl.implicit_column_edges(w, none, none, o).withColumn("way", F.lit("name")))
    return i.join(tgt, pl.WRITE).groupBy("way", "source_dataset", "source_column", "target_dataset", "target_column").agg(F.count("*").alias("n"))


@query("j12_uncovered_columns", f"SELECT {_LOGID}, o_orderkey * 3 AS root_execution_id, e.c AS \"column\" FROM {{orders}}, (VALUES ('total'), ('flag'), ('run')) e(c) WHERE CASE e.c WHEN 'run' THEN o_orderkey % 6 = 1 ELSE {_T} END")
def _(t):
    n = _written(t)
    w, o = checkpoint(pl.written_columns(n)), pl.attribute_origins(n)
    traced = w.join(o, [*pl.WRITE, "expr_id"]).select(*pl.WRITE, w["column"].alias("target_column"))
    return pl.uncovered_columns(w, traced).drop("expr_id", "write_id", "write_no")


@query("x12_query_schemas", f"""SELECT 'read' AS side, 'src' || (o_custkey % 9) AS dataset, 'id:bigint,price:double,status:string' AS fields, count(*) AS n FROM {{orders}} WHERE {_T} GROUP BY ALL
 UNION ALL SELECT 'read', 'lake:ref' || (o_orderkey % 7), 'ref:string,id2:bigint', CAST(sum(CASE WHEN o_orderkey % 6 = 3 THEN 2 ELSE 1 END) AS BIGINT) FROM {{orders}} GROUP BY ALL
 UNION ALL SELECT 'read', 'alt' || (o_custkey % 5), 'k:bigint,v:double', count(*) FROM {{orders}} WHERE o_orderkey % 6 = 1 GROUP BY ALL UNION ALL SELECT 'read', 'hist' || (o_custkey % 3), 'hk:bigint,hw:double', count(*) FROM {{orders}} WHERE o_orderkey % 6 = 1 GROUP BY ALL UNION ALL SELECT 'read', 'nn:8020:' || {_NAME}, 'old:int', count(*) FROM {{orders}} WHERE o_orderkey % 2 = 1 AND o_orderkey % 5 = 0 GROUP BY ALL
 UNION ALL SELECT 'write', 'tab' || (o_custkey % 50), 'id:bigint,total:double,flag:string', count(*) FROM {{orders}} WHERE {_T} GROUP BY ALL UNION ALL SELECT 'write', 'side' || (o_custkey % 10), 'k:bigint,run:double', count(*) FROM {{orders}} WHERE o_orderkey % 6 = 1 GROUP BY ALL UNION ALL SELECT 'write', 'nn:8020:' || {_NAME}, 'ref:string,id2:bigint', count(*) FROM {{orders}} WHERE o_orderkey % 2 = 1 GROUP BY ALL""")
def _(t):
    s = pl.query_schemas(_nodes(t))
    text = F.array_join(F.transform("fields", lambda f: F.concat_ws(":", f["name"], f["type"])), ",")
    return s.groupBy("side", "dataset", text.alias("fields")).agg(F.count("*").alias("n"))


# --- run metrics -----------------------------------------------------------------------

_TASKS = "tk AS (SELECT 'log-' || o_custkey AS log_id, o_custkey, l_orderkey AS job_id, l_orderkey * 2 + l_linenumber % 2 AS stage_id, CASE WHEN l_suppkey % 10 = 0 THEN 'driver' ELSE CAST(l_suppkey % 4 AS VARCHAR) END AS ex, l_returnflag = 'R' AND l_linestatus = 'O' AS bad, CAST(l_quantity AS BIGINT) AS q, l_partkey, l_suppkey, l_linenumber FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey)"
_STG = """st AS (SELECT 'log-' || o_custkey AS log_id, o_orderkey AS job_id, o_orderkey * 2 + s AS stage_id, s = 1 AND o_orderkey % 11 = 0 AS failed, o_custkey AS duration_ms FROM {orders}, (SELECT unnest([0, 1]) AS s) y),
 sm AS (SELECT st.log_id, st.job_id, st.stage_id, any_value(st.failed) AS failed, any_value(duration_ms) AS duration_ms, CAST(sum(q) AS BIGINT) AS run_ms, CAST(sum(l_suppkey) AS BIGINT) AS bytes_written, CAST(sum(l_partkey % 1000) AS BIGINT) AS peak, CAST(sum(l_partkey + 5) AS BIGINT) AS shuffle_read, count(*) FILTER (bad) AS tf
   FROM st LEFT JOIN tk ON tk.log_id = st.log_id AND tk.stage_id = st.stage_id GROUP BY st.log_id, st.job_id, st.stage_id),
 jm AS (SELECT log_id, job_id, CAST(sum(run_ms) AS BIGINT) AS execution_time_ms, CAST(sum(run_ms) AS BIGINT) AS rows_written, CAST(sum(bytes_written) AS BIGINT) AS bytes_written, CAST(sum(shuffle_read) AS BIGINT) AS shuffle_read_bytes, 8::BIGINT AS total_tasks,
   count(*) FILTER (failed) AS failed_stages, max(peak) AS peak_execution_memory FROM sm GROUP BY log_id, job_id)"""


@query("x13_stage_metrics", f"WITH {_TASKS}, {_STG} SELECT log_id, stage_id, duration_ms, run_ms AS execution_time_ms, bytes_written, peak AS peak_execution_memory, shuffle_read AS shuffle_read_bytes, failed FROM sm")
def _(t):
    x = _tables(t)
    s = rm.stage_metrics(x["stages"], x["tasks"])
    return s.select("log_id", "stage_id", "duration_ms", "execution_time_ms", "bytes_written", "peak_execution_memory", "shuffle_read_bytes", F.col("failure_reason").isNotNull().alias("failed"))


_JCOLS = ["execution_time_ms", "rows_written", "bytes_written", "shuffle_read_bytes", "total_tasks", "failed_stages", "peak_execution_memory"]


@query("a6_job_metrics", f"WITH {_TASKS}, {_STG} SELECT log_id, job_id, {', '.join(_JCOLS)} FROM jm")
def _(t):
    x = _tables(t)
    return rm.job_metrics(rm.stage_metrics(x["stages"], x["tasks"]), x["jobs"]).select("log_id", "job_id", *_JCOLS)


_EXEC = """em AS (SELECT log_id, o_custkey, job_id, ex, max(l_partkey % 1000) AS peak FROM tk WHERE NOT bad AND ex <> 'driver' AND l_partkey % 1000 > 0 GROUP BY ALL),
 ej AS (SELECT log_id, job_id, max(peak) AS max_memory_per_executor_bytes, CASE WHEN o_custkey % 5 > 0 THEN max(peak) // (o_custkey % 5) END AS max_memory_per_core_bytes, CAST(sum(peak) // count(*) AS BIGINT) AS avg_memory_per_executor_bytes, count(*) AS executor_count FROM em GROUP BY log_id, o_custkey, job_id)"""


@query("a8_executor_memory", f"WITH {_TASKS}, {_EXEC} SELECT * FROM ej")
def _(t):
    x = _tables(t)
    return rm.executor_memory_stats(x["tasks"], x["jobs"], x["environment"])


_LOCQ = """lc AS (SELECT log_id, job_id, count(*) FILTER (l_linenumber > 3) AS process_local_tasks, count(*) FILTER (l_linenumber = 1) AS node_local_tasks, count(*) FILTER (l_linenumber = 2) AS rack_local_tasks, count(*) FILTER (l_linenumber = 3) AS any_locality_tasks, count(*) AS n FROM tk WHERE NOT bad GROUP BY ALL)"""


@query("a9_task_locality", f"WITH {_TASKS}, {_LOCQ}, p AS (SELECT *, CAST(floor(any_locality_tasks * 100.0 / n) AS INTEGER) AS any_percent FROM lc) SELECT log_id, job_id, process_local_tasks, node_local_tasks, rack_local_tasks, any_locality_tasks, any_percent, CASE WHEN any_percent > 30 THEN 'CRITICAL' WHEN any_percent > 10 THEN 'WARNING' ELSE 'OK' END AS verdict FROM p")
def _(t):
    x = _tables(t)
    return rm.task_locality(x["tasks"], x["jobs"])


_APP = f"""am AS (SELECT jm.log_id, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in _JCOLS[:-1])}, max(peak_execution_memory) AS peak_execution_memory, max(max_memory_per_executor_bytes) AS max_memory_per_executor_bytes,
  max(max_memory_per_core_bytes) AS max_memory_per_core_bytes, max(avg_memory_per_executor_bytes) AS avg_memory_per_executor_bytes, max(executor_count) AS executor_count, CAST(sum(any_locality_tasks) AS BIGINT) AS any_locality_tasks
  FROM jm LEFT JOIN ej USING (log_id, job_id) LEFT JOIN lc USING (log_id, job_id) GROUP BY jm.log_id)"""
_ACOLS = [*_JCOLS, "max_memory_per_executor_bytes", "max_memory_per_core_bytes", "avg_memory_per_executor_bytes", "executor_count", "any_locality_tasks"]


@query("a7_app_metrics", f"WITH {_TASKS}, {_STG}, {_EXEC}, {_LOCQ}, {_APP} SELECT log_id, {', '.join(_ACOLS)} FROM am")
def _(t):
    return rm.app_metrics(rm.full_job_metrics(_tables(t))).select("log_id", *_ACOLS)


_STATUS = "(SELECT 'log-' || o_custkey AS log_id, CASE WHEN bool_or(o_orderkey % 13 = 0) THEN 'Failed' ELSE 'Success' END AS status, count(*) FILTER (o_orderkey % 13 = 0) AS failed_jobs, 'Job ' || min(o_orderkey) FILTER (o_orderkey % 13 = 0) || ': boom ' || min(o_orderkey) FILTER (o_orderkey % 13 = 0) AS error_message FROM {orders} GROUP BY o_custkey)"


@query("a17_app_status", f"SELECT * FROM {_STATUS} x")
def _(t):
    x = _tables(t)
    return rm.app_status(x["jobs"], x["job_ends"])


@query("a17_app_errors", "SELECT 'log-' || o_custkey AS log_id, o_orderkey AS job_id, 'boom ' || o_orderkey AS error FROM {orders} WHERE o_orderkey % 13 = 0")
def _(t):
    return rm.app_errors(_tables(t)["job_ends"])


@query("a16_app_io", f"SELECT DISTINCT log_id, 'input' AS side, name FROM {_IN} i UNION ALL SELECT DISTINCT log_id, 'output', name FROM {_OUT} o")
def _(t):
    n = _read_and_written(t)
    return rm.app_io(pl.query_inputs(n), pl.query_outputs(n))


_PK = "(SELECT 'log-' || o_custkey AS log_id, coalesce(max_by('country=C' || (o_orderkey % 3), o_orderkey) FILTER (o_orderkey % 2 = 1 AND o_custkey % 4 = 0), 'GLOBAL') AS partition_key FROM {orders} GROUP BY o_custkey)"


@query("w7_run_partition_key", f"SELECT * FROM {_PK} x")
def _(t):
    return rm.run_partition_key(pl.query_outputs(_nodes(t, pl.NOTHING)))


@query("x10_job_runs", f"""WITH {_TASKS}, {_STG}, {_EXEC}, {_LOCQ}, {_APP} SELECT 'log-' || c_custkey AS log_id, 'app-' || c_custkey AS app_id, CASE WHEN c_custkey % 3 = 0 AND first_job IS NOT NULL THEN 'nightly ' || (c_custkey % 5) WHEN first_job IS NOT NULL THEN 'app' || (c_custkey % 7) || ' [SQL-' || (first_job * 3) || ']' END AS job_name,
  s.status, coalesce(p.partition_key, 'GLOBAL') AS partition_key, (1 + c_custkey % 8) * 1024 AS executor_memory_mb, {', '.join(_ACOLS)}
  FROM {{customer}} c LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS first_job FROM {{orders}} GROUP BY 1) f ON f.o_custkey = c.c_custkey LEFT JOIN am ON am.log_id = 'log-' || c_custkey LEFT JOIN {_STATUS} s ON s.log_id = 'log-' || c_custkey LEFT JOIN {_PK} p ON p.log_id = 'log-' || c_custkey""")
def _(t):
    x = _tables(t)
    return rm.job_runs(x, pl.query_outputs(pl.write_nodes(_nodes(t, pl.NOTHING)))).select("log_id", "app_id", "job_name", "status", "partition_key", F.col("executor_memory_mb").cast("bigint").alias("executor_memory_mb"), *_ACOLS)


@query("x11_run_output_metrics", f"""WITH {_TASKS}, {_STG}, r AS (SELECT log_id, CAST(sum(rows_written) AS BIGINT) AS row_count, CAST(sum(bytes_written) AS BIGINT) AS byte_size FROM jm GROUP BY log_id),
 own AS (SELECT 'log-' || o_custkey AS log_id, 'tab' || (o_custkey % 50) AS name, CAST(sum(o_orderkey % 1000) AS BIGINT) AS row_count, CAST(sum(o_custkey * 7) AS BIGINT) AS byte_size FROM {{orders}} WHERE {_T} GROUP BY ALL)
 SELECT DISTINCT o.name AS dataset, coalesce(w.row_count, r.row_count) AS row_count, coalesce(w.byte_size, r.byte_size) AS byte_size, replace(o.log_id, 'log-', 'app-') AS app_id, s.status
 FROM {_OUT} o JOIN r USING (log_id) JOIN {_STATUS} s USING (log_id) LEFT JOIN own w USING (log_id, name)""")
def _(t):
    x = _tables(t)
    n = checkpoint(pl.write_nodes(pl.plan_nodes(x["plans"], partitions=x.partitions("sql_start"), only=pl.NOTHING)))
    o = checkpoint(pl.query_outputs(n))
    return rm.run_output_metrics(rm.job_runs(x, o), o, rm.write_metrics(x, n)).drop("last_updated")
