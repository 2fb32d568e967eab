"""Fact views derived from the given tables, in SQL that Spark and DuckDB both read.

``{name}`` refers to a given table or to another view here. Each view has one row
per row (or per small group) of the table it comes from, so it grows with it.
"""

VIEWS: dict[str, str] = {}

# --- load metrics -----------------------------------------------------------------
VIEWS["v_metrics_hourly"] = """
SELECT 'o1' AS org_id, dataset, ts,
       CASE WHEN h % 40 = 7 THEN NULL ELSE dataset || '-' || CAST(h AS STRING) END AS job_id,
       'load_' || dataset AS job_name,
       CASE dataset WHEN 'click' THEN NULL WHEN 'view' THEN 'UNKNOWN' ELSE 'type=' || dataset END AS partition_key,
       row_count, byte_size
FROM (SELECT event_type AS dataset, date_trunc('hour', ts) AS ts, CAST(day(ts) * 24 + hour(ts) AS BIGINT) AS h,
             count(*) AS row_count, CAST(sum(length(props)) AS BIGINT) AS byte_size
      FROM {events} GROUP BY event_type, date_trunc('hour', ts), day(ts) * 24 + hour(ts)) e
"""
VIEWS["v_metrics_daily"] = """
SELECT 'o2' AS org_id, 'li_' || l_returnflag || l_linestatus AS dataset, CAST(l_shipdate AS TIMESTAMP) AS ts,
       l_returnflag || l_linestatus || '-' ||
         CAST(year(l_shipdate) * 10000 + month(l_shipdate) * 100 + CAST(floor(day(l_shipdate) / 8) AS INT) AS STRING) AS job_id,
       CASE WHEN l_returnflag = 'N' THEN NULL ELSE 'ship' END AS job_name,
       CASE WHEN l_returnflag = 'R' THEN 'flag=R' WHEN l_returnflag = 'A' THEN '' ELSE NULL END AS partition_key,
       count(*) AS row_count,
       CASE WHEN l_linestatus = 'O' AND day(l_shipdate) % 5 = 0 THEN NULL ELSE CAST(sum(floor(l_extendedprice)) AS BIGINT) END AS byte_size
FROM {lineitem} GROUP BY l_returnflag, l_linestatus, l_shipdate
"""
VIEWS["v_metrics"] = "SELECT * FROM {v_metrics_hourly} UNION ALL SELECT * FROM {v_metrics_daily}"

# --- datasets and lineage ---------------------------------------------------------
VIEWS["v_datasets"] = """
SELECT 'o1' AS org_id, name,
       CASE k % 4 WHEN 0 THEN 's3' WHEN 1 THEN 'table' WHEN 2 THEN 'view' ELSE 'iceberg' END AS dataset_type,
       CASE WHEN k % 4 = 0 THEN 's3://lake/' || replace(name, ':', '/') ELSE NULL END AS location,
       TIMESTAMP '2024-01-01 00:00:00' + (INTERVAL 1 MINUTE) * (k % 1000) AS created_at,
       TIMESTAMP '2024-01-02 00:00:00' + (INTERVAL 1 MINUTE) * (k % 40000) AS updated_at
FROM (SELECT 'region:' || CAST(r_regionkey AS STRING) AS name, CAST(r_regionkey AS BIGINT) AS k FROM {region}
      UNION ALL SELECT 'nation:' || CAST(n_nationkey AS STRING), CAST(n_nationkey AS BIGINT) FROM {nation}
      UNION ALL SELECT 'customer:' || CAST(c_custkey AS STRING), c_custkey FROM {customer}
      UNION ALL SELECT 'supplier:' || CAST(s_suppkey AS STRING), s_suppkey FROM {supplier}
      UNION ALL SELECT 'part:' || CAST(p_partkey AS STRING), p_partkey FROM {part}
      UNION ALL SELECT DISTINCT event_type, CAST(length(event_type) AS BIGINT) FROM {events}) d
"""
VIEWS["v_edges"] = """
SELECT org_id, source, target, 'job-' || kind AS job_id, 'build_' || kind AS job_name
FROM (SELECT 'o1' AS org_id, 'region:' || CAST(n_regionkey AS STRING) AS source, 'nation:' || CAST(n_nationkey AS STRING) AS target, 'nation' AS kind FROM {nation}
      UNION ALL SELECT 'o1', 'nation:' || CAST(c_nationkey AS STRING), 'customer:' || CAST(c_custkey AS STRING), 'customer' FROM {customer}
      UNION ALL SELECT 'o1', 'nation:' || CAST(s_nationkey AS STRING), 'supplier:' || CAST(s_suppkey AS STRING), 'supplier' FROM {supplier}
      UNION ALL SELECT 'o1', 'customer:' || CAST(o_custkey AS STRING), 'order:' || CAST(o_orderkey AS STRING), 'order' FROM {orders}
      UNION ALL SELECT DISTINCT 'o1', 'order:' || CAST(l_orderkey AS STRING), 'part:' || CAST(l_partkey AS STRING), 'line' FROM {lineitem}
      UNION ALL SELECT DISTINCT 'o1', 'supplier:' || CAST(l_suppkey AS STRING), 'part:' || CAST(l_partkey AS STRING), 'supply' FROM {lineitem}
      UNION ALL SELECT 'o2', 'nation:' || CAST(c_nationkey AS STRING), 'customer:' || CAST(c_custkey AS STRING), 'customer' FROM {customer}
      UNION ALL SELECT 'o2', 'customer:' || CAST(c_custkey AS STRING), 'nation:' || CAST(c_nationkey AS STRING), 'back' FROM {customer}
      UNION ALL SELECT DISTINCT 'o' || CAST(1 + user_id % 2 AS STRING), event_type, 'customer:' || CAST(user_id AS STRING), 'event' FROM {events}) e
"""
VIEWS["v_column_changes"] = """
SELECT 'o' || CAST(1 + user_id % 2 AS STRING) AS org_id,
       'd' || CAST(user_id AS STRING) AS source_dataset, 'c' || CAST(event_id % 5 AS STRING) AS source_column,
       'd' || CAST(CASE WHEN event_id % 50 = 0 AND user_id > 6 THEN user_id - 6 ELSE user_id + 2 + 2 * (event_id % 2) END AS STRING) AS target_dataset,
       'c' || CAST(event_id * 3 % 5 AS STRING) AS target_column,
       CASE event_type WHEN 'click' THEN 'DIRECT' WHEN 'view' THEN 'EXPRESSION' WHEN 'error' THEN 'CASE' WHEN 'signup' THEN 'JOIN' ELSE 'AGGREGATE' END AS transform_type,
       CASE event_type WHEN 'click' THEN NULL ELSE event_type || '(c' || CAST(event_id % 5 AS STRING) || ')' END AS expression,
       event_id AS seq
FROM {events}
"""
VIEWS["v_column_edges"] = """
SELECT org_id, source_dataset, source_column, target_dataset, target_column,
       max_by(transform_type, seq) AS transform_type,
       nullif(max_by(coalesce(expression, ''), seq), '') AS expression
FROM {v_column_changes} GROUP BY org_id, source_dataset, source_column, target_dataset, target_column
"""

# --- anomalies, alerts ------------------------------------------------------------
VIEWS["v_anomalies"] = """
SELECT event_id AS anomaly_id, 'o' || CAST(1 + user_id % 2 AS STRING) AS org_id, event_type AS dataset,
       CASE event_id % 5 WHEN 0 THEN 'RowCountSpike' WHEN 1 THEN 'RowCountDrop' WHEN 2 THEN 'VolumeSpike' WHEN 3 THEN 'VolumeDrop' ELSE 'SchemaChange' END AS anomaly_type,
       CASE WHEN value > 60 THEN 'CRITICAL' WHEN value > 20 THEN 'WARNING' ELSE 'INFO' END AS severity,
       CASE user_id % 4 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'ACKNOWLEDGED' WHEN 2 THEN 'RESOLVED' ELSE 'OPEN' END AS status,
       CAST(ts AS TIMESTAMP) AS detected_at, value AS actual_value,
       CASE WHEN event_id % 9 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(user_id AS DOUBLE) END AS expected_value,
       'job-' || CAST(user_id AS STRING) AS job_id
FROM {events}
"""
VIEWS["v_rules"] = """
SELECT n_nationkey AS rule_id, 'rule ' || n_name AS rule_name,
       CASE n_nationkey % 3 WHEN 0 THEN 'o1' WHEN 1 THEN 'o2' ELSE NULL END AS org_id,
       CASE n_nationkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '*' WHEN 2 THEN 'cl*' WHEN 3 THEN 'view' WHEN 4 THEN 'p*' ELSE 'zz*' END AS dataset_pattern,
       CASE n_nationkey % 4 WHEN 1 THEN 'RowCountSpike' WHEN 2 THEN 'SchemaChange' ELSE NULL END AS anomaly_type,
       CASE n_nationkey % 5 WHEN 1 THEN 'CRITICAL' WHEN 3 THEN 'WARNING' ELSE NULL END AS severity,
       n_nationkey % 7 <> 3 AS enabled,
       CASE n_nationkey % 2 WHEN 0 THEN 'email' ELSE 'slack' END AS channel_type,
       CASE n_nationkey % 4 WHEN 0 THEN NULL ELSE chr(123) || 'severity' || chr(125) || ' on ' || chr(123) || 'dataset_name' || chr(125) || ' (' || chr(123) || 'anomaly_type' || chr(125) || ')' END AS subject_template,
       CASE n_nationkey % 3 WHEN 0 THEN 30 ELSE 60 END AS deduplication_minutes
FROM {nation}
"""
VIEWS["v_rule_book"] = """
SELECT s_suppkey AS rule_id, 'rule ' || s_name AS rule_name,
       CASE s_suppkey % 3 WHEN 0 THEN 'o1' WHEN 1 THEN 'o2' ELSE NULL END AS org_id,
       CASE s_nationkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'cl*' WHEN 2 THEN 'view' ELSE '*' END AS dataset_pattern,
       CASE s_suppkey % 2 WHEN 0 THEN 'WARNING' ELSE NULL END AS severity, s_suppkey % 7 <> 3 AS enabled
FROM {supplier}
"""
VIEWS["v_rule_changes"] = """
SELECT s_suppkey AS rule_id, CASE WHEN s_suppkey % 5 = 0 THEN 'delete' ELSE 'upsert' END AS op, s_suppkey * 10 + 1 AS seq,
       CASE WHEN s_suppkey % 3 = 0 THEN 'renamed ' || CAST(s_suppkey AS STRING) ELSE NULL END AS rule_name, CAST(NULL AS STRING) AS org_id,
       CASE WHEN s_suppkey % 2 = 0 THEN 'new*' ELSE NULL END AS dataset_pattern, CAST(NULL AS STRING) AS severity, CASE WHEN s_suppkey % 4 = 0 THEN s_acctbal > 0 ELSE NULL END AS enabled
FROM {supplier} WHERE s_acctbal > 1000
UNION ALL SELECT s_suppkey + 1000000, 'upsert', 7, 'added ' || s_name, 'o1', '*', 'CRITICAL', s_nationkey > 3 FROM {supplier} WHERE s_acctbal < 500
"""
VIEWS["v_alert_history"] = """
SELECT event_id AS alert_id, CAST(event_id % 25 AS INT) AS rule_id, event_id AS anomaly_id,
       CASE user_id % 5 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'DEDUPLICATED' ELSE 'SENT' END AS status,
       CAST(ts AS TIMESTAMP) AS sent_at, event_type AS dataset
FROM {events}
"""

# --- job runs ---------------------------------------------------------------------
VIEWS["v_job_runs"] = """
SELECT 'o' || CAST(1 + r.o_custkey % 2 AS STRING) AS org_id, 'app-' || CAST(r.o_orderkey AS STRING) AS app_id,
       r.o_orderpriority AS job_name,
       CASE WHEN c.c_nationkey = 24 THEN 'GLOBAL' WHEN c.c_nationkey = 23 THEN 'region=r1,zone=z2' ELSE 'country=N' || CAST(c.c_nationkey AS STRING) || ',region=r' || CAST(c.c_nationkey % 5 AS STRING) END AS partition_key,
       CASE r.o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'SUCCESS' ELSE 'RUNNING' END AS status,
       CAST(r.o_orderdate AS TIMESTAMP) + (INTERVAL 1 MINUTE) * (r.o_orderkey % 1440) AS started_at,
       CASE WHEN r.o_orderstatus = 'P' THEN NULL ELSE CAST(r.o_orderdate AS TIMESTAMP) + (INTERVAL 1 MINUTE) * (r.o_orderkey % 1440) + (INTERVAL 1 SECOND) * CAST(floor(r.o_totalprice / 1000) AS BIGINT) END AS ended_at,
       CASE WHEN r.o_custkey % 9 = 0 THEN NULL ELSE 512 * (1 + r.o_custkey % 4) END AS executor_memory_mb,
       CAST(1 + r.o_custkey % 4 AS INT) AS executor_cores,
       l.qty AS rows_written, l.price AS bytes_written,
       l.qty * 100 AS execution_time_ms, l.n AS total_tasks,
       CASE WHEN r.o_orderkey % 11 = 0 THEN 1 + r.o_orderkey % 3 ELSE 0 END AS failed_tasks,
       CASE WHEN r.o_orderkey % 13 = 0 THEN 0 ELSE l.qty * 1000000 * (r.o_orderkey % 101) END AS executor_cpu_time_ns,
       l.qty * (r.o_custkey % 40) AS jvm_gc_time_ms,
       CASE WHEN r.o_orderkey % 5 = 0 THEN l.price ELSE 0 END AS memory_bytes_spilled,
       CASE WHEN r.o_orderkey % 7 = 0 THEN l.price * 3 ELSE 0 END AS disk_bytes_spilled,
       l.price * 4000 AS max_memory_per_executor_bytes,
       l.n1 AS process_local_tasks, l.n2 AS node_local_tasks, l.n3 AS rack_local_tasks, l.n4 AS any_locality_tasks
FROM {orders} r JOIN {customer} c ON r.o_custkey = c.c_custkey
LEFT JOIN (SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS qty, CAST(sum(floor(l_extendedprice)) AS BIGINT) AS price, count(*) AS n,
                  CAST(sum(CASE WHEN l_linenumber < 4 THEN 1 ELSE 0 END) AS BIGINT) AS n1, CAST(sum(CASE WHEN l_linenumber = 4 THEN 1 ELSE 0 END) AS BIGINT) AS n2,
                  CAST(sum(CASE WHEN l_linenumber = 5 THEN 1 ELSE 0 END) AS BIGINT) AS n3, CAST(sum(CASE WHEN l_linenumber > 5 THEN 1 ELSE 0 END) AS BIGINT) AS n4
           FROM {lineitem} GROUP BY l_orderkey) l ON r.o_orderkey = l.l_orderkey
"""

# --- schema snapshots, one row per field ------------------------------------------
VIEWS["v_snapshot_fields"] = """
SELECT 'o1' AS org_id, 'u' || CAST(user_id AS STRING) AS dataset, day AS captured_at, event_type AS name,
       CASE WHEN max(value) > 60 THEN 'bigint' WHEN max(value) > 45 THEN 'string' ELSE 'int' END AS type,
       max(value) < 40 AS nullable,
       CAST(row_number() OVER (PARTITION BY user_id, day
            ORDER BY CASE WHEN day(day) % 7 = 0 THEN -length(event_type) ELSE 0 END, event_type) - 1 AS INT) AS pos
FROM (SELECT user_id, date_trunc('day', ts) AS day, event_type, value FROM {events}) e
GROUP BY user_id, day, event_type
"""

# --- messages ---------------------------------------------------------------------
VIEWS["v_payload_json"] = """
SELECT 'o' || CAST(1 + o_custkey % 2 AS STRING) AS org_id, CAST(o_orderdate AS TIMESTAMP) + (INTERVAL 1 SECOND) * (o_orderkey % 86400) AS received_at,
  CASE WHEN o_orderkey % 97 = 5 THEN chr(123) || '"job_id": "broken-' || CAST(o_orderkey AS STRING) ELSE
  chr(123) || '"api_version": "1.0", "job_id": "run-' || CAST(o_orderkey AS STRING) || '", "job_name": ' ||
  CASE WHEN o_orderkey % 10 = 3 THEN 'null' ELSE '"' || o_orderpriority || '"' END ||
  ', "application_id": "app-' || CAST(o_custkey AS STRING) || '", "status": "' || CASE o_orderstatus WHEN 'F' THEN 'Failed' ELSE 'Success' END || '"' ||
  ', "started_at": "' || CAST(CAST(o_orderdate AS DATE) AS STRING) || 'T01:02:03Z", "ended_at": "' || CAST(CAST(o_orderdate AS DATE) AS STRING) || 'T02:02:03Z"' ||
  ', "inputs": [' || chr(123) || '"name": "customer:' || CAST(o_custkey AS STRING) || '", "type": "TABLE"' || chr(125) || ', ' ||
     chr(123) || '"name": "lake:ref' || CAST(o_orderkey % 7 AS STRING) || '", "type": "FILE", "location": "s3a://lake/ref' || CAST(o_orderkey % 7 AS STRING) || '/date=2024-01-0' || CAST(1 + o_orderkey % 9 AS STRING) || '"' || chr(125) || ']' ||
  ', "outputs": [' || chr(123) || '"name": "out' || CAST(o_custkey % 50 AS STRING) || '", "type": "FILE", "location": "hdfs://nn:8020/out' || CAST(o_custkey % 50 AS STRING) || CASE WHEN o_orderkey % 2 = 0 THEN '/country=C' || CAST(o_custkey % 3 AS STRING) ELSE '' END || '/dt=20240101"' || chr(125) || ']' ||
  ', "lineage_edges": [' || chr(123) || '"source": "customer:' || CAST(o_custkey AS STRING) || '", "target": "out' || CAST(o_custkey % 50 AS STRING) || '"' || chr(125) || ', ' ||
     chr(123) || '"source": "lake:ref' || CAST(o_orderkey % 7 AS STRING) || '", "target": "out' || CAST(o_custkey % 50 AS STRING) || '"' || chr(125) || ', ' ||
     chr(123) || '"source": "nobody", "target": "out' || CAST(o_custkey % 50 AS STRING) || '"' || chr(125) || ']' ||
  ', "column_lineage": [' || chr(123) || '"source_table": "customer:' || CAST(o_custkey AS STRING) || '", "source_column": "c' || CAST(o_orderkey % 3 AS STRING) || '", "target_table": "out' || CAST(o_custkey % 50 AS STRING) || '", "target_column": "t' || CAST(o_orderkey % 2 AS STRING) || '", "transformation_type": "' || CASE WHEN o_orderkey % 2 = 0 THEN 'DIRECT' ELSE 'EXPRESSION' END || '", "expression": "e' || CAST(o_orderkey % 4 AS STRING) || '"' || chr(125) || ']' ||
  ', "metrics": ' || chr(123) || '"out' || CAST(o_custkey % 50 AS STRING) || '": ' || chr(123) || '"row_count": ' || CAST(CAST(floor(o_totalprice / 100) AS BIGINT) AS STRING) || ', "byte_size": ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || chr(125) || chr(125) ||
  ', "anomalies": [' || CASE WHEN o_orderkey % 8 = 0 THEN chr(123) || '"dataset_name": "out' || CAST(o_custkey % 50 AS STRING) || '", "anomaly_type": "RowCountSpike", "severity": "WARNING", "current_value": 5.5, "expected_value": 2.5, "threshold": 3.0, "message": "m' || CAST(o_orderkey AS STRING) || '"' || chr(125) ELSE '' END || ']' ||
  CASE WHEN o_orderkey % 4 = 1 THEN '' ELSE ', "execution_metrics": ' || chr(123) || '"rows_written": ' || CAST(o_orderkey AS STRING) || ', "execution_time_ms": 1000, "total_tasks": 4' || chr(125) || ', "executor_memory_mb": 1024, "executor_cores": 2' END ||
  CASE WHEN o_orderkey % 6 = 0 THEN ', "partition_key": "region=r' || CAST(o_custkey % 4 AS STRING) || '"' ELSE ', "partition_key": "GLOBAL"' END || chr(125) END AS value
FROM {orders}
"""
VIEWS["v_schema_payload_json"] = """
SELECT 'o1' AS org_id, CAST(o_orderdate AS TIMESTAMP) + (INTERVAL 1 SECOND) * (o_orderkey % 86400) AS received_at,
  chr(123) || '"job_id": "run-' || CAST(o_orderkey AS STRING) || '", "schemas": [' || chr(123) || '"dataset_name": "cust' || CAST(o_custkey % 200 AS STRING) || '", "version_hash": "h' || CAST(o_orderkey % 3 AS STRING) || '", "fields": [' ||
  chr(123) || '"name": "id", "data_type": "' || CASE WHEN o_orderkey % 3 = 0 THEN 'int' ELSE 'bigint' END || '", "nullable": true' || chr(125) ||
  CASE WHEN o_orderkey % 3 = 2 THEN ', ' || chr(123) || '"name": "email", "data_type": "string", "nullable": false' || chr(125) ELSE '' END || ']' || chr(125) || ']' || chr(125) AS value
FROM {orders}
"""

# --- paths ------------------------------------------------------------------------
VIEWS["v_paths"] = """
SELECT o_orderkey AS path_id,
  CASE o_orderkey % 16
    WHEN 0 THEN 's3://bucket' || CAST(o_custkey % 5 AS STRING) || '/sales/date=' || CAST(CAST(o_orderdate AS DATE) AS STRING) || '/country=US/f.parquet'
    WHEN 1 THEN '/data/' || CAST(year(o_orderdate) AS STRING) || '/' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '/' || lpad(CAST(day(o_orderdate) AS STRING), 2, '0') || '/x'
    WHEN 2 THEN 's3a://b/featuremart/brand/202601'
    WHEN 3 THEN 's3://b/featuremart/output_v2/20251003-20251231'
    WHEN 4 THEN 'hdfs://nn:8020/sales/year=2024/month=01/'
    WHEN 5 THEN 'file:///data/local/output' || CAST(o_custkey AS STRING)
    WHEN 6 THEN '/data/US/agg' || CAST(o_custkey % 100 AS STRING) || '.csv'
    WHEN 7 THEN ''
    WHEN 8 THEN 'gs://lake/prod/us-east-1/events/dt=20240101/Region=eu/zone=*/part.json'
    WHEN 9 THEN '/a/20240101/20240102/b/10:20:30/_temporary/0/_attempt_12'
    WHEN 10 THEN 'abfss://c@acct.dfs.core.windows.net/t' || CAST(o_custkey % 9 AS STRING) || '/market=de/hour=03'
    WHEN 11 THEN 'dbfs:/mnt/raw/t' || CAST(o_custkey % 9 AS STRING)
    WHEN 12 THEN 'sales_table_' || CAST(o_custkey % 9 AS STRING)
    WHEN 13 THEN 's3://b2/2024/03/US/'
    WHEN 14 THEN 'file:/tmp/wh/delta_' || CAST(o_custkey % 9 AS STRING) || '/2024/10/x.avro'
    ELSE NULL END AS path,
  CASE o_orderkey % 5 WHEN 0 THEN 'TABLE' WHEN 1 THEN 'FILE' WHEN 2 THEN NULL WHEN 3 THEN 'View' ELSE 'Stream' END AS declared
FROM {orders}
"""

# --- raw trips and weather --------------------------------------------------------
VIEWS["v_trip_ids"] = "SELECT o_orderkey AS idx FROM {orders}"
VIEWS["v_weather_ids"] = "SELECT DISTINCT CAST(hour(ts) AS BIGINT) AS idx FROM {events}"

# --- event log lines: one application per customer, one job and one write per order ------
# In the texts below « » stand for braces and ~ for a newline inside JSON; the columns they hold are numbers.
def _J(body: str) -> str:
    """A text with its marks written out once, as SQL spells them; only Spark reads these views."""
    return body.replace("«", "{{").replace("»", "}}").replace("~", r"\\n")


_LOG = "'log-' || CAST(o_custkey AS STRING)"
_KEY = "CAST(o_orderkey AS STRING)"
_T0 = "CAST(1700000000000 + o_orderkey * 1000 AS STRING)"
_SRC = "'src' || CAST(o_custkey % 9 AS STRING)"
_REF = "'s3a://lake/ref' || CAST(o_orderkey % 7 AS STRING) || '/dt=20240101'"
_DST = "'hdfs://nn:8020/out' || CAST(o_custkey % 50 AS STRING) || CASE WHEN o_custkey % 4 = 0 THEN '/country=C' || CAST(o_orderkey % 3 AS STRING) ELSE '' END || '/dt=20240101'"
_LOGICAL = (
    "'== Physical Plan ==~Execute CreateDataSourceTableAsSelectCommand (1)~~~(1) Execute CreateDataSourceTableAsSelectCommand~Output: []~~(2) CreateDataSourceTableAsSelectCommand~Arguments: `spark_catalog`.`default`.`tab' || CAST(o_custkey % 50 AS STRING)"
    " || '`, Overwrite, [id, total, flag]~~(3) LogicalRelation~Arguments: parquet, [id#1L, price#2, status#3], `spark_catalog`.`default`.`' || " + _SRC + " || '`, false~~(4) LogicalRelation~Arguments: parquet, [ref#4, id2#5L], false"
    "~~(5) Join~Arguments: Inner, (id#1L = id2#5L)~~(6) Project~Arguments: [id#1L, (price#2 * cast(2 as double)) AS dbl#6, status#3, ref#4]~~(7) Aggregate~Arguments: [id#1L, status#3], [id#1L, sum(dbl#6) AS total#7, status#3 AS flag#8]~'"
)
_PHYS_TABLE = (
    "'== Physical Plan ==~Execute InsertIntoHadoopFsRelationCommand (4)~~~(1) Scan parquet spark_catalog.default.' || " + _SRC + " || '~Output [3]: [id#1L, price#2, status#3]~Batched: true~Location: InMemoryFileIndex [file:/wh/' || " + _SRC
    + " || ']~ReadSchema: struct<id:bigint,price:double,status:string>~~(2) Scan parquet ~Output [2]: [ref#4, id2#5L]~Batched: true~Location: InMemoryFileIndex [' || " + _REF
    + " || ']~ReadSchema: struct<ref:string,id2:bigint>~~(3) WriteFiles~Input [3]: [id#1L, total#7, flag#8]~~(4) Execute InsertIntoHadoopFsRelationCommand~Input: []~Arguments: file:/wh/tab, false, Parquet, [path=file:/wh/tab], Overwrite, [id, total, flag]~'"
)
_PHYS_FILE = (
    "'== Physical Plan ==~Execute InsertIntoHadoopFsRelationCommand (4)~~~(1) Scan parquet ~Output [2]: [ref#4, id2#5L]~Batched: true~Location: InMemoryFileIndex [' || " + _REF
    + " || ']~ReadSchema: struct<ref:string,id2:bigint>~~' || CASE WHEN o_orderkey % 5 = 0 THEN '(2) Scan parquet ~Output [1]: [old#9]~Location: InMemoryFileIndex [' || " + _DST
    + " || ']~ReadSchema: struct<old:int>~~' ELSE '' END || '(3) WriteFiles~Input [2]: [ref#4, id2#5L]~~(4) Execute InsertIntoHadoopFsRelationCommand~Input: []~Arguments: ' || " + _DST + " || ', false, Parquet, [path=' || " + _DST + " || '], Overwrite, [ref, id2]~'"
)
# A write into another catalog, over a union and a window.
_V2 = (
    "'== Physical Plan ==~AppendData (7)~+- * Project (6)~   +- Window (5)~      +- Union (4)~         :- * Project (2)~         :  +- Scan parquet spark_catalog.default.alt (1)~         +- Scan parquet spark_catalog.default.hist (3)"
    "~~~(1) Scan parquet spark_catalog.default.alt' || CAST(o_custkey % 5 AS STRING) || '~Output [2]: [k#21L, v#22]~Batched: true~Location: InMemoryFileIndex [file:/wh/alt]~ReadSchema: struct<k:bigint,v:double>"
    "~~(2) Project [codegen id : 1]~Output [2]: [k#21L, (v#22 * 2.0) AS w#23]~Input [2]: [k#21L, v#22]"
    "~~(3) Scan parquet spark_catalog.default.hist' || CAST(o_custkey % 3 AS STRING) || '~Output [2]: [hk#24L, hw#25]~Batched: true~Location: InMemoryFileIndex [file:/wh/hist]~ReadSchema: struct<hk:bigint,hw:double>"
    "~~(4) Union~~(5) Window~Input [2]: [k#21L, w#23]~Arguments: [sum(w#23) windowspecdefinition(k#21L, k#21L ASC NULLS FIRST) AS run#26], [k#21L], [k#21L ASC NULLS FIRST]"
    "~~(6) Project [codegen id : 2]~Output [2]: [k#21L, run#26]~Input [3]: [k#21L, w#23, run#26]~~(7) AppendData~Arguments: org.apache.spark.sql.X@1, `cat`.`db`.`side' || CAST(o_custkey % 10 AS STRING) || '`~'"
)


def _sql_event(plan: str, execution: str, info: str = "''") -> str:
    return (
        "'«\"Event\":\"org.apache.spark.sql.execution.ui.SparkListenerSQLExecutionStart\",\"executionId\":' || CAST(" + execution + " AS STRING) || ',\"rootExecutionId\":' || CAST(o_orderkey * 3 AS STRING)"
        " || ',\"description\":\"save\",\"physicalPlanDescription\":\"' || " + plan + " || '\"' || " + info + " || ',\"time\":' || " + _T0 + " || '»'"
    )


# What the command of a write into a table counted, under the accumulators that its plan names.
_INFO = (
    "',\"sparkPlanInfo\":«\"nodeName\":\"Execute InsertIntoHadoopFsRelationCommand\",\"simpleString\":\"x\",\"children\":[«\"nodeName\":\"WriteFiles\",\"simpleString\":\"WriteFiles\",\"children\":[],\"metadata\":«»,\"metrics\":[]»],\"metadata\":«»,"
    "\"metrics\":[«\"name\":\"number of written files\",\"accumulatorId\":1,\"metricType\":\"sum\"»,«\"name\":\"written output\",\"accumulatorId\":' || CAST(o_orderkey * 10 + 2 AS STRING) || ',\"metricType\":\"size\"»,"
    "«\"name\":\"number of output rows\",\"accumulatorId\":' || CAST(o_orderkey * 10 + 3 AS STRING) || ',\"metricType\":\"sum\"»]»'"
)
_ACCUMS = (
    "'«\"Event\":\"org.apache.spark.sql.execution.ui.SparkListenerDriverAccumUpdates\",\"executionId\":' || CAST(o_orderkey * 3 + 2 AS STRING) || ',\"accumUpdates\":[[1,1],[' || CAST(o_orderkey * 10 + 2 AS STRING) || ',' || CAST(o_custkey * 7 AS STRING)"
    " || '],[' || CAST(o_orderkey * 10 + 3 AS STRING) || ',' || CAST(o_orderkey % 1000 AS STRING) || ']]»'"
)
# Odd orders write to a path; every third of them also into a table, and every other third into another catalog, under the same root.
_TABLE = "(o_orderkey % 2 = 0 OR o_orderkey % 6 = 3)"


_JOB_START = (
    "'«\"Event\":\"SparkListenerJobStart\",\"Job ID\":' || " + _KEY + " || ',\"Submission Time\":' || " + _T0 + " || ',\"Stage IDs\":[' || CAST(o_orderkey * 2 AS STRING) || ',' || CAST(o_orderkey * 2 + 1 AS STRING)"
    " || '],\"Properties\":«\"spark.app.name\":\"app' || CAST(o_custkey % 7 AS STRING) || '\",\"spark.sql.execution.id\":\"' || CAST(o_orderkey * 3 AS STRING) || '\"' || CASE WHEN o_custkey % 3 = 0 THEN ',\"spark.job.description\":\"nightly ' || CAST(o_custkey % 5 AS STRING) || '\"' ELSE '' END || '»»'"
)
_JOB_END = (
    "'«\"Event\":\"SparkListenerJobEnd\",\"Job ID\":' || " + _KEY + " || ',\"Completion Time\":' || " + _T0 + " || ',\"Job Result\":«\"Result\":\"' || CASE WHEN o_orderkey % 13 = 0 THEN 'JobFailed\",\"Exception\":«\"Message\":\"boom ' || " + _KEY + " || '\"»' ELSE 'JobSucceeded\"' END || '»»'"
)


def _stage(n: str) -> str:
    return (
        "'«\"Event\":\"SparkListenerStageCompleted\",\"Stage Info\":«\"Stage ID\":' || CAST(o_orderkey * 2 + " + n + " AS STRING) || ',\"Stage Attempt ID\":0,\"Stage Name\":\"s' || " + _KEY + " || '\",\"Number of Tasks\":4,\"Submission Time\":' || " + _T0
        + " || ',\"Completion Time\":' || CAST(1700000000000 + o_orderkey * 1000 + o_custkey AS STRING)" + (" || CASE WHEN o_orderkey % 11 = 0 THEN ',\"Failure Reason\":\"lost\"' ELSE '' END" if n == "1" else "") + " || '»»'"
    )


_TASK = (
    "'«\"Event\":\"SparkListenerTaskEnd\",\"Stage ID\":' || CAST(l_orderkey * 2 + l_linenumber % 2 AS STRING) || ',\"Stage Attempt ID\":0,\"Task Info\":«\"Task ID\":' || CAST(l_partkey AS STRING) || ',\"Executor ID\":\"' ||"
    " CASE WHEN l_suppkey % 10 = 0 THEN 'driver' ELSE CAST(l_suppkey % 4 AS STRING) END || '\",\"Locality\":\"' || CASE l_linenumber WHEN 1 THEN 'NODE_LOCAL' WHEN 2 THEN 'RACK_LOCAL' WHEN 3 THEN 'ANY' ELSE 'PROCESS_LOCAL' END || '\",\"Failed\":' ||"
    " CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'true' ELSE 'false' END || '»,\"Task Metrics\":«\"Executor Run Time\":' || CAST(CAST(l_quantity AS BIGINT) AS STRING) || ',\"Executor CPU Time\":' || CAST(CAST(l_quantity AS BIGINT) * 1000 AS STRING) ||"
    " ',\"Peak Execution Memory\":' || CAST(l_partkey % 1000 AS STRING) || ',\"JVM GC Time\":' || CAST(l_linenumber AS STRING) || ',\"Shuffle Read Metrics\":«\"Remote Bytes Read\":' || CAST(l_partkey AS STRING) || ',\"Local Bytes Read\":5»,\"Output Metrics\":«\"Bytes Written\":' ||"
    " CAST(l_suppkey AS STRING) || ',\"Records Written\":' || CAST(CAST(l_quantity AS BIGINT) AS STRING) || '»»»'"
)


def _lines(table: str, log: str, body: str, cond: str = "") -> str:
    """A line of each row that the condition holds for; it is asked last, so that all parts of the union read the rows as dealt out once."""
    keep = cond or "true"
    return f"SELECT log_id, value FROM (SELECT {log} AS log_id, inline(array(struct({keep} AS keep, CASE WHEN {keep} THEN {_J(body)} END AS value))) AS (keep, value) FROM {{{table}}}) x WHERE keep"


VIEWS["v_task_lines"] = f"SELECT {_LOG} AS log_id, {_J(_TASK)} AS value FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey"
VIEWS["v_event_lines"] = " UNION ALL ".join(
    [
        _lines("customer", "'log-' || CAST(c_custkey AS STRING)", body)
        for body in (
            "'«\"Event\":\"SparkListenerApplicationStart\",\"App Name\":\"app' || CAST(c_custkey % 7 AS STRING) || '\",\"App ID\":\"app-' || CAST(c_custkey AS STRING) || '\",\"Timestamp\":1700000000000»'",
            "'«\"Event\":\"SparkListenerEnvironmentUpdate\",\"Spark Properties\":«\"spark.executor.memory\":\"' || CAST(1 + c_custkey % 8 AS STRING) || 'g\",\"spark.executor.cores\":\"' || CAST(c_custkey % 5 AS STRING) || '\"»»'",
            "'«\"Event\":\"SparkListenerApplicationEnd\",\"Timestamp\":' || CAST(1700000000000 + c_custkey AS STRING) || '»'",
        )
    ]
    + [
        _lines("orders", _LOG, body, cond)
        for body, cond in (
            (_JOB_START, ""), (_JOB_END, ""), (_stage("0"), ""), (_stage("1"), ""),
            (_sql_event(_LOGICAL, "o_orderkey * 3 + 1"), _TABLE),
            (_sql_event(_PHYS_TABLE, "o_orderkey * 3 + 2", _INFO), _TABLE),
            (_ACCUMS, _TABLE),
            (_sql_event(_PHYS_FILE, "o_orderkey * 3"), "o_orderkey % 2 = 1"),
            (_sql_event(_V2, "o_orderkey * 3 + 1"), "o_orderkey % 6 = 1"),
        )
    ]
    + ["SELECT log_id, value FROM {v_task_lines}"]
)
