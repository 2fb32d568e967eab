"""One test for each fixed behaviour that no other test names."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lakeledger.functions import naming, paths
from lakeledger.functions.schema_text import schema_hash
from lakeledger.operators import alerts, graph, listing, plan_lineage, run_metrics, schema_diff
from lakeledger.operators import tables as tb
from lakeledger.operators.plan_lineage import query_outputs
from lakeledger.sources.payloads import parse_ingest

T0 = dt.datetime(2024, 1, 1)
FIELDS = "array<struct<name:string,type:string,nullable:boolean>>"


def message(spark, **body):
    text = json.dumps({"job_id": "j", **body})
    return parse_ingest(spark.createDataFrame([("o", T0, text)], "org_id string, received_at timestamp, value string"))[0]


def test_hash_separator_B1(spark):
    df = spark.createDataFrame([([("a", "int", True), ("b", "string", False)],)], f"f {FIELDS}")
    a, b = df.select(schema_hash(F.col("f")), schema_hash(F.col("f"), "|")).first()
    assert a == hashlib.sha256(b"a:int:true,b:string:false").hexdigest() and b == hashlib.sha256(b"a:int:true|b:string:false").hexdigest()


def test_description_parts_are_joined_by_blanks_B5(spark):
    old, new = [("a", "int", True), ("b", "int", True)], [("a", "string", True), ("c", "int", True)]
    p = spark.createDataFrame([(1, old, new)], f"k int, old_fields {FIELDS}, new_fields {FIELDS}")
    text = schema_diff.schema_change_anomalies(p, ["k"]).first().message
    assert "Added 1 new column: 'c' Removed column 'b' Data type changed for column 'a'" in text


def test_table_named_only_in_column_edges_B12(spark):
    m = message(spark, inputs=[{"name": "raw", "type": "s3", "location": "s3://b/raw"}], column_lineage=[{"source_table": "raw", "source_column": "x", "target_table": "only", "target_column": "y"}])
    got = {r.name: (r.dataset_type, r.location) for r in tb.payload_datasets(m).collect()}
    assert got == {"raw": ("s3", "s3://b/raw"), "only": ("table", None)}  # a full reference is not lost


def test_every_output_has_the_run_total_B13(spark):
    runs = spark.createDataFrame([("l", "app", 7, 70, T0, "Success")], "log_id string, app_id string, rows_written bigint, bytes_written bigint, ended_at timestamp, status string")
    outs = spark.createDataFrame([("l", "a"), ("l", "b"), ("l", "a")], "log_id string, name string")
    assert sorted((r.dataset, r.row_count, r.byte_size) for r in run_metrics.run_output_metrics(runs, outs).collect()) == [("a", 7, 70), ("b", 7, 70)]


def test_failed_stages_and_failed_tasks_B14(spark):
    names = [c for c in run_metrics.TASK_COUNTERS]
    tasks = spark.createDataFrame([("l", s, 0, bad, True) for s, bad in ((1, True), (1, True), (2, False))], "log_id string, stage_id bigint, stage_attempt_id bigint, failed boolean, has_metrics boolean")
    tasks = tasks.select("*", *[F.lit(1).cast("bigint").alias(c) for c in names])
    stages = spark.createDataFrame([("l", 1, 0, 2, "lost", T0, T0), ("l", 2, 0, 1, None, T0, T0)], "log_id string, stage_id bigint, stage_attempt_id bigint, num_tasks bigint, failure_reason string, started_at timestamp, ended_at timestamp")
    jobs = spark.createDataFrame([("l", 5, [1, 2])], "log_id string, job_id bigint, stage_ids array<bigint>")
    r = run_metrics.job_metrics(run_metrics.stage_metrics(stages, tasks), jobs).first()
    assert (r.failed_stages, r.failed_tasks) == (1, 2)


def test_filter_is_an_expression_of_its_own_B15(spark):
    kinds = spark.createDataFrame([("(a#1 > 3)",), ("a#1",), ("(a#1 + 1)",)], "e string").select(naming.transform_type(F.col("e"))).collect()
    assert [k[0] for k in kinds] == ["FILTER", "DIRECT", "EXPRESSION"]


def test_first_output_of_a_plan_B19(spark):
    rows = [("l", 1, k, T0 + dt.timedelta(minutes=m), k, "InsertIntoHadoopFsRelationCommand", f"Arguments: file:/wh/{n}, false") for k, (m, n) in enumerate([(2, "a"), (1, "z")])]
    nodes = spark.createDataFrame(rows, "log_id string, root_execution_id bigint, execution_id bigint, started_at timestamp, node_id bigint, node_name string, detail string")
    first = query_outputs(nodes).groupBy("log_id").agg(F.min_by("name", F.struct("started_at", "name")).alias("n")).first().n
    assert first == "z"


def test_organisations_do_not_leak_B22(spark):
    e = spark.createDataFrame([("o1", "a", "b"), ("o2", "b", "c")], "org_id string, source string, target string")
    start = spark.createDataFrame([("o1", "a")], "org_id string, name string")
    assert [r.dataset for r in graph.downstream(e, start).collect()] == ["b"]


def test_wildcards_and_repeat_suppression_together_B24(spark):
    a = spark.createDataFrame([(k, "o", "sales_eu", "T", "INFO", T0 + dt.timedelta(minutes=m)) for k, m in enumerate((0, 10, 70))], "anomaly_id bigint, org_id string, dataset string, anomaly_type string, severity string, detected_at timestamp")
    rules = spark.createDataFrame([(1, "o", "sales_*", None, None, True, 60)], "rule_id int, org_id string, dataset_pattern string, anomaly_type string, severity string, enabled boolean, deduplication_minutes int")
    got = {r.anomaly_id: r.status for r in alerts.dedup_alerts(alerts.match_rules(a, rules)).collect()}
    assert got == {0: "SENT", 1: "DEDUPLICATED", 2: "SENT"}
    assert alerts.match_rules(a, rules, wildcard=False).count() == 0


def test_one_row_for_one_anomaly_B23(spark):
    m = message(spark, outputs=[{"name": "t"}], anomalies=[{"dataset_name": "t", "anomaly_type": "RowCountDrop", "current_value": 1.0, "expected_value": 9.0, "threshold": 3.0}])
    assert tb.payload_anomalies(m).count() == 1


def test_retention_orders_by_the_rows_time_B25(spark):
    rows = [("o", "d", "n", None, T0 + dt.timedelta(days=k), f"j{k}") for k in (2, 0, 1)]
    m = spark.createDataFrame(rows, "org_id string, dataset string, job_name string, partition_key string, ts timestamp, job_id string")
    assert sorted(r.job_id for r in tb.retain_last(m, 2).collect()) == ["j1", "j2"]


@pytest.mark.parametrize("asked", ["success", "SUCCESS", "Success"])
def test_status_filter_ignores_case_B26(spark, asked):
    j = spark.createDataFrame([("o", "a", "SUCCESS", "n", None, T0, T0), ("o", "b", "FAILED", "n", None, T0, T0)], "org_id string, app_id string, status string, job_name string, partition_key string, started_at timestamp, ended_at timestamp")
    assert [r.app_id for r in listing.list_jobs(j, "o", status=asked).collect()] == ["a"]


def test_times_are_utc_B27(spark):
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    assert message(spark, started_at="2024-01-01T00:00:00Z").select(F.unix_seconds("started_at")).first()[0] == 1704067200


def test_last_part_of_a_name_B28(spark):
    got = spark.createDataFrame([("cat.db1.t",), ("t",)], "n string").select(naming.last_part(F.col("n"))).collect()
    assert [r[0] for r in got] == ["t", "t"]


@pytest.mark.parametrize("full,names", [(False, {("t", "out")}), (True, {("spark_catalog.db1.t", "spark_catalog.gold.out"), ("spark_catalog.db2.t", "spark_catalog.gold.out")})])
def test_full_names_keep_databases_apart_B28(spark, full, names):
    rows = [("l", 1, 1, T0, k, n, d) for k, (n, d) in enumerate([
        ("Scan parquet spark_catalog.db1.t", "Output [1]: [a#1]"), ("LogicalRelation", "Arguments: parquet, [a#2], `spark_catalog`.`db2`.`t`, false"),
        ("CreateDataSourceTableAsSelectCommand", "Arguments: `spark_catalog`.`gold`.`out`, ErrorIfExists, [a]")])]
    nodes = spark.createDataFrame(rows, "log_id string, root_execution_id bigint, execution_id bigint, started_at timestamp, node_id bigint, node_name string, detail string")
    e = plan_lineage.query_edges(plan_lineage.query_inputs(nodes, full), plan_lineage.query_outputs(nodes, full))
    assert {(r.source, r.target) for r in e.collect()} == names


def test_mean_executor_memory_is_combined_by_maximum_B29(spark):
    cols = [*run_metrics.SUMMED, "shuffle_read_bytes", "total_tasks", "failed_stages", "failed_tasks", *run_metrics.LOCAL, "peak_execution_memory", *run_metrics.MEMORY]
    rows = spark.createDataFrame([("l", 10), ("l", 30)], "log_id string, v bigint").select("log_id", *[F.col("v").alias(c) for c in cols])
    r = run_metrics.app_metrics(rows).first()
    assert r.avg_memory_per_executor_bytes == 30 and r.total_tasks == 40


def test_threshold_is_stored_as_deviation_B30(spark):
    m = message(spark, outputs=[{"name": "t"}], anomalies=[{"dataset_name": "t", "anomaly_type": "X", "threshold": 4.5}])
    assert tb.payload_anomalies(m).first().deviation_score == 4.5


def test_geography_keys_ignore_case_and_wildcards_B31(spark):
    got = spark.createDataFrame([("/x/Country=US/REGION=*/Zone=z",)], "p string").select(paths.extract_geo(F.col("p"))).first()[0]
    assert got == {"country": "US", "zone": "z"}
