"""Lines and plans are dealt out by their number; plan texts are read the same in every form."""

import datetime
import json

from pyspark.sql import functions as F

from lakeledger.operators import plan_lineage as pl
from lakeledger.operators import run_metrics
from lakeledger.plans import registry
from lakeledger.sources import eventlog

PLAN = "== Physical Plan ==\nExecute InsertIntoHadoopFsRelationCommand (2)\n+- * Scan parquet db.t (1)\n\n\n(1) Scan parquet db.t [codegen id : 1]\nOutput [1]: [a#1]\n\n(2) Execute InsertIntoHadoopFsRelationCommand\nArguments: file:/wh/out, false"


def _line(event, **fields):
    return json.dumps({"Event": eventlog.EVENTS[event], **fields})


def _lines(spark, n):
    rows = [(f"log-{k % 7}", _line("sql_start", executionId=k, rootExecutionId=k // 2, physicalPlanDescription=PLAN, time=k)) for k in range(n)]
    return spark.createDataFrame([*rows, ("log-0", _line("app_end", Timestamp=1)), ("log-0", '{"Event":"Other"}'), ("log-0", rows[0][1][:-9]), ("log-0", None)], "log_id string, value string")


def test_nodes_of_a_plan_text():
    assert pl.parsed_nodes(PLAN) == [
        (1, "Scan parquet db.t", "Output [1]: [a#1]", 1, 3),
        (2, "Execute InsertIntoHadoopFsRelationCommand", "Arguments: file:/wh/out, false", 0, 0),
    ]
    # a node that the tree does not show has no place; what is no node is left out
    assert pl.parsed_nodes("== Physical Plan ==\nA (1)\n\n\n(7) B\n\n(x) C\n\n(8)") == [(7, "B", "", None, None), (8, "", "", None, None)]
    assert pl.parsed_nodes("") == []


def test_plans_are_dealt_out_by_their_number(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(eventlog, "DEALT", 10)
    x = eventlog.event_tables(eventlog.stage_event_log(_lines(spark, 45), str(tmp_path / "log")))
    assert x.partitions("sql_start") == 5
    nodes = pl.plan_nodes(x["sql"], partitions=x.partitions("sql_start"))
    # adaptive execution would put so few bytes into one task
    assert nodes.select("log_id", "root_execution_id", F.spark_partition_id().alias("p")).distinct().select("p").distinct().count() > 1
    whole = pl.plan_nodes(x["sql"])
    assert sorted(nodes.collect()) == sorted(whole.collect())
    assert nodes.count() == 90


def test_plans_without_a_text_have_no_nodes(spark):
    sql = spark.createDataFrame([("l", 1, 1, datetime.datetime(2024, 1, 1), None)], "log_id string, root_execution_id bigint, execution_id bigint, started_at timestamp, plan_text string")
    assert pl.plan_nodes(sql).collect() == []


def test_staged_lines_are_not_sorted(spark, tmp_path):
    conf = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(conf)
    staged = eventlog.stage_event_log(_lines(spark, 5).coalesce(1), str(tmp_path / "log"))
    assert spark.conf.get(conf) == before
    # events of other kinds, broken lines and no lines stay out
    assert {(r.event, r["count"]) for r in staged.groupBy("event").count().collect()} == {(eventlog.EVENTS["sql_start"], 5), (eventlog.EVENTS["app_end"], 1)}
    # in the order in which they came, so no sort by event stood before the write
    assert [r.log_id for r in staged.filter(F.col("event") == eventlog.EVENTS["sql_start"]).collect()] == [f"log-{k}" for k in range(5)]


def test_messages_are_made_in_parts_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(registry, "MESSAGES", 100)
    parts = registry.dealt(spark.range(1000).coalesce(1).toDF("k")).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 11
    assert max(r["count"] for r in parts) <= 100


def test_write_nodes_tell_outputs_and_writes(spark):
    nodes = pl.plan_nodes(eventlog.event_tables(_lines(spark, 6))["sql"])
    some = pl.write_nodes(nodes)
    assert 0 < some.count() < nodes.count()
    assert sorted(pl.query_outputs(some).collect()) == sorted(pl.query_outputs(nodes).collect()) != []
    assert sorted(pl.execution_writes(some).collect()) == sorted(pl.execution_writes(nodes).collect()) != []


def _log_of_orders(spark, folder):
    spark.sql("SELECT id AS c_custkey FROM range(3)").write.parquet(f"{folder}/customer.parquet")
    spark.sql("SELECT IF(id = 11, null, id) AS o_orderkey, id % 3 AS o_custkey FROM range(12)").write.parquet(f"{folder}/orders.parquet")
    spark.sql("SELECT id % 12 AS l_orderkey, id AS l_partkey, id AS l_suppkey, 1 AS l_linenumber, 2.0D AS l_quantity, 'R' AS l_returnflag, 'O' AS l_linestatus FROM range(24)").write.parquet(f"{folder}/lineitem.parquet")
    return registry.Tables(spark, str(folder))("v_event_lines")


def test_rows_behind_the_lines_are_dealt_out_once(spark, tmp_path):
    lines = _log_of_orders(spark, tmp_path)
    n = {r.event: r["count"] for r in lines.groupBy(F.get_json_object("value", "$.Event").alias("event")).count().collect()}
    # an order without a key gives lines without a text where no condition asks for the key
    sql = eventlog.EVENTS["sql_start"]
    assert n == {**{eventlog.EVENTS[k]: 3 for k in ("app_start", "environment", "app_end")}, **{eventlog.EVENTS[k]: 11 for k in ("job_start", "job_end")}, eventlog.EVENTS["stage"]: 22, sql: 23, eventlog.EVENTS["accums"]: 8, eventlog.EVENTS["task"]: 22, None: 4}
    ran = lines.agg(F.max("log_id"), F.max("value"))
    ran.collect()
    plan = ran._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # customers and orders once each for all their lines
    assert plan.count("RoundRobinPartitioning") - plan.count("ReusedExchange") <= 2
    assert plan.count("ReusedExchange") >= 10


def test_events_are_read_off_each_line_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    lines = _lines(spark, 5).select("log_id", F.udf(count, "string").asNondeterministic()("value").alias("value"))
    staged = eventlog.stage_event_log(lines, str(tmp_path / "log"))
    assert staged.count() == 6
    assert seen.value == 9


WRITE = "log_id string, root_execution_id bigint, write_id bigint, write_no int, name string, table_type string, path string, location string"


def test_inputs_meet_the_outputs_of_their_write_once(spark):
    row = lambda write, name, kind="File", at=None, log="l": (log, 1, write, 0, name, kind, at, at)
    inputs = spark.createDataFrame(
        [row(1, "a", at="/in/a"), row(1, "out", at="/x/out"), row(1, "t", "Table"), row(1, "b", at="/w/out/"), row(1, "c", at="/s/_temporary/0"), row(2, "out", at="/x/out"), row(None, "a", at="/in/a"), row(1, "n", log=None)], WRITE
    )
    outputs = spark.createDataFrame([row(1, "out", at="/w/out"), row(1, "t", "Table"), row(1, "side", "Table"), row(1, "n", log=None)], WRITE)
    # its own name and place and staging paths go; a table of a written name stays, as do writes without outputs
    left = pl.drop_self_reads(inputs, outputs)
    assert left.columns == inputs.columns
    assert {(r.log_id, r.write_id, r["name"]) for r in left.collect()} == {("l", 1, "a"), ("l", 1, "t"), ("l", 2, "out"), ("l", None, "a"), (None, 1, "n")}
    edges = pl.query_edges(inputs, outputs)
    assert {(r.source, r.target) for r in edges.collect()} == {(s, t) for s in ("a", "t") for t in ("out", "t", "side")}
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def test_table_nodes_tell_inputs_and_outputs(spark):
    nodes = pl.plan_nodes(eventlog.event_tables(_lines(spark, 6).union(spark.createDataFrame([("log-9", _line("sql_start", executionId=1, physicalPlanDescription="== Physical Plan ==\nFilter (1)\n\n\n(1) Filter\nCondition : x", time=1))], "log_id string, value string")))["sql"])
    some = pl.table_nodes(nodes)
    assert 0 < some.count() < nodes.count()
    assert sorted(pl.query_inputs(some).collect()) == sorted(pl.query_inputs(nodes).collect()) != []
    assert sorted(pl.query_outputs(some).collect()) == sorted(pl.query_outputs(nodes).collect()) != []


def test_first_named_output_of_the_best_rank_is_the_target():
    origin, written = (pl._ORIGIN, 1, "src", "c", None), (pl._WRITTEN, 1, "c", None, None)
    targets = [(pl._TARGET, 3, "file", "/f", "2024-01-01"), (pl._TARGET, 1, "late", None, "2024-01-03"), (pl._TARGET, 1, "early", None, "2024-01-02"), (pl._TARGET, 1, "early", None, None)]
    assert {e[-1] for e in pl.resolved([*targets, origin, written])} == {"early"}
    assert pl.resolved([origin, written]) == set()


def test_tasks_are_read_off_their_lines_once(spark, tmp_path):
    t = eventlog.event_tables(eventlog.stage_event_log(_log_of_orders(spark, tmp_path), str(tmp_path / "log")))
    plan = run_metrics.full_job_metrics(t)._jdf.queryExecution().optimizedPlan().toString()
    assert "Stage Info" in plan
    assert "Task Info" not in plan
    assert "Job ID" not in plan
