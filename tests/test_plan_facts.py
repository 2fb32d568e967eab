"""What is read off plan texts once: events that are kept, tables, columns, types and the writes they are part of."""

import json

from pyspark.sql import functions as F

from lakeledger.functions import naming, paths
from lakeledger.operators import plan_lineage as pl
from lakeledger.operators import plan_text as pt
from lakeledger.plans import registry
from lakeledger.sources import eventlog


def _line(event, **fields):
    return json.dumps({"Event": eventlog.EVENTS[event], **fields})


def test_events_that_nobody_asked_for_are_read_but_not_kept(spark, tmp_path):
    whole = _line("sql_start", executionId=1, physicalPlanDescription="x", time=1)
    escaped = whole.replace("SparkListenerSQL", "\\u0053parkListener\\u0053QL")
    spelt = _line("app_end", Timestamp=1, User=eventlog.EVENTS["sql_start"])
    lines = spark.createDataFrame([("l", x) for x in (whole, escaped, spelt, whole[:-9], _line("task"), None)], "log_id string, value string")
    some = eventlog.stage_event_log(lines, str(tmp_path / "some"), ["sql_start"])
    assert sorted(r.value for r in some.collect()) == sorted([whole, escaped])
    every = eventlog.stage_event_log(lines, str(tmp_path / "all"))
    assert sorted(some.collect()) == sorted(every.filter(F.col("event") == eventlog.EVENTS["sql_start"]).collect())
    assert every.count() == 4


def test_a_query_on_plans_keeps_no_tasks(spark, tmp_path):
    d = str(tmp_path)
    spark.sql("SELECT id AS c_custkey FROM range(3)").write.parquet(f"{d}/customer.parquet")
    spark.sql("SELECT id AS o_orderkey, id % 3 AS o_custkey FROM range(12)").write.parquet(f"{d}/orders.parquet")
    spark.sql("SELECT id % 12 AS l_orderkey, id AS l_partkey, id AS l_suppkey, 1 AS l_linenumber, 2.0D AS l_quantity, 'R' AS l_returnflag, 'O' AS l_linestatus FROM range(24)").write.parquet(f"{d}/lineitem.parquet")
    t = registry.Tables(spark, d)
    sql = t.staged_log("sql_start")
    assert [r.event for r in sql.select("event").distinct().collect()] == [eventlog.EVENTS["sql_start"]]
    whole = t.staged_log()
    assert whole.select("event").distinct().count() == 9
    # what was split whole serves all
    assert t.staged_log("sql_start").inputFiles() == whole.inputFiles()
    assert sorted(sql.collect()) == sorted(whole.filter(F.col("event") == eventlog.EVENTS["sql_start"]).collect())


# Texts in which Java's and Python's patterns part ways, beside plain ones.
TEXTS = ["s3a://lake/ref1/dt=20240101", "file:/wh/a b", "hdfs://nn:8020/out/country=C1/dt=2024-01-01/", "/x/eu-west-1/us", "a\u2028", "dt=1\n", "x.parquet\r", "//", "", "path=rel/x", "`a`.`b`.`c` and `d`", "spark_catalog.default.té",
    "a#1, f(b#2L, c#3) AS d#4, [e#5, {g#6}]", "(a#1 = b#2L)", "sum(v#1)#9L AS total#3", "éand b", "case  when x", "JDBCRelation(t) [n=1]", "dbtable=q, x", "CheckpointsV2 [s, t]", "] x ]"]


def test_row_functions_answer_as_column_functions_do(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    t = F.col("t")
    got = df.select("t", paths.extract_file_path(t), paths.dataset_name_from_path(t), paths.generalize_location(t), naming.table_from_plan(t), naming.table_from_plan(t, True), naming.source_table(t), naming.transform_type(t)).collect()
    for text, *told in got:
        assert told == [pt.file_path(text), pt.dataset_name(text), pt.location(text), pt.plan_table(text, False), pt.plan_table(text, True), pt.source_table(text), pt.transform_type(text)], text
    assert pt.split_top(TEXTS[12]) == ["a#1", "f(b#2L, c#3) AS d#4", "[e#5, {g#6}]"]
    assert pt.attributes("a#1, x, b#2L") == [("a", 1, False), ("b", 2, True)]


TREE = "== Physical Plan ==\nAppendData (4)\n+- Union (3)\n   :- Scan parquet d.s (1)\n   +- Scan parquet d.t (2)\n\n\n(1) Scan parquet d.s\nOutput [1]: [a#1]\nReadSchema: struct<a:int>\n\n(2) Scan parquet d.t\nOutput [1]: [b#2]\nReadSchema: struct<b:int>\n\n(3) Union\n\n(4) AppendData\nArguments: X@1, `c`.`d`.`out`\n"


def _plans(spark, text, n):
    rows = [(f"l{k % 5}", k, k, text) for k in range(n)]
    return spark.createDataFrame(rows, "log_id string, root_execution_id bigint, execution_id bigint, plan_text string").withColumn("started_at", F.lit(0).cast("timestamp"))


def test_a_write_is_resolved_where_its_plans_were_dealt_to(spark):
    nodes = pl.plan_nodes(_plans(spark, TREE, 40), partitions=3)
    edges = pl.column_edges(nodes)
    assert {(r.root_execution_id, r.source_dataset, r.source_column, r.target_dataset, r.target_column) for r in edges.collect()} == {(k, d, c, "out", "a") for k in range(40) for d, c in (("s", "a"), ("t", "b"))}
    schemas = pl.query_schemas(nodes)
    assert schemas.filter("side = 'write'").count() == 40
    for df in (edges, schemas, pl.query_inputs(nodes), pl.query_outputs(nodes), pl.attribute_origins(nodes), pl.written_columns(nodes)):
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        assert plan.count("Exchange hashpartitioning") == 1


def test_plans_keep_the_nodes_that_columns_are_read_off(spark):
    file = "== Physical Plan ==\nExecute InsertIntoHadoopFsRelationCommand (4)\n+- WriteFiles (3)\n   +- Project (2)\n      +- Scan parquet d.s (1)\n\n\n(1) Scan parquet d.s\nOutput [2]: [a#1, b#2]\n\n(2) Project\nOutput [1]: [a#1]\nInput [2]: [a#1, b#2]\n\n(3) WriteFiles\nInput [1]: [a#1]\n\n(4) Execute InsertIntoHadoopFsRelationCommand\nArguments: file:/wh/out, false"
    plans = _plans(spark, TREE, 2).unionByName(_plans(spark, file, 2).withColumn("log_id", F.lit("file")))
    whole, few = pl.plan_nodes(plans), pl.plan_nodes(plans, only=pl.COLUMNS)
    # a plan that hands on what it writes is kept whole, as its children tell it
    assert sorted(r["count"] for r in few.groupBy("log_id").count().collect()) == [4, 4, 6]
    for read in (pl.written_columns, pl.attribute_origins, pl.query_outputs):
        assert sorted(read(few).collect()) == sorted(read(whole).collect()) != []
    assert {(r.log_id, r.column, r.expr_id) for r in pl.written_columns(few).collect()} == {("l0", "a", 1), ("l1", "a", 1), ("file", "a", 1)}
