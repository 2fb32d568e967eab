"""Nodes left behind where plan texts are read change no inputs, outputs or writes."""

import json

import pytest
from pyspark.sql import functions as F

from lakeledger.functions import naming, paths
from lakeledger.operators import plan_lineage as pl
from lakeledger.sources import eventlog


PLAN = "== Physical Plan ==\nExecute InsertIntoHadoopFsRelationCommand (3)\n\n\n(1) Scan parquet db.t [codegen id : 1]\nOutput [1]: [a#1]\n\n(2) Project\nOutput [1]: [a#1]\n\n(3) Execute InsertIntoHadoopFsRelationCommand\nArguments: file:/wh/out, false"


def _lines(spark, n):
    plan = lambda k: json.dumps({"Event": eventlog.EVENTS["sql_start"], "executionId": k, "rootExecutionId": k // 2, "physicalPlanDescription": PLAN, "time": k})
    return spark.createDataFrame([(f"log-{k % 7}", plan(k)) for k in range(n)], "log_id string, value string")


def _rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("read, only", [(pl.query_inputs, pl.SCANS), (pl.query_outputs, pl.NOTHING), (pl.attribute_origins, pl.SCANS)])
def test_only_what_is_asked_is_handed_on(spark, read, only):
    x = eventlog.event_tables(_lines(spark, 12))
    whole, few = pl.plan_nodes(x["sql"]), pl.plan_nodes(x["plans"], only=only)
    assert _rows(read(few)) == _rows(read(whole))
    assert 0 < few.count() < whole.count()


def test_several_commands_of_a_plan_stay_apart(spark):
    text = "== Physical Plan ==\n(1) Scan parquet a.b.c\nx\n\n(2) AppendData\nArguments: `c`.`d`.`one`\n\n(3) Scan parquet a.b.e\nx\n\n(4) AppendData\nArguments: `c`.`d`.`two`\n"
    sql = spark.createDataFrame([("l", 1, 1, text)], "log_id string, root_execution_id bigint, execution_id bigint, plan_text string").withColumn("started_at", F.lit(0).cast("timestamp"))
    for only in (None, pl.SCANS):
        n = pl.plan_nodes(sql, only=only)
        assert {(r.node_id, r.write_no) for r in n.filter("node_id > 1").collect()} == {(2, 0), (3, 1), (4, 1)}


def test_words_missed_hide_no_path_or_table(spark):
    texts = ["x [gs://b/k, y]", "dbfs:/m", "file:/a b", "file:///c", "path=rel/x, z", "at /loc/a", "wasb://u@h/p", "no", None, "a`b`.`c`", "`a`.`b`.`c`", "hive_metastore.db.t", "JDBCRelation(t) [n=1]", "JDBC Relation(t)"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", paths.extract_file_path(F.col("t")).alias("p"), naming.table_from_plan(F.col("t")).alias("n"), naming.table_from_plan(F.col("t"), True).alias("f"), naming.source_table(F.col("t")).alias("s")).orderBy("i").collect()
    assert [r.p for r in got] == ["gs://b/k", "dbfs:/m", "file:/a", "file:///c", "rel/x", "/loc/a", "wasb://u@h/p", None, None, None, None, None, None, None]
    assert [(r.n, r.f) for r in got][9:12] == [("c", "b.c"), ("c", "a.b.c"), ("t", "hive_metastore.db.t")]
    assert [r.s for r in got][12:] == ["t", None]


def test_written_schemas_are_handed_on_together(spark, monkeypatch):
    """Some batches of many schemas, not one for each write, and none lost where a batch ends."""
    monkeypatch.setattr(pl, "SCHEMAS", 3)
    text = "== Physical Plan ==\nExecute InsertIntoHadoopFsRelationCommand (3)\n+- WriteFiles (2)\n   +- Scan parquet db.t (1)\n\n\n(1) Scan parquet db.t\nOutput [1]: [a#1]\nLocation: InMemoryFileIndex [file:/wh/t]\nReadSchema: struct<a:int>\n\n(2) WriteFiles\nInput [1]: [a#1]\n\n(3) Execute InsertIntoHadoopFsRelationCommand\nArguments: file:/wh/out, false"
    rows = [(f"l{k}", 1, 1, text) for k in range(10)]
    sql = spark.createDataFrame(rows, "log_id string, root_execution_id bigint, execution_id bigint, plan_text string").withColumn("started_at", F.lit(0).cast("timestamp")).coalesce(1)
    found = pl.query_schemas(pl.plan_nodes(sql)).filter("side = 'write'")
    assert sorted((r.log_id, r.dataset, [tuple(f) for f in r.fields]) for r in found.collect()) == [(f"l{k}", "out", [("a", "int", True)]) for k in range(10)]
