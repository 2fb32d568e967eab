"""Lineage and metrics out of a real event log, written with Spark's default settings (rolled, compressed)."""

import os
import subprocess
import sys
import tempfile

import pytest
from pyspark.sql import functions as F

from lakeledger.operators import plan_lineage as pl
from lakeledger.operators import run_metrics as rm
from lakeledger.operators import schema_history as sh
from lakeledger.operators.plan_types import type_of, types_of
from lakeledger.sources.eventlog import event_tables, read_event_log

APP = """
import sys
from pyspark.sql import SparkSession, functions as F
logs, wh = sys.argv[1:]
s = (SparkSession.builder.master("local[2]").appName("orchard").config("spark.ui.enabled", "false").config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", logs)
     .config("spark.sql.warehouse.dir", wh).config("spark.sql.maxPlanStringLength", "10000000").config("spark.sql.debug.maxToStringFields", "10000").config("spark.sql.shuffle.partitions", "2").getOrCreate())
s.sql("select id as tree, id % 3 as plot, double(id) as kilos, array(id, id + 1) as picks from range(30)").write.saveAsTable("north")
s.sql("select id as stem, id % 3 as bed, double(id) as mass, array(id) as picks from range(20)").write.saveAsTable("south")
s.table("north").union(s.table("south")).drop("picks").write.saveAsTable("harvest")
s.sql("select tree, sum(kilos) over (partition by plot order by tree) as running from harvest").write.saveAsTable("ranked")
s.sql("select tree, pick from north lateral view explode(picks) p as pick").write.parquet(wh + "/files/picked")
s.sql("select plot, tree, sum(kilos) as kilos, count(*) as n from harvest group by plot, tree with rollup").write.parquet(wh + "/files/rolled")
s.sql("select stem, upper(string(bed)) as bed_name, mass as weight from south where mass > 1").write.saveAsTable("plain")
s.range(3).selectExpr("id as plot", "2.5D as price").write.parquet(wh + "/files/prices")
s.table("harvest").join(s.read.parquet(wh + "/files/prices"), "plot").write.saveAsTable("sales")
s.table("south").write.parquet(wh + "/files/copy")
s.sql("create table left_side (x bigint) using parquet")
s.sql("create table right_side (y double) using parquet")
s.sql("from north insert into left_side select tree where tree < 7 insert into right_side select sum(kilos) group by plot")
def two(df, n):
    df.where("kilos > 3").write.mode("append").saveAsTable("batch_table")
    df.select((F.col("kilos") * 2).alias("twice")).write.mode("append").parquet(wh + "/files/batch_file")
s.readStream.schema("tree long, plot long, kilos double").parquet(wh + "/north").writeStream.foreachBatch(two).option("checkpointLocation", wh + "/ck").trigger(availableNow=True).start().awaitTermination()
try:
    s.sql("select assert_true(id < 0) from range(2)").write.saveAsTable("never")
except Exception:
    pass
s.stop()
"""


@pytest.fixture(scope="module")
def logs():
    root = tempfile.mkdtemp(prefix="lakeledger-log-")
    logs, wh = os.path.join(root, "logs"), os.path.join(root, "wh")
    os.mkdir(logs)
    subprocess.run([sys.executable, "-c", APP, logs, wh], check=True, timeout=300, capture_output=True, cwd=root)
    return logs


@pytest.fixture(scope="module")
def tables(spark, logs):
    return event_tables(read_event_log(spark, logs))


@pytest.fixture(scope="module")
def nodes(tables):
    return pl.plan_nodes(tables["sql"])


@pytest.fixture(scope="module")
def column_edges(nodes):
    got = {}
    for r in pl.column_edges(nodes).collect():
        got.setdefault(r.target_dataset, set()).add((r.source_dataset, r.source_column, r.target_column, r.transform_type))
    return got


def table_edges(nodes):
    return {(r.source, r.target) for r in pl.query_edges(pl.query_inputs(nodes), pl.query_outputs(nodes)).collect()}


def test_default_log_is_rolled_and_packed(logs):
    names = [f for _, _, fs in os.walk(logs) for f in fs]
    assert any(f.startswith("events_1_") and f.endswith(".zstd") for f in names)


def test_table_edges(nodes):
    assert table_edges(nodes) == {
        ("north", "harvest"), ("south", "harvest"), ("harvest", "ranked"), ("north", "picked"), ("harvest", "rolled"), ("south", "plain"), ("harvest", "sales"), ("prices", "sales"), ("south", "copy"),
        ("north", "left_side"), ("north", "right_side"), ("north", "batch_table"), ("north", "batch_file"),
    }


def test_union_has_edges_from_all_sides(column_edges):
    assert column_edges["harvest"] == {
        ("north", "tree", "tree", "DIRECT"), ("north", "plot", "plot", "DIRECT"), ("north", "kilos", "kilos", "DIRECT"),
        ("south", "stem", "tree", "DIRECT"), ("south", "bed", "plot", "DIRECT"), ("south", "mass", "kilos", "DIRECT"),
    }


def test_window_generator_and_rollup(column_edges):
    assert column_edges["ranked"] == {("harvest", "tree", "tree", "DIRECT"), ("harvest", "kilos", "running", "AGGREGATE"), ("harvest", "plot", "running", "AGGREGATE"), ("harvest", "tree", "running", "AGGREGATE")}
    assert column_edges["picked"] == {("north", "tree", "tree", "DIRECT"), ("north", "picks", "pick", "EXPRESSION")}
    # count(*) names no column, so n has no edge
    assert column_edges["rolled"] == {("harvest", "plot", "plot", "DIRECT"), ("harvest", "tree", "tree", "DIRECT"), ("harvest", "kilos", "kilos", "AGGREGATE")}


def test_projection_join_and_copy(column_edges):
    assert column_edges["plain"] == {("south", "stem", "stem", "DIRECT"), ("south", "bed", "bed_name", "EXPRESSION"), ("south", "mass", "weight", "DIRECT")}
    assert ("prices", "price", "price", "DIRECT") in column_edges["sales"]  # B18
    assert ("prices", "plot", "plot", "JOIN") in column_edges["sales"] and ("harvest", "plot", "plot", "DIRECT") in column_edges["sales"]
    assert column_edges["copy"] == {("south", c, c, "DIRECT") for c in ("stem", "bed", "mass", "picks")}  # B20


def test_several_writes_of_one_root(tables, nodes, column_edges):
    """An insert into two tables is one execution; a batch's writes share a root, and each has outputs and columns of its own."""
    assert column_edges["left_side"] == {("north", "tree", "x", "DIRECT")}
    assert column_edges["right_side"] == {("north", "kilos", "y", "AGGREGATE")}
    outputs = pl.query_outputs(nodes).filter("name IN ('left_side', 'right_side', 'batch_table', 'batch_file')").collect()
    assert len(outputs) == 4 and len({r.root_execution_id for r in outputs}) == 2
    assert sorted(r.name for r in outputs if r.table_type == "File") == ["batch_file"]
    runs = rm.job_runs(tables, pl.query_outputs(nodes))
    rows = {r.dataset: r.row_count for r in rm.run_output_metrics(runs, pl.query_outputs(nodes), rm.write_metrics(tables, nodes)).collect()}
    assert (rows["north"], rows["south"], rows["harvest"], rows["plain"]) == (30, 20, 50, 18)
    assert (rows["left_side"], rows["right_side"], rows["batch_table"], rows["batch_file"]) == (7, 3, 26, 30)


def test_types_follow_ids(nodes):
    s = {(r.dataset, r.side): [(f.name, f.type) for f in r.fields] for r in pl.query_schemas(nodes).collect()}
    assert s["copy", "write"] == [("stem", "bigint"), ("bed", "bigint"), ("mass", "double"), ("picks", "array<bigint>")]
    assert s["plain", "write"] == [("stem", "bigint"), ("bed_name", "string"), ("weight", "double")]


def test_written_schemas_are_those_of_the_files(spark, logs, nodes):
    """What the plans say of every write of the log, against what lies in its folder."""
    wh = os.path.join(os.path.dirname(logs), "wh")
    wrote = {r.dataset: r.fields for r in pl.query_schemas(nodes).filter("side = 'write'").collect()}
    assert set(wrote) >= {"north", "south", "harvest", "ranked", "picked", "rolled", "plain", "prices", "sales", "copy", "batch_table", "batch_file"}
    for name, fields in wrote.items():
        place = next((p for p in (f"{wh}/{name}", f"{wh}/files/{name}", f"{wh}/{name.rsplit(':')[-1]}") if os.path.isdir(p) and any(f.endswith(".parquet") for f in os.listdir(p))), None)
        if place is None:
            assert name == "never"
            continue
        true = [(f.name, f.dataType.simpleString()) for f in spark.read.parquet(place).schema]
        got = [(f.name, f.type) for f in fields]
        if name in ("left_side", "right_side"):  # an insert hands on its own names
            assert [t for _, t in got] == [t for _, t in true]
        elif name == "prices":  # a bare literal does not tell its type
            assert [t for _, t in got] == ["bigint", "unknown"]
        elif name.startswith("batch_"):  # a micro-batch enters as rows without types; an id's L is all there is
            assert [t for _, t in got] == [t if t == "bigint" else "unknown" for _, t in true]
        elif name == "sales":
            assert dict(got) == dict(true)
        else:
            assert got == true, name


def test_written_snapshots_enter_the_snapshot_log(spark, nodes):
    schemas = pl.query_schemas(nodes)
    log = sh.snapshot_log(pl.written_snapshots(schemas, F.lit("o1")))
    rows = {r.dataset: r for r in log.collect()}
    assert "prices" not in rows  # a column of unknown type
    assert [(f.name, f.type, f.nullable) for f in rows["harvest"].fields] == [("tree", "bigint", True), ("plot", "bigint", True), ("kilos", "double", True)]
    versions = sh.build_schema_versions(log).filter("dataset = 'harvest'").collect()
    assert [(v.version_no, v.valid_to) for v in versions] == [(1, None)]


EXPRESSIONS = """i + 1 AS a1|l * i AS a2|f / 2 AS a3|d + d AS a4|d * d AS a5|d / d AS a6|d % d AS a7|i div 2 AS a8|-i AS a9|cast(s AS decimal(20, 4)) AS b1|cast(i AS string) AS b2|i > 2 AND s LIKE 'x%' AS b3
i IN (1, 2, 3) AS b4|NOT (i = 2) AS b5|CASE WHEN i > 1 THEN l WHEN i < 0 THEN i ELSE 0 END AS b6|CASE WHEN i > 1 THEN CASE WHEN i > 5 THEN s ELSE 'y' END ELSE s END AS b7|if(i > 1, f, 0) AS b8|coalesce(s, 'z') AS b9
upper(s) AS c1|length(s) AS c2|concat(s, 'x') AS c3|concat_ws('-', s, s) AS c4|year(t) AS c5|date_trunc('day', t) AS c6|to_date(t) AS c7|date_format(t, 'yyyy') AS c8|t + INTERVAL 1 DAY AS c9|p[0] AS d1|p[0].x AS d2|m['k'] AS d3|q.x AS d4|q.y.z AS d5
named_struct('u', i, 'v', s) AS e1|array(i, 2) AS e2|size(p) AS e3|round(d, 1) AS e4|floor(d) AS e5|ceil(f) AS e6|abs(d) AS e7|map_keys(m) AS e8|split(s, ',') AS e9|md5(s) AS g1|s IS NULL AS g2|unix_timestamp(t) AS g3|greatest(i, l) AS g4|float(i) AS g5|d + i AS g6|datediff(t, t) AS g7"""
AGGREGATES = "sum(i) AS s1|sum(l) AS s2|sum(f) AS s3|sum(d) AS s4|avg(i) AS s5|avg(d) AS s6|count(*) AS s7|count(DISTINCT s) AS s8|min(s) AS s9|max(t) AS t1|collect_list(d) AS t2|stddev(f) AS t3|sum(i) FILTER (WHERE l > 2) AS t4|sum(d * d) AS t5|max_by(s, l) AS t6|first(q) AS t7|sum(i) / count(*) AS t8|approx_count_distinct(s) AS t9"
WINDOWS = "i|row_number() OVER (PARTITION BY i ORDER BY l) AS w1|rank() OVER (PARTITION BY i ORDER BY l) AS w2|sum(d) OVER (PARTITION BY i) AS w3|lag(s) OVER (PARTITION BY i ORDER BY l) AS w4|percent_rank() OVER (PARTITION BY i ORDER BY l) AS w5|avg(f) OVER (PARTITION BY i) AS w6"


@pytest.mark.parametrize("query", [EXPRESSIONS, f"i|{AGGREGATES}", WINDOWS, "i|explode(p) AS x", "*|count(*) OVER (PARTITION BY i) AS w"], ids=["expressions", "aggregates", "windows", "generator", "added window"])
def test_types_of_expressions(spark, query):
    """Types read off the printed plan of a query written to another catalog, against those Spark gives it."""
    root = tempfile.mkdtemp(prefix="lakeledger-types-")
    rich = "int(id) i, id l, double(id) f, cast(id AS decimal(10, 2)) d, string(id) s, timestamp_seconds(id) t, array(named_struct('x', int(id))) p, map('k', id) m, named_struct('x', int(id), 'y', named_struct('z', string(id))) q"
    spark.sql(f"SELECT {rich} FROM range(5)").write.parquet(f"{root}/rich")
    spark.read.parquet(f"{root}/rich").createOrReplaceTempView("rich")
    columns = query.replace("\n", "|").replace("|", ", ")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    df = spark.sql(f"SELECT {columns} FROM rich" + (" GROUP BY i" if query.endswith(AGGREGATES) else ""))
    text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    tree, rest = text.split("\n\n\n", 1)
    first, *lines = tree.split("\n")[1:]
    tree = "\n".join(["== Physical Plan ==", "AppendData (999)", f"+- {first}", *[f"   {x}" for x in lines]])
    text = f"{tree}\n\n\n{rest.rstrip()}\n\n(999) AppendData\nArguments: org.apache.X@1, `cat`.`db`.`target`\n"
    [row] = pl.query_schemas(plan(spark, text)).filter("side = 'write'").collect()
    assert [(f.name, f.type) for f in row.fields] == [(f.name, f.dataType.simpleString()) for f in df.schema]


def test_types_of_deep_and_broken_texts():
    deep = "(" * 20_000 + "a#1" + " + 1)" * 20_000
    assert type_of(deep, {1: "int"}) == "int"
    assert [type_of(x, {1: "int"}) for x in ("", "a#2", "abc", "f(a#1", "a#1)", "CASE WHEN (a#1", "unheard_of(a#1)")] == [None] * 7
    assert types_of([3], {1: "int"}, {3: ["b#2 AS x"], 2: ["c#3"]})[3] is None  # a circle
    assert types_of([40_000], {0: "date"}, {i: [f"a#{i - 1}"] for i in range(1, 40_001)})[40_000] == "date"


def test_run_metrics(tables, nodes):
    r = rm.job_runs(tables, pl.query_outputs(nodes)).first()
    assert r.partition_key == "GLOBAL" and r.rows_written >= 30 + 20 + 50 + 50 + 60 + 18 + 3 + 50 + 20
    assert r.executor_count is None  # in local mode all tasks run in the driver
    assert r.total_tasks > 0


def test_failed_queries_can_be_told(tables):
    errors = [r.error for r in tables["sql_end"].collect()]
    assert errors.count(None) >= 10 and any(errors)


@pytest.mark.parametrize("parts", [1, 4])
def test_a_log_in_several_files_is_one_application(spark, tables, nodes, parts):
    root = tempfile.mkdtemp(prefix="lakeledger-cut-")
    lines = [r.value for r in tables.lines.collect()]
    folder = root if parts == 1 else os.path.join(root, "eventlog_v2_app-1")
    os.makedirs(folder, exist_ok=True)
    for k in range(parts):
        with open(os.path.join(folder, f"events_{k + 1}_app-1"), "w") as f:
            f.write("\n".join(lines[k::parts]) + "\n")
    t = event_tables(read_event_log(spark, root))
    n = pl.plan_nodes(t["sql"])
    assert t["apps"].count() == 1 and table_edges(n) == table_edges(nodes)
    pick = lambda x, m: x.select("app_id", "status", "rows_written", "total_tasks", "execution_time_ms").collect()  # noqa: E731, ARG005
    assert pick(rm.job_runs(t, pl.query_outputs(n)), 0) == pick(rm.job_runs(tables, pl.query_outputs(nodes)), 0)


def plan(spark, text):
    return pl.plan_nodes(spark.createDataFrame([("l", 1, 1, text)], "log_id string, root_execution_id bigint, execution_id bigint, plan_text string").withColumn("started_at", F.lit(0).cast("timestamp")))


def test_writes_into_another_catalog_have_columns(spark):
    text = """== Physical Plan ==
AppendData (3)
+- * Project (2)
   +- Scan parquet spark_catalog.default.src (1)


(1) Scan parquet spark_catalog.default.src
Output [2]: [a#1, b#2L]
Location: InMemoryFileIndex [file:/wh/src]
ReadSchema: struct<a:int,b:bigint>

(2) Project [codegen id : 1]
Output [2]: [a#1, (b#2L + 1) AS c#3L]
Input [2]: [a#1, b#2L]

(3) AppendData
Arguments: org.apache.X@1, `cat`.`db`.`target`
"""
    got = {(r.source_dataset, r.source_column, r.target_dataset, r.target_column, r.transform_type) for r in pl.column_edges(plan(spark, text)).collect()}
    assert got == {("src", "a", "target", "a", "DIRECT"), ("src", "b", "target", "c", "EXPRESSION")}


def test_long_alias_chains_and_long_expressions(spark):
    n = 30
    long = " + ".join(["a#1"] * 1500)
    tree = "\n".join(["== Physical Plan ==", f"Execute InsertIntoHadoopFsRelationCommand ({n + 3})", f"+- WriteFiles ({n + 2})"] + [f"{'   ' * (k + 1)}+- Project ({n + 1 - k})" for k in range(n)] + [f"{'   ' * (n + 1)}+- Scan parquet (1)"])
    parts = ["(1) Scan parquet\nOutput [1]: [a#1]\nLocation: InMemoryFileIndex [file:/wh/src]\nReadSchema: struct<a:int>"]
    for k in range(n):
        body = f"({long}) AS x0#2" if k == 0 else f"x{k - 1}#{k + 1} AS x{k}#{k + 2}"
        more = f", (({long}) + 7) AS y#500" if k == 0 else ", y#500"
        parts.append(f"({k + 2}) Project\nOutput [2]: [{body}{more}]\nInput [1]: [a#1]")
    parts.append(f"({n + 2}) WriteFiles\nInput [2]: [x{n - 1}#{n + 1}, y#500]")
    parts.append(f"({n + 3}) Execute InsertIntoHadoopFsRelationCommand\nInput: []\nArguments: file:/wh/out, false, Parquet, [path=file:/wh/out], Overwrite, [x, y]")
    got = {r.target_column: r for r in pl.column_edges(plan(spark, tree + "\n\n\n" + "\n\n".join(parts) + "\n")).collect()}
    assert set(got) == {f"x{n - 1}", "y"} and all(r.source_column == "a" and r.transform_type == "EXPRESSION" for r in got.values())
    assert len(got["y"].expression) > 3000 and got["y"].expression.endswith("+ 7)")
