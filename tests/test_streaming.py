"""Stateful freshness and retried batches."""

import datetime as dt

import pytest

from lakeledger.runtime import scratch
from lakeledger.streaming import facts as fa
from lakeledger.streaming import windows as wi

T0 = dt.datetime(2024, 1, 1)


def test_freshness_breach_is_reported_once(spark):
    root = scratch(spark, "fresh")
    schema = "org_id string, dataset string, ts timestamp"
    hours = [("late", 0), ("late", 1), ("good", 0), ("good", 3), ("good", 6), ("good", 9)]
    for i, part in enumerate((hours[:3], hours[3:5], hours[5:])):
        spark.createDataFrame([("o", d, T0 + dt.timedelta(hours=h)) for d, h in part], schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
    slas = spark.createDataFrame([("o", "late", 2), ("o", "good", 4)], "org_id string, dataset string, sla_hours int")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    out = wi.stream_freshness(src, slas)
    fa.run_available(out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/cp").outputMode("append"))
    got = spark.read.schema(out.schema).parquet(f"{root}/out").collect()
    assert [(r.dataset, r.last_updated, r.sla_hours) for r in got] == [("late", T0 + dt.timedelta(hours=1), 2)]


@pytest.mark.parametrize("cuts", [[], [1], [1, 2, 3]])
def test_every_gap_is_reported_however_updates_arrive(spark, cuts):
    root = scratch(spark, "gaps")
    schema = "org_id string, dataset string, ts timestamp"
    rows = [("o", d, T0 + dt.timedelta(hours=h)) for h, d in sorted([(0, "a"), (0, "b"), (10, "a"), (30, "b")])]
    slas = spark.createDataFrame([("o", "a", 2), ("o", "b", 2), ("o", "b", 5)], "org_id string, dataset string, sla_hours int")
    for lo, hi in zip([0, *cuts], [*cuts, len(rows)]):
        spark.createDataFrame(rows[lo:hi], schema).write.mode("append").parquet(f"{root}/in")
        out = wi.stream_freshness(spark.readStream.schema(schema).parquet(f"{root}/in"), slas, "1 minute")
        fa.run_available(out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/cp").outputMode("append"))
    got = sorted((r.dataset, (r.last_updated - T0).seconds // 3600) for r in spark.read.parquet(f"{root}/out").collect())
    assert got == [("a", 0), ("a", 10), ("b", 0)]


@pytest.mark.parametrize("ids", [("x-5", "x7", "x9", "x11"), (-5, 7, 9, 11)])
def test_alerts_keep_ids_of_any_kind(spark, ids):
    root = scratch(spark, "ids")
    kind = "string" if isinstance(ids[0], str) else "bigint"
    schema = f"rule_id int, org_id string, dataset string, anomaly_type string, detected_at timestamp, anomaly_id {kind}, deduplication_minutes int"
    rows = [(1, "o", "d", "T", T0 + dt.timedelta(minutes=m), i, 60) for m, i in zip((0, 30, 70, 10), ids)]
    for part in (rows[:1], rows[1:3], rows[3:]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{root}/in")
        fa.run_available(fa.stream_dedup(spark.readStream.schema(schema).parquet(f"{root}/in"), root))
    got = {r.anomaly_id: r.status for r in spark.read.parquet(f"{root}/alerts").collect()}
    assert got == dict(zip(ids, ("SENT", "DEDUPLICATED", "SENT", "LATE")))


def test_versions_in_any_order_and_after_empty_batches(spark):
    root = scratch(spark, "versions")
    schema = "org_id string, received_at timestamp, value string"
    text = lambda kind: '{"job_id": "j", "schemas": [{"dataset_name": "d", "version_hash": "h", "fields": [{"name": "a", "data_type": "%s", "nullable": true}]}]}' % kind
    batches = [[("o", T0, "unreadable")], [("o", T0 + dt.timedelta(hours=3), text("int")), ("o", T0 + dt.timedelta(hours=5), text("string"))], [("o", T0, "x")], [("o", T0 + dt.timedelta(hours=1), text("int")), ("o", T0 + dt.timedelta(hours=9), text("int"))]]
    for rows in batches:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{root}/in")
        fa.run_available(fa.stream_schema_versions(spark.readStream.schema(schema).parquet(f"{root}/in"), root))
    got = sorted((r.valid_from, r.fields[0].type, r.valid_to) for r in fa.read_versions(spark, root).collect())
    assert got == [(T0 + dt.timedelta(hours=1), "int", T0 + dt.timedelta(hours=5)), (T0 + dt.timedelta(hours=5), "string", None)]
    assert spark.read.parquet(f"{root}/versions").count() == 3


def test_a_batch_run_twice_leaves_its_rows_once(spark):
    root = scratch(spark, "twice")
    df = spark.createDataFrame([(1,), (2,)], "x int")
    fa._write(df, root, "t", 0)
    fa._write(df, root, "t", 0)
    assert spark.read.parquet(f"{root}/t").count() == 2
