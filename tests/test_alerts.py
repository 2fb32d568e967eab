"""Rule matching and repeat suppression."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lakeledger.operators import alerts as al

T0 = dt.datetime(2024, 1, 1)
RULES = [
    (1, "o1", None, None, None, True), (2, "o1", "*", None, None, True), (3, "o1", "sales_*", None, None, True), (4, "o1", "sales_eu", None, None, True),
    (5, "o1", None, "RowCountDrop", None, True), (6, "o1", None, None, "CRITICAL", True), (7, "o1", None, None, None, False),
    (8, "o2", None, None, None, True), (9, None, "sales_eu", None, None, True), (10, "o1", "", None, None, True), (11, "o1", "sales", None, None, True),
]


def test_matching(spark):
    rules = spark.createDataFrame(RULES, "rule_id int, org_id string, dataset_pattern string, anomaly_type string, severity string, enabled boolean")
    a = spark.createDataFrame(
        [(1, "o1", "sales_eu", "RowCountSpike", "WARNING"), (2, "o1", "hr", "RowCountDrop", "CRITICAL"), (3, "o2", "sales_eu", "VolumeDrop", "CRITICAL")],
        "anomaly_id bigint, org_id string, dataset string, anomaly_type string, severity string",
    )
    got = {}
    for r in al.match_rules(a, rules).collect():
        got.setdefault(r.anomaly_id, set()).add(r.rule_id)
    assert got == {1: {1, 2, 3, 4, 9, 10}, 2: {1, 2, 5, 6, 10}, 3: {8, 9}}
    exact = {(r.anomaly_id, r.rule_id) for r in al.match_rules(a, rules, wildcard=False).collect()}
    assert (1, 3) not in exact and (1, 4) in exact and (1, 1) in exact
    none = spark.createDataFrame(RULES[3:4], rules.schema)
    assert {r.anomaly_id for r in al.unmatched_anomalies(a, none).collect()} == {2, 3}


def matches(spark, rows):
    return spark.createDataFrame(rows, "rule_id int, org_id string, dataset string, anomaly_type string, detected_at timestamp, anomaly_id bigint, deduplication_minutes int")


def test_sixty_minutes(spark):
    rows = [(1, "o", "d", "T", T0 + dt.timedelta(minutes=m), m, 60) for m in (0, 30, 59, 61, 90)]
    got = {r.anomaly_id: r.status for r in al.dedup_alerts(matches(spark, rows)).collect()}
    assert got == {0: "SENT", 30: "DEDUPLICATED", 59: "DEDUPLICATED", 61: "SENT", 90: "DEDUPLICATED"}


@pytest.mark.parametrize("seed", range(3))
def test_against_one_by_one(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(3000):
        hot = rnd.random() < 0.6
        minutes = rnd.randrange(0, 60 * 24 * 40) if rnd.random() < 0.8 else rnd.randrange(0, 600)
        rule = 1 if hot else rnd.randrange(2, 6)
        rows.append((rule, rnd.choice(["o", None]) if not hot else "o", "d", "T", T0 + dt.timedelta(minutes=minutes), i, [60, 60, 7, None, 0, 1440][rule]))
    last, want = {}, {}
    for r in sorted(rows, key=lambda r: (r[4], r[5])):
        g, w = r[:4], dt.timedelta(minutes=60 if r[6] is None else r[6])
        if g not in last or r[4] - last[g] >= w:
            last[g], want[r[5]] = r[4], "SENT"
        else:
            want[r[5]] = "DEDUPLICATED"
    got = {r.anomaly_id: r.status for r in al.dedup_alerts(matches(spark, rows)).collect()}
    assert got == want


def test_one_group_of_very_many_times(spark):
    n, w = 200_000, 60_000_000
    times = spark.range(n).select(F.lit(1).alias("rule_id"), F.lit("o").alias("org_id"), F.lit("d").alias("dataset"), F.lit("T").alias("anomaly_type"),
        F.timestamp_micros(F.col("id") * 700_000 + F.pmod(F.col("id") * F.col("id"), F.lit(97)) * 5_000).alias("detected_at"), F.col("id").alias("anomaly_id"), F.lit(1).alias("deduplication_minutes"))
    got = sorted(r.t for r in al.dedup_alerts(times).filter("status = 'SENT'").select(F.unix_micros("detected_at").alias("t")).collect())
    want, last = [], None
    for t in sorted(i * 700_000 + i * i % 97 * 5_000 for i in range(n)):
        if last is None or t >= last + w:
            want.append(t)
            last = t
    assert got == want


def test_outbox_and_status(spark):
    d = matches(spark, [(1, "o", "d", "T", T0, 5, 60)]).withColumns(
        {"status": F.lit("SENT"), "severity": F.lit("WARNING"), "channel_type": F.lit("email"), "subject_template": F.lit("{severity}: {dataset_name}/{anomaly_type}")}
    )
    r = al.alert_outbox(d).first()
    assert (r.status, r.subject) == ("PENDING", "WARNING: d/T")
    a = spark.createDataFrame([(5, "OPEN"), (6, "OPEN"), (7, "RESOLVED")], "anomaly_id bigint, status string")
    h = spark.createDataFrame([(5, "SENT"), (6, "FAILED"), (7, "SENT")], "anomaly_id bigint, status string")
    assert {r.anomaly_id: r.status for r in al.apply_alert_status(a, h).collect()} == {5: "ALERTED", 6: "OPEN", 7: "RESOLVED"}
