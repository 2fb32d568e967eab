"""Load anomalies: worked cases, border rows, and the windowed form against the self-join."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lakeledger.operators import anomalies as an

SCHEMA = "org_id string, dataset string, job_id string, job_name string, partition_key string, ts timestamp, row_count bigint, byte_size bigint"
T0 = dt.datetime(2024, 1, 1)


def load(spark, counts, now, *, part=None, job="j", ids=None, step=dt.timedelta(days=1), dataset="d", last_part=None):
    rows = []
    for i, c in enumerate(counts):
        rows.append(("o", dataset, ids[i] if ids else f"r{i}", job, part, T0 + i * step, c, c * 10))
    rows.append(("o", dataset, "now", job, last_part or part, T0 + len(counts) * step, now, now * 10))
    return spark.createDataFrame(rows, SCHEMA)


def found(df, **kw):
    return {(r.ts, r.anomaly_type): r for r in an.detect_row_count_anomalies(df, **kw).collect() if r.job_id == "now"}


def test_spike_inside_own_history(spark):
    hits = found(load(spark, [100] * 15, 1000), exclude_own_job=False)
    (r,) = hits.values()
    assert (r.anomaly_type, r.severity, r.expected_value) == ("RowCountSpike", "WARNING", 156.25)
    stats = an.history_stats(load(spark, [100] * 15, 1000), exclude_own_job=False).filter("job_id = 'now'").first()
    assert stats.std_row_count == pytest.approx(225.0)


def test_short_history_with_itself_hides_the_spike(spark):
    assert not found(load(spark, [100] * 5, 1000), exclude_own_job=False)


def test_zero_variance_flags_any_change_B6_B7(spark):
    (r,) = found(load(spark, [100] * 5, 1000)).values()
    assert r.deviation == 9.0 and r.expected_value == 100.0
    assert r.message == "Row count spike for job 'j': 1000 (Expected ~100, >3.0σ)"


def test_four_points_are_too_few(spark):
    assert not found(load(spark, [100] * 4, 100000))


def test_drop_is_critical(spark):
    (r,) = found(load(spark, [98, 99, 100, 101, 102] * 3, 10)).values()
    assert (r.anomaly_type, r.severity) == ("RowCountDrop", "CRITICAL")


def test_partition_judged_only_against_itself(spark):
    us = load(spark, [100000] * 6, 100000, part="country=US")
    inn = load(spark, [9900, 10000, 10100] * 3, 15000, part="country=IN")
    r = [x for x in an.detect_row_count_anomalies(us.unionByName(inn)).collect() if x.scope_value == "country=IN" and x.job_id == "now"]
    assert len(r) == 1 and r[0].anomaly_type == "RowCountSpike"
    assert " in partition 'country=IN'" in r[0].message


def test_history_without_job_id_does_not_count(spark):
    assert not found(load(spark, [100] * 6, 1000, ids=[None] * 6))


def test_row_exactly_thirty_days_old_is_out(spark):
    df = load(spark, [100] * 5, 1000, step=dt.timedelta(days=6))
    s = an.history_stats(df).filter("job_id = 'now'").first()
    assert s.hist_count == 4


def test_half_drop_rule_is_off_by_default_B8(spark):
    df = load(spark, [50, 150] * 8, 45)
    assert not found(df)
    assert len(found(df, drop_ratio=0.5)) == 1


def test_measure_without_values_is_skipped_B32(spark):
    df = load(spark, [100] * 6, 1000).withColumn("byte_size", F.when(F.col("job_id") == "now", F.col("byte_size")))
    kinds = {r.anomaly_type for r in an.detect(df).filter("job_id = 'now'").collect()}
    assert kinds == {"RowCountSpike"}


def test_deviation_without_mean(spark):
    (r,) = found(load(spark, [0] * 6, 7)).values()
    assert r.deviation == 1.0


@pytest.mark.parametrize("seed", [1, 2])
def test_window_form_equals_self_join(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(600):
        hot = rnd.random() < 0.4
        rows.append(
            (
                "o", "hot" if hot else f"d{rnd.randrange(4)}", rnd.choice([None, *[f"job{k}" for k in range(30)]]),
                rnd.choice([None, "", "a", "b"]), rnd.choice([None, "", "UNKNOWN", "p=1", "p=2"]),
                T0 + dt.timedelta(hours=rnd.randrange(0, 24 * 70)), rnd.choice([None, rnd.randrange(10**12)]), rnd.randrange(10**6),
            )
        )
    m = spark.createDataFrame(rows, SCHEMA)
    key = lambda r: tuple(str(v) for v in r[:10])
    a = sorted(an.history_stats(m, block_us=3_600_000_000 * 7).collect(), key=key)
    b = sorted(an.history_stats_by_join(m).collect(), key=key)
    assert len(a) == len(b) == 600
    for x, y in zip(a, b):
        assert x.hist_count == y.hist_count
        for c in ("mean_row_count", "std_row_count", "mean_byte_size", "std_byte_size"):
            assert (x[c] is None) == (y[c] is None)
            if x[c] is not None:
                assert x[c] == pytest.approx(y[c], rel=1e-9, abs=1e-6)
