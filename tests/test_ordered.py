"""Blocked running sums, neighbours and as-of lookups against plain Python, with a hot key."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeledger.operators import ordered as od

T0 = dt.datetime(2024, 1, 1)


def rows(seed, n=400):
    rnd = random.Random(seed)
    return [("hot" if rnd.random() < 0.5 else rnd.choice("abc"), T0 + dt.timedelta(minutes=rnd.randrange(20000)), i, rnd.choice([None, rnd.randrange(100)])) for i in range(n)]


@pytest.mark.parametrize("width", [3_600_000_000, (600_000_000, 7_200_000_000, 86_400_000_000)])
def test_running_sums(spark, width):
    data = rows(1)
    df = spark.createDataFrame(data, "k string, ts timestamp, id int, x bigint")
    got = {r.id: r.x for r in od.running_sums(df, ["k"], "ts", ["id"], ["x"], block_us=width).collect()}
    for k, ts, i, _ in data:
        assert got[i] == sum(x or 0 for k2, t2, i2, x in data if k2 == k and (t2, i2) <= (ts, i))


def test_neighbours(spark):
    data = rows(2)
    df = spark.createDataFrame(data, "k string, ts timestamp, id int, x bigint")
    prev = {r.id: r.p for r in od.carried(df, ["k"], "ts", ["id"], "x", "p", block_us=3_600_000_000).collect()}
    nxt = {r.id: r.p for r in od.carried(df, ["k"], "ts", ["id"], "x", "p", forward=True, block_us=3_600_000_000).collect()}
    for k, ts, i, _ in data:
        same = sorted((t, j, x) for k2, t, j, x in data if k2 == k and x is not None)
        before = [x for t, j, x in same if (t, j) < (ts, i)]
        after = [x for t, j, x in same if (t, j) > (ts, i)]
        assert prev[i] == (before[-1] if before else None)
        assert nxt[i] == (after[0] if after else None)


def test_as_of(spark):
    facts = [(k, t, i) for k, t, i, _ in rows(3, 80)]
    probes = rows(4, 200)
    f = spark.createDataFrame(facts, "k string, fts timestamp, v int")
    p = spark.createDataFrame([(k, t, i) for k, t, i, _ in probes], "k string, pts timestamp, id int")
    got = {r.id: r.v for r in od.as_of(p, f, ["k"], "pts", "fts", "v", block_us=3_600_000_000).collect()}
    for k, t, i, _ in probes:
        latest = max((ft for fk, ft, _ in facts if fk == k and ft <= t), default=None)
        assert (got[i] is None) if latest is None else (got[i] in {v for fk, ft, v in facts if fk == k and ft == latest})


def test_trailing_sums_keep_null_keys_apart(spark):
    df = spark.createDataFrame([(None, T0, 1), (None, T0 + dt.timedelta(days=1), 2), ("a", T0, 5)], "k string, ts timestamp, x bigint")
    got = {(r.k, r.ts): r.x for r in od.trailing_sums(df, ["k"], "ts", ["x"], 86_400_000_000).collect()}
    assert got == {(None, T0): 1, (None, T0 + dt.timedelta(days=1)): 2, ("a", T0): 5}


def test_neighbours_and_numbers(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", None]), T0 + dt.timedelta(hours=rnd.randrange(0, 500)), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, i int")
    got = {r.i: (r.number, r.previous, r.following) for r in od.neighbours(df, ["k"], "ts", ["i"], "i").collect()}
    for key in ("a", None):
        line = [r[2] for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))]
        for n, i in enumerate(line):
            assert got[i] == (n + 1, line[n - 1] if n else None, line[n + 1] if n + 1 < len(line) else None)


def test_quantiles_equal_percentile(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([None, 0, -3, 5, rnd.randrange(-10**12, 10**12), rnd.randrange(0, 2000)])) for _ in range(3000)] + [("one", 7), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v bigint")
    shares = {"low": 0.05, "mid": 0.5, "high": 0.97, "least": 0.0, "most": 1.0}
    got = {r.k: r.asDict() for r in od.quantiles(df, ["k"], "v", shares).collect()}
    want = {r.k: r.asDict() for r in df.filter("v IS NOT NULL").groupBy("k").agg(*[F.percentile("v", F.lit(q)).alias(n) for n, q in shares.items()]).collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        assert all(abs(got[k][n] - w[n]) <= 1e-9 * max(1, abs(w[n])) for n in shares), (k, got[k], w)


@pytest.mark.parametrize("forward", [False, True])
def test_several_widths_carry_the_same(spark, forward):
    df = spark.createDataFrame(rows(11), "k string, ts timestamp, i int, v int")
    one = od.carried(df, ["k"], "ts", ["i"], "v", "out", forward=forward)
    many = od.carried(df, ["k"], "ts", ["i"], "v", "out", forward=forward, block_us=(60_000_000, 7_200_000_000, 5 * od.DAY_US))
    assert sorted(map(repr, one.collect())) == sorted(map(repr, many.collect()))


def test_quantiles_of_values_that_lie_close_together(spark):
    """200,000 distinct values near 10^12, one far away, and a constant key: no bucket holds more than a few hundred."""
    near = spark.range(200_000).select(F.lit("near").alias("k"), (F.lit(10**12) + F.col("id") * 3).alias("v"))
    df = near.unionByName(spark.createDataFrame([("near", -5), ("flat", 7), ("flat", 7), ("none", None)], "k string, v bigint"))
    got = {r.k: (r.low, r.mid, r.top) for r in od.quantiles(df, ["k"], "v", {"low": 0.0, "mid": 0.5, "top": 0.99}).collect()}
    values = [-5.0, *[float(10**12 + 3 * i) for i in range(200_000)]]
    at = 0.99 * (len(values) - 1)
    assert got["flat"] == (7.0, 7.0, 7.0) and set(got) == {"near", "flat"}
    assert got["near"][:2] == (-5.0, values[100_000]) and abs(got["near"][2] - (values[int(at)] + (at % 1) * 3)) < 1e-3
    counts = df.filter("v IS NOT NULL").groupBy("k", F.col("v").alias("_v")).agg(F.count("*").alias("_n"))
    wanted = [F.struct(F.lit("mid").alias("name"), F.floor((F.col("_all") - 1) * 0.5).cast("bigint").alias("rank"))]
    kept, _ = od.ranked_buckets(counts, ["k"], wanted)
    assert kept.groupBy("k", "_b").count().agg(F.max("count")).first()[0] < 500


@pytest.fixture
def many_parts(spark):
    """Sixteen ranges, none of them merged."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield 16
    for k, v in kept.items():
        spark.conf.set(k, v)


def test_a_hot_second_is_cut_by_its_rows(spark, many_parts):
    """Half of the rows are one key's in one second, a fifth of them at one moment: every block holds its share."""
    n = 40_000
    at = F.when(F.col("id") % 5 == 0, F.lit(0)).otherwise(F.col("id") * 7 % 1_000_000)
    hot = spark.range(n).select(F.lit("hot").alias("k"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + at).alias("ts"), "id")
    rest = spark.range(n, 2 * n).select(F.concat(F.lit("k"), (F.col("id") % 500).cast("string")).alias("k"), F.timestamp_micros(F.col("id") * 4_320_000_000).alias("ts"), "id")
    df = hot.unionByName(rest).withColumn("x", F.col("id") % 13)
    cut = od.cut_by_rows(df, ["k"], "ts", ["id"])
    blocks = cut.groupBy("_blk").count().collect()
    assert len(blocks) == many_parts and max(r["count"] for r in blocks) < 2 * 2 * n / many_parts
    spans = cut.filter("k = 'hot'").groupBy("_blk").agg(F.min(F.struct("ts", "id")).alias("a"), F.max(F.struct("ts", "id")).alias("z")).orderBy("_blk").collect()
    assert len(spans) >= 6 and all(a.z < b.a for a, b in zip(spans, spans[1:]))
    by_key = Window.partitionBy("k").orderBy("ts", "id")
    upto = by_key.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("id", F.sum("x").over(upto).alias("s"), F.row_number().over(by_key).cast("bigint").alias("n"), F.lag("x").over(by_key).alias("p"), F.lead("x").over(by_key).alias("f"))
    got = od.running_sums(df, ["k"], "ts", ["id"], ["x"]).select("id", F.col("x").alias("s"))
    got = got.join(od.neighbours(df, ["k"], "ts", ["id"], "x").select("id", F.col("number").alias("n"), F.col("previous").alias("p"), F.col("following").alias("f")), "id")
    assert got.count() == 2 * n and not got.exceptAll(want).limit(1).count()


@pytest.mark.parametrize("forward", [False, True])
def test_ranges_carry_like_widths(spark, many_parts, forward):
    df = spark.createDataFrame([*rows(12), *((None, t, i + 1000, v) for _, t, i, v in rows(13))], "k string, ts timestamp, i int, v int")
    df = df.unionByName(spark.createDataFrame([("a", None, 5000, 3), ("a", None, 5001, None)], df.schema))
    by_rows = od.carried(df, ["k"], "ts", ["i"], "v", "out", forward=forward)
    by_width = od.carried(df, ["k"], "ts", ["i"], "v", "out", forward=forward, block_us=3_600_000_000)
    assert sorted(map(repr, by_rows.collect())) == sorted(map(repr, by_width.collect()))


def test_ranges_of_an_empty_table(spark, many_parts):
    df = spark.createDataFrame([], "k string, ts timestamp, i int, v int")
    assert od.neighbours(df, ["k"], "ts", ["i"], "v").count() == od.carried(df, ["k"], "ts", ["i"], "v", "out").count() == od.running_sums(df, ["k"], "ts", ["i"], ["v"]).count() == 0
