"""Running sums, neighbours and as-of lookups along time that no hot key can clog.

A plain window hands every row of one key to one task. Here a key's timeline is
cut into blocks: the window runs inside (key, block), and only one summary row per
block is carried along the key. The blocks are ranges of (key, time, order) that Spark
cuts from a sample of the rows, so each holds about as many rows as the next, however
many a key has in a second. Callers who know the spread of their times may give widths instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeledger.runtime import checkpoint

DAY_US = 86_400_000_000
#: Microseconds a block, one width or several from fine to coarse; None: blocks cut by the rows.
Blocks = int | tuple[int, ...] | None


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join in which NULL keys meet; the right copies of the keys are dropped."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(r[f"_r_{k}"]) for k in keys])
    out = left.join(r, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"_r_{k}" for k in keys])


def cut_by_rows(df: DataFrame, keys: list[str], ts: str, order: list[str], parts: int | None = None) -> DataFrame:
    """``df`` as a written table with ``_blk``: the range of (keys, ts, order) that a row lies in.

    Ranges ascend along each key and rows of one place lie in one range. There are ``parts`` of them, or as
    many as the session has shuffle partitions; a key without many rows lies in one or two.
    """
    place = [F.col(c) for c in dict.fromkeys([*keys, ts, *order])]
    ranges = df.repartitionByRange(*place) if parts is None else df.repartitionByRange(parts, *place)
    return checkpoint(ranges.withColumn("_blk", F.spark_partition_id().cast("bigint")))


def _blocked(df: DataFrame, keys: list[str], ts: str, order: list[str], block_us: Blocks) -> tuple[DataFrame, tuple[int, ...]]:
    """``df`` with ``_blk``, and the given widths."""
    if block_us is None:
        return cut_by_rows(df, keys, ts, order), ()
    widths = (block_us,) if isinstance(block_us, int) else tuple(block_us)
    return df.withColumn("_blk", F.floor(F.unix_micros(F.col(ts)) / F.lit(widths[0])).cast("bigint")), widths


def running_sums(
    df: DataFrame,
    keys: list[str],
    ts: str,
    order: list[str],
    measures: list[str],
    block_us: Blocks = None,
) -> DataFrame:
    """Replace each measure by its running sum per key in (ts, *order) order, row included.

    Of widths from fine to coarse, such as ``(1_000_000, 3_600_000_000)``, seconds are summed up along
    hours, hours along the key.
    """
    b, widths = _blocked(df, keys, ts, order, block_us)
    bk = [*keys, "_blk"]
    inner = Window.partitionBy(*bk).orderBy(ts, *order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    totals = b.groupBy(*bk).agg(*[F.coalesce(F.sum(m), F.lit(0)).cast(df.schema[m].dataType).alias(f"_t_{m}") for m in measures])
    if len(widths) > 1:
        t = totals.select("*", F.timestamp_micros(F.col("_blk") * widths[0]).alias("_at"), *[F.col(f"_t_{m}").alias(f"_o_{m}") for m in measures])
        t = t.withColumnRenamed("_blk", "_no")
        run = running_sums(t, keys, "_at", [], [f"_t_{m}" for m in measures], widths[1:])
        carry = run.select(*keys, F.col("_no").alias("_blk"), *[(F.col(f"_t_{m}") - F.col(f"_o_{m}")).alias(f"_c_{m}") for m in measures])
    else:
        carry = totals.select(*bk, *[F.sum(f"_t_{m}").over(before).alias(f"_c_{m}") for m in measures])
    x = b.select(
        *[c for c in b.columns if c not in measures],
        *[F.sum(m).over(inner).alias(m) for m in measures],
    )
    zero = {m: F.lit(0).cast(df.schema[m].dataType) for m in measures}
    return join_null_safe(x, carry, bk).select(
        *[c for c in df.columns if c not in measures],
        *[
            (F.coalesce(F.col(m), zero[m]) + F.coalesce(F.col(f"_c_{m}"), zero[m]))
            .cast(df.schema[m].dataType)
            .alias(m)
            for m in measures
        ],
    )


def trailing_sums(
    points: DataFrame,
    keys: list[str],
    ts: str,
    measures: list[str],
    span_us: int,
    block_us: Blocks = None,
) -> DataFrame:
    """Sums over ``(t - span, t]`` at the time ``t`` of every point.

    ``points`` holds one row per (keys, ts). Each point enters at its time and
    leaves ``span`` later, so the sliding sum is one running sum over both.
    Use exact (integer or decimal) measures: what leaves must cancel what entered.
    """
    types = dict(points.dtypes)

    def event(at: Column, is_point: int, sign: int) -> Column:
        return F.struct(at.alias(ts), F.lit(is_point).alias("_is_point"), *[(sign * F.col(m)).cast(types[m]).alias(m) for m in measures])

    leaves = F.timestamp_micros(F.unix_micros(ts) + F.lit(span_us))
    both = F.array(event(F.col(ts), 1, 1), event(leaves, 0, -1))
    rest = [c for c in points.columns if c not in (ts, *measures)]
    moves = points.select(*rest, F.explode(both).alias("_e")).select(*rest, "_e.*")
    return running_sums(moves, keys, ts, ["_is_point"], measures, block_us).filter("_is_point = 1").drop("_is_point")


def carried(
    df: DataFrame,
    keys: list[str],
    ts: str,
    order: list[str],
    value: str,
    out: str,
    *,
    forward: bool = False,
    include_self: bool = False,
    block_us: Blocks = None,
) -> DataFrame:
    """Add ``out``: the nearest non-null ``value`` before the row (after it if ``forward``)."""
    b, widths = _blocked(df, keys, ts, order, block_us)
    bk = [*keys, "_blk"]
    flip = (lambda c: F.col(c).desc()) if forward else (lambda c: F.col(c).asc())
    inner = (
        Window.partitionBy(*bk)
        .orderBy(*[flip(c) for c in [ts, *order]])
        .rowsBetween(Window.unboundedPreceding, 0 if include_self else -1)
    )
    across = Window.partitionBy(*keys).orderBy(flip("_blk")).rowsBetween(Window.unboundedPreceding, -1)
    pick = F.min_by if forward else F.max_by
    rank = F.when(F.col(value).isNotNull(), F.struct(ts, *order))
    ends = b.groupBy(*bk).agg(pick(value, rank).alias("_t"))
    if len(widths) > 1:
        blocks = ends.select(*keys, F.col("_blk").alias("_no"), F.timestamp_micros(F.col("_blk") * widths[0]).alias("_at"), "_t")
        carry = carried(blocks, keys, "_at", [], "_t", "_c", forward=forward, block_us=widths[1:]).select(*keys, F.col("_no").alias("_blk"), "_c")
    else:
        carry = ends.select(*bk, F.last("_t", ignorenulls=True).over(across).alias("_c"))
    x = b.withColumn("_i", F.last(value, ignorenulls=True).over(inner))
    return join_null_safe(x, carry, bk).select(*df.columns, F.coalesce("_i", "_c").alias(out))


def neighbours(df: DataFrame, keys: list[str], ts: str, order: list[str], value: str) -> DataFrame:
    """Add ``number`` (from 1 along the key), ``previous`` and ``following`` ``value`` of each row, in one pass."""
    b = cut_by_rows(df, keys, ts, order)
    bk = [*keys, "_blk"]
    inner = Window.partitionBy(*bk).orderBy(ts, *order)
    across = Window.partitionBy(*keys).orderBy("_blk")
    rank = F.struct(ts, *order)
    s = b.groupBy(*bk).agg(F.count("*").alias("_n"), F.min_by(value, rank).alias("_first"), F.max_by(value, rank).alias("_last"))
    s = s.select(*bk, (F.sum("_n").over(across) - F.col("_n")).alias("_base"), F.lag("_last").over(across).alias("_p"), F.lead("_first").over(across).alias("_f"))
    x = b.withColumns({"_i": F.row_number().over(inner), "_l": F.lag(value).over(inner), "_r": F.lead(value).over(inner)})
    out = join_null_safe(x, s, bk)
    return out.select(*df.columns, (F.col("_base") + F.col("_i")).alias("number"), F.coalesce("_l", "_p").alias("previous"), F.coalesce("_r", "_f").alias("following"))


#: Parts into which a bucket that holds a wanted rank is cut, and how often.
PARTS, CUTS = 1_024, 2


def ranked_buckets(counts: DataFrame, keys: list[str], wanted: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Buckets of ``counts(keys, _v, _n)`` that hold a wanted rank: their rows, and the ranks asked of them.

    Values fall into ordered buckets (128 to a power of two); of these, and then of their parts, only those in
    which a wanted rank lies are kept and cut by their own least and greatest value, so that values which
    lie close together do not stay together. ``wanted`` are structs (name, rank) of the number of values ``_all``.
    """
    x = F.col("_v").cast("double")
    # floor draws values of both signs towards zero, so buckets stay in the order of their values
    counts = counts.withColumn("_b", F.array((F.signum(x) * F.floor(F.log2(F.abs(x) + 1) * 128)).cast("int")))
    along = Window.partitionBy(*keys).orderBy("_b")
    sums = counts.groupBy(*keys, "_b").agg(F.sum("_n").alias("_n"))
    sums = sums.select(*keys, "_b", (F.sum("_n").over(along) - F.col("_n")).alias("_before"), F.col("_n").alias("_in"), F.sum("_n").over(Window.partitionBy(*keys)).alias("_all"))
    asked = sums.select("*", F.explode(F.array(*wanted)).alias("w")).filter("w.rank >= _before AND w.rank < _before + _in")
    for _ in range(CUTS):
        kept = join_null_safe(counts, asked.select(*keys, "_b").distinct(), [*keys, "_b"], "left_semi")
        span = kept.groupBy(*keys, "_b").agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
        part = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(PARTS - 1), F.floor((x - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * PARTS).cast("int"))).otherwise(0)
        counts = join_null_safe(kept, span, [*keys, "_b"], "inner").withColumn("_s", part).select(*keys, "_v", "_n", "_b", "_s")
        inside = Window.partitionBy(*keys, "_b").orderBy("_s")
        parts = counts.groupBy(*keys, "_b", "_s").agg(F.sum("_n").alias("_m")).withColumn("_off", F.sum("_m").over(inside) - F.col("_m"))
        start = F.col("_before") + F.col("_off")
        asked = join_null_safe(asked, parts, [*keys, "_b"], "inner").filter((F.col("w.rank") >= start) & (F.col("w.rank") < start + F.col("_m")))
        asked = asked.select(*keys, F.concat("_b", F.array("_s")).alias("_b"), start.alias("_before"), F.col("_m").alias("_in"), "_all", "w")
        counts = counts.withColumn("_b", F.concat("_b", F.array("_s"))).drop("_s")
    return join_null_safe(counts, asked.select(*keys, "_b").distinct(), [*keys, "_b"], "left_semi"), asked


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles of ``value`` per key: one column for each name in ``shares``.

    Values are counted, then ranked by ever smaller buckets; only the last ones in which a wanted rank lies are
    ordered value by value. Null values do not count; a key without values is left out.
    """
    counts = checkpoint(df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n")))
    place = lambda q: (F.col("_all") - 1) * F.lit(q)
    wanted = [F.struct(F.lit(f"{n}_{side}").alias("name"), f(place(q)).cast("bigint").alias("rank")) for n, q in shares.items() for side, f in (("lo", F.floor), ("hi", F.ceil))]
    counts, asked = ranked_buckets(counts, keys, wanted)
    inner = Window.partitionBy(*keys, "_b").orderBy("_v")
    ranked = counts.withColumn("_upto", F.sum("_n").over(inner))
    hits = join_null_safe(asked.select(*keys, "_b", "_before", "_all", "w"), ranked, [*keys, "_b"], "inner")
    at = F.col("w.rank") - F.col("_before")
    hits = hits.filter((at >= F.col("_upto") - F.col("_n")) & (at < F.col("_upto")))
    got = hits.groupBy(*keys).agg(F.first("_all").alias("_all"), *[F.max(F.when(F.col("w.name") == f"{n}_{side}", F.col("_v"))).alias(f"{n}_{side}") for n in shares for side in ("lo", "hi")])
    return got.select(*keys, *[(F.col(f"{n}_lo") + (place(q) - F.floor(place(q))) * (F.col(f"{n}_hi") - F.col(f"{n}_lo"))).cast("double").alias(n) for n, q in shares.items()])


def as_of(
    probes: DataFrame,
    facts: DataFrame,
    keys: list[str],
    probe_ts: str,
    fact_ts: str,
    value: str,
    block_us: Blocks = None,
) -> DataFrame:
    """Add to each probe the ``value`` of the latest fact at or before it (no range join)."""
    p = probes.select(*keys, F.col(probe_ts).alias("_ts"), F.struct(*probes.columns).alias("_probe"))
    f = facts.select(*keys, F.col(fact_ts).alias("_ts"), F.col(value))
    both = f.withColumn("_side", F.lit(0)).unionByName(p.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    got = carried(both, keys, "_ts", ["_side"], value, "_v", block_us=block_us)
    return got.filter("_side = 1").select("_probe.*", F.col("_v").alias(value))
