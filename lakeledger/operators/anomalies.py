"""Abnormal loads: every load judged against its own recent past, all loads in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeledger.functions.units import fmt_bytes, percent_change
from lakeledger.operators.ordered import DAY_US, Blocks, join_null_safe, quantiles, trailing_sums

# Anomaly types and severities by measure and direction.
KINDS = {
    "row_count": {"up": ("RowCountSpike", "WARNING"), "down": ("RowCountDrop", "CRITICAL")},
    "byte_size": {"up": ("VolumeSpike", "WARNING"), "down": ("VolumeDrop", "CRITICAL")},
}

_DEC = "decimal(38,0)"


def with_scope(metrics: DataFrame) -> DataFrame:
    """Add ``scope_kind`` / ``scope_value``: partition, else job name, else whole dataset."""
    part, job = F.col("partition_key"), F.col("job_name")
    use_part = F.coalesce((part != "") & (part != "UNKNOWN"), F.lit(False))
    use_job = F.coalesce(job != "", F.lit(False))
    return metrics.withColumn(
        "scope_kind", F.when(use_part, "partition").when(use_job, "job").otherwise("dataset")
    ).withColumn("scope_value", F.when(use_part, part).when(use_job, job).otherwise(""))


def _moments(points: DataFrame, measures: list[str]) -> list[Column]:
    out = [F.count(F.lit(1)).alias("n")]
    for m in measures:
        x = F.col(m).cast("decimal(19,0)")
        out += [
            F.count(m).alias(f"n_{m}"),
            F.sum(x).cast(_DEC).alias(f"s_{m}"),
            F.sum((x * x).cast(_DEC)).cast(_DEC).alias(f"q_{m}"),
        ]
    return out


def _mean_std(m: str) -> tuple[Column, Column]:
    """Mean and sample deviation out of exact n, sum and sum of squares.

    Squares are re-centred on the rounded mean while still exact, so a constant
    history gives a deviation of exactly 0.
    """
    n, s, q = F.col(f"n_{m}"), F.col(f"s_{m}"), F.col(f"q_{m}")
    mean = F.when(n > 0, s.cast("double") / n)
    mid = F.round(mean).cast("decimal(19,0)").cast(_DEC)
    nd = n.cast(_DEC)
    sq = (q - F.lit(2).cast(_DEC) * mid * s + nd * mid * mid).cast("double")
    off = (s - nd * mid).cast("double")
    var = F.when(n > 1, (sq - off * off / n) / (n - 1))
    return mean, F.when(n > 1, F.sqrt(F.greatest(var, F.lit(0.0))))


def history_stats(
    metrics: DataFrame,
    days: int = 30,
    measures: tuple[str, ...] = ("row_count", "byte_size"),
    exclude_own_job: bool = True,
    block_us: Blocks = None,
) -> DataFrame:
    """Per metric row: size, mean and sample deviation of its scope's last ``days`` days.

    History is ``(ts - days, ts]`` in the row's scope without the rows of the same
    job. A row with a job id does not see rows without one; a row without a job id
    sees every row, itself included.
    """
    ms = list(measures)
    rows = with_scope(metrics)
    named = F.col("job_id").isNotNull() if exclude_own_job else F.lit(False)
    rows = rows.withColumn("audience", F.when(named, "named").otherwise("any"))
    key = ["org_id", "dataset", "scope_kind", "scope_value", "audience"]

    # What a row contributes to: its dataset, its job name and its partition key,
    # kept only where some row is judged in that scope.
    judged_in = rows.select(*key).distinct()
    in_scope = F.filter(
        F.array(
            F.struct(F.lit("dataset").alias("scope_kind"), F.lit("").alias("scope_value")),
            F.struct(F.lit("job").alias("scope_kind"), F.col("job_name").alias("scope_value")),
            F.struct(F.lit("partition").alias("scope_kind"), F.col("partition_key").alias("scope_value")),
        ),
        lambda s: s["scope_value"].isNotNull(),
    )
    seen_by = F.when(named, F.array(F.lit("named"), F.lit("any"))).otherwise(F.array(F.lit("any")))
    points = (
        metrics.select("org_id", "dataset", "job_id", "ts", *ms, F.explode(in_scope).alias("_s"), seen_by.alias("_a"))
        .select("org_id", "dataset", "_s.*", F.explode("_a").alias("audience"), "job_id", "ts", *ms)
        .join(judged_in, key, "left_semi")
    )
    sums = ["n"] + [f"{p}_{m}" for m in ms for p in ("n", "s", "q")]
    whole, own = F.lit("all").alias("part"), F.lit("job").alias("part")
    parts = [F.struct(whole, F.lit(None).cast("string").alias("job_id"))]
    if exclude_own_job:
        # a second copy of each point counts for its own job; what it sums up is taken off again
        parts.append(F.when(F.col("audience") == "named", F.struct(own, F.col("job_id").cast("string").alias("job_id"))))
    split = points.withColumn("_p", F.explode(F.filter(F.array(*parts), lambda p: p.isNotNull()))).drop("job_id").select("*", "_p.*").drop("_p")
    per = split.groupBy(*key, "part", "job_id", "ts").agg(*_moments(split, ms))
    types = {c: "bigint" if c.startswith("n") else _DEC for c in sums}
    per = per.select(*key, "part", "job_id", "ts", *[F.coalesce(F.col(c), F.lit(0)).cast(types[c]).alias(c) for c in sums])
    run = trailing_sums(per, [*key, "part", "job_id"], "ts", sums, days * DAY_US, block_us)
    if exclude_own_job:
        # at one moment of one scope: its total beside the totals of the jobs that ran then
        now = Window.partitionBy(*key, "ts")
        total = F.first(F.when(F.col("part") == "all", F.struct(*sums)), ignorenulls=True).over(now)
        run = run.withColumn("_all", total).filter("part = 'job' OR audience = 'any'")
        run = run.select(*key, "job_id", "ts", *[F.when(F.col("part") == "all", F.col(c)).otherwise(F.col(f"_all.{c}") - F.col(c)).alias(c) for c in sums])
    else:
        run = run.select(*key, F.lit(None).cast("string").alias("job_id"), "ts", *sums)
    rows = rows.withColumn("_job", F.when(F.col("audience") == "named", F.col("job_id").cast("string")))
    out = join_null_safe(rows, run.withColumnRenamed("job_id", "_job"), [*key, "_job", "ts"])
    stats = [F.col("n").alias("hist_count")]
    for m in ms:
        mean, std = _mean_std(m)
        stats += [mean.alias(f"mean_{m}"), std.alias(f"std_{m}")]
    return out.select(*metrics.columns, "scope_kind", "scope_value", *stats)


def history_stats_by_join(metrics: DataFrame, days: int = 30) -> DataFrame:
    """The same numbers as ``history_stats`` by a range self-join, for tables of few loads a scope.

    Time is cut into spans of the history's length: a row's history lies in its own span and the one
    before, so rows meet on (organisation, dataset, span) and the range only filters what has met.
    """
    span = lambda c: F.floor(F.unix_micros(c) / F.lit(days * DAY_US)).cast("bigint")
    own = with_scope(metrics).withColumn("_id", F.monotonically_increasing_id())
    r = own.withColumn("_span", F.explode(F.array(span(F.col("ts")), span(F.col("ts")) - 1))).alias("r")
    h = metrics.withColumn("_span", span(F.col("ts"))).alias("h")
    cond = (
        (F.col("r.org_id") == F.col("h.org_id"))
        & (F.col("r.dataset") == F.col("h.dataset"))
        & (F.col("r._span") == F.col("h._span"))
        & (F.col("h.ts") <= F.col("r.ts"))
        & (F.col("h.ts") > F.col("r.ts") - F.expr(f"INTERVAL {days} DAYS"))
        & (F.col("r.job_id").isNull() | (F.col("h.job_id") != F.col("r.job_id")))
        & (
            (F.col("scope_kind") == "dataset")
            | ((F.col("scope_kind") == "job") & (F.col("h.job_name") == F.col("scope_value")))
            | ((F.col("scope_kind") == "partition") & (F.col("h.partition_key") == F.col("scope_value")))
        )
    )
    g = r.join(h, cond, "left").groupBy("_id", *[f"r.{c}" for c in metrics.columns], "scope_kind", "scope_value")
    return g.agg(
        F.count("h.ts").alias("hist_count"),
        *[f(f"h.{m}").alias(f"{n}_{m}") for m in ("row_count", "byte_size") for n, f in (("mean", F.avg), ("std", F.stddev_samp))],
    ).drop("_id")


def _bounds(measure: str, sigma: float) -> tuple[Column, Column, Column]:
    mean = F.col(f"mean_{measure}")
    std = F.coalesce(F.col(f"std_{measure}"), F.lit(0.0))
    return mean, mean + sigma * std, F.greatest(F.lit(0.0), mean - sigma * std)


def _found(measure: str, sigma: float, drop_ratio: float | None) -> Column:
    """The anomaly of one measure as a struct, or NULL."""
    cur = F.col(measure).cast("double")
    mean, upper, lower = _bounds(measure, sigma)
    low = cur < lower
    if drop_ratio is not None:
        low = low | (cur < mean * drop_ratio)
    where = (
        F.when(F.col("scope_kind") == "partition", F.concat(F.lit(" in partition '"), F.col("scope_value"), F.lit("'")))
        .when(F.col("scope_kind") == "job", F.concat(F.lit(" for job '"), F.col("scope_value"), F.lit("'")))
        .otherwise("")
    )
    if measure == "row_count":
        tail = F.concat(
            F.lit(": "), F.col(measure).cast("string"), F.lit(" (Expected ~"),
            F.format_string("%.0f", F.bround(mean, 0)), F.lit(f", >{float(sigma)}σ)"),
        )
        noun = "Row count"
    else:
        tail = F.concat(F.lit(": "), fmt_bytes(F.col(measure)), F.lit(" (Expected ~"), fmt_bytes(mean), F.lit(")"))
        noun = "Volume"

    def event(direction: str, word: str) -> Column:
        kind, severity = KINDS[measure][direction]
        return F.struct(
            F.lit(kind).alias("anomaly_type"),
            F.lit(severity).alias("severity"),
            cur.alias("current_value"),
            mean.alias("expected_value"),
            F.when(mean > 0, F.abs(cur - mean) / mean).otherwise(F.lit(1.0)).alias("deviation"),
            F.concat(F.lit(f"{noun} {word}"), where, tail).alias("message"),
        )

    return F.when(cur > upper, event("up", "spike")).when(low, event("down", "drop"))


def detect(
    metrics: DataFrame,
    measures: tuple[str, ...] = ("row_count", "byte_size"),
    sigma: float = 3.0,
    min_points: int = 5,
    days: int = 30,
    exclude_own_job: bool = True,
    drop_ratio: float | None = None,
    block_us: Blocks = None,
) -> DataFrame:
    """Spikes and drops outside mean ± sigma·std of a history of ``min_points`` or more."""
    return judge(history_stats(metrics, days, measures, exclude_own_job, block_us), measures, sigma, min_points, drop_ratio)


def judge(
    stats: DataFrame,
    measures: tuple[str, ...] = ("row_count", "byte_size"),
    sigma: float = 3.0,
    min_points: int = 5,
    drop_ratio: float | None = None,
) -> DataFrame:
    """Anomalies out of rows that already carry their history statistics."""
    events = F.filter(F.array(*[_found(m, sigma, drop_ratio) for m in measures]), lambda e: e.isNotNull())
    return (
        stats.filter(F.col("hist_count") >= min_points)
        .select("org_id", "dataset", "job_id", "ts", "scope_kind", "scope_value", "hist_count", F.explode(events).alias("_e"))
        .select("org_id", "dataset", "job_id", "ts", "scope_kind", "scope_value", "hist_count", "_e.*")
    )


def detect_row_count_anomalies(metrics: DataFrame, sigma: float = 3.0, min_points: int = 5, **kw) -> DataFrame:
    return detect(metrics, ("row_count",), sigma, min_points, **kw)


def detect_volume_anomalies(metrics: DataFrame, sigma: float = 3.0, min_points: int = 5, **kw) -> DataFrame:
    return detect(metrics, ("byte_size",), sigma, min_points, **kw)


def percentile_bounds(metrics: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Rows outside their scope's [p5, p95] of row_count."""
    key = ["org_id", "dataset", "scope_kind", "scope_value"]
    rows = with_scope(metrics).filter("row_count IS NOT NULL")
    out = join_null_safe(rows, quantiles(rows, key, "row_count", {"lower_bound": low, "upper_bound": high}), key, "inner")
    return out.filter((F.col("row_count") < F.col("lower_bound")) | (F.col("row_count") > F.col("upper_bound")))


def detect_null_rate(profiles: DataFrame, sigma: float = 3.0, min_points: int = 5, days: int = 30) -> DataFrame:
    """Columns whose share of nulls left its own history's band (Q5).

    ``profiles``: org_id, dataset, column, ts, job_id, row_count, null_count. The rate is
    judged in whole parts per million so that the sums stay exact.
    """
    ppm = F.round(F.col("null_count") * 1_000_000 / F.nullif(F.col("row_count"), F.lit(0))).cast("bigint")
    m = profiles.select(
        "org_id",
        F.concat_ws(".", "dataset", "column").alias("dataset"),
        "job_id", "ts",
        F.lit(None).cast("string").alias("job_name"),
        F.lit(None).cast("string").alias("partition_key"),
        ppm.alias("null_ppm"),
    )
    s = history_stats(m, days, ("null_ppm",))
    mean, upper, lower = _bounds("null_ppm", sigma)
    kind = F.when(F.col("null_ppm") > upper, "null_rate_spike").when(F.col("null_ppm") < lower, "completeness_gain")
    return s.filter(F.col("hist_count") >= min_points).withColumn("anomaly_type", kind).filter("anomaly_type IS NOT NULL").select(
        "org_id", F.col("dataset").alias("column_path"), "ts", "null_ppm", mean.alias("expected_ppm"), "hist_count", "anomaly_type"
    )


def comparison(anomalies: DataFrame) -> DataFrame:
    """Actual against expected with the change in percent."""
    return anomalies.withColumn("percent_change", percent_change(F.col("actual_value"), F.col("expected_value")))
