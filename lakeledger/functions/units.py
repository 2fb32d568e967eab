"""Numbers to text and ratios: sizes, utilisation, percent change, anomaly messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(x: Column, digits: int) -> Column:
    """A number with a fixed count of decimals and no thousands separator."""
    return F.format_string(f"%.{digits}f", x.cast("double"))


def fmt_bytes(x: Column) -> Column:
    """1536 -> ``1.5KB``; exact halves go to the even digit."""
    v = x.cast("double")

    def even(y: Column) -> Column:
        return fixed(F.bround(y, 1), 1)

    ladder = F.when(v < 1024, F.concat(even(v), F.lit("B")))
    for power, unit in enumerate(["KB", "MB", "GB"], start=1):
        ladder = ladder.when(v < 1024.0 ** (power + 1), F.concat(even(v / 1024.0**power), F.lit(unit)))
    return ladder.when(v.isNotNull(), F.concat(even(v / 1024.0**4), F.lit("TB")))


def fmt_bytes_long(x: Column) -> Column:
    """1536 -> ``1.50 KB``; whole bytes below 1 KB, GB at the top."""
    v = x.cast("double")
    return (
        F.when(v < 1024, F.concat(x.cast("bigint").cast("string"), F.lit(" B")))
        .when(v < 1024.0**2, F.concat(fixed(v / 1024.0, 2), F.lit(" KB")))
        .when(v < 1024.0**3, F.concat(fixed(v / 1024.0**2, 2), F.lit(" MB")))
        .when(v.isNotNull(), F.concat(fixed(v / 1024.0**3, 2), F.lit(" GB")))
    )


def parse_memory_mb(text: Column) -> Column:
    """``4g`` / ``512m`` / ``2048k`` / bytes -> whole megabytes."""
    t = F.lower(F.trim(text))
    n = F.regexp_extract(t, r"^(\d+)[gmk]?$", 1).try_cast("bigint")
    return (
        F.when(t.endswith("g"), n * 1024)
        .when(t.endswith("m"), n)
        .when(t.endswith("k"), F.floor(n / 1024).cast("bigint"))
        .otherwise(F.floor(n / (1024 * 1024)).cast("bigint"))
    )


def duration_ms(start: Column, end: Column) -> Column:
    """Milliseconds from start to end; NULL when either is missing."""
    return ((F.unix_micros(end) - F.unix_micros(start)) / 1000).cast("bigint")


def run_time_ms(metric_ms: Column, wall_ms: Column) -> Column:
    """Execution time, or the wall-clock duration where that counter is missing or 0."""
    return F.coalesce(F.when(metric_ms != 0, metric_ms), F.when(wall_ms != 0, wall_ms), F.lit(0))


def cpu_utilisation(cpu_ns: Column, run_ms: Column) -> Column:
    """CPU time over run time; NULL if either is 0."""
    return F.when((F.coalesce(cpu_ns, F.lit(0)) != 0) & (run_ms != 0), cpu_ns / (run_ms * 1e6))


def gc_ratio(gc_ms: Column, run_ms: Column) -> Column:
    """GC time over run time; NULL if the run time is 0."""
    return F.when(run_ms != 0, F.coalesce(gc_ms, F.lit(0)) / run_ms)


def memory_utilisation(peak_bytes: Column, config_mb: Column) -> Column:
    """Peak executor memory over configured memory (F16)."""
    ok = (F.coalesce(peak_bytes, F.lit(0)) != 0) & (F.coalesce(config_mb, F.lit(0)) != 0)
    return F.when(ok, peak_bytes / (config_mb * F.lit(1048576.0)))


def memory_severity(utilisation: Column) -> Column:
    return (
        F.when(utilisation.isNull(), "info")
        .when(utilisation > 0.9, "critical")
        .when(utilisation > 0.75, "warning")
        .otherwise("success")
    )


def percent_change(actual: Column, expected: Column) -> Column:
    """Change against the expected value in percent; 0 when nothing was expected."""
    return F.when(F.coalesce(expected, F.lit(0.0)) == 0, F.lit(0.0)).otherwise((actual - expected) / expected * 100)
