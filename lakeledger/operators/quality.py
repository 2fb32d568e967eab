"""Profiles, quality rules and freshness (Q1-Q6). The rule semantics are this library's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _countable(df: DataFrame, name: str) -> Column:
    """A column as a value that can be grouped; maps and variants by their text."""
    kind = df.schema[name].dataType.simpleString()
    return F.to_json(F.struct(F.col(name).alias("v"))) if "map<" in kind or "variant" in kind else F.col(name)


def profile(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """Per column: rows, nulls, distinct values (Q1, Q2).

    One pass. Exact distinct counts first reduce to one row per (column, typed value), so a column
    with few values shrinks before the shuffle and one with many spreads over all tasks.
    """
    cols = columns or df.columns
    distinct = lambda c: F.approx_count_distinct(_countable(df, c)) if approx else F.count_distinct(F.when(F.col(c).isNotNull(), _countable(df, c)))
    one = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("null_count"), distinct(c).alias("distinct_count")) for c in cols]
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.array(*one).alias("_c")).select("row_count", F.inline("_c"))


def _violated(rule: dict) -> Column:
    """Whether a row breaks a row rule; NULL passes all but NOT_NULL."""
    c = F.col(rule["column"]) if rule.get("column") else None
    kind = rule["type"]
    if kind == "NOT_NULL":
        return c.isNull()
    if kind == "RANGE":
        low = c < rule["min"] if rule.get("min") is not None else F.lit(False)
        high = c > rule["max"] if rule.get("max") is not None else F.lit(False)
        return F.coalesce(low | high, F.lit(False))
    if kind == "PATTERN":
        return F.coalesce(~c.cast("string").rlike(rule["pattern"]), F.lit(False))
    if kind == "CUSTOM":
        return F.coalesce(~F.expr(rule["expression"]), F.lit(False))
    raise ValueError(f"unknown rule type {kind}")


def evaluate_rules(df: DataFrame, rules: list[dict], id_column: str, samples: int = 3) -> DataFrame:
    """Result per rule: passed, violation_count, sample_violations (Q3).

    ``rules``: dicts with name, type (NOT_NULL, UNIQUE, RANGE, PATTERN, CUSTOM), column, and
    min / max / pattern / expression. All row rules share one pass that emits a row per broken
    rule; UNIQUE groups by value. A sample is the lowest ``samples`` ids that break the rule, in
    the ids' own type; null ids are left out of it but counted.
    """
    row_rules = [r for r in rules if r["type"] != "UNIQUE"]
    ident = F.col(id_column).alias("id")
    lowest, counts = [], []
    if row_rules:
        broken = F.filter(F.array(*[F.when(_violated(r), F.lit(r["name"])) for r in row_rules]), lambda n: n.isNotNull())
        hits = df.select(ident, F.explode(broken).alias("rule"))
        lowest.append(hits)
        counts.append(hits.groupBy("rule").agg(F.count("*").alias("violation_count")))
    for r in rules:
        if r["type"] == "UNIQUE":
            values = df.select(ident, F.col(r["column"]).alias("value")).filter("value IS NOT NULL")
            # every row of a value after the first by id; a few of each value are enough for the sample
            nth = F.row_number().over(Window.partitionBy("value").orderBy("id"))
            lowest.append(values.withColumn("_n", nth).filter(F.col("_n").between(2, samples + 1)).select("id", F.lit(r["name"]).alias("rule")))
            twice = values.groupBy("value").agg((F.count("*") - 1).alias("_more"))
            counts.append(twice.agg(F.coalesce(F.sum("_more"), F.lit(0)).alias("violation_count")).select(F.lit(r["name"]).alias("rule"), "violation_count"))
    w = Window.partitionBy("rule").orderBy("id")
    # the limit runs in every task before the shuffle, so few rows per rule move
    few = reduce(DataFrame.unionByName, lowest).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= samples)
    sample = few.groupBy("rule").agg(F.array_sort(F.collect_list("id")).alias("sample_violations"))
    names = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(r["name"]) for r in rules])).alias("rule"))
    out = names.join(reduce(DataFrame.unionByName, counts), "rule", "left").join(sample, "rule", "left").na.fill(0, ["violation_count"])
    return out.withColumn("passed", F.col("violation_count") == 0)


def freshness(metrics: DataFrame, slas: DataFrame, as_of: str, default_hours: int = 24) -> DataFrame:
    """Datasets with their last load and whether that is older than agreed (Q4).

    ``slas``: org_id, dataset, sla_hours; without one the default applies.
    """
    last = metrics.groupBy("org_id", "dataset").agg(F.max("ts").alias("last_updated"))
    s = last.join(slas.select("org_id", "dataset", "sla_hours"), ["org_id", "dataset"], "left")
    hours = F.coalesce("sla_hours", F.lit(default_hours))
    age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("last_updated")) / 3.6e9
    return s.withColumn("sla_hours", hours).withColumn("age_hours", age).withColumn("stale", age > F.col("sla_hours"))


def file_stats(df: DataFrame) -> DataFrame:
    """Files and partition folders behind a file-based DataFrame (Q6)."""
    f = df.select(F.col("_metadata.file_path").alias("f")).groupBy("f").agg(F.count("*").alias("n"))
    return f.agg(F.count("*").alias("file_count"), F.count_distinct(F.regexp_replace("f", "/[^/]*$", "")).alias("partition_count"), F.sum("n").alias("row_count"))
