"""Lineage closure, impact and graphs around one or many starting points in one job."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeledger.runtime import checkpoint

#: Levels followed unless told otherwise.
MAX_LEVELS = 10


def _reach(edges: DataFrame, src: list[str], dst: list[str], starts: DataFrame, max_depth: int | None) -> DataFrame:
    """(org_id, start_*, node_*, depth): shortest depth of every node reachable from every start.

    Level by level: frontier ⋈ edges, distinct, minus what is known, for ``max_depth`` levels or, if
    that is None, until nothing new is reached. Each level is written to the shared folder, so the
    plan stays short and a lost executor costs one level at most. A start shows up in its own result
    if it lies on a cycle.
    """
    n = len(src)
    at, to = [f"_at{i}" for i in range(n)], [f"node_{i}" for i in range(n)]
    st = [f"start_{i}" for i in range(n)]
    e = checkpoint(
        edges.select("org_id", *[F.col(s).alias(a) for s, a in zip(src, at)], *[F.col(d).alias(t) for d, t in zip(dst, to)]).distinct()
    )
    s0 = starts.select("org_id", *[F.col(c).alias(a) for c, a in zip(starts.columns[1:], at)]).distinct()
    step = e.join(s0, ["org_id", *at]).select("org_id", *[F.col(a).alias(s) for a, s in zip(at, st)], *to)
    key = ["org_id", *st, *to]
    levels: list[DataFrame] = []
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        if levels:
            seen = reduce(DataFrame.union, [lv.select(*key) for lv in levels])
            front = levels[-1].select("org_id", *st, *[F.col(t).alias(a) for t, a in zip(to, at)])
            step = front.join(e, ["org_id", *at]).select(*key).distinct().join(seen, key, "left_anti")
        level = checkpoint(step.withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            break
        levels.append(level)
    return reduce(DataFrame.union, levels) if levels else level


def downstream(edges: DataFrame, sources: DataFrame, max_depth: int | None = MAX_LEVELS) -> DataFrame:
    """Datasets fed by each of ``sources`` (org_id, name): org_id, source, dataset, depth (G1)."""
    r = _reach(edges, ["source"], ["target"], sources, max_depth)
    return r.select("org_id", F.col("start_0").alias("source"), F.col("node_0").alias("dataset"), "depth")


def upstream(edges: DataFrame, targets: DataFrame, max_depth: int | None = MAX_LEVELS) -> DataFrame:
    """Datasets that feed each of ``targets`` (org_id, name): org_id, target, dataset, depth."""
    r = _reach(edges, ["target"], ["source"], targets, max_depth)
    return r.select("org_id", F.col("start_0").alias("target"), F.col("node_0").alias("dataset"), "depth")


def column_closure(
    column_edges: DataFrame, columns: DataFrame, direction: str = "downstream", max_depth: int | None = MAX_LEVELS
) -> DataFrame:
    """Columns reached from each start column, one row per way they are computed.

    ``columns``: (org_id, dataset, column). Result: org_id, start_dataset, start_column,
    dataset, column, transform_type, expression, depth.
    """
    near, far = ("source", "target") if direction == "downstream" else ("target", "source")
    src, dst = [f"{near}_dataset", f"{near}_column"], [f"{far}_dataset", f"{far}_column"]
    zero = columns.toDF("org_id", "start_dataset", "start_column").distinct()
    zero = zero.select("*", F.col("start_dataset").alias(src[0]), F.col("start_column").alias(src[1]), F.lit(0).alias("_d"))
    nodes = zero
    if max_depth is None or max_depth > 1:
        r = _reach(column_edges, src, dst, columns, None if max_depth is None else max_depth - 1)
        nodes = zero.unionByName(
            r.select(
                "org_id", F.col("start_0").alias("start_dataset"), F.col("start_1").alias("start_column"),
                F.col("node_0").alias(src[0]), F.col("node_1").alias(src[1]), F.col("depth").alias("_d"),
            )
        )
    key = ["org_id", "start_dataset", "start_column", "dataset", "column", "transform_type", "expression"]
    return (
        nodes.join(column_edges, ["org_id", *src])
        .withColumnsRenamed({dst[0]: "dataset", dst[1]: "column"})
        .groupBy(*key)
        .agg((F.min("_d") + 1).alias("depth"))
    )


def impacted_datasets(closure: DataFrame, datasets: DataFrame | None = None) -> DataFrame:
    """Per start column and dataset: its impacted columns, deepest level and type."""
    g = closure.groupBy("org_id", "start_dataset", "start_column", "dataset").agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("depth") == 1).alias("direct"),
        F.max("depth").alias("max_depth"),
        # bounded by the width of one dataset
        F.array_sort(F.collect_set("column")).alias("columns"),
    )
    if datasets is None:
        return g
    d = datasets.select("org_id", F.col("name").alias("dataset"), "dataset_type")
    return g.join(d, ["org_id", "dataset"], "left")


def impact_analysis(column_edges: DataFrame, columns: DataFrame, max_depth: int | None = MAX_LEVELS) -> DataFrame:
    """Size and criticality of what depends on each start column."""
    closure = column_closure(column_edges, columns, "downstream", max_depth)
    per = impacted_datasets(closure)
    s = per.groupBy("org_id", "start_dataset", "start_column").agg(
        F.sum("direct").alias("direct_dependents"),
        F.sum(F.col("n_rows") - F.col("direct")).alias("transitive_dependents"),
        F.count("*").alias("total_datasets_affected"),
        F.sum("n_rows").alias("total_columns_affected"),
        F.sum(F.size("columns")).alias("distinct_columns_affected"),
        F.max("max_depth").alias("max_depth"),
    )
    asked = columns.toDF("org_id", "start_dataset", "start_column").distinct()
    s = asked.join(s, ["org_id", "start_dataset", "start_column"], "left").na.fill(0)
    ds, cols = F.col("total_datasets_affected"), F.col("total_columns_affected")
    return s.withColumn(
        "criticality",
        F.when((ds >= 5) | (cols >= 10), "CRITICAL").when((ds >= 3) | (cols >= 5), "HIGH").when((ds >= 2) | (cols >= 3), "MEDIUM").otherwise("LOW"),
    )


def edges_within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (org_id, name)."""
    n = nodes.select("org_id", "name").distinct()
    return edges.join(n.withColumnRenamed("name", "source"), ["org_id", "source"], "left_semi").join(
        n.withColumnRenamed("name", "target"), ["org_id", "target"], "left_semi"
    )


def edges_within_columns(column_edges: DataFrame, columns: DataFrame) -> DataFrame:
    """Column edges with both ends among ``columns`` (org_id, dataset, column)."""
    out = column_edges
    for side in ("source", "target"):
        k = ["org_id", f"{side}_dataset", f"{side}_column"]
        out = out.join(columns.select("org_id", "dataset", "column").distinct().toDF(*k), k, "left_semi")
    return out


def lineage_graph(edges: DataFrame, org: str, name: str, max_depth: int | None = MAX_LEVELS) -> tuple[DataFrame, DataFrame]:
    """(nodes with role and depth, edges among them) around one dataset."""
    spark = edges.sparkSession
    start = spark.range(1).select(F.lit(org).alias("org_id"), F.lit(name).alias("name"))
    up = upstream(edges, start, max_depth).select("org_id", F.col("dataset").alias("name"), F.lit("upstream").alias("role"), "depth")
    down = downstream(edges, start, max_depth).select("org_id", F.col("dataset").alias("name"), F.lit("downstream").alias("role"), "depth")
    nodes = start.select("*", F.lit("self").alias("role"), F.lit(0).alias("depth")).unionByName(up).unionByName(down)
    return nodes, edges_within(edges, nodes)


def column_graph(column_edges: DataFrame, org: str, dataset: str, column: str, max_depth: int | None = MAX_LEVELS) -> tuple[DataFrame, DataFrame]:
    """(columns with role and depth, column edges among them) around one column."""
    spark = column_edges.sparkSession
    start = spark.range(1).select(F.lit(org).alias("org_id"), F.lit(dataset).alias("dataset"), F.lit(column).alias("column"))
    parts = [start.select("*", F.lit("self").alias("role"), F.lit(0).alias("depth"))]
    for role in ("upstream", "downstream"):
        c = column_closure(column_edges, start, role, max_depth)
        parts.append(c.groupBy("org_id", "dataset", "column").agg(F.min("depth").alias("depth")).select("org_id", "dataset", "column", F.lit(role).alias("role"), "depth"))
    nodes = reduce(DataFrame.unionByName, parts)
    return nodes, edges_within_columns(column_edges, nodes)


def dataset_column_edges(column_edges: DataFrame, org: str, dataset: str) -> DataFrame:
    """Column edges that touch a dataset."""
    return column_edges.filter((F.col("org_id") == org) & ((F.col("source_dataset") == dataset) | (F.col("target_dataset") == dataset)))


def lineage_columns(column_edges: DataFrame) -> DataFrame:
    """Columns with lineage, per dataset."""
    s = column_edges.select("org_id", F.col("source_dataset").alias("dataset"), F.col("source_column").alias("column"))
    t = column_edges.select("org_id", F.col("target_dataset").alias("dataset"), F.col("target_column").alias("column"))
    return s.union(t).distinct()


def clean_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One edge per pair, no self-loops, both ends known."""
    one = edges.filter("source <> target").groupBy("org_id", "source", "target").agg(F.min(F.struct("job_id", "job_name")).alias("j"))
    return edges_within(one.select("org_id", "source", "target", "j.*"), nodes)


def downstream_count(closure: DataFrame) -> DataFrame:
    """Number of datasets below each source."""
    return closure.groupBy("org_id", "source").agg(F.count("*").alias("downstream_count"))


def lineage_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Upstream, downstream and edge counters of one graph in long form."""
    n = nodes.filter("role <> 'self'").groupBy(F.col("role").alias("counter")).agg(F.count("*").alias("n"))
    return n.unionByName(edges.agg(F.count("*").alias("n")).select(F.lit("edges").alias("counter"), "n"))


def order_closure(closure: DataFrame) -> DataFrame:
    """Closest first, then by name (O2)."""
    return closure.orderBy("depth", "dataset")
