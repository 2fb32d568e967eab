"""Closures, impact and cleaning on small graphs with known answers."""

import pytest

from lakeledger.operators import graph as g

ROWS = (
    [("o1", a, b) for a, b in [("a", "b"), ("b", "c"), ("d1", "d2"), ("d1", "d3"), ("d2", "d4"), ("d3", "d4"), ("x", "y"), ("y", "z"), ("z", "x")]]
    + [("o1", f"n{i}", f"n{i + 1}") for i in range(12)]
    + [("o2", "b", "other")]
)


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(*r, "j", "n") for r in ROWS], "org_id string, source string, target string, job_id string, job_name string")


def every(edges, side="source"):
    return edges.select("org_id", side).distinct()


def test_downstream(edges):
    d = {}
    for r in g.downstream(edges, every(edges)).collect():
        d.setdefault((r.org_id, r.source), {})[r.dataset] = r.depth
    assert d["o1", "a"] == {"b": 1, "c": 2}
    assert d["o1", "d1"] == {"d2": 1, "d3": 1, "d4": 2}
    assert d["o1", "x"] == {"y": 1, "z": 2, "x": 3}
    assert max(d["o1", "n0"].values()) == 10 and len(d["o1", "n0"]) == 10
    assert d["o2", "b"] == {"other": 1}


@pytest.mark.parametrize("levels,reached", [(3, 3), (12, 12), (None, 12)])
def test_levels_asked_for_are_followed(spark, edges, levels, reached):
    start = spark.createDataFrame([("o1", "n0")], "org_id string, name string")
    assert sorted(r.depth for r in g.downstream(edges, start, levels).collect()) == list(range(1, reached + 1))
    ring = spark.createDataFrame([("o1", "x")], "org_id string, name string")
    assert {(r.dataset, r.depth) for r in g.downstream(edges, ring, None).collect()} == {("y", 1), ("z", 2), ("x", 3)}


def test_upstream_of_one(spark, edges):
    t = spark.createDataFrame([("o1", "d4")], "org_id string, name string")
    assert {(r.dataset, r.depth) for r in g.upstream(edges, t).collect()} == {("d2", 1), ("d3", 1), ("d1", 2)}
    assert {(r.dataset, r.depth) for r in g.upstream(edges, t, max_depth=1).collect()} == {("d2", 1), ("d3", 1)}


def test_unknown_start_gives_nothing(spark, edges):
    t = spark.createDataFrame([("o1", "nowhere")], "org_id string, name string")
    assert g.downstream(edges, t).count() == 0


def columns(spark, rows):
    return spark.createDataFrame(
        [("o", *r) for r in rows], "org_id string, source_dataset string, source_column string, target_dataset string, target_column string, transform_type string, expression string"
    )


def test_one_column_by_two_ways_counts_twice_B21(spark):
    e = columns(spark, [("s", "c", "t", "k", "DIRECT", None), ("s", "c", "m", "x", "DIRECT", None), ("m", "x", "t", "k", "EXPRESSION", "f(x)")])
    start = spark.createDataFrame([("o", "s", "c")], "org_id string, dataset string, column string")
    assert {(r.dataset, r.column, r.transform_type, r.depth) for r in g.column_closure(e, start).collect()} == {("t", "k", "DIRECT", 1), ("m", "x", "DIRECT", 1), ("t", "k", "EXPRESSION", 2)}
    r = g.impact_analysis(e, start).first()
    assert (r.total_columns_affected, r.distinct_columns_affected, r.total_datasets_affected, r.direct_dependents, r.transitive_dependents) == (3, 2, 2, 2, 1)


@pytest.mark.parametrize("datasets,cols,want", [(1, 2, "LOW"), (1, 3, "MEDIUM"), (2, 2, "MEDIUM"), (3, 3, "HIGH"), (1, 5, "HIGH"), (5, 5, "CRITICAL"), (1, 10, "CRITICAL")])
def test_criticality(spark, datasets, cols, want):
    e = columns(spark, [("s", "c", f"t{i % datasets}", f"k{i}", "DIRECT", None) for i in range(cols)])
    start = spark.createDataFrame([("o", "s", "c"), ("o", "none", "c")], "org_id string, dataset string, column string")
    got = {r.start_dataset: r for r in g.impact_analysis(e, start).collect()}
    assert got["s"].criticality == want
    assert (got["none"].criticality, got["none"].total_datasets_affected, got["none"].max_depth) == ("LOW", 0, 0)
