"""Profiles and rules on values and ids of any type."""

import datetime as dt

from lakeledger.operators import quality as qu


def test_distinct_values_are_compared_as_they_are(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(t, {"a": 1}, 1.0, None), (t + dt.timedelta(microseconds=1), {"a": 1}, 1.0, None), (None, {"a": 2}, float("nan"), None), (t, None, float("nan"), None)]
    df = spark.createDataFrame(rows, "ts timestamp, m map<string,int>, x double, z string")
    got = {r.column: (r.row_count, r.null_count, r.distinct_count) for r in qu.profile(df).collect()}
    assert got == {"ts": (4, 1, 2), "m": (4, 1, 2), "x": (4, 0, 2), "z": (4, 4, 0)}
    assert {r.column: r.distinct_count for r in qu.profile(df, ["ts", "x"], approx=True).collect()} == {"ts": 2, "x": 2}


def test_rules_with_text_ids(spark):
    rows = [("b", 1, "k"), ("a", 1, "k"), ("c", 1, None), ("d", 2, "m"), ("e", None, "k"), ("f", None, "m")]
    df = spark.createDataFrame(rows, "id string, v int, w string")
    rules = [{"name": "one", "type": "UNIQUE", "column": "v"}, {"name": "w set", "type": "NOT_NULL", "column": "w"}, {"name": "w one", "type": "UNIQUE", "column": "w"}, {"name": "fine", "type": "RANGE", "column": "v", "min": 0}]
    got = {r.rule: (r.violation_count, r.sample_violations, r.passed) for r in qu.evaluate_rules(df, rules, "id", samples=2).collect()}
    assert got == {"one": (2, ["b", "c"], False), "w set": (1, ["c"], False), "w one": (3, ["b", "e"], False), "fine": (0, None, True)}


def test_a_value_held_by_most_rows(spark):
    df = spark.range(50_000).selectExpr("id", "CASE WHEN id % 3 > 0 THEN 0 ELSE id END AS v")
    r = qu.evaluate_rules(df, [{"name": "one", "type": "UNIQUE", "column": "v"}], "id").first()
    assert r.violation_count == df.filter("v = 0").count() - 1 and r.sample_violations == [1, 2, 4]
