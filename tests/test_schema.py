"""Schema versions and differences."""

import datetime as dt

import pytest

from lakeledger.operators import schema_diff as sd
from lakeledger.operators import schema_history as sh
from lakeledger.plans.medallion import evolution_snapshots

T0 = dt.datetime(2024, 1, 1)
FIELDS = "array<struct<name:string,type:string,nullable:boolean>>"
A = [("id", "int", True)]
B = [("id", "int", True), ("x", "string", True)]


def versions(spark, steps, **kw):
    s = spark.createDataFrame([("o", "d", T0 + dt.timedelta(hours=i), f) for i, f in enumerate(steps)], f"org_id string, dataset string, captured_at timestamp, fields {FIELDS}")
    return sorted(sh.build_schema_versions(s, **kw).collect(), key=lambda r: r.version_no)


def test_known_schema_opens_no_version_B2(spark):
    v = versions(spark, [A, B, A])
    assert [len(r.fields) for r in v] == [1, 2] and v[1].valid_to is None
    assert [len(r.fields) for r in versions(spark, [A, B, A], reopen=True)] == [1, 2, 1]


def test_five_step_evolution(spark):
    v = sh.build_schema_versions(evolution_snapshots(spark.range(1).toDF("idx")))
    a = {r.version_no: r for r in sd.schema_change_anomalies(sd.version_pairs(v), ["org_id", "dataset", "version_no"]).collect()}
    assert {k: r.change_type for k, r in a.items()} == {2: "NON_BREAKING", 3: "BREAKING", 4: "BREAKING", 5: "BREAKING"}
    assert a[2].message == "Schema non-breaking: Schema has been extended with new columns. Added 2 new columns: 'city', 'email'"
    assert a[5].changes == ["Nullability changed: id (NULLABLE -> NOT NULL)", "Nullability changed: name (NULLABLE -> NOT NULL)"]


def pair(spark, old, new):
    return spark.createDataFrame([(1, old, new)], f"k int, old_fields {FIELDS}, new_fields {FIELDS}")


@pytest.mark.parametrize(
    "old,new,library,service,breaks",
    [
        ([("a", "int", True)], [("a", "bigint", True)], {"Warning"}, "BREAKING", True),
        ([("a", "int", True)], [("a", "string", True)], {"Breaking"}, "BREAKING", True),
        ([("a", "int", False)], [("a", "int", True)], {"NonBreaking"}, "BREAKING", False),  # B4
        ([("a", "int", True), ("b", "int", True)], [("b", "int", True), ("a", "int", True)], {"Warning"}, "UNCHANGED", False),  # B3
        ([("a", "int", True)], [("a", "int", True), ("b", "int", True)], {"NonBreaking"}, "NON_BREAKING", False),
        ([("a", "string", True)], [("a", "varchar(10)", True)], {"Warning"}, "BREAKING", True),
    ],
)
def test_three_views_of_a_change(spark, old, new, library, service, breaks):
    p = pair(spark, old, new)
    assert {r.severity for r in sd.diff_fields(p, ["k"]).collect()} == library
    assert sd.schema_change_anomalies(p, ["k"]).first().change_type == service
    assert sd.schema_version_diff(p, ["k"]).first().is_breaking == breaks


def test_leaf_fields(spark):
    s = spark.createDataFrame([("o", "d", [("id", "bigint", True), ("u", "struct<y:int,z:array<string>>", True)])], f"org_id string, dataset string, fields {FIELDS}")
    assert {(r.path, r.type) for r in sh.explode_leaf_fields(s).collect()} == {("id", "bigint"), ("u.y", "int"), ("u.z.element", "string")}
