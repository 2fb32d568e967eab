"""Path, naming and unit functions on the cases of the fixture list."""

import pytest
from pyspark.sql import functions as F

from lakeledger.functions import naming, paths, units
from lakeledger.operators.schema_history import type_leaves


def one(spark, f, *args):
    row = spark.range(1).select(*[F.lit(a).cast("string").alias(f"c{i}") for i, a in enumerate(args)])
    return row.select(f(*[F.col(f"c{i}") for i in range(len(args))]).alias("r")).first().r


PATHS = [
    ("/data/date=2024-01-01/country=US/f.parquet", "/data/date=*/country=US/f.parquet", "f", {"country": "US"}),
    ("/data/2024/01/01/x", "/data/*/*/*/x", "x", {}),
    ("s3://b/featuremart/brand_propensity/202601", "s3://b/featuremart/brand_propensity/202601", "b:brand_propensity", {}),
    ("s3://b/featuremart/output_v2/20251003-20251231", "s3://b/featuremart/output_v2/*", "b:output_v2", {}),
    ("hdfs://nn:8020/sales/year=2024/month=01/", "hdfs://nn:8020/sales/year=*/month=*/", "nn:8020:sales", {}),
    ("file:///data/local/output", "file:///data/local/output", "output", {}),
    ("/data/US/agg", "/data/US/agg", "agg", {"country": "US"}),
]


@pytest.mark.parametrize("path,signature,name,geo", PATHS)
def test_paths(spark, path, signature, name, geo):
    assert one(spark, paths.generalize_path, path) == signature
    assert one(spark, paths.dataset_name_from_path, path) == name
    assert one(spark, paths.extract_geo, path) == geo


def test_empty_and_adjacent_dates_B9(spark):
    assert one(spark, paths.generalize_path, "") == "UNKNOWN"
    assert one(spark, paths.generalize_path, "/a/20240101/20240102/b") == "/a/*/20240102/b"


def test_location_keeps_one_leading_slash_B10(spark):
    assert one(spark, paths.generalize_location, "/data/2024/x") == "/data/*/x"
    assert one(spark, paths.generalize_location, "s3://b/us-east-1/prod/dt=1/country=US/") == "s3://b/*/*/dt=*/country=US"
    assert one(spark, paths.generalize_location, "file:/tmp/2024") == "file:/tmp/*"


def test_all_partition_path_B11(spark):
    assert one(spark, paths.dataset_name_from_path, "s3a://bucket/2024/01") == "bucket:01"


@pytest.mark.parametrize("args,want", [(("t", "s3a://b/x", "FILE"), "s3"), (("t", "file:/wh/t", "TABLE"), "table"), (("x.csv", None, None), "file"), (("my_delta", None, "Stream"), "delta"), (("t", None, None), "table"), (("s3://b/x", None, None), "file")])
def test_dataset_type(spark, args, want):
    assert one(spark, paths.infer_dataset_type, *args) == want


def test_geo_key(spark):
    assert one(spark, paths.geo_partition_key, "/x/Region=eu/country=DE/zone=*") == "country=DE,region=eu"
    assert one(spark, paths.geo_partition_key, "/x/y") == "GLOBAL"


@pytest.mark.parametrize("expr,want", [("name#3", "DIRECT"), ("sum(a#1)", "AGGREGATE"), ("CASE WHEN a THEN b END", "CASE"), ("(a#1 > 5)", "FILTER"), ("upper(a#1)", "EXPRESSION"), ("minute(ts#1)", "EXPRESSION"), ("last_day(d#1)", "EXPRESSION")])
def test_transform_type_B16(spark, expr, want):
    assert one(spark, naming.transform_type, expr) == want


@pytest.mark.parametrize("text,mb", [("4g", 4096), ("512m", 512), ("2048k", 2), ("1048576", 1), ("1500k", 1)])
def test_memory(spark, text, mb):
    assert one(spark, units.parse_memory_mb, text) == mb


def test_long_expression_is_cut(spark):
    assert len(one(spark, naming.capped, "x" * 3001)) == 3000
    assert one(spark, naming.capped, "x" * 3000) == "x" * 3000


def test_type_leaves():
    assert type_leaves("struct<a:int,b:struct<c:array<string>,`d-e`:decimal(10,2)>>") == [("a", "int"), ("b.c.element", "string"), ("b.d-e", "decimal(10,2)")]
    assert type_leaves("map<string,struct<count:int,sum:double>>") == [("key", "string"), ("value.count", "int"), ("value.sum", "double")]
    assert type_leaves("array<struct<id:int,name:string>>") == [("element.id", "int"), ("element.name", "string")]
    assert type_leaves("bigint") == [("", "bigint")]
