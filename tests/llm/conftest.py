import datetime

import pytest


def plain(v):
    """A value that compares alike from Spark and DuckDB."""
    if isinstance(v, float):
        return float(f"{v:.10g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


@pytest.fixture
def docs(spark):
    """``docs(rows)``: a table like documents, with columns whose names operators also use inside."""

    def make(rows, schema="doc_id bigint, text string"):
        extra = ", lang string, source string, n_chars bigint, id string, fp string, score string, shard string, bucket string"
        full = [(*r, "en", "src0", None, "x", "y", "z", "w", "v") for r in rows]
        return spark.createDataFrame(full, schema + extra)

    return make
