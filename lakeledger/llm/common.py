"""What several corpus operators share: column binding, Arrow output and connected components."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeledger.runtime import checkpoint, ship

ship(__name__)


def picked(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Only the named columns under internal names, so nothing else in ``df`` can clash with them."""
    return df.select(*[(df[c] if isinstance(c, str) else c).alias(name) for name, c in columns.items()])


def unused(name: str, columns: Iterable[str]) -> str:
    """``name``, with underscores behind it until none of ``columns`` is called so (upper and lower case alike)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts(column: pa.Array) -> list[str]:
    """Texts of an Arrow column; a missing text counts as an empty one."""
    return [t or "" for t in column.to_pylist()]


def pieces(text: str | bytes, size: int) -> Iterator[str | bytes]:
    """A long text in pieces of about ``size``, cut at white space, so that no word is split."""
    space = (re.compile(rb"[\x20\x09-\x0D]") if isinstance(text, bytes) else re.compile(r"\s"))
    at = 0
    while len(text) - at > size:
        found = space.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Tuples as Arrow batches."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def same(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> Column:
    """Null-safe equality of several columns."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[v]) for k, v in keys.items()])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(u, v)`` by alternating large and small stars.

    Returns ``node, root`` for every node that has an edge, ``root`` being the smallest node
    reachable. A hub is met only by a partial minimum and by joins whose other side has one row per
    node, which adaptive execution can split. Every round is written to the shared folder; the
    number of rounds is logarithmic in practice. Loops and repeated edges are ignored, an empty
    input gives an empty result.
    """
    e = checkpoint(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    while True:
        parents = e.select(F.col("u").alias("v")).distinct()
        chained = e.join(parents, "v", "left_semi").limit(1).count()
        many = 0 if chained else e.groupBy("u").count().filter("count > 1").limit(1).count()
        if not chained and not many:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = checkpoint(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpoint(rest.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
