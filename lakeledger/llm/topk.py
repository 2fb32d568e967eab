"""Exact top-k search: every query against every row, a term at a time, a block of rows at a time.

Rows are dealt into blocks. In a block each dimension has a list of postings (row, weight); a query
scatters its own weight times those into one dense score array, the best k are selected by partition,
and the blocks' winners are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeledger.llm.common import batches, picked
from lakeledger.runtime import checkpoint, ship

ship(__name__)

#: Rows and queries of one block: a task holds both, and one score array as long as its rows. While all blocks run at
#: once they may have as few as ``FEWEST`` rows.
ROWS, FEWEST, QUERIES = 131_072, 8_192, 4_096
_OUT = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantised(column: pa.ChunkedArray | pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """All components as floor(scale * x), and where each vector begins.

    Components too large for exact 64-bit sums become Python integers.
    """
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    longest = max(1, sizes.max(initial=0))
    if np.abs(x).max(initial=0) < 2.0**31 / scale / longest:
        return np.floor(scale * x).astype(np.int64), ends
    return np.array([scale * n // d for n, d in map(float.as_integer_ratio, x.tolist())], dtype=object), ends


def as_long(score: int) -> int:
    """A score as a long; one beyond 64 bits is the nearest."""
    return max(-(1 << 63), min((1 << 63) - 1, int(score)))


def postings(values: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray | slice, np.ndarray]]:
    """Rows and weights of each dimension's non-zero components; all rows are given as a slice."""
    sizes = np.diff(ends)
    row = np.repeat(np.arange(len(sizes)), sizes)
    dim = np.arange(len(values)) - np.repeat(ends[:-1], sizes)
    keep = values != 0
    row, dim, weight = row[keep], dim[keep], values[keep]
    order = np.argsort(dim, kind="stable")
    row, weight = row[order], weight[order]
    cut = np.searchsorted(dim[order], np.arange(sizes.max(initial=0) + 1))
    lists = [(row[a:b], weight[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return [(slice(None) if len(r) == len(sizes) else r, w) for r, w in lists]


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores; among equals the first ones."""
    if len(scores) <= k:
        return np.arange(len(scores))
    edge = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > edge)
    return np.concatenate([above, np.flatnonzero(scores == edge)[: k - len(above)]])


def _search(table: pa.Table, k: int, scale: int) -> pa.Table:
    is_query = table.column("is_query").to_numpy()
    rows, queries = table.filter(pa.array(~is_query)).sort_by("id"), table.filter(pa.array(is_query))
    if not rows.num_rows or not queries.num_rows:
        return _OUT.empty_table()
    ids = rows.column("id").to_numpy()
    values, ends = quantised(rows.column("vec"), scale)
    lists = postings(values, ends)
    asked, bounds = quantised(queries.column("vec"), scale)
    kind = object if object in (values.dtype, asked.dtype) else np.int64
    found = []
    for n, (tag, own) in enumerate(zip(queries.column("tag").to_pylist(), queries.column("id").to_pylist(), strict=True)):
        scores = np.zeros(len(ids), kind)
        vector = asked[bounds[n] : bounds[n + 1]]
        for d in np.flatnonzero(vector):
            if d < len(lists):
                at, weight = lists[d]
                scores[at] += vector[d] * (weight if kind is np.int64 else weight.astype(object))
        if kind is object:
            scores = np.array([as_long(s) for s in scores], np.int64)
        others = np.flatnonzero(ids != own)
        top = others[best(scores[others], k)]
        found += [(tag, own, i, s) for i, s in zip(ids[top].tolist(), scores[top].tolist(), strict=True)]
    return pa.Table.from_batches(list(batches(found, _OUT)), _OUT)


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, id, score`` of each query's ``k`` best rows by integer inner product.

    Components are floor(scale * x). Vectors that are null or hold a null or non-finite component,
    and rows without an id, take no part; a vector may be shorter than others (missing components
    are 0). Candidates are all rows with another id than the query's, repeated ones included; ties go
    to the smaller id. A query row that is repeated whole is asked once. Sums are exact; a score beyond 64 bits counts as the nearest long.
    """
    x = F.col(vec_col)
    sound = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = picked(vectors.filter(F.coalesce(sound, F.lit(False))), id=F.col(id_col).cast("bigint"), vec=F.col(vec_col).cast("array<double>"))
    asked = rows.filter(F.coalesce(is_query(F.col("id")), F.lit(False))).dropDuplicates()
    asked = checkpoint(asked.withColumn("tag", F.monotonically_increasing_id()))
    n, q = max(1, rows.count()), max(1, asked.count())
    parts, groups = max(-(-n // ROWS), min(-(-n // FEWEST), vectors.sparkSession.sparkContext.defaultParallelism)), -(-q // QUERIES)
    # each block of rows meets each block of queries in one task
    spread = lambda count: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint")))
    left = rows.select(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"), spread(groups).alias("grp"), F.lit(False).alias("is_query"), F.lit(0).cast("bigint").alias("tag"), "id", "vec")
    right = asked.select(spread(parts).alias("part"), F.pmod(F.xxhash64("tag"), F.lit(groups)).alias("grp"), F.lit(True).alias("is_query"), "tag", "id", "vec")
    met = left.unionByName(right).groupBy("part", "grp").applyInArrow(lambda t: _search(t, k, scale), "query bigint, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("vec_id").alias(id_col), "score")
