"""Hard negatives from blocks along a Hilbert curve.

Rows are ordered along a Hilbert curve through their widest dimensions and cut into blocks, written as
Parquet; a zone map keeps the least and greatest value of every dimension of a block. For an anchor,
interval arithmetic on a zone map bounds the scores that any row of the block can have. A block is read
for an anchor's positives only if it may hold a score as high as the best found in the anchor's own block,
and for its negatives only if the bounds meet one of the windows that its positives open. Bounds are never
too narrow, so nothing is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeledger.llm.common import picked
from lakeledger.runtime import checkpoint, ship

ship(__name__)

#: Rows of a block, blocks a task reads at once, anchors that read them together.
BLOCK, BLOCKS, ANCHORS = 1_024, 16, 4_096
#: Dimensions of the curve and bits of each.
DIMS, BITS = 8, 7
#: Zone maps that a task compares with a group of anchors.
ZONES = 4_096
#: Bounds are widened by this part, for the rounding of sums.
SLACK = 1e-9

_ROW = "id bigint, label bigint, vec array<double>, is_anchor boolean"


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of ``cells`` (n x dimensions, below ``2**bits``) on the Hilbert curve (Skilling's transform)."""
    x = cells.T.astype(np.int64).copy()
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for axis in x:
            turned = (axis & q) != 0
            swap = np.where(turned, 0, (x[0] ^ axis) & low)
            x[0] ^= np.where(turned, low, swap)
            axis ^= swap
        q >>= 1
    for k in range(1, len(x)):
        x[k] ^= x[k - 1]
    flip, q = np.zeros(x.shape[1], np.int64), 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    place = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for axis in x:
            place = place << 1 | (axis >> b & 1)
    return place


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as the rows of a matrix, shorter ones filled up with 0."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width))
    if len(flat):
        row = np.repeat(np.arange(len(sizes)), sizes)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): doubles if they are exact, else Python integers."""
    if np.abs(x).max(initial=0) * scale < 2.0**53:
        return np.floor(scale * x)
    flat = [int(v) * scale if abs(v) >= 2.0**53 else (v.as_integer_ratio()[0] * scale) // v.as_integer_ratio()[1] for v in x.ravel().tolist()]
    return np.array(flat, dtype=object).reshape(x.shape)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``a`` with all of ``b``; one beyond 64 bits as the nearest long."""
    if a.dtype != object and b.dtype != object:
        if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1]) < 2.0**53:
            return (a @ b.T).astype(np.int64)
    exact = lambda m: m if m.dtype == object else np.array([int(v) for v in m.ravel().tolist()], dtype=object).reshape(m.shape)
    found = exact(a).dot(exact(b).T)
    return np.array([as_long(v) for v in found.ravel().tolist()], dtype=np.int64).reshape(found.shape)


def as_long(score: int) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, score))


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each anchor with any vector between ``low`` and ``high``."""
    plus, minus = np.maximum(anchors, 0), np.minimum(anchors, 0)
    wide = SLACK * (np.abs(anchors) @ np.maximum(np.abs(low), np.abs(high)).T)
    return plus @ low.T + minus @ high.T - wide, plus @ high.T + minus @ low.T + wide


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best scores, ties to the smaller id."""
    at = np.arange(len(scores))
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge)
    return np.array(sorted(at.tolist(), key=lambda n: (-int(scores[n]), ids[n]))[:k], dtype=np.int64)


# --- blocks and zone maps ---


def widest(rows: DataFrame) -> tuple[int, list[int], list[float], list[float]]:
    """Width of the longest vector; the dimensions of greatest variance, with their least and greatest values."""
    width = rows.agg(F.coalesce(F.max(F.size("vec")), F.lit(0))).first()[0]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(0), width)
            with np.errstate(over="ignore"):
                columns = (np.arange(width), np.full(width, len(x)), x.sum(0), (x * x).sum(0), x.min(0, initial=0), x.max(0, initial=0))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["dim", "n", "s", "q", "low", "high"])

    found = rows.select("vec").mapInArrow(sums, "dim bigint, n bigint, s double, q double, low double, high double")
    found = found.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("low").alias("low"), F.max("high").alias("high"))
    spread = F.when(F.col("n") > 0, F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), F.lit(2)))
    top = sorted(found.orderBy(F.desc(spread), "dim").limit(DIMS).collect(), key=lambda r: r["dim"])
    return width, [r["dim"] for r in top], [r["low"] for r in top], [r["high"] for r in top]


def blocks(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows(id, label, vec, is_anchor)`` along the curve, with the ``block`` each belongs to, written; and the vectors' width."""
    width, dims, low, high = widest(rows)
    start, span = np.array(low), np.maximum(np.array(high) - np.array(low), 1e-300)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(2), width)[:, dims]
            with np.errstate(over="ignore", invalid="ignore"):
                cells = np.nan_to_num((x - start) / span * (1 << BITS)).clip(0, (1 << BITS) - 1).astype(np.int64)
            place = hilbert(cells, BITS) if dims else np.zeros(len(x), np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place)], names=[*b.schema.names, "place"])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, part = 0, TaskContext.get().partitionId() << 32
        for b in batches:
            block = part + (n + np.arange(b.num_rows)) // BLOCK
            n += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(block, pa.int64())], names=[*b.schema.names, "block"])

    parts = -(-max(1, rows.count()) // (BLOCK * BLOCKS))
    along = rows.mapInArrow(keyed, _ROW + ", place bigint").repartitionByRange(parts, "place", "id")
    along = along.sortWithinPartitions("place", "id").drop("place")
    return checkpoint(along.mapInArrow(numbered, _ROW + ", block bigint")), width


def zone_maps(stored: DataFrame, width: int, scale: int) -> DataFrame:
    """``block, low, high, labels`` of every block: least and greatest whole number of each dimension, labels held."""
    schema = "block bigint, low array<double>, high array<double>, labels array<bigint>"
    names = ["block", "low", "high", "labels"]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block, label = b.column(0).to_numpy(), b.column(1).to_numpy()
            with np.errstate(over="ignore"):
                x = np.floor(scale * matrix(b.column(2), width)).clip(-1e300, 1e300)
            seen = np.unique(block)
            held = [block == k for k in seen]
            columns = [pa.array(seen, pa.int64()), pa.array([x[h].min(0) for h in held], pa.list_(pa.float64())), pa.array([x[h].max(0) for h in held], pa.list_(pa.float64())), pa.array([np.unique(label[h]) for h in held], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def merged(t: pa.Table) -> pa.Table:
        low, high = (matrix(t.column(c), width) for c in ("low", "high"))
        labels = sorted(set(t.column("labels").combine_chunks().flatten().to_pylist()))
        return pa.table({"block": t.column("block")[:1], "low": [low.min(0)], "high": [high.max(0)], "labels": [labels]}, schema=pa.schema([("block", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("labels", pa.list_(pa.int64()))]))

    # a block lies in one file, so it has a row for each Arrow batch that holds some of it
    return stored.select("block", "label", "vec").mapInArrow(part, schema).groupBy("block").applyInArrow(merged, schema)


# --- which blocks to read, and reading them ---


class Asked:
    """Anchors of a group: whole numbers, labels, ids, the floors of their positives or the windows of their negatives."""

    def __init__(self, t: pa.Table, width: int, scale: int, low: int, high: int):
        self.tags, self.ids, self.labels = (t.column(c).to_numpy() for c in ("tag", "id", "label"))
        self.vectors = whole(matrix(t.column("vec"), width), scale)
        self.plain = self.vectors.astype(float)
        self.floors = np.array([-np.inf if f is None else float(f) for f in t.column("floor").to_pylist()])
        # windows as whole numbers: low * positive <= 100 * score <= high * positive
        self.windows = [[(n, -(-low * s // 100), high * s // 100) for n, s in enumerate(w or [])] for w in t.column("windows").to_pylist()]

    def meet(self, low: np.ndarray, high: np.ndarray, labels: list[list[int]], same: bool) -> np.ndarray:
        """Whether each anchor must read each block (anchors x blocks)."""
        least, most = bounds(self.plain, low, high)
        if same:
            held = [set(x) for x in labels]
            known = {one: np.array([one in h for h in held]) for one in set(self.labels.tolist())}
            return (most >= self.floors[:, None]) & np.array([known[one] for one in self.labels.tolist()])
        only = np.array([x[0] if len(x) == 1 else 0 for x in labels])
        mixed = np.array([len(x) > 1 for x in labels])
        out = np.zeros(most.shape, bool)
        for k, windows in enumerate(self.windows):
            for _, a, z in windows:
                if a <= z:
                    out[k] |= (most[k] >= float(a) - abs(a) * SLACK) & (least[k] <= float(z) + abs(z) * SLACK)
            out[k] &= mixed | (only != self.labels[k])
        return out


def _read(rows: pa.Table, asked: Asked, width: int, scale: int, same: bool, k: int) -> Iterator[tuple]:
    """(anchor's tag, window, id, score): the ``k`` best of these rows for each anchor, in each of its windows."""
    found: list[dict[int, list[tuple]]] = [{} for _ in asked.tags]
    block = rows.column("block").to_numpy()
    for one in np.unique(block):
        part = rows.filter(pa.array(block == one))
        ids, labels, vectors = part.column("id").to_numpy(), part.column("label").to_numpy(), whole(matrix(part.column("vec"), width), scale)
        plain = vectors.astype(float)
        wanted = np.flatnonzero(asked.meet(plain.min(0, keepdims=True), plain.max(0, keepdims=True), [np.unique(labels).tolist()], same)[:, 0])
        if not len(wanted):
            continue
        scores = products(asked.vectors[wanted], vectors)
        for a, s in zip(wanted.tolist(), scores, strict=True):
            others = ids != asked.ids[a]
            if same:
                at = np.flatnonzero(others & (labels == asked.labels[a]))
                top = at[best(s[at], ids[at], k)]
                held = found[a].setdefault(0, [])
                held += [(-int(s[n]), int(ids[n])) for n in top]
                held.sort()
                del held[k:]
                if len(held) == k:
                    asked.floors[a] = max(asked.floors[a], float(-held[-1][0]))
                continue
            windows = [w for w in asked.windows[a] if w[1] <= w[2]]
            least = as_long(min(w[1] for w in windows))
            at = np.flatnonzero(others & (labels != asked.labels[a]) & (s >= least) & (s <= as_long(max(w[2] for w in windows))))
            ranked = sorted((-int(s[n]), int(ids[n])) for n in at)
            for name, a_low, z_high in windows:
                held = found[a].setdefault(name, [])
                first = next((n for n, (m, _) in enumerate(ranked) if -m <= z_high), len(ranked))
                held += [x for x in ranked[first : first + k] if -x[0] >= a_low]
                held.sort()
                del held[k:]
    for tag, windows in zip(asked.tags.tolist(), found, strict=True):
        for name, held in windows.items():
            yield from ((tag, name, i, -m) for m, i in held)


def _search(anchors: DataFrame, stored: DataFrame, zones: DataFrame, width: int, scale: int, same: bool, k: int, low: int = 0, high: int = 0) -> DataFrame:
    """``tag, name, rank, id, score``: the best of all rows for each anchor's windows.

    First the groups of anchors meet the zone maps, a page of them at a time; then each group reads,
    some neighbouring blocks at a time, those that one of its anchors needs.
    """
    names = ["grp", "tag", "id", "label", "vec", "floor", "windows"]
    groups = anchors.agg(F.coalesce(F.max("grp"), F.lit(0))).first()[0] + 1
    pages = -(-max(1, zones.count()) // ZONES)
    none = lambda kind: F.lit(None).cast(kind)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.select(every(pages).alias("page"), *names, none("bigint").alias("block"), none("array<double>").alias("low"), none("array<double>").alias("high"), none("array<bigint>").alias("labels"))
    right = zones.select(F.pmod(F.xxhash64("block"), F.lit(pages)).cast("int").alias("page"), every(groups).alias("grp"), "block", "low", "high", "labels")

    def plan(t: pa.Table) -> pa.Table:
        is_zone = t.column("block").is_valid()
        z, a = t.filter(is_zone), t.filter(pa.compute.invert(is_zone))
        if not z.num_rows or not a.num_rows:
            return pa.table({"grp": pa.array([], pa.int32()), "block": pa.array([], pa.int64())})
        needed = Asked(a, width, scale, low, high).meet(matrix(z.column("low"), width), matrix(z.column("high"), width), z.column("labels").to_pylist(), same).any(0)
        block = z.column("block").filter(pa.array(needed))
        return pa.table({"grp": pa.array([a.column("grp")[0].as_py()] * len(block), pa.int32()), "block": block})

    needed = checkpoint(left.unionByName(right, allowMissingColumns=True).groupBy("page", "grp").applyInArrow(plan, "grp int, block bigint"))
    chunk = F.expr(f"block div {BLOCKS}").alias("chunk")
    rows = stored.join(needed, "block").select("grp", chunk, "block", "id", "label", "vec")
    askers = needed.select("grp", chunk).distinct().join(anchors, "grp").select("chunk", *names)

    def read(t: pa.Table) -> pa.Table:
        is_row = t.column("block").is_valid()
        asked = Asked(t.filter(pa.compute.invert(is_row)), width, scale, low, high)
        out = list(_read(t.filter(is_row), asked, width, scale, same, k))
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("tag", "name", "id", "score"), zip(*out, strict=True) if out else [[]] * 4, strict=True)})

    met = rows.unionByName(askers, allowMissingColumns=True).groupBy("grp", "chunk").applyInArrow(read, "tag bigint, name bigint, id bigint, score bigint")
    order = Window.partitionBy("tag", "name").orderBy(F.desc("score"), "id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Callable[[Column], Column],
    label: Column | None = None,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    scale: int = 256,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    A row's score with an anchor is the inner product of floor(scale * x) of their components.
    An anchor's positives are its best ``positives`` rows of its label; for each of them, negatives are the
    best ``negatives`` rows of other labels whose score lies in ``low`` to ``high`` per cent of the
    positive's. Ties go to the smaller id. ``label`` may replace the label's column by an expression.

    Rows without an id, a label or a vector, or with a null or non-finite component, take no part. Rows
    with the anchor's id are never its positives or negatives. Repeated rows count each as candidates; an
    anchor repeated whole is asked once. A vector may be shorter than others (missing components are 0). Sums are
    exact; a score beyond 64 bits counts as the nearest long. A negative positive score opens no window. An empty table gives no rows.
    """
    x = F.col(vec_col)
    sound = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    label = F.col(label_col) if label is None else label
    rows = picked(vectors.filter(F.coalesce(sound, F.lit(False))), id=F.col(id_col).cast("bigint"), label=label.cast("bigint"), vec=F.col(vec_col).cast("array<double>"), is_anchor=F.coalesce(is_anchor(F.col(id_col)), F.lit(False)))
    stored, width = blocks(rows)
    zones = checkpoint(zone_maps(stored, width, scale))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors, with the score that their worst positive has at least, by the rows around them."""
        for b in batches:
            ids, labels, block = (b.column(k).to_numpy() for k in (0, 1, 4))
            at = np.flatnonzero(b.column(3).to_numpy(zero_copy_only=False))
            if not len(at):
                continue
            all_of = whole(matrix(b.column(2), width), scale)
            floors = []
            for n in at:
                near = np.flatnonzero((block == block[n]) & (labels == labels[n]) & (ids != ids[n]))
                s = products(all_of[n : n + 1], all_of[near])[0]
                floors.append(int(s[best(s, ids[near], positives)[-1]]) if len(near) >= positives else None)
            yield pa.RecordBatch.from_arrays([*pa.RecordBatch.from_arrays(b.columns, names=b.schema.names).take(pa.array(at)).columns[:3], pa.array(block[at]), pa.array(floors, pa.int64())], names=["id", "label", "vec", "block", "floor"])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, part = 0, TaskContext.get().partitionId()
        for b in batches:
            tag = (part << 32) + n + np.arange(b.num_rows)
            n += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tag, pa.int64())], names=[*b.schema.names, "tag"])

    schema = "id bigint, label bigint, vec array<double>, block bigint, floor bigint"
    asked = stored.mapInArrow(home, schema).dropDuplicates(["id", "label", "vec"])
    asked = checkpoint(asked)
    groups = -(-max(1, asked.count()) // ANCHORS)
    # neighbours along the curve ask together; a written table keeps their numbers
    asked = checkpoint(asked.repartitionByRange(groups, "block", "id").mapInArrow(numbered, schema + ", tag bigint"))
    part = F.shiftright("tag", 32)
    parts = asked.agg(F.coalesce(F.max(part), F.lit(0))).first()[0] + 1
    asked = asked.withColumns({"grp": F.floor(part * F.lit(groups) / F.lit(parts)).cast("int"), "windows": F.lit(None).cast("array<bigint>")})
    best_rows = checkpoint(_search(asked, stored, zones, width, scale, True, positives))
    opened = best_rows.groupBy("tag").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("p"))
    again = checkpoint(asked.drop("windows").join(opened, "tag").select("*", F.col("p.score").alias("windows")))
    found = _search(again.drop("p"), stored, zones, width, scale, False, negatives, low, high)
    named = found.select("tag", "name", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(again.select("tag", F.col("id").alias("anchor_id"), "p"), "tag")
    positive = F.element_at("p", (F.col("name") + 1).cast("int"))
    return named.select("anchor_id", positive["id"].alias("positive_id"), "rank", "negative_id", positive["score"].alias("positive_score"), "negative_score")
