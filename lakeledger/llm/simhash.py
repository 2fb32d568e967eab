"""SimHash near-duplicates: fingerprints of word shingles, compared exactly tile by tile."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeledger.llm.common import components, picked, pieces, same, texts
from lakeledger.runtime import checkpoint, ship

ship(__name__)

SEED = 42
#: Fingerprints in one tile, and pairs of fingerprints compared at once inside a task.
TILE = 1 << 17
BLOCK = 1 << 21
#: Shingle hashes turned into bits at once.
PIECE = 1 << 18
#: Bytes of a text taken apart at once.
LONG = 1 << 20


def _hashes(text: str, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of every word shingle of a text, repeats included; long texts in several arrays."""
    before: list[bytes] = []
    any_yet = False
    data = text.encode("utf-8", "surrogatepass").lower()  # bytes: A-Z and ASCII white space only
    for piece in pieces(data, LONG):
        words = before + piece.split()
        if len(words) >= shingle:
            any_yet = True
            yield _windows(words, shingle)
        before = words[-(shingle - 1) :] if shingle > 1 else []
    if not any_yet and before:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(before), SEED)], np.uint64)


def _windows(words: list[bytes], shingle: int) -> np.ndarray:
    h, joined = xxhash.xxh64_intdigest, b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: len(words) - shingle])).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    return np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))


def _bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set, for each run of hashes that begins at ``starts``."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduceat(bits, starts, axis=0, dtype=np.int32)


def _majority(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    bits = (counts * 2 > totals[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def text_fingerprints(values: list[str], shingle: int) -> np.ndarray:
    """64-bit fingerprint of each text: bits set in over half of its shingle hashes; no words: zero."""
    out = np.zeros(len(values), np.uint64)
    held: list[np.ndarray] = []
    at: list[int] = []

    def flush() -> None:
        if held:
            sizes = np.array([len(h) for h in held])
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            out[at] = _majority(_bit_counts(np.concatenate(held), starts), sizes)
            held.clear()
            at.clear()

    waiting = 0
    for i, text in enumerate(values):
        if 4 * len(text) > LONG:  # may be several pieces
            counts, total = np.zeros(64, np.int64), 0
            for h in _hashes(text, shingle):
                counts += sum(_bit_counts(h[k : k + PIECE], np.array([0]))[0] for k in range(0, len(h), PIECE))
                total += len(h)
            if total:
                out[i] = _majority(counts[None, :], np.array([total]))[0]
            continue
        for h in _hashes(text, shingle):
            held.append(h)
            at.append(i)
            waiting += len(h)
        if waiting >= PIECE:
            flush()
            waiting = 0
    flush()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``id, text_key, fp`` of every row; ``text_key`` is the MD5 of the text ("" for none), ``fp`` a signed long."""
    key = F.md5(F.coalesce(docs[text_col], F.lit("")))
    rows = picked(docs, id=id_col, text_key=key, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            fp = text_fingerprints(texts(b.column(2)), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], names=["id", "text_key", "fp"])

    return rows.mapInArrow(run, f"id {kind}, text_key string, fp bigint")


# --- comparison -------------------------------------------------------------------------------


def _cells(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints ordered by the population counts of their four 16-bit words, and that order's key."""
    p = np.bitwise_count(fps.view(np.uint16).reshape(-1, 4)).astype(np.int64) + 8  # room for differences on both sides
    key = ((p[:, 0] * 64 + p[:, 1]) * 64 + p[:, 2]) * 64 + p[:, 3]
    order = np.argsort(key, kind="stable")
    return fps[order], key[order]


def _offsets(radius: int) -> np.ndarray:
    """Key offset of the first three counts and what the fourth may still differ by."""
    span = range(-radius, radius + 1)
    left = [((i * 64 + j) * 64 + k) * 64 for i in span for j in span for k in span if abs(i) + abs(j) + abs(k) <= radius]
    rest = [radius - abs(i) - abs(j) - abs(k) for i in span for j in span for k in span if abs(i) + abs(j) + abs(k) <= radius]
    return np.array([left, rest])


def _join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the classes of linked nodes; a class is named by its smallest index."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        if not len(i):
            return
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, nxt := label[label]):
            label[:] = nxt


def forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as stars, of the links within ``radius`` bits between two tiles (or inside one).

    Small tiles of equal word counts are compared by exclusive-or and bit counts; pairs of them
    whose counts differ by more than the radius in sum are skipped.
    """
    a, ka = _cells(left)
    b, kb = (a, ka) if right is None else _cells(right)
    shift = 0 if right is None else len(a)
    nodes = a if right is None else np.concatenate([a, b])
    label = np.arange(len(nodes))
    heads = np.flatnonzero(np.concatenate(([True], ka[1:] != ka[:-1])))
    tails = np.concatenate((heads[1:], [len(a)]))
    move, rest = _offsets(radius)
    near = ka[heads][:, None] + move[None, :]
    lo = np.searchsorted(kb, near - rest)
    hi = np.searchsorted(kb, near + rest, side="right")
    if right is None:
        lo = np.maximum(lo, heads[:, None])
    for head, tail, los, his in zip(heads.tolist(), tails.tolist(), lo, hi, strict=True):
        size = his - los
        some = size > 0
        if not some.any():
            continue
        los, size = los[some], size[some]
        before = np.cumsum(size) - size
        other = np.repeat(los - before, size) + np.arange(size.sum())
        step = max(1, BLOCK // len(other))
        for k in range(head, tail, step):
            rows = a[k : min(k + step, tail)]
            for m in range(0, len(other), BLOCK):
                cols = other[m : m + BLOCK]
                i, j = np.nonzero(np.bitwise_count(rows[:, None] ^ b[cols][None, :]) <= radius)
                if len(i):
                    _join_labels(label, i + k, cols[j] + shift)
    linked = np.flatnonzero(label != np.arange(len(label)))
    return nodes[linked], nodes[label[linked]]


def links(fps: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """Edges ``u, v`` that connect all distinct fingerprints ``fps(fp)`` within ``radius`` bits of each other.

    Fingerprints are dealt into tiles of one population count and about ``tile`` rows; each pair of
    tiles whose counts differ by at most the radius meets in one task, which returns a spanning
    forest of its links, never all pairs. ``fps`` must be a written table; the driver reads no more
    than the 65 sizes by population count.
    """
    rows = fps.select("fp", F.bit_count("fp").alias("pop"))
    sizes = {r["pop"]: r["n"] for r in rows.groupBy("pop").agg(F.count("*").alias("n")).collect()}
    parts = [-(-sizes.get(p, 0) // tile) for p in range(65)]
    first = [sum(parts[:p]) for p in range(66)]
    lows = [first[max(0, p - radius)] for p in range(65)]
    tops = [first[min(65, p + radius + 1)] for p in range(65)]
    table = lambda xs: F.array(*[F.lit(x) for x in xs])
    at = lambda xs: F.element_at(table(xs), F.col("pop") + 1)
    own = (at(first) + F.pmod(F.xxhash64("fp"), at(parts))).cast("int")
    pairs = rows.select("fp", own.alias("own"), F.explode(F.sequence(at(lows), at(tops) - 1)).alias("other"))
    pairs = pairs.select("fp", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") <= F.col("other")).alias("is_a"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf["fp"].to_numpy().view(np.uint64)
        if pdf["a"].iat[0] == pdf["b"].iat[0]:
            u, v = forest(fp, None, radius)
        else:
            is_a = pdf["is_a"].to_numpy()
            left, right = fp[is_a], fp[~is_a]
            if not len(left) or not len(right):
                return pd.DataFrame({"u": [], "v": []}).astype("int64")
            u, v = forest(left, right, radius)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return pairs.groupBy("a", "b").applyInPandas(compare, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """Near-duplicate class of every row: ``id_col, text_key, fingerprint, component_id, class_print``.

    Words are runs without ASCII white space, A-Z lower-cased; a text of fewer than ``shingle`` words
    is one shingle, a text without words (empty or null) has fingerprint zero. ``component_id`` is the
    smallest id reachable over links of at most ``radius`` differing bits, ``class_print`` the class's
    smallest fingerprint (it tells classes apart even where ids repeat or are null). Equal fingerprints are one
    node, so copies cost nothing; rows with a null id take part, and their class is null only if no
    row of it has an id. Repeated rows are kept. Other columns are left out.
    """
    slim = checkpoint(fingerprints(docs, id_col, text_col, shingle))
    fps = checkpoint(slim.groupBy("fp").agg(F.min("id").alias("least")))
    linked = checkpoint(components(links(fps.select("fp"), radius)))
    # rename: both sides come from tables with a column of that name
    root = fps.join(linked.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    best = root.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = checkpoint(root.join(best, "root").select(F.col("fp").alias("_fp"), "component_id", "root"))
    digits = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return slim.join(by_fp, slim["fp"] == by_fp["_fp"]).select(
        F.col("id").alias(id_col), "text_key", digits("fp").alias("fingerprint"), "component_id", digits("root").alias("class_print")
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """``docs`` with one row of each near-duplicate class: the smallest id, then the smallest text digest.

    All columns stay. Rows that repeat an id and a text are one document. A class whose rows have no
    id keeps the row of the smallest digest.
    """
    found = near_duplicates(docs, id_col, text_col, shingle, radius)
    named = found.select(F.col(id_col).alias("id"), "text_key", "class_print")
    rank = F.struct(F.col("id").isNull().alias("z"), "id", "text_key")
    best = named.groupBy("class_print").agg(F.min(rank).alias("r"))
    ids = named.groupBy("id", "text_key").agg(F.count("*").alias("n"))
    best = best.select(F.col("r.id").alias("id"), F.col("r.text_key").alias("text_key"))
    keep = checkpoint(best.join(ids, same(best, ids, {"id": "id", "text_key": "text_key"})).select(best["id"].alias("_id"), best["text_key"].alias("_key"), "n"))
    key = F.md5(F.coalesce(docs[text_col], F.lit("")))

    def of(rows: DataFrame) -> DataFrame:
        return docs.join(rows, docs[id_col].eqNullSafe(rows["_id"]) & (key == rows["_key"]), "left_semi")

    single = of(keep.filter("n = 1"))
    if not keep.filter("n > 1").limit(1).count():
        return single
    again = of(keep.filter("n > 1"))
    return single.unionByName(again.withColumn("_simhash_key", key).dropDuplicates([id_col, "_simhash_key"]).drop("_simhash_key"))
