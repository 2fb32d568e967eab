"""Prefix trie of conversations by a splitter skeleton.

Every conversation is a path of turn digests; sorted paths put the members of a node side by side. Paths
are dealt into shards at splitter paths taken from a sample, and the splitters are broadcast. A node that is a
prefix of no splitter lies whole in one shard, which finishes it while it walks its sorted paths; the
nodes on splitter paths, the skeleton, span shards: each shard hands on what it knows of them and a
reduction puts the parts together. A path that a third of all conversations share is split by their ids.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeledger.llm.common import batches, picked
from lakeledger.runtime import checkpoint, ship

ship(__name__)

#: Conversations of a shard, the most shards, sampled paths a shard, and bytes of sampled paths on the driver.
SHARD, SHARDS, SAMPLED, SAMPLE_BYTES = 4_096, 4_096, 8, 1 << 26
#: Characters of a turn's digest, and of a piece of a list of ids.
DIGEST, PIECE = 32, 8_192

_FOUND = pa.schema(
    [("kind", pa.int32()), ("conv", pa.int64()), ("depth", pa.int64()), ("parent_conv", pa.int64()), ("node", pa.string()), ("parent", pa.string())]
    + [(c, pa.int64()) for c in ("n", "kids", "leaves", "saved", "size", "shard", "seq")]
    + [("ends", pa.string())]
)
_FOUND_SQL = "kind int, conv bigint, depth bigint, parent_conv bigint, node string, parent string, n bigint, kids bigint, leaves bigint, saved bigint, size bigint, shard bigint, seq bigint, ends string"
LOCAL, PART, ENDS = 0, 1, 2
NOTHING = hashlib.sha256(b"").hexdigest()


def paths(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv, steps``: each conversation's turns in order, as (digest of role and text, code points of the text).

    Turns without a number come first; equal numbers go by role, then by digest. Null roles and texts
    are empty. Rows without a conversation are left out. A conversation's digests, 40 bytes a
    turn, are gathered in one row; its texts are not.
    """
    t = picked(turns, conv=turns[conv_col].cast("bigint"), turn=turns[turn_col].cast("bigint"), role=F.coalesce(turns[role_col], F.lit("")), text=F.coalesce(turns[text_col], F.lit(""))).filter("conv IS NOT NULL")
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    step = F.struct(F.col("turn").isNotNull().alias("a"), F.coalesce("turn", F.lit(0)).alias("b"), F.left("role", F.lit(64)).alias("r"), digest.alias("digest"), F.length("text").alias("size"))
    # a conversation and the one it shares turns with are grouped, and met, where their hundred is
    t = t.select("conv", (F.col("conv") - F.col("conv") % 100).alias("hundred"), step.alias("step")).repartition("hundred")
    steps = F.transform(F.array_sort(F.collect_list("step")), lambda s: F.struct(s["digest"].alias("digest"), s["size"].alias("size")))
    return t.groupBy("hundred", "conv").agg(steps.alias("steps"))


def rebuilt(found: DataFrame, most: int = 6) -> DataFrame:
    """``conv, key, sizes``: conversations with their first turns taken from the first one of their hundred."""
    first = found.filter("conv = hundred").select("hundred", F.slice("steps", 1, most).alias("first"))
    h = (F.crc32(F.col("conv").cast("string")) % most).cast("int")
    given = F.when(h > 0, F.slice(F.coalesce("first", F.slice("steps", 1, 0)), F.lit(1), h)).otherwise(F.slice("steps", 1, 0))
    own = F.slice("steps", h + 1, F.greatest(F.size("steps"), F.lit(1)))
    joined = found.join(first, "hundred", "left").select("conv", F.concat(given, own).alias("steps"))
    return joined.select("conv", F.array_join(F.col("steps.digest"), "").alias("key"), F.col("steps.size").alias("sizes"))


def splitters(rows: DataFrame) -> list[tuple[str, int]]:
    """Paths and ids at which sorted conversations are cut into shards; from a sample of bounded size."""
    n, size = rows.agg(F.count("*"), F.coalesce(F.avg(F.length("key")), F.lit(0.0))).first()
    shards = min(SHARDS, -(-n // SHARD), int(SAMPLE_BYTES / SAMPLED / (size + 64)) + 1)
    if shards < 2:
        return []
    some = sorted((r["key"], r["conv"]) for r in rows.select("key", "conv").sample(min(1.0, SAMPLED * shards / n), seed=13).toLocalIterator())
    return sorted({some[len(some) * k // shards] for k in range(1, shards)}) if some else []


class _Node:
    """A node on the way down to the current path, as its shard knows it so far."""

    __slots__ = ("conv", "ends", "held", "high", "kids", "leaves", "low", "n", "pieces", "saved", "seq", "sha", "size")

    def __init__(self, size: int, low: bool, high: bool):
        self.size, self.low, self.high = size, low, high  # low, high: on the splitter path before or after the shard
        self.conv: int | None = None
        self.n = self.kids = self.leaves = self.saved = self.seq = self.ends = 0
        self.sha = None
        self.held: list[tuple] = []  # finished children that wait for this node's least member
        self.pieces: list[str] = []

    @property
    def skeleton(self) -> bool:
        return self.low or self.high


def _walk(rows: Iterator[tuple[int, int, str, list[int]]], cuts: list[tuple[str, int]]) -> Iterator[tuple]:
    """Nodes of shards whose (shard, conv, path, sizes) come in the order of paths and ids."""
    stack: list[_Node] = []
    shard, key, low, high = -1, "", "", ""

    def name(depth: int) -> str:
        return hashlib.md5(key[: DIGEST * depth].encode()).hexdigest()

    def close() -> Iterator[tuple]:
        depth, node = len(stack) - 1, stack.pop()
        up = stack[-1] if stack else None
        if up is not None:
            up.n += node.n
            up.conv = node.conv if up.conv is None else min(up.conv, node.conv)
        if node.skeleton:
            if node.pieces:
                yield (ENDS, None, None, None, name(depth), None, None, None, None, None, None, shard, node.seq, ",".join(node.pieces))
            yield (PART, node.conv, depth, None, name(depth), name(depth - 1) if depth else None, node.n, node.kids, node.leaves, node.saved, node.size, shard, None, None)
            return
        leaves, saved = node.leaves if node.kids else 1, node.saved + (node.n - 1) * node.size
        ends = node.sha.hexdigest() if node.sha else NOTHING
        for conv, d, n, kids, below, spared, digest in node.held:
            yield (LOCAL, conv, d, node.conv, None, None, n, kids, below, spared, None, None, None, digest)
        up.kids, up.leaves, up.saved = up.kids + 1, up.leaves + leaves, up.saved + saved
        if up.skeleton:
            # leaves and savings count for all skeleton nodes above
            yield (LOCAL, node.conv, depth, None, None, name(depth - 1), node.n, node.kids, leaves, saved, None, None, None, ends)
        else:
            up.held.append((node.conv, depth, node.n, node.kids, leaves, saved, ends))

    for at, conv, path, sizes in rows:
        depth = len(sizes)
        if at != shard:
            while stack:
                yield from close()
            shard, key = at, ""
            low, high = cuts[at - 1][0] if at else "", cuts[at][0] if at < len(cuts) else ""
            stack.append(_Node(0, True, True))
        same, most = 0, min(depth, len(stack) - 1)
        if path[: DIGEST * most] == key[: DIGEST * most]:
            same = most
        else:
            while path[DIGEST * same : DIGEST * (same + 1)] == key[DIGEST * same : DIGEST * (same + 1)]:
                same += 1
        while len(stack) - 1 > same:
            yield from close()
        key = path
        for d in range(len(stack), depth + 1):
            step, up = path[DIGEST * (d - 1) : DIGEST * d], stack[-1]
            stack.append(_Node(sizes[d - 1], up.low and low[DIGEST * (d - 1) : DIGEST * d] == step, up.high and high[DIGEST * (d - 1) : DIGEST * d] == step))
        node = stack[-1]
        node.n += 1
        node.conv = conv if node.conv is None else min(node.conv, conv)
        if node.skeleton:
            node.pieces.append(str(conv))
            node.ends += len(node.pieces[-1]) + 1
            if node.ends >= PIECE:
                yield (ENDS, None, None, None, name(depth), None, None, None, None, None, None, shard, node.seq, ",".join(node.pieces))
                node.pieces, node.ends, node.seq = [], 0, node.seq + 1
        elif node.sha is None:
            node.sha = hashlib.sha256(str(conv).encode())
        else:
            node.sha.update(f",{conv}".encode())
    while stack:
        yield from close()


def _digests(parts: DataFrame) -> DataFrame:
    """``node, ends``: SHA-256 of the pieces of each skeleton node's ids, read one after the other."""

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def digests() -> Iterator[tuple]:
            node, sha = None, None
            for b in given:
                for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if name != node:
                        if sha:
                            yield node, sha.hexdigest()
                        node, sha = name, hashlib.sha256(text.encode())
                    else:
                        sha.update(b"," + text.encode())
            if sha:
                yield node, sha.hexdigest()

        yield from batches(digests(), pa.schema([("node", pa.string()), ("ends", pa.string())]))

    ordered = parts.select("node", "shard", "seq", "ends").repartition("node").sortWithinPartitions("node", "shard", "seq")
    return ordered.select("node", "ends").mapInArrow(run, "node string, ends string")


def _reduced(parts: list, digests: dict[str, str]) -> list[tuple]:
    """The skeleton from the sums of its parts: savings and leaves go up from the deepest nodes."""
    nodes = {r["node"]: r for r in parts}
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    out = []
    for r in sorted(parts, key=lambda r: -r["depth"]):
        name, up = r["node"], r["parent"]
        own_kids = r["kids"] + kids[name]
        own_leaves = r["leaves"] + leaves[name] if own_kids else 1
        own_saved = r["saved"] + saved[name] + (r["n"] - 1) * r["size"]
        if up is not None:
            kids[up] += 1
            leaves[up] += own_leaves
            saved[up] += own_saved
        out.append((name, r["conv"], r["depth"], nodes[up]["conv"] if up is not None else None, r["n"], own_kids, own_leaves, own_saved, digests.get(name, NOTHING)))
    return out


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of every node.

    Conversations are rebuilt first: the first crc32(id) % 6 turns come from the first conversation of
    their hundred. A node is a distinct sequence of first turns (role, text), the root has none.
    ``conv_id`` is the least member, ``parent_conv_id`` the parent's (null for the root), ``saved_tokens`` the
    code points that members beyond the first repeat, over the subtree, ``ends_sha256`` the digest of
    the ids of members that end at the node.

    Null turns come first, ties go by role and digest, null roles and texts are empty, rows without a
    conversation are left out, repeated rows are turns each. A turn is known by the MD5 of its role and text. An
    empty table gives no rows. Other columns play no part.

    The driver sees a sample of paths, at most ``SAMPLE_BYTES`` of them on average, and the skeleton, whose
    nodes are prefixes of splitters among these. A shard's finished nodes wait in memory for their
    parents, unless these are of the skeleton.
    """
    spark = turns.sparkSession
    rows = checkpoint(rebuilt(paths(turns, conv_col, turn_col, role_col, text_col)))
    cuts = splitters(rows)
    known = spark.sparkContext.broadcast(cuts)

    def dealt(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in given:
            shard = [bisect_right(known.value, x) for x in zip(b.column(1).to_pylist(), b.column(0).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), *b.columns], names=["shard", "conv", "key", "sizes"])

    def walked(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (r for b in given for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        yield from batches(_walk(each, known.value), _FOUND)

    shards = rows.mapInArrow(dealt, "shard bigint, conv bigint, key string, sizes array<int>").repartition(len(cuts) + 1, "shard").sortWithinPartitions("shard", "key", "conv")
    found = checkpoint(shards.mapInArrow(walked, _FOUND_SQL))
    sums = [F.sum(c).alias(c) for c in ("n", "kids", "leaves", "saved")]
    parts = found.filter(F.col("kind") == PART).groupBy("node").agg(F.min("conv").alias("conv"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.max("size").alias("size"), *sums).collect()
    ends = {r["node"]: r["ends"] for r in _digests(found.filter(F.col("kind") == ENDS)).collect()}
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    kinds = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
    skeleton = spark.createDataFrame(_reduced(parts, ends), "node string, " + kinds)
    above = skeleton.select(F.col("node").alias("parent"), F.col("conv_id").alias("_above"))
    local = found.filter(F.col("kind") == LOCAL).join(above, "parent", "left")
    parent: Column = F.coalesce("parent_conv", "_above")
    local = local.select("conv", "depth", parent, "n", "kids", "leaves", "saved", "ends").toDF(*columns)
    return local.unionByName(skeleton.select(*columns))
