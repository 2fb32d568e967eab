"""Sharding by longest-processing-time scheduling: whole groups, largest first, to the least-loaded shard.

Groups of equal texts stay together. One heap over all groups would have to see them in one place,
so the schedule has two steps. Each task runs the rule over its own random part of the small groups
and fills a fixed number of bins through a heap, largest group first; the driver then runs it over
all bins and the few groups that are large beside a shard, largest first, through one heap of
shards. The driver sees a number of items bounded by its parameters, however many groups there are.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeledger.llm.common import picked, unused
from lakeledger.runtime import checkpoint, ship

ship(__name__)

#: Bins in all (while parts are few), parts at most, groups of a part, and the part of a shard from
#: which a group is dealt by itself (so 500 a shard at most).
BINS, PARTS, PART_GROUPS, LARGE = 8_192, 2_000, 20_000, 500
#: Bytes that a row costs besides its text.
ROW_BYTES = 16


def least_loaded(sizes: list[int], shards: int) -> list[int]:
    """Shard of each item: by size, largest first, to the least-loaded shard (ties: lowest number)."""
    heap = [(0, s) for s in range(shards)]
    out = [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        load, s = heapq.heappop(heap)
        out[k] = s
        heapq.heappush(heap, (load + sizes[k], s))
    return out


def _fill_bins(groups: DataFrame, parts: int, bins: int) -> DataFrame:
    """``digest, part, bin`` of each small group, filled largest first through a heap in each part."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heap: list[tuple[int, int]] = []
        now = None
        for f in frames:
            out = []
            for part, size in zip(f["part"].tolist(), f["bytes"].tolist()):
                if part != now:
                    now, heap = part, [(0, b) for b in range(bins)]
                load, b = heap[0]
                heapq.heapreplace(heap, (load + size, b))
                out.append(b)
            yield pd.DataFrame({"digest": f["digest"], "part": f["part"], "bin": out, "bytes": f["bytes"]})

    dealt = groups.withColumn("part", F.pmod(F.xxhash64("digest"), F.lit(parts)).cast("int"))
    ordered = dealt.repartition(parts, "part").sortWithinPartitions("part", F.col("bytes").desc(), "digest").select("digest", "part", "bytes")
    return ordered.mapInPandas(run, "digest string, part int, bin int, bytes bigint")


def shards_of_groups(groups: DataFrame, shards: int) -> DataFrame:
    """``digest, shard`` for groups ``digest, bytes``, loads near equal."""
    n, total = groups.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    large = max(1, total // (shards * LARGE))
    own = [(r["digest"], r["bytes"]) for r in groups.filter(F.col("bytes") > large).orderBy(F.desc("bytes"), "digest").toLocalIterator()]
    parts = max(1, min(PARTS, n // PART_GROUPS))
    bins = max(shards, BINS // parts)
    filled = checkpoint(_fill_bins(groups.filter(F.col("bytes") <= large), parts, bins))
    held = [(r["part"], r["bin"], r["bytes"]) for r in filled.groupBy("part", "bin").agg(F.sum("bytes").alias("bytes")).orderBy("part", "bin").collect()]
    to = least_loaded([b for _, b in own] + [b for _, _, b in held], shards)
    spark = groups.sparkSession
    first = spark.createDataFrame([(d, s) for (d, _), s in zip(own, to)], "digest string, shard int")
    second = spark.createDataFrame([(p, b, s) for (p, b, _), s in zip(held, to[len(own) :])], "part int, bin int, shard int")
    return first.unionByName(filled.join(second, ["part", "bin"]).select("digest", "shard"))


def assign(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and place of every row: ``id_col, size, text_crc32, shard, slot``.

    ``size`` is the text's UTF-8 bytes and 16 more. Rows of equal text are one group and share a
    shard; null counts as an empty text. A group larger than an even shard has one to itself as far
    as that goes. ``slot`` numbers a shard's rows from 0 without a gap. Repeated rows and null ids
    are rows like others; an empty table gives an empty one.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = picked(docs, id=id_col, size=(F.octet_length(text) + ROW_BYTES).cast("bigint"), crc=F.crc32(text.cast("binary")), digest=F.sha2(text, 256))
    slim = checkpoint(rows.withColumn("chunk", F.spark_partition_id()))
    groups = checkpoint(slim.groupBy("digest").agg(F.sum("size").alias("bytes")))
    dealt = slim.join(shards_of_groups(groups, shards), "digest")
    # chunk: the part of the written table that a row came from, so the numbering below has no hot key
    dealt = checkpoint(dealt.select("id", "size", "crc", "shard", "chunk"))
    counts = dealt.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    base = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", "chunk", base.alias("base"))
    place = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("id", "crc", "size")) - 1
    numbered = dealt.withColumn("place", place).join(starts, ["shard", "chunk"])
    return numbered.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("place") + F.col("base")).cast("bigint").alias("slot"))


def with_shards(docs: DataFrame, shards: int = 40, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` and, behind them, ``size, text_crc32, shard`` as in ``assign``.

    Whole texts are moved once, to meet their shard by digest; where very many rows share a text adaptive
    execution splits them, for a digest has one shard. A null text counts as an empty one, repeated rows stay
    repeated, an empty table gives an empty one. Where ``docs`` has a column called like one of the three,
    the new one gets underscores behind its name.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    size = (F.octet_length(text) + ROW_BYTES).cast("bigint")
    groups = checkpoint(picked(docs, digest=F.sha2(text, 256), size=size).groupBy("digest").agg(F.sum("size").alias("bytes")))
    to = checkpoint(shards_of_groups(groups, shards).withColumnsRenamed({"digest": "_to_digest", "shard": "_to_shard"}))
    rows = docs.join(to, F.sha2(text, 256) == to["_to_digest"])
    added = {"size": size, "text_crc32": F.crc32(text.cast("binary")), "shard": to["_to_shard"]}
    return rows.select(*[docs[c] for c in docs.columns], *[c.alias(unused(name, docs.columns)) for name, c in added.items()])
