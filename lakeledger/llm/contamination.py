"""Benchmark decontamination: BM25 over test items with block-max pruning, then an overlap check.

Every training passage is a query against an inverted index of the test items. A passage scores an
item only where upper bounds allow it to reach the item's threshold: first the sum of the list
maxima of its terms, then the sum of their maxima in each block of items (block-max WAND, run over
whole batches of passages at once). All items at or above the threshold are then checked word for
word against the text around the passage.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeledger.llm.common import batches, picked, pieces, texts
from lakeledger.runtime import checkpoint, ship

ship(__name__)

K1, B = 1.2, 0.75
#: Words of a passage, items in a block, words of a shingle (a fifth of shorter parts).
PASSAGE, BLOCK, SHINGLE = 64, 8, 5
#: Part of an item's own score, and parts of its question and answer words, that must be met.
RETRIEVE, VERIFY = 0.6, 0.8
#: Words of the items in one index; more items make more indexes, each of which meets all passages.
INDEX_WORDS = 500_000
#: Words of text searched at once, characters taken apart at once.
STEP, LONG = 200_000, 1 << 20

_WORD = re.compile(r"[^\W_]+")
HIT = "item_id {item}, word bigint, bm25 double, question_overlap double, answer_overlap double"


def words(text: str) -> list[str]:
    """Lower-case runs of letters and digits."""
    return _WORD.findall(text.lower())


class Index:
    """Impact-ordered blocks of one part of the items; its size is bounded by ``INDEX_WORDS``."""

    def __init__(self, items: list[tuple], stats: dict[str, int], n: int, mean: float):
        self.ids = [i for i, _, _ in items]
        self.vocabulary: dict[str, int] = {}
        self.parts = [tuple(np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in p], np.int64) for p in (q, a)) for _, q, a in items]
        term, item, impact = [], [], []
        names = list(self.vocabulary)
        self.threshold = np.ones(len(items))
        for k, (q, a) in enumerate(self.parts):
            t, tf = np.unique(np.concatenate([q, a]), return_counts=True)
            length = len(q) + len(a)
            df = np.array([stats[names[x]] for x in t])
            s = np.log1p((n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
            spans = (length - 2) // PASSAGE + 2 if length > 1 else 1
            self.threshold[k] = RETRIEVE * s.sum() / spans
            term.append(t)
            item.append(np.full(len(t), k))
            impact.append(s / self.threshold[k])
        cat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.empty(0, kind)
        term, item, impact = cat(term, np.int64), cat(item, np.int64), cat(impact, np.float64)
        order = np.lexsort((item, term))
        term, self.item, self.impact = term[order], item[order], impact[order]
        v = len(names)
        self.list_max = np.zeros(v)
        np.maximum.at(self.list_max, term, self.impact)
        # blocks: one entry for each term and block of items that holds it
        self.blocks = len(items) // BLOCK + 1
        key = term * self.blocks + self.item // BLOCK
        heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
        self.block = key[heads] % self.blocks
        self.block_max = np.maximum.reduceat(self.impact, heads) if len(heads) else np.empty(0)
        self.postings = np.append(heads, len(key))
        self.lists = np.searchsorted(term[heads], np.arange(v + 1))

    @classmethod
    def of(cls, state: dict) -> Index:
        """An index from its plain state, which workers can read without this module."""
        index = cls.__new__(cls)
        index.__dict__.update(state)
        return index

    def ids_of(self, text: str) -> np.ndarray:
        """Term numbers of a text's words, -1 for words of no item."""
        parts = map(words, pieces(text, LONG))
        return np.concatenate([np.fromiter(map(self.vocabulary.get, w, repeat(-1)), np.int64, len(w)) for w in parts])

    def search(self, terms: np.ndarray, passage: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Passage, item and score (1 is the item's threshold) of all pairs at or above the threshold."""
        v = max(1, len(self.vocabulary))
        known = terms >= 0
        key = np.unique(passage[known] * v + terms[known])
        p, t = key // v, key % v
        if not len(p):
            return p, p, np.empty(0)
        alive = np.bincount(p, self.list_max[t]) >= 1
        keep = alive[p]
        p, t = p[keep], t[keep]
        if not len(p):
            return p, p, np.empty(0)
        new = np.concatenate(([True], p[1:] != p[:-1]))
        names, p = p[new], np.cumsum(new) - 1  # passages left, numbered
        row, at = _expand(self.lists[t], self.lists[t + 1])
        cell = p[row] * self.blocks + self.block[at]
        bound = np.bincount(cell, self.block_max[at])
        keep = bound[cell] >= 1
        row, at = row[keep], at[keep]
        row, post = _expand(self.postings[at], self.postings[at + 1], p[row])
        pair = row * len(self.ids) + self.item[post]
        order = np.argsort(pair, kind="stable")
        pair, gain = pair[order], self.impact[post][order]
        heads = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))) if len(pair) else np.empty(0, np.int64)
        if not len(heads):
            return heads, heads, np.empty(0)
        score = np.add.reduceat(gain, heads)
        hit = score >= 1
        pair = pair[heads][hit]
        return names[pair // len(self.ids)], pair % len(self.ids), score[hit]

    def overlap(self, item: int, region: np.ndarray) -> tuple[float, float]:
        """Parts of the question's and the answer's words that stand in shingles found in the region."""
        return tuple(_covered(part, region) for part in self.parts[item])


def _expand(lo: np.ndarray, hi: np.ndarray, mark: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges, each with its range's number (or mark)."""
    size = hi - lo
    row = np.repeat(np.arange(len(lo)) if mark is None else mark, size)
    return row, np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)


def _covered(part: np.ndarray, region: np.ndarray) -> float:
    """Share of a part's words that stand in the region; one changed, added or lost word costs a fifth of them at most."""
    if not len(part):
        return 1.0
    covered = np.zeros(len(part), bool)
    n = min(SHINGLE, len(part) // 5)
    if len(part) == 1:
        covered[:] = part[0] in region
    elif n < 2:  # too short for shingles: pairs of words in order, with one word between them at most
        base = max(part.max(), region.max(initial=0)) + 1
        near = [region[:-d] * base + region[d:] for d in (1, 2)]
        known = [k[(region[:-d] >= 0) & (region[d:] >= 0)] for d, k in zip((1, 2), near)]
        for d in (1, 2):
            at = np.flatnonzero(np.isin(part[:-d] * base + part[d:], np.concatenate(known)))
            covered[at] = covered[at + d] = True
    elif len(region) >= n:
        view = np.lib.stride_tricks.sliding_window_view
        there = {g.tobytes() for g in view(region, n)}
        for k, g in enumerate(view(part, n)):
            if g.tobytes() in there:
                covered[k : k + n] = True
    return float(covered.mean())


def _hits(index: Index, values: list[str]) -> Iterator[tuple]:
    """Row, item, first word of the passage, BM25 score and overlaps of all verified pairs."""
    i = 0
    while i < len(values):
        rows: list[np.ndarray] = []
        first, count, n, held = i, [], 0, 0
        while i < len(values) and (not rows or held < STEP):
            rows.append(index.ids_of(values[i]))
            held += len(rows[-1])
            i += 1
        base = np.cumsum([0] + [-(-len(r) // PASSAGE) for r in rows])
        terms = np.concatenate(rows)
        passage = np.concatenate([b + np.arange(len(r)) // PASSAGE for b, r in zip(base, rows)])
        p, item, score = index.search(terms, passage)
        done = set()
        for q, k, s in zip(p.tolist(), item.tolist(), score.tolist()):
            r = int(np.searchsorted(base, q, side="right")) - 1
            if (r, k) in done:
                continue
            at = (q - base[r]) * PASSAGE
            wide = sum(map(len, index.parts[k]))
            question, answer = index.overlap(k, rows[r][max(0, at - wide) : at + PASSAGE + wide])
            if question >= VERIFY and answer >= VERIFY:
                done.add((r, k))
                yield first + r, k, int(at), s * float(index.threshold[k]), question, answer


def indexes(items: DataFrame, item_col: str, question_col: str, answer_col: str) -> Iterator[Index]:
    """Indexes over all items, each of bounded size, with document counts taken over all of them.

    Null questions and answers count as empty, items without words are in no index, repeated rows
    count once.
    """
    rows = picked(items, item=item_col, question=question_col, answer=answer_col).dropDuplicates()
    kind = rows.schema["item"].dataType.simpleString()

    def split(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            q, a = ([words(t) for t in texts(b.column(k))] for k in (1, 2))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(q, pa.list_(pa.string())), pa.array(a, pa.list_(pa.string()))], names=["item", "q", "a"])

    split_rows = checkpoint(rows.mapInArrow(split, f"item {kind}, q array<string>, a array<string>").filter("size(q) + size(a) > 0"))
    n, total = split_rows.agg(F.count("*"), F.sum(F.size("q") + F.size("a"))).first()
    if not n:
        return
    shards = -(-total // INDEX_WORDS)
    dealt = split_rows.withColumn("shard", F.pmod(F.xxhash64("q", "a"), F.lit(shards)))
    term = F.explode(F.array_distinct(F.concat("q", "a"))).alias("term")
    counts = checkpoint(split_rows.select(term).groupBy("term").agg(F.count("*").alias("df"))) if shards > 1 else split_rows.select(term).groupBy("term").agg(F.count("*").alias("df"))
    for shard in range(shards):
        part = dealt.filter(F.col("shard") == shard)
        here = part.select(term).distinct()
        stats = {r["term"]: r["df"] for r in counts.join(here, "term", "left_semi").toLocalIterator()}
        yield Index([(r["item"], r["q"], r["a"]) for r in part.orderBy("q", "a", "item").toLocalIterator()], stats, n, total / n)


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", question_col: str = "question", answer_col: str = "answer") -> DataFrame:
    """One row for each row of ``docs`` and item whose question and answer both stand in it, at least ``VERIFY`` of each.

    An item without an answer of its own is met as a whole.

    ``id_col, item_id, word`` (where the passage begins), ``bm25`` and the two overlaps. Empty and
    null texts match nothing; rows that repeat an id are searched each, and null ids are kept. With no
    items the result is empty.
    """
    rows = picked(docs, id=id_col, text=text_col)
    kind, item_kind = rows.schema["id"].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    schema = f"id {kind}, {HIT.format(item=item_kind)}"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in indexes(items, item_col, question_col, answer_col):
        sent = docs.sparkSession.sparkContext.broadcast(vars(index))

        def run(parts: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = Index.of(sent.value)
            for b in parts:
                ids = b.column(0)
                shape = pa.schema([("id", ids.type), ("item_id", pa.array(index.ids).type if any(i is not None for i in index.ids) else pa.int64()), ("word", pa.int64()), ("bm25", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])
                yield from batches(((ids[r].as_py(), index.ids[k], *rest) for r, k, *rest in _hits(index, texts(b.column(1)))), shape)

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out.withColumnRenamed("id", id_col)


def clean_rows(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", question_col: str = "question", answer_col: str = "answer") -> DataFrame:
    """The rows of ``docs``, all columns, in which no item was found."""
    at = docs.columns.index(text_col)
    for index in indexes(items, item_col, question_col, answer_col):
        sent = docs.sparkSession.sparkContext.broadcast(vars(index))

        def run(parts: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = Index.of(sent.value)
            for b in parts:
                clean = np.ones(b.num_rows, bool)
                clean[[r for r, *_ in _hits(index, texts(b.column(at)))]] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
