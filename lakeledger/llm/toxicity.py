"""Toxicity by multiple-instance learning: only documents are labelled, sentences are scored.

A sentence's chance of being toxic is a logistic function of its worst word's hashed byte n-grams,
so repeats add nothing; a document is toxic unless all its sentences are clean (noisy-or). Training on document labels alone teaches the
sentence scores, which then point out the offending sentences. A sentence counts by what its worst word adds to the
bias; without a word of positive weight it counts nothing, so length alone makes no text toxic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeledger.llm.common import picked, texts
from lakeledger.runtime import checkpoint, ship

ship(__name__)

BITS = 20
GRAMS = (4, 6)
#: Labelled documents used to fit, by class, and the longest text (bytes) among them: 96 MB at most.
POSITIVES, NEGATIVES, LONGEST = 1024, 2048, 32_768
#: Bytes scored at once.
PIECE = 1 << 20

_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True
# A-Z as a-z, ASCII punctuation, digits and control characters as a space; other bytes as they are.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass
class Model:
    """Bias and hashed weights; 4 MB however much text there is."""

    bias: float
    weights: np.ndarray


def features(data: bytes, gram: int) -> np.ndarray:
    """Bucket of the ``gram`` bytes that begin at each byte (past the end: spaces)."""
    b = np.frombuffer(data.translate(_PLAIN) + b" " * gram, np.uint8)
    code = np.zeros(len(data), np.uint64)
    for k in range(gram):
        code |= b[k : k + len(data)].astype(np.uint64) << np.uint64(8 * k)
    code *= np.uint64(0x9E3779B97F4A7C15)
    return (code >> np.uint64(64 - BITS)).astype(np.int32)


def sentence_starts(data: bytes) -> np.ndarray:
    """Byte offsets at which sentences begin; one ends after a run of full stops, !, ? and line ends."""
    ends = _ENDS[np.frombuffer(data, np.uint8)]
    return np.concatenate(([0], np.flatnonzero(ends[:-1] & ~ends[1:]) + 1))


def _window_weights(data: bytes, weights: np.ndarray) -> np.ndarray:
    out = np.empty(len(data), np.float32)
    for k in range(0, len(data), PIECE):
        piece = data[k : k + PIECE + max(GRAMS)]
        n = min(PIECE, len(data) - k)
        out[k : k + n] = sum(weights[features(piece, g)[:n]] for g in GRAMS)
    return out


def _word_starts(data: bytes, starts: np.ndarray) -> np.ndarray:
    """Where words begin (at the space before them); a sentence's first byte begins one in any case."""
    space = np.frombuffer(data.translate(_PLAIN), np.uint8) == 32
    begins = np.zeros(len(data), bool)
    begins[:-1] = space[:-1] & ~space[1:]
    begins[starts] = True
    return np.flatnonzero(begins)


def _joined(values: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Texts as one byte string, each behind a space; where sentences begin, and the first of each text."""
    raw = [b" " + t.encode("utf-8", "surrogatepass") for t in values]
    at = np.cumsum([0] + [len(r) for r in raw])[:-1]
    data = b"".join(raw)
    starts = np.union1d(sentence_starts(data), at)
    return data, starts, np.searchsorted(starts, at)


def document_scores(values: list[str], model: Model) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Noisy-or score of each text, its sentences' byte offsets and their chances."""
    score = np.empty(len(values))
    begins: list[np.ndarray] = []
    chances: list[np.ndarray] = []
    i = 0
    while i < len(values):
        j, held = i, 0
        while j < len(values) and (j == i or held + len(values[j]) <= PIECE):
            held += len(values[j])
            j += 1
        data, starts, firsts = _joined(values[i:j])
        words = _word_starts(data, starts)
        sums = np.add.reduceat(_window_weights(data, model.weights), words)
        worst = np.maximum(np.maximum.reduceat(sums, np.searchsorted(words, starts)).astype(float), 0)
        # log of the chance to be clean, less that of a sentence without any learned word
        stays = np.logaddexp(0, model.bias) - np.logaddexp(0, np.minimum(worst + model.bias, 30))
        score[i:j] = 0 - np.expm1(np.add.reduceat(stays, firsts))
        p = 0 - np.expm1(stays)
        for k, (a, b) in enumerate(zip(firsts, [*firsts[1:], len(starts)], strict=True)):
            begins.append(np.maximum(starts[a:b] - starts[a] - 1, 0))  # less the space before the text
            chances.append(p[a:b])
            if not values[i + k]:
                score[i + k] = 0.0
                begins[-1], chances[-1] = begins[-1][:0], chances[-1][:0]
        i = j
    return score, begins, chances


def train(values: list[str], toxic: np.ndarray, epochs: int = 8, rate: float = 1.0, l1: float = 3e-3, group: int = 32, bias: float = -9.5) -> Model:
    """Fit word weights to document labels by AdaGrad on the noisy-or likelihood.

    The bias is fixed low, so that the documents learned from are clean at the start, however many
    sentences they have; scores leave out what it alone adds. With no documents, or labels of one kind only, every text scores near 0.
    """
    weights, squares = np.zeros(1 << BITS, np.float32), np.full(1 << BITS, 1e-3, np.float32)
    if not len(values) or toxic.min() == toxic.max():
        return Model(-30.0, weights)
    order = np.random.default_rng(7)
    packed = []
    for k in range(0, len(values), group):
        data, starts, firsts = _joined(values[k : k + group])
        words = _word_starts(data, starts)
        packed.append((np.stack([features(data, g) for g in GRAMS]), words, np.searchsorted(words, starts), firsts, toxic[k : k + group].astype(float)))
    for epoch in range(epochs):
        step = rate / (1 + 0.3 * epoch)
        for n in order.permutation(len(packed)):
            buckets, words, heads, firsts, y = packed[n]
            sums = np.add.reduceat(weights[buckets].sum(0), words)
            worst = np.maximum.reduceat(sums, heads)
            z = np.clip(worst.astype(float) + bias, -30, 30)
            p = 1 / (1 + np.exp(-z))
            clean = np.add.reduceat(-np.logaddexp(0, z), firsts)
            pull = np.where(y > 0, -np.exp(clean) / np.maximum(-np.expm1(clean), 1e-9), 1.0)
            g = np.clip(p * np.repeat(pull, np.diff([*firsts, len(heads)])), -1, 1)
            per = np.diff([*heads, len(words)])
            chosen = sums == np.repeat(worst, per)  # all words of a sentence while nothing is learnt
            g = np.repeat(g / np.add.reduceat(chosen.astype(float), heads), per) * chosen
            used = np.repeat(g != 0, lengths := np.diff([*words, buckets.shape[1]]))
            at, hits = np.repeat(g, lengths)[used], buckets[:, used]
            grad = sum(np.bincount(b, at, 1 << BITS) for b in hits)
            hit = np.flatnonzero(grad)
            gr = grad[hit].astype(np.float32)
            squares[hit] += gr * gr
            pace = step / np.sqrt(squares[hit])
            w = weights[hit] - pace * gr
            weights[hit] = np.sign(w) * np.maximum(np.abs(w) - pace * l1, 0)
    return Model(float(bias), weights)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", where: Column | None = None) -> Model:
    """Learn from labelled rows of ``docs``; ``where`` further limits which ids may be learned from.

    The sample is bounded (``POSITIVES``, ``NEGATIVES``, ``LONGEST``) and chosen by a hash of the id;
    it is fitted in one task. Ids labelled more than once are toxic if any label says so, of rows that
    repeat an id one text is learned from; null ids, null labels and labels without a document are
    left out.
    """
    marks = picked(labels, id=id_col, toxic=F.col(label_col).cast("int")).filter("id IS NOT NULL AND toxic IS NOT NULL")
    marks = marks.groupBy("id").agg(F.max("toxic").alias("toxic"))
    if where is not None:
        marks = marks.filter(where)
    # the sample is chosen without texts; only its own are read then
    there = marks.join(picked(docs, id=id_col), "id", "left_semi").withColumn("h", F.xxhash64("id"))
    some = lambda flag, n: there.filter(F.col("toxic") == flag).orderBy("h", "id").limit(n)
    chosen = checkpoint(some(1, POSITIVES).unionByName(some(0, NEGATIVES)))
    rows = picked(docs, id=id_col, text=text_col).filter(F.octet_length("text") <= LONGEST)
    sample = rows.join(chosen, "id").groupBy("id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic"), F.min("h").alias("h"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "id"])
        m = train(pdf["text"].tolist(), pdf["toxic"].to_numpy())
        at = np.flatnonzero(m.weights)
        return pd.DataFrame({"bucket": np.append(at, -1), "weight": np.append(m.weights[at], m.bias).astype(float)})

    got = sample.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "bucket int, weight double").toPandas()
    weights = np.zeros(1 << BITS, np.float32)
    if not len(got):
        return Model(-30.0, weights)
    rest = got[got["bucket"] >= 0]
    weights[rest["bucket"].to_numpy()] = rest["weight"].to_numpy()
    return Model(float(got.loc[got["bucket"] < 0, "weight"].iat[0]), weights)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """``id_col, score, predicted, offending`` of every row.

    ``offending`` lists the sentences whose own chance is ``cut`` or more as byte offsets into the
    UTF-8 text with that chance. Empty and null texts score 0. Repeated rows are scored each.
    """
    rows = picked(docs, id=id_col, text=text_col)
    sent = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))
    span = pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("chance", pa.float64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*sent.value)
        for b in parts:
            values = texts(b.column(1))
            scores, begins, chances = document_scores(values, m)
            spans = []
            for text, at, p in zip(values, begins, chances, strict=True):
                hit = np.flatnonzero(p >= cut)
                ends = [*at[1:], len(text.encode("utf-8", "surrogatepass"))] if len(hit) else []
                spans.append([{"begin": int(at[k]), "end": int(ends[k]), "chance": float(p[k])} for k in hit])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(scores), pa.array((scores >= cut).astype(np.int32)), pa.array(spans, pa.list_(span))], names=["id", "score", "predicted", "offending"]
            )

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, score double, predicted int, offending array<struct<begin: bigint, end: bigint, chance: double>>")
    return out.withColumnRenamed("id", id_col)


def clean_rows(docs: DataFrame, model: Model, text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores under ``cut``."""
    sent = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))
    at = docs.columns.index(text_col)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*sent.value)
        for b in parts:
            scores, _, _ = document_scores(texts(b.column(at)), m)
            yield b.filter(pa.array(scores < cut))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether an id is kept from learning: CRC-32 of its text is divisible by five; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
