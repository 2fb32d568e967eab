"""Best-fit packing with Martello and Toth's dominance reduction.

Documents become pieces of at most ``capacity`` tokens. Only the lengths of pieces matter for the packing,
and there are at most ``capacity`` of them, so the whole instance is a table of counts by length however
many documents there are. On it, small sets that dominate every other set with the same longest piece
are fixed for good, in bulk; what remains is packed best fit, longest first, also in bulk. The plan tells
for each length which of its pieces goes where; every piece looks its place up by its rank among
pieces of its length. No text or piece is shuffled by length, so a length that a third of all pieces share
is nothing special.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeledger.llm.common import picked
from lakeledger.runtime import checkpoint, ship

ship(__name__)

CAPACITY = 4_096
#: Words whose ids a task remembers, and the longest such word.
WORDS, WORD = 1 << 18, 64
#: The longest word that is merged with others.
LONG = 256
_CHUNK = re.compile(r"[^ \t\n\r\x0b\x0c]+")
# Characters that lower-case, compose and split alike everywhere.
_PLAIN = re.compile("[\t\n\r\x0b\x0c -~À-ÖØ-öø-ÿ]*")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
# Fixed value: how tokenizers of the known kind split.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

Pattern = tuple[tuple[int, int], ...]  # (length, how often), longest first


class WordIds(dict):
    """Token ids by word: a tokenizer that never joins across white space gives a text's ids word by word.

    Where the tokenizer is of the kind that ``_ranks`` knows, words of plain Latin letters, digits
    and signs are merged together by a faster library from the same vocabulary; the others, very
    long ones and those with names of special tokens are encoded one by one.
    """

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.model = Tokenizer.from_str(tokenizer)
        self.fast = None
        if ranks := _ranks(json.loads(tokenizer)):
            import tiktoken

            self.fast = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, word: str) -> list[int]:
        ids = self.model.encode(word, add_special_tokens=False).ids
        if len(word) <= WORD:
            if len(self) >= WORDS:
                self.clear()
            self[word] = ids
        return ids

    def ids(self, text: str) -> np.ndarray:
        """Ids of a text, as encoding it whole gives them."""
        if not self.fast:
            return np.array([i for m in _CHUNK.finditer(text) for i in self[m[0]]], "<u4")
        if "<|" not in text and _PLAIN.fullmatch(text):
            parts = _PARTS.findall(text.lower())
            if max(map(len, parts), default=0) <= LONG:
                return np.array(self.fast("\0".join(parts) + "\0") if parts else [], "<u4")
        out: list[int] = []
        held: list[str] = []
        for word in _CHUNK.findall(text):
            if len(word) <= LONG and "<|" not in word and _PLAIN.fullmatch(word):
                held += _PARTS.findall(word.lower())
                continue
            if held:
                out += self.fast("\0".join(held) + "\0")
                held = []
            out += self[word]
        if held:
            out += self.fast("\0".join(held) + "\0")
        return np.array(out, "<u4")


def _ranks(model: dict) -> dict[bytes, int] | None:
    """Vocabulary as bytes by rank, a zero byte for the end of a word; None unless the file is of the known kind.

    That kind lower-cases, splits as ``_PARTS`` does, starts from bytes with and without a word's end, and numbers
    every merge in the order of the merges, so that ids are ranks.
    """
    bpe = model["model"]
    kind = {k: bpe.get(k) for k in ("type", "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")}
    known = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
    steps = [x["type"] for x in (model.get("normalizer") or {}).get("normalizers", [])], [x["type"] for x in (model.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    if kind != known or steps != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]):
        return None
    if model["pre_tokenizer"]["pretokenizers"][0].get("pattern") != {"Regex": _SPLIT}:
        return None
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in bpe["merges"]]
    vocabulary = bpe["vocab"]
    if any(vocabulary.get(a + b) != 512 + k for k, (a, b) in enumerate(merges)):
        return None
    # the usual printable stand-ins of bytes
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stand_in = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in plain)}
    special = {t["content"] for t in model["added_tokens"]}
    ranks = {}
    for token, rank in vocabulary.items():
        if token not in special:
            body, end = (token[:-4], b"\0") if token.endswith("</w>") and len(token) > 4 else (token, b"")
            ranks[bytes(stand_in[c] for c in body) + end] = rank
    return ranks if len(ranks) == len(vocabulary.keys() - special) else None


# --- the plan ---


def dominating(counts: np.ndarray, longest: int, capacity: int) -> list[int] | None:
    """A set with ``longest`` in it that some best packing uses as it is, if one of up to three pieces is known.

    The piece alone if nothing fits beside it; with the largest piece that fits if no two others do, if it
    fills the sequence, or if it is as large as any two that fit; with the best two if no three fit and
    no two that fit are larger one by one.
    """
    others = counts.copy()
    others[longest] -= 1
    room = capacity - longest
    sizes = np.flatnonzero(others)
    if not len(sizes) or sizes[0] > room:
        return [longest]
    least = [int(s) for s in sizes[:3] for _ in range(min(3, int(others[s])))][:3]
    best = int(sizes[np.searchsorted(sizes, room, "right") - 1])
    if best == room or len(least) < 2 or least[0] + least[1] > room:
        return [longest, best]
    if len(least) == 3 and sum(least) <= room:
        return None
    first = sizes[sizes <= room]
    at = np.searchsorted(sizes, np.minimum(room - first, first), "right") - 1
    at -= (at >= 0) & (sizes[at] == first) & (others[first] < 2)
    both = np.where(at >= 0, first + sizes[at], -1)
    k = len(both) - 1 - int(np.argmax(both[::-1]))  # of equal sums the one with the largest piece
    a, b = int(first[k]), int(sizes[at[k]])
    if best >= a + b:
        return [longest, best]
    larger = sizes[sizes > b]
    next_two = [int(s) for s in larger[:2] for _ in range(min(2, int(others[s])))][:2]
    if a == best and (len(next_two) < 2 or sum(next_two) > room):
        return [longest, a, b]
    return None


def reduce(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Takes all dominating sets out of ``counts`` and returns them, each with how often it was fixed.

    A set that dominates keeps doing so while its pieces last: fewer other pieces mean fewer rivals.
    """
    fixed: list[tuple[Pattern, int]] = []
    changed = True
    while changed:
        changed = False
        for longest in np.flatnonzero(counts)[::-1]:
            while counts[longest] and (found := dominating(counts, int(longest), capacity)):
                pattern = tuple(sorted(Counter(found).items(), reverse=True))
                times = min(int(counts[s]) // n for s, n in pattern)
                for s, n in pattern:
                    counts[s] -= n * times
                fixed.append((pattern, times))
                changed = True
    return fixed


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit, longest pieces first: each into the fullest sequence that still has room for it."""
    by_room: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)

    def put(pattern: Pattern, size: int, each: int, room: int, times: int) -> None:
        if times:
            by_room[room - each * size].append(((*pattern, (size, each)) if each else pattern, times))

    for size in map(int, np.flatnonzero(counts)[::-1]):
        left = int(counts[size])
        # equal pieces go on filling the sequence they went into, as it stays the fullest with room
        for room in sorted(r for r in by_room if r >= size):
            if not left:
                break
            each = room // size
            groups = by_room.pop(room)
            for pattern, times in groups:
                full = min(times, left // each)
                rest = min(left - full * each, each - 1) if full < times else 0
                put(pattern, size, each, room, full)
                put(pattern, size, rest, room, 1 if rest else 0)
                put(pattern, size, 0, room, times - full - (1 if rest else 0))
                left -= full * each + rest
        each = capacity // size
        put((), size, each, capacity, left // each)
        put((), size, left % each, capacity, 1 if left % each else 0)
    return [g for groups in by_room.values() for g in groups]


def places(counts: dict[int, int], capacity: int) -> dict[int, np.ndarray]:
    """For each length the runs of its pieces: columns first rank, first sequence, pieces a sequence, offset."""
    table = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        table[length] = n
    runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    used: Counter[int] = Counter()
    sequence = 0
    for pattern, times in (*reduce(table, capacity), *best_fit(table, capacity)):
        offset = 0
        for length, each in pattern:
            runs[length].append((used[length], sequence, each, offset))
            used[length] += each * times
            offset += each * length
        sequence += times
    return {length: np.array(r, np.int64) for length, r in runs.items()}


# --- on Spark ---


def cut(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, piece, start, length, ids_crc32, part, nth``: every document's tokens in pieces.

    ``tokenizer`` is the path of a tokenizer file the driver can read; it must drop white space. ``part`` is the task that
    cut the piece, ``nth`` the piece's number among those of its length there. Write the rows before
    they are used twice. A null text is an empty one: ``end_id`` alone.
    """
    with open(tokenizer, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file
    rows = picked(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", "piece", "start", "length", "ids_crc32", "part", "nth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words, part, seen = WordIds(model.value), TaskContext.get().partitionId(), Counter()
        for b in batches:
            at, found = [], []
            for k, text in enumerate(b.column(1)):
                ids = np.append(words.ids(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    n = len(piece)
                    at.append(k)
                    found.append((start // capacity, start, n, zlib.crc32(piece.tobytes()), part, seen[n]))
                    seen[n] += 1
            columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)] or [pa.array([], pa.int64())] * 6
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *columns], names=names)

    out = rows.mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} bigint" for n in names[1:]))
    return out.select(F.col("id").alias(id_col), F.col("piece").cast("int").alias("piece"), *names[2:])


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, piece, start, length, ids_crc32, sequence_id, offset`` of every piece of every document.

    Pieces are as ``cut`` makes them: only documents of more than ``capacity`` tokens are cut, and only their
    last piece is shorter. A null or empty text is one token. Rows that repeat, and rows without an id, are
    packed each; equal lengths are dealt out by task and place, so their order follows the input's
    files. An empty table gives no rows. Columns of ``docs`` beside the two named play no part.

    The driver sees one count for each length, ``capacity`` numbers, and hands a plan of some
    multiple of that to the tasks, whatever the number of documents.
    """
    pieces = checkpoint(picked(cut(docs, tokenizer, end_id, capacity, id_col, text_col), id=id_col, **{c: c for c in ("piece", "start", "length", "ids_crc32", "part", "nth")}))
    counts = checkpoint(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    plan = places({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    known = docs.sparkSession.sparkContext.broadcast(plan)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["part", "length"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for size in np.unique(length):
                rows = np.flatnonzero(length == size)
                runs = known.value[int(size)]
                first, base, each, place = runs[np.searchsorted(runs[:, 0], rank[rows], "right") - 1].T
                past = rank[rows] - first
                sequence[rows], offset[rows] = base + past // each, place + past % each * size
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = pieces.schema["id"].dataType.simpleString()
    out = ranked.mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    return out.withColumnRenamed("id", id_col)
