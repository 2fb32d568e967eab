"""Packing, hard negatives and the prefix trie against plain versions."""

import hashlib
import random
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from lakeledger.llm import negatives, packing, queries, trie

DIR = "/root/testdata/sf0.001"
WORDS = path("word_bpe_49k.json")


# --- packing ---


def fewest(sizes, capacity):
    """Least number of bins, by trying all sets that hold the largest piece."""

    @lru_cache(None)
    def go(left):
        if not left:
            return 0
        first, rest = left[0], left[1:]
        best = [len(left)]

        def fill(k, room, kept):
            if k == len(rest):
                best[0] = min(best[0], 1 + go(kept))
                return
            if rest[k] <= room:
                fill(k + 1, room - rest[k], kept)
            fill(k + 1, room, (*kept, rest[k]))

        fill(0, capacity - first, ())
        return best[0]

    return go(tuple(sorted(sizes, reverse=True)))


def spread(patterns):
    return [sorted(s for s, n in p for _ in range(n)) for p, times in patterns for _ in range(times)]


def test_reduction_keeps_the_optimum():
    rng = random.Random(5)
    reduced = 0
    for _ in range(400):
        capacity = rng.randint(5, 24)
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        counts = np.bincount(sizes, minlength=capacity + 1)
        fixed = spread(packing.reduce(counts, capacity))
        left = [s for s in range(capacity + 1) for _ in range(counts[s])]
        assert sorted(left + [s for b in fixed for s in b]) == sorted(sizes)
        assert all(sum(b) <= capacity for b in fixed)
        assert len(fixed) + fewest(left, capacity) == fewest(sizes, capacity), (capacity, sizes, fixed)
        reduced += bool(fixed)
    assert reduced > 300


def plain_best_fit(sizes, capacity):
    rooms, bins = [], []
    for s in sorted(sizes, reverse=True):
        fits = [k for k, r in enumerate(rooms) if r >= s]
        if fits:
            k = min(fits, key=lambda k: rooms[k])
        else:
            k = len(rooms)
            rooms.append(capacity)
            bins.append([])
        rooms[k] -= s
        bins[k].append(s)
    return sorted(capacity - r for r in rooms), bins


def test_best_fit_in_bulk_is_best_fit():
    rng = random.Random(6)
    for _ in range(300):
        capacity = rng.randint(5, 40)
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 60))]
        got = spread(packing.best_fit(np.bincount(sizes, minlength=capacity + 1), capacity))
        loads, _ = plain_best_fit(sizes, capacity)
        assert sorted(map(sum, got)) == loads and sorted(s for b in got for s in b) == sorted(sizes)


def test_ids_by_word_are_those_of_the_text():
    model = Tokenizer.from_file(WORDS)
    with open(WORDS, encoding="utf-8") as f:
        words = packing.WordIds(f.read())
    rng = random.Random(7)
    letters = "abcXYZ éÉßİſΣςσ 'stll've 12³½ ½ \t\n\r\x0b\x0c\x1c\x85\xa0 　​̣́̈ ǅ漢字ガ한글😀👩‍👩‍👧 <|endoftext|> -_.,!?\x00﻿"
    for _ in range(2000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert words.ids(text).tolist() == model.encode(text, add_special_tokens=False).ids, repr(text)


def check_packed(rows, texts, capacity=4096):
    """Texts by row in order; every token of every row in one piece, pieces end to end in sequences."""
    model = Tokenizer.from_file(WORDS)
    want = defaultdict(int)
    for i, text in texts:
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 1]
        for k, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            want[i, k, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got, held = defaultdict(int), defaultdict(list)
    for r in rows:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        held[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for parts in held.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(held)


def test_all_documents_are_packed(spark):
    rows = queries.QUERIES["op11_best_fit_packing"](spark, DIR).collect()
    docs = spark.read.parquet(f"{DIR}/documents.parquet").collect()
    n = check_packed(rows, [(d.doc_id, d.text) for d in docs])
    assert n <= -(-sum(r.length for r in rows) // 4096) + 1


@pytest.mark.parametrize("capacity", [1, 3, 8, 4096])
def test_edges_of_packing(spark, docs, capacity):
    texts = [(1, None), (2, ""), (3, "one two three"), (3, "one two three"), (None, "no id at all"), (4, "word " * 9000), (5, "x" * 3000), (6, " \n\t"), *[(9, "copy of a line")] * 40]
    rows = packing.pack(docs(texts).repartition(3), WORDS, capacity=capacity).collect()
    check_packed(rows, texts, capacity)
    assert packing.pack(docs([]), WORDS, capacity=capacity).collect() == []


# --- hard negatives ---


def test_curve_goes_in_single_steps():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        side = 1 << bits
        cells = np.stack([a.ravel() for a in np.meshgrid(*[np.arange(side)] * dims, indexing="ij")], axis=1)
        place = negatives.hilbert(cells, bits)
        assert sorted(place.tolist()) == list(range(side**dims))
        along = cells[np.argsort(place)]
        assert (np.abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()


def plain_negatives(rows, every, low=80, high=100, k=5):
    sound = [(i, label, v) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    whole = lambda x: (x.as_integer_ratio()[0] * 256) // x.as_integer_ratio()[1]
    clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    out = []
    for i, label, v in {(i, label, tuple(map(float, v))) for i, label, v in sound if i % every == 0}:
        scored = [(-clip(sum(whole(a) * whole(float(b)) for a, b in zip(v, w))), j, m) for j, m, w in sound if j != i]
        for s, j, _ in sorted(x for x in scored if x[2] == label)[:k]:
            found = sorted((t, n) for t, n, m in scored if m != label and low * -s <= 100 * -t <= high * -s)[:k]
            out += [(i, j, r + 1, n, -s, -t) for r, (t, n) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_negatives_against_plain_search(spark, monkeypatch, seed):
    for name, value in (("BLOCK", 7), ("BLOCKS", 2), ("ANCHORS", 3), ("ZONES", 4)):
        monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, 6))
    rows = []
    for i in range(150):
        c = int(rng.integers(4))
        v = (centres[c] + rng.normal(size=6) * 0.4).round(int(rng.integers(1, 3))).tolist()
        rows.append((i, v[: 6 - (i % 11 == 0) * 2], c if i % 13 else None))
    rows += [rows[3], rows[10], (10, rows[10][1], rows[10][2]), (None, [1.0], 1), (200, None, 1), (201, [1.0, None], 1), (202, [float("inf")], 1), (203, [], 1), (210, [0.0] * 6, 0), (300, [1e19] * 6, 2), (301, [1e18, -1e18, 0.5], 3), (310, [-0.5] * 6, 0)]
    rows += [(1000 + k, [0.5, 0.25, 0.0, 1.0, 0.0, 0.5], k % 3) for k in range(40)]
    df = spark.createDataFrame([(*r, "a", "b", 1.0) for r in rows], "vec_id bigint, embedding array<double>, label int, id string, block string, floor double")
    got = negatives.hard_negatives(df, lambda i: i % 10 == 0)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, 10)


def test_negatives_of_nothing(spark):
    kinds = "vec_id bigint, embedding array<float>, label int"
    for rows in ([], [(0, [1.0], 1)], [(0, [], 1), (1, [], 1), (2, [], 2)]):
        got = negatives.hard_negatives(spark.createDataFrame(rows, kinds), lambda i: i % 100 == 0)
        assert sorted(map(tuple, got.collect())) == plain_negatives(rows, 100)


def test_bounds_hold():
    rng = np.random.default_rng(3)
    x, a = rng.integers(-300, 300, (50, 8)).astype(float), rng.integers(-300, 300, (20, 8)).astype(float)
    least, most = negatives.bounds(a, x.min(0, keepdims=True), x.max(0, keepdims=True))
    s = a @ x.T
    assert (least[:, 0] <= s.min(1)).all() and (most[:, 0] >= s.max(1)).all()


# --- prefix trie ---


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        hundred = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        paths[c] = tuple(own.get(hundred, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    out = []
    for node, inside in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = lambda n: [m for m in members if len(m) == len(n) + 1 and m[: len(n)] == n]
        ends = ",".join(map(str, sorted(c for c in inside if paths[c] == node)))
        out.append(
            (min(inside), len(node), min(members[node[:-1]]) if node else None, len(inside), len(kids(node)), sum(not kids(n) for n in below), sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n), hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "shard"), [(0, 4096), (1, 1), (2, 3), (3, 10), (4, 25)])
def test_trie_against_plain_version(spark, monkeypatch, seed, shard):
    monkeypatch.setattr(trie, "SHARD", shard)
    monkeypatch.setattr(trie, "PIECE", 20)
    rng = random.Random(seed)
    rows = []
    for c in [*rng.sample(range(-150, 900), 60), 0, 100, 200]:
        for turn in range(rng.randint(1, 7)):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["hi", "ho", "é😀", None, "", "what a day"])))
    rows += [(c, t, "user", "the same") for c in range(2000, 2030) for t in range(4)]
    rows += [(1, None, "system", "first"), (1, 2, "user", "tie"), (1, 2, "assistant", "tie"), (1, 2, "user", "tie"), (None, 1, "user", "lost"), (7, 0, "us", "er"), (8, 0, "u", "ser")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "a", "b", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, key string, node string, n int").repartition(5)
    got = sorted(map(tuple, trie.prefix_trie(df).collect()), key=str)
    assert got == plain_trie(rows)


def test_trie_of_nothing_and_of_a_long_conversation(spark):
    kinds = "conv_id bigint, turn bigint, role string, text string"
    assert trie.prefix_trie(spark.createDataFrame([], kinds)).collect() == []
    rows = [(c, t, "user", f"t{t}") for c in (5, 6) for t in range(3000)]
    got = {(r.conv_id, r.depth): r for r in trie.prefix_trie(spark.createDataFrame(rows, kinds)).collect()}
    h5, h6 = (zlib.crc32(x) % 6 for x in (b"5", b"6"))
    assert len(got) == 3001 - h5 + (0 if h5 == h6 else 3000 - h6)
    assert got[5, 0].n_convs == 2 and got[5, 3000 - h5].n_children == 0
