"""Decontamination, mixing and sharding against plain versions, and their edge cases."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from lakeledger.llm import contamination, mixing, sharding

SCHEMA = "doc_id bigint, text string, lang string, source string"


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ta", "no", "ri", "sel", "mu"]) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def items(spark):
    rows = [(k, prose(20 + k, k), prose(4, 100 + k)) for k in range(40)] + [(40, prose(300, 7), prose(9, 8)), (41, "", ""), (42, None, None), (None, prose(25, 9), prose(3, 10))]
    return spark.createDataFrame(rows, "item_id bigint, question string, answer string"), rows


def test_passages_are_found_wherever_they_stand(spark, docs, items):
    df, rows = items
    full = {k: f"{q} {a}" for k, q, a in rows if q}
    cases = []
    for n, (k, text) in enumerate(full.items()):
        for shift in (0, 17, 50, 63, 64, 200):
            cases.append((n * 10 + len(cases) % 6, k, prose(shift, n + shift) + "\n" + text.upper().replace(" ", ", ") + " " + prose(30, n)))
    clean = [(10_000 + i, prose(400, 1000 + i)) for i in range(30)]
    question_only = [(20_000, prose(50, 3) + " " + rows[3][1] + " " + prose(50, 4))]
    d = docs([(10 * i, t) for i, (_, _, t) in enumerate(cases)] + clean + question_only + [(1, ""), (2, None), (None, full[0]), (30_001, full[1]), (30_001, full[1])])
    got = collections.Counter((r.doc_id, r.item_id) for r in contamination.matches(d, df).collect())
    want = collections.Counter({(10 * i, k): 1 for i, (_, k, _) in enumerate(cases)})
    want.update({(None, 0): 1, (30_001, 1): 2})
    assert got == want
    kept = contamination.clean_rows(d, df)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == sorted([1, 2, 20_000] + [i for i, _ in clean])


def test_one_word_edits_at_every_position():
    import numpy as np

    for n in (10, 13, 20, 26, 40, 50):
        parts = [(np.arange(n), np.arange(0))] + [(np.arange(n - m), np.arange(n - m, n)) for m in (5, 8) if n > 2 * m]
        for q, a in parts:
            index = contamination.Index([(0, [f"w{i}" for i in q], [f"w{i}" for i in a])], dict.fromkeys((f"w{i}" for i in range(n)), 1), 100, n)
            whole = [f"w{i}" for i in range(n)]
            for k in range(n):
                for text in ([*whole[:k], "x", *whole[k + 1 :]], [*whole[:k], "x", *whole[k:]], [*whole[:k], *whole[k + 1 :]]):
                    for shift in (0, 60):
                        assert [h[:2] for h in contamination._hits(index, [" ".join(["y"] * shift + text + ["z"] * 9)])] == [(0, 0)], (n, len(a), k, text)
    index = contamination.Index([(0, [f"w{i}" for i in range(20)], ["a", "b", "c", "d"])], dict.fromkeys([f"w{i}" for i in range(20)] + list("abcd"), 1), 100, 24)
    question = " ".join(f"w{i}" for i in range(20))
    assert [len(list(contamination._hits(index, [f"{question} {t}"]))) for t in ("", "a b c d", "d c b a", "a x y b x c x y d")] == [0, 1, 0, 0]


def test_bounded_search_equals_full_scores(spark, items, monkeypatch):
    df, rows = items
    index = next(contamination.indexes(df, "item_id", "question", "answer"))
    import numpy as np

    terms = np.concatenate([index.ids_of(prose(640, s)) for s in range(6)])
    passage = np.arange(len(terms)) // contamination.PASSAGE
    for scale in (1.0, 0.3, 0.1):  # lower thresholds, so that chance overlaps count too
        index.threshold, old = index.threshold * scale, index.threshold
        index.impact, index.block_max, index.list_max = index.impact / scale, index.block_max / scale, index.list_max / scale
        got = {(int(p), int(k)): s for p, k, s in zip(*index.search(terms, passage))}
        want = {}
        starts = np.repeat(np.arange(len(index.lists) - 1), np.diff(index.lists))
        by_term = collections.defaultdict(list)
        for b, t in enumerate(starts):
            for q in range(index.postings[b], index.postings[b + 1]):
                by_term[t].append((index.item[q], index.impact[q]))
        for p in np.unique(passage):
            sums = collections.defaultdict(float)
            for t in set(terms[(passage == p) & (terms >= 0)].tolist()):
                for k, s in by_term[t]:
                    sums[k] += s
            want.update({(int(p), int(k)): s for k, s in sums.items() if s >= 1})
        assert set(got) == set(want) and all(abs(got[x] - want[x]) < 1e-9 for x in got)


def test_several_indexes_find_the_same(spark, docs, items, monkeypatch):
    df, rows = items
    d = docs([(i, f"{prose(90, i)} {rows[i][1]} {rows[i][2]}") for i in range(30)])
    once = sorted((r.doc_id, r.item_id) for r in contamination.matches(d, df).collect())
    monkeypatch.setattr(contamination, "INDEX_WORDS", 300)
    monkeypatch.setattr(contamination, "LONG", 50)
    assert sorted((r.doc_id, r.item_id) for r in contamination.matches(d, df).collect()) == once == [(i, i) for i in range(30)]
    assert contamination.clean_rows(d, df).count() == 0


def test_no_items_no_documents(spark, docs, items):
    none = spark.createDataFrame([], "item_id bigint, question string, answer string")
    d = docs([(1, "some text here")])
    assert contamination.matches(d, none).count() == 0 and contamination.clean_rows(d, none).count() == 1
    assert contamination.matches(docs([]), items[0]).count() == 0


def plain_share(given, children):
    """Shared by repeated rounds: fill what overflows, divide the rest anew. ``children``: name to (weight, capacity)."""
    left = min(given, sum(c for w, c in children.values() if w))
    out, open_ = dict.fromkeys(children, 0), {n: wc for n, wc in children.items() if wc[0]}
    while open_:
        total = sum(w for w, _ in open_.values())
        full = [n for n, (w, c) in open_.items() if c * total <= w * left]
        if not full:
            break
        n = min(full, key=lambda n: (open_[n][1] / open_[n][0], n is not None, n or ""))
        out[n] = open_.pop(n)[1]
        left -= out[n]
    if open_:
        total = sum(w for w, _ in open_.values())
        for n, (w, _) in open_.items():
            out[n] = w * left // total
        over = left - sum(out[n] for n in open_)
        for n in sorted(open_, key=lambda n: (n is not None, n or ""))[:over]:
            out[n] += 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_budgets_against_plain_rounds(spark, seed):
    r = random.Random(seed)
    leaves = [(d, l, s, r.choice([0, 1, 7, 100, 5000, 10**6]) * r.randint(1, 9)) for d in ("a", "b", None) for l in ("en", "de", None) for s in ("s1", "s2", None, "s3") if r.random() < 0.8]
    weights = {"domain": {"a": 5, "b": 0 if seed == 3 else 3}, "lang": {"en": 7, "de": 2}, "source": {"s1": 4}}
    total = sum(t for *_, t in leaves)
    df = spark.createDataFrame([(*x, 1) for x in leaves], "domain string, lang string, source string, tokens bigint, docs bigint")
    got = {(x.domain, x.lang, x.source): x.budget for x in mixing.budgets(df, F.expr("sum(tokens) div 2"), 2, weights).collect()}
    w = lambda level, name: weights[level].get(name, 1)
    cap = lambda *path: 2 * sum(t for *p, t in leaves if p[: len(path)] == list(path))
    want = {}
    top = plain_share(total // 2, {d: (w("domain", d), cap(d)) for d in {x[0] for x in leaves}})
    for d, b in top.items():
        mid = plain_share(b, {l: (w("lang", l), cap(d, l)) for l in {x[1] for x in leaves if x[0] == d}})
        for l, c in mid.items():
            low = plain_share(c, {s: (w("source", s), cap(d, l, s)) for s in {x[2] for x in leaves if x[:2] == (d, l)}})
            want |= {(d, l, s): v for s, v in low.items()}
    assert got == want


def test_mix_takes_whole_epochs_and_prefixes(spark):
    rows = [(i, prose(1 + i % 30, i), "en", "big" if i % 3 else "small") for i in range(300)] + [(None, None, None, None), (1, "", "en", "big"), (7, prose(5, 7), "de", None), (7, prose(5, 7), "de", None)]
    d = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA + ", domain string, tokens int")
    out = mixing.mix(d, F.col("domain"), (3, 2), 4, {"source": {"small": 5}}, seed=1)
    assert out.columns == [*d.columns, "mix_epoch", "mix_domain", "mix_tokens"]
    got = out.collect()
    total = sum(len((r[1] or "").split()) for r in rows)
    assert total * 3 // 2 - 4 * 30 <= sum(r.mix_tokens for r in got) <= total * 3 // 2
    times = collections.Counter((r.doc_id, r.source) for r in got if r.source == "small")
    assert max(times.values()) - min(times.values()) <= 1 and set(r.mix_epoch for r in got) <= {0, 1, 2, 3}
    again = mixing.mix(d.repartition(7), F.col("domain"), (3, 2), 4, {"source": {"small": 5}}, seed=1).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert mixing.mix(d.limit(0), F.col("domain")).count() == 0


def test_least_loaded_rule():
    assert sharding.least_loaded([5, 4, 3, 3, 3], 2) == [0, 1, 1, 0, 1]
    assert sharding.least_loaded([], 3) == []


def test_shards_are_even_and_groups_whole(spark, docs, monkeypatch):
    monkeypatch.setattr(sharding, "PART_GROUPS", 200)
    r = random.Random(2)
    texts = [prose(r.randint(1, 60), i) for i in range(1500)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5000 + i, "same copy") for i in range(400)] + [(None, "é"), (None, "é"), (7000, None), (7001, "")]
    got = sharding.assign(docs(rows), 8).collect()
    load, slots, where = collections.Counter(), collections.defaultdict(list), {}
    text = dict(rows)
    for x in got:
        load[x.shard] += x.size
        slots[x.shard].append(x.slot)
        assert where.setdefault(text[x.doc_id] or "", x.shard) == x.shard
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) - min(load.values()) < 0.01 * sum(load.values()) / 8
    assert sharding.assign(docs([]), 8).count() == 0
    one = sharding.assign(docs([(1, "x" * 100_000), (2, "y")]), 8).collect()
    assert {x.slot for x in one} == {0} and len({x.shard for x in one}) == 2
