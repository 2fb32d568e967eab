"""Near-duplicates and toxicity: nulls, empty and long texts, repeats, empty tables, clashing names."""

import numpy as np
import pytest

from lakeledger.llm import simhash, toxicity
from lakeledger.llm.common import components


def brute_classes(prints, radius):
    label = list(range(len(prints)))
    for _ in prints:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (int(a) ^ int(b)).bit_count() <= radius:
                    label[i] = label[j] = min(label[i], label[j])
    return label


def test_forest_equals_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, n, replace=False))) for b in base for n in (0, 1, 2, 3, 4, 5)]
    prints = np.unique(np.array(flips, np.uint64))
    for right in (None, 100):
        left = prints if right is None else prints[:right]
        u, v = simhash.forest(left, None if right is None else prints[right:], 3)
        assert len(u) < len(prints)
        at = {int(p): k for k, p in enumerate(prints)}
        label = np.arange(len(prints))
        simhash._join_labels(label, np.array([at[int(x)] for x in u]), np.array([at[int(x)] for x in v]))
        if right is None:
            assert label.tolist() == brute_classes(prints, 3)
        else:
            near = {(i, j) for i in range(right) for j in range(right, len(prints)) if (int(prints[i]) ^ int(prints[j])).bit_count() <= 3}
            assert near and all(label[i] == label[j] for i, j in near)


def test_tiles_of_any_size_give_the_same_classes(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-(1 << 62), 1 << 62, 60)
    prints = sorted({int(b) ^ (1 << int(k)) for b in base for k in rng.integers(0, 63, 6)})
    df = spark.createDataFrame([(p,) for p in prints], "fp bigint")

    def classes(tile):
        return {tuple(r) for r in components(simhash.links(df, 3, tile)).collect()}

    got = classes(1 << 17)
    assert got == classes(7)
    least = brute_classes([p & ((1 << 64) - 1) for p in prints], 3)
    want = {(p, min(q for q, lq in zip(prints, least) if lq == lp)) for p, lp in zip(prints, least) if least.count(lp) > 1}
    assert got == want


def test_components_of_chains_hubs_and_nothing(spark):
    chain = [(i, i + 1) for i in range(40)]
    hub = [(1000, 2000 + i) for i in range(300)] + [(1000, 1000), (2001, 1000)]
    got = dict(map(tuple, components(spark.createDataFrame(chain + hub, "u bigint, v bigint")).collect()))
    assert {got[i] for i in range(41)} == {0} and {got[2000 + i] for i in range(300)} == {1000}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_near_duplicates_edge_cases(spark, docs):
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(300_000))
    text = " ".join(f"word{i}" for i in range(400))
    rows = [(5, text), (3, text.upper()), (9, text + " tail"), (None, text), (7, ""), (8, None), (6, " \t\n"), (4, "A b"), (2, "a  B"), (1, long), (11, long), (11, long), (12, "Ünï cödé wörds")]
    got = simhash.near_duplicates(docs(rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == len(rows) and len(by[11]) == 2
    assert by[5][0].component_id == by[3][0].component_id == by[9][0].component_id == by[None][0].component_id == 3
    assert {by[i][0].fingerprint for i in (6, 7, 8)} == {"0" * 16} and {by[i][0].component_id for i in (6, 7, 8)} == {6}
    assert by[4][0].component_id == by[2][0].component_id == 2
    assert {r.component_id for r in by[1] + by[11]} == {1}
    kept = simhash.one_of_each(docs(rows))
    assert kept.columns == docs(rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 6, 12]


def test_one_of_each_without_ids_and_without_rows(spark, docs):
    rows = [(None, "one two three four"), (None, "one two three four"), (None, "five six seven eight")]
    assert simhash.one_of_each(docs(rows)).count() == 2
    assert simhash.one_of_each(docs([(1, "x y"), (1, "x y"), (1, "other words here now")])).count() == 2
    assert simhash.near_duplicates(docs([])).count() == 0 and simhash.one_of_each(docs([])).count() == 0


def test_long_texts_in_pieces_have_the_same_fingerprint(monkeypatch):
    rng = np.random.default_rng(2)
    values = [" ".join(f"w{k}" for k in rng.integers(0, 99, n)) + tail for n, tail in ((0, ""), (1, ""), (2, " "), (3, ""), (40, "\n\t"), (900, " é"), (5000, ""))] + ["x" * 5000, "x" * 300 + " y z"]
    whole = simhash.text_fingerprints(values, 3)
    monkeypatch.setattr(simhash, "LONG", 17)
    assert np.array_equal(whole, simhash.text_fingerprints(values, 3))
    monkeypatch.setattr(simhash, "PIECE", 5)
    assert np.array_equal(whole, simhash.text_fingerprints(values, 3))


@pytest.fixture(scope="module")
def toxic_texts():
    rng = np.random.default_rng(1)
    parts = ["ta", "no", "ri", "sel", "mu", "ko", "en", "ar"]
    word = lambda: "".join(rng.choice(parts, rng.integers(1, 4)))

    def text(bad):
        s = [" ".join(word() for _ in range(rng.integers(3, 12))) for _ in range(rng.integers(2, 30))]
        if bad:
            s[rng.integers(len(s))] += " blorgface " + word()
        return ". ".join(s) + "."

    return [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(400)]


def test_sentences_learned_from_documents(spark, docs, toxic_texts):
    labels = spark.createDataFrame([(i, y) for i, _, y in toxic_texts] + [(None, 1), (1, None), (99999, 1)], "doc_id bigint, toxic int")
    d = docs([(i, t) for i, t, _ in toxic_texts])
    model = toxicity.fit(d, labels, where=~toxicity.held_out("id"))
    rows = {r.doc_id: r for r in toxicity.score(d, model).withColumn("held_out", toxicity.held_out()).collect()}
    held = [(i, t, y) for i, t, y in toxic_texts if rows[i].held_out]
    assert len(held) > 40 and sum(rows[i].predicted == y for i, _, y in held) >= 0.97 * len(held)
    for i, t, y in held:
        if y and rows[i].predicted:
            data = t.encode()
            assert any(b"blorgface" in data[s.begin : s.end] for s in rows[i].offending)
    assert toxicity.clean_rows(d, model).filter("doc_id % 4 = 0").count() < 5
    assert toxicity.clean_rows(d, model).columns == d.columns


def test_toxicity_edge_cases(spark, docs):
    rows = [(1, ""), (2, None), (None, "abc. def"), (3, "x"), (3, "x"), (4, "no end of it " * 200_000), (5, "...!!!\n\n"), (6, "é" * 50)]
    d = docs(rows)
    none = toxicity.fit(d, spark.createDataFrame([], "doc_id bigint, toxic int"))
    one_kind = toxicity.fit(d, spark.createDataFrame([(3, 1), (6, 1)], "doc_id bigint, toxic int"))
    for m in (none, one_kind):
        got = toxicity.score(d, m).collect()
        assert len(got) == len(rows) and all(0 <= r.score < 0.5 and r.predicted == 0 for r in got)
    assert {r.score for r in toxicity.score(d, none).filter("doc_id in (1, 2)").collect()} == {0.0}
    assert toxicity.score(docs([]), none).count() == 0 and toxicity.clean_rows(docs([]), none).count() == 0


def test_pieces_do_not_change_scores():
    text = "Some words here. And mörе of them! " * 400
    model = toxicity.Model(-4.0, np.random.default_rng(0).normal(0, 0.1, 1 << toxicity.BITS).astype(np.float32))
    whole, at, _ = toxicity.document_scores([text], model)
    old, toxicity.PIECE = toxicity.PIECE, 97
    try:
        parts, at_parts, _ = toxicity.document_scores([text, "", text], model)
    finally:
        toxicity.PIECE = old
    assert np.allclose(whole[0], parts[[0, 2]]) and parts[1] == 0 and np.array_equal(at[0], at_parts[0])


def test_length_alone_is_not_toxic(toxic_texts):
    model = toxicity.train([t for _, t, _ in toxic_texts], np.array([y for _, _, y in toxic_texts]))
    clean = [s for _, t, y in toxic_texts if not y for s in t.split(". ")]
    lines = "\n".join(clean[i % len(clean)] for i in range(50_000))
    unseen = "\n".join(f"xq{i:x}" for i in range(50_000))
    texts = [lines, unseen, "." * 50_000, ". \n" * 50_000, lines + "\nblorgface", "." * 50_000 + " blorgface", unseen + "\nblorgface"]
    scores, begins, chances = toxicity.document_scores(texts, model)
    assert [s >= 0.5 for s in scores] == [False] * 4 + [True] * 3
    assert len(begins[2]) == 1 and all((p >= 0.5).sum() == 1 for p in chances[4:])


def test_runs_of_end_marks_are_one_break():
    data = b"Wait... what?!\n\nNo.\nYes"
    at = toxicity.sentence_starts(data)
    assert [data[a:b] for a, b in zip(at, [*at[1:], len(data)])] == [b"Wait...", b" what?!\n\n", b"No.\n", b"Yes"]
    assert toxicity.sentence_starts(b"").tolist() == [0]
