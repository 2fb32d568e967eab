"""Corpus queries against their SQL twins in DuckDB, and the contracts of those without one."""

import collections
import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lakeledger.llm import sharding
from lakeledger.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import table

DIR = "/root/testdata/sf0.001"
TABLES = ["documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    yield con
    con.close()


def test_all_registered():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= names
    assert set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    r = duck.execute(ORACLES[name])
    cols = [c[0] for c in r.description]
    assert sorted(df.columns) == sorted(cols)
    assert table(df.columns, df.collect()) == table(cols, r.fetchall())


def test_contract_columns(spark):
    want = {
        "op6_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
        "op7_simhash_near_dedup": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
        "op8_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
        "op9_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
        "op10_html_extraction": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
        "op11_best_fit_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
        "op12_hard_negatives": {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"},
        "op13_prefix_trie": {"conv_id": "bigint", "depth": "bigint", "parent_conv_id": "bigint", "n_convs": "bigint", "n_children": "bigint", "n_leaves": "bigint", "saved_tokens": "bigint", "ends_sha256": "string"},
        "op4_top_k": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    }
    for name, columns in want.items():
        assert columns.items() <= dict(QUERIES[name](spark, DIR).dtypes).items(), name


def test_toxicity_contract(spark):
    rows = QUERIES["op6_toxicity"](spark, DIR).collect()
    assert len(rows) == spark.read.parquet(f"{DIR}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)


def test_sharding_contract(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    rows = QUERIES["op8_sharding"](spark, DIR).collect()
    slots, group = collections.defaultdict(list), {}
    for r in rows:
        data = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        assert group.setdefault(data, r.shard) == r.shard and 0 <= r.shard < 40
        slots[r.shard].append(r.slot)
    assert len(rows) == len(docs)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_decontamination_against_plain_search(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").collect()
    items = spark.read.parquet(f"{DIR}/benchmark.parquet").collect()
    want = {(d.doc_id, i.item_id) for d in docs for i in items if i.text in (d.text or "")}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op2_decontamination"](spark, DIR).collect()}
    assert want and got == want


def test_fingerprints_against_plain_loop(spark):
    import re

    import xxhash

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in QUERIES["op7_simhash_near_dedup"](spark, DIR).collect()}
    prints = {}
    for i, text in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        s = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert rows[i].fingerprint == f"{prints[i]:016x}"
    label = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i in prints:
            least = min(label[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 3)
            if least < label[i]:
                label[i], changed = least, True
    assert {i: r.component_id for i, r in rows.items()} == label


def test_warc_digests(spark):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{DIR}/pages.parquet").collect()}
    for r in QUERIES["op9_warc"](spark, DIR).collect():
        assert r.payload_digest == hashlib.sha1(pages[r.page_id]).hexdigest()


def test_pipeline_against_plain_steps(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    here, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        before = here.columns
        here = stage(spark, here, DIR)
        here = spark.createDataFrame(here.collect(), here.schema)
        seen[name] = here
        if name != "sharding":
            assert here.columns == before and here.schema.simpleString() == docs.schema.simpleString()
    ids = lambda d: [r.doc_id for r in d.select("doc_id").collect()]
    toxic = {r.doc_id for r in QUERIES["op6_toxicity"](spark, DIR).filter("predicted = 1").collect()}
    assert set(ids(seen["toxicity"])) == set(ids(docs)) - toxic
    assert len(ids(seen["near_dedup"])) == len(set(ids(seen["near_dedup"])))
    held = {r.doc_id: r.text for r in seen["near_dedup"].collect()}
    assert set(ids(seen["decontamination"])) == {i for i, t in held.items() if not any(x in t for x in items)}
    assert set(ids(seen["mixing"])) <= set(ids(seen["decontamination"]))
    assert sorted(ids(seen["sharding"])) == sorted(ids(seen["mixing"]))
    final = entry.queries()["pipeline"](spark, DIR)
    assert sorted(map(tuple, final.select(*sorted(final.columns)).collect())) == sorted(map(tuple, seen["sharding"].select(*sorted(final.columns)).collect()))


def test_pipeline_keeps_texts_and_columns(spark, tmp_path):
    """Nulls, empty texts, repeated rows and columns called like those of the stages; then an empty table."""
    import corpus_pipeline

    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{DIR}/{t}.parquet").write.parquet(f"{tmp_path}/a/{t}.parquet")
        spark.read.parquet(f"{DIR}/{t}.parquet").write.parquet(f"{tmp_path}/b/{t}.parquet")
    docs = spark.read.parquet(f"{DIR}/documents.parquet").withColumns({c: F.concat(F.lit(f"own {c} "), F.col("doc_id")) for c in ("mix_tokens", "_mix_full", "shard", "_to_shard")})
    odd = [(None, None, None, None), (7, "", "en", None), (7, "", "en", None), (None, "a text of its own without a source", None, "src0")]
    odd = spark.createDataFrame(odd, "doc_id bigint, text string, lang string, source string")
    docs = docs.unionByName(odd, allowMissingColumns=True)
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/a")
    assert out.columns == [*docs.columns, "size", "text_crc32", "shard_"]
    rows, given = out.collect(), set(docs.collect())
    assert rows and all(tuple(r)[: len(docs.columns)] in given for r in rows)
    shard = {}
    for r in rows:
        data = (r.text or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 16, zlib.crc32(data)) and 0 <= r.shard_ < 40
        assert shard.setdefault(data, r.shard_) == r.shard_
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").collect() == []


def test_shards_of_rows_are_those_of_assign(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").repartition(7)
    a = sharding.assign(docs, 40).select("doc_id", "size", "text_crc32", "shard")
    b = sharding.with_shards(docs, 40).select("doc_id", "size", "text_crc32", "shard")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
