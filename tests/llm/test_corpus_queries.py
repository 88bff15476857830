"""The registered corpus queries over whole small tables, against SQL or plain versions."""

import os
import sys
import zlib
from collections import Counter

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

import brute  # noqa: E402
import check_queries  # noqa: E402

from lapforge.llm.queries import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))
    assert "pipeline" in QUERIES and set(QUERIES) <= set(check_queries.contract.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in check_queries.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    verdict = check_queries.compare(QUERIES[name](spark, SF), con, ORACLES[name])
    assert verdict.startswith("ok") and "EMPTY" not in verdict, verdict


def test_op1(spark):
    rows = QUERIES["op1_url_filter"](spark, SF).collect()
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert sorted(r.page_id for r in rows) == sorted(urls)
    decided = {urls[r.page_id]: r.verdict == "allow" for r in rows if r.rule}
    learned = [(u, good) for u, good in decided.items() if zlib.crc32(u.encode()) % 5]
    wanted = brute.url_scores([urls[r.page_id] for r in rows], learned)
    assert max(abs(r.score - w) for r, w in zip(rows, wanted)) < 1e-6
    for r in rows:
        if r.rule is None:
            assert not r.host.endswith("org") and not r.path.startswith(("/fr/", "/de/") if r.host.endswith("com") else "-")
    free = [r for r in rows if r.rule is None]
    assert max((r.score for r in free if r.verdict == "block"), default=-9) < min((r.score for r in free if r.verdict == "allow"), default=9)


def test_op2(spark, docs):
    rows = QUERIES["op2_kd_sharding"](spark, SF).collect()
    texts = dict(docs)
    assert sorted(r.doc_id for r in rows) == sorted(texts) and {r.shard for r in rows} == set(range(8))
    shards, slots = Counter(), {}
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        shards[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r.size for r in rows)
    assert max(shards.values()) - min(shards.values()) <= 2 * largest


def test_op5(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in QUERIES["op5_decontamination"](spark, SF).collect()}
    assert got == brute.shared_runs(docs, items) and got


def test_op6(spark, docs):
    import hashlib

    import public_tokenizers
    import tiktoken

    from lapforge.llm.bpe import read_ranks

    tokens = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    sha = lambda data: hashlib.sha256(data).hexdigest()
    wanted = []
    for key, text in docs:
        ids = plain.encode_ordinary(text or "")
        wanted.append((key, len(ids), sha(",".join(map(str, ids)).encode()), sha((text or "").encode())))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op6_bpe"](spark, SF).collect()]
    assert sorted(got) == sorted(wanted)


def test_op7(spark, docs):
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in QUERIES["op7_simhash_near_dedup"](spark, SF).collect()]
    assert sorted(got) == sorted(brute.near(docs))


def test_op9(spark, docs):
    got = [tuple(r) for r in QUERIES["op9_substring_dedup"](spark, SF).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got) == sorted(brute.repeats(docs, 35))


def test_op10(spark):
    rows = {r.doc_id: r for r in QUERIES["op10_quality"](spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for i, r in rows.items())
    unseen = [(rows[x.doc_id].predicted, x.quality) for x in labels if rows[x.doc_id].held_out]
    assert len(unseen) > 50 and sum(a == b for a, b in unseen) >= 0.97 * len(unseen)


def test_pipeline(spark, docs):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "simhash near-dedup", "benchmark decontamination", "byte-level bpe"]
    table = spark.read.parquet(f"{SF}/documents.parquet")
    good = corpus_pipeline.STAGES[0][1](spark, table, SF)
    assert good.columns == table.columns
    rows = [(r.doc_id, r.text) for r in good.collect()]
    single = {keep for _, keep, _, _ in brute.exact(rows)}
    rows = [r for r in rows if r[0] in single]
    first = {key for _, key in brute.similar(rows)}
    rows = [r for r in rows if r[0] in first]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {d for d, _ in brute.shared_runs(rows, items)}
    assert dirty and {r.doc_id for r in QUERIES["pipeline"](spark, SF).collect()} == {d for d, _ in rows} - dirty
