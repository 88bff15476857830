"""Exact top-k search: against all inner products, proofs that stop early, blocks, and edge cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapforge.llm import topk


def plain(rows, k=10, step=100):
    vectors = [(i, v, [math.floor(1024 * float(np.float32(c))) for c in x]) for i, (v, x) in enumerate(rows)
               if x is not None and all(c is not None and math.isfinite(c) for c in x)]
    out = []
    for i, v, x in vectors:
        if v is None or v % step:
            continue
        scores = [(-sum(a * b for a, b in zip(x, y, strict=False)), w is None, w or 0) for j, w, y in vectors if j != i]
        out += [(v, rank, None if none else w, -s) for rank, (s, none, w) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


SCHEMA = "vec_id long, embedding array<float>, row long, x string, chunk int"


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, 7, "x", 1) for r in rows], SCHEMA)
    got = topk.top_k(topk.integer_vectors(df), F.col("vec_id") % 100 == 0, **options)
    return sorted((tuple(r) for r in got.collect()), key=str)


def normal_rows(n=700, dims=16, seed=2):
    draw = np.random.default_rng(seed)
    return [(i, x.tolist()) for i, x in enumerate(draw.normal(0, 0.3, (n, dims)).astype(np.float32))]


@pytest.mark.parametrize("options", [{}, {"chunk_rows": 60}, {"few": 1.0}, {"few": 0.0}, {"chunk_rows": 5, "k": 3}])
def test_equals_plain_version(spark, options):
    rows = normal_rows()
    assert found(spark, rows, **options) == plain(rows, options.get("k", 10))


def test_blocks_of_queries_and_vectors(spark, monkeypatch):
    for name, value in (("QUERY_ROWS", 3), ("VECTOR_STEP", 40), ("QUERY_STEP", 2)):
        monkeypatch.setattr(topk, name, value)
    rows = normal_rows(900)
    assert found(spark, rows, chunk_rows=200) == plain(rows)


def test_edges(spark):
    draw = random.Random(4)
    rows = [(i, [draw.choice([0.0, 0.25, -0.5, 1.0]) for _ in range(4)]) for i in range(250)]  # many ties
    rows += [(100, rows[100][1]), (100, [9.0, 9.0, 9.0, 9.0]), (300, []), (301, None), (400, [1.0, None, 0.0, 0.0]), (500, [float("nan")] * 4),
             (600, [float("inf"), 0.0, 0.0, 0.0]), (700, [0.5]), (None, [2.0, 2.0, 2.0, 2.0]), (None, [2.0, 2.0, 2.0, 2.0]), (-100, [0.0] * 4)]
    rows += [(5_000 + i, [0.25, 0.25, 0.25, 0.25]) for i in range(300)]  # copies
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows, chunk_rows=11) == plain(rows)


def test_few_rows_and_none(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0, 2.0])]) == []
    assert found(spark, [(0, None), (1, [1.0])]) == []
    rows = [(0, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [0.0, 0.0])]
    assert found(spark, rows) == plain(rows)


def test_large_numbers(spark):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(1).integers(-(2**18), 2**18, (150, 3)))]
    assert found(spark, rows) == plain(rows)
    rows = [(i, [x * 2.0**2 for x in v]) for i, v in rows]  # close to 2^63
    assert found(spark, rows) == plain(rows)
    with pytest.raises(Exception, match="64 bits"):
        found(spark, [(i, [x * 2.0**2 for x in v]) for i, v in rows])


def test_proof_stops_before_the_last_segment():
    draw = np.random.default_rng(3)
    centres = draw.normal(0, 1, (40, 32))
    x = (centres[draw.integers(0, 40, 4_000)] + draw.normal(0, 0.1, (4_000, 32)))
    x = np.floor(1024 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    import pyarrow as pa

    data = pa.table({"row": np.arange(4_000), "vec_id": np.arange(4_000), "x": list(x)})
    rows = topk._index_chunk(0, data, 32)
    segments = [(np.frombuffer(r[2], np.uint32).astype(np.int64), np.frombuffer(r[3], np.uint32), np.frombuffer(r[4], np.int64), np.frombuffer(r[5])) for r in rows[1:]]
    header = np.arange(4_000), np.arange(4_000), np.ones(4_000, bool)
    stats = []
    best = topk._search_block(x[:200], np.arange(200), header, segments, 10, topk.FEW, stats)
    assert all(read < there and possible <= topk.FEW * pairs for read, there, possible, pairs in stats)
    scores = x[:200] @ x.T
    scores[np.arange(200), np.arange(200)] = -(1 << 60)
    assert np.array_equal(np.sort(best.score.reshape(200, 10)[:, ::-1], axis=1), np.sort(scores, axis=1)[:, -10:])


def test_given_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = topk.op12_exact_top_k(spark, sf_dir)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)
