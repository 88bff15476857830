"""The near-copy stage of the pipeline against a comparison of all shingle sets."""

from collections import Counter

import brute
import numpy as np
import pytest

from lapforge.llm import near_copies, vp_trees

VOCABULARY = [f"w{i}" for i in range(5000)]


def edited(rng, words, changes):
    out = list(words)
    for at in rng.choice(len(out), changes, replace=False):
        out[at] = f"x{rng.integers(1 << 40)}"
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def kept(df):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in df.collect())


def test_groups_of_edited_copies_and_clean_documents(spark):
    rng, rows, wanted = np.random.default_rng(5), [], []
    for group in range(60):
        base = list(rng.choice(VOCABULARY, 200))
        texts = [base] + [edited(rng, base, int(rng.integers(1, 4))) for _ in range(group % 4)]
        rows += [(1000 * group + i, " ".join(t)) for i, t in enumerate(texts)]
        wanted.append(1000 * group)
    base = list(rng.choice(VOCABULARY, 120))
    rows += [(90000 + i, " ".join(edited(rng, base, 1))) for i in range(300)]
    order = rng.permutation(len(rows))
    got = kept(near_copies.drop_near_copies(frame(spark, [rows[i] for i in order])))
    assert got == brute.similar(rows) == [(False, i) for i in [*wanted, 90000]]


def test_pairs_below_the_similarity_stay(spark):
    rng, rows = np.random.default_rng(6), []
    for i in range(80):
        base = list(rng.choice(VOCABULARY, 150))
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(edited(rng, base, int(rng.integers(4, 9)))))]
    want = brute.similar(rows)
    got = kept(near_copies.drop_near_copies(frame(spark, rows)))
    assert set(want) <= set(got) and len(got) - len(want) <= 2 and len(got) > 120


@pytest.mark.parametrize("low", [0.8, 0.85, 0.9, 0.95])
def test_recall_of_candidates(low):
    rng, hits = np.random.default_rng(7), []
    masks = vp_trees.PARTS
    while len(hits) < 250:
        base = list(rng.choice(VOCABULARY, 300))
        a, b = (" ".join(t).encode() for t in (base, edited(rng, base, int(rng.integers(1, 9)))))
        x, y = near_copies.shingle_hashes(a), near_copies.shingle_hashes(b)
        shared = len(np.intersect1d(x, y))
        if low <= shared / (len(x) + len(y) - shared) < low + 0.05:
            pair = np.array([np.frombuffer(near_copies.wide_fingerprint(t), np.uint64) for t in (a, b)])
            hits.append(any(len(near_copies.forest(pair, w, m)[0]) for w in range(near_copies.WORDS) for m in masks))
    assert np.mean(hits) >= 0.9


def test_forest_connects_what_all_pairs_connect():
    rng = np.random.default_rng(8)
    x = rng.integers(0, 1 << 63, (1500, near_copies.WORDS)).astype(np.uint64)
    x[500:] = x[rng.integers(0, 20, 1000)]
    for i in range(500, 1500):
        for bit in rng.choice(64 * near_copies.WORDS, rng.integers(1, 12), replace=False):
            x[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    mask = vp_trees.PARTS[0]
    i, j = near_copies.forest(x, 0, mask)
    d = sum(np.bitwise_count(x[:, None, w] ^ x[None, :, w]).astype(int) for w in range(near_copies.WORDS))
    part = np.bitwise_count((x[:, None, 0] ^ x[None, :, 0]) & mask)
    for limit in near_copies.BANDS:
        near = (part <= near_copies.RADIUS) & (d <= limit)
        own = d[i, j] <= limit
        assert (near_copies._merged(np.arange(1500), *np.nonzero(near)) == near_copies._merged(np.arange(1500), i[own], j[own])).all()
    assert len(i) < len(near_copies.BANDS) * 1500 and (part[i, j] <= near_copies.RADIUS).all()


def test_more_shards_and_pieces_than_one(spark):
    rng = np.random.default_rng(9)
    x = rng.integers(0, 1 << 63, (3000, near_copies.WORDS)).astype(np.uint64)
    x[1:800] = x[0]
    for i in range(1, 800):
        x[i, i % 5] ^= np.uint64(1) << np.uint64(i // 5 % 64)
    x = np.unique(x, axis=0)
    classes = spark.createDataFrame([(i, row.tobytes()) for i, row in enumerate(x)], "seq long, fp binary").cache()
    pairs = near_copies.candidates(classes, sample_rows=512, shard_rows=200, piece_rows=100).collect()
    d = sum(np.bitwise_count(x[:, None, w] ^ x[None, :, w]).astype(int) for w in range(near_copies.WORDS))
    linked = near_copies._merged(np.arange(len(x)), np.array([p.a for p in pairs]), np.array([p.b for p in pairs]))
    assert all(p.a < p.b and d[p.a, p.b] <= near_copies.WIDE for p in pairs)
    assert (linked == near_copies._merged(np.arange(len(x)), *np.nonzero(d <= 4))).all()


def test_edges(spark):
    long = " ".join(VOCABULARY * 20)
    rows = [(None, None), (3, ""), (4, " \n"), (5, "one two"), (6, "ONE\ttwo"), (6, "one two"), (None, "one two"), (7, long), (8, long + " end")]
    df = spark.createDataFrame([(i, t, 1, 2, "fp", 9) for i, t in rows], "doc_id long, text string, seq int, stay int, fp string, row int")
    left = near_copies.drop_near_copies(df)
    assert left.columns == df.columns and {r.fp for r in left.collect()} == {"fp"}
    assert Counter(kept(left)) == Counter([(False, 3), (False, 5), (False, 7)])
    assert near_copies.drop_near_copies(df.limit(0)).count() == 0
    assert kept(near_copies.drop_near_copies(frame(spark, [(None, "a b c"), (None, "a b c")]))) == [(True, 0)]


def test_hot_ends_are_spread(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "HOT", 3)
    texts = frame(spark, [(i, " ".join(VOCABULARY[:60])) for i in range(20)]).withColumnRenamed("doc_id", "seq")
    pairs = spark.createDataFrame([(0, i) for i in range(1, 20)], "a long, b long")
    assert near_copies.similar(pairs, texts).count() == 19


def test_texts_leave_arrow_in_short_slices(spark):
    """A batch of ten thousand long texts is not turned into Python objects at once."""
    import pyarrow as pa

    from lapforge.llm.common import SLICE_ROWS, slices

    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([f"text {i}" for i in range(1000)])], names=["i", "text"])
    parts = list(slices(batch))
    assert max(p.num_rows for p in parts) == SLICE_ROWS and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert not list(slices(batch.slice(0, 0)))
