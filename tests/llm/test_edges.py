"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import gc
import hashlib
import os
import sys
from types import SimpleNamespace

import numpy as np
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT]

import brute  # noqa: E402

from lapforge.llm import bpe, components, decontaminate, exact_dedup, licenses, quality, sharding, simhash, substrings, urls, vp_trees, warc  # noqa: E402

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(40))
ROWS = [
    (1, None), (2, ""), (3, " \t\n"), (4, "a b c"), (5, "a  b\nc"), (5, "a  b\nc"), (6, "ab c "), (None, "a b c"), (None, None),
    (7, LONG), (8, LONG), (9, LONG + " end"), (10, f"one {PASSAGE} two"), (11, f"three {PASSAGE}"), (12, "Ünï çödé 世界 🙂\u00a0x"),
    (13, "x " * 50), (14, "All rights reserved.\nsome words here"), (15, "one"),
]
SCHEMA = "doc_id long, text string, lang string, kept boolean, score double, row int, id string, tokens int, fp int, shard string, slot int, words string, k int, u int"
EXTRA = ("en", True, 0.5, 1, "x", 2, 3, "s", 4, "w", 5, 6)


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame([(*r, *EXTRA) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def test_exact_groups(messy, nothing):
    got = exact_dedup.exact_groups(messy)
    assert {"lang", "text", "keep_id", "group_size", "kept", "text_sha256"} <= set(got.columns)
    rows = got.collect()
    assert ordered((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == ordered(brute.exact(ROWS))
    assert sum(r.kept for r in rows) == len({r.text_sha256 for r in rows})
    assert exact_dedup.exact_groups(nothing).count() == 0
    stay = exact_dedup.exact_dedup(messy)
    assert stay.columns == messy.columns and stay.count() == len({r.text_sha256 for r in rows})


@pytest.mark.parametrize("first, growth, hot", [(1, 2, 0), (2, 3, 10_000)])
def test_exact_groups_over_many_levels(messy, monkeypatch, first, growth, hot):
    monkeypatch.setattr(exact_dedup, "HOT", hot)
    small = messy.where("length(text) < 400 OR text IS NULL")
    rows = [r for r in ROWS if len(r[1] or "") < 400]
    got = exact_dedup.exact_groups(small, carry_text=False, first=first, growth=growth).collect()
    assert ordered((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == ordered(brute.exact(rows))


def test_near_components(messy, nothing):
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_components(messy).collect()]
    assert ordered(got) == ordered(brute.near(ROWS))
    assert simhash.near_components(nothing).count() == 0
    stay = simhash.near_dedup(messy)
    ids = [r.doc_id for r in stay.collect()]
    assert stay.columns == messy.columns and sorted(i for i in ids if i is not None) == sorted({c for _, _, c in brute.near(ROWS) if c is not None})


def test_vp_trees_find_every_component():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    for _ in range(3):
        near = x[:1500].copy()
        for _ in range(4):
            near ^= np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64)
        x = np.unique(np.concatenate([x, near]))
    linked = {(i, int(j)) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x[i] ^ x) <= 4) if j > i}
    together = set()
    for mask in vp_trees.PARTS:
        first = vp_trees.linked(x, mask, 1, 4)
        together |= {(i, j) for i, j in linked if first[i] == first[j]}
        tree = vp_trees.grow(x[:3000], mask, 1, 100)
        leaves, where = vp_trees.shards(tree, x)
        homes = {}
        for leaf, i in zip(leaves.tolist(), where.tolist()):
            homes.setdefault(i, set()).add(leaf)
        assert set(homes) == set(range(len(x)))
        assert all(homes[i] & homes[j] for i, j in linked if int((x[i] ^ x[j]) & mask).bit_count() <= 1)
    assert linked and together == linked


@pytest.mark.parametrize("shard_rows, piece_rows", [(1 << 13, 1 << 16), (50, 1 << 16), (1 << 13, 100)])
def test_near_links_over_shards_and_pieces(spark, shard_rows, piece_rows):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, 400, dtype=np.uint64)
    near = np.repeat(base[:3], 150)
    for _ in range(5):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, len(near)).astype(np.uint64))
    x = np.unique(np.concatenate([base, near]))
    links = simhash.near_links(spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long"), 4, shard_rows=shard_rows, piece_rows=piece_rows)
    got = {r.node: r.root for r in components.components(links).collect()}
    wanted = list(range(len(x)))
    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i] ^ x) <= 4):
            a, b = sorted((wanted[i], wanted[int(j)]))
            wanted = [a if w == b else w for w in wanted]
    root = lambda i: got.get(int(x[i].view(np.int64)), int(x[i].view(np.int64)))
    assert len({(root(i), wanted[i]) for i in range(len(x))}) == len(set(wanted)) == len({root(i) for i in range(len(x))})


def test_components(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 60)]
    links = spark.createDataFrame([*path, *star, (7, 7), (3, 2)], "a long, b long")
    got = {r.node: r.root for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)}
    assert components.components(links.where("false")).count() == 0


@pytest.mark.parametrize("length, group", [(35, 4096), (3, 4096), (10, 1)])
def test_without_repeats(messy, nothing, length, group):
    got = substrings.without_repeats(messy, length=length, group=group)
    rows = got.select("doc_id", "n_words", "n_removed", "kept_sha256", "text").collect()
    assert ordered(tuple(r)[:4] for r in rows) == ordered(brute.repeats(ROWS, length))
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 for r in rows)
    assert substrings.without_repeats(nothing, length=length).count() == 0


def test_suffix_tree():
    words = [b"a", b"b", b"a", b"b", b"a", b"c"]
    assert sorted(substrings.repeated_suffixes([(words, i) for i in range(4)], 3)) == [0, 2]
    assert sorted(substrings.repeated_suffixes([(words, i) for i in range(5)], 2)) == [0, 1, 2, 3]


def test_round_trip(messy, nothing):
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    rows = bpe.bpe_round_trip(messy, path, P.PATTERN).select("doc_id", "text", "tokens", "decoded").collect()
    assert len(rows) == len(ROWS) and all(bytes(r.decoded) == (r.text or "").encode() for r in rows)
    assert bpe.bpe_round_trip(nothing, path, P.PATTERN).count() == 0
    encoder = bpe.Encoder(tuple(bpe.read_ranks(path)), P.PATTERN)
    for text in ("ab" * 5000, "x" * 3000, " \n\t  é世🙂", "aaaaaaab"):
        for piece in encoder.pattern.findall(text):
            if len(piece) < 200:
                data = piece.encode()
                assert list(encoder.pieces[piece]) == ([encoder.ranks[data]] if data in encoder.ranks else encoder.merged(data))
        assert encoder.decode(encoder.encode(text)) == text.encode()


def test_lasting_objects_are_left_out_of_collections():
    shared = SimpleNamespace(value=(tuple([bytes([b]) for b in range(256)] + [b"%05d" % i for i in range(20_000)]), r"\S+"))
    before = gc.get_freeze_count()
    try:
        assert bpe._encoder(shared).encode("00017") == [256 + 17]
        assert gc.get_freeze_count() > before
    finally:
        bpe._ENCODERS.clear()
        gc.unfreeze()


def test_longest_matches_step_back():
    tokens = tuple([bytes([b]) for b in range(256)] + [b"bc", b"ab", b"abc", b"cd"])
    encoder = bpe.Encoder(tokens, r"\S+")
    for text in ("abcd", "abc", "ab", "abcabcd", "xbcd", "é", ""):
        assert encoder.encode(text) == (encoder.merged(text.encode()) if text else []), text
        assert encoder.decode(encoder.encode(text)) == text.encode()


def test_memo_stays_bounded():
    calls = []
    memo = bpe.Bounded(lambda x: calls.append(x) or x, limit=3)
    assert [memo[i] for i in (1, 2, 3, 1, 4, 1, 5)] == [1, 2, 3, 1, 4, 1, 5]
    assert len(memo) <= 3 and len(memo.older) <= 3 and calls == [1, 2, 3, 4, 5]


def test_contaminated(spark, messy, nothing):
    items = spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (2, None), (3, ""), (4, "one"), (None, " ".join(f"w{i % 977}x{i % 13}" for i in range(20)))], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(messy, items).collect()}
    assert got == {(10, 1), (11, 1), (7, None), (8, None), (9, None)}
    assert decontaminate.contaminated(nothing, items).count() == 0 and decontaminate.contaminated(messy, items.where("false")).count() == 0
    clean = decontaminate.decontaminate(messy, items)
    assert clean.columns == messy.columns and clean.count() == len(ROWS) - 5


def test_contamination_tolerates_substitutions(spark):
    words = PASSAGE.split()
    every_fifth = [w if i % 5 else "other" for i, w in enumerate(words)]
    every_second = [w if i % 2 else "other" for i, w in enumerate(words)]
    docs = spark.createDataFrame([(1, "intro " + " ".join(every_fifth) + " outro"), (2, " ".join(every_second)), (3, PASSAGE.upper().replace(" ", ", "))], "doc_id long, text string")
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    rows = {r.doc_id: r for r in decontaminate.contaminated(docs, items).collect()}
    assert set(rows) == {1, 3} and rows[3].n_words == 40 and rows[1].n_agreeing >= 0.8 * rows[1].n_words >= 10


def test_quality(spark, messy, nothing):
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, 1), (7, None), (10, 1), (99, 1)], "doc_id long, quality int")
    rows = quality.quality_scores(messy, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert quality.quality_scores(nothing, labels).count() == 0
    none = quality.quality_scores(messy, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.keep_good(messy, labels.where("false")).columns == messy.columns


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000], rounds=20, pair_rounds=60)
    assert ((model.scores(x[3000:]) > 0.5) == (y[3000:] > 0.5)).mean() > 0.9


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_sharding(messy, shards):
    rows = sharding.documents_by_bytes(messy, shards).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.shard < shards for r in rows)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_sharding_balances_and_keeps_groups(spark, nothing):
    rng = np.random.default_rng(1)
    rows = [(i, "x" * int(n) + str(i % 400)) for i, n in enumerate(rng.integers(1, 60, 4000))] + [(5000 + i, "copy " * 12) for i in range(2000)]
    placed = sharding.documents_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    size = {s: sum(r.size for r in placed if r.shard == s) for s in range(4)}
    assert max(size.values()) <= 1.02 * sum(size.values()) / 4
    heavy = 61 * 2000 > sum(size.values()) / 4
    homes = {}
    for r in placed:
        homes.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert all(len(h) == 1 for key, h in homes.items() if not heavy or key[1] != 61)
    assert sharding.documents_by_bytes(nothing).count() == 0


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://A.ORG/x?y"), (4, "http://A.ORG/x?y"), (5, "https://b.example.org/es/1#t"), (6, "http://c.com/fr"),
            (7, "http://c.com/de/1"), (8, "http://example.org/en/1"), (9, "http://org"), (10, "x://y://z/q"), (None, "http://d.net/" + "p" * 5000), (11, "http://x.com/fr/://")]
    pages = spark.createDataFrame([(*r, "h", 0.1) for r in rows], "page_id long, url string, host string, score double")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judged(pages).collect()}
    assert urls.judged(pages).count() == len(rows) and urls.judged(pages.where("false")).count() == 0
    assert got[1][:3] == got[2][:3] == got[3][:3] == ("", "", None)
    assert got[4] == ("a.org", "/x", "org/", "allow") and got[5] == ("b.example.org", "/es/1", "example.org/es/", "block")
    assert got[6][:3] == ("c.com", "/fr", None) and got[7] == ("c.com", "/de/1", "com/de/", "block")
    assert got[8] == ("example.org", "/en/1", "example.org/en/1", "block") and got[9][:3] == ("org", "", None)
    assert got[10][:2] == ("y:", "//z/q") and got[11] == ("x.com", "/fr/://", "com/fr/", "allow")


def test_threshold():
    assert urls.threshold([(-3, 0, 4), (2, 5, 0)], 0.1) == pytest.approx(0.2)
    assert urls.threshold([], 0.1) == 0.0 and urls.threshold([(4, 3, 0)], 0.1) == 0.0


def test_fixity(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "p" * (i * 37 % 500)) for i in range(800)] + [(5, None, None), (None, "u", "b"), (5, None, None)],
                                  "page_id long, url string, html string")
    found = warc.audit_pages(pages).collect()
    assert {r.status for r in found} == {"altered", "missing"}
    assert all(r.expected != r.found for r in found) and all((r.found is None) == (r.status == "missing") for r in found)
    assert warc.audit_pages(pages.where("false")).count() == 0
    records = spark.createDataFrame([(i * 1000, 1000, f"d{i}") for i in range(300)], "offset long, length long, digest string")
    assert warc.merkle_audit(records, records).count() == 0
    extra = records.where("offset <> 7000").unionByName(records.where("offset = 9000").selectExpr("offset + 5 AS offset", "length", "digest"))
    assert sorted((r.offset, r.status) for r in warc.merkle_audit(records, extra).collect()) == [(7000, "missing"), (9005, "extra")]


def test_licenses(spark, messy, nothing):
    got = [(r.doc_id, r.line, r.license) for r in licenses.license_units(messy).collect()]
    assert got == [(14, 1, "all-rights-reserved")]
    assert licenses.license_units(nothing).count() == 0
    mit = licenses.TEMPLATES["mit"]
    docs = spark.createDataFrame([(1, mit.replace(". ", ".\n")), (2, mit.lower().replace("software", "program", 2)), (3, "all all")], "doc_id long, text string")
    rows = {(r.doc_id, r.line): (r.license, r.dice) for r in licenses.license_units(docs).collect()}
    assert rows[1, 0][0] == "mit" and rows[1, 0][1] == 1.0 and rows[2, 1][0] == "mit" and 0.8 <= rows[2, 1][1] < 1 and (3, 1) not in rows


def test_pipeline_stages(spark, messy, nothing):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    assert corpus_pipeline.ORACLE_SQL is None
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES, start=1):
        out, empty = stage(spark, messy, sf), stage(spark, nothing, sf)
        assert empty.count() == 0 and out.count() <= len(ROWS), name
        if number < len(corpus_pipeline.STAGES):
            assert out.columns == messy.columns and dict(out.dtypes) == dict(messy.dtypes), name
            assert {r.lang for r in out.select("lang").distinct().collect()} <= {"en"}, name
