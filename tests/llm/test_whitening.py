"""Whitening: rank-one spectra against direct ones, the fitted whitening against numpy, and edge cases."""

import math
from fractions import Fraction

import numpy as np
import pytest

from lapforge.llm import whitening
from lapforge.llm.spectra import Scatter


def cases():
    draw = np.random.default_rng(0)
    yield np.floor(256 * draw.normal(0, 0.125, (400, 24)))
    x = np.floor(256 * draw.normal(0, 0.125, (60, 8)))
    x[:, 3], x[:, 4] = 0, x[:, 5]
    yield x
    yield np.repeat(np.eye(6) * 100, 3, axis=0)  # equal eigenvalues
    yield draw.normal(0, 1, (3, 10))  # fewer vectors than dimensions
    yield np.floor(draw.normal(0, 1e6, (50, 1)))
    yield draw.normal(0, 1, (80, 5)) * [1e6, 1, 1e-3, 1, 0]
    yield np.ones((9, 4))


def close(scatter, x):
    direct = (x - x.mean(0)).T @ (x - x.mean(0))
    size = max(1e-300, np.abs(direct).max())
    built = scatter.q @ np.diag(scatter.d) @ scatter.q.T
    return np.abs(built - direct).max() / size < 1e-12 and np.abs(scatter.q.T @ scatter.q - np.eye(x.shape[1])).max() < 1e-12 and np.allclose(scatter.mean, x.mean(0))


@pytest.mark.parametrize("x", list(cases()), ids=str)
def test_rank_one_updates(x):
    whole, a, b = Scatter(x.shape[1]), Scatter(x.shape[1]), Scatter(x.shape[1])
    for r in x:
        whole.add(r)
    for r in x[:len(x) // 3]:
        a.add(r)
    for r in x[len(x) // 3:]:
        b.add(r)
    a.join(b)
    empty = Scatter(x.shape[1])
    empty.join(whole)
    if np.ptp(x):
        assert close(whole, x) and close(a, x) and close(empty, x)
    else:
        assert not whole.d.any() and not a.d.any()


def integers(rows):
    out = [(v, [math.floor(256 * float(np.float32(c))) for c in x]) for v, x in rows
           if x is not None and all(c is not None and math.isfinite(c) for c in x)]
    dims = max((len(x) for _, x in out), default=0)
    return [(v, x + [0] * (dims - len(x))) for v, x in out]


def check(got, rows, count):
    rows = integers(rows)
    fit = np.array(sorted({tuple(x) for _, x in rows}), float)
    n, sums = len(fit), [sum(Fraction(x[i]) for x in {tuple(x) for _, x in rows}) for i in range(len(rows[0][1]))]
    centred = fit - fit.mean(0)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == count * len(rows)
    by_row = {}
    for r in got:
        by_row.setdefault((r.vec_id, r.deviation), []).append(r)
    white = {c: {} for c in range(1, count + 1)}
    for v, x in rows:
        deviation = int(sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)))
        expected = (np.array(x) - fit.mean(0)) @ vectors[:, :count] / np.sqrt(values[:count])
        mine = sorted(by_row[v, deviation], key=lambda r: r.component)
        for r in mine:
            assert r.n == n and abs(r.explained - values[r.component - 1] / values.sum()) < 1e-10 and r.identity_error < 1e-9
            assert abs(abs(r.whitened) - abs(expected[r.component - 1])) < 1e-6
        for r in mine[:count]:
            white[r.component][tuple(x)] = r.whitened
    matrix = np.array([[white[c][tuple(x)] for c in white] for x in {tuple(x) for _, x in rows}])
    assert np.abs(matrix.T @ matrix / n - np.eye(count)).max() < 1e-9


SCHEMA = "vec_id long, embedding array<float>, x int, n long, part int"


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)
    ints = whitening.integer_rows(df)
    return whitening.whiten(ints, whitening.fit_whitening(ints)).collect()


def test_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(whitening, "PART_ROWS", 30)
    monkeypatch.setattr(whitening, "FAN", 2)
    draw = np.random.default_rng(7)
    x = draw.normal(0, 1, (900, 12)) * np.linspace(0.6, 0.05, 12)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(2_000 + i, x[0].tolist()) for i in range(200)]  # copies weigh once
    rows += [(3_000, None), (3_001, [0.1, None]), (3_002, [float("nan")]), (3_003, [float("-inf")]), (3_004, [0.5, 0.25]), (3_005, [0.5, 0.25, 0.0]), (3_006, [])]
    check(run(spark, rows), rows, 4)


def test_fewer_components_than_asked(spark):
    rows = [(i, [i / 7, 2 * i / 7, 0.0]) for i in range(40)]
    check(run(spark, [(v, [math.floor(256 * c) / 256 if j else math.floor(256 * c) / 256 for j, c in enumerate(x)]) for v, x in rows[:1]] +
              [(i, [i / 256, 2 * i / 256, 0.0]) for i in range(1, 40)]), [(0, [0.0, 0.0, 0.0])] + [(i, [i / 256, 2 * i / 256, 0.0]) for i in range(1, 40)], 1)


def test_nothing_to_whiten(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [0.5, 0.5])]) == []
    assert run(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])]) == []
    assert run(spark, [(1, []), (2, None)]) == []


def test_deviation_beyond_64_bits():
    assert whitening._deviations(np.array([[1 << 40, 0]]), 1 << 10, [3, 0]) == [None]
    assert whitening._deviations(np.array([[3, 4]]), 2, [1, 1]) == [25 + 49]


def test_given_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(whitening.op11_embedding_whitening(spark, sf_dir).collect(), rows, 4)
