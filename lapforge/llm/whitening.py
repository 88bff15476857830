"""Whitening of embeddings by an incremental eigendecomposition.

Components are turned into integers x = floor(scale * component). The fit takes every distinct x once, so copies don't weigh
and a vector that many rows share is one row after the first shuffle. Each part of the fit list feeds its vectors, one after
the other, into a spectrum of its own as centred rank-one updates (``spectra``); the parts' spectra are joined in a tree of
``FAN`` at a time by further rank-one updates, so no task or driver sees more than ``FAN`` of them. Rounding of very many
updates is removed by a last distributed Rayleigh-Ritz step: the covariance in the basis found is computed anew from all
vectors, centred by the exact mean, and its small eigenproblem gives the components.

The driver holds the sums of each dimension and one spectrum (dims x dims doubles: 32 KB for 64 dimensions), never rows.

Vectors that are null or hold null, infinite or NaN components, or ones beyond 2^62 / scale, are left out. A shorter vector
counts as filled up with zeros. Rows of equal ids or vectors each get their result; a null id stays null. Components whose
variance is zero within rounding have no whitened value and are left out, so constant vectors, a single vector, empty vectors
and an empty table give no rows. Equal eigenvalues have no unique vectors; some orthogonal ones are taken. ``deviation`` is
null where it doesn't fit 64 bits. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapforge.llm.common import side_table, table
from lapforge.llm.registry import register
from lapforge.llm.spectra import EPS, Scatter

SCALE = 256
COMPONENTS = 4
PART_ROWS = 20_000
FAN = 16
STEP = 4_096


def integer_rows(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, x) with x = floor(scale * component) of the vectors that take part."""
    v, most = F.col(f"`{vector}`"), float(1 << 62) / scale
    sound = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < most) & ~F.isnan(c))
    return df.where(sound).select(F.col(f"`{vec_id}`").alias("vec_id"), F.transform(v, lambda c: F.floor(c.cast("double") * scale)).alias("x"))


def dense(lists: pa.Array, dims: int) -> np.ndarray:
    """Lists of integers as rows, filled up with zeros."""
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), dims), np.int64)
    if lengths.sum():
        rows = np.repeat(np.arange(len(lists)), lengths)
        places = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[rows, places] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _blocks(batches, dims: int, column: int = 0):
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            yield dense(batch.column(column).slice(at, STEP), dims)


def _tree(parts: DataFrame, count: int, schema: str, join: Callable[[pa.Table], list]) -> DataFrame:
    """Join rows (part, ...) of ``count`` parts to one, ``FAN`` parts in a task, until one is left."""
    names = [c.split()[0] for c in schema.split(", ")]

    def joined(key, rows):
        out = [key[0].as_py(), *join(rows.sort_by("part"))]
        return pa.table([pa.array([v], rows.schema.field(n).type) for n, v in zip(names, out, strict=True)], names=names)

    while True:
        count = ceil(count / FAN)
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("part").applyInArrow(joined, schema)
        if count <= 1:
            return parts


SPECTRUM = "part int, n bigint, mean binary, d binary, q binary"


def fitted_spectrum(fit: DataFrame, dims: int, parts: int) -> Scatter:
    """The spectrum of the distinct vectors ``fit``: one for each part, then joined."""
    names = [c.split()[0] for c in SPECTRUM.split(", ")]

    def learn(batches):
        out = Scatter(dims)
        for block in _blocks(batches, dims):
            for x in block.astype(float):
                out.add(x)
        types = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        values = (TaskContext.get().partitionId(), *out.packed())
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

    def join(rows: pa.Table) -> list:
        first, *others = (Scatter.unpacked(*(r[c] for c in names[1:])) for r in rows.to_pylist())
        for other in others:
            first.join(other)
        return list(first.packed())

    learned = side_table(fit.select("x").repartition(parts).mapInArrow(learn, SPECTRUM), "spectra")
    row = _tree(learned, parts, SPECTRUM, join).first()
    return Scatter.unpacked(row.n, *(bytes(row[c]) for c in names[2:]))


MOMENTS = "part int, sums binary, products binary"


def projected_moments(fit: DataFrame, dims: int, parts: int, centre: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and products of ``(x - centre) @ basis`` over all of ``fit``."""
    def learn(batches):
        sums, products = np.zeros(basis.shape[1]), np.zeros((basis.shape[1], basis.shape[1]))
        for block in _blocks(batches, dims):
            y = (block - centre) @ basis
            sums += y.sum(axis=0)
            products += y.T @ y
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([sums.tobytes()]), pa.array([products.tobytes()])],
                                         names=["part", "sums", "products"])

    def join(rows: pa.Table) -> list:
        return [sum(np.frombuffer(r.as_py(), float) for r in rows.column(c)).tobytes() for c in ("sums", "products")]

    found = side_table(fit.select("x").repartition(parts).mapInArrow(learn, MOMENTS), "moments")
    row = _tree(found, parts, MOMENTS, join).first()
    size = basis.shape[1]
    return np.frombuffer(bytes(row.sums), float), np.frombuffer(bytes(row.products), float).reshape(size, size)


class Whitening:
    """Exact sums, the components (columns), their eigenvalues and share of the variance, and the error of the identity."""

    def __init__(self, n, sums, components, values, explained, identity_error):
        self.n, self.sums, self.components, self.values = n, sums, components, values
        self.explained, self.identity_error = explained, identity_error

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def scaled(self) -> np.ndarray:
        return self.components / np.sqrt(self.values)


def fit_whitening(rows: DataFrame, components: int = COMPONENTS, part_rows: int = PART_ROWS) -> Whitening | None:
    """Learn from the distinct x of ``integer_rows``; None if they don't vary. Starts Spark jobs, writes side tables."""
    fit = side_table(rows.select("x").distinct(), "fit-list")
    n, dims = fit.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    if n < 2 or not dims:
        return None
    # (3, 0) and (3) are the same vector once filled up
    if fit.where(F.size("x") < dims).limit(1).count():
        fit = side_table(fit.select(F.concat("x", F.array_repeat(F.lit(0).cast("bigint"), F.lit(dims) - F.size("x"))).alias("x")).distinct(), "fit-list")
        n = fit.count()
    found = fit.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).collect()
    sums = [int(r.s) for r in sorted(found, key=lambda r: r.at)]
    tasks = fit.sparkSession.sparkContext.defaultParallelism
    parts = max(1, ceil(n / part_rows), min(tasks, n // 256))
    spectrum = fitted_spectrum(fit, dims, parts)
    mean = np.array([s / n for s in sums])
    basis, _ = np.linalg.qr(spectrum.q[:, ::-1])
    _, products = projected_moments(fit, dims, parts, mean, basis)
    values, vectors = np.linalg.eigh(products / n)
    values, vectors = values[::-1], (basis @ vectors)[:, ::-1]
    total = float(np.trace(products) / n)
    kept = [i for i in range(min(components, dims)) if values[i] > 64 * EPS * dims * total]
    if not kept:
        return None
    values, vectors = values[kept], vectors[:, kept]
    vectors = vectors / np.sqrt((vectors * vectors).sum(axis=0))
    white = vectors / np.sqrt(values)
    shift, cross = projected_moments(fit, dims, parts, mean, white)
    off = cross / n - np.outer(shift / n, shift / n) - np.eye(len(kept))
    return Whitening(n, sums, vectors, values, values / total, float(np.abs(off).max()))


RESULT = "vec_id {id}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; None beyond 64 bits."""
    most = max(1, n * int(np.abs(x).max(initial=0)) + max(map(abs, sums)))
    if most * most * len(sums) < 1 << 63:
        away = n * x - np.array(sums, np.int64)
        return (away * away).sum(axis=1).tolist()
    away = n * x.astype(object) - np.array(sums, object)
    return [v if v < 1 << 63 else None for v in (away * away).sum(axis=1).tolist()]


def whiten(rows: DataFrame, model: Whitening | None) -> DataFrame:
    """Every row of ``integer_rows`` with each component: one pass, no shuffle."""
    schema = RESULT.format(id=rows.schema["vec_id"].dataType.simpleString())
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    n, sums, mean, scaled = model.n, model.sums, model.mean, model.scaled
    explained, error, k, dims = model.explained.tolist(), model.identity_error, len(model.values), len(model.sums)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                x, rows_ = dense(part.column(1), dims), part.num_rows
                each = np.repeat(np.arange(rows_), k)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), rows_), pa.int32()),
                    pa.array(np.full(rows_ * k, n)), pa.array(_deviations(x, n, sums), pa.int64()).take(pa.array(each)),
                    pa.array(((x - mean) @ scaled).ravel()), pa.array(explained * rows_), pa.array([error] * (rows_ * k)),
                ], names=[c.split()[0] for c in schema.split(", ")])

    return rows.select("vec_id", "x").mapInArrow(run, schema)


@register("op11_embedding_whitening")
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = integer_rows(table(spark, sf_dir, "embeddings"))
    return whiten(rows, fit_whitening(rows))
