"""Helpers shared by the corpus operators: side tables, salted joins, chunks of text inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapforge.session import written_table

SALTS = 16
#: Bytes of text that a task looks at together; one longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Rows of a batch whose texts are taken out of Arrow at once.
SLICE_ROWS = 256
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def side_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later steps neither recompute it nor depend on an executor."""
    return written_table(df, f"llm-{name}")


def drop_side_table(df: DataFrame) -> None:
    """Delete a side table that no later step reads."""
    files = df.inputFiles()
    if files:
        sc = df.sparkSession.sparkContext
        folder = sc._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def payload(df: DataFrame, *drop: str) -> Column:
    """All columns of ``df`` as one struct, so that no column of the caller can clash with a helper column."""
    kept = [c for c in df.columns if c not in drop]
    return F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(True).alias("_none"))


def unpacked(row: str, columns: list[str], *new: str) -> list[Column]:
    """The struct's columns again, without those that the operator adds under the same name."""
    return [F.col(row).getField(c).alias(c) for c in columns if c not in new]


def salted_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", hot: str | None = None,
                spread: int = SALTS) -> DataFrame:
    """Join with few rows of ``right`` to a key, where one key may hold a large share of ``left``.

    The rows of a key go to ``spread`` tasks; each of them gets a copy of the key's rows of ``right``. If both sides have a
    boolean column ``hot`` that depends on the key, only its keys are spread. Always a merge join: which side is small
    enough for a broadcast must not decide whether ``left`` is shuffled. Should a share of a key still be large for a task,
    Spark's adaptive execution splits it, as it can split the left side of such a join at any row.
    """
    salts, number = F.array(*[F.lit(i) for i in range(spread)]), F.pmod(F.monotonically_increasing_id(), F.lit(spread)).cast("int")
    if hot:
        salts, number = F.when(F.col(hot), salts).otherwise(F.array(F.lit(0))), F.when(F.col(hot), number).otherwise(F.lit(0))
        on = [*on, hot]
    copies = right.withColumn("_salt", F.explode(salts)).hint("merge")
    return left.withColumn("_salt", number).join(copies, [*on, "_salt"], how).drop("_salt")


def bounded_sample(df: DataFrame, by: list[str], most: int, total: int) -> DataFrame:
    """At most ``most`` of about ``total`` rows, those with the least hash of ``by``; each task passes on few more than it must."""
    space = 1 << 30
    share = space if total <= most else int(space * min(1.0, 1.1 * most / total + 1e-6))
    return df.where(F.pmod(F.xxhash64(*by), F.lit(space)) < share).orderBy(F.pmod(F.xxhash64(*by), F.lit(space)), *by).limit(most)


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The UTF-8 bytes of a text column; null as empty."""
    return _bytes_of(batch.column(column))


def _bytes_of(texts: pa.Array) -> list[bytes]:
    return [x or b"" for x in texts.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Short slices of a batch: the texts of a whole batch as Python objects would take as much memory again."""
    for start in range(0, batch.num_rows, SLICE_ROWS):
        yield batch.slice(start, SLICE_ROWS)


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes in all."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield start, i
            start, held = i, 0
        held += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def spark_schema(*fields: str) -> str:
    return ", ".join(fields)


# Hashes of words, computed for a whole chunk at once. A word's hash is a polynomial in its bytes modulo 2^64: with prefix
# sums of byte * BASE^position, a word's value is a difference of two sums, brought to position zero by the inverse power.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.full(size, base, np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        if size > 4 * CHUNK_BYTES:
            return out
        _POWERS[base] = have = out
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_bounds(buf: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a buffer that begins and ends with a separator."""
    gap = separators[buf]
    edge = gap[1:] != gap[:-1]
    at = np.flatnonzero(edge) + 1
    return at[0::2], at[1::2]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span, order included. Wraps round on purpose."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values.astype(np.uint64, copy=False) * powers(base, n), out=sums[1:])
    inverse = _INVERSE if base == _BASE else pow(base, -1, 1 << 64)
    return mixed((sums[ends] - sums[starts]) * powers(inverse, n + 1)[starts])


ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def with_text_columns(df: DataFrame, text: str | tuple[str, str], new: str, make, drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with columns computed from whole texts inside the tasks.

    ``text`` is a column, or a struct column and its field. ``make()`` is called once in a task and gives a function from a list of texts (UTF-8, null as empty) to one Arrow
    array for each column of the DDL string ``new``. Columns of the same name are replaced, those in ``drop`` left out.
    """
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(new)
    kept = [c for c in df.columns if c not in added.fieldNames() and c not in drop]
    schema = StructType([df.schema[c] for c in kept] + list(added))
    column, field = (text, None) if isinstance(text, str) else text
    read = kept if column in kept else [*kept, column]
    source, at = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(read)]), read.index(column)

    def run(batches):
        compute = make()
        for batch in (part for whole in batches for part in slices(whole)):
            texts = _bytes_of(batch.column(at) if field is None else pc.struct_field(batch.column(at), field))
            for a, b in chunks(texts):
                part = batch.slice(a, b - a)
                columns = [part.column(i) for i in range(len(kept))] + compute(texts[a:b])
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return source.mapInArrow(run, schema)
