"""Exact top-k search by inner product, over an impact-ordered index read score at a time.

Components are turned into integers. A posting is a component of a vector; its impact is the number of bits of its size, so
a segment of the index holds all postings of a chunk of vectors with sizes between two powers of two. A search adds the
segments' contributions in descending order of impact. What is still missing of a score is at most the length of the query
times the length of the vector's components in the segments not read (Cauchy and Schwarz), and that length is stored with
each segment. A vector whose score so far and this bound together stay below the k-th best lower bound can't be a member.
Reading stops only when this proof leaves few possible members (or no segment is left), and those get their exact score.
How many count as few (``FEW``) decides when it is cheaper to score them at once; the result is exact with any number.

Queries and vectors meet in blocks: a chunk of at most ``CHUNK_ROWS`` vectors with a block of about ``QUERY_ROWS`` queries in
one task, which passes on k rows for each query. Chunks are dealt by row number, so equal ids or vectors don't gather. No
side is broadcast or collected.

Vectors that are null or hold null, infinite or NaN components take no part, either as queries or as candidates. A shorter
vector counts as filled up with zeros, an empty one scores zero. A null id is no query; as a candidate it comes after all
ids of its score. Equal ids: each row is a query or candidate of its own, and only the query's own row is left out. Scores
must fit 64 bits, else the search raises. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapforge.llm.common import side_table, table
from lapforge.llm.registry import register

SCALE = 1024
CHUNK_ROWS = 32_768
QUERY_ROWS = 2_048
#: Vectors and queries that a task scores together.
VECTOR_STEP, QUERY_STEP = 4_096, 256
FEW = 0.02
#: Sums of products below this are exact in double precision.
EXACT = 1 << 53
#: Impact of the rows that hold a chunk's ids: read first.
HEADER = 1 << 20


def integer_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(row, vec_id, x) with x = floor(scale * component); without vectors that are null or not finite."""
    x = F.col(f"`{vector}`")
    sound = F.col(f"`{vector}`").isNotNull() & F.forall(x, lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))) & ~F.isnan(c))
    return df.where(sound).select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{vec_id}`").alias("vec_id"),
        F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("x"))


def _dense(lists: pa.Array, dims: int) -> np.ndarray:
    """Lists of integers as rows, filled up with zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), dims), np.int64)
    rows = np.repeat(np.arange(len(lists)), lengths)
    places = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[rows, places] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _index_chunk(chunk: int, data: pa.Table, dims: int) -> list[tuple]:
    """The chunk's header and its posting segments by descending impact, each with the lengths that are left after it."""
    x = _dense(data.column("x"), dims)
    sizes = np.abs(x)
    impact = np.zeros(x.shape, np.int64)
    for bits in range(63):
        more = sizes >> bits
        if not more.any():
            break
        impact += more > 0
    left = np.square(x.astype(float)).sum(axis=1)
    ids = data.column("vec_id")
    # Ids are kept as plain numbers, so a null needs a mark of its own.
    known = np.asarray(ids.is_valid())
    numbers = ids.fill_null(0).to_numpy().astype(np.int64)
    out = [(chunk, HEADER, numbers.tobytes(), data.column("row").to_numpy().tobytes(), known.tobytes(), b"")]
    for level in sorted(set(np.unique(impact).tolist()) - {0}, reverse=True):
        row, place = np.nonzero(impact == level)
        values = x[row, place]
        left = np.maximum(left - np.bincount(row, np.square(values.astype(float)), minlength=len(x)), 0)
        rest = np.sqrt(left) if level > impact[impact > 0].min() else np.zeros(len(x))
        out.append((chunk, level, row.astype(np.uint32).tobytes(), place.astype(np.uint32).tobytes(), values.tobytes(), rest.tobytes()))
    return out


SEGMENT = "chunk int, impact int, a binary, b binary, c binary, rest binary"


def build_index(vectors: DataFrame, dims: int, chunks: int) -> DataFrame:
    """Posting segments (chunk, impact, rows, places, values, lengths left) of ``integer_vectors``; a written table."""
    def run(key, data):
        rows = _index_chunk(key[0].as_py(), data, dims)
        names = [c.split()[0] for c in SEGMENT.split(", ")]
        types = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
        return pa.table([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    dealt = vectors.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int"))
    return side_table(dealt.groupBy("chunk").applyInArrow(run, SEGMENT), "impact-index")


class _Best:
    """The k best (score, id, row) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.query = np.zeros(0, np.int64)
        self.score, self.id, self.known, self.row = (np.zeros(0, np.int64) for _ in range(4))
        self.floor = np.full(queries, -np.inf)

    def add(self, query, score, ids, known, row) -> None:
        both = [np.concatenate([a, b]) for a, b in zip((self.query, self.score, self.id, self.known, self.row), (query, score, ids, known, row), strict=True)]
        # ~score instead of -score: defined for the least integer too
        order = np.lexsort((both[4], both[2], 1 - both[3], ~both[1], both[0]))
        both = [a[order] for a in both]
        starts = np.searchsorted(both[0], both[0])
        rank = np.arange(len(both[0])) - starts
        kept = [a[rank < self.k] for a in both]
        self.query, self.score, self.id, self.known, self.row = kept
        last = both[0][rank == self.k - 1]
        self.floor[last] = both[1][rank == self.k - 1]


def _search_block(q: np.ndarray, q_rows: np.ndarray, header, segments: list, k: int, few: float, stats: list | None = None) -> _Best:
    """The k best of one chunk for one block of queries."""
    ids, rows, known = header
    best = _Best(len(q), k)
    largest = max([int(np.abs(q).max(initial=0)), *(int(np.abs(s[2]).max(initial=0)) for s in segments)])
    dims = q.shape[1]
    if largest * largest * max(dims, 1) >= 1 << 63:
        raise ValueError("inner products of these vectors don't fit 64 bits")
    exact = largest * largest * max(dims, 1) < EXACT
    kind = np.float64 if exact else np.int64
    q = q.astype(kind)
    q_length = np.sqrt(np.square(q.astype(float)).sum(axis=1))
    own = {r: i for i, r in enumerate(q_rows.tolist())}
    for v0 in range(0, len(ids), VECTOR_STEP):
        v1 = min(v0 + VECTOR_STEP, len(ids))
        full = np.zeros((v1 - v0, dims), kind)
        parts = []
        for row, place, value, rest in segments:
            a, b = np.searchsorted(row, (v0, v1))
            part = np.zeros((v1 - v0, dims), kind)
            part[row[a:b] - v0, place[a:b]] = value[a:b]
            full += part
            parts.append((part, rest[v0:v1]))
        selves = [(own[r], i) for i, r in enumerate(rows[v0:v1].tolist()) if r in own]
        for q0 in range(0, len(q), QUERY_STEP):
            block = q[q0:q0 + QUERY_STEP]
            self_q = np.array([a - q0 for a, _ in selves if q0 <= a < q0 + len(block)], np.int64)
            self_v = np.array([i for a, i in selves if q0 <= a < q0 + len(block)], np.int64)
            score = np.zeros((len(block), v1 - v0), kind)
            floor, done = best.floor[q0:q0 + len(block)], False
            possible = np.ones(score.shape, bool)
            for number, (part, rest) in enumerate(parts):
                score += block @ part.T
                last = number == len(parts) - 1
                # a little more than the bound, against rounding
                slack = 0 if last else np.outer(q_length[q0:q0 + len(block)] * (1 + 1e-9) + 1e-6, rest * (1 + 1e-9) + 1e-6)
                low = floor
                if (last or number >= len(parts) // 2) and not np.isfinite(floor).all() and v1 - v0 > k:
                    sure = score - slack
                    sure = sure.astype(float) if exact else sure
                    lowest = -np.inf if exact else np.iinfo(np.int64).min
                    sure[self_q, self_v] = lowest
                    kth = np.partition(sure, v1 - v0 - k, axis=1)[:, v1 - v0 - k]
                    low = np.maximum(floor, np.where(kth == lowest, -np.inf, kth.astype(float)))
                # scores beyond 2^53 are compared as doubles: one unit in the last place is given away
                possible = score + slack >= (low if exact else low - np.abs(low) * 1e-15 - 1)[:, None]
                possible[self_q, self_v] = False
                if last or possible.mean() <= few:
                    done = last
                    if stats is not None:
                        stats.append((number + 1, len(parts), int(possible.sum()), possible.size))
                    break
            qi, vi = np.nonzero(possible)
            if done:
                found = score[qi, vi]
            else:
                found = np.concatenate([np.einsum("ij,ij->i", block[qi[a:a + 65_536]], full[vi[a:a + 65_536]]) for a in range(0, max(len(qi), 1), 65_536)])
            at = v0 + vi
            best.add(q0 + qi, found.astype(np.int64), ids[at], known[at].astype(np.int64), rows[at])
    return best


def _numbers(value, kind) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


RESULT = "query_row bigint, query_id bigint, row bigint, vec_id bigint, score bigint"


def search(index: DataFrame, queries: DataFrame, dims: int, chunks: int, k: int = 10, few: float = FEW) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best of every query, from the rows (row, vec_id, x) of ``queries``."""
    blocks = max(1, ceil(queries.count() / QUERY_ROWS))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    read = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(segments, wanted):
        empty = pa.table([pa.array([], pa.int64())] * 5, names=[c.split()[0] for c in RESULT.split(", ")])
        if not segments.num_rows or not wanted.num_rows:
            return empty
        segments = segments.sort_by([("impact", "descending")])
        a, b, c, rest = (segments.column(n) for n in ("a", "b", "c", "rest"))
        header = _numbers(a[0], np.int64), _numbers(b[0], np.int64), _numbers(c[0], bool)
        lists = [(_numbers(a[i], np.uint32).astype(np.int64), _numbers(b[i], np.uint32), _numbers(c[i], np.int64), _numbers(rest[i], float))
                 for i in range(1, segments.num_rows)]
        nothing = np.zeros(0, np.int64)
        lists = lists or [(nothing, nothing, nothing, np.zeros(len(header[0])))]
        ids, rows = wanted.column("vec_id").to_numpy(), wanted.column("row").to_numpy()
        best = _search_block(_dense(wanted.column("x"), dims), rows, header, lists, k, few)
        return pa.table([pa.array(x) for x in (rows[best.query], ids[best.query], best.row)]
                        + [pa.array(best.id, mask=best.known == 0), pa.array(best.score)], names=empty.column_names)

    met = read.groupBy("block", "chunk").cogroup(asked.groupBy("block", "chunk")).applyInArrow(run, RESULT)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, is_query, k: int = 10, chunk_rows: int = CHUNK_ROWS, few: float = FEW) -> DataFrame:
    """The k best other vectors of every row of ``integer_vectors`` for which ``is_query`` holds. Starts Spark jobs."""
    vectors = side_table(vectors, "vectors")
    rows, dims = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    tasks = 2 * vectors.sparkSession.sparkContext.defaultParallelism
    chunks = max(1, ceil(rows / min(chunk_rows, max(1, ceil(rows / tasks)))))
    index = build_index(vectors, dims, chunks)
    return search(index, vectors.where(is_query), dims, chunks, k, few)


SQL = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(1024 * CAST(c AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda c: c IS NULL OR NOT isfinite(c)))),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.x, v.x) AS BIGINT) AS score
  FROM vectors q JOIN vectors v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10"""


@register("op12_exact_top_k", SQL)
def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(integer_vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)
