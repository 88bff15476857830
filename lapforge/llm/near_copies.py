"""Near copies by Jaccard similarity, found with wide SimHash fingerprints and vantage-point trees.

A text's words (A-Z lower-cased, between ASCII white space) give its set of five-word shingles; fewer words are one shingle, none
the empty set, which is near nothing but itself. Two texts are near if their sets have a Jaccard similarity of 0.8 or more; groups
are the components of such pairs, and one row of each stays, the one of the smallest id.

The fingerprint has WORDS times 64 bits, each the majority of one bit of the shingles' hashes. At similarity 0.8 some 15 of 100 bits
differ, too many for one tree of 64 bits, but of the 15 disjoint parts of 21 or 22 bits one nearly always has a distance of at most
RADIUS. So there is a vantage-point tree for each part, as in ``simhash``: its top is grown on a bounded sample, every fingerprint
goes to its home shard and to the shards beyond a boundary that it can have partners in. What meets in a leaf within the part's
radius and within WIDE bits in all is a candidate. A leaf hands on a spanning forest of its candidates, nearest bands first, so a
group of n near copies gives about n candidates, not n squared; each is then compared by its texts' shingles, which decides.
The share of pairs found is measured by ``tests/llm/near_recall.py``.

Null text counts as empty. Null ids are passed over by "smallest id". Of repeated rows, and of texts of equal fingerprint (such
as equal texts), exactly one stays. Very long texts are read whole. An empty table gives an empty table. All columns are kept,
whatever their names. Starts Spark jobs when called; each intermediate table is written to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapforge.llm import vp_trees
from lapforge.llm.common import bounded_sample, chunks, drop_side_table, mixed, salted_join, side_table, slices, texts_of, with_text_columns
from lapforge.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
#: 64-bit words of a fingerprint, distance within a part, and over the whole fingerprint.
WORDS = 5
RADIUS = 1
WIDE = 64
#: Upper ends of the bands of distance in which a leaf builds its forests.
BANDS = (16, 28, 36, 40, 44, 48, 52, 56, 60, WIDE)
#: Fingerprints that the tops of the trees are grown on, to a shard, and that a task compares at once.
SAMPLE = 1 << 16
SHARD = 1 << 13
PIECE = 1 << 14
#: Candidates of a text beyond which its candidates are spread over tasks.
HOT = 1000


def shingle_hashes(text: bytes) -> np.ndarray:
    """The sorted distinct XXH64 hashes of a text's shingles."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(sizes)
    k = min(SHINGLE, len(parts))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b]) for a, b in zip((ends - sizes).tolist(), (ends[k - 1:] - 1).tolist())]
    return np.unique(np.array(hashes, np.uint64))


def wide_fingerprint(text: bytes) -> bytes:
    """WORDS little-endian 64-bit words; of tied bits every second one is set."""
    hashes = shingle_hashes(text)
    counts = np.zeros((WORDS, 64), np.int64)
    for i in range(0, len(hashes), 8192):
        part = hashes[i:i + 8192]
        for w in range(WORDS):
            seeded = mixed(part + np.uint64((w + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
            counts[w] += np.unpackbits(seeded.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    tied = np.arange(64) % 2
    return np.packbits(2 * counts + tied > len(hashes), axis=1).tobytes() if len(hashes) else bytes(8 * WORDS)


def _words(column: pa.Array) -> np.ndarray:
    """Fingerprints of a binary column as an array of WORDS numbers to a row."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, WORDS)


def forest(x: np.ndarray, word: int, mask: np.uint64, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs (i, j) of the distinct fingerprints ``x`` that connect, band by band, all that are within it.

    A pair is left out only if pairs of its own band or nearer ones connect it already. Memory is a block of rows times
    the leaf; pairs are not kept.
    """
    labels = np.tile(np.arange(len(x)), (len(BANDS), 1))
    found = []

    def take(i: np.ndarray, j: np.ndarray, d: np.ndarray) -> None:
        band = np.searchsorted(BANDS, d)
        for b in range(len(BANDS)):
            own = band == b
            left, right = i[own], j[own]
            while True:
                p, q = labels[b][left], labels[b][right]
                left, right, p, q = (v[p != q] for v in (left, right, p, q))
                if not len(left):
                    break
                # Each component takes its first pair; a pair's number breaks ties, so there are no rings.
                first = np.full(len(x), len(left))
                np.minimum.at(first, p, np.arange(len(left)))
                np.minimum.at(first, q, np.arange(len(left)))
                chosen = np.unique(first[first < len(left)])
                found.append(np.stack([left[chosen], right[chosen]]))
                for level in range(b, len(BANDS)):
                    labels[level] = _merged(labels[level], left[chosen], right[chosen])

    todo, part = [np.arange(len(x))], x[:, word]
    while todo:
        rows = todo.pop()
        values = part[rows]
        cut = vp_trees.choose(values, mask, radius) if len(rows) > vp_trees.BLOCK else None
        if cut is not None:
            d = vp_trees.distance(values, cut[0], mask).astype(np.int64)
            todo += [rows[d <= cut[1]], rows[d > cut[1] - radius]]
            continue
        masked = values & mask
        for start in range(0, len(rows), 128):
            i, j = np.nonzero(np.bitwise_count(masked[start:start + 128, None] ^ masked[None, start:]) <= radius)
            i, j = rows[start + i[j > i]], rows[start + j[j > i]]
            d = np.zeros(len(i), np.int64)
            for w in range(WORDS):
                d += np.bitwise_count(x[i, w] ^ x[j, w])
            if (d <= WIDE).any():
                take(i[d <= WIDE], j[d <= WIDE], d[d <= WIDE])
    return tuple(np.concatenate(found, axis=1)) if found else (np.zeros(0, int), np.zeros(0, int))


def _merged(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Component labels after joining i with j; a label is the first position of its component."""
    label = label.copy()
    while True:
        p, q = label[i], label[j]
        if (p == q).all():
            return label
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def candidates(classes: DataFrame, sample_rows: int = SAMPLE, shard_rows: int = SHARD, piece_rows: int = PIECE) -> DataFrame:
    """Distinct pairs (a, b), a < b, of the ``seq`` of rows (seq, fp) with distinct ``fp`` that may be near."""
    spark = classes.sparkSession
    total = classes.count()
    sample = _words(bounded_sample(classes.select("fp"), ["fp"], sample_rows, total).toArrow().column("fp").combine_chunks())
    leaf = max(16, int(shard_rows * len(sample) / max(total, 1)))
    parts = [(w, mask) for w in range(WORDS) for mask in vp_trees.PARTS]
    trees = spark.sparkContext.broadcast([vp_trees.grow(sample[:, w], mask, RADIUS, leaf) for w, mask in parts])
    firsts = np.cumsum([0] + [t.leaves for t in trees.value])

    def deal(batches):
        for batch in batches:
            x = _words(batch.column(0))
            for (w, _), first, tree in zip(parts, firsts, trees.value):
                leaves, where = vp_trees.shards(tree, x[:, w])
                at = pa.array(where)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((leaves + first).astype(np.int32)), batch.column(0).take(at), batch.column(1).take(at)],
                    names=["shard", "fp", "seq"])

    def search(batches):
        for key, rows in _pieces(batches):
            x, seq = _words(rows.column("fp").combine_chunks()), rows.column("seq").to_numpy()
            _, once = np.unique(seq, return_index=True)
            x, seq = x[once], seq[once]
            i, j = forest(x, *parts[int(np.searchsorted(firsts, key >> 40, side="right")) - 1])
            a, b = seq[i], seq[j]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    dealt = classes.select("fp", "seq").mapInArrow(deal, "shard int, fp binary, seq long")
    # At most one row for each leaf of the trees.
    sizes = side_table(dealt.groupBy("shard").agg(F.ceil(F.count("*") / piece_rows).cast("int").alias("blocks")), "near-sizes")
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("long")
    pieces = dealt.join(F.broadcast(sizes), "shard").select(
        "shard", "fp", "seq", block.alias("i"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("j"))
    piece = F.shiftleft(F.col("shard").cast("long"), 40).bitwiseOR(F.shiftleft(F.least("i", "j"), 20)).bitwiseOR(F.greatest("i", "j"))
    tasks = max(1, spark.sparkContext.defaultParallelism * 4)
    return pieces.select(piece.alias("piece"), "fp", "seq").repartition(tasks, "piece").sortWithinPartitions("piece").mapInArrow(
        search, "a long, b long").distinct()


def _pieces(batches):
    """(piece, its rows) for each run of equal ``piece`` in sorted batches."""
    key, held = None, []
    for batch in batches:
        keys = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for start, stop in zip(edges, edges[1:]):
            if start == stop:
                continue
            if held and keys[start] != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = int(keys[start])
            held.append(batch.slice(start, stop - start))
    if held:
        yield key, pa.Table.from_batches(held)


def similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) whose ``texts`` (seq, text) have a similarity of SIMILARITY or more."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("seq")).groupBy("seq").agg((F.count("*") > HOT).alias("hot"))
    needed = side_table(ends, "near-ends")
    # A written table: Catalyst broadcasts it if it is small, by its size on disk, and joins by a shuffle if not.
    held = side_table(texts.join(needed, "seq").select("seq", "hot", "text"), "near-texts")
    for end in ("a", "b"):
        marked = pairs.join(needed.withColumnRenamed("seq", end), end)
        side = held.select(F.col("seq").alias(end), "hot", F.col("text").alias(f"text_{end}"))
        pairs = salted_join(marked, side, [end], hot="hot").drop("hot")

    def check(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            left, right = texts_of(batch, "text_a"), texts_of(batch, "text_b")
            near = np.zeros(len(left), bool)
            for start, stop in chunks([x + y for x, y in zip(left, right)]):
                for k in range(start, stop):
                    x, y = shingle_hashes(left[k]), shingle_hashes(right[k])
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    near[k] = shared >= SIMILARITY * (len(x) + len(y) - shared) and shared > 0
            yield batch.select(["a", "b"]).filter(pa.array(near))

    near = side_table(pairs.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long"), "near-links")
    drop_side_table(held)
    return near


def drop_near_copies(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``df`` but for those in a group with another that stays."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{key}`").alias("id"))
    tagged = side_table(
        with_text_columns(rows, ("row", text), "fp binary", lambda: lambda texts: [pa.array([wide_fingerprint(t) for t in texts], pa.binary())])
        .withColumn("seq", F.monotonically_increasing_id()), "near-tagged")
    stay = F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "seq")).alias("stay")
    classes = side_table(tagged.groupBy("fp").agg(stay).select("fp", "stay", F.col("stay.seq").alias("seq")), "near-classes")
    pairs = side_table(candidates(classes.select("seq", "fp")), "near-pairs")
    texts = tagged.select("seq", F.col("row").getField(text).alias("text"))
    roots = side_table(components(similar(pairs, texts)), "near-roots")
    stays = classes.join(roots, classes["seq"] == roots["node"], "left").groupBy(F.coalesce("root", "seq")).agg(
        F.min("stay").alias("stay")).select(F.col("stay.seq").alias("seq"))
    gone = side_table(tagged.select("seq").join(stays, "seq", "left_anti"), "near-gone")
    return tagged.join(gone, "seq", "left_anti").select(*[F.col("row").getField(c).alias(c) for c in df.columns])
