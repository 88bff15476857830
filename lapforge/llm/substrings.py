"""Substring dedup with prefix-partitioned suffix trees over words.

A window of LENGTH words is repeated if the suffix that begins there shares its first LENGTH words with another suffix:
both then lie below an internal node of that depth in the suffix tree of all texts. The tree is never built as a whole:

1. Of a window's word groups of PREFIX words, the one with the least hash is its anchor. Windows of one text with the same
   anchor form a region. Equal windows have equal anchors at equal places, so it is enough to compare regions that share an
   anchor: the suffixes are partitioned by this prefix. Only the anchors and the hashes of whole regions are shuffled, and
   they are counted with a combine in the map tasks.
2. Prefixes that occur once are leaves and fall away. Regions that occur more than once as a whole are repeats, as all
   their windows are; they leave one of them behind for comparison. So only regions of which there is one are open.
3. The words of the regions left under a prefix go to one task, which builds the tree of their suffixes top down and reads
   off the internal nodes of depth LENGTH. Where more than ``group`` different regions share a prefix, it is lengthened to
   the whole window: those suffixes are counted by a 128-bit hash of the window and never meet in a task.

Texts without open regions are finished when the flags reach them; the others are kept until the trees are done.

Words are compared as they are in the trees. Regions are counted by the hash of their anchor and 64 bits of a BLAKE2 digest
of their words, windows by 128 bits of their words, and rows are named by 96 bits of their text and columns. Hashes of words
only choose anchors; words of equal hash share an anchor and are then told apart.

Null text has no words. Shorter texts than a window lose nothing. Windows repeated in the same text count, overlapping
ones too, and so do repeated rows: both copies lose what they share. Extra columns are kept, those named like a new one
replaced.
"""

from __future__ import annotations

from hashlib import blake2b, sha256
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lapforge.llm.common import ASCII_SPACE, chunks, drop_side_table, salted_join, side_table, span_hashes, table, texts_of, word_bounds
from lapforge.llm.registry import register
from lapforge.session import written_table

PREFIX = 8
GROUP = 4096
_PREFIX_BASE = 0xD1342543DE82EF95
_INDEX = np.uint64((1 << 28) - 1)


def regions(texts: list[bytes], length: int, prefix: int = PREFIX) -> tuple[np.ndarray, ...]:
    """Text number, first and last window start, hash of the anchor and digest of the whole region's words, for every region.

    The digest is taken from the words themselves, not from their hashes: two regions are one only if their words are.
    """
    prefix = min(prefix, length)
    texts = [b" ".join(t.split()) for t in texts]
    buf = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    starts, ends = word_bounds(buf, ASCII_SPACE)
    n = len(starts) - length + 1
    if n < 1:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    offsets = np.cumsum([1] + [len(t) + 1 for t in texts])[:-1]
    first_word = np.searchsorted(starts, offsets)
    text_of = np.searchsorted(offsets, starts, side="right") - 1
    words = span_hashes(buf, starts, ends)
    at = np.arange(len(words) - prefix + 1)
    grams = span_hashes(words, at, at + prefix, _PREFIX_BASE)
    # The least hash of a window's grams, the first of ties: hash bits above, place below; minima of doubling width.
    least, width, want = (grams & ~_INDEX) | at.astype(np.uint64), 1, length - prefix + 1
    while 2 * width <= want:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    rest = want - width
    least = np.minimum(least[:len(least) - rest], least[rest:]) if rest else least
    begin = np.flatnonzero(text_of[:n] == text_of[length - 1:])
    if not len(begin):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    anchor = (least[begin] & _INDEX).astype(np.int64)
    turn = np.flatnonzero(np.diff(anchor)) + 1
    first, last = begin[np.concatenate([[0], turn])], begin[np.concatenate([turn - 1, [len(begin) - 1]])]
    text = text_of[first]
    data, spans = buf.tobytes(), zip(starts[first].tolist(), ends[last + length - 1].tolist())
    whole = np.frombuffer(b"".join(blake2b(data[a:b], digest_size=8).digest() for a, b in spans), np.int64)
    anchors = grams[anchor[np.concatenate([[0], turn])]]
    return text, first - first_word[text], last - first_word[text], anchors.view(np.int64), whole


def repeated_suffixes(suffixes: list[tuple[list[bytes], int]], depth: int) -> list[int]:
    """Numbers of the suffixes below internal nodes of at least ``depth`` words, from a suffix tree built top down."""
    deep, todo = [], [(list(range(len(suffixes))), 0)]
    while todo:
        node, at = todo.pop()
        if len(node) == 2:
            (u, i), (v, j) = suffixes[node[0]], suffixes[node[1]]
            if u[i + at:i + depth] == v[j + at:j + depth]:
                deep += node
        elif at == depth:
            deep += node
        else:
            children: dict[bytes, list[int]] = {}
            for x in node:
                words, i = suffixes[x]
                children.setdefault(words[i + at], []).append(x)
            todo += [(child, at + 1) for child in children.values() if len(child) > 1]
    return deep


def kept_words(words: list[bytes], spans, length: int) -> list[bytes]:
    """The words outside all windows that start in one of the spans (first, last)."""
    gone = bytearray(len(words))
    for a, b in spans:
        gone[a:b + length] = b"\1" * (b + length - a)
    return list(compress(words, (not x for x in gone))) if any(gone) else words


def _window_keys(words: list[bytes], count: int, length: int) -> list[tuple[int, int]]:
    out = []
    for s in range(count):
        digest = xxhash.xxh3_128_digest(b" ".join(words[s:s + length]))
        out.append(tuple(np.frombuffer(digest, np.int64).tolist()))
    return out


def without_repeats(df: DataFrame, text: str = "text", length: int = 35, group: int = GROUP, with_text: bool = True) -> DataFrame:
    """``df`` with its text cut down to the words that stay, and ``n_words``, ``n_removed`` and ``kept_sha256``.

    ``length`` is the window in words, ``group`` the number of regions of one prefix that a task may hold. Without
    ``with_text`` the text is left out.
    """
    new = StructType.fromDDL("n_words long, n_removed long, kept_sha256 string")
    kept = [c for c in df.columns if c not in (text, *new.fieldNames())]
    rows = df.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(text).alias("text"))
    rows = rows.select("row", "text", F.xxhash64("row", "text").alias("k"), F.hash("text", "row").alias("l"))

    def anchors(batches):
        for batch in batches:
            texts = texts_of(batch, "text")
            k, l_ = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, j in chunks(texts):
                text_no, a, b, q, r = regions(texts[i:j], length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k[text_no + i]), pa.array(l_[text_no + i]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)),
                     pa.array(q), pa.array(r)], names=["k", "l", "a", "b", "q", "r"])

    found = side_table(rows.select("k", "l", "text").mapInArrow(anchors, "k long, l int, a int, b int, q long, r long"), "anchors")
    # Most prefixes occur once; a count of the prefixes alone finds those whose regions go on.
    shared = side_table(found.groupBy("q").agg(F.count("*").alias("n")).where("n > 1").select("q"), "shared-prefixes")
    everything, found = found, side_table(salted_join(found, shared, ["q"], spread=4), "shared-anchors")
    drop_side_table(everything)
    kinds = found.groupBy("q", "r").agg(F.count("*").alias("n"), F.min(F.struct("k", "l", "a", "b")).alias("one"))
    kinds = side_table(kinds, "regions")
    prefixes = kinds.groupBy("q").agg(F.count("*").alias("kinds"), F.min("n").alias("fewest"))
    flagged = side_table(salted_join(kinds, prefixes, ["q"]), "flagged-regions")
    repeats = salted_join(found, flagged.where("n > 1").select("q", "r"), ["q", "r"]).select("k", "l", "a", "b")
    compared = flagged.where("kinds > 1 AND fewest = 1").select(
        "one.*", "q", F.when(F.col("n") == 1, 1).otherwise(2).alias("what"), (F.col("kinds") > group).alias("heavy"))
    flags = repeats.select("k", "l", F.struct(F.lit(0).alias("what"), "a", "b", F.lit(0).cast("long").alias("q"), F.lit(False).alias("heavy")).alias("flag"))
    flags = flags.unionByName(compared.select("k", "l", F.struct("what", "a", "b", "q", "heavy").alias("flag")))
    flags = flags.groupBy("k", "l").agg(F.collect_set("flag").alias("flags"))

    joined = rows.join(flags, ["k", "l"], "left").select("row", "k", "l", "text", F.col("flags.what").alias("what"), F.col("flags.a").alias("a"),
                                                         F.col("flags.b").alias("b"), F.col("flags.q").alias("q"), F.col("flags.heavy").alias("heavy"))
    row_type = rows.schema["row"].dataType
    sorted_out = StructType.fromDDL("k long, l int, words binary, spans array<int>, n_words long, n_removed long, kept binary, sha string, "
                                    "q long, p long, a int, b int, open boolean, kind string").add("row", row_type)
    names = sorted_out.fieldNames()

    def outcome(stay):
        joined = b" ".join(stay)
        return {"kept": joined if with_text else None, "sha": sha256(joined).hexdigest()}

    def sort_out(batches):
        """done: a finished text; text: one to finish later; region: words to compare; suffix: a window by its hash."""
        for batch in batches:
            texts = texts_of(batch, "text")
            for i, j in chunks(texts):
                part = batch.slice(i, j - i)
                what, a, b, q, heavy = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("what", "a", "b", "q", "heavy"))
                k, l_ = (part.column(part.schema.get_field_index(c)).to_pylist() for c in "kl")
                out, origin = {c: [] for c in names if c != "row"}, []

                def put(at, **values):
                    origin.append(at)
                    for c in out:
                        out[c].append(values.get(c))

                for at, data in enumerate(texts[i:j]):
                    words, flag = data.split(), list(zip(what[at] or (), a[at] or (), b[at] or (), q[at] or (), heavy[at] or ()))
                    spans = [(x, y) for w, x, y, _, _ in flag if w == 0]
                    for w, x, y, prefix, many in flag:
                        if w and many:
                            keys = _window_keys(words[x:y + length], y - x + 1, length)
                            for s, (h, p) in enumerate(keys):
                                put(at, k=k[at], l=l_[at], q=h, p=p, a=x + s, b=x + s, open=w == 1, kind="suffix")
                        elif w:
                            put(at, k=k[at], l=l_[at], q=prefix, a=x, b=y, open=w == 1, words=b" ".join(words[x:y + length]), kind="region")
                    if any(w == 1 for w, *_ in flag):
                        put(at, k=k[at], l=l_[at], words=data, spans=[z for s in spans for z in s], kind="text")
                    else:
                        stay = kept_words(words, spans, length)
                        put(at, k=k[at], l=l_[at], n_words=len(words), n_removed=len(words) - len(stay), kind="done", **outcome(stay))
                columns = [pa.array(out[f.name], _arrow(f.dataType)) for f in sorted_out if f.name != "row"]
                column = part.column(part.schema.get_field_index("row"))
                nothing = pa.nulls(1, column.type)
                source = pa.concat_arrays([column, nothing])
                finished = np.array([o if w in ("done", "text") else len(column) for o, w in zip(origin, out["kind"])], np.int64)
                yield pa.RecordBatch.from_arrays([*columns, source.take(pa.array(finished))], names=[*[c for c in names if c != "row"], "row"])

    order = StructType([sorted_out[c] for c in names if c != "row"] + [sorted_out["row"]])
    state = written_table(joined.mapInArrow(sort_out, order), "llm-substrings", ["kind"])

    def trees(batches):
        for group_rows in _groups(batches):
            suffixes, origin, parts = [], [], [w.split(b" ") for w in group_rows["words"]]
            for no, words in enumerate(parts):
                for s in range(len(words) - length + 1):
                    suffixes.append((words, s))
                    origin.append((no, s))
            hits = sorted(origin[x] for x in repeated_suffixes(suffixes, length))
            hits = [(no, s) for no, s in hits if group_rows["open"][no]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([group_rows[c][no] for no, _ in hits], kind) for c, kind in (("k", pa.int64()), ("l", pa.int32()))]
                + [pa.array([group_rows["a"][no] + s for no, s in hits], pa.int32())], names=["k", "l", "a"])

    regions_left = state.where("kind = 'region'").select("q", "k", "l", "a", "open", "words")
    parts = max(1, regions_left.sparkSession.sparkContext.defaultParallelism * 4)
    from_trees = regions_left.repartition(parts, "q").sortWithinPartitions("q").mapInArrow(trees, "k long, l int, a int")
    suffixes = state.where("kind = 'suffix'").select("q", "p", "k", "l", "a", "open")
    twice = suffixes.groupBy("q", "p").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    from_counts = salted_join(suffixes.where("open"), twice, ["q", "p"]).select("k", "l", "a")
    late = from_trees.unionByName(from_counts).groupBy("k", "l").agg(F.collect_set("a").alias("late"))
    waiting = state.where("kind = 'text'").select("row", "words", "spans", "k", "l").join(late, ["k", "l"], "left").select("row", "words", "spans", "late")
    end = StructType([rows.schema["row"]]).add("n_words", "long").add("n_removed", "long").add("kept", "binary").add("sha", "string")

    def finish(batches):
        for batch in batches:
            texts = texts_of(batch, "words")
            for i, j in chunks(texts):
                part = batch.slice(i, j - i)
                n, removed, out = [], [], {"kept": [], "sha": []}
                for data, spans, late_starts in zip(texts[i:j], part.column(2).to_pylist(), part.column(3).to_pylist()):
                    words = data.split()
                    stay = kept_words(words, [*zip(spans[::2], spans[1::2]), *((s, s) for s in late_starts or ())], length)
                    n.append(len(words))
                    removed.append(len(words) - len(stay))
                    for c, value in outcome(stay).items():
                        out[c].append(value)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(out["kept"], pa.binary()),
                     pa.array(out["sha"])], names=end.fieldNames())

    done = state.where("kind = 'done'").select("row", "n_words", "n_removed", "kept", "sha").unionByName(waiting.mapInArrow(finish, end))
    columns = [F.col("row").getField(c).alias(c) for c in kept] + ([F.col("kept").cast("string").alias(text)] if with_text else [])
    return done.select(*columns, "n_words", "n_removed", F.col("sha").alias("kept_sha256"))


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _groups(batches):
    """Columns as lists for each run of equal ``q`` in sorted batches."""
    held = None
    for batch in batches:
        data = batch.to_pydict()
        q = data["q"]
        start = 0
        for stop in range(1, len(q) + 1):
            if stop == len(q) or q[stop] != q[start]:
                piece = {c: v[start:stop] for c, v in data.items()}
                if held and held["q"][0] == q[start]:
                    held = {c: held[c] + piece[c] for c in held}
                else:
                    if held:
                        yield held
                    held = piece
                start = stop
    if held:
        yield held


@register("op9_substring_dedup")
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
