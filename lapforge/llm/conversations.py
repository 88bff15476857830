"""Audit and repair of the structure of conversations.

A sound conversation is empty, or an optional system row and then pairs of user and assistant rows. The audit finds the
cheapest edits that make every conversation sound (``audit_paths`` has the costs and the search), the least string of edit
initials among equals, and counts what is wrong before.

Rows are taken by turn, nulls first; rows of equal turn by role, the first 64 characters of the text and the SHA-256 of the
text. Equal rows of one conversation are counted, not repeated, until the edits are applied, so many copies of a row are one
row in the shuffle. Only what the search needs of a row is shuffled for it (its kind and a digest), not the text.

One conversation may hold a large share of all rows: rows are dealt out by ranges of conversation, turn and tie, so that a
range has about ``RANGE_ROWS`` rows whatever the conversations are, and each range searches its part of a conversation from
every state in which that may begin. The parts are then joined in order, with the edits of one conversation (a byte a row,
as in the result) in memory. Texts meet their edits once, in a stream that holds a row at a time; the SHA-256 of a whole
repaired conversation can only be computed in order, so this stream stays in one task for each conversation.

Null conversation ids form one conversation, returned with a null id. Null roles and texts count as one space. A row with an
empty role has no initial, fits nowhere and must get a role or go. Texts of any length are read whole. Repeated rows are
duplicates (two equal blank rows are blank). An empty table gives no rows, a conversation without rows left gives zeros, no
edits and the digest of an empty text. Other columns of the table are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapforge.llm import audit_paths
from lapforge.llm.common import salted_join, side_table, table
from lapforge.llm.registry import register

RANGE_ROWS = 10_000
HEAD_CHARS = 64
BLANKS = " \t\n\x0b\x0c\r"
LEGAL_PAIRS = frozenset(("su", "ua", "au"))
ORDER = ("t", "r", "head", "digest")


def plain_rows(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The four columns under names of this module; ``n`` copies of a row (0: lost, but its conversation is reported)."""
    col = lambda c: F.col(f"`{c}`")
    return df.select(
        F.coalesce(F.concat(F.lit("="), col(conv).cast("string")), F.lit("")).alias("c"), col(conv).alias("id"),
        col(turn).cast("bigint").alias("t"), F.coalesce(col(role), F.lit(" ")).alias("r"),
        F.coalesce(col(text), F.lit(" ")).alias("text"), F.lit(1).cast("bigint").alias("n"))


def damaged(rows: DataFrame) -> DataFrame:
    """Damage by a hash of conversation and turn: rows lost, emptied, without final marks, repeated, or of role user."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("id"), F.lit(":"), name("t"))) % 20
    return rows.withColumn("_kind", kind).select(
        "c", "id", "t", F.when(F.col("_kind") == 4, F.lit("user")).otherwise(F.col("r")).alias("r"),
        F.when(F.col("_kind") == 1, F.lit("")).when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("_kind") == 0, 0).when(F.col("_kind") == 3, 2).otherwise(1).cast("bigint").alias("n"))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"head": F.substring("text", 1, HEAD_CHARS), "digest": F.unhex(F.sha2("text", 256))})


def _kind(blank: Column, seen: Column, truncated: Column) -> Column:
    initial = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise(F.lit("x"))
    return F.when(blank, F.lit("b")).when(seen, F.lit("d")).otherwise(F.when(truncated, F.upper(initial)).otherwise(initial))


def _row_kinds(rows: DataFrame) -> DataFrame:
    """One row for equal rows of a conversation: its order, role initial, number of copies and kind of the first copy."""
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    narrow = _keyed(rows).withColumns({"blank": end == "", "truncated": ~F.substring(end, -1, 1).isin(".", "!", "?")})
    narrow = side_table(narrow.groupBy("c", "id", *ORDER).agg(
        F.sum("n").alias("n"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated")), "turn-kinds")
    again = narrow.where("n > 0").groupBy("c", "r", "digest").agg(
        F.count("*").alias("times"), F.max(F.col("t").isNull()).alias("untimed"), F.min("t").alias("least")).where("times > 1").drop("times")
    met = salted_join(narrow, again, ["c", "r", "digest"], "left")
    seen = F.col("untimed").isNotNull() & F.col("t").isNotNull() & (F.col("untimed") | (F.col("t") > F.col("least")))
    return met.withColumn("initial", F.substring("r", 1, 1)).select(
        "c", "id", *ORDER, "n", "initial", _kind(F.col("blank"), F.coalesce(seen, F.lit(False)), F.col("truncated")).alias("kind"))


class _Run:
    """What a range knows of its part of one conversation."""

    def __init__(self, part: int, first_in_part: bool, c: str, key):
        self.part, self.open, self.c, self.key = part, first_in_part, c, key
        self.kinds: list[str] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = self.first_initial = self.last_initial = None

    def add(self, turn: int | None, initial: str, kind: str, n: int) -> None:
        if not n:
            return
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        if self.last_initial is None:
            self.first_initial = initial
        elif self.last_initial + initial not in LEGAL_PAIRS:
            self.illegal += 1
        self.illegal += n - 1
        self.last_initial = initial
        if kind == "b":
            self.blank += n
            self.kinds.append("d" * n)
            return
        gone = n if kind == "d" else n - 1
        self.duplicate += gone
        self.truncated += kind.isupper()
        self.kinds.append("" if kind == "d" else kind)
        self.kinds.append("d" * gone)

    def row(self) -> tuple:
        kinds = "".join(self.kinds)
        found = []
        for entry in audit_paths.STATES if self.open else (audit_paths.START,):
            for state, path in enumerate(audit_paths.paths(kinds, entry)):
                if path is not None:
                    found.append({"entry": entry, "state": state, "cost": path[0], "edits": path[1]})
        return (self.c, self.key, self.part, self.first_turn, self.last_turn, self.turns, self.first_initial, self.last_initial,
                self.blank, self.duplicate, self.truncated, self.illegal, found)


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 2_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _in_arrow(df: DataFrame, rows_of, schema: T.StructType) -> DataFrame:
    """``rows_of`` maps an iterator of row tuples to one of row tuples, a partition at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        each = (row for b in batches for row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True))
        yield from _batches(rows_of(each), arrow)

    return df.mapInArrow(run, schema)


def _segments(kinds: DataFrame) -> DataFrame:
    """Each range's part of each conversation, with the cheapest edits between the states at its ends."""
    parts = max(1, ceil(kinds.count() / RANGE_ROWS))
    ranged = kinds.repartitionByRange(parts, "c", *ORDER).sortWithinPartitions("c", *ORDER).select(
        F.spark_partition_id().alias("part"), "c", "id", "t", "initial", "kind", "n")
    path = T.StructType.fromDDL("entry int, state int, cost bigint, edits string")
    schema = T.StructType([
        T.StructField("c", T.StringType()), T.StructField("id", kinds.schema["id"].dataType), T.StructField("part", T.IntegerType()),
        *T.StructType.fromDDL("first_turn bigint, last_turn bigint, turns bigint, first_initial string, last_initial string, "
                              "blank bigint, duplicate bigint, truncated bigint, illegal bigint"),
        T.StructField("paths", T.ArrayType(path))])

    def rows_of(rows):
        run = None
        for part, c, key, turn, initial, kind, n in rows:
            if run is None or run.c != c or run.part != part:
                if run is not None:
                    yield run.row()
                run = _Run(part, run is None or run.part != part, c, key)
            run.add(turn, initial, kind, n)
        if run is not None:
            yield run.row()

    return side_table(_in_arrow(ranged, rows_of, schema), "turn-segments")


def audit_conversations(rows: DataFrame) -> DataFrame:
    """Per conversation: c, id, gaps, blank, duplicate, truncated, illegal, cost and audit. Starts Spark jobs; a written table.

    ``rows`` are those of ``plain_rows``.
    """
    kinds = side_table(_row_kinds(rows), "turn-order")
    segments = _segments(kinds)
    schema = T.StructType([
        T.StructField("c", T.StringType()), kinds.schema["id"],
        *T.StructType.fromDDL("gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string")])

    def folded(c, parts):
        cells = [(0, None), None, None, None]
        key = low = high = initial = None
        turns = 0
        counts = [0, 0, 0, 0]
        for _, key, _, first_turn, last_turn, distinct, first, last, *found, table_ in parts:  # noqa: B007
            tables: list = [None] * 4
            for p in table_:
                tables[p["entry"]] = tables[p["entry"]] or [None] * 4
                tables[p["entry"]][p["state"]] = (p["cost"], p["edits"])
            cells = audit_paths.follow(cells, tables)
            counts = [a + b for a, b in zip(counts, found, strict=True)]
            if first_turn is not None:
                turns += distinct - (first_turn == high)
                low, high = first_turn if low is None else low, last_turn
            if first is not None:
                counts[3] += initial is not None and initial + first not in LEGAL_PAIRS
                initial = last
        cost, audit = audit_paths.best(cells)
        return (c, key, 0 if low is None else high - low + 1 - turns, *counts, cost, audit)

    def rows_of(parts):
        from itertools import groupby

        for c, group in groupby(parts, key=lambda p: p[0]):
            yield folded(c, group)

    ordered = segments.repartition("c").sortWithinPartitions("c", "part")
    return side_table(_in_arrow(ordered, rows_of, schema), "turn-audits")


def repaired_turns(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The conversations after their edits: c, position, edit (K, R or I), role, text; in order within a conversation."""
    wide = _keyed(rows.where("n > 0")).select("c", F.lit(1).alias("after"), *ORDER, "text", "n")
    edits = audits.where("audit <> ''").select(
        "c", F.lit(0).alias("after"), F.lit(None).cast("bigint").alias("t"), F.lit(None).cast("string").alias("r"),
        F.lit(None).cast("string").alias("head"), F.lit(None).cast("binary").alias("digest"), F.col("audit").alias("text"),
        F.lit(0).cast("bigint").alias("n"))
    stream = wide.unionByName(edits).repartition("c").sortWithinPartitions("c", "after", *ORDER).select("c", "after", "r", "text", "n")
    schema = T.StructType.fromDDL("c string, position bigint, edit string, role string, text string")

    def rows_of(items):
        audit, at, position, state, conv = "", 0, 0, audit_paths.START, None

        def made(edit, role, text):
            nonlocal position, state
            if edit == "K":
                state = next(to for initial, to in audit_paths.FOLLOWS[state] if initial == role[:1])
            else:
                state = audit_paths.FORCED[state]
                role = "user" if state == audit_paths.USER else "assistant"
            position += 1
            return conv, position, edit, role, text

        def inserts():
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                at += 1
                yield made("I", "", "")

        for c, after, role, text, n in items:
            if not after:
                yield from inserts()
                audit, at, position, state, conv = text, 0, 0, audit_paths.START, c
                continue
            for _ in range(n):
                yield from inserts()
                edit = audit[at]
                at += 1
                if edit != "D":
                    yield made(edit, role, text)
        yield from inserts()

    return _in_arrow(stream, rows_of, schema)


def digests(turns: DataFrame) -> DataFrame:
    """(c, sha256) of each conversation's ``role:text`` lines, from rows in order as ``repaired_turns`` leaves them."""
    def rows_of(rows):
        conv, state = None, None
        for c, _, _, role, text in rows:
            if c != conv:
                if state is not None:
                    yield conv, state.hexdigest()
                conv, state = c, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(f"{role}:{text}".encode())
        if state is not None:
            yield conv, state.hexdigest()

    return _in_arrow(turns, rows_of, T.StructType.fromDDL("c string, sha256 string"))


def audit_report(rows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row per conversation of ``rows``: what is wrong, the edits, and the digest of the repaired conversation.

    ``rows`` are computed twice, for the search and for the repair, and must come out the same.
    """
    audits = audit_conversations(rows)
    found = digests(repaired_turns(rows, audits))
    empty = hashlib.sha256().hexdigest()
    return audits.join(found, "c", "left").select(
        F.col("id").alias(conv), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.coalesce("sha256", F.lit(empty)).alias("repaired_sha256"))


@register("op13_conversation_repair")
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_report(damaged(plain_rows(table(spark, sf_dir, "conversations"))))
