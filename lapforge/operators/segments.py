"""Ordered windows that survive a hot group.

``Window.partitionBy(keys)`` puts a whole group into one task. Here a group with more than ``rows`` rows is cut
into segments along its leading order column, and every window runs over ``keys + segment``. What a segment has
to know about the rows before (or after) it arrives as a few extra rows that ride along in the same shuffle:

* up to ``depth`` copies of the rows just before the segment, for lag and short rolling frames;
* one carry row with the number of earlier rows, running sums, last / next values and group maxima.

Groups within the bound stay whole in segment 0 and add no extra rows. Which groups are hot is found out first,
by one narrow aggregate over the keys. When there are none, the plan is the plain window over one shuffle. Otherwise the
list of cuts (see :func:`lapforge.session.listed`) is broadcast after a check of its size, so the rows of a hot group are
spread before they are shuffled for the first time. A bound of fewer than PIECE_ROWS rows makes too many cuts for a list: then
the rows of a group are numbered, piece by piece, and written with their positions, and a segment is every ``rows`` positions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lapforge.session import listed, written_table

SEGMENT_ROWS = 4_000_000
SAMPLES = 64
#: Segments of fewer rows are made of positions, in pieces of this size.
PIECE_ROWS = 4_000_000

SEG, EXTRA, BEFORE = "_seg", "_extra", "_before"
_WITHIN_BEFORE, _WITHIN_TOTAL = "_within_before", "_within_total"


@dataclass(frozen=True)
class Segments:
    """``frame`` plus the window specifications that are valid on it."""

    frame: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    within: str | None
    helper: tuple[str, ...]

    def whole(self, *more: str) -> WindowSpec:
        return Window.partitionBy(*self.keys, SEG, *more)

    def ordered(self, *more: str) -> WindowSpec:
        return self.whole(*more).orderBy(*self.order)

    def previous(self, far: int, near: int = 1) -> WindowSpec:
        return self.ordered().rowsBetween(-far, -near)

    def running(self, *more: str) -> WindowSpec:
        return self.ordered(*more).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def backwards(self) -> WindowSpec:
        """From the last row up to this one, in reverse: a running frame, where "all following rows" would be quadratic."""
        reverse = self.whole().orderBy(*[F.col(c).desc() for c in self.order])
        return reverse.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def _from_carry(self, column: str, spec: WindowSpec) -> Column:
        return F.max(column).over(spec) if column in self.helper else F.lit(None)

    def carried(self, name: str) -> Column:
        return self._from_carry(f"_c_{name}", self.whole())

    def position(self) -> Column:
        """1-based position of the row in its whole group."""
        local = F.sum(F.when(F.col(EXTRA), 0).otherwise(1)).over(self.running())
        return local + F.coalesce(self._from_carry(BEFORE, self.whole()), F.lit(0))

    def position_within(self) -> Column:
        local = F.sum(F.when(F.col(EXTRA), 0).otherwise(1)).over(self.running(self.within))
        return local + F.coalesce(self._from_carry(_WITHIN_BEFORE, self.whole(self.within)), F.lit(0))

    def size_within(self) -> Column:
        local = F.sum(F.when(F.col(EXTRA), 0).otherwise(1)).over(self.whole(self.within))
        return F.coalesce(self._from_carry(_WITHIN_TOTAL, self.whole(self.within)), local)

    def keyed(self, value: Column) -> Column:
        """NULL where a group key is missing: such rows belong to no group."""
        return F.when(F.expr(" and ".join(f"`{k}` is not null" for k in self.keys)), value)

    def close(self, df: DataFrame) -> DataFrame:
        return df.where(~F.col(EXTRA)).drop(*self.helper)


def _order_key(columns: Sequence[str], order: Sequence[str]) -> Column:
    """What rows are cut by: all order columns, then a hash of the row for rows that tie in them. NULL comes first."""
    tie = F.xxhash64(*[F.col(c) for c in columns])
    return F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], tie.alias("tie"))


def _segment(key: Column) -> Column:
    """Number of cuts at or below the row's key; ``_cuts`` holds them in runs, so that two short scans find it."""
    run = F.size(F.filter("_cuts", lambda part: F.get(part, F.lit(0)) <= key)) - 1
    inside = F.size(F.filter(F.get(F.col("_cuts"), run), lambda cut: cut <= key))
    return F.when(run < 0, 0).otherwise(run * F.col("_run") + inside)


def _hot_groups(df: DataFrame, keys: list[str], rows: int) -> DataFrame | None:
    """Groups with more than ``rows`` rows, and their sizes (``_seg_rows``); None if there are none."""
    return listed(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_seg_rows")).where(F.col("_seg_rows") > rows))


def _cut_list(df: DataFrame, hot: DataFrame, keys: list[str], order: list[str], rows: int) -> DataFrame | None:
    """Where to cut the groups in ``hot`` into segments of about ``rows`` rows; None if the sample is empty.

    The cuts of a group are evenly spaced members of a sample of its order keys, about ``SAMPLES`` to a segment, drawn by
    a hash of the row. So neither outliers nor clusters nor ties make a segment much larger than ``rows``. Over all
    groups there are at most ``all rows / rows`` cuts.
    """
    key = _order_key(df.columns, order)
    drawn = F.pmod(F.xxhash64(F.lit(17), *[F.col(c) for c in df.columns]), F.lit(rows)) < SAMPLES
    sample = df.where(drawn).join(hot, keys).select(*keys, "_seg_rows", key.alias("_key"))
    group = Window.partitionBy(*keys)
    at = (F.row_number().over(group.orderBy("_key")) - 1) * F.ceil(F.col("_seg_rows") / rows)
    slot = F.floor(at / F.count(F.lit(1)).over(group))
    first = F.coalesce(slot > F.lag("_slot").over(group.orderBy("_key")), F.lit(False))
    cuts = (
        sample.withColumn("_slot", slot).withColumn("_first", first).where("_first")
        .groupBy(*keys).agg(F.array_sort(F.collect_set("_key")).alias("_all"))
        .withColumn("_run", F.ceil(F.sqrt(F.size("_all"))).cast("int"))
    )
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("_all") - 1) / F.col("_run")).cast("int")),
                       lambda i: F.slice("_all", i * F.col("_run") + 1, F.col("_run")))
    return listed(cuts.select(*keys, "_run", runs.alias("_cuts")))


def _numbered(
    df: DataFrame, census: DataFrame, hot: DataFrame, keys: list[str], order: list[str], by: list[str], rows: int
) -> DataFrame:
    """``df`` with its SEG and, in the groups in ``hot``, ``_seg_rows`` and the position ``_seg_at`` from 0; written once.

    Segments of few rows are too many for a list of cuts. So groups are cut into pieces that a task can order, a piece's rows
    are numbered, and a segment is every ``rows`` positions.
    """
    large = listed(hot.where(F.col("_seg_rows") > PIECE_ROWS))
    cuts = _cut_list(census, large, keys, order, PIECE_ROWS) if large is not None else None
    marked, piece = df.join(hot, keys, "left"), F.lit(0)
    if cuts is not None:
        marked = marked.join(cuts, keys, "left")
        piece = F.coalesce(_segment(_order_key(by, order)), F.lit(0))
    tie = F.xxhash64(*[F.col(c) for c in by])
    marked = marked.select(*df.columns, "_seg_rows", piece.cast("bigint").alias("_seg_piece"), tie.alias("_seg_tie"))
    here = Window.partitionBy(*keys, "_seg_piece").orderBy(*order, "_seg_tie")
    at = F.when(F.col("_seg_rows").isNotNull(), F.row_number().over(here).cast("bigint") - 1)
    placed = written_table(marked.withColumn("_seg_at", at).drop("_seg_tie"), "positions")
    if cuts is not None:
        sizes = placed.join(large.select(*keys), keys).groupBy(*keys, "_seg_piece").agg(F.count(F.lit(1)).alias("_n"))
        earlier = Window.partitionBy(*keys).orderBy("_seg_piece").rowsBetween(Window.unboundedPreceding, -1)
        starts = listed(sizes.select(*keys, "_seg_piece", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")))
        placed = placed.join(starts, [*keys, "_seg_piece"], "left").withColumn("_seg_at", F.col("_seg_at") + F.coalesce("_start", F.lit(0)))
    seg = F.coalesce(F.floor(F.col("_seg_at") / rows), F.lit(0)).cast("bigint").alias(SEG)
    return placed.select(*df.columns, "_seg_rows", "_seg_at", seg)


def open_segments(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    rows: int = SEGMENT_ROWS,
    depth: int = 0,
    marks: Mapping[str, Column] | None = None,
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    nexts: Mapping[str, Column] | None = None,
    maxima: Sequence[str] = (),
    within: str | None = None,
    census: DataFrame | None = None,
) -> Segments:
    """Cut hot groups of ``df`` into segments of about ``rows`` rows along ``order``. Starts Spark jobs for that.

    ``marks``  name -> condition: position of the last earlier row where it holds;
    ``sums``   name -> value: sum over the earlier rows;
    ``lasts``  / ``nexts`` name -> value: nearest non-null value before / after the segment;
    ``maxima`` columns whose window maximum must be that of the whole group;
    ``within`` a sub-group column for :meth:`Segments.position_within` / :meth:`Segments.size_within`;
    ``census`` where to count group sizes instead of ``df``: a cheaper table that holds at least its rows.
    """
    marks, sums, lasts, nexts = dict(marks or {}), dict(sums or {}), dict(lasts or {}), dict(nexts or {})
    keys, order = list(keys), list(order)
    columns = df.columns

    source = df if census is None else census
    exact = rows < PIECE_ROWS
    hot = _hot_groups(source, keys, rows)
    cuts = _cut_list(source, hot, keys, order, rows) if hot is not None and not exact else None
    if hot is None or (cuts is None and not exact):
        frame = df.withColumns({SEG: F.lit(0).cast("bigint"), EXTRA: F.lit(False)})
        return Segments(frame, tuple(keys), tuple(order), within, (SEG, EXTRA))
    by = df.columns if census is None else [c for c in census.columns if c in columns]
    if exact:
        cut = _numbered(df, source, hot, keys, order, by, rows)
        big = cut.drop("_seg_rows").join(hot, keys)
    else:
        seg = F.coalesce(_segment(_order_key(by, order)), F.lit(0)).cast("bigint").alias(SEG)
        cut = df.join(cuts, keys, "left").select(*columns, seg)
        big = df.join(cuts, keys, "inner").select(*columns, seg)

    carry_types = {BEFORE: "bigint"}
    if within:
        carry_types |= {_WITHIN_BEFORE: "bigint", _WITHIN_TOTAL: "bigint"}
    per_segment = [F.count(F.lit(1)).alias("_n")]
    per_segment += [F.max(F.when(c, F.col("_local"))).alias(f"_m_{n}") for n, c in marks.items()]
    per_segment += [F.sum(c).alias(f"_s_{n}") for n, c in sums.items()]
    rank = F.struct(*[F.col(c) for c in order])
    per_segment += [F.max_by(c, F.when(c.isNotNull(), rank)).alias(f"_l_{n}") for n, c in lasts.items()]
    per_segment += [F.min_by(c, F.when(c.isNotNull(), rank)).alias(f"_f_{n}") for n, c in nexts.items()]
    per_segment += [F.max(c).alias(f"_x_{c}") for c in maxima]

    here = Window.partitionBy(*keys, SEG).orderBy(*order)
    local = F.col("_seg_at") - F.col(SEG) * rows + 1 if exact else F.row_number().over(here)
    numbered = big.withColumn("_local", local) if marks else big
    earlier = Window.partitionBy(*keys).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.col(SEG).desc()).rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*keys)
    summary = (
        numbered.groupBy(*keys, SEG).agg(*per_segment)
        .withColumn(BEFORE, F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    )
    for name in marks:
        reached = F.col(BEFORE) + F.col(f"_m_{name}")
        summary = summary.withColumn(f"_c_{name}", F.last(reached, ignorenulls=True).over(earlier))
    for name in sums:
        summary = summary.withColumn(f"_c_{name}", F.sum(f"_s_{name}").over(earlier))
    for name in lasts:
        summary = summary.withColumn(f"_c_{name}", F.last(f"_l_{name}", ignorenulls=True).over(earlier))
    for name in nexts:
        summary = summary.withColumn(f"_c_{name}", F.last(f"_f_{name}", ignorenulls=True).over(later))
    for column in maxima:
        summary = summary.withColumn(f"_x_{column}", F.max(f"_x_{column}").over(group))
    named = [*marks, *sums, *lasts, *nexts]
    types = dict(summary.select(*[f"_c_{n}" for n in named]).dtypes) if named else {}
    carry_types |= {f"_c_{n}": types[f"_c_{n}"] for n in named}

    source_types = dict(df.dtypes)

    def padded(source: DataFrame, given: Mapping[str, Column]) -> DataFrame:
        everything = {**source_types, SEG: "bigint", EXTRA: "boolean", **carry_types}
        return source.select(*[
            given.get(c, F.lit(None)).cast(t).alias(c) for c, t in everything.items()
        ])

    key_cols = {k: F.col(k) for k in keys}
    extras = [padded(summary, {
        **key_cols, SEG: F.col(SEG), EXTRA: F.lit(True), BEFORE: F.col(BEFORE),
        **{f"_c_{n}": F.col(f"_c_{n}") for n in named},
        **{c: F.col(f"_x_{c}") for c in maxima},
    })]
    if within:
        sub = Window.partitionBy(*keys, within)
        by_sub = big.groupBy(*keys, SEG, within).agg(F.count(F.lit(1)).alias("_n"))
        before = F.sum("_n").over(sub.orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1))
        extras.append(padded(
            by_sub.select("*", F.coalesce(before, F.lit(0)).alias("_b"), F.sum("_n").over(sub).alias("_t")),
            {**key_cols, within: F.col(within), SEG: F.col(SEG), EXTRA: F.lit(True),
             _WITHIN_BEFORE: F.col("_b"), _WITHIN_TOTAL: F.col("_t")},
        ))
    if depth and exact:
        # A row rides along into the segments that begin within ``depth`` positions after it.
        upto = F.least(F.floor((F.col("_seg_at") + depth) / rows), F.floor((F.col("_seg_rows") - 1) / rows))
        tails = big.withColumn("_upto", upto).where(F.col("_upto") > F.col(SEG)).select(
            *columns, F.explode(F.sequence(F.col(SEG) + 1, F.col("_upto"))).alias("_next"))
        extras.append(padded(tails, {
            **{c: F.col(c) for c in columns}, SEG: F.col("_next"), EXTRA: F.lit(True),
        }))
    elif depth:
        back = Window.partitionBy(*keys, SEG).orderBy(*[F.col(c).desc() for c in order])
        along = Window.partitionBy(*keys).orderBy(SEG, *order)
        tails = (
            big.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= depth)
            .withColumn("_tail", F.collect_list(F.struct(*columns)).over(along.rowsBetween(1 - depth, 0)))
            .withColumn("_next", F.lead(SEG).over(along))
            .where((F.col("_back") == 1) & F.col("_next").isNotNull())
            .select("_next", F.explode("_tail").alias("_row"))
        )
        extras.append(padded(tails, {
            **{c: F.col(f"_row.{c}") for c in columns}, SEG: F.col("_next"), EXTRA: F.lit(True),
        }))

    frame = padded(cut, {**{c: F.col(c) for c in columns}, SEG: F.col(SEG), EXTRA: F.lit(False)})
    for rows_added in extras:
        frame = frame.unionByName(rows_added)
    return Segments(frame, tuple(keys), tuple(order), within, (SEG, EXTRA, *carry_types))


def group_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], output: str, *, rows: int = SEGMENT_ROWS
) -> DataFrame:
    """1-based position of every row in its group, in ``order``."""
    s = open_segments(df, keys, order, rows=rows)
    return s.close(s.frame.withColumn(output, s.position()))


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, output: str,
    *, rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Running total of ``value`` along ``order``; missing values add nothing."""
    s = open_segments(df, keys, order, rows=rows, sums={"total": value})
    local = F.sum(F.when(~F.col(EXTRA), value)).over(s.running())
    total = F.when(local.isNotNull() | s.carried("total").isNotNull(),
                   F.coalesce(local, F.lit(0)) + F.coalesce(s.carried("total"), F.lit(0)))
    return s.close(s.frame.withColumn(output, total))
