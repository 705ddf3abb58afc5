"""Ordered-sequence building blocks that never put a whole key into one task.

A session (one court, one sensor) may hold a large share of all rows, so no window here is
partitioned by the session alone. Rows are laid out in fixed-width *blocks* of the order column:

* ``spread`` copies the rows near a block border into the neighbour block, so any window whose
  reach is bounded in units of the order column is exact inside ``(keys, block)``.
* ``running`` computes prefix sums / maxima over the whole key in two levels: inside the block,
  plus a carry taken from one summary row per block.
* ``row_index`` gives the dense position of a row, after which a reach in *rows* is a reach in
  the order column and ``spread`` applies again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK = 65536
BLK = "_blk"
OWN = "_own"

Build = Callable[[DataFrame, WindowSpec], DataFrame]


def block_of(order: str, block: int | None = None) -> Column:
    block = block or BLOCK
    return F.floor(F.col(order) / F.lit(block)).cast("long")


def spread(df: DataFrame, order: str, before: int, after: int, block: int | None = None) -> DataFrame:
    """Add ``_blk`` and ``_own``; rows within reach of a block border appear in both blocks.

    ``before``/``after`` say how far back/ahead a row may look, in units of the order column.
    """
    block = block or BLOCK
    o = F.col(order)
    lo = F.floor((o - F.lit(after)) / F.lit(block)).cast("long")
    hi = F.floor((o + F.lit(before)) / F.lit(block)).cast("long")
    out = df.withColumn(BLK, F.explode(F.sequence(lo, hi)))
    return out.withColumn(OWN, F.col(BLK) == block_of(order, block))


def windowed(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    build: Build,
    before: int = 1,
    after: int = 1,
    block: int | None = None,
    keep_block: bool = False,
) -> DataFrame:
    """Run ``build(df, window)`` on blocks with borders, then keep each row once."""
    t = spread(df, order, before, after, block)
    w = Window.partitionBy(*keys, BLK).orderBy(order)
    out = build(t, w).where(F.col(OWN)).drop(OWN)
    return out if keep_block else out.drop(BLK)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    block: int | None = None,
) -> DataFrame:
    """Inclusive running sums and maxima of expressions along the whole key.

    Only one summary row per block crosses blocks, so the prefix over the summaries stays small.
    """
    sums, maxes = sums or {}, maxes or {}
    base = df if BLK in df.columns else df.withColumn(BLK, block_of(order, block))
    part = [*keys, BLK]
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    aggs = [F.sum(c).alias(f"_c_{n}") for n, c in sums.items()]
    aggs += [F.max(c).alias(f"_c_{n}") for n, c in maxes.items()]
    prev = Window.partitionBy(*keys).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    carry = base.groupBy(*part).agg(*aggs)
    carry = carry.select(
        *part,
        *[F.sum(f"_c_{n}").over(prev).alias(f"_c_{n}") for n in sums],
        *[F.max(f"_c_{n}").over(prev).alias(f"_c_{n}") for n in maxes],
    )
    inner = base.withColumns(
        {f"_r_{n}": F.sum(c).over(w) for n, c in sums.items()}
        | {f"_r_{n}": F.max(c).over(w) for n, c in maxes.items()}
    )
    out = inner.join(carry, part, "left").withColumns(
        {n: F.col(f"_r_{n}") + F.coalesce(F.col(f"_c_{n}"), F.lit(0)) for n in sums}
        | {n: F.greatest(F.col(f"_r_{n}"), F.col(f"_c_{n}")) for n in maxes}
    )
    drop = [f"_{k}_{n}" for k in "rc" for n in [*sums, *maxes]]
    return out.drop(BLK, *drop)


def neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    prev: dict[str, tuple[Column | None, Column]] | None = None,
    next: dict[str, tuple[Column | None, Column]] | None = None,
    block: int | None = None,
) -> DataFrame:
    """Value at the nearest earlier / later row where a condition holds, however far it is.

    ``{name: (condition, value)}``; the condition None means any row. The current row is excluded.
    """
    prev, next = prev or {}, next or {}
    base = df.withColumn(BLK, block_of(order, block))
    part = [*keys, BLK]
    w = Window.partitionBy(*part).orderBy(order)
    # "following" runs as "preceding" in descending order: that frame only ever grows
    before = (Window.unboundedPreceding, -1)
    wp = w.rowsBetween(*before)
    wn = Window.partitionBy(*part).orderBy(F.desc(order)).rowsBetween(*before)
    bp = Window.partitionBy(*keys).orderBy(BLK).rowsBetween(*before)
    bn = Window.partitionBy(*keys).orderBy(F.desc(BLK)).rowsBetween(*before)

    def tagged(cond: Column | None, value: Column) -> Column:
        s = F.struct(F.col(order).alias("o"), value.alias("v"))
        return s if cond is None else F.when(cond, s)

    cols = [(n, F.max, wp, bp, F.greatest, tagged(*cv)) for n, cv in prev.items()]
    cols += [(n, F.min, wn, bn, F.least, tagged(*cv)) for n, cv in next.items()]
    carry = base.groupBy(*part).agg(*[fn(c).alias(f"_c_{n}") for n, fn, _, _, _, c in cols])
    carry = carry.select(*part, *[fn(f"_c_{n}").over(bw).alias(f"_c_{n}") for n, fn, _, bw, _, _ in cols])
    inner = base.withColumns({f"_r_{n}": fn(c).over(rw) for n, fn, rw, _, _, c in cols})
    out = inner.join(carry, part, "left").withColumns(
        {n: F.coalesce(F.col(f"_r_{n}"), F.col(f"_c_{n}"))["v"] for n, *_ in cols})
    return out.drop(BLK, *[f"_{k}_{n}" for k in "rc" for n, *_ in cols])


def row_index(df: DataFrame, keys: Sequence[str], order: str, name: str = "idx", block: int | None = None) -> DataFrame:
    """Dense 0-based position of each row along its key."""
    return running(df, keys, order, sums={name: F.lit(1).cast("long")}, block=block).withColumn(
        name, F.col(name) - 1
    )


def gap_break(order: str, w: WindowSpec, gap: float) -> Column:
    """True on the first row after a gap wider than ``gap`` (and on the first row of all)."""
    prev = F.lag(order).over(w)
    return prev.isNull() | (F.col(order) - prev > F.lit(gap))


def local_segments(t: DataFrame, w: WindowSpec, order: str, gap: float, name: str = "_seg") -> DataFrame:
    """Segment start as seen inside a bordered block: enough for any look of bounded reach."""
    return t.withColumn("_brk", gap_break(order, w, gap)).withColumn(
        name, F.max(F.when(F.col("_brk"), F.col(order))).over(w)
    ).drop("_brk")


def segments(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    gap: int,
    name: str = "seg",
    brk: Callable[[WindowSpec], Column] | None = None,
    block: int | None = None,
) -> DataFrame:
    """Gaps-and-islands: ``name`` = order value of the first row of the island.

    ``brk`` may add break rules about the previous row; any previous row further back than
    ``gap`` is a break already, so a border of ``gap`` is exact.
    """

    def build(t: DataFrame, w: WindowSpec) -> DataFrame:
        cond = gap_break(order, w, gap)
        return t.withColumn("_brk", cond | F.coalesce(brk(w), F.lit(False)) if brk else cond)

    flagged = windowed(df, keys, order, build, before=gap + 1, after=0, block=block, keep_block=True)
    out = running(flagged, keys, order, maxes={name: F.when(F.col("_brk"), F.col(order))}, block=block)
    return out.drop("_brk")


def upper_median(values: Column) -> Column:
    """Element at position n div 2 of the sorted non-null values (null when there are none)."""
    s = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    return F.try_element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int"))
