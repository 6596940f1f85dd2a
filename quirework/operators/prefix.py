"""Ordered numbering and running totals that never put one key in one task.

A window partitioned by ``doc_id`` alone sends a whole document to one task,
which fails when one document holds a third of the corpus.  Here the order
column is cut into monotone blocks: rows are numbered inside (key, block), and
the short table of block totals supplies the offset.  The only wide exchange is
on (key, block); block totals are combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def page_block(col: str | Column = "page_no", size: int = BLOCK) -> Column:
    """Monotone block number of a dense position column."""
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c / F.lit(size)).cast("long")


def block_totals(
    df: DataFrame, keys: Sequence[str], blocks: Sequence[tuple[str, Column]], value: Column
) -> DataFrame:
    """(keys, block) -> _base (sum before the block) and _total (sum of the key).

    ``blocks`` are (name, expression) pairs from coarse to fine.  With more than
    one pair the table of fine blocks is itself summed block-wise.
    """
    names = [n for n, _ in blocks]
    sums = (
        df.select(*[F.col(k) for k in keys], *[e.alias(n) for n, e in blocks], value.alias("__v"))
        .groupBy(*keys, *names)
        .agg(F.sum("__v").alias("__v"))
    )
    if len(blocks) == 1:
        w = Window.partitionBy(*keys).orderBy(*names)
        return sums.select(
            *keys,
            *names,
            F.coalesce(
                F.sum("__v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ).alias("__base"),
            F.sum("__v").over(Window.partitionBy(*keys)).alias("__total"),
        )
    coarse = block_totals(sums, keys, [(n, F.col(n)) for n in names[:-1]], F.col("__v"))
    w = Window.partitionBy(*keys, *names[:-1]).orderBy(names[-1])
    return sums.join(coarse, [*keys, *names[:-1]]).select(
        *keys,
        *names,
        (
            F.col("__base")
            + F.coalesce(F.sum("__v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ).alias("__base"),
        "__total",
    )


def running(
    df: DataFrame,
    keys: Sequence[str],
    blocks: Sequence[Column],
    order: Sequence[Column | str],
    value: Column | None = None,
    before: str | None = "before",
    total: str | None = None,
) -> DataFrame:
    """Add the sum of ``value`` over earlier rows of the key, and its total.

    ``blocks`` must be a coarsening of ``order`` (coarse to fine).  Without
    ``value`` rows are counted, so ``before + 1`` is the row number.
    """
    value = F.lit(1).cast("long") if value is None else value
    pairs = [(f"__b{i}", b) for i, b in enumerate(blocks)]
    names = [n for n, _ in pairs]
    totals = block_totals(df, keys, pairs, value)
    w = (
        Window.partitionBy(*keys, *names)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = df.withColumns({n: e for n, e in pairs}).withColumn("__v", value)
    joined = joined.join(totals, [*keys, *names], "left")
    out = joined
    if before:
        out = out.withColumn(before, F.col("__base") + F.coalesce(F.sum("__v").over(w), F.lit(0)))
    if total:
        out = out.withColumn(total, F.col("__total"))
    return out.drop("__v", "__base", "__total", *names)


def number_rows(df, keys, order, number="row_no", total=None, blocks=None):
    """1-based row number inside ``keys``; blocks default to the first order column."""
    if blocks is None:
        blocks = [page_block(order[0])]
    out = running(df, keys, blocks, order, before="__n", total=total)
    return out.withColumn(number, (F.col("__n") + 1).cast("long")).drop("__n")


def with_totals(df: DataFrame, keys: Sequence[str], pos: str = "page_no", total: str = "total_pages"):
    """Attach the row count of each key, joined on (key, block): no hot key."""
    return running(df, keys, [page_block(pos)], [pos], before=None, total=total)


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    point: str,
    lo: str,
    hi: str,
    size: int = BLOCK,
) -> DataFrame:
    """points with lo <= point <= hi, as an equi-join on (keys, block of point).

    An interval is repeated once per block it touches, never once per page.
    """
    left = points.withColumn("_blk", page_block(point, size))
    right = (
        intervals.filter(F.col(hi) >= F.col(lo))
        .withColumn("_blk", F.explode(F.sequence(page_block(lo, size), page_block(hi, size))))
    )
    return (
        left.join(right, [*keys, "_blk"])
        .filter(F.col(point).between(F.col(lo), F.col(hi)))
        .drop("_blk")
    )
