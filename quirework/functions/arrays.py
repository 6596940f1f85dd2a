"""Array helpers that stay inside one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 128


def exploded(df: DataFrame, *keep: Column | str, array: Column, value: str, at: str | None = None) -> DataFrame:
    """A row per element of ``array``, none of which may be null, and its place if ``at`` names it.

    A plain explode filters by the array's size first and works the array out a second time for that."""
    element = F.explode_outer(array).alias(value) if at is None else F.posexplode_outer(array).alias(at, value)
    return df.select(*keep, element).where(F.col(value).isNotNull())


def let(value: Column, body) -> Column:
    """Bind ``value`` once for a body that uses it several times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(xs: Column, start: Column) -> Column:
    """start, start + x1, start + x1 + x2, ...: the sum before each element."""
    first = F.struct(start.cast("int").alias("pos"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(
        xs,
        first,
        lambda acc, x: F.struct(
            (acc["pos"] + x).alias("pos"), F.concat(acc["out"], F.array(acc["pos"])).alias("out")
        ),
        lambda acc: acc["out"],
    )


def sums_before(xs: Column) -> Column:
    """For each integer of an array the sum of those before it.

    A fold copies its output at every step, so it runs over chunks of 128 and
    over the chunk totals instead of over the whole array.
    """

    def whole(a: Column) -> Column:
        last = F.floor((F.size(a) - 1) / F.lit(CHUNK)).cast("int")
        chunks = F.transform(
            F.sequence(F.lit(0), last), lambda c: F.slice(a, c * F.lit(CHUNK) + 1, F.lit(CHUNK))
        )
        totals = lambda cs: F.transform(
            cs, lambda ch: F.aggregate(ch, F.lit(0), lambda s, x: s + x)
        )
        joined = let(
            chunks,
            lambda cs: F.flatten(
                F.zip_with(cs, _running(totals(cs), F.lit(0)), lambda ch, base: _running(ch, base))
            ),
        )
        return F.when(F.size(a) > 0, joined).otherwise(F.array().cast("array<int>"))

    return let(xs, whole)


def match_starts(pieces: Column, found: Column) -> Column:
    """Offsets of matches, from the texts between them and the matches themselves."""
    gaps = F.transform(F.slice(pieces, 1, F.size(found)), lambda p: F.length(p))
    steps = F.zip_with(gaps, found, lambda g, h: g + F.length(h))
    return F.zip_with(sums_before(steps), gaps, lambda before, g: before + g)
