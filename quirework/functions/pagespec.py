"""Page-selection strings such as ``1-3,5,8-`` as arrays of intervals.

A specification becomes ``array<struct<lo,hi,parity>>``; testing a page against
it is a Column predicate, so a selection never needs one row per page number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EVERY_PAGE = 9_223_372_036_854_775_807


@dataclass(frozen=True)
class Dialect:
    blank_means_all: bool
    keywords: tuple[str, ...]  # subset of all / odd / even
    swap_reversed: bool


# How each caller of a page specification reads it.
DIALECTS = {
    "split": Dialect(False, (), False),
    "extract": Dialect(False, (), False),
    "tables": Dialect(True, (), False),
    "overlay": Dialect(True, ("odd", "even"), True),
    "labels": Dialect(True, ("odd", "even"), True),
    "header": Dialect(True, ("all",), False),
}


def leading_int(s: Column) -> Column:
    """Leading digits of a string as a number, null when there are none."""
    return F.regexp_extract(s, r"^\s*([+-]?\d+)", 1).try_cast("long")


def _interval(lo: Column, hi: Column, parity: int = -1) -> Column:
    return F.struct(lo.alias("lo"), hi.alias("hi"), F.lit(parity).alias("parity"))


def spec_ranges(spec: Column, dialect: str = "extract") -> Column:
    """Intervals of a specification in written order (repeats kept)."""
    d = DIALECTS[dialect]
    text = F.lower(F.trim(F.coalesce(spec, F.lit(""))))
    tokens = F.filter(F.transform(F.split(text, ","), lambda t: F.trim(t)), lambda t: t != "")

    def one(tok: Column) -> Column:
        dashed = F.split(tok, "-")
        a = leading_int(F.get(dashed, F.lit(0)))
        b = F.when(tok.contains("-"), leading_int(F.get(dashed, F.lit(1)))).otherwise(a)
        if d.swap_reversed:
            return _interval(F.least(a, b), F.greatest(a, b))
        return _interval(a, b)

    # a missing bound makes the token void; least/greatest skip nulls, so test both
    def valid(tok: Column) -> Column:
        dashed = F.split(tok, "-")
        a = leading_int(F.get(dashed, F.lit(0)))
        b = leading_int(F.get(dashed, F.lit(1)))
        return a.isNotNull() & (~tok.contains("-") | b.isNotNull())

    ranges = F.transform(F.filter(tokens, valid), one)
    every = F.lit(EVERY_PAGE)
    rules: list[tuple[Column, Column]] = []
    if d.blank_means_all:
        rules.append((text == "", F.array(_interval(F.lit(1).cast("long"), every))))
    for word in d.keywords:
        parity = {"all": -1, "odd": 1, "even": 0}[word]
        rules.append((text == word, F.array(_interval(F.lit(1).cast("long"), every, parity))))
    if not rules:
        return ranges
    cond, val = rules[0]
    out = F.when(cond, val)
    for cond, val in rules[1:]:
        out = out.when(cond, val)
    return out.otherwise(ranges)


def covers(ranges: Column, page: Column) -> Column:
    """True where ``page`` lies in one of the intervals."""
    return F.exists(
        ranges,
        lambda r: page.between(r["lo"], r["hi"])
        & ((r["parity"] < 0) | (F.pmod(page, F.lit(2)) == r["parity"])),
    )


def clamp_ranges(ranges: Column, total: Column) -> Column:
    """Cut intervals to 1..total and drop the empty ones."""
    cut = F.transform(
        ranges,
        lambda r: F.struct(
            F.greatest(r["lo"], F.lit(1).cast("long")).alias("lo"),
            F.least(r["hi"], total.cast("long")).alias("hi"),
            r["parity"].alias("parity"),
        ),
    )
    return F.filter(cut, lambda r: r["hi"] >= r["lo"])


def literal_ranges(spec: str, dialect: str = "extract") -> list[tuple[int, int, int]]:
    """The same reading for an option string given by the caller."""
    import re

    d = DIALECTS[dialect]
    text = (spec or "").strip().lower()
    if text == "" and d.blank_means_all:
        return [(1, EVERY_PAGE, -1)]
    if text in d.keywords:
        return [(1, EVERY_PAGE, {"all": -1, "odd": 1, "even": 0}[text])]
    out = []
    for tok in (t.strip() for t in text.split(",")):
        nums = [re.match(r"\s*([+-]?\d+)", p) for p in tok.split("-")[:2]]
        if not tok or any(m is None for m in nums):
            continue
        lo, hi = int(nums[0].group(1)), int(nums[-1].group(1))
        if d.swap_reversed:
            lo, hi = min(lo, hi), max(lo, hi)
        out.append((lo, hi, -1))
    return out


def literal_covers(spec: str, page: Column, dialect: str = "extract") -> Column:
    """Plain comparison predicate for an option string: reaches the file scan."""
    cond = F.lit(False)
    for lo, hi, parity in literal_ranges(spec, dialect):
        if hi < lo:
            continue
        one = (page >= max(lo, 1)) if hi == EVERY_PAGE else page.between(max(lo, 1), hi)
        if parity >= 0:
            one = one & (page % 2 == parity)
        cond = cond | one
    return cond
