"""Sizes, dates, page geometry units, colours and ratings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS_PER_INCH = 72.0
MM_PER_INCH = 25.4

# Standard sizes in points (portrait), tested in this order.
STANDARD_SIZES = {
    "Letter": (612, 792),
    "Legal": (612, 1008),
    "Tabloid": (792, 1224),
    "A0": (2384, 3370),
    "A1": (1684, 2384),
    "A2": (1191, 1684),
    "A3": (842, 1191),
    "A4": (595, 842),
    "A5": (420, 595),
    "A6": (298, 420),
    "B4": (709, 1001),
    "B5": (499, 709),
    "Executive": (522, 756),
}
SIZE_TOLERANCE = 2


def half_up(x: Column, digits: int = 0) -> Column:
    """floor(x * 10^d + 0.5) / 10^d: halves go up, also below zero."""
    f = 10**digits
    scaled = F.floor(x * F.lit(float(f)) + F.lit(0.5))
    return scaled.cast("double") / F.lit(float(f)) if digits else scaled


def format_size(size: Column, digits: int = 2, byte_unit: str = "Bytes") -> Column:
    """1536 -> '1.5 KB'; units go up to EB, the largest a long can hold."""
    k = 1024.0
    units = [(k**i, u) for i, u in ((6, "EB"), (5, "PB"), (4, "TB"), (3, "GB"), (2, "MB"), (1, "KB"))] + [(1.0, byte_unit)]

    def text(div: float, unit: str) -> Column:
        d = F.round(size / F.lit(div), digits).cast(f"decimal(24,{digits})").cast("string")
        return F.concat(F.regexp_replace(d, r"\.?0+$", ""), F.lit(f" {unit}"))

    out = F.when(size == 0, F.lit(f"0 {byte_unit}"))
    for div, unit in units:
        out = out.when(size >= div, text(div, unit))
    return out


def relative_time(ts: Column, now: Column) -> Column:
    secs = F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))
    mins = F.floor(secs / 60_000_000)
    hours = F.floor(secs / 3_600_000_000)
    days = F.floor(secs / 86_400_000_000)
    return (
        F.when(mins < 1, F.lit("Just now"))
        .when(mins < 60, F.concat(mins.cast("string"), F.lit("m ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
        .when(days < 7, F.concat(days.cast("string"), F.lit("d ago")))
        .otherwise(F.date_format(ts, "yyyy-MM-dd"))
    )


def pdf_date(s: Column) -> Column:
    """``D:YYYYMMDDHHmmSS`` as a timestamp; missing time parts are 00."""
    digits = F.regexp_extract(s, r"^D:(\d{8}\d{0,6})", 1)
    return F.when(
        digits != "", F.try_to_timestamp(F.rpad(digits, 14, "0"), F.lit("yyyyMMddHHmmss"))
    )


def orientation(w: Column, h: Column) -> Column:
    return (
        F.when(F.abs(w - h) < 1, F.lit("square"))
        .when(w > h, F.lit("landscape"))
        .otherwise(F.lit("portrait"))
    )


def standard_size(w: Column, h: Column) -> Column:
    """Name of the first standard size within tolerance, null when none fits."""
    t = SIZE_TOLERANCE
    out = None
    for name, (sw, sh) in STANDARD_SIZES.items():
        for label, a, b in ((name, sw, sh), (f"{name} (Landscape)", sh, sw)):
            cond = (F.abs(w - a) <= t) & (F.abs(h - b) <= t)
            out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out


def to_inches(pt: Column) -> Column:
    return half_up(pt / POINTS_PER_INCH, 2)


def to_mm(pt: Column) -> Column:
    return half_up(pt / POINTS_PER_INCH * MM_PER_INCH, 1)


def hex_to_rgb(s: Column) -> Column:
    """struct<r,g,b> in 0..1; anything but six hex digits is black."""
    h = F.regexp_extract(s, r"^#?([0-9A-Fa-f]{6})$", 1)

    def part(i: int) -> Column:
        v = F.conv(F.substring(h, i, 2), 16, 10).cast("double") / 255.0
        return F.when(h == "", F.lit(0.0)).otherwise(v)

    return F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b"))


def normalize_angle(a: Column) -> Column:
    return F.pmod(a, F.lit(360))


# Fixed values: (good, needs improvement) upper bounds per metric.
RATING_BOUNDS = {
    "LCP": (2500.0, 4000.0),
    "FID": (100.0, 300.0),
    "CLS": (0.1, 0.25),
    "FCP": (1800.0, 3000.0),
    "TTFB": (800.0, 1800.0),
    "INP": (200.0, 500.0),
}


def rating(metric: Column, value: Column) -> Column:
    out = None
    for m, (good, fair) in RATING_BOUNDS.items():
        r = (
            F.when(value <= good, F.lit("good"))
            .when(value <= fair, F.lit("needs-improvement"))
            .otherwise(F.lit("poor"))
        )
        out = F.when(metric == m, r) if out is None else out.when(metric == m, r)
    return out


# Digit groups of roman numbers.
ROMAN = (
    ("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"),
    ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"),
    ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"),
)


def roman(n: Column) -> Column:
    """Upper-case roman number, '' for zero and below."""

    def digit(table, v):
        return F.get(F.array(*[F.lit(t) for t in table]), F.pmod(v, F.lit(10)).cast("int"))

    text = F.concat(
        F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")),
        digit(ROMAN[0], F.floor(n / 100)),
        digit(ROMAN[1], F.floor(n / 10)),
        digit(ROMAN[2], n),
    )
    return F.when(n <= 0, F.lit("")).otherwise(text)


def letters(n: Column) -> Column:
    """A..Z, then AA, BB, ... as page labels count."""
    letter = F.char(F.lit(65) + F.pmod(n - 1, F.lit(26)))
    return F.when(n <= 0, F.lit("")).otherwise(
        F.repeat(letter, (F.floor((n - 1) / 26) + 1).cast("int"))
    )
