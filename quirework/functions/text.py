"""Text helpers: terms, similarity, words, HTML escaping, trimming."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirework.functions.arrays import let, sums_before

# Fixed value: characters whose presence makes a text item split per character.
CJK_CLASS = "[\\x{4e00}-\\x{9fa5}]"


def strip(s: Column) -> Column:
    """Trim all white space, not only blanks."""
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def squeeze(s: Column) -> Column:
    """Collapse white space to single blanks and trim."""
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def parse_terms(s: Column) -> Column:
    """Search terms typed as one string, separated by commas or line breaks."""
    parts = F.transform(F.split(s, "[,，\n]"), strip)
    return F.filter(parts, lambda t: t != "")


def text_similarity(a: Column, b: Column) -> Column:
    """Share of characters of ``b`` that occur in ``a``; not symmetric."""
    ca = F.regexp_replace(a, r"\s+", "")
    cb = F.regexp_replace(b, r"\s+", "")
    shared = F.length(cb) - F.length(F.call_function("translate", cb, ca, F.lit("")))
    return (
        F.when((ca == "") & (cb == ""), F.lit(1.0))
        .when((ca == "") | (cb == ""), F.lit(0.0))
        .otherwise(2.0 * shared / (F.length(ca) + F.length(cb)))
    )


def escape_html(s: Column) -> Column:
    # Entity for each reserved character, ampersand first.
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        s = F.replace(s, F.lit(raw), F.lit(entity))
    return s


def linkify(s: Column) -> Column:
    """Wrap bare web addresses in anchors."""
    return F.regexp_replace(s, r"""(?i)(https?://[^\s<>"]+)""", r'<a href="$1">$1</a>')


def tokenize_words(s: Column, x: Column, width: Column) -> Column:
    """array<struct<text,x,w>>: one entry per word, or per character for CJK.

    Positions follow the share of characters, blanks included.
    """
    # the width per character is bound once: inside a lambda it would be worked
    # out anew, by counting the whole text, for every word
    share = width / F.greatest(F.length(s), F.lit(1))

    def per_character(unit: Column) -> Column:
        return F.transform(
            F.filter(F.split(s, ""), lambda c: c != ""),
            lambda c, i: F.struct(c.alias("text"), (x + i * unit).alias("x"), unit.alias("w")),
        )

    # runs of blanks and runs of non-blanks alternate; offsets are running lengths
    def per_word(unit: Column) -> Column:
        def from_runs(runs: Column) -> Column:
            sizes = F.transform(runs, lambda t: F.length(t))
            placed = F.zip_with(
                F.zip_with(runs, sizes, lambda t, k: F.struct(t.alias("t"), k.alias("k"))),
                sums_before(sizes),
                lambda r, at: F.struct(
                    r["t"].alias("text"), (x + at * unit).alias("x"), (r["k"] * unit).alias("w")
                ),
            )
            return F.filter(placed, lambda p: ~p["text"].rlike(r"^\s"))

        return let(F.regexp_extract_all(s, F.lit(r"\s+|\S+"), 0), from_runs)

    return let(share, lambda u: F.when(s.rlike(CJK_CLASS), per_character(u)).otherwise(per_word(u)))


def wrap_lines(paragraph: Column, width: int) -> Column:
    """Greedy word wrap at ``width`` characters; a longer word stands alone."""
    clean = F.trim(F.regexp_replace(paragraph, " +", " "))
    return F.regexp_extract_all(clean, F.lit("(.{1,%d}|[^ ]+)(?: |$)" % width), 1)


# Protocols that make a link unsafe.
UNSAFE_PROTOCOLS = ("javascript:", "data:", "vbscript:")


def is_safe_url(url: Column) -> Column:
    u = strip(F.lower(url))
    cond = F.lit(True)
    for p in UNSAFE_PROTOCOLS:
        cond = cond & ~u.startswith(p)
    return cond
