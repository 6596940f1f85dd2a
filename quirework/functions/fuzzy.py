"""Graded text match: equal, contained, shared words, letters in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirework.functions.text import strip


def letters_in_order(q: Column, t: Column) -> Column:
    """How many leading letters of ``q`` occur in ``t`` in this order."""
    return F.aggregate(
        F.split(t, ""),
        F.lit(0),
        lambda k, c: F.when((c != "") & (c == F.substring(q, k + 1, F.lit(1))), k + 1).otherwise(k),
    )


def fuzzy_score(query: Column, text: Column) -> Column:
    q = strip(F.lower(query))
    t = F.lower(text)
    lq, lt = F.length(q), F.length(t)
    pos = F.position(q, t) - 1
    q_words = F.split(q, r"\s+")
    t_words = F.split(t, r"\s+")
    hits = F.size(
        F.filter(
            q_words, lambda a: F.exists(t_words, lambda b: b.contains(a) | a.contains(b))
        )
    )
    run = letters_in_order(q, t)
    return (
        F.when(q == "", F.lit(0.0))
        .when(t == q, F.lit(1.0))
        .when(t.contains(q), 0.7 + 0.2 * (lq / lt) + 0.1 * (1 - pos / lt))
        .when(hits > 0, 0.4 + 0.3 * (hits / F.size(q_words)))
        .when(run == lq, 0.3 + 0.2 * (run / lt))
        .when(run > lq * 0.5, 0.1 + 0.2 * (run / lq))
        .otherwise(F.lit(0.0))
    )
