"""Two versions of a document: page pairing, word differences, moved text."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions.arrays import exploded, let
from quirework.functions.text import strip
from quirework.operators.align import align, likeness, with_letters
from quirework.operators.prefix import block_totals, page_block
from quirework.session import materialise

# Page match, same page, moved text, short segment, header band.
PAGE_MATCH, PAGE_SAME, MOVED_MATCH, MOVED_MIN, EDGE_BAND = 0.25, 0.999, 0.85, 5, 0.12
# Same line and adjoining box (points) when joining highlights.
SAME_LINE, ADJOINING = 5.0, 15.0


LETTERS = ("n", "chars", "counts")


def _from_end(pages: DataFrame, side: str) -> DataFrame:
    """Letters of a version's pages, numbered from the last page."""
    # the join asks this of one side only; asked of both, their texts are spread once
    pages = pages.where("doc_id IS NOT NULL")
    block = page_block("page_no")
    totals = block_totals(pages, ["doc_id"], [("_block", block)], F.lit(1).cast("long")).withColumnRenamed("__total", "_n")
    letters = with_letters(pages.select("doc_id", "page_no", "text"), "text").withColumn("_block", block)
    return letters.join(totals, ["doc_id", "_block"], "left").select(
        F.col("doc_id").alias("pair_id"),
        (F.col("_n") - F.col("page_no")).alias("k"),
        F.col("page_no").alias(f"page_{side}"),
        *[F.col(c).alias(f"{c}_{side}") for c in LETTERS],
    )


def pair_pages(a: DataFrame, b: DataFrame, keep_text: bool = False) -> DataFrame:
    """(pair_id, pair_no, page_a, page_b, similarity); an unmatched side is null.

    ``pair_no`` rises in reading order: 0 is the last pair, the one before is -1.

    The alignment is walked from the last pages: while page N-k of one version
    resembles page M-k of the other (>= 0.25) they pair up, whatever the rest
    looks like.  That diagonal is one equi-join on (pair_id, k), written once to
    the shared folder because three readers follow (each reads few columns).
    Likeness counts letters only, so those and not the texts are moved and written.
    Only pairs with a break in it need the full recurrence, and only for the
    pages before the break (``align``, in blocks of pages).  ``keep_text`` adds
    text_a and text_b, which meet their pairs at the end.
    """
    joined = _from_end(a, "a").join(_from_end(b, "b"), ["pair_id", "k"], "full")
    joined = joined.withColumn("similarity", likeness(*[F.col(c) for c in ("n_a", "chars_a", "n_b", "chars_b", "counts_b")]))
    diag = materialise(joined, "page-pairs")
    breaks = (
        diag.filter(F.col("similarity") < PAGE_MATCH)
        .groupBy("pair_id")
        .agg(F.min("k").alias("_break"))
    )
    marked = diag.join(breaks, "pair_id", "left")
    out = ["pair_id", "pair_no", "page_a", "page_b", "similarity"]
    settled = (
        marked.filter(F.col("_break").isNull() | (F.col("k") < F.col("_break")))
        .withColumn("pair_no", -F.col("k"))
        .select(*out)
    )
    rest = diag.join(breaks, "pair_id").filter(F.col("k") >= F.col("_break"))
    pairs = settled.unionByName(align(_pages_of(rest), PAGE_MATCH).select(*out))
    if keep_text:
        for s, pages in (("a", a), ("b", b)):
            texts = pages.select(F.col("doc_id").alias("pair_id"), F.col("page_no").alias(f"page_{s}"), F.col("text").alias(f"text_{s}"))
            pairs = pairs.join(texts, ["pair_id", f"page_{s}"], "left")
        pairs = pairs.select(*out, "text_a", "text_b")
    return pairs


#: Bytes of a text up to which all its pages get their pairs in one row.
WHOLE = 1 << 20


def pair_texts(pairs: DataFrame, docs: DataFrame, pages_a: Callable[[Column], Column], pages_b: Callable[[Column], Column]) -> DataFrame:
    """Adds text_a and text_b to pairs of pages; ``docs`` (doc_id, text) holds the texts that both versions are made of, as arrays
    of page texts, by ``pages_a`` and ``pages_b``.

    A text is moved once, to the pairs of its pages, and not page by page for each version.  The pages of longer texts
    are moved one by one, so that they spread.
    """
    out = pairs.columns
    docs = docs.select(F.col("doc_id").alias("pair_id"), "text")
    long = docs.where(F.octet_length("text") > WHOLE)
    listed = pairs.groupBy("pair_id").agg(F.collect_list(F.struct(*[c for c in out if c != "pair_id"])).alias("pairs"))
    met = listed.join(docs.where(F.octet_length("text") <= WHOLE), "pair_id")

    def with_pages(of: Column) -> Column:
        def text(p: Column, s: str) -> Column:
            return F.get(of[s], (p[f"page_{s}"] - 1).cast("int")).alias(f"text_{s}")

        return F.transform("pairs", lambda p: F.struct(p.alias("p"), text(p, "a"), text(p, "b")))

    texts = F.struct(pages_a(F.col("text")).alias("a"), pages_b(F.col("text")).alias("b"))
    whole = exploded(met, "pair_id", array=let(texts, with_pages), value="x").select("pair_id", "x.p.*", "x.text_a", "x.text_b")
    apart = pairs.join(long.select("pair_id"), "pair_id", "left_semi")
    for s, pages in (("a", pages_a), ("b", pages_b)):
        each = exploded(long, "pair_id", array=pages(F.col("text")), value=f"text_{s}", at="_i")
        each = each.select("pair_id", (F.col("_i") + 1).cast("long").alias(f"page_{s}"), f"text_{s}")
        apart = apart.join(each, ["pair_id", f"page_{s}"], "left")
    return whole.select(*out, "text_a", "text_b").unionByName(apart.select(*out, "text_a", "text_b"))


def _pages_of(rest: DataFrame) -> DataFrame:
    """Letters of the pages of both sides; a page without text counts as empty."""
    none = F.array().cast("array<int>")
    sides = F.array(*[
        F.struct(
            F.lit(s).alias("side"), F.col(f"page_{s}").alias("page_no"), F.coalesce(f"n_{s}", F.lit(0)).alias("n"),
            F.coalesce(f"chars_{s}", none).alias("chars"), F.coalesce(f"counts_{s}", none).alias("counts"),
        )
        for s in ("a", "b")
    ])
    return rest.select("pair_id", "_break", F.explode(sides).alias("s")).select("pair_id", "_break", "s.*").filter("page_no IS NOT NULL")


def page_pair_summary(pairs: DataFrame) -> DataFrame:
    """Difference flag and percentage of each page pair."""
    s = F.coalesce(F.col("similarity"), F.lit(0.0))
    return pairs.withColumns(
        {"has_difference": s < PAGE_SAME, "diff_percent": (F.lit(1.0) - s) * 100}
    )


def lcs_ops(a: list, b: list) -> list[tuple[int, int]]:
    """Word alignment as (index in a, index in b), -1 on the missing side.

    Rows of the table are bit vectors held in Python integers (one bit per word
    of ``b``), about n * m / 64 machine steps; rows are kept every ``stride``
    and rebuilt on the way back, so memory grows with sqrt(n) * m.  On equal
    scores the word of ``b`` counts as added.
    """
    n, m = len(a), len(b)
    ops = []
    # the way back starts along equal words, which need no scores
    while n > 0 and m > 0 and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
        ops.append((n, m))
    masks: dict = {}
    for j, w in enumerate(b[:m]):
        masks[w] = masks.get(w, 0) | (1 << j)
    full = (1 << m) - 1

    def advance(v: int, w) -> int:
        match = v & masks.get(w, 0)
        return ((v + match) | (v - match)) & full

    stride = max(1, int(n**0.5))
    saved = [full]
    v = full
    for i in range(n):
        v = advance(v, a[i])
        if (i + 1) % stride == 0:
            saved.append(v)
    i, j = n, m
    block, rows = -1, []
    while i > 0 or j > 0:
        if i > 0 and j > 0 and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            ops.append((i, j))
            continue
        added = j > 0
        if i > 0 and j > 0:
            want = i // stride
            if want != block:
                block, rows = want, [saved[want]]
                for r in range(want * stride, min((want + 1) * stride - 1, n)):
                    rows.append(advance(rows[-1], a[r]))
            # bit j-1 set: the score does not grow with word j-1, so dropping it costs nothing
            added = (rows[i - block * stride] >> (j - 1)) & 1 == 1
        if added:
            j -= 1
            ops.append((-1, j))
        else:
            i -= 1
            ops.append((i, -1))
    ops.reverse()
    return ops


BOX = ("text", "x", "y", "w", "h", "font")
MARK_SCHEMA = (
    ("pair_id", pa.int64()), ("pair_no", pa.int64()), ("page_a", pa.int64()), ("page_b", pa.int64()),
    ("mark_no", pa.int64()), ("diff_percent", pa.float64()), ("side", pa.string()), ("type", pa.string()),
    ("text", pa.string()), ("x", pa.float64()), ("y", pa.float64()), ("w", pa.float64()), ("h", pa.float64()),
    ("category", pa.string()),
)
MARK_DDL = ", ".join(f"{n} {'long' if t == pa.int64() else 'double' if t == pa.float64() else 'string'}" for n, t in MARK_SCHEMA)


def islands(y: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """Number of the stretch each box belongs to.

    ``joined`` tells whether a box continues the one before; a stretch also ends
    before its first box that is off the line of the stretch's own first box.
    """
    starts = ~joined
    if len(starts):
        starts[0] = True
    while True:
        stretch = np.cumsum(starts) - 1
        anchor = y[np.flatnonzero(starts)]
        off = np.flatnonzero(np.abs(y - anchor[stretch]) >= SAME_LINE)
        if not len(off):
            return stretch
        # the first one of each stretch opens a new stretch, and the rest is judged again
        starts[off[np.unique(stretch[off], return_index=True)[1]]] = True


def side_marks(words: dict, kinds: list[str], height: float, side: str) -> dict:
    """Highlights of one side, as columns: the marked words, neighbours of one kind merged.

    ``kinds`` holds added, deleted, modified or an empty text for each word.
    """
    at = np.array([i for i, k in enumerate(kinds) if k], dtype=int)
    x, y, w, h = (np.array(words[c], dtype=float)[at] for c in ("x", "y", "w", "h"))
    edge = (y <= height * EDGE_BAND) | (y >= height * (1 - EDGE_BAND))
    type_ = np.array([kinds[i] for i in at], dtype=object)
    category = np.where(type_ == "modified", "formatting", np.where(edge, "header-footer", "text"))
    left, right = x - 1, x + w + 1
    joined = np.zeros(len(at), dtype=bool)
    joined[1:] = (
        (np.abs(left[1:] - right[:-1]) < ADJOINING) & (type_[1:] == type_[:-1]) & (category[1:] == category[:-1])
    )
    first = np.flatnonzero(np.diff(islands(y, joined), prepend=-1))
    stop = np.append(first[1:], len(at))[: len(first)]
    text = [words["text"][i] for i in at]
    return {
        "side": [side] * len(first), "type": type_[first].tolist(),
        "text": ["".join(text[i:j]) for i, j in zip(first, stop)],
        "x": left[first].tolist(), "y": (y[first] - 1).tolist(), "w": (right[stop - 1] - left[first]).tolist(),
        "h": (h[first] + 2).tolist(), "category": category[first].tolist(),
    }


def page_highlights(wa: dict, wb: dict, height_a: float, height_b: float) -> tuple[dict, int]:
    """Highlights of one page pair (side a first) and the number of differing words; words come as columns."""
    kinds_a, kinds_b = ["deleted"] * len(wa["text"]), ["added"] * len(wb["text"])
    same = [(i, j) for i, j in lcs_ops(wa["text"], wb["text"]) if i >= 0 and j >= 0]
    for i, j in same:
        kinds_a[i] = kinds_b[j] = "" if wa["font"][i] == wb["font"][j] else "modified"
    left, right = side_marks(wa, kinds_a, height_a, "a"), side_marks(wb, kinds_b, height_b, "b")
    return {c: left[c] + right[c] for c in left}, len(kinds_a) + len(kinds_b) - 2 * len(same)


def _field(name: str):
    return lambda w: w[name]


#: What white space and CJK characters are to ``functions.text.tokenize_words``.
_WORDS, _CJK = re.compile(r"[^ \t\n\x0b\f\r]+"), re.compile("[\u4e00-\u9fa5]")


def line_words(line: str) -> list[tuple[str, int]]:
    """Words of a line, or its characters if some are CJK, with their offsets."""
    if _CJK.search(line):
        return [(c, i) for i, c in enumerate(line)]
    return [(m.group(), m.start()) for m in _WORDS.finditer(line)]


def box_words(pairs: DataFrame, first_x: float = 50.0, first_y: float = 40.0, leading: float = 14.0, advance: float = 5.0, height: float = 10.0) -> DataFrame:
    """Adds words_a and words_b, the words of text_a and text_b with boxes: lines ``leading`` points apart, ``advance`` points a
    character, fonts from font_a and font_b.  A null text gives null."""
    sides = ("a", "b")
    slim = pairs.select(*[c for c in pairs.columns if c[:5] not in ("text_", "font_")], *[f"{c}_{s}" for s in sides for c in ("text", "font")])
    kept = slim.columns[:-4]
    box = pa.struct([("text", pa.string()), *((c, pa.float64()) for c in BOX[1:5]), ("font", pa.string())])
    ddl = "array<struct<text:string,x:double,y:double,w:double,h:double,font:string>>"

    def words_of(texts: pa.Array, fonts: pa.Array) -> pa.Array:
        offsets, missing, words, at, line_no, font = [0], [], [], [], [], []
        for text, f in zip(texts.to_pylist(), fonts.to_pylist(), strict=True):
            missing.append(text is None)
            for i, line in enumerate((text or "").split("\n")):
                found = line_words(line)
                words += [w for w, _ in found]
                at += [k for _, k in found]
                line_no += [i] * len(found)
            font += [f] * (len(words) - offsets[-1])
            offsets.append(len(words))
        n = np.fromiter(map(len, words), np.float64, len(words))
        y = first_y + np.array(line_no, dtype=np.float64) * leading
        cols = [words, first_x + np.array(at, dtype=np.float64) * advance, y, n * advance, np.full(len(words), height), font]
        structs = pa.StructArray.from_arrays([pa.array(c, k.type) for c, k in zip(cols, box, strict=True)], fields=list(box))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs, mask=pa.array(missing))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                b = batch.slice(s, 512)
                text_a, font_a, text_b, font_b = b.columns[-4:]
                yield pa.RecordBatch.from_arrays([*b.columns[:-4], words_of(text_a, font_a), words_of(text_b, font_b)], names=[*kept, "words_a", "words_b"])

    types = dict(slim.dtypes)
    return slim.mapInArrow(run, ", ".join([*(f"{c} {types[c]}" for c in kept), f"words_a {ddl}", f"words_b {ddl}"]))


def diff_words(pairs: DataFrame) -> DataFrame:
    """Merged highlights of each page pair, numbered by mark_no.

    Input, one row per page pair: pair_id, pair_no, page_a, page_b, words_a,
    words_b (arrays of words with boxes, y from the top), height_a, height_b.
    The work is per row, so no grouping happens here.
    """
    keys = ("pair_id", "pair_no", "page_a", "page_b")
    # boxes travel as plain arrays, one per property, which convert fastest
    slim = pairs.select(
        *keys, "height_a", "height_b",
        *[
            F.transform(f"words_{s}", _field(c)).alias(f"{c}_{s}")
            for s in ("a", "b")
            for c in BOX
        ],
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = {n: b.column(n) for n in b.schema.names}
            out = {n: [] for n, _ in MARK_SCHEMA}
            flat, ends = {}, {}
            for s in ("a", "b"):
                ends[s] = np.cumsum(np.r_[0, pc.fill_null(pc.list_value_length(col[f"text_{s}"]), 0).to_numpy(zero_copy_only=False)])
                for c in BOX:
                    own = col[f"{c}_{s}"].flatten()
                    flat[c, s] = own.to_pylist() if c in ("text", "font") else own.to_numpy(zero_copy_only=False)
            for i in range(b.num_rows):
                wa, wb = ({c: flat[c, s][ends[s][i] : ends[s][i + 1]] for c in BOX} for s in ("a", "b"))
                marks, differing = page_highlights(wa, wb, col["height_a"][i].as_py(), col["height_b"][i].as_py())
                n = len(marks["text"])
                for k in keys:
                    out[k] += [col[k][i].as_py()] * n
                out["mark_no"] += range(n)
                out["diff_percent"] += [100.0 * differing / max(len(wa["text"]), len(wb["text"]), 1)] * n
                for c, values in marks.items():
                    out[c] += values
            yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in MARK_SCHEMA], names=[n for n, _ in MARK_SCHEMA])

    return slim.mapInArrow(run, MARK_DDL)


def word_ops(pairs: DataFrame) -> DataFrame:
    """Word operations of each pair as counts: equal, added, deleted, n1, n2.

    ``pairs``: pair_id, page_a, page_b, words_a, words_b (arrays of strings).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                wa = list(r.words_a) if r.words_a is not None else []
                wb = list(r.words_b) if r.words_b is not None else []
                ops = lcs_ops(wa, wb)
                equal = sum(1 for i, j in ops if i >= 0 and j >= 0)
                rows.append(
                    (r.pair_id, r.page_a, r.page_b, equal, len(wb) - equal, len(wa) - equal, len(wa), len(wb))
                )
            yield pd.DataFrame(
                rows,
                columns=["pair_id", "page_a", "page_b", "equal", "added", "deleted", "n1", "n2"],
            )

    return pairs.select("pair_id", "page_a", "page_b", "words_a", "words_b").mapInPandas(
        run,
        "pair_id long, page_a long, page_b long, equal long, added long, deleted long, n1 long, n2 long",
    )


def diff_percent(ops: DataFrame) -> DataFrame:
    """100 * (added + deleted) / max(n1, n2, 1); may exceed 100."""
    return ops.withColumn(
        "diff_percent",
        100.0 * (F.col("added") + F.col("deleted")) / F.greatest("n1", "n2", F.lit(1)),
    )


def filter_highlights(marks: DataFrame, hidden: tuple[str, ...] = ()) -> DataFrame:
    """Hide kinds: ``moved``, ``header-footer``, ``formatting``, ``text``."""
    return marks.filter(
        ~(((F.col("type") == "moved") & F.lit("moved" in hidden)) | F.col("category").isin(*hidden))
        if hidden
        else F.lit(True)
    )


#: Deleted texts, in reading order, that every added text is compared with at once; one that is like none of them is compared
#: with MOVED_MORE times as many before the join on letters.
MOVED_FIRST, MOVED_MORE = 8, 16
#: Lengths are told apart by steps of a quarter: the bounds of a step must hold for all lengths in it.
LENGTH_STEP = 1.25


def _step(n: int) -> int:
    return int(math.log(n) / math.log(LENGTH_STEP) + 1e-9)


def _shortest(step: int) -> int:
    n = max(1, int(LENGTH_STEP**step))
    while _step(n) < step:
        n += 1
    return n


def deleted_keys(kinds: DataFrame) -> DataFrame:
    """pair_id, step, letter, letters, n, place: deleted letter sets (pair_id, letters, n, place) under each of their letters."""
    step = F.floor(F.log("n") / math.log(LENGTH_STEP) + 1e-9).cast("int")
    each = kinds.select("pair_id", "letters", "n", "place", step.alias("step"))
    return each.withColumn("letter", F.explode(F.split("letters", ""))).where("letter <> ''")


def added_keys(texts: DataFrame, frequency: dict[str, int]) -> DataFrame:
    """pair_id, t, step, letter: the letters of which a likeness of MOVED_MATCH needs one, rarest first, for each step of lengths.

    Of an added text of n letters, at most n - MOVED_MATCH / 2 * (n + m) may be missing in a deleted one of m letters, so one of the
    rarest letters that together stand more often than that has to occur in it."""
    half = MOVED_MATCH / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                out: tuple[list, list, list, list] = ([], [], [], [])
                part = batch.slice(at, 4096)
                for pair, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    n = len(t)
                    rare = sorted(Counter(t).items(), key=lambda c: (frequency.get(c[0], 0), c[0]))
                    for step in range(_step(MOVED_MIN), _step(max(MOVED_MIN, int(n * (1 - half) / half) + 1)) + 1):
                        spare, held = n - half * (n + max(MOVED_MIN, _shortest(step))) + 1e-9, 0
                        if spare < 0:
                            break
                        for c, k in rare:
                            if frequency.get(c):
                                for col, v in zip(out, (pair, t, step, c), strict=True):
                                    col.append(v)
                            held += k
                            if held > spare:
                                break
                types = (pa.int64(), pa.string(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, types, strict=True)], names=["pair_id", "t", "step", "letter"])

    return texts.select("pair_id", "t").mapInArrow(run, "pair_id long, t string, step int, letter string")


def resembles(t: Column, letters: Column, n: Column) -> Column:
    """Whether the added text ``t`` is like a deleted one of ``n`` letters, known by their set."""
    shared = F.length(t) - F.length(F.call_function("translate", t, letters, F.lit("")))
    # of a text far too short, no letters need be looked at
    return may_resemble(F.length(t), n) & (2.0 * shared / (n + F.length(t)) >= MOVED_MATCH)


def may_resemble(length: Column, n: Column) -> Column:
    """Whether an added text of ``length`` letters, or a shorter one, can be like a deleted one of ``n``."""
    return 2.0 * length / (n + length) >= MOVED_MATCH


def moved_candidates(kinds: DataFrame, texts: DataFrame) -> DataFrame:
    """pair_id, t, letters, n, place: pairs that may be alike, by the join on letters."""
    counts = kinds.select(F.explode(F.split("letters", "")).alias("c")).groupBy("c").count()
    # one row per code point at most
    frequency = {r["c"]: r["count"] for r in counts.collect()}
    # a file's size tells little of its rows under each of their letters, and nothing here is small
    return added_keys(texts, frequency).join(deleted_keys(kinds).hint("merge"), ["pair_id", "step", "letter"])


def first_alike(kinds: DataFrame, texts: DataFrame) -> DataFrame:
    """``texts`` (pair_id, t and more) with deleted (place): the first deleted text that each added text t is like.

    ``kinds``: pair_id, letters (their set), n (length) and the first place of the deleted texts of that set and length, which is all that
    likeness depends on.  Long texts of one language are alike almost all, and find their first among the MOVED_FIRST
    first ones; most documents have no more than those tried next, and only what is left of the others goes through the join on letters."""
    order = Window.partitionBy("pair_id").orderBy("place")
    most = MOVED_FIRST * MOVED_MORE
    head = kinds.withColumn("no", F.row_number().over(order)).where(F.col("no") <= most + 1)
    head = head.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("place", "letters", "n"))).alias("head"))
    found = F.coalesce(*[
        F.get(F.filter(F.slice("head", first + 1, size), lambda h: resembles(F.col("t"), h["letters"], h["n"])), F.lit(0))["place"]
        for first, size in ((0, MOVED_FIRST), (MOVED_FIRST, most - MOVED_FIRST))
    ])
    own = [F.col(c) for c in texts.columns]
    # place of the first deleted text that was not tried
    left = F.get("head", F.lit(most))["place"].alias("_from")
    tried = texts.join(head.hint("merge"), "pair_id").select(*own, found.alias("deleted"), left)
    # written as it is: a filter before that would look for the first ones a second time
    tried = materialise(tried, "moved-first")
    rest = tried.where("deleted IS NULL AND _from IS NOT NULL")
    reach = rest.groupBy("pair_id", "_from").agg(F.max(F.length("t")).alias("_longest"))
    behind = kinds.join(reach.hint("merge"), "pair_id").where((F.col("place") >= F.col("_from")) & may_resemble(F.col("_longest"), F.col("n")))
    behind = behind.select(*kinds.columns)
    rest = rest.select(*own)
    some = moved_candidates(materialise(behind, "moved-behind"), rest.select("pair_id", "t").distinct()).where(resembles(F.col("t"), F.col("letters"), F.col("n")))
    late = some.groupBy("pair_id", "t").agg(F.min("place").alias("deleted"))
    late = rest.join(late.hint("merge"), ["pair_id", "t"]).select(*own, "deleted")
    return tried.where("deleted IS NOT NULL").select(*own, "deleted").unionByName(late)


def usable() -> Column:
    """Whether a mark may be moved text."""
    return F.coalesce(F.col("type").isin("deleted", "added") & (F.length(strip(F.col("text"))) >= MOVED_MIN), F.lit(False))


def moved_pairs(marks: DataFrame, *more: Column) -> DataFrame:
    """pair_id, deleted, added: the places (pair_no, mark_no and ``more``) of each added segment and the deleted one it belongs to."""
    clean = F.regexp_replace("text", r"\s+", "")
    place = F.struct("pair_no", "mark_no", *more)
    ends = marks.where(usable()).select("pair_id", place.alias("place"), "type", clean.alias("t"))
    letters = F.array_join(F.array_sort(F.array_distinct(F.split("t", ""))), "")
    kinds = ends.where("type = 'deleted'").groupBy("pair_id", letters.alias("letters"), F.length("t").alias("n")).agg(F.min("place").alias("place"))
    added = ends.where("type = 'added'").select("pair_id", "t", F.col("place").alias("added"))
    return first_alike(materialise(kinds, "moved-from"), added).select("pair_id", "deleted", "added")


def find_moved(marks: DataFrame) -> DataFrame:
    """Deleted and added segments of a document pair that are the same text.

    Every added segment belongs to the first deleted one it resembles (>= 0.85);
    a deleted segment points to the last added one it won.  Likeness depends on
    the texts alone, and of a deleted one on its set of letters and its length,
    so equal ones are compared once (``first_alike``).  Every table here grows with
    the corpus, so none is sent whole to all executors: joins are merge joins.

    Input: pair_id, pair_no, mark_no (reading order), type, text.
    Returns (pair_id, deleted_pair, deleted_mark, added_pair, added_mark,
    is_target).
    """
    won = moved_pairs(marks)
    last = won.groupBy("pair_id", "deleted").agg(F.max("added").alias("added"))
    last = last.select("pair_id", "added", F.lit(True).alias("_last"))
    return won.join(last.hint("merge"), ["pair_id", "added"], "left").select(
        "pair_id",
        F.col("deleted.pair_no").alias("deleted_pair"), F.col("deleted.mark_no").alias("deleted_mark"),
        F.col("added.pair_no").alias("added_pair"), F.col("added.mark_no").alias("added_mark"),
        F.coalesce("_last", F.lit(False)).alias("is_target"),
    )


def mark_moved(marks: DataFrame) -> DataFrame:
    """Highlights with both ends of a moved text turned into type ``moved``.

    Adds to_page, to_x and to_y: where the text went (side a) or came from
    (side b); null on other highlights.  Places carry their page and position
    along, so that marks and their texts are moved once, and only those that can
    be moved text.
    """
    page = F.when(F.col("side") == "a", F.col("page_a")).otherwise(F.col("page_b"))
    won = moved_pairs(marks, F.struct(page.alias("page"), "x", "y").alias("to"))
    last = won.groupBy("pair_id", "deleted").agg(F.max("added").alias("added"))

    def end(pairs: DataFrame, mine: str, other: str) -> DataFrame:
        return pairs.select("pair_id", F.col(f"{mine}.pair_no").alias("pair_no"), F.col(f"{mine}.mark_no").alias("mark_no"), F.col(f"{other}.to").alias("to"))

    links = end(last, "deleted", "added").unionByName(end(won, "added", "deleted"))
    linked = marks.where(usable()).join(links.hint("merge"), ["pair_id", "pair_no", "mark_no"], "left")
    others = marks.where(~usable()).withColumn("to", F.lit(None).cast(links.schema["to"].dataType))
    return (
        linked.unionByName(others)
        .withColumns(
            {
                "type": F.when(F.col("to").isNotNull(), "moved").otherwise(F.col("type")),
                "to_page": F.col("to.page"), "to_x": F.col("to.x"), "to_y": F.col("to.y"),
            }
        )
        .drop("to")
    )
