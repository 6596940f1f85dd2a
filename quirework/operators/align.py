"""Page alignment of two versions in blocks of pages: a wavefront of border rows, walked back block by block.

The recurrence over (page of a, page of b) is cut into blocks of ``PAGES`` x ``PAGES`` cells.  A block needs the last row of the block
above and the last column of the block to its left, so all blocks of one anti-diagonal, of all documents, are one Spark job keyed
by (pair, block of a, block of b), and only border rows are handed on.  Pairs come out on the way back: each job takes every
document one block further and rebuilds that block from its borders.  Documents that fit one block need no wavefront and one job.
No task holds more than one block, whatever the length of a document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.session import shared_dir

PAGES = 1024

FRONT = "pair_id long, i long, j long, bottom array<double>, right array<double>"
STEP = "pair_id long, _break long, i long, j long, row long, col long, done long, finished boolean, page_a array<long>, page_b array<long>, similarity array<double>"


def letters_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a text without white space, rising, and their counts."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<i4")
    if codes.max(initial=0) < LOW:
        counts = np.bincount(codes)
        chars = np.flatnonzero(counts)
        counts = counts[chars]
    else:
        chars, counts = np.unique(codes, return_counts=True)
    kept = (chars != 32) & ((chars < 9) | (chars > 13))
    return chars[kept].astype(np.int32), counts[kept].astype(np.int32)


#: Texts with code points below this are counted in a table.
LOW = 4096


def with_letters(pages: DataFrame, text: str) -> DataFrame:
    """A text's code points without white space (rising), their counts and how many there are, in place of the text; nulls
    for no text."""
    rest = [c for c in pages.columns if c != text]
    names = [*rest, "n", "chars", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(rest)).to_pylist()
            found = [None if t is None else letters_of(t) for t in texts]
            cols = [
                pa.array([None if f is None else int(f[1].sum()) for f in found], pa.int32()),
                pa.array([None if f is None else f[0] for f in found], pa.list_(pa.int32())),
                pa.array([None if f is None else f[1] for f in found], pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *cols], names=names)

    kinds = dict(pages.dtypes)
    return pages.select(*rest, text).mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in rest], "n int, chars array<int>, counts array<int>"]))


def likeness(n_a: Column, chars_a: Column, n_b: Column, chars_b: Column, counts_b: Column) -> Column:
    """``functions.text.text_similarity`` of two texts, from their letters."""

    def keys(chars: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(chars)), pc.fill_null(pc.list_value_length(chars), 0).to_numpy(zero_copy_only=False))
        return row, (row << 21) | chars.flatten().to_numpy(zero_copy_only=False)

    @F.arrow_udf("double")
    def shared(n_a: pa.Array, chars_a: pa.Array, n_b: pa.Array, chars_b: pa.Array, counts_b: pa.Array) -> pa.Array:
        both = pc.and_(n_a.is_valid(), n_b.is_valid()).to_numpy(zero_copy_only=False)
        a, b = (pc.fill_null(n, 0).to_numpy(zero_copy_only=False).astype(np.int64) for n in (n_a, n_b))
        of_a, (row, of_b) = keys(chars_a)[1], keys(chars_b)
        hit = np.isin(of_b, of_a)
        found = np.bincount(row[hit], counts_b.flatten().to_numpy(zero_copy_only=False)[hit], minlength=len(a))
        out = np.divide(2.0 * found, a + b, out=np.ones(len(a)), where=a + b > 0)
        out[(a == 0) != (b == 0)] = 0.0
        return pa.array(out, mask=~both)

    return shared(n_a, chars_a, n_b, chars_b, counts_b)


class Side:
    """Letters of the pages of one block."""

    def __init__(self, lengths, sizes, chars, counts):
        self.n = np.array(lengths or [], dtype=np.float64)
        self.row = np.repeat(np.arange(len(self.n)), np.array(sizes or [], dtype=np.int64))
        self.chars, self.counts = np.array(chars or [], dtype=np.int64), np.array(counts or [], dtype=np.float64)

    def table(self, letters: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.n), len(letters)))
        out[self.row, np.searchsorted(letters, self.chars)] = values
        return out


def similarities(a: Side, b: Side) -> np.ndarray:
    """Share of the letters of each page of ``b`` that occur in each page of ``a``, both lengths counted."""
    letters = np.union1d(a.chars, b.chars)
    shared = a.table(letters, np.ones(len(a.chars))) @ b.table(letters, b.counts).T
    both = a.n[:, None] + b.n
    out = np.divide(2.0 * shared, both, out=np.ones_like(shared), where=both > 0)
    out[(a.n[:, None] == 0) != (b.n == 0)] = 0.0
    return out


def fill(s: np.ndarray, hit: np.ndarray, top: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Scores of a block from its borders, one anti-diagonal at a time.

    A matching cell takes the score before both pages and its own; another one the better of its upper and left neighbours."""
    n, m = s.shape
    d = np.empty((n + 1, m + 1))
    d[0], d[:, 0] = top, left
    if not s.size:
        return d
    flat, own, match, step = d.ravel(), s.ravel(), hit.ravel(), m
    for k in range(2, n + m + 1):
        lo, hi = max(1, k - m), min(n, k - 1)
        # cell (i, k - i) stands at i * (m + 1) + k - i = i * m + k
        at = slice(lo * step + k, hi * step + k + 1, step)
        count = hi - lo + 1
        first = (lo - 1) * m + k - lo - 1
        cells = slice(first, first + (count - 1) * (m - 1) + 1, m - 1) if m > 1 else slice(first, first + count)
        up = flat[lo * step + k - m - 1 : hi * step + k - m : step]
        before = flat[lo * step + k - 1 : hi * step + k : step]
        corner = flat[lo * step + k - m - 2 : hi * step + k - m - 1 : step]
        flat[at] = np.where(match[cells], corner + own[cells], np.maximum(up, before))
    return d


def walk(s: np.ndarray, hit: np.ndarray, d: np.ndarray, i: int, j: int) -> tuple[list[tuple[int, int]], int, int]:
    """(row, column) of each step back from cell (i, j) until a border, -1 for a side without page; and the cell reached."""
    out = []
    while i and j:
        if hit[i - 1, j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif d[i, j - 1] >= d[i - 1, j]:
            j -= 1
            out.append((-1, j))
        else:
            i -= 1
            out.append((i, -1))
    return out, i, j


def align(pages: DataFrame, at_least: float, size: int = PAGES) -> DataFrame:
    """pair_id, pair_no, page_a, page_b, similarity for pages (pair_id, _break, side, page_no from 1) of unsettled pairs, with
    their text without white space (t) or its letters."""
    spark = pages.sparkSession
    base = shared_dir(spark, "page-blocks")
    listed = F.array_sort(F.collect_list(F.struct("page_no", "n", "chars", "counts")))
    if "t" in pages.columns:
        pages = with_letters(pages.withColumn("t", F.coalesce("t", F.lit(""))), "t")
    blocks = pages.groupBy("pair_id", "side", F.floor((F.col("page_no") - 1) / size).alias("no")).agg(F.first("_break").alias("_break"), listed.alias("p"))
    blocks = blocks.select(
        "pair_id", "side", "no", "_break", F.col("p.n").alias("lengths"), F.transform("p", lambda x: F.size(x["chars"])).alias("sizes"),
        F.flatten("p.chars").alias("chars"), F.flatten("p.counts").alias("counts"),
    )
    blocks.write.parquet(f"{base}/pages")
    blocks = spark.read.schema(blocks.schema).parquet(f"{base}/pages")
    count = lambda side, c: F.coalesce(F.sum(F.when(F.col("side") == side, c)), F.lit(0)).cast("long")
    shape = blocks.groupBy("pair_id").agg(
        F.first("_break").alias("_break"), count("a", F.size("lengths")).alias("n"), count("b", F.size("lengths")).alias("m"),
        F.greatest(count("a", F.lit(1)), F.lit(1)).alias("n_i"), F.greatest(count("b", F.lit(1)), F.lit(1)).alias("n_j"),
    )
    fields = ("lengths", "sizes", "chars", "counts")

    def side(name: str, key: str) -> DataFrame:
        return blocks.where(F.col("side") == name).select("pair_id", F.col("no").alias(key), *[F.col(f).alias(f"{f}_{name}") for f in fields])

    def with_pages(cells: DataFrame, fronts: DataFrame | None) -> DataFrame:
        """Cells (pair_id, i, j) with the pages of both sides and the borders above and to the left."""
        out = cells.join(side("a", "i"), ["pair_id", "i"], "left").join(side("b", "j"), ["pair_id", "j"], "left")
        if fronts is None:
            return out.withColumns({"top": F.lit(None).cast("array<double>"), "left": F.lit(None).cast("array<double>")})
        above = fronts.select("pair_id", (F.col("i") + 1).alias("i"), "j", F.col("bottom").alias("top"))
        before = fronts.select("pair_id", "i", (F.col("j") + 1).alias("j"), F.col("right").alias("left"))
        return out.join(above, ["pair_id", "i", "j"], "left").join(before, ["pair_id", "i", "j"], "left")

    def scores(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = (Side(*[r[f"{f}_{x}"] for f in fields]) for x in ("a", "b"))
        s = similarities(a, b)
        hit = s >= at_least
        top = np.zeros(s.shape[1] + 1) if r["top"] is None else np.array(r["top"])
        left = np.zeros(s.shape[0] + 1) if r["left"] is None else np.array(r["left"])
        return s, hit, fill(s, hit, top, left)

    def front(r: dict) -> dict:
        d = scores(r)[2]
        return {"pair_id": r["pair_id"], "i": r["i"], "j": r["j"], "bottom": d[-1].tolist(), "right": d[:, -1].tolist()}

    def step(r: dict) -> dict:
        i, j, row, col = r["i"], r["j"], r["row"], r["col"]
        found: list[tuple] = []
        if row and col:
            s, hit, d = scores(r)
            path, row, col = walk(s, hit, d, row, col)
            found = [(i * size + a + 1 if a >= 0 else None, j * size + b + 1 if b >= 0 else None, float(s[a, b]) if a >= 0 and b >= 0 else None) for a, b in path]
        # a side that is used up leaves the other one without partners, block after block
        if i == 0 and row == 0:
            found += [(None, j * size + b, None) for b in range(col, 0, -1)]
            col = 0
        elif j == 0 and col == 0:
            found += [(i * size + a, None, None) for a in range(row, 0, -1)]
            row = 0
        i, row = (i - 1, size) if row == 0 and i else (i, row)
        j, col = (j - 1, size) if col == 0 and j else (j, col)
        pages_a, pages_b, likeness = ([f[x] for f in found] for x in range(3))
        more = {"i": i, "j": j, "row": row, "col": col, "done": r["done"] + len(found), "finished": not (row or col)}
        return {"pair_id": r["pair_id"], "_break": r["_break"], **more, "page_a": pages_a, "page_b": pages_b, "similarity": likeness}

    def each(df: DataFrame, fn: Callable[[dict], dict], schema: str, path: str) -> DataFrame:
        kinds = {"long": pa.int64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64()), "array<long>": pa.list_(pa.int64())}
        arrow = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(batch.num_rows):
                    yield pa.RecordBatch.from_pylist([fn(batch.slice(at, 1).to_pylist()[0])], arrow)

        df.mapInArrow(run, schema).write.parquet(path)
        return spark.read.schema(schema).parquet(path)

    many = shape.where("n_i * n_j > 1")
    rounds = many.agg(F.max(F.col("n_i") + F.col("n_j"))).first()[0] or 0
    fronts = None
    for k in range(rounds - 2):
        last = F.col("n_i") + F.col("n_j") - 2
        # the last block of a pair hands nothing on
        cells = many.where(F.lit(k) < last).select("pair_id", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.lit(k) - F.col("n_j") + 1), F.least(F.lit(k).cast("long"), F.col("n_i") - 1))).alias("i"))
        each(with_pages(cells.withColumn("j", F.lit(k) - F.col("i")), fronts), front, FRONT, f"{base}/fronts/round={k}")
        fronts = spark.read.schema(f"{FRONT}, round int").parquet(f"{base}/fronts").where(F.col("round") == k)
    all_fronts = spark.read.schema(f"{FRONT}, round int").parquet(f"{base}/fronts") if fronts is not None else None
    state = shape.select(
        "pair_id", "_break", (F.col("n_i") - 1).alias("i"), (F.col("n_j") - 1).alias("j"),
        (F.col("n") - (F.col("n_i") - 1) * size).alias("row"), (F.col("m") - (F.col("n_j") - 1) * size).alias("col"), F.lit(0).cast("long").alias("done"),
    )
    k = 0
    while True:
        out = each(with_pages(state, all_fronts if rounds else None), step, STEP, f"{base}/steps/round={k}")
        state = out.where("NOT finished").select("pair_id", "_break", "i", "j", "row", "col", "done")
        k += 1
        if state.isEmpty():
            break
    found = spark.read.schema(f"{STEP}, round int").parquet(f"{base}/steps")
    found = found.withColumn("first", F.col("done") - F.size("page_a")).select("pair_id", "_break", "first", F.posexplode(F.arrays_zip("page_a", "page_b", "similarity")).alias("at", "x"))
    # pairs come out last to first, and begin where the settled ones end
    return found.select("pair_id", (-(F.col("_break") + F.col("first") + F.col("at"))).alias("pair_no"), "x.page_a", "x.page_b", "x.similarity")
