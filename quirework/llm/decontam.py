"""Benchmark decontamination as a prefix-filtered join of word shingles.

Items are cut into windows of ``window`` consecutive words (an item of fewer words is one window).  Every occurrence of a window
holds all its shingles at known offsets, so one shingle is a sufficient prefix: the one that is rarest over all documents.
Documents look up their shingles in that index; a hit gives the only possible place of the window (positional bound), which
must lie inside the document (length bound), and all its words are then compared.

The index of a block of items is broadcast; a block has about ``block_chars`` characters of items at most, larger benchmarks take
several blocks, each with a pass over the documents, and the hits of all blocks are united.  Documents are never shuffled with
their texts.

Words: A-Z lower-cased, then runs of 0-9, a-z and everything outside ASCII.  Edge cases: a null text has no words; an item without
words has no window; repeated rows each get their result; items that share a window all count; null item ids count as windows
but are not listed.  Extra columns are kept by ``drop_contaminated`` and ignored by ``contamination``.  Empty tables: nothing is hit.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8

SHINGLE = 3
_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
HITS = "doc_id long, text_key long, n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def words(text: str | None) -> list[bytes]:
    return utf8(text).translate(_WORD_BYTES).split()


class Index:
    """Windows of one block of items, and the shingle under which each is looked up."""

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        self.vocab: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set] = {}
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(text)]
            n = min(window, len(ids))
            for i in range(len(ids) - n + 1) if n else ():
                found.setdefault(tuple(ids[i : i + n]), set()).update(() if item is None else (str(item),))
        self.base = len(self.vocab) + 1
        if self.base**SHINGLE >= 1 << 63:
            raise ValueError("too many different words in a block of items: lower block_chars")
        self.window = window
        self.items = [sorted(v) for v in found.values()]
        self.length = np.array([len(w) for w in found], dtype=np.int64)
        self.ids = np.zeros((len(found), window), dtype=np.int32)
        for k, w in enumerate(found):
            self.ids[k, : len(w)] = w
        self.sizes = sorted({min(SHINGLE, len(w)) for w in found})
        self.keys = {m: np.unique(np.concatenate([self.shingles(self.ids[k, : self.length[k]], m) for k in range(len(found)) if min(SHINGLE, self.length[k]) == m])) for m in self.sizes}
        self.prefix: dict[int, tuple] = {}

    def shingles(self, ids: np.ndarray, m: int) -> np.ndarray:
        """Number of the shingle of ``m`` words at each place, 0 where a word is not in the block."""
        n = max(0, len(ids) - m + 1)
        key, whole = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
        for j in range(m):
            key = key * self.base + ids[j : j + n]
            whole &= ids[j : j + n] > 0
        return key * whole

    def look_up(self, ids: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Places whose shingle is in the block, and its number among ``keys[m]``."""
        s = self.shingles(ids, m)
        at = np.flatnonzero(s)
        k = np.minimum(np.searchsorted(self.keys[m], s[at]), len(self.keys[m]) - 1)
        ok = self.keys[m][k] == s[at]
        return at[ok], k[ok]

    def order(self, counts: dict[tuple[int, int], int]) -> Index:
        """File every window under its rarest shingle; ``counts``: by size and number."""
        rows: dict[int, list[tuple[int, int, int]]] = {m: [] for m in self.sizes}
        for k in range(len(self.length)):
            m = min(SHINGLE, int(self.length[k]))
            numbers = np.searchsorted(self.keys[m], self.shingles(self.ids[k, : self.length[k]], m))
            _, number, offset = min((counts.get((m, int(x)), 0), int(x), o) for o, x in enumerate(numbers))
            rows[m].append((number, k, offset))
        for m, r in rows.items():
            a = np.array(sorted(r), dtype=np.int64).reshape(-1, 3)
            self.prefix[m] = (np.searchsorted(a[:, 0], np.arange(len(self.keys[m]) + 1)), a[:, 1], a[:, 2])
        return self

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts, a zero behind each, and where each text begins."""
        out, starts, at = [], [0], 0
        for t in texts:
            w = words(t)
            ids = np.zeros(len(w) + 1, dtype=np.int32)
            ids[:-1] = np.fromiter(map(self.vocab.get, w, repeat(0)), dtype=np.int32, count=len(w))
            out.append(ids)
            at += len(ids)
            starts.append(at)
        return (np.concatenate(out) if out else np.zeros(0, np.int32)), np.array(starts, dtype=np.int64)

    def matches(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and window of every occurrence."""
        starts, wins = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for m in self.sizes:
            first, win, offset = self.prefix[m]
            place, key = self.look_up(ids, m)
            n = first[key + 1] - first[key]
            for a in range(0, len(place), 1 << 16):  # in stretches, so that frequent shingles stay small
                c = n[a : a + (1 << 16)]
                row = np.repeat(first[key[a : a + (1 << 16)]], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                start, w = np.repeat(place[a : a + (1 << 16)], c) - offset[row], win[row]
                ok = (start >= 0) & (start + self.length[w] <= len(ids))
                start, w = start[ok], w[ok]
                for j in range(self.window):
                    if not len(start):
                        break
                    ok = (j >= self.length[w]) | (ids[np.minimum(start + j, len(ids) - 1)] == self.ids[w, j])
                    start, w = start[ok], w[ok]
                starts.append(start)
                wins.append(w)
        return np.concatenate(starts), np.concatenate(wins)

    def hits(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """Per text: words, merged word spans that are hit, items whose windows occur."""
        ids, begins = self.encode(texts)
        start, win = self.matches(ids)
        doc = np.searchsorted(begins, start, side="right") - 1
        edge = np.zeros(len(ids) + 1, dtype=np.int32)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + self.length[win], -1)
        cover = np.diff(np.concatenate([[0], (np.cumsum(edge) > 0).astype(np.int8)]))
        ups, downs = np.flatnonzero(cover == 1), np.flatnonzero(cover == -1)
        spans: dict[int, list] = {}
        for a, b in zip(ups.tolist(), downs.tolist(), strict=True):
            d = int(np.searchsorted(begins, a, side="right")) - 1
            spans.setdefault(d, []).append((a - int(begins[d]), b - int(begins[d])))
        items: dict[int, set] = {}
        for d, w in set(zip(doc.tolist(), win.tolist(), strict=True)):
            items.setdefault(d, set()).update(self.items[w])
        return [(int(begins[d + 1] - begins[d]) - 1, spans.get(d, []), sorted(items.get(d, ()))) for d in range(len(texts))]


def indexes(docs: DataFrame, benchmark: DataFrame, window: int, block_chars: int) -> Iterator:
    """Broadcast indexes, one for each block of items, ordered by the shingles' counts over all documents."""
    sc = docs.sparkSession.sparkContext
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_chars))
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        index = sc.broadcast(Index([tuple(r) for r in part.collect()], window))

        def count(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            ix, seen = index.value, Counter()
            for batch in batches:
                for part in slices(batch, 4 << 20):
                    ids, _ = ix.encode(part.column(0).to_pylist())
                    for m in ix.sizes:
                        seen.update({(m, int(k)): int(n) for k, n in zip(*np.unique(ix.look_up(ids, m)[1], return_counts=True), strict=True)})
            rows = [(m, k, n) for (m, k), n in seen.items()]
            yield pa.RecordBatch.from_pydict({"m": [r[0] for r in rows], "k": [r[1] for r in rows], "n": [r[2] for r in rows]}, pa.schema([("m", pa.int64()), ("k", pa.int64()), ("n", pa.int64())]))

        counted = docs.select("text").mapInArrow(count, "m long, k long, n long").groupBy("m", "k").agg(F.sum("n").alias("n"))
        yield sc.broadcast(index.value.order({(r.m, r.k): r.n for r in counted.collect()}))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_chars: int = 16 << 20) -> DataFrame:
    """doc_id, n_words, spans (word spans that are hit; those of several blocks may overlap), items: one row per document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    parts = []
    for index in indexes(docs, benchmark, window, block_chars):

        def find(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, 4 << 20):
                    got = index.value.hits(part.column(1).to_pylist())
                    spans = pa.array([[{"start": a, "end": b} for a, b in g[1]] for g in got], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(2), pa.array([g[0] for g in got], pa.int64()), spans, pa.array([g[2] for g in got], pa.list_(pa.string()))],
                        names=["doc_id", "text_key", "n_words", "spans", "items"],
                    )

        parts.append(rows.mapInArrow(find, HITS))
    if len(parts) == 1:
        return parts[0].drop("text_key")
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return (
        whole.groupBy("doc_id", "text_key", "n_words")
        .agg(F.flatten(F.collect_set("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"), (F.count("*") / len(parts)).cast("int").alias("copies"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
        .select("doc_id", "n_words", "spans", "items")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_chars: int = 16 << 20) -> DataFrame:
    """``docs`` without the rows in which a window occurs; all columns stay."""
    schema = docs.schema
    at = docs.columns.index("text")
    for index in indexes(docs, benchmark, window, block_chars):

        def keep(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, 4 << 20):
                    yield part.filter(pa.array([not g[1] for g in index.value.hits(part.column(at).to_pylist())], pa.bool_()))

        docs = docs.mapInArrow(keep, schema)
    return docs
