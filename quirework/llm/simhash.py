"""SimHash near-duplicates through deletion-variant signatures.

Fingerprints of 64 bits link at ``3`` or fewer differing bits.  They are cut into two segments of 32 bits: of three differing bits
at most one falls into one of the segments, so linked fingerprints agree in some segment with some one of its bits wiped out.
Every fingerprint is indexed under its 2 x 32 variants, equal variants meet, and pairs are verified on all 64 bits.

Only distinct fingerprints are indexed: copies and empty texts, however many, are one row.  Fingerprints that meet are linked
inside their partition by union-find over vectorised comparisons, and only spanning edges leave it, so a large group of near copies
never emits its pairs.  A variant's group holds fingerprints that share 31 bits.  Components over the remaining edges are found by
alternating star contractions, each written to the shared folder.

Edge cases: a null or wordless text has fingerprint zero and links like any other; fewer words than a shingle give one shingle of
all words; repeated rows each get a row; null ids never become a component's id (a component of null ids has id null).
Extra columns are ignored.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.session import materialise

from .common import ASCII_LOWER, slices, utf8

MAX_BITS = 3
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_POP = _BITS.sum(axis=1).astype(np.uint8)


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint of a text's word shingles."""
    w = utf8(text).translate(ASCII_LOWER).split()
    if not w:
        return 0
    width = min(width, len(w))
    grams = map(b" ".join, zip(*(islice(w, j, None) for j in range(width)), strict=False))
    n, counts = len(w) - width + 1, np.zeros((8, 8), dtype=np.int64)
    while h := b"".join(islice(map(xxhash.xxh64_digest, grams, repeat(seed)), 1 << 16)):
        a = np.frombuffer(h, dtype=np.uint8).reshape(-1, 8)
        for j in range(8):
            counts[j] += np.bincount(a[:, j], minlength=256) @ _BITS
    return int.from_bytes(np.packbits(counts.ravel() * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                fps = np.array([fingerprint(t, width, seed) for t in part.column(1).to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def variants(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and fingerprints: each fingerprint under segment, wiped bit and the rest of the segment."""
    keys = []
    for seg in range(2):
        half = (fps >> np.uint64(32 * seg)) & np.uint64(0xFFFFFFFF)
        for bit in range(32):
            keys.append((half & np.uint64(0xFFFFFFFF ^ (1 << bit))) | np.uint64((seg << 37) | (bit << 32)))
    return np.concatenate(keys), np.tile(fps, 64)


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the classes of a[i] and b[i]; ``label`` maps to the class's smallest member and stays flat."""
    while True:
        la, lb = label[a], label[b]
        ne = la != lb
        if not ne.any():
            return
        a, b, la, lb = a[ne], b[ne], la[ne], lb[ne]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(flat := label[label], label):
            label[:] = flat


def spanning(keys: np.ndarray, fps: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what links of fingerprints under equal keys connect: a member and its class's smallest."""
    values, at = np.unique(fps, return_inverse=True)
    order = np.argsort(keys, kind="stable")
    k, at = keys[order], at[order]
    label = np.arange(len(values))
    left = np.arange(len(k))
    shift = 0
    while True:
        shift += 1
        left = left[left + shift < len(k)]
        left = left[k[left] == k[left + shift]]
        if not len(left):
            break
        for s in range(0, len(left), 1 << 20):
            a, b = at[left[s : s + (1 << 20)]], at[left[s : s + (1 << 20)] + shift]
            open_ = label[a] != label[b]
            a, b = a[open_], b[open_]
            near = _POP[(values[a] ^ values[b]).view(np.uint8).reshape(-1, 8)].sum(axis=1) <= max_bits
            _union(label, a[near], b[near])
    member = np.flatnonzero(label != np.arange(len(values)))
    return values[member], values[label[member]]


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """a, b with a > b: edges that span the components of distinct fingerprints ``fp``."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1 << 18):
                k, v = variants(np.asarray(part.column(0)).view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(v.view(np.int64))], names=["k", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches]
        if held:
            a, b = spanning(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]).view(np.uint64), max_bits)
            a, b = a.view(np.int64), b.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    return fps.select("fp").mapInArrow(index, "k long, fp long").repartition("k").mapInArrow(meet, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """v, root: every vertex of ``edges`` (a, b) that is not its component's smallest, and that smallest."""
    edges = materialise(edges, "links")
    state = None
    while True:
        found = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == state:
            return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
        state = found
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = materialise(small.where("a > b").distinct(), "links")


def near_duplicates(docs: DataFrame, width: int = 3, seed: int = 42, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp, component_id: one row per document; the component's id is its smallest doc_id."""
    prints = materialise(fingerprints(docs, width, seed), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(distinct, max_bits))
    rooted = distinct.join(roots, distinct["fp"] == roots["v"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = rooted.join(ids, "root").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")
