"""Near copies by SimHash fingerprints and MinHash bands, each link checked by the exact Jaccard similarity of five-word shingles.

Two texts are linked if the Jaccard similarity of their sets of shingles is ``SIMILARITY`` or more, computed from the shingles
themselves; fingerprints and bands only propose pairs.  First come the SimHash links (``simhash.links``: deletion variants of two
segments, 3 or fewer differing bits, only spanning edges), which join most of a large group of near copies without its pairs; bands
and prefixes then propose pairs of different components alone.  ``BANDS`` bands of ``ROWS`` minima miss a pair at 0.8 with probability
(1 - 0.8 ** 5) ** 30 = 7e-6, and fewer above.  Fingerprints alone would not do: pairs at 0.8 differ in about ten bits
and often in fifteen, and segments short enough to leave one differing bit would hold a fixed share of all fingerprints.

Texts with equal sets are one node.  In a band's group of up to ``SMALL`` nodes every pair is compared; in a larger one all nodes are
compared with its ``LEADERS`` smallest (one: what it misses, the exact join finds).  Nodes of larger groups whose components still differ are then joined exactly, by prefixes: shingles
are ordered by rarity, two sets at 0.8 share one of the first ``size - ceil(0.8 size) + 1``, and how many they can share behind
that place is bounded by what both have left, and by the bits that only one of them has in a bitmap of its shingles.  A passage that very many texts share is not rare, so it brings no pairs together, and
texts below 0.8 are no pairs although they share a band.  Both values steer work only: any value gives the same links for pairs that meet.

Edge cases: words are split at ASCII whitespace and lower-cased in A-Z; fewer than five words give one shingle of all words;
null and wordless texts are one node.  An empty table gives an empty table.
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
from .simhash import components, fingerprint, links

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 30, 5
SMALL, LEADERS = 16, 1
#: Slots of the filter that keeps texts out of the shuffle that no candidate pair needs.
SLOTS = 1 << 22
#: 64-bit words of a node's bits.
WORDS = 8
_R = np.random.default_rng(20)
_A = _R.integers(0, 1 << 63, size=(BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _R.integers(0, 1 << 63, size=(BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2)


def shingles(text: str | None) -> set[bytes]:
    w = utf8(text).translate(ASCII_LOWER).split()
    width = min(WIDTH, len(w))
    return set(map(b" ".join, zip(*(islice(w, j, None) for j in range(width)), strict=False))) if w else set()


def similar(a: set[bytes], b: set[bytes]) -> bool:
    common = len(a & b)
    return common >= SIMILARITY * (len(a) + len(b) - common)


def signature(text: str | None) -> tuple[int, int, bytes, int]:
    """Number of the set, its size, a key of 64 bits for each band, and the SimHash fingerprint."""
    grams = shingles(text)
    h = np.sort(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(7)), np.uint64, len(grams)))
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for s in range(0, len(h), 2048):
        least = np.minimum(least, (_A * h[s : s + 2048] + _B).min(axis=1))
    keys = [xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS)]
    return xxhash.xxh64_intdigest(h.tobytes(), 1), len(h), np.array(keys, dtype=np.uint64).tobytes(), fingerprint(text, WIDTH)


def text_key():
    return F.md5(F.coalesce("text", F.lit("")))


def signatures(docs: DataFrame) -> DataFrame:
    """text_key, node, size, bands, fp: one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                node, size, bands, fp = zip(*map(signature, part.column(1).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(size, pa.int64()), pa.array(bands, pa.binary()), pa.array(np.array(fp, np.uint64).view(np.int64))],
                    names=["text_key", "node", "size", "bands", "fp"],
                )

    return docs.select(text_key().alias("text_key"), "text").mapInArrow(run, "text_key string, node long, size long, bands binary, fp long")


def index(nodes: DataFrame) -> DataFrame:
    """k, node, size: a row per band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1 << 20):
                keys = np.frombuffer(b"".join(part.column(2).to_pylist()), dtype=np.int64)
                node, size = (np.repeat(np.asarray(part.column(i)), BANDS) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(node), pa.array(size)], names=["k", "node", "size"])

    return nodes.select("node", "size", "bands").mapInArrow(run, "k long, node long, size long")


def alike(nodes: DataFrame) -> DataFrame:
    """a < b: pairs of nodes (node, fp) that span what fingerprints at few differing bits link; of equal fingerprints each node and the smallest."""
    least = materialise(nodes.groupBy("fp").agg(F.min("node").alias("least")), "fingerprints")
    same = nodes.join(least, "fp").where("node > least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    of = lambda c, n: least.select(F.col("fp").alias(c), F.col("least").alias(n))
    near = links(least).join(of("a", "x"), "a").join(of("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return same.unionByName(near)


def meet(rows: DataFrame, leaders_only: bool) -> DataFrame:
    """a < b: pairs of nodes with an equal key, in different components (k, node, size, place, comp, bits), whose sizes, places and bits allow the similarity.

    ``bits`` holds a bit for each shingle, by hash (empty for a band).  ``place`` is the key's place in the order of the node's shingles, 0 for a band.  With ``leaders_only`` a large group gives only the pairs
    of its first nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def bitmaps(c: pa.Array) -> np.ndarray:
            raw = b"".join(c.to_pylist())
            return np.frombuffer(raw, dtype="<u8").reshape(-1, WORDS) if raw else np.zeros((len(c), WORDS), dtype="<u8")

        held = [[*(np.asarray(c) for c in b.columns[:5]), bitmaps(b.column(5))] for b in batches if b.num_rows]
        if not held:
            return
        k, node, size, place, comp, bits = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((node, comp, k))
        k, node, size, place, comp, bits = k[order], node[order], size[order], place[order], comp[order], bits[order]
        at = np.arange(len(k))
        begin = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else at
        length = np.diff(np.r_[begin, len(k)])
        first, end = np.repeat(begin, length), np.repeat(begin + length, length)
        run_begin = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (comp[1:] != comp[:-1])]) if len(k) else at
        run_length = np.diff(np.r_[run_begin, len(k)])
        nxt = np.repeat(run_begin + run_length, run_length)
        left = at[nxt < end] if not leaders_only else at[((end - first <= SMALL) | (at - first < LEADERS)) & (nxt < end)]
        n = (end - nxt)[left]
        total = np.cumsum(n)
        s = 0
        while s < len(left):
            e = max(s + 1, int(np.searchsorted(total, (total[s - 1] if s else 0) + (1 << 18), "right")))
            a = np.repeat(left[s:e], n[s:e])
            b = np.repeat(nxt[left[s:e]], n[s:e]) + np.arange(len(a)) - np.repeat(np.cumsum(n[s:e]) - n[s:e], n[s:e])
            # similarity 0.8 takes 4/9 of both sizes in common
            ok = 9 * np.minimum(size[a] - place[a], size[b] - place[b]) >= 4 * (size[a] + size[b])
            a, b = a[ok], b[ok]
            # a bit that only one side has is a shingle at least that only this side has
            mine, other = (np.bitwise_count(bits[x] & ~bits[y]).sum(axis=1).astype(np.int64) for x, y in ((a, b), (b, a)))
            ok = 9 * np.minimum(size[a] - mine, size[b] - other) >= 4 * (size[a] + size[b])
            pairs = np.unique(np.stack([np.minimum(node[a[ok]], node[b[ok]]), np.maximum(node[a[ok]], node[b[ok]])]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])
            s = e

    return rows.select("k", "node", "size", "place", "comp", "bits").repartition("k").mapInArrow(run, "a long, b long").distinct()


def crowded(rows: DataFrame) -> DataFrame:
    """node: nodes (k, node, comp) of large groups that hold several components."""
    of = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    return rows.join(of.where((F.col("n") > SMALL) & (F.col("lo") < F.col("hi"))).select("k"), "k").select("node").distinct()


def prefixes(texts: DataFrame) -> DataFrame:
    """k, node, size, place, bits: the rarest shingles of each node (node, text), as many as a pair at 0.8 needs to share one.

    Shingles are counted in ``SLOTS`` slots; those order them, and any order is right."""

    def hashes(text: str) -> np.ndarray:
        grams = shingles(text)
        return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(7)), np.uint64, len(grams))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                np.add.at(n, (hashes(t) % SLOTS).astype(np.int64), 1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["slot", "n"])

    found = texts.select("text").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1").toArrow()
    counts = np.ones(SLOTS, dtype=np.float32)
    counts[np.asarray(found.column(0))] = np.asarray(found.column(1))
    frequent = texts.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1 << 20):
                cols: list[list] = [[], [], [], []]
                bits: list[bytes] = []
                for node, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    h = hashes(t)
                    h = h[np.lexsort((h, frequent.value[(h % SLOTS).astype(np.int64)]))]
                    n = len(h) - -(-4 * len(h) // 5) + 1 if len(h) else 0
                    own = np.zeros(WORDS, dtype="<u8")
                    np.bitwise_or.at(own, ((h >> np.uint64(6)) % np.uint64(WORDS)).astype(np.int64), np.uint64(1) << (h & np.uint64(63)))
                    bits += [own.tobytes()] * n
                    for c, v in zip(cols, (h[:n].view(np.int64), np.full(n, node), np.full(n, len(h)), np.arange(n)), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([*[pa.array(np.concatenate(c)) for c in cols], pa.array(bits, pa.binary())], names=["k", "node", "size", "place", "bits"])

    return texts.select("node", "text").mapInArrow(run, "k long, node long, size long, place long, bits binary")


def needed(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """node, text of the nodes in ``keys`` (node, text_key)."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS)).cast("int")
    slots = np.zeros(SLOTS, dtype=bool)
    slots[np.asarray(keys.select(slot("text_key")).distinct().toArrow().column(0))] = True
    passed = docs.sparkSession.sparkContext.broadcast(slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.filter(pa.array(passed.value[np.asarray(batch.column(2))]))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["text_key", "text"])

    some = docs.select(text_key().alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    some = some.withColumn("slot", slot("text_key")).mapInArrow(run, "text_key string, text string")
    return keys.join(some, "text_key").groupBy("node").agg(F.first("text").alias("text"))


def texts_of(nodes: DataFrame, docs: DataFrame, keys: DataFrame) -> DataFrame:
    """node, text of ``nodes`` (node)."""
    return materialise(needed(docs, materialise(keys.join(nodes, "node"), "ends")), "texts")


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that are similar; a node of many pairs meets them in shares."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(32)))
    left = texts.withColumnRenamed("node", "a").join(salted.select("a", "salt").distinct(), "a").withColumnRenamed("text", "text_a")
    both = salted.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(left, ["a", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, grams = None, set()
        for batch in batches:
            for part in slices(batch):
                ok = []
                for a, x, y in zip(*(part.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                    if a != last:
                        last, grams = a, shingles(x)
                    ok.append(similar(grams, shingles(y)))
                found = part.filter(pa.array(ok, pa.bool_()))
                yield pa.RecordBatch.from_arrays([found.column(1), found.column(0)], names=["a", "b"])

    # an edge points from the larger number to the smaller, as ``components`` takes them
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def forest(root: DataFrame) -> DataFrame:
    """Edges that keep the components found so far."""
    return root.select(F.col("v").alias("a"), F.col("root").alias("b"))


def near_copies(docs: DataFrame) -> DataFrame:
    """text_key, component: one row per distinct text."""
    prints = materialise(signatures(docs), "signatures")
    nodes = prints.groupBy("node").agg(F.min("text_key").alias("text_key"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.min("fp").alias("fp"))
    keys = materialise(nodes, "nodes")
    rows = index(keys).withColumns({"place": F.lit(0).cast("long"), "bits": F.lit(b"")})
    prints_of, keys = keys.select("node", "fp"), keys.select("node", "text_key")
    comp = F.coalesce("root", "node")
    labelled = lambda r: r.join(root.withColumnRenamed("v", "node"), "node", "left").withColumn("comp", comp)
    near = materialise(alike(prints_of), "alike")
    root = components(verified(near, texts_of(ends(near), docs, keys)))
    near = materialise(meet(labelled(rows), True), "pairs")
    root = components(forest(root).unionByName(verified(near, texts_of(ends(near), docs, keys))))
    open_ = materialise(crowded(labelled(rows)), "crowded")
    if not open_.isEmpty():
        texts = texts_of(open_, docs, keys)
        rare = materialise(prefixes(texts), "prefixes")
        for leaders_only in (True, False):
            more = materialise(meet(labelled(rare), leaders_only), "pairs")
            root = components(forest(root).unionByName(verified(more, texts)))
    return prints.select("text_key", "node").distinct().join(root.withColumnRenamed("v", "node"), "node", "left").select("text_key", comp.alias("component"))
