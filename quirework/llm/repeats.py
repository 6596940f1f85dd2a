"""Strings of a fixed number of symbols that also start in a document with a smaller id, found without all pairs.

The exact plan that the two substring operators share; a symbol is a byte or a word.  Texts are dealt into chunks, and only digests,
short phrases and answers travel between chunks and shards:

1. *Parse.*  A rolling hash over ``gram`` symbols is taken at every place.  Each string of ``size`` symbols is triggered by the
   smallest hash in it (leftmost of equal ones), consecutive strings with one trigger form a phrase, and phrases overlap by
   ``size - 1`` symbols: every string lies in one phrase, and equal strings have equal triggers at equal places.
2. *Triggers.*  Chunks send their distinct trigger hashes to shards (by hash), which answer with two bits: whether a trigger stands in two
   documents or more, and whether it has very many phrases.
3. *Dictionary.*  Chunks send their distinct phrases with such triggers, with smallest and largest id.  A shard unites equal phrases and
   takes the smallest id; phrases that share a trigger but differ are compared string by string by the operator's own
   ``solve``.  Phrases under a trigger that has very many are sent string by string to shards by their own hash, so that
   the ends of a passage with a third of all documents spread.
4. *Cut.*  Shards answer with runs of strings and the smallest id of each; chunks mark what is covered and cut their texts.

Whatever is sent is distinct within its chunk, told apart by 64-bit hashes: a group of copies costs one entry per chunk.  In a shard phrases are
compared by their bytes.  ``WIDE`` only chooses how strings under one trigger meet, the result is the same for any value.
"""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A trigger with about this many phrases, counted as distinct within each chunk, has its strings dealt out one by one.
WIDE = 20_000
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64
_BLOB = pa.schema([("chunk", pa.int64()), ("shard", pa.int64()), ("blob", pa.binary())])


@lru_cache(maxsize=2)
def _powers(log: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    n, out = 1 << log, []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        a = np.full(n, b, dtype=_U)
        a[0] = 1
        out.append(np.cumprod(a, dtype=_U))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(20, n.bit_length()))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(31))


def prefix_sums(symbols: np.ndarray) -> np.ndarray:
    out = np.zeros(len(symbols) + 1, dtype=_U)
    np.cumsum(symbols * powers(len(symbols))[0][: len(symbols)], out=out[1:])
    return out


def spans_hash(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the symbols a..b of each span, wherever they stand."""
    return mix((sums[b] - sums[a]) * powers(len(sums))[1][a] + (b - a).astype(_U))


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    n, m, s = len(v) - width + 1, v, 1
    while s * 2 <= width:
        m = np.minimum(m[:-s], m[s:])
        s *= 2
    return np.minimum(m[:n], m[width - s : width - s + n])


class Parsed:
    """Phrases of a run of texts: first string, number of strings, trigger hash, phrase hash, row of the text."""

    def __init__(self, symbols: np.ndarray, bounds: np.ndarray, size: int, gram: int):
        width = size - gram + 1
        n = len(symbols) - size + 1
        empty = np.zeros(0, dtype=np.int64)
        self.first, self.count, self.row = empty, empty, empty
        self.trigger = self.hash = np.zeros(0, dtype=_U)
        if n <= 0:
            return
        sums = prefix_sums(symbols)
        at = len(symbols) - gram + 1
        h = mix((sums[gram:] - sums[:-gram]) * powers(len(sums))[1][:at])
        low = _U(len(symbols).bit_length())
        place = sliding_min(((h >> low) << low) | np.arange(at, dtype=_U), width) & ((_U(1) << low) - _U(1))
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        valid = row[:n] == row[size - 1 :]
        new = np.ones(n, dtype=bool)
        new[1:] = (place[1:] != place[:-1]) | (valid[1:] != valid[:-1]) | (row[1:n] != row[: n - 1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, n))
        ok = valid[first]
        self.first, self.count = first[ok], count[ok]
        self.row = row[self.first]
        self.trigger = h[place[self.first].astype(np.int64)]
        self.hash = spans_hash(sums, self.first, self.first + self.count + size - 1)
        self.sums = sums


class Finder(ABC):
    """What an operator adds: its symbols, the bytes of a phrase, how differing phrases are compared, and the cut."""

    size: int
    gram: int
    result: pa.Schema
    ddl: str

    @abstractmethod
    def symbols(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, object]:
        """Symbols of all texts, where each text begins (and the end), and what ``content`` and ``cut`` need."""

    @abstractmethod
    def content(self, held, first: np.ndarray, end: np.ndarray) -> list[bytes]:
        """Bytes that tell spans of symbols apart."""

    @abstractmethod
    def length(self, content: bytes) -> int:
        """Symbols of a content."""

    @abstractmethod
    def solve(self, phrases: list[bytes], ids: list[int]) -> list[np.ndarray]:
        """For each phrase the smallest id of each of its strings among all phrases."""

    @abstractmethod
    def cut(self, held, row: int, a: int, b: int, removed: np.ndarray) -> tuple:
        """Result columns after doc_id for the text whose symbols are a..b."""

    # ---- parsing a chunk

    def groups(self, rows: pa.Table, room: int = 1 << 19) -> Iterator[tuple[list, list[bytes]]]:
        """Texts of a chunk in a fixed order, about ``room`` bytes at a time."""
        ids = rows.column("doc_id").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        texts, held, size = rows.column("text"), [], 0
        for i in order:
            t = texts[i].as_py() or b""
            held.append((ids[i], t))
            size += len(t)
            if size >= room:
                yield [h[0] for h in held], [h[1] for h in held]
                held, size = [], 0
        if held:
            yield [h[0] for h in held], [h[1] for h in held]

    def parse(self, rows: pa.Table):
        """For each run of texts: ids, what belongs to the texts, text bounds, phrases.  Texts without an id have no phrases."""
        for ids, texts in self.groups(rows):
            symbols, bounds, held = self.symbols(texts)
            p = Parsed(symbols, bounds, self.size, self.gram)
            known = np.array([i is not None for i in ids], dtype=bool)
            number = np.array([i if i is not None else 0 for i in ids], dtype=np.int64)
            ok = known[p.row] if len(p.row) else np.zeros(0, bool)
            p.first, p.count, p.row, p.trigger, p.hash = p.first[ok], p.count[ok], p.row[ok], p.trigger[ok], p.hash[ok]
            yield ids, number, held, bounds, p

    def phrases(self, rows: pa.Table):
        parts = list(self.parse(rows))
        cat = lambda f, t: np.concatenate([f(x) for x in parts]) if parts else np.zeros(0, t)
        return parts, cat(lambda x: x[4].trigger, _U), cat(lambda x: x[4].hash, _U), cat(lambda x: x[1][x[4].row] if len(x[4].row) else np.zeros(0, np.int64), np.int64)

    @staticmethod
    def keys(trigger: np.ndarray, doc: np.ndarray, hashed: np.ndarray, shards: int):
        """Distinct triggers by shard: shard, 43-bit key, whether in two documents of the chunk, log of the number of phrases;
        and each phrase's index among them."""
        t, inverse = np.unique(trigger, return_inverse=True)
        low, high = np.full(len(t), np.iinfo(np.int64).max), np.full(len(t), np.iinfo(np.int64).min)
        np.minimum.at(low, inverse, doc)
        np.maximum.at(high, inverse, doc)
        by = np.lexsort((hashed, inverse))
        new = np.concatenate([[True], (np.diff(inverse[by]) != 0) | (hashed[by][1:] != hashed[by][:-1])])
        log = np.minimum(15, np.ceil(np.log2(np.bincount(inverse[by][new], minlength=len(t))))).astype(np.int64)
        shard, key = (t % _U(shards)).astype(np.int64), (t // _U(shards)) & _U((1 << 43) - 1)
        order = np.lexsort((key, shard))
        return shard[order], key[order], (low < high)[order], log[order], np.argsort(order)[inverse]

    # ---- the steps

    def send_triggers(self, chunk: int, rows: pa.Table, shards: int) -> pa.Table:
        sent = [(p.trigger, number[p.row] if len(p.row) else np.zeros(0, np.int64), p.hash) for _, number, _, _, p in self.parse(rows)]
        trigger, doc, hashed = (np.concatenate([x[i] for x in sent]) if sent else np.zeros(0, np.int64) for i in range(3))
        if not len(trigger):
            return _BLOB.empty_table()
        shard, key, twice, log, _ = self.keys(trigger, doc, hashed, shards)
        packed = (key << _U(5) | log.astype(_U) << _U(1) | twice.astype(_U)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        at = np.searchsorted(shard, np.unique(shard))
        return pa.table([pa.array([chunk] * len(at), pa.int64()), pa.array(shard[at]), [x.tobytes() for x in np.split(packed, at[1:])] if len(at) else []], schema=_BLOB)

    @staticmethod
    def answer_triggers(shard: int, rows: pa.Table) -> pa.Table:
        """Two bits for each trigger sent: in two documents, with more than ``WIDE`` phrases."""
        chunks, parts = rows.column("chunk").to_pylist(), []
        for b in rows.column("blob"):
            raw = np.frombuffer(b.as_buffer(), dtype=np.uint8).reshape(-1, 6)
            whole = np.zeros((len(raw), 8), dtype=np.uint8)
            whole[:, :6] = raw
            parts.append(whole.view("<u8").ravel())
        sent = np.concatenate(parts)
        _, inverse, n = np.unique(sent >> _U(5), return_inverse=True, return_counts=True)
        twice = n > 1
        twice[inverse[(sent & _U(1)) == 1]] = True
        many = np.bincount(inverse, weights=2.0 ** ((sent >> _U(1)) & _U(15)).astype(np.int64)) > WIDE
        bits = np.stack([twice[inverse], many[inverse]], axis=1)
        at = np.cumsum([0, *map(len, parts)])
        return pa.table([pa.array(chunks, pa.int64()), pa.array([shard] * len(chunks), pa.int64()), [np.packbits(bits[a:b].ravel()).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]], schema=_BLOB)

    def send_phrases(self, chunk: int, rows: pa.Table, answers: pa.Table, shards: int) -> pa.Table:
        parts, trigger, hashed, doc = self.phrases(rows)
        if not len(trigger):
            return _BLOB.empty_table()
        shard, _, _, _, index = self.keys(trigger, doc, hashed, shards)
        twice, wide = np.zeros(len(shard), dtype=bool), np.zeros(len(shard), dtype=bool)
        for s, b in zip(answers.column("shard").to_pylist(), answers.column("blob").to_pylist(), strict=True):
            a, e = np.searchsorted(shard, [s, s + 1])
            bits = np.unpackbits(np.frombuffer(b, dtype=np.uint8))[: 2 * (e - a)].reshape(-1, 2)
            twice[a:e], wide[a:e] = bits[:, 0], bits[:, 1]
        _, one, inverse = np.unique(hashed, return_index=True, return_inverse=True)
        low, high = np.full(len(one), np.iinfo(np.int64).max), np.full(len(one), np.iinfo(np.int64).min)
        np.minimum.at(low, inverse, doc)
        np.maximum.at(high, inverse, doc)
        send = twice[index[one]]
        out: list[tuple] = []  # shard, key, phrase, first string, ids, content
        at = 0
        for _, _, held, _, p in parts:
            mine = np.flatnonzero(send & (one >= at) & (one < at + len(p.first)))
            k = one[mine] - at
            for far in (False, True):
                w = wide[index[one[mine]]] == far
                u, j = mine[w], k[w]
                if not len(u):
                    continue
                if far:  # string by string
                    n = p.count[j]
                    off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    u, first = np.repeat(u, n), np.repeat(p.first[j], n) + off
                    key = spans_hash(p.sums, first, first + self.size)
                    end = first + self.size
                else:
                    off, first, end, key = np.zeros(len(u), np.int64), p.first[j], p.first[j] + p.count[j] + self.size - 1, p.trigger[j]
                out.append(((key % _U(shards)).astype(np.int64), key, u, off, low[u], high[u], self.content(held, first, end)))
            at += len(p.first)
        if not out:
            return _BLOB.empty_table()
        to, key, u, off, lo, hi = (np.concatenate([o[i] for o in out]) for i in range(6))
        content = [c for o in out for c in o[6]]
        order = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[order], np.unique(to))
        blobs, packer = [], zstandard.ZstdCompressor(level=1)
        for part in np.split(order, cuts[1:]):
            mine = [content[i] for i in part]
            head = np.array([len(part)], dtype="<i8").tobytes()
            blob = head + b"".join(x[part].astype("<i8").tobytes() for x in (key.view(np.int64), lo, hi - lo)) + b"".join(x.astype("<u4").tobytes() for x in (u[part], off[part], np.array([len(c) for c in mine]))) + b"".join(mine)
            blobs.append(packer.compress(blob))
        return pa.table([pa.array([chunk] * len(blobs), pa.int64()), pa.array(np.unique(to)), blobs], schema=_BLOB)

    def answer_phrases(self, shard: int, rows: pa.Table) -> pa.Table:
        """Runs (phrase, first string, strings, smallest id) that matter to each chunk."""
        number: dict[bytes, int] = {}
        keys, entries = [], []
        unpacker = zstandard.ZstdDecompressor()
        for packed in rows.column("blob"):
            b = unpacker.decompress(packed.as_buffer())
            n = int(np.frombuffer(b, "<i8", 1)[0])
            key, lo, span = np.frombuffer(b, "<i8", 3 * n, 8).reshape(3, n)
            hi = lo + span
            u, off, size = np.frombuffer(b, "<u4", 3 * n, 8 + 24 * n).reshape(3, n)
            at, mine = 8 + 36 * n, np.zeros(n, dtype=np.int64)
            for i, z in enumerate(size.tolist()):
                c = b[at : at + z]
                at += z
                mine[i] = got = number.setdefault(c, len(number))
                if got == len(keys):
                    keys.append(key[i])
            entries.append((u, off, lo, hi, mine))
        contents = list(number)
        least = np.full(len(contents), np.iinfo(np.int64).max)
        for _, _, lo, _, mine in entries:
            np.minimum.at(least, mine, lo)
        n_strings = np.array([self.length(c) - self.size + 1 for c in contents], dtype=np.int64)
        runs = {}
        order = np.argsort(np.array(keys), kind="stable")
        edges = np.flatnonzero(np.diff(np.array(keys)[order], prepend=np.array(keys)[order[:1]] + 1, append=np.array(keys)[order[-1:]] + 1))
        batch: list[int] = []

        def compare():
            if not batch:
                return
            for c, ids in zip(batch, self.solve([contents[c] for c in batch], [int(least[c]) for c in batch]), strict=True):
                if (ids < least[c]).any():
                    cut = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1, append=ids[-1] - 1))
                    runs[c] = (cut[:-1], np.diff(cut), ids[cut[:-1]])
            batch.clear()

        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a > 1:
                batch.extend(order[a:b].tolist())
                if len(batch) > 4000:
                    compare()
        compare()
        special = np.zeros(len(contents), dtype=bool)
        special[list(runs)] = True
        out = []
        for u, off, _, hi, mine in entries:
            plain = ~special[mine] & (least[mine] < hi)
            cols = [[u[plain]], [off[plain]], [n_strings[mine[plain]]], [least[mine[plain]]]]
            for i in np.flatnonzero(special[mine]):
                first, n, ids = runs[mine[i]]
                use = ids < hi[i]
                for col, x in zip(cols, (np.full(use.sum(), u[i]), off[i] + first[use], n[use], ids[use]), strict=True):
                    col.append(x)
            whole = [np.concatenate(c) for c in cols]
            out.append(b"".join(x.astype(t).tobytes() for x, t in zip(whole, ("<u4", "<u4", "<u4", "<i8"), strict=True)))
        return pa.table([rows.column("chunk"), pa.array([shard] * len(out), pa.int64()), pa.array(out, pa.binary())], schema=_BLOB)

    def finish(self, rows: pa.Table, answers: pa.Table) -> pa.Table:
        parts, _, hashed, doc = self.phrases(rows)
        runs = [np.zeros(0, np.int64)] * 4
        if answers.num_rows:
            got = []
            for b in answers.column("blob").to_pylist():
                n = len(b) // 20
                got.append((*np.frombuffer(b, "<u4", 3 * n).reshape(3, n).astype(np.int64), np.frombuffer(b, "<i8", n, 12 * n)))
            runs = [np.concatenate([g[i] for g in got]) for i in range(4)]
        _, inverse, n = np.unique(hashed, return_inverse=True, return_counts=True)
        order = np.argsort(inverse, kind="stable")
        begin = np.cumsum(n) - n
        u, off, count, least = runs
        times = n[u] if len(u) else u
        pick = np.repeat(np.arange(len(u)), times)
        where = order[np.repeat(begin[u], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)] if len(u) else u
        later = doc[where] > least[pick] if len(u) else np.zeros(0, bool)
        pick, where = pick[later], where[later]
        at, cols = 0, []
        for ids, _, held, bounds, p in parts:
            mine = (where >= at) & (where < at + len(p.first))
            edge = np.zeros(bounds[-1] + 1, dtype=np.int32)
            a = p.first[where[mine] - at] + off[pick[mine]]
            np.add.at(edge, a, 1)
            np.add.at(edge, a + count[pick[mine]] + self.size - 1, -1)
            removed = np.cumsum(edge[:-1]) > 0
            for i, doc_id in enumerate(ids):
                cols.append((doc_id, *self.cut(held, i, int(bounds[i]), int(bounds[i + 1]), removed[bounds[i] : bounds[i + 1]])))
            at += len(p.first)
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*cols), self.result, strict=True)], schema=self.result) if cols else self.result.empty_table()

    def run(self, docs: DataFrame, chunk_bytes: int = 4 << 20, shard_bytes: int = 12 << 20) -> DataFrame:
        """One row per row of ``docs`` (doc_id, text)."""
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
        total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        chunks, shards = max(1, math.ceil(total / chunk_bytes)), max(1, math.ceil(total / shard_bytes))
        dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks))).repartition(chunks, "chunk")
        ddl = "chunk long, shard long, blob binary"
        me = self
        triggers = dealt.groupBy("chunk").applyInArrow(lambda key, t: me.send_triggers(key[0].as_py(), t, shards), ddl)
        known = triggers.groupBy("shard").applyInArrow(lambda key, t: me.answer_triggers(key[0].as_py(), t), ddl).repartition(chunks, "chunk")
        phrases = dealt.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(lambda key, a, b: me.send_phrases(key[0].as_py(), a, b, shards), ddl)
        answers = phrases.groupBy("shard").applyInArrow(lambda key, t: me.answer_phrases(key[0].as_py(), t), ddl).repartition(chunks, "chunk")
        return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda key, a, b: me.finish(a, b), self.ddl)
