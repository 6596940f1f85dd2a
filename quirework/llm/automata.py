"""Substring deduplication over words by suffix automata of reference shards.

The reference is the corpus itself, cut down to the distinct phrases whose trigger stands in two documents or more (see ``repeats``) and
sharded by trigger.  Equal phrases are settled by equality, with the smallest document id of their copies.  Phrases that share a trigger but
differ are built into suffix automata whose states carry the smallest document id of their occurrences, and stream through them for
matching statistics; windows whose match has the threshold's length and a smaller document are removed, as maximal
spans.  Phrases under a trigger with very many of them are settled window by window, by equality, without an automaton.

Where this departs from the name: no automaton is broadcast and whole documents do not stream through one, since all shards together grow with
the corpus; a phrase and the only automaton that can hold its windows are brought together by trigger instead.

Words are runs without space and U+0009 to U+000D, unchanged.  Edge cases: a null text has no words; texts of fewer words than the
window stay whole; rows that repeat an id do not remove each other's words; a row without an id neither loses words nor
takes any from others.  Extra columns are ignored.  An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import Finder, prefix_sums, spans_hash


class SuffixAutomaton:
    """Automaton of several word sequences; ``least[state]``: smallest id of a sequence that holds the state's strings."""

    def __init__(self):
        self.go: list[dict] = [{}]
        self.link, self.len, self.least = [-1], [0], [1 << 63]

    def _state(self, length: int, go: dict, link: int) -> int:
        self.go.append(go)
        self.len.append(length)
        self.link.append(link)
        self.least.append(1 << 63)
        return len(self.len) - 1

    def _split(self, p: int, w, q: int) -> int:
        """A copy of q for strings of length len(p) + 1, reached from p and its shorter suffixes."""
        c = self._state(self.len[p] + 1, dict(self.go[q]), self.link[q])
        self.link[q] = c
        while p >= 0 and self.go[p].get(w) == q:
            self.go[p][w] = c
            p = self.link[p]
        return c

    def add(self, words, doc_id: int) -> None:
        last = 0
        for w in words:
            q = self.go[last].get(w)
            if q is not None:
                last = q if self.len[q] == self.len[last] + 1 else self._split(last, w, q)
            else:
                new, p = self._state(self.len[last] + 1, {}, 0), last
                while p >= 0 and w not in self.go[p]:
                    self.go[p][w] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.go[p][w]
                    self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, w, q)
                last = new
            if doc_id < self.least[last]:
                self.least[last] = doc_id

    def finish(self) -> None:
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            p = self.link[v]
            if p > 0 and self.least[v] < self.least[p]:
                self.least[p] = self.least[v]

    def statistics(self, words):
        """State and length of the longest match that ends at each word."""
        v = n = 0
        for w in words:
            while v and w not in self.go[v]:
                v = self.link[v]
                n = self.len[v]
            if w in self.go[v]:
                v, n = self.go[v][w], n + 1
            yield v, n

    def windows(self, words, size: int) -> list[int]:
        """Smallest id of each window of ``size`` words."""
        out = []
        for v, n in self.statistics(words):
            if n >= size:
                while self.len[self.link[v]] >= size:
                    v = self.link[v]
                out.append(self.least[v])
        return out


class WordFinder(Finder):
    result = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64()))])
    ddl = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<long>"

    def __init__(self, size: int = 13, gram: int = 5):
        self.size, self.gram = size, gram

    def symbols(self, texts):
        raw = b"\n".join([*texts, b""])
        whole = np.frombuffer(raw, dtype=np.uint8)
        gap = (whole == 32) | ((whole >= 9) & (whole <= 13))
        edge = np.diff(np.concatenate([[1], gap.view(np.int8), [1]]))
        a, b = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        text_at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        hashed = spans_hash(prefix_sums(whole.astype(np.uint64) + np.uint64(1)), a, b)
        return hashed, np.searchsorted(a, text_at).astype(np.int64), (raw, a, b)

    def content(self, held, first, end):
        raw, a, b = held
        return [b" ".join(raw[x:y].split()) for x, y in zip(a[first].tolist(), b[end - 1].tolist(), strict=True)]

    def length(self, content):
        return content.count(b" ") + 1

    def solve(self, phrases, ids):
        """Phrases of whole triggers only come here, so that an automaton holds all that its windows can match."""
        auto, split = SuffixAutomaton(), [p.split(b" ") for p in phrases]
        for w, i in zip(split, ids, strict=True):
            auto.add(w, i)
        auto.finish()
        return [np.array(auto.windows(w, self.size), dtype=np.int64) for w in split]

    def cut(self, held, row, a, b, removed):
        raw, start, end = held
        edge = np.diff(np.concatenate([[0], removed.astype(np.int8), [0]]))
        spans = np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1)
        if a == b:
            kept = b""
        elif not len(spans):
            kept = b" ".join(raw[start[a] : end[b - 1]].split())
        else:
            cuts = [0, *spans.ravel().tolist(), b - a]
            kept = b" ".join(b" ".join(raw[start[a + x] : end[a + y - 1]].split()) for x, y in zip(cuts[::2], cuts[1::2], strict=True) if y > x)
        return b - a, int(removed.sum()), hashlib.sha256(kept).hexdigest(), spans.ravel().tolist()


def dedup_words(docs: DataFrame, size: int = 13, gram: int = 5) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans (removed word ranges: start, end, start, end, ...)."""
    return WordFinder(size, gram).run(docs)
