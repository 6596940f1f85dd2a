"""Suffix-array deduplication of byte strings over a prefix-free parse.

Rolling-hash triggers cut the texts into phrases that overlap by ``size - 1`` bytes (see ``repeats``), so a byte string of the threshold's
length lies in one phrase, and equal strings lie at equal places of phrases with one trigger.  Equal phrases are settled by equality,
once for however many copies a phrase has in the corpus, with the smallest document of those in which the parse holds it.  Phrases that
share a trigger but differ are compared by sorting their strings of ``size`` bytes: neighbours that are equal form one class, whose smallest document
keeps its bytes.

Where this departs from the name: no suffix array of the whole dictionary nor of the parse is built, because order beyond the threshold's
length decides nothing here and the parse of a large corpus does not fit one task; only strings under one trigger are sorted.

Removed from a document is each byte covered by a string that also starts in a document with a smaller id; strings are judged on the
input.  Texts are UTF-8 bytes; matches never cross documents.

Edge cases: a null text is empty; texts shorter than ``size`` stay whole; rows that repeat an id do not remove each other's bytes; a
row without an id neither loses bytes nor takes any from others.  Extra columns are ignored.  An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import Finder


class ByteFinder(Finder):
    result = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64()))])
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>"

    def __init__(self, size: int = 50, gram: int = 16):
        self.size, self.gram = size, gram

    def symbols(self, texts):
        whole = np.frombuffer(b"".join(texts), dtype=np.uint8)
        return whole.astype(np.uint64) + np.uint64(1), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64), whole

    def content(self, held, first, end):
        raw = held.tobytes()
        return [raw[a:b] for a, b in zip(first.tolist(), end.tolist(), strict=True)]

    def length(self, content):
        return len(content)

    def solve(self, phrases, ids):
        size = self.size
        whole = np.frombuffer(b"".join(phrases), dtype=np.uint8)
        n = np.array([len(p) - size + 1 for p in phrases])
        begin = np.cumsum([0, *(len(p) for p in phrases)])[:-1]
        at = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        doc = np.repeat(np.array(ids, dtype=np.int64), n)
        suffix = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(whole, size)[at]).view(f"S{size}").ravel()
        order = np.argsort(suffix, kind="stable")  # dictionary suffixes in corpus order
        ranked = suffix[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])  # a common prefix shorter than the threshold
        least = np.minimum.reduceat(doc[order], np.flatnonzero(new))
        out = np.empty(len(at), dtype=np.int64)
        out[order] = least[np.cumsum(new) - 1]
        return np.split(out, np.cumsum(n)[:-1])

    def cut(self, held, row, a, b, removed):
        edge = np.diff(np.concatenate([[0], removed.astype(np.int8), [0]]))
        spans = np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1)
        kept = held[a:b][~removed] if len(spans) else held[a:b]
        return b - a, int(removed.sum()), len(spans), hashlib.sha256(kept.tobytes()).hexdigest(), spans.ravel().tolist()


def dedup_bytes(docs: DataFrame, size: int = 50, gram: int = 16) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed byte ranges: start, end, start, end, ...)."""
    return ByteFinder(size, gram).run(docs)
