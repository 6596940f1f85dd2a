"""Bounded-space online best-fit packing of tokenised documents into sequences.

Documents are tokenised where they stand, and their pieces (numbers only, no text) are written to the shared folder.  Then pieces are dealt
evenly to tasks of about ``PER_TASK`` each, so the fill does not depend on how the input is cut; a task leaves ``open_bins`` sequences
open at its end at most.  In a task ``open_bins`` sequences are open at a time, their free space is the index of a bitset, and
the best fit is the lowest set bit at or above the piece's length.  When all are open and none fits, the fullest one
closes.  Within an Arrow batch longer pieces come first.  Sequence numbers are unique through the task's number.

A document longer than ``capacity`` is cut into pieces of ``capacity``; its first piece takes the remainder.  Ids are those of the
byte-level BPE file given; ``tokenizers`` files are read for their vocabulary and encoded with ``tiktoken``, whose ids are the
same and which is about four times as fast.  With ``added_tokens`` the file's added tokens in a text get their single ids, as
``tokenizers`` does with ``add_special_tokens=False`` unless told otherwise; without, their strings are ordinary text.

Edge cases: a null text is empty and gives the end id alone.  Repeated rows are packed as often as they occur; null ids stay null.
Extra columns are ignored.  An empty table gives an empty table.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.session import materialise

from .common import slices

#: Pieces that one task packs.
PER_TASK = 1 << 16
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in byte-level vocabularies: printable bytes for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def encoder(path: str):
    """Encoder of a byte-level BPE file whose ids are its merge ranks."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    for t in spec["added_tokens"]:
        if t["single_word"] or t["lstrip"] or t["rstrip"]:
            raise ValueError(f"added token {t['content']!r} takes in more than its string")
    special, letters = {t["content"] for t in spec["added_tokens"]}, byte_letters()
    ranks = {bytes(letters[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
    return tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in spec["added_tokens"]})


def tokens_of(enc, text: str | None, end_id: int, added_tokens: bool = False) -> np.ndarray:
    ids = (enc.encode(text, allowed_special="all") if added_tokens else enc.encode_ordinary(text)) if text else []
    return np.fromiter([*ids, end_id], dtype="<u4", count=len(ids) + 1)


class Bins:
    """Open sequences by free space: bit f of ``mask`` is set if ``free[f]`` is not empty."""

    def __init__(self, capacity: int, open_bins: int, first_id: int):
        self.capacity, self.open_bins, self.next_id = capacity, open_bins, first_id
        self.mask, self.count = 0, 0
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, f: int) -> int:
        s = self.free[f].pop()
        if not self.free[f]:
            self.mask &= ~(1 << f)
        self.count -= 1
        return s

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) for a piece of ``length``."""
        fits = self.mask >> length
        if fits:
            f = length + (fits & -fits).bit_length() - 1
            s = self._take(f)
        else:
            if self.count == self.open_bins:
                self._take((self.mask & -self.mask).bit_length() - 1)
            s, f = self.next_id, self.capacity
            self.next_id += 1
        if f > length:
            self.free[f - length].append(s)
            self.mask |= 1 << (f - length)
            self.count += 1
        return s, self.capacity - f


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, added_tokens: bool) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch):
                out = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = tokens_of(enc, text, end_id, added_tokens)
                    first = (len(ids) - 1) % capacity + 1
                    cuts = [0, *range(first, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        out.append((doc_id, k, a, b - a, zlib.crc32(ids[a:b])))
                types = (pa.int64(), pa.int32(), *[pa.int64()] * 3)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, open_bins: int = 1024, end_id: int = 2, added_tokens: bool = False, per_task: int = PER_TASK) -> DataFrame:
    """Columns of ``PIECES``, one row per piece of a document."""
    found = materialise(pieces(docs, tokenizer, capacity, end_id, added_tokens), "pieces")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = Bins(capacity, open_bins, TaskContext.get().partitionId() << 40)
        for batch in batches:
            longest_first = np.argsort(-np.asarray(batch.column(3)), kind="stable")
            part = batch.take(pa.array(longest_first))
            placed = [bins.place(n) for n in part.column(3).to_pylist()]
            sequence, offset = zip(*placed, strict=True) if placed else ((), ())
            names = [c.split()[0] for c in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=names)

    return found.repartition(max(1, math.ceil(found.count() / per_task))).mapInArrow(run, PIECES)
