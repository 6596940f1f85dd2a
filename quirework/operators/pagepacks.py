"""Items of a page brought together as arrays: one exchange, however many columns and uses follow."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE = ["doc_id", "page_no"]
#: Items and output rows that a batch holds about.
ITEMS = 1 << 16


def changes(col: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before; the first one does."""
    if col.null_count:
        return changes(col.is_null().cast(pa.int8())) | changes(pc.fill_null(col, 0))
    v = col.to_numpy(zero_copy_only=False)
    return np.r_[True, v[1:] != v[:-1]]


def packed(items: DataFrame) -> DataFrame:
    """doc_id, page_no and an array for every other column: the items of a page that follow one another in a partition."""
    rest = [f for f in items.schema.fields if f.name not in PAGE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            first = np.flatnonzero(changes(b.column(0)) | changes(b.column(1)))
            offsets = pa.array(np.r_[first, b.num_rows].astype(np.int32))
            cols = [b.column(i).take(pa.array(first)) for i in (0, 1)]
            cols += [pa.ListArray.from_arrays(offsets, c) for c in b.columns[2:]]
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    ddl = [f"{c} {t}" for c, t in items.select(*PAGE).dtypes] + [f"{f.name} array<{f.dataType.simpleString()}>" for f in rest]
    return items.select(*PAGE, *[f.name for f in rest]).mapInArrow(run, ", ".join(ddl))


def struct_lists(values: list[tuple], kind: pa.ListType) -> pa.ListArray:
    """Lists of structs from tuples that hold a sequence for each field."""
    offsets = np.cumsum([0, *(len(v[0]) for v in values)]).astype(np.int32)
    fields = []
    for i, f in enumerate(kind.value_type):
        parts = [v[i] for v in values]
        flat = np.concatenate(parts) if parts and isinstance(parts[0], np.ndarray) else list(chain.from_iterable(parts))
        fields.append(pa.array(flat, f.type))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, fields=list(kind.value_type)))


def map_pages(items: DataFrame, fn: Callable[..., list[tuple]], schema: str, arrow: pa.Schema) -> DataFrame:
    """Rows of ``fn`` (doc_id and page_no put in front) for the columns of each page: arrays of numbers, lists of texts.

    Lists of structs come as tuples of sequences, one for each field.

    Consecutive items are packed before the one exchange, so it moves a row per page and not one per item.  No task holds more than
    a page besides its batch."""
    names = [c for c in items.columns if c not in PAGE]
    together = packed(items).repartition(*PAGE).sortWithinPartitions(*PAGE)

    def values(col: pa.Array) -> list | np.ndarray:
        return col.to_pylist() if pa.types.is_string(col.type) or col.null_count else col.to_numpy(zero_copy_only=False)

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            sizes = np.cumsum(pc.fill_null(pc.list_value_length(b.column(2)), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + ITEMS, "right")))
                part = b.slice(at, to - at)
                keys = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
                n = np.r_[0, sizes[at:to] - (sizes[at - 1] if at else 0)]
                cols = [values(part.column(i + 2).flatten()) for i in range(len(names))]
                for i, key in enumerate(keys):
                    yield key, [c[n[i] : n[i + 1]] for c in cols]
                at = to

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        last, held = None, []
        for key, cols in packs(batches):
            if held and key != last:
                yield last, held
                held = []
            last = key
            held.append(cols)
        if held:
            yield last, held

    def joined(parts: list) -> list | np.ndarray:
        if len(parts) == 1:
            return parts[0]
        if all(isinstance(p, np.ndarray) for p in parts):
            return np.concatenate(parts)
        return [v for p in parts for v in p]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for key, held in pages(batches):
            cols = [joined(c) for c in zip(*held, strict=True)]
            rows += [(*key, *r) for r in fn(*cols)]
            size += len(cols[0])
            if size >= ITEMS:
                yield made(rows)
                rows, size = [], 0
        if rows:
            yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        cols = zip(*rows, strict=True) if rows else [[] for _ in arrow]
        of_structs = [pa.types.is_list(f.type) and pa.types.is_struct(f.type.value_type) for f in arrow]
        made_of = [struct_lists(list(c), f.type) if s else pa.array(list(c), f.type) for c, f, s in zip(cols, arrow, of_structs, strict=True)]
        return pa.RecordBatch.from_arrays(made_of, schema=arrow)

    return together.mapInArrow(run, schema)


def map_parts(items: DataFrame, fn: Callable[..., pa.RecordBatch], schema: str) -> DataFrame:
    """``fn`` of some whole pages at a time: arrays of their doc_id and page_no, the places where each page's items begin (and
    the last one's end), and the columns of all their items.

    Items are collected before Python gets them: Spark works out the size of a batch anew at each of its rows, which takes
    longer than all else that handing over an item needs.  No task holds more than a page besides its batch."""
    rest = F.struct(*[c for c in items.columns if c not in PAGE])
    together = items.groupBy(*PAGE).agg(F.collect_list(rest).alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.r_[0, np.cumsum(pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False))]
            at = 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + ITEMS, "right")) - 1)
                part = b.slice(at, to - at)
                yield fn(part.column(0), part.column(1), sizes[at : to + 1] - sizes[at], *part.column(2).flatten().flatten())
                at = to

    return together.mapInArrow(run, schema)


def ordered(strs: list | np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Places sorted by ``keys``, the last one first, equals by text."""
    order = np.lexsort(keys)
    same = np.ones(max(len(order) - 1, 0), dtype=bool)
    for k in keys:
        s = np.asarray(k)[order]
        same &= s[1:] == s[:-1]
    if same.any():
        # null texts stand last
        rank = {s: i for i, s in enumerate(sorted({s for s in strs if s is not None}))}
        text = np.array([rank.get(s, len(rank)) for s in strs])
        order = np.lexsort((text, *keys))
    return order
