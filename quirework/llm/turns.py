"""Conversation structure repair: cheapest edits that make the roles read ``(s?(ua)+)?``, by a run-length min-plus DP.

A row is a symbol: initial of its role (s, u, a, other) and fault (clean, truncated, to be deleted).  The edits of one row are a 4 x 4
min-plus matrix over the states of the pattern (start, after s, after u, after a), inserts before it included.  Equal consecutive
symbols are a run, and a run of n rows is advanced through cached binary powers of its matrix.  Choices are unrolled by halving a run along
the same powers: the costs to go at its middle are one product, so no table of all rows is kept.

Min-plus products are associative, so a conversation may be cut anywhere: rows are dealt by range of (conversation, turn, role, text)
into pieces, each piece's part of a conversation (a block) becomes one matrix, a scan over the blocks of each conversation
gives the costs to go at its end and the state it begins in, and blocks are then unrolled on their own.  A conversation with a third of
all rows is spread over its pieces, and equal rows of one turn are one row with a count.  Only conversations that cross a border between
pieces are scanned: there are fewer of them than pieces (shuffle partitions), so the driver scans their matrices, of 16 numbers each.

Edits: keep 0, rerole to user or assistant 3, delete 4, insert an empty user or assistant turn 3; a truncated row that is not deleted costs 3
more.  Blank rows (nothing but ASCII whitespace) and rows whose role and text were seen earlier in the conversation (told apart by MD5) must be
deleted.  Among cheapest edits the ASCII-least sequence of initials is taken (D, I, K, R); it fixes the roles.

Edge cases: rows are ordered by turn (nulls first), then role and MD5; a null role or text is one space; an empty role has no
initial; rows without conversation id are one conversation; extra columns are ignored.  An empty table gives empty tables.
``digests`` has to hash a conversation's texts in order and streams them through one task, holding its audit only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.session import materialise

from .common import slices

WS = " \t\n\x0b\x0c\r"
FAR = 1 << 60
CLEAN, TRUNCATED, BLANK, REPEATED = range(4)
#: States of the pattern: start, after s, after u, after a.
STATES = range(4)
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FILL = ("u", "u", "a", "u")
ENDS = (0, 3)
Matrix = tuple[tuple[int, ...], ...]
Vector = tuple[int, ...]
IN_ORDER = ("conv_id", "turn", "role", "digest")


def times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in STATES) for j in STATES) for i in STATES)


def apply(a: Matrix, v: Vector) -> Vector:
    return tuple(min(a[i][k] + v[k] for k in STATES) for i in STATES)


def _inserts() -> Matrix:
    rows = []
    for q in STATES:
        cost, at, paid = [FAR] * 4, q, 0
        while cost[at] == FAR:
            cost[at], at, paid = paid, NEXT[at][FILL[at]], paid + 3
        rows.append(tuple(cost))
    return tuple(rows)


INSERTS = _inserts()
NOTHING: Matrix = tuple(tuple(0 if i == j else FAR for j in STATES) for i in STATES)
#: Costs to go behind the last row.
END: Vector = tuple(min(INSERTS[q][e] for e in ENDS) for q in STATES)


@cache
def edits(initial: str, fault: int) -> tuple[tuple[tuple[str, int, int], ...], ...]:
    """Per state: letter, cost and next state of each edit of a row, inserts aside, in ASCII order."""
    more = 3 if fault == TRUNCATED else 0
    out = []
    for q in STATES:
        own = [("D", 4, q)]
        if fault < BLANK:
            own += [("K", more, NEXT[q][initial])] if initial in NEXT[q] else []
            own += [("R", 3 + more, NEXT[q][FILL[q]])]
        out.append(tuple(own))
    return tuple(out)


@cache
def power(initial: str, fault: int, j: int) -> Matrix:
    """Transition of 2^j equal rows."""
    if j:
        return times(power(initial, fault, j - 1), power(initial, fault, j - 1))
    one = [[FAR] * 4 for _ in STATES]
    for q, own in enumerate(edits(initial, fault)):
        for _, cost, to in own:
            one[q][to] = min(one[q][to], cost)
    return times(INSERTS, tuple(map(tuple, one)))


def run_matrix(initial: str, fault: int, n: int) -> Matrix:
    out = NOTHING
    for j in range(n.bit_length()):
        if n >> j & 1:
            out = times(out, power(initial, fault, j))
    return out


def one_row(initial: str, fault: int, q: int, after: Vector) -> tuple[str, str, int]:
    """Letters and filled roles (``-`` for none) of a row with the inserts before it, and the state behind it."""
    letters, fills, before = "", "", apply(power(initial, fault, 0), after)
    while True:
        best = {letter: to for letter, cost, to in reversed(edits(initial, fault)[q]) if cost + after[to] == before[q]}
        if "D" in best or 3 + before[NEXT[q][FILL[q]]] != before[q]:
            letter = min(best)
            return letters + letter, fills + (FILL[q] if letter == "R" else "-"), best[letter]
        letters, fills, q = letters + "I", fills + FILL[q], NEXT[q][FILL[q]]


def unroll(initial: str, fault: int, j: int, q: int, after: Vector, out: list) -> int:
    """Edits of 2^j equal rows, appended to ``out`` row by row."""
    if j == 0:
        letters, fills, q = one_row(initial, fault, q, after)
        out.append((letters, fills))
        return q
    half = power(initial, fault, j - 1)
    q = unroll(initial, fault, j - 1, q, apply(half, after), out)
    return unroll(initial, fault, j - 1, q, after, out)


def unroll_runs(runs: list[tuple[str, int, int]], q: int, after: Vector, out: list) -> int:
    """Edits of all rows of a block that begins in state ``q``, appended to ``out`` row by row; the state behind it."""
    parts = [(i, f, j) for i, f, n in runs for j in range(n.bit_length()) if n >> j & 1]
    to_go = [after]
    for i, f, j in reversed(parts):
        to_go.append(apply(power(i, f, j), to_go[-1]))
    for (i, f, j), v in zip(parts, reversed(to_go[:-1]), strict=True):
        q = unroll(i, f, j, q, v, out)
    return q


def fill_up(q: int) -> str:
    """Roles inserted behind the last row."""
    out = ""
    while q not in ENDS:
        out, q = out + FILL[q], NEXT[q][FILL[q]]
    return out


def lined_up(rows: DataFrame) -> DataFrame:
    """Rows in order: piece, seq (place in the piece), conv_id, turn, role, text, digest, copies (equal rows), fault, fresh (first of its role and text in the piece)."""
    own = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    end = F.right(F.rtrim("text", F.lit(WS)), F.lit(1))
    fault = F.when(end == "", BLANK).when(end.isin(*".!?"), CLEAN).otherwise(TRUNCATED)
    own = own.withColumn("digest", F.md5(F.concat("role", F.lit("\x00"), "text"))).withColumn("fault", fault)
    keys = [F.col(c).asc_nulls_first() for c in IN_ORDER]
    dealt = own.repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = "piece int, seq long, conv_id long, turn long, role string, text string, digest string, copies long, fault int, fresh boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, seq, seen, conv, held, copies = TaskContext.get().partitionId(), 0, set(), None, None, 0

        def out():
            row, _, fresh = held
            cols = [pa.array([piece], pa.int32()), pa.array([seq], pa.int64()), *(row.column(i) for i in range(5)), pa.array([copies], pa.int64()), row.column(5), pa.array([fresh])]
            return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in schema.split(", ")])

        for batch in batches:
            for part in slices(batch):
                done = []
                for i, key in enumerate(zip(*(part.column(c).to_pylist() for c in (0, 1, 2, 4)), strict=True)):
                    if held and held[1] == key:
                        copies += 1
                        continue
                    if held:
                        done.append(out())
                        seq += 1
                    if not held or conv != key[0]:
                        seen, conv = set(), key[0]
                    held, copies = (part.slice(i, 1), key, key[3] not in seen), 1
                    seen.add(key[3])
                if done:
                    yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if held:
            yield out()

    chosen = dealt.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", "digest", "fault")
    return materialise(chosen.mapInArrow(run, schema), "turns")


def repeated_elsewhere(rows: DataFrame) -> DataFrame:
    """piece, seq of rows whose role and text stand in an earlier piece of their conversation."""
    # a border between pieces is crossed by one conversation at most, so these are fewer than the pieces
    crossing = rows.groupBy("conv_id").agg(F.min("piece").alias("a"), F.max("piece").alias("b")).where("a < b").select(F.col("conv_id").alias("crossing"))
    some = rows.where(F.col("fresh") & (F.col("fault") != BLANK)).select("conv_id", "digest", "piece", "seq")
    some = some.join(F.broadcast(crossing), F.col("conv_id").eqNullSafe(F.col("crossing"))).drop("crossing")
    first = some.groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d")).agg(F.min("piece").alias("first"))
    both = some.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")))
    return both.where("piece > first").select("piece", "seq")


BLOCKS = (
    "piece int, no int, conv_id long, seq long, initials string, faults array<int>, sizes array<long>, copies array<long>, matrix array<long>,"
    " cost long, blank long, repeated long, truncated long, illegal long, head string, tail string, least long, most long, turns long"
)


def blocks(rows: DataFrame) -> DataFrame:
    """One row per piece and conversation: its runs, their product, its counts, and its cost if it were the whole conversation."""
    late = repeated_elsewhere(rows).withColumn("late", F.lit(True))
    initial = F.when(F.substring("role", 1, 1).isin(*"sua"), F.substring("role", 1, 1)).otherwise("-")
    own = rows.select("piece", "seq", "conv_id", "turn", initial.alias("initial"), "copies", "fault", "fresh").join(late, ["piece", "seq"], "left")
    fault = F.when((F.col("fault") != BLANK) & (~F.col("fresh") | F.col("late").isNotNull()), REPEATED).otherwise(F.col("fault"))
    own = own.select("piece", "seq", "conv_id", "turn", "initial", "copies", fault.alias("fault"))

    def block(no: int, piece: int, conv, rows: list) -> tuple:
        runs: list[list] = []
        copies, counts, illegal, turns, last = [], [0] * 4, 0, [], None
        for seq, turn, initial, n, fault in rows:
            for f, m in ((fault, n),) if fault >= BLANK or n == 1 else ((fault, 1), (REPEATED, n - 1)):
                counts[f] += m
                if runs and runs[-1][:2] == [initial, f]:
                    runs[-1][2] += m
                else:
                    runs.append([initial, f, m])
            illegal += n - 1 + (last is not None and last + initial not in ("su", "ua", "au"))
            copies.append(n)
            last = initial
            if turn is not None and (not turns or turns[-1] != turn):
                turns.append(turn)
        matrix = NOTHING
        for i, f, n in runs:
            matrix = times(matrix, run_matrix(i, f, n))
        initials, faults, sizes = zip(*runs, strict=True)
        head = (piece, no, conv, rows[0][0], "".join(initials), list(faults), list(sizes), copies, [x for r in matrix for x in r])
        return (*head, apply(matrix, END)[0], counts[BLANK], counts[REPEATED], counts[TRUNCATED], illegal, rows[0][2], last, turns[0] if turns else None, turns[-1] if turns else None, len(turns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        types += [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()] * 3
        names = [c.split()[0] for c in BLOCKS.split(", ")]
        key, held, done, no = None, [], [], 0

        def flush():
            cols = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

        for batch in batches:
            for piece, seq, conv, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and key != (piece, conv):
                    done.append(block(no, *key, held))
                    no, held = no + 1 if key[0] == piece else 0, []
                key = piece, conv
                held.append((seq, *rest))
            if done:
                yield flush()
                done = []
        if held:
            done.append(block(no, *key, held))
            yield flush()

    return materialise(own.repartition("piece").sortWithinPartitions("piece", "seq").mapInArrow(run, BLOCKS), "blocks")


def _of(runs) -> list[tuple[str, int, int]]:
    return list(zip(runs["initials"], runs["faults"], runs["sizes"], strict=True))


def scan(found: DataFrame) -> tuple[dict[tuple[int, int], tuple[int, Vector, bool]], list[tuple]]:
    """Of each block of a crossing conversation: state, costs to go and whether it is the last; and what the sums over blocks lack."""
    own = found.groupBy(F.col("conv_id").alias("crossing")).agg(F.count("*").alias("n")).where("n > 1").select("crossing")
    some = found.join(F.broadcast(own), F.col("conv_id").eqNullSafe(F.col("crossing"))).drop("crossing")
    rows = some.select("conv_id", "piece", "no", "matrix", "cost", "head", "tail", "least", "most").collect()
    of: dict = {}
    for r in sorted(rows, key=lambda r: r.piece):
        of.setdefault(r.conv_id, []).append(r)
    to_go: dict[tuple[int, int], Vector] = {}
    lacks = []
    for conv, parts in of.items():
        after = END
        for r in reversed(parts):
            to_go[r.piece, r.no] = after
            after = apply(tuple(tuple(r.matrix[4 * i : 4 * i + 4]) for i in STATES), after)
        illegal = sum(a.tail + b.head not in ("su", "ua", "au") for a, b in zip(parts, parts[1:], strict=False))
        dated = [r for r in parts if r.least is not None]
        shared = sum(a.most == b.least for a, b in zip(dated, dated[1:], strict=False))
        lacks.append((conv, after[0] - sum(r.cost for r in parts), illegal, -shared))
    if not to_go:
        return {}, []

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """State behind a block for each state before it."""
        for batch in batches:
            for r in batch.to_pylist():
                key = r["piece"], r["no"]
                ends = [end_state(_of(r), q, to_go[key]) for q in STATES]
                yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([ends], pa.list_(pa.int32()))], names=["piece", "no", "ends"])

    runs = some.select("piece", "no", "initials", "faults", "sizes")
    ends = {(r.piece, r.no): r.ends for r in runs.mapInArrow(leave, "piece int, no int, ends array<int>").collect()}
    placed = {}
    for parts in of.values():
        q = 0
        for r in parts:
            key = r.piece, r.no
            placed[key] = q, to_go[key], r is parts[-1]
            q = ends[key][q]
    return placed, lacks


def end_state(runs: list[tuple[str, int, int]], q: int, after: Vector) -> int:
    """State in which the least edits of a block end that begins in state ``q``."""
    out: list[tuple[str, str]] = []
    return unroll_runs(runs, q, after, out)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edited rows and a report, for ``rows`` (conv_id, turn, role, text).

    Edited rows: piece, seq, conv_id, turn, role, text, edits, fills; the order is that of (piece, seq), ``edits`` holds the initials of the
    row's edits (inserts before it and, on a conversation's last row, behind it; one delete, keep or rerole for each of its
    copies) and ``fills`` the role's initial of each insert and rerole, else ``-``.  Report: conv_id, gaps, blank, duplicate, truncated, illegal, cost.
    """
    turns = lined_up(rows)
    found = blocks(turns)
    placed, lacks = scan(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            piece, seq, letters, fills = [], [], [], []
            for r in batch.to_pylist():
                q, after, last = placed.get((r["piece"], r["no"]), (0, END, True))
                done: list[tuple[str, str]] = []
                q = unroll_runs(_of(r), q, after, done)
                at = 0
                for n in r["copies"]:
                    letters.append("".join(x for x, _ in done[at : at + n]))
                    fills.append("".join(x for _, x in done[at : at + n]))
                    at += n
                tail = fill_up(q) if last else ""
                letters[-1], fills[-1] = letters[-1] + "I" * len(tail), fills[-1] + tail
                piece += [r["piece"]] * len(r["copies"])
                seq += range(r["seq"], r["seq"] + len(r["copies"]))
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(seq, pa.int64()), pa.array(letters, pa.string()), pa.array(fills, pa.string())], names=["piece", "seq", "edits", "fills"])

    chosen = found.select("piece", "no", "seq", "initials", "faults", "sizes", "copies").mapInArrow(run, "piece int, seq long, edits string, fills string")
    edited = turns.select("piece", "seq", "conv_id", "turn", "role", "text").join(chosen, ["piece", "seq"])
    sums = found.select("conv_id", "cost", "illegal", "turns", "blank", "repeated", "truncated", "least", "most")
    if lacks:
        sums = sums.unionByName(rows.sparkSession.createDataFrame(lacks, "conv_id long, cost long, illegal long, turns long"), allowMissingColumns=True)
    number = lambda c: F.coalesce(F.sum(c), F.lit(0))
    span = F.max("most").cast("decimal(38,0)") - F.min("least") + 1 - F.sum("turns")
    gaps = F.least(F.coalesce(span, F.lit(0)), F.lit((1 << 63) - 1)).cast("long")
    report = sums.groupBy("conv_id").agg(
        gaps.alias("gaps"), number("blank").alias("blank"), number("repeated").alias("duplicate"), number("truncated").alias("truncated"), number("illegal").alias("illegal"), number("cost").alias("cost")
    )
    return edited, report


def repaired(edited: DataFrame) -> DataFrame:
    """The repaired conversations: piece, seq, place (order), conv_id, turn, role, text; inserted rows have no turn."""
    at = F.posexplode(F.split("edits", "")).alias("place", "edit")
    some = edited.select("*", at).where("edit IN ('K', 'R', 'I')")
    fill = F.when(F.substring("fills", F.col("place") + 1, F.lit(1)) == "u", "user").otherwise("assistant")
    kept = F.col("edit") == "K"
    return some.select(
        "piece", "seq", "place", "conv_id",
        F.when(F.col("edit") != "I", F.col("turn")).alias("turn"),
        F.when(kept, F.col("role")).otherwise(fill).alias("role"),
        F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"),
    )


def digests(edited: DataFrame) -> DataFrame:
    """conv_id, audit, repaired_sha256 (of ``role:text`` lines)."""
    own = edited.repartition("conv_id").sortWithinPartitions("conv_id", "piece", "seq")
    roles = {"u": "user", "a": "assistant"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, digest, lines, done = None, None, None, 0, []

        def out():
            cols = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string()), strict=True)], names=["conv_id", "audit", "repaired_sha256"])

        for batch in batches:
            for part in slices(batch):
                for c, role, text, edits, fills in zip(*(x.to_pylist() for x in part.columns), strict=True):
                    if audit is None or c != conv:
                        if audit is not None:
                            done.append((conv, "".join(audit), digest.hexdigest()))
                        conv, audit, digest, lines = c, [], hashlib.sha256(), 0
                    audit.append(edits)
                    for e, f in zip(edits, fills, strict=True):
                        if e != "D":
                            line = f"{role if e == 'K' else roles[f]}:{'' if e == 'I' else text}"
                            digest.update(("\n" * (lines > 0) + line).encode("utf-8", "surrogatepass"))
                            lines += 1
                if done:
                    yield out()
                    done = []
        if audit is not None:
            done.append((conv, "".join(audit), digest.hexdigest()))
            yield out()

    return own.select("conv_id", "role", "text", "edits", "fills").mapInArrow(run, "conv_id long, audit string, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with the faults that CRC-32 of ``conv_id:turn`` deals out; nulls are one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    no = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    new_text = F.when(no == 1, "").when(no == 2, F.translate(text("text"), ".!?", "")).otherwise(text("text"))
    new_role = F.when(no == 4, "user").otherwise(text("role"))
    own = rows.where(no != 0).select("conv_id", "turn", new_role.alias("role"), new_text.alias("text"), F.when(no == 3, 2).otherwise(1).alias("n"))
    return own.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("n"))).alias("copy")).drop("copy")
