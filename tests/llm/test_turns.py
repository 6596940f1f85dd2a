import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from quirework.llm import queries, turns

SF = "/root/testdata/sf0.001"
WS = " \t\n\x0b\x0c\r"
TYPE = "conv_id long, turn long, role string, text string, piece int, audit string"


def slow_edits(symbols: list[tuple[str, str]]) -> tuple[int, str, list]:
    """Cheapest cost, least audit and result (None for a deleted row) by a plain DP that keeps whole audits."""
    legal = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "", ())}

    def inserted(states):
        out = dict(states)
        for _ in range(4):
            for q, (cost, audit, kept) in list(out.items()):
                for x in "ua":
                    if (q, x) in legal:
                        new = (cost + 3, audit + "I", (*kept, ("I", x)))
                        if x not in out or new[:2] < out[x][:2]:
                            out[x] = new
        return out

    # exact ASCII order of whole audits needs all prefixes of equal length only; costs first
    for role, fault in symbols:
        new: dict = {}
        for q, (cost, audit, kept) in inserted(best).items():
            more = 3 if fault == "truncated" else 0
            options = [("D", 4, q, None)]
            if fault not in ("blank", "duplicate"):
                options += [("K", more, role, "K")] if (q, role) in legal else []
                options += [("R", 3 + more, x, x) for x in "ua" if (q, x) in legal]
            for letter, price, to, what in options:
                made = (cost + price, audit + letter, (*kept, (letter, what)))
                if to not in new or made[:2] < new[to][:2]:
                    new[to] = made
        best = new
    ends = inserted(best)
    return min((v for q, v in ends.items() if q in ("", "a")), key=lambda v: v[:2])


def every_edit(symbols: list[tuple[str, str]]) -> tuple[int, str]:
    """The same by trying all edit sequences with up to three inserts in each gap."""
    out = []
    choices = [[("D", 4)] if f in ("blank", "duplicate") else [("D", 4), ("K", 3 * (f == "truncated")), ("Ru", 3 + 3 * (f == "truncated")), ("Ra", 3 + 3 * (f == "truncated"))] for _, f in symbols]
    gaps = ["", "u", "a", "ua", "au"]
    for picked in product(*choices):
        for fills in product(gaps, repeat=len(symbols) + 1):
            word, audit, cost = "", "", 0
            for (role, _), (letter, price), fill in zip(symbols, picked, fills, strict=False):
                word += fill + {"D": "", "K": role}.get(letter, letter[-1])
                audit += "I" * len(fill) + letter[0]
                cost += price + 3 * len(fill)
            word, audit, cost = word + fills[-1], audit + "I" * len(fills[-1]), cost + 3 * len(fills[-1])
            if re.fullmatch(r"(s?(ua)+)?", word):
                out.append((cost, audit))
    return min(out)


def damage(rows):
    for conv, turn, role, text in rows:
        conv_s, turn_s = (" " if x is None else str(x) for x in (conv, turn))
        role, text = role if role is not None else " ", text if text is not None else " "
        no = zlib.crc32(f"{conv_s}:{turn_s}".encode()) % 20
        if no == 0:
            continue
        text = "" if no == 1 else re.sub(r"[.!?]", "", text) if no == 2 else text
        yield from [(conv, turn, "user" if no == 4 else role, text)] * (2 if no == 3 else 1)


def slow(rows, damage=damage):
    out = []
    changed = list(damage(rows))
    for conv in {r[0] for r in rows}:
        order = lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(f"{r[2]}\0{r[3]}".encode()).hexdigest())
        mine = sorted((r for r in changed if r[0] == conv), key=order)
        seen, faults = set(), []
        for _, _, role, text in mine:
            fault = "blank" if not text.strip(WS) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(WS)[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
        turn = sorted({r[1] for r in mine if r[1] is not None})
        gaps = turn[-1] - turn[0] + 1 - len(turn) if turn else 0
        initials = [r[2][:1] if r[2][:1] in "sua" else "-" for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, kept = slow_edits(list(zip(initials, faults, strict=True)))
        lines, at = [], iter(mine)
        for letter, what in kept:
            row = next(at) if letter != "I" else None
            if letter == "K":
                lines.append(f"{row[2]}:{row[3]}")
            elif letter != "D":
                lines.append(f"{'user' if what == 'u' else 'assistant'}:{row[3] if row else ''}")
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha))
    return sorted(out, key=str)


def found(spark, rows, monkeypatch, change=False):
    data = spark.createDataFrame([(*r, 7, "x") for r in rows], TYPE).repartition(3)
    monkeypatch.setattr(queries, "table", lambda *_: data)
    if not change:
        monkeypatch.setattr(turns, "damaged", lambda r: r)
    return sorted(map(tuple, queries.op12_turns(spark, "").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()), key=str)


def some_rows(seed, n_convs, n_rows=9):
    r = random.Random(seed)
    roles = ["user"] * 4 + ["assistant"] * 4 + ["system", "sys", "tool", "", None, "User"]
    texts = ["Yes.", "no", "Why?", "", " \n", "Ärger!", "ok.  \n", None, "a.b", "x ", "One.", "Two."]
    out = []
    for c in range(n_convs):
        for _ in range(r.randint(1, n_rows)):
            out.append((c if c else None, r.choice([None, *range(6)]), r.choice(roles), r.choice(texts)))
    return out


def test_least_edits_of_short_conversations():
    r = random.Random(5)
    for _ in range(60):
        rows = [(r.choice("sua-"), r.choice(["", "", "truncated", "blank"])) for _ in range(r.randint(0, 3))]
        assert slow_edits(rows)[:2] == every_edit(rows)


@pytest.mark.parametrize("seed", range(30))
def test_runs_equal_row_by_row(seed):
    r = random.Random(seed)
    faults = ["", "truncated", "blank", "duplicate"]
    runs = [(r.choice("sua-"), r.randint(0, 3), r.choice([1, 1, 2, 3, r.randint(1, 40)])) for _ in range(r.randint(1, 6))]
    rows = [(i, faults[f]) for i, f, n in runs for _ in range(n)]
    matrix = turns.NOTHING
    for x in runs:
        matrix = turns.times(matrix, turns.run_matrix(*x))
    done: list = []
    q = turns.unroll_runs(runs, 0, turns.END, done)
    tail = turns.fill_up(q)
    cost, audit, _ = slow_edits(rows)
    assert (turns.apply(matrix, turns.END)[0], "".join(x for x, _ in done) + "I" * len(tail)) == (cost, audit)


def test_rows_with_nulls_ties_and_clashing_columns(spark, monkeypatch):
    rows = some_rows(1, 60)
    assert found(spark, rows, monkeypatch) == slow(rows, lambda x: [(c, t, " " if a is None else a, " " if b is None else b) for c, t, a, b in x])


def test_damage_and_lost_conversations(spark, monkeypatch):
    rows = some_rows(2, 80, 3)
    assert found(spark, rows, monkeypatch, True) == slow(rows)


def test_one_conversation_over_many_pieces(spark, monkeypatch):
    r = random.Random(3)
    rows = [(5, t // 3, r.choice(["user", "assistant", "system"]), r.choice(["Yes.", f"{t}.", "no", ""])) for t in range(600)]
    rows += [(6, 1, "user", "Same.")] * 300 + [(6, 2, "assistant", "Same.")] * 40 + [(7, None, "user", "A.")]
    rows += [(8, 1 << 62, "user", "A."), (8, -(1 << 62), "user", "B.")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    monkeypatch.setattr(turns, "materialise", lambda df, name, write=turns.materialise: seen.setdefault(name, write(df, name)))
    seen: dict = {}
    got = found(spark, rows, monkeypatch)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert seen["turns"].where("conv_id = 5").select("piece").distinct().count() > 1
    assert got == slow(rows, lambda x: x)


def test_empty_table(spark, monkeypatch):
    assert found(spark, [], monkeypatch) == []


def test_whole_table(spark):
    rows = [tuple(x) for x in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op12_turns(spark, SF).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == slow(rows)


def test_repaired_rows_follow_the_pattern(spark):
    rows = some_rows(4, 40)
    edited, _ = turns.repair(spark.createDataFrame([(*x, 0, "") for x in rows], TYPE))
    of: dict = {}
    for x in sorted(turns.repaired(edited).collect(), key=lambda x: (x.piece, x.seq, x.place)):
        of[x.conv_id] = of.get(x.conv_id, "") + x.role[0]
    assert all(re.fullmatch(r"(s?(ua)+)?", w) for w in of.values())
