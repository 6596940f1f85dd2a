"""Language identification: scripts narrow the candidates, letter-trigram scores per word, Viterbi over the words of a text.

``train`` fits letter trigrams on a bounded sample: per language the ``docs_per_lang`` labelled documents with the smallest hash of
their id, whole texts; counts are made by Spark, and all letters and trigrams of the sample, which bounds them, reach the driver
(more than ``max_langs`` languages are refused).  ``identify`` needs no shuffle: a word's languages are those that use its script, its score is the sum
of the log probabilities of its letters' trigrams, and switching the language between words costs ``penalty``.  Texts of a
slice are decoded in step, so the work per word is a few vectorised operations.

Output: ``spans`` of one language (code points, from the first letter of the first word to the last of the last), the language with
most letters (ties: the smaller name) and its share of the letters as score.

Edge cases: null texts and texts without a letter are ``und`` with score 0 and no spans; a word in a script that no learned language
uses keeps all languages with equal scores; repeated rows each get a row; a null id is never trained on and not held out.
Without any training text every text is ``und``.  Extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.session import materialise

from .common import slices

#: First words of Unicode letter names that stand for a script of their own; other letters are "OTHER".
SCRIPTS = ("LATIN", "GREEK", "CYRILLIC", "ARMENIAN", "HEBREW", "ARABIC", "DEVANAGARI", "BENGALI", "TAMIL", "TELUGU", "THAI", "GEORGIAN", "HANGUL", "HIRAGANA", "KATAKANA", "CJK")
IDENTIFIED = "doc_id long, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"


@lru_cache(maxsize=1)
def letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: script number (0: no letter) and lower-case code point."""
    number = {s: i + 1 for i, s in enumerate(SCRIPTS)}
    script, lower = np.zeros(0x110000, dtype=np.uint8), np.arange(0x110000, dtype=np.uint32)
    for c in range(0x32000):
        ch = chr(c)
        if ch.isalpha():
            script[c] = number.get(unicodedata.name(ch, "").split(" ")[0].split("-")[0], len(SCRIPTS) + 1)
            if len(low := ch.lower()) == 1:
                lower[c] = ord(low)
    return script, lower


def points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype="<u4")


def numbered(alphabet: list[int]) -> np.ndarray:
    """Number of each code point: 1 and up for known letters, the last one for all others."""
    letter = np.full(0x110000, len(alphabet) + 1, dtype=np.int32)
    letter[alphabet] = np.arange(1, len(alphabet) + 1)
    return letter


class Rows:
    """Row (1 and up, 0: unknown) by trigram key: a hash table with linear probing, filled and asked for many keys at once."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.concatenate([[-1], keys]).astype(np.int64)
        self.bits = max(10, (4 * len(keys)).bit_length())
        self.table = np.zeros(1 << self.bits, dtype=np.int32)
        left, slot = np.arange(1, len(self.keys)), self.slots(self.keys[1:])
        while len(left):
            _, first = np.unique(slot, return_index=True)
            first = first[self.table[slot[first]] == 0]
            self.table[slot[first]] = left[first]
            rest = np.ones(len(left), dtype=bool)
            rest[first] = False
            left, slot = left[rest], (slot[rest] + 1) & (len(self.table) - 1)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        slot = self.slots(keys)
        out = self.table[slot]
        other = np.flatnonzero((out > 0) & (self.keys[out] != keys))
        while len(other):
            slot[other] = (slot[other] + 1) & (len(self.table) - 1)
            out[other] = self.table[slot[other]]
            other = other[(out[other] > 0) & (self.keys[out[other]] != keys[other])]
        return out


@dataclass
class Model:
    langs: list[str]
    alphabet: list[int]
    grams: np.ndarray  # key of each trigram known
    logp: np.ndarray  # row 0: unseen trigram; then one row per trigram, one column per language
    scripts: np.ndarray  # script number x language: whether the language uses it

    def tables(self) -> tuple[np.ndarray, Rows]:
        """Letter number by code point, and row of ``logp`` by trigram key."""
        return numbered(self.alphabet), Rows(self.grams)


def trigram_keys(cp: np.ndarray, script: np.ndarray, number: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of letters, and the key of the trigram around each; 0 stands for what is no letter."""
    n = np.where(script > 0, number, 0).astype(np.int64)
    around = np.concatenate([[0], n, [0]])
    at = np.flatnonzero(script)
    return at, (around[at] * base + around[at + 1]) * base + around[at + 2]


def train(docs: DataFrame, docs_per_lang: int = 400, max_langs: int = 200) -> Model:
    """Model of the texts of ``docs`` (doc_id, text, lang); rows with null text or lang are left out."""
    known = docs.select("doc_id", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).distinct()
    # Ranked within 64 shares of a language first, so that the last window of a frequent one has a fixed size.
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    share = F.pmod(F.xxhash64("doc_id", F.lit("share")), F.lit(64))
    chosen = known.withColumn("share", share).withColumn("n", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("n") <= docs_per_lang)
    chosen = chosen.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("n") <= docs_per_lang).drop("n", "share")
    names = sorted(r.lang for r in chosen.select("lang").distinct().limit(max_langs + 1).collect())
    if len(names) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    rows = docs.select("doc_id", "lang", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")
    sample = materialise(rows.select("lang", "text"), "langid")

    def count(by: str, number=None, base: int = 0):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            script, lower = letters()
            seen: dict[tuple, int] = {}
            for batch in batches:
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    cp = lower[points(text)]
                    s = script[cp]
                    keys = cp[s > 0] if by == "letter" else trigram_keys(cp, s, number[cp], base)[1]
                    for k, n in zip(*(a.tolist() for a in np.unique(keys, return_counts=True)), strict=True):
                        seen[lang, k] = seen.get((lang, k), 0) + n
            yield pa.RecordBatch.from_pydict({"lang": [k[0] for k in seen], "k": [k[1] for k in seen], "n": list(seen.values())}, pa.schema([("lang", pa.string()), ("k", pa.int64()), ("n", pa.int64())]))

        return sample.mapInArrow(run, "lang string, k long, n long").groupBy("lang", "k").agg(F.sum("n").alias("n"))

    by_letter = count("letter").collect()
    alphabet = sorted({r.k for r in by_letter})
    script, _ = letters()
    use = np.zeros((len(SCRIPTS) + 2, len(names)))
    column = {name: i for i, name in enumerate(names)}
    for r in by_letter:
        use[script[r.k], column[r.lang]] += r.n
    uses = use >= 0.01 * np.maximum(use.sum(axis=0), 1)
    grams = count("trigram", numbered(alphabet), len(alphabet) + 2).toArrow()
    keys, row = np.unique(np.asarray(grams.column("k")), return_inverse=True)
    counts = np.zeros((len(keys) + 1, len(names)))
    counts[1 + row, [column[x] for x in grams.column("lang").to_pylist()]] = np.asarray(grams.column("n"))
    counts += 0.5
    return Model(names, alphabet, keys, np.log(counts / counts.sum(axis=0)).astype(np.float32) if names else counts.astype(np.float32), uses)


def viterbi(scores: np.ndarray, begins: np.ndarray, penalty: float) -> np.ndarray:
    """Language number of every word; text i has the words begins[i]..begins[i+1]."""
    sizes = np.diff(begins)
    order = np.argsort(-sizes, kind="stable")
    start = begins[:-1][order]
    active = np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)), side="left")  # texts that have a word t
    back, arg = np.zeros(scores.shape, dtype=bool), np.zeros(len(scores), dtype=np.int16)
    value = scores[start[: active[0]]] if len(active) else None
    for t in range(1, len(active)):
        a = active[t]
        v, at = value[:a], start[:a] + t
        top = v.max(axis=1)[:, None] - penalty
        back[at] = v < top
        arg[at] = v.argmax(axis=1)
        value[:a] = np.maximum(v, top) + scores[at]
        # a finished text keeps its last values in value[a:]
    label = np.zeros(len(scores), dtype=np.int16)
    if value is None:
        return label
    state = value.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        a = active[t]
        at = start[:a] + t
        label[at] = state[:a]
        state[:a] = np.where(back[at, state[:a]], arg[at], state[:a])
    return label


def spans_of(model: Model, tables, texts: list[str | None], penalty: float) -> list[tuple[str, float, list[dict]]]:
    """Per text: language, score, spans."""
    script_of, lower = letters()
    letter, row = tables
    parts = [points(t) for t in texts]
    sizes = np.array([len(p) + 1 for p in parts], dtype=np.int64)
    text_at = np.concatenate([[0], np.cumsum(sizes)])
    gap = np.zeros(1, dtype=np.uint32)
    cp = lower[np.concatenate([x for p in parts for x in (p, gap)])] if parts else gap
    script = script_of[cp]
    at, keys = trigram_keys(cp, script, letter[cp], len(model.alphabet) + 2)
    if not len(at) or not model.langs:
        return [("und", 0.0, [])] * len(texts)
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)  # among letters: where words begin
    scores = np.add.reduceat(model.logp[row[keys]], first, axis=0).astype(np.float64)
    length = np.diff(np.append(first, len(at)))
    start = at[first]
    candidates = np.add.reduceat(model.scripts[script[at]].astype(np.int32), first, axis=0) > 0
    none = ~candidates.any(axis=1)
    scores[~candidates] -= 1000.0
    scores[none] = 0.0
    begins = np.searchsorted(start, text_at)
    label = viterbi(scores, begins, penalty)
    out = []
    for i in range(len(texts)):
        a, b = begins[i], begins[i + 1]
        if a == b:
            out.append(("und", 0.0, []))
            continue
        mine = label[a:b]
        share = np.bincount(mine, weights=length[a:b], minlength=len(model.langs))
        best = int(share.argmax())
        cut = np.concatenate([[0], np.flatnonzero(np.diff(mine)) + 1, [b - a]])
        spans = [{"start": int(start[a + x] - text_at[i]), "end": int(start[a + y - 1] + length[a + y - 1] - text_at[i]), "lang": model.langs[mine[x]]} for x, y in zip(cut[:-1], cut[1:], strict=True)]
        out.append((model.langs[best], float(share[best] / share.sum()), spans))
    return out


def identify(docs: DataFrame, model: Model, penalty: float = 8.0) -> DataFrame:
    """Columns of ``IDENTIFIED``, one row per document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value.tables()
        for batch in batches:
            for part in slices(batch, 2 << 20):
                got = spans_of(shared.value, tables, part.column(1).to_pylist(), penalty)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], kind)],
                    names=["doc_id", "lang_pred", "score", "spans"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, IDENTIFIED)


def keep_identified(docs: DataFrame, model: Model, min_score: float = 0.5, penalty: float = 8.0) -> DataFrame:
    """``docs`` whose language is known and has ``min_score`` of the letters at least; all columns stay."""
    shared, schema, at = docs.sparkSession.sparkContext.broadcast(model), docs.schema, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value.tables()
        for batch in batches:
            for part in slices(batch, 2 << 20):
                got = spans_of(shared.value, tables, part.column(at).to_pylist(), penalty)
                yield part.filter(pa.array([g[0] != "und" and g[1] >= min_score for g in got], pa.bool_()))

    return docs.mapInArrow(run, schema)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4
