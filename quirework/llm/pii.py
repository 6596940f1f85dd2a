"""Personal data: four patterns, and terms of their surroundings that give the protected value away.

Protected entities are the values that the patterns find (e-mail and IP addresses, card and phone numbers).  A term is a word of
three letters or more, lower-cased.  Co-occurrence is counted over the whole corpus, equal texts once, in two ways: n(t, e), the occurrences
of t within ``reach`` terms of an occurrence of e, beside n(t), all its occurrences; and the texts that hold t and e at any distance,
beside those that hold t.  The disclosure of e by t is its pointwise mutual information relative to the entity's own information,
PMI(e; t) / IC(e), which is 1 where t never stands without e, and the larger of the two counts.  Terms at or above
``threshold``, with ``support`` common texts at least, are sanitised wherever they stand in a document that
holds that entity: removed where the term gives it away for certain (``remove_at``), generalised otherwise.

Disclosure reaches the threshold just where p(e | t) >= p(e) ^ (1 - threshold).  A term stands at least as often as near all entities together,
so most pairs go before the corpus is read for n(t), which is counted for the rest only, occurrences and texts in one pass.
Only counts, words near entities and spans are shuffled, never texts (but by ``redact``, which gives texts back).  A task adds up its counts
before they leave it.  Texts that may have copies (by a filter of fixed size) are counted under their key, and each key once.

Offsets are code points, ends exclusive.  Base spans are leftmost and do not overlap within their kind; different kinds may
overlap, and terms never overlap a base span.  Edge cases: a null text is empty; repeated rows each get their result; null ids are
an id like any other; extra columns of any name are kept by ``redact`` and ignored by ``find``; texts are told apart by 64-bit hashes.
An empty table gives an empty table.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.session import materialise

from .common import slices

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# From the first digit of a run only: a match that begins inside a run would also have begun at its first digit.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")
_SPAN = "struct<kind:string,start:int,end:int>"
BASE = f"doc_id long, text_key long, base array<{_SPAN}>, near array<struct<term:string,start:int,entity:long>>, entities array<long>, n_terms long"


def luhn(digits: str) -> bool:
    twice = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(twice) + sum(map(int, digits[-1::-2]))) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each ``@`` with the longest local part before it; the parts lie between the signs, so this is linear."""
    floor, at = 0, text.find("@")
    while at >= 0:
        before = text[floor:at]
        start = floor + len(before.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            floor = m.end()
        else:
            floor = at + 1
        at = text.find("@", floor)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all four kinds, sorted."""
    out = [(a, 0, b) for a, b in emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out)


def entity(kind: int, value: str) -> int:
    """Number of a protected value, spelling aside."""
    plain = value.lower() if kind < 2 else re.sub(r"[^0-9]", "", value)
    return xxhash.xxh64_intdigest(f"{KINDS[kind]}:{plain}".encode()) - (1 << 63)


def entities(text: str, spans: list[tuple[int, int, int]]) -> list[int]:
    return sorted({entity(kind, text[s:e]) for s, kind, e in spans})


def free_spans(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Places of all terms that do not overlap a base span, in order."""
    out: list[tuple[int, int]] = []
    covered, at = sorted((s, e) for s, _, e in spans), 0
    reach = 0  # end of the spans that begin before the term's end
    for m in _TERM.finditer(text):
        a, b = m.span()
        while at < len(covered) and covered[at][0] < b:
            reach = max(reach, covered[at][1])
            at += 1
        if reach <= a:
            out.append((a, b))
    return out


def free_terms(text: str, spans: list[tuple[int, int, int]]) -> dict[str, list[tuple[int, int]]]:
    """Places by term."""
    out: dict[str, list[tuple[int, int]]] = {}
    for a, b in free_spans(text, spans):
        out.setdefault(text[a:b].lower(), []).append((a, b))
    return out


def near_terms(text: str, spans: list[tuple[int, int, int]], reach: int) -> list[dict]:
    """The ``reach`` terms before and behind each entity, however far away."""
    free = free_spans(text, spans)
    starts = [a for a, _ in free]
    out = {}
    for s, kind, e in spans:
        e_no = entity(kind, text[s:e])
        left, right = bisect_left(starts, s), bisect_left(starts, e)
        for a, b in free[max(0, left - reach) : left] + free[right : right + reach]:
            out[a, e_no] = {"term": text[a:b].lower(), "start": a, "entity": e_no}
    return [out[k] for k in sorted(out)]


def base(docs: DataFrame, reach: int = 8) -> DataFrame:
    """Columns of ``BASE``, one row per document."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    near = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int32()), ("entity", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                found = [base_spans(t) for t in texts]
                cols = [
                    pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in f] for f in found], span),
                    pa.array([near_terms(t, f, reach) if f else [] for t, f in zip(texts, found, strict=True)], near),
                    pa.array([entities(t, f) for t, f in zip(texts, found, strict=True)], pa.list_(pa.int64())),
                    pa.array([len(_TERM.findall(t)) for t in texts], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *cols], names=["doc_id", "text_key", "base", "near", "entities", "n_terms"])

    return keyed(docs).mapInArrow(run, BASE)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, text_key."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))


#: Slots of the filters that thin out what is counted; their size is fixed, and what passes by chance is dropped by the join behind them.
SLOTS = 1 << 22
#: Keys that a task adds up before it lets them go: 16 bytes each.
HELD = 1 << 22


def passing(numbers: DataFrame):
    """Broadcast filter by slots of the only column's numbers."""
    slots = np.zeros(SLOTS, dtype=bool)
    slots[np.asarray(numbers.select(F.pmod(F.col(numbers.columns[0]), F.lit(SLOTS)).cast("int").alias("s")).distinct().toArrow().column(0))] = True
    return numbers.sparkSession.sparkContext.broadcast(slots)


def term_number(term: str) -> int:
    """As Spark's xxhash64 of a string."""
    n = xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass"), 42)
    return n - (1 << 64) if n >> 63 else n


def term_counts(docs: DataFrame, wanted: DataFrame, copied) -> DataFrame:
    """term_no, n, texts: occurrences in the corpus, and texts, of the terms ``wanted`` (term_no) and of some others, equal texts once.

    ``copied`` is the filter of texts that may have copies."""
    passed = passing(wanted.select("term_no"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int | None] = {}
        sums: dict[int, list[int]] = {}
        seen: set[int] = set()

        def out(rows):
            cols = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["text_key", "term_no", "n", "texts"])

        def look_up(term):
            no = number[term] = no if passed.value[(no := term_number(term)) % SLOTS] else None
            return no

        for batch in batches:
            for part in slices(batch, 1 << 20):
                single: list[tuple] = []
                if len(number) > HELD // 8:
                    number.clear()
                for t, key in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    many = t and copied.value[key % SLOTS]
                    if not t or many and key in seen:
                        continue
                    if many:
                        seen.add(key)
                    own = {}
                    for w, n in Counter(_TERM.findall(t)).items():
                        w = w.lower()
                        no = number[w] if w in number else look_up(w)
                        if no is not None:
                            own[no] = own.get(no, 0) + n
                    if many:
                        single += [(key, no, n, 1) for no, n in own.items()]
                        continue
                    for no, n in own.items():
                        s = sums.setdefault(no, [0, 0])
                        s[0] += n
                        s[1] += 1
                if single:
                    yield out(single)
                if len(sums) > HELD:
                    yield out([(None, no, *s) for no, s in sums.items()])
                    sums.clear()
        if sums:
            yield out([(None, no, *s) for no, s in sums.items()])

    found = keyed(docs).mapInArrow(run, "text_key long, term_no long, n long, texts long")
    # a text with copies comes once from each task, always with the same counts
    once = found.groupBy("text_key", "term_no").agg(F.when(F.col("text_key").isNull(), F.sum("n")).otherwise(F.max("n")).alias("n"), F.when(F.col("text_key").isNull(), F.sum("texts")).otherwise(F.lit(1)).alias("texts"))
    return once.groupBy("term_no").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))


def pair_counts(docs: DataFrame, frequent: DataFrame, holders: DataFrame, copied) -> DataFrame:
    """term, entity, both: texts that hold both, for the entities ``frequent`` (entity) and some others, found in the texts ``holders`` (text_key);
    without entity, those that hold the term."""
    passed, held = passing(frequent.select("entity")), passing(holders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        seen: set[int] = set()

        def out(rows):
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["text_key", "term", "entity", "n"])

        for batch in batches:
            for part in slices(batch, 1 << 20):
                single: list[tuple] = []
                for t, key in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    many = t and copied.value[key % SLOTS]
                    if not t or not held.value[key % SLOTS] or many and key in seen:
                        continue
                    if many:
                        seen.add(key)
                    spans = base_spans(t)
                    some = [e for e in entities(t, spans) if passed.value[e % SLOTS]] if spans else []
                    terms = free_terms(t, spans) if some else ()
                    for e in [*some, None] if terms else ():
                        if many:
                            single += [(key, w, e, 1) for w in terms]
                        else:
                            sums.update((w, e) for w in terms)
                if single:
                    yield out(single)
                if len(sums) > HELD // 8:
                    yield out([(None, *p, n) for p, n in sums.items()])
                    sums.clear()
        if sums:
            yield out([(None, *p, n) for p, n in sums.items()])

    found = keyed(docs).mapInArrow(run, "text_key long, term string, entity long, n long")
    once = found.groupBy("text_key", "term", "entity").agg(F.when(F.col("text_key").isNull(), F.sum("n")).otherwise(F.lit(1)).alias("n"))
    return once.groupBy("term", "entity").agg(F.sum("n").alias("both"))


def likely(pairs: DataFrame, most: DataFrame, of_entity: DataFrame, total, threshold: float) -> DataFrame:
    """Pairs (term, entity, both) that can reach the threshold, with p_e: a term (term, most) stands at least as often as with all entities together."""
    p_e = F.col("n_e") / F.greatest(F.lit(total), "n_e")
    rated = pairs.join(most, "term").join(of_entity.withColumn("p_e", p_e).select("entity", "p_e"), "entity")
    # a little room for rounding; the score itself decides later
    return rated.where(F.col("both") >= F.col("most") * F.pow("p_e", F.lit(1 - threshold)) * (1 - 1e-9)).drop("most")


def disclosing(rows: DataFrame, docs: DataFrame, threshold: float = 0.95, support: int = 3) -> DataFrame:
    """term, entity, disclosure: pairs at or above ``threshold``, for ``rows`` of ``base``."""
    texts = rows.groupBy("text_key").agg(F.first("n_terms").alias("n_terms"), F.count("*").alias("rows"))
    texts = materialise(texts, "texts")
    n_texts, n_terms = texts.agg(F.count("*"), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    copied = passing(texts.where("rows > 1").select("text_key"))
    once = materialise(rows.where(F.size("entities") > 0).select("text_key", "near", "entities").dropDuplicates(["text_key"]), "entities")
    near = once.select("text_key", F.explode("near").alias("x")).select("text_key", "x.term", "x.entity")
    # a place near two entities counts once
    places = F.array_distinct(F.transform("near", lambda x: F.struct(x["start"].alias("start"), x["term"].alias("term"))))
    most = once.select(F.explode(places).alias("x")).groupBy("x.term").agg(F.count("*").alias("most"))
    by_text = near.groupBy("term", "entity", "text_key").agg(F.count("*").alias("n"))
    close = by_text.groupBy("term", "entity").agg(F.sum("n").alias("both"), F.count("*").alias("texts")).where(F.col("texts") >= support)
    close = likely(close.drop("texts"), most, near.groupBy("entity").agg(F.count("*").alias("n_e")), max(1, n_terms), threshold)
    frequent = once.select("text_key", F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= support)
    frequent = materialise(frequent, "frequent")
    holders = once.select("text_key", F.explode("entities").alias("entity")).join(frequent, "entity").select("text_key").distinct()
    counted = materialise(pair_counts(docs, frequent, holders, copied).where(F.col("both") >= support), "counted")
    most = counted.where("entity IS NULL").select("term", F.col("both").alias("most"))
    wide = likely(counted.where("entity IS NOT NULL"), most, frequent, max(1, n_texts), threshold)
    mark = lambda pairs, kind: pairs.withColumn("kind", F.lit(kind))
    pairs = materialise(mark(close, "near").unionByName(mark(wide, "text")).withColumn("term_no", F.xxhash64("term")), "pairs")
    counts = term_counts(docs, pairs, copied)
    n = F.when(F.col("kind") == "near", F.col("n")).otherwise(F.col("texts"))
    p_et = F.least(F.lit(1.0), F.col("both") / n)
    score = F.when(F.col("p_e") >= 1, 0.0).otherwise(F.log(p_et / F.col("p_e")) / -F.log("p_e"))
    rated = pairs.join(counts, "term_no").withColumn("disclosure", score).where(F.col("disclosure") >= threshold)
    return rated.groupBy("term", "entity").agg(F.max("disclosure").alias("disclosure"))


def occurrences(docs: DataFrame, pairs: DataFrame, holders: DataFrame) -> DataFrame:
    """text_key, term, entity, places: all places of the terms in the texts that hold the entity, for ``pairs`` and some others.

    Equal texts have equal places: each comes once from a task, and the caller takes one."""
    passed = passing(pairs.select(F.xxhash64("term").bitwiseXOR(F.col("entity")).alias("pair")))
    held = passing(holders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1 << 20):
                out: dict[tuple, list] = {}
                for t, key in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    if not t or not held.value[key % SLOTS]:
                        continue
                    spans = base_spans(t)
                    terms = free_terms(t, spans) if spans else {}
                    words = list(terms)
                    hashes = np.fromiter(map(term_number, words), np.int64, len(words))
                    for e in entities(t, spans) if words else ():
                        for j in np.flatnonzero(passed.value[(hashes ^ np.int64(e)) % SLOTS]):
                            out[key, words[j], e] = [{"start": a, "end": b} for a, b in terms[words[j]]]
                keys, words, numbers = zip(*out, strict=True) if out else ((), (), ())
                place = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(words, pa.string()), pa.array(numbers, pa.int64()), pa.array(list(out.values()), place)], names=["text_key", "term", "entity", "places"])

    return keyed(docs).mapInArrow(run, "text_key long, term string, entity long, places array<struct<start:int,end:int>>")


def find(docs: DataFrame, reach: int = 8, threshold: float = 0.95, support: int = 3) -> DataFrame:
    """doc_id, text_key, base, terms (start, end, disclosure): one row per document."""
    rows = materialise(base(docs, reach), "pii")
    pairs = materialise(disclosing(rows, docs, threshold, support), "disclosing")
    holders = rows.select("text_key", F.explode("entities").alias("entity")).join(pairs, "entity", "left_semi").select("text_key").distinct()
    terms = (
        occurrences(docs, pairs, holders)
        .join(pairs, ["term", "entity"])
        .select("text_key", F.explode("places").alias("p"), "disclosure")
        .groupBy("text_key", "p.start", "p.end")
        .agg(F.max("disclosure").alias("disclosure"))
        .groupBy("text_key")
        .agg(F.array_sort(F.collect_list(F.struct("start", "end", "disclosure"))).alias("terms"))
    )
    none = F.expr("cast(array() as array<struct<start:int,end:int,disclosure:double>>)")
    return rows.join(terms, "text_key", "left").select("doc_id", "text_key", "base", F.coalesce("terms", none).alias("terms"))


def cut(text: str | None, base: list, terms: list, remove_at: float) -> str | None:
    """The text with base spans replaced by their kind, and terms removed or generalised; overlapping spans as one."""
    if text is None or not (base or terms):
        return text
    marks = [(s["start"], s["end"], f"[{s['kind'].upper()}]") for s in base]
    marks += [(s["start"], s["end"], "" if s["disclosure"] >= remove_at else "[TERM]") for s in terms]
    out, at = [], 0
    for s, e, word in sorted(marks):
        if s >= at:
            out += [text[at:s], word]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, reach: int = 8, threshold: float = 0.95, support: int = 3, remove_at: float = 1.0) -> DataFrame:
    """``docs`` with sanitised texts; all columns stay."""
    found = find(docs, reach, threshold, support).where((F.size("base") > 0) | (F.size("terms") > 0))
    found = found.select("text_key", "base", "terms").dropDuplicates(["text_key"])
    schema, at = docs.schema, docs.columns.index("text")
    # columns are told apart by place, so any name of the caller's may stand
    own = docs.select(F.struct("*").alias("row"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")).alias("o")
    both = own.join(found.alias("f"), F.col("o.text_key") == F.col("f.text_key"), "left").select(*[F.col("o.row").getField(c).alias(f"c{i}") for i, c in enumerate(docs.columns)], "base", "terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n = len(schema)
                texts = [cut(t, b or [], x or [], remove_at) for t, b, x in zip(*(part.column(i).to_pylist() for i in (at, n, n + 1)), strict=True)]
                cols = [part.column(i) for i in range(n)]
                cols[at] = pa.array(texts, cols[at].type)
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

    return both.mapInArrow(run, schema)
