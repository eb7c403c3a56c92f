"""Operator 10: personal data by patterns, and terms that reveal it by corpus co-occurrence.

After Sanchez and Batet, "C-sanitized: a privacy model for document redaction and sanitization" (2016).
Patterns find the protected entities: e-mail addresses, IP addresses, payment cards, phone numbers.
A term of a document, anywhere outside its entities, discloses an entity of the document
if its pointwise mutual information with it, estimated over the documents of the corpus, is at least
``DISCLOSURE`` of the entity's own information: ``log2(N n(t,e) / (n(t) n(e))) >= DISCLOSURE * log2(N / n(e))``.
The estimate is trusted from ``SUPPORT`` documents on in which both occur.  Copies are no evidence: of documents that
hold entities and are near copies of one another (operator 7), one counts, in N too.  Disclosing terms become
spans of kind ``term`` wherever they stand in a document with the entity, copies included; ``sanitised`` replaces entities
by their kind and generalises terms to a class that nearly every document has (number, name, word), or removes them.

One pass finds entities and keeps the texts that hold any; entities of too few documents for support end there.
A second counts the documents of all terms: a task sums what it has seen and sends one row a term, so nothing that grows
with the corpus is held.  A term of more documents than allows it to disclose an entity is not paired with it.

Defined cases: a null or empty text has no entities; rows that repeat are copies, and flagged each; null ids are kept;
a very long text is scanned whole, in linear time; a term at exactly the threshold discloses (a tie); an empty table
gives no rows; other columns pass unchanged whatever their names, and an output whose name is taken has an underscore
behind it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import near_dedup, shared
from .tokens import ALNUM, U64, pieces

KINDS = ("email", "ip", "card", "phone", "term")
SUPPORT = 2
DISCLOSURE = 0.7
FLUSH = 4_000_000  # terms of documents that a counting task holds

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGIT = re.compile(r"[0-9]")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++")  # from the left of a run of digits only: linear
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_TERM = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@label(.label)+, found from each @ outwards: linear however long the runs are."""
    end, at = 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        if m:
            # the run of local characters before the @, not before the last match's end; widened until it stops short
            width = 64
            while True:
                low = max(end, at - width)
                n = len(_LOCAL.match(text[low:at][::-1]).group())
                if n < at - low or low == end:
                    break
                width *= 2
            if n:
                yield at - n, m.end()
                end = m.end()
        at = text.find("@", at + 1)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Every four parts of a run of dotted numbers, from its left; those over 255 are dropped."""
    for m in _DOTTED.finditer(text):
        at, parts = m.start(), m.group().split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, at + size
            at += size + 1


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 12 <= len(digits := _NOT_DIGIT.sub("", m.group())) <= 19 and _luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m.group())) <= 15:
            yield m.span()


def entities(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base kinds, in order."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(a, 1, b) for a, b in _ips(text)]
        out += [(a, 2, b) for a, b in _cards(text)]
        if "+" in text:
            out += [(a, 3, b) for a, b in _phones(text)]
    out.sort()
    return out


def _value(text: str, kind: int) -> str:
    return text.lower() if kind == 0 else text if kind == 1 else _NOT_DIGIT.sub("", text)


def blanked(text: str, found: list[tuple[int, int, int]]) -> str:
    """text with its entities and the words that they touch as blanks; what is left keeps its place."""
    out, at = [], 0
    for a, _, b in found:
        if b <= at:
            continue
        a = max(a, at)
        while a > at and _TERM.match(text, a - 1, a):
            a -= 1
        if m := _TERM.match(text, b):
            b = m.end()
        out += [text[at:a], " " * (b - a)]
        at = b
    return "".join([*out, text[at:]])


def _blank(column: pa.Array) -> tuple[pa.Array, list[list[tuple[int, int, int]]]]:
    """The blanked texts, as bytes, and the entities of each."""
    texts = [t or "" for t in column.to_pylist()]
    found = [entities(t) for t in texts]
    return pa.array([(blanked(t, f) if f else t).encode() for t, f in zip(texts, found, strict=True)], pa.large_binary()), found


def _hashes(words: list[str]) -> np.ndarray:
    """The hashes that the words of a text have; a word has no white space or other separator in it."""
    if not words:
        return np.empty(0, U64)
    return np.concatenate([p.hashes() for p in pieces(pa.array([w.encode() for w in words], pa.binary()), np.ones(256, bool))])


_SCANNED = "id long, base array<struct<start: long, kind: int, end: long>>, names array<long>, held string"


def _scanner(inside: str | None):
    """The entities of each row, the hashes of their names, and the text of rows that hold any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        base_type = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
        for batch in batches:
            base, names, held = [], [], []
            for text in shared.texts(batch, inside):
                text = text.as_py() or ""
                found = entities(text)
                base.append([{"start": a, "kind": k, "end": b} for a, k, b in found])
                names.append(_hashes(sorted({f"{KINDS[k]}:{_value(text[a:b], k)}" for a, k, b in found})).view(np.int64).tolist())
                held.append(text if found else None)
            ids = pa.array(np.arange(row, row + batch.num_rows, dtype=np.int64))
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("row"), ids, pa.array(base, base_type), pa.array(names, pa.list_(pa.int64())), pa.array(held, pa.string())], ["row", "id", "base", "names", "held"])

    return run


def _term_sets(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The first row of each piece of a column of texts, and the distinct terms, of three signs or more, of its rows outside their entities."""
    for piece in pieces(_blank(column)[0], ALNUM):
        h, at = piece.hashes(), piece.word_bounds
        signs = np.concatenate([[0], np.cumsum((piece.data & 0xC0) != 0x80)])
        long = signs[piece.ends] - signs[piece.starts] >= 3
        yield piece.first, [np.unique(h[a:b][long[a:b]]).view(np.int64) for a, b in zip(at[:-1], at[1:], strict=True)]


def _termed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, sets in _term_sets(batch.column("held")):
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)
            terms = pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(sets))).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, len(sets)), terms], ["id", "terms"])


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where the terms of each row stand, everywhere outside its entities."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    for batch in batches:
        out = []
        for text, telling in zip(batch.column("held").to_pylist(), batch.column("telling").to_pylist(), strict=True):
            places = [m.span() for m in _TERM.finditer(blanked(text, entities(text)))]
            hit = np.isin(_hashes([text[a:b] for a, b in places]).view(np.int64), np.array(telling, np.int64))
            out.append([{"start": a, "kind": 4, "end": b} for (a, b), x in zip(places, hit.tolist(), strict=True) if x])
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, kind)], ["id", "terms"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n): in how many of the task's rows each term is, summed before it is sent."""
    held, n = [], 0

    def emit() -> pa.RecordBatch:
        terms, counts = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(terms), pa.array(counts)], ["term", "n"])

    for batch in batches:
        for _, sets in _term_sets(batch.column("text")):
            held += sets
            n += sum(map(len, sets))
            if n >= FLUSH:
                yield emit()
                held, n = [], 0
    if held:
        yield emit()


def find(docs: DataFrame, keep: list[str], text: str = "text", support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """keep, base and terms of each row of docs: arrays of (start, kind, end) in code points; kind is the place in KINDS."""
    return shared.beside(_found(docs, keep, text, support, disclosure), keep, ["base", "terms"])


def _found(docs: DataFrame, keep: list[str], text: str, support: int, disclosure: float) -> DataFrame:
    spark = docs.sparkSession
    inside = text if text in keep else None
    plain = shared.packed(docs, keep) if inside else shared.packed(docs, keep, text=F.col(f"`{text}`"))
    scanned = shared.materialise(plain.mapInArrow(_scanner(inside), shared.widened(plain, _SCANNED)), "entities")
    with shared.kept(spark) as keep_table:
        terms = keep_table(_disclosing(docs.select(F.col(f"`{text}`").alias("text")), scanned, support, disclosure), "disclosing")
    out = scanned.drop("names", "held").join(terms, "id", "left").drop("id")
    return out.withColumn("terms", F.coalesce("terms", F.expr("cast(array() as array<struct<start: bigint, kind: int, end: bigint>>)")))


def _disclosing(texts: DataFrame, scanned: DataFrame, support: int, disclosure: float) -> DataFrame:
    """(id, terms): the spans of the disclosing terms of rows that have any."""
    rows = scanned.count()
    named = scanned.select("id", F.explode("names").alias("entity"))
    # what cannot reach the support takes no further part
    often = named.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support).select("entity")
    named = shared.materialise(named.join(often, "entity"), "named")
    holders = shared.materialise(scanned.select("id", "held").join(named.select("id").distinct(), "id", "left_semi"), "holders")
    # of near copies among them one is evidence
    copies = shared.materialise(near_dedup.near_duplicates(holders.select(F.col("id").alias("doc_id"), F.col("held").alias("text"))).where("not kept").select(F.col("doc_id").alias("id")), "copies")
    total = rows - copies.count()
    sole = named.join(copies, "id", "left_anti")
    of_entity = sole.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).where((F.col("n_entity") >= support) & (F.col("n_entity") < total))
    # n_both is at most n_entity, so a term of more documents than this cannot disclose the entity (0.1 % for rounding)
    most = 1.001 * F.pow(F.lit(float(max(total, 1))), F.lit(1.0 - disclosure)) * F.pow(F.col("n_entity").cast("double"), F.lit(float(disclosure)))
    of_entity = shared.materialise(of_entity.withColumn("most", most), "shared_entities")
    bound = of_entity.agg(F.max("most")).first()[0] or 0.0
    termed = shared.materialise(holders.mapInArrow(_termed, "id long, terms array<long>"), "terms").select("id", F.explode("terms").alias("term"))
    evidence = termed.join(copies, "id", "left_anti")
    common = shared.materialise(evidence.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support).select("term"), "candidates")
    of_copies = termed.join(copies, "id", "left_semi").select("term", F.lit(-1).cast("long").alias("n"))
    everywhere = texts.mapInArrow(_counted, "term long, n long").union(of_copies).groupBy("term").agg(F.sum("n").alias("n_term"))
    of_term = shared.materialise(everywhere.join(common, "term").where(F.col("n_term") <= bound), "frequencies")
    pairs = evidence.join(of_term, "term").join(sole.join(of_entity, "entity"), "id").where(F.col("n_term") <= F.col("most"))
    together = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both"), F.first("n_term").alias("n_term"), F.first("n_entity").alias("n_entity")).where(F.col("n_both") >= support)
    information = F.log2(F.lit(total) / F.col("n_entity"))
    mutual = F.log2(F.lit(total) * F.col("n_both") / (F.col("n_term") * F.col("n_entity")))
    telling = shared.materialise(together.where(mutual >= disclosure * information).select("entity", "term"), "telling")
    of_row = termed.join(named.join(telling, "entity"), ["id", "term"]).groupBy("id").agg(F.collect_set("term").alias("telling"))
    return holders.join(of_row, "id").mapInArrow(_marked, "id long, terms array<struct<start: long, kind: int, end: long>>")


def _written(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, s -> concat(element_at(array({names}), s.kind + 1), ':', s.start, ':', s.end)), ',')"


def generalised(term: str) -> str:
    """The class of a term; nearly every document has one of each, so it discloses nothing."""
    return "[NUMBER]" if term.isdigit() else "[NAME]" if term[:1].isupper() else "[WORD]"


def _replacer(text: str, generalise: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, spans in zip(batch.column("row").field(text).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                if t is None or not spans:
                    out.append(t)
                    continue
                done, at = [], 0
                for s in spans:
                    if s["end"] > at:
                        kind = KINDS[s["kind"]]
                        instead = f"[{kind.upper()}]" if kind != "term" else generalised(t[s["start"] : s["end"]]) if generalise else ""
                        done += [t[at : max(at, s["start"])], instead]
                        at = s["end"]
                out.append("".join([*done, t[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], ["row", "t"])

    return run


def sanitised(docs: DataFrame, text: str = "text", support: int = SUPPORT, disclosure: float = DISCLOSURE, generalise: bool = True) -> DataFrame:
    """docs with entities replaced by their kind in brackets, and disclosing terms generalised, or else removed."""
    found = _found(docs, docs.columns, text, support, disclosure).select("row", F.array_sort(F.concat("base", "terms")).alias("spans"))
    out = found.mapInArrow(_replacer(text, generalise), shared.widened(found, "t string"))
    return out.select(*(F.col("t").alias(k) if k == text else F.col("row")[k].alias(k) for k in docs.columns))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(F.expr(_written("base")), 256).alias("base_sha256"), F.expr(_written("array_sort(concat(base, terms))")).alias("spans"))
