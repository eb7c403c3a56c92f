"""Full-text search over symbols: an inverted index with positions, phrases, and BM25 ranks.

A token is a run of letters and digits, lower-cased and without diacritics; ``_`` separates.  A query is
words, which are phrases of their tokens, ``"quoted phrases"``, ``prefix*``, ``column:word``, joined by
AND, OR, NOT and parentheses; phrases side by side are all meant, and hold together more closely than any operator.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

COLUMNS = ("name", "signature", "documentation")
K1, B = 1.2, 0.75

_ACCENTED = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1]


def fold(c: Column) -> Column:
    low = F.lower(c)
    return F.when(F.octet_length(low) == F.char_length(low), low).otherwise(_plain(low))  # most text is ASCII


def _plain(low: Column) -> Column:
    return F.translate(low, "".join(a for a, _ in _ACCENTED), "".join(b.lower() for _, b in _ACCENTED))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(fold(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def tokens_of(text: str) -> list[str]:
    plain = "".join(dict(_ACCENTED).get(x, x) for x in text.lower()).lower()
    return re.findall(r"[^\W_]+", plain)


@dataclass
class SearchIndex:
    """postings (doc, col, pos, token) and documents (doc, size)."""

    postings: DataFrame
    documents: DataFrame


def index(rows: DataFrame, key: str = "id", columns: tuple[str, ...] = COLUMNS, keep: bool = False) -> SearchIndex:
    """A posting per token, and each row's number of tokens over all columns.  keep: the tokens are stored, so that each text is cut once."""
    cut = rows.select(F.col(key).alias("doc"), *(tokens(F.col(c)).alias(f"t{i}") for i, c in enumerate(columns)))
    if keep:
        cut = materialise(cut, "tokens")
    each = cut.select("doc", F.explode(F.array(*(F.struct(F.lit(c).alias("col"), F.col(f"t{i}").alias("t")) for i, c in enumerate(columns)))).alias("x"))
    postings = each.select("doc", "x.col", F.posexplode("x.t").alias("pos", "token"))
    size = reduce(lambda a, b: a + b, (F.size(f"t{i}") for i in range(len(columns))))
    return SearchIndex(postings, cut.select("doc", size.alias("size")))


def stored(rows: DataFrame, key: str = "id", columns: tuple[str, ...] = COLUMNS) -> SearchIndex:
    """The index as tables, postings sorted by token, so that looking up a word skips the rest."""
    at = index(rows, key, columns, keep=True)
    return SearchIndex(materialise(at.postings.repartitionByRange("token").sortWithinPartitions("token"), "postings"), materialise(at.documents, "documents"))


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]
    prefix: bool = False
    column: str | None = None


_LEX = re.compile(r'\s*(?:(?P<quoted>"(?:[^"]|"")*")|(?P<word>[^\W]+)|(?P<sign>[():*]))')


def parse(query: str, columns: tuple[str, ...] = COLUMNS) -> tuple | Phrase:
    """The query as nested ("and" | "or" | "not", left, right) and phrases; ValueError where it is none."""
    found, at = [], 0
    query = query.rstrip()
    while at < len(query):
        m = _LEX.match(query, at)
        if not m:
            raise ValueError(f"no query: {query!r} at {at}")
        found.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    place = 0

    def peek() -> tuple[str | None, str]:
        return found[place] if place < len(found) else (None, "")

    def take() -> tuple[str | None, str]:
        nonlocal place
        place += 1
        return found[place - 1]

    def joined(kind: str, word: str, inner: Callable[[], tuple | Phrase]) -> tuple | Phrase:
        out = inner()
        while peek() == ("word", word):
            take()
            out = (kind, out, inner())
        return out

    def either() -> tuple | Phrase:
        return joined("or", "OR", lambda: joined("and", "AND", lambda: joined("not", "NOT", side_by_side)))

    def side_by_side() -> tuple | Phrase:
        """A bracket, which stands alone, or phrases."""
        if peek() == ("sign", "("):
            take()
            out = either()
            if peek() != ("sign", ")"):
                raise ValueError(f"no query: {query!r} has an open bracket")
            take()
            return out
        out = single()
        while peek()[0] == "quoted" or peek()[0] == "word" and peek()[1] not in ("AND", "OR", "NOT"):
            out = ("and", out, single())
        return out

    def single(column: str | None = None) -> Phrase:
        kind, text = peek()
        if kind not in ("quoted", "word") or kind == "word" and text in ("AND", "OR", "NOT"):
            raise ValueError(f"no query: {query!r}")
        take()
        if kind == "word" and column is None and peek() == ("sign", ":"):
            if text not in columns:
                raise ValueError(f"no column {text!r}")
            take()
            return single(text)
        words = tuple(tokens_of(text[1:-1].replace('""', '"') if kind == "quoted" else text))
        prefix = peek() == ("sign", "*")
        if prefix:
            take()
        return Phrase(words, prefix, column)

    if not found:
        raise ValueError("empty query")
    out = either()
    if place < len(found):
        raise ValueError(f"no query: {query!r}")
    return out


def _phrases(tree: tuple | Phrase, ranked_only: bool = False) -> list[Phrase]:
    if isinstance(tree, Phrase):
        return [tree]
    return _phrases(tree[1], ranked_only) + ([] if tree[0] == "not" and ranked_only else _phrases(tree[2], ranked_only))


def _hits(at: SearchIndex, phrase: Phrase) -> DataFrame:
    """(doc, f): how often the phrase is in each row that has it; words are looked up one by one and joined on where they stand."""
    post = at.postings if phrase.column is None else at.postings.where(F.col("col") == phrase.column)
    out = None
    for i, word in enumerate(phrase.words):
        last = phrase.prefix and i == len(phrase.words) - 1
        match = F.startswith("token", F.lit(word)) if last else F.col("token") == word
        rows = post.where(match).select("doc", "col", (F.col("pos") - i).alias("pos"))
        out = rows if out is None else out.join(rows, ["doc", "col", "pos"])
    if out is None:
        return at.documents.where(F.lit(False)).select("doc", F.lit(0).cast("long").alias("f"))
    return out.groupBy("doc").agg(F.count(F.lit(1)).alias("f"))


def _holds(tree: tuple | Phrase, f: dict[Phrase, Column]) -> Column:
    """Whether a row of phrase counts matches."""
    if isinstance(tree, Phrase):
        return f[tree] > 0
    kind, a, b = tree[0], _holds(tree[1], f), _holds(tree[2], f)
    return a | b if kind == "or" else a & (b if kind == "and" else ~b)


def ranked(at: SearchIndex, query: str, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """(doc, score) of the rows that match; the lowest score, the most negative one, fits best.

    Each phrase is looked up once.  The counts of all phrases meet in one row a document; whether it matches and
    how it ranks are expressions over that row.
    """
    tree = parse(query, columns)
    phrases = list(dict.fromkeys(_phrases(tree)))
    hits = reduce(DataFrame.union, (_hits(at, p).withColumn("p", F.lit(i)) for i, p in enumerate(phrases)))
    rows = materialise(hits.groupBy("doc").agg(*(F.coalesce(F.max(F.when(F.col("p") == i, F.col("f"))), F.lit(0)).alias(f"f{i}") for i in range(len(phrases)))), "hits")
    n = rows.agg(*(F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(phrases)))).first()  # one row
    total, mean = at.documents.agg(F.count(F.lit(1)), F.avg("size")).first()
    out = rows.where(_holds(tree, {p: F.col(f"f{i}") for i, p in enumerate(phrases)})).join(at.documents, "doc")
    score = F.lit(0.0)
    for p in dict.fromkeys(_phrases(tree, ranked_only=True)):
        i = phrases.index(p)
        idf = math.log((total - n[f"n{i}"] + 0.5) / (n[f"n{i}"] + 0.5))
        f = F.col(f"f{i}")
        score = score - F.lit(idf if idf > 0 else 1e-6) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("size") / F.lit(mean)))
    return out.select("doc", score.alias("score"))


def search_symbols(symbols: DataFrame, files: DataFrame, query: str, kind: str | None = None, limit: int = 50, at: SearchIndex | None = None) -> DataFrame:
    """Symbols that match, best first."""
    found = ranked(at or index(symbols), query)
    rows = symbols if kind is None else symbols.where(F.col("kind") == kind)
    paths = files.select(F.col("id").alias("def_file_id"), F.col("path").alias("def_file_path"))
    out = found.join(rows, found["doc"] == rows["id"]).join(paths, "def_file_id", "left").orderBy("score", "id")
    return (out if limit < 0 else out.limit(limit)).select("id", "scip_symbol", "name", "kind", "signature", "def_file_path", "def_start_line", "score")
