"""Operator 9: benchmark decontamination with an FM-index per shard of the training text.

After Ferragina and Manzini, "Opportunistic data structures with applications" (2000), over words
instead of characters.  A task cuts its documents into shards of ``SHARD`` words.  Of a shard it indexes
the runs of words that the benchmark has, as long as they could hold a window (other words
cannot be in any occurrence, so nothing is lost): suffix order by prefix doubling, Burrows-Wheeler
transform, wavelet matrix with popcount ranks, and every eighth suffix position.  All windows of the
benchmark are searched backward at once; rows still alive after the last word are occurrences, which
walk back to a sampled position.  Their spans are merged per document.

The benchmark is a stated query set.  It is cut into blocks of about ``BLOCK`` bytes, written to the
shared folder; a task searches block after block, so neither side is ever held whole.

A window is 13 consecutive words of an item; an item of fewer, but not none, is one window.

Defined cases: null or empty texts have no words and are clean; null or empty items have no windows; a null
item_id counts as an empty name; items that repeat an id count once; an empty benchmark, or an empty block of it,
leaves all clean; rows that repeat are judged each; a text of any length is one shard at most longer than ``SHARD``;
there are no ties (a word is hit or not); other columns pass through ``keep`` unchanged whatever their names, and an
output whose name is taken has an underscore behind it.  A block whose file is lost is an error, never read as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .tokens import ALNUM, U64, pieces

WINDOW = 13
SHARD = 3_000_000  # words
BLOCK = 8 << 20
SAMPLE = 8


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The order of the suffixes of symbols above 0; each 0 is a separator of its own, smaller than all symbols, and text ends with one."""
    n = len(text)
    ends = text == 0
    separators = int(ends.sum())
    rank = np.empty(n, np.int64)
    rank[ends] = np.arange(separators)
    # a symbol's rank is the place of its first suffix
    counts = np.bincount(text[~ends], minlength=1)
    before = np.concatenate([[0], np.cumsum(counts)[:-1]]) + separators
    rank[~ends] = before[text[~ends]]
    active = np.flatnonzero(~ends & (counts[text] > 1))
    k = 1
    while len(active):
        key = (rank[active].astype(U64) << U64(32)) | rank[np.minimum(active + k, n - 1)].astype(U64)
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        old = key >> U64(32)
        fresh = np.concatenate([[True], old[1:] != old[:-1]])
        at = np.arange(len(active))
        start, group = np.maximum.accumulate(np.where(new, at, 0)), np.maximum.accumulate(np.where(fresh, at, 0))
        rank[active] = old.astype(np.int64) + start - group
        last = np.concatenate([new[1:], [True]])
        active = active[~(new & last)]
        k *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class Wavelet:
    """A wavelet matrix: ranks of symbols in a sequence."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.n = len(sequence)
        self.words, self.ranks, self.zeros = [], [], []
        now, begin = sequence, np.zeros(symbols, np.int64)
        every = np.arange(symbols)
        for level in reversed(range(self.levels)):
            bit = ((now >> level) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(len(bit) // 64 + 1, U64)
            words.view(np.uint8)[: len(packed)] = packed
            self.words.append(words)
            self.ranks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]))
            self.zeros.append(int(len(bit) - bit.sum()))
            begin = self._step(len(self.words) - 1, begin, (every >> level) & 1)
            now = np.concatenate([now[~bit], now[bit]])
        self.begin = begin

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        mask = (U64(1) << (i & 63).astype(U64)) - U64(1)
        return self.ranks[level][w] + np.bitwise_count(self.words[level][w] & mask).astype(np.int64)

    def _step(self, level: int, i: np.ndarray, bit: np.ndarray) -> np.ndarray:
        ones = self._ones(level, i)
        return np.where(bit == 1, self.zeros[level] + ones, i - ones)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first i."""
        for level in range(self.levels):
            i = self._step(level, i, (symbol >> (self.levels - 1 - level)) & 1)
        return i - self.begin[symbol]


class FMIndex:
    """Counts and places of phrases in a text of symbols 1..symbols-1 that 0 separates and ends."""

    def __init__(self, text: np.ndarray, symbols: int):
        order = suffix_order(text)
        self.last = text[order - 1].astype(np.int64)  # the transform; the first suffix's is the end, a 0
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))]).astype(np.int64)
        self.wavelet = Wavelet(self.last, symbols)
        self.kept = (order % SAMPLE == 0) | (self.last == 0)
        self.place = np.where(self.kept, order, -1)[self.kept]
        self.slot = np.cumsum(self.kept) - 1

    def search(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The phrases (rows, padded on the left) that occur, and their ranges of rows."""
        width = phrases.shape[1]
        live = np.flatnonzero(sizes > 0)
        low, high = np.zeros(len(live), np.int64), np.full(len(live), self.wavelet.n, np.int64)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for step in range(width):
            over = sizes[live] == step
            if over.any():
                done.append((live[over], low[over], high[over]))
                live, low, high = live[~over], low[~over], high[~over]
            c = phrases[live, width - 1 - step]
            low, high = self.first[c] + self.wavelet.rank(c, low), self.first[c] + self.wavelet.rank(c, high)
            some = low < high
            live, low, high = live[some], low[some], high[some]
        done.append((live, low, high))
        return tuple(np.concatenate([d[i] for d in done]) for i in range(3))

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text positions of the suffixes in these rows."""
        out, at, todo, steps = np.empty(len(rows), np.int64), rows, np.arange(len(rows)), 0
        while len(todo):
            hit = self.kept[at]
            out[todo[hit]] = self.place[self.slot[at[hit]]] + steps
            todo, at = todo[~hit], at[~hit]
            c = self.last[at]
            at = self.first[c] + self.wavelet.rank(c, at)
            steps += 1
        return out


class Benchmark:
    """The blocks of items in the shared folder."""

    def __init__(self, items: DataFrame, block: int = BLOCK):
        spark = items.sparkSession
        items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("text"))
        size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.uri, self.blocks = shared.place(spark, "benchmark"), size // block + 1
        uri = self.uri

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by: dict[int, list[pa.RecordBatch]] = {}
            for batch in batches:
                blocks = batch.column("block")
                for b in blocks.unique().to_pylist():
                    by.setdefault(b, []).append(batch.filter(pa.compute.equal(blocks, b)))
            for b, rows in by.items():
                names: list[bytes] = []
                hashes, sizes = [], []
                for r in rows:
                    names += [x.encode() for x in r.column("item").to_pylist()]
                    for piece in pieces(r.column("text"), ALNUM):
                        hashes.append(piece.hashes())
                        sizes.append(piece.sizes)
                ends = np.cumsum([len(x) for x in names], dtype=np.int64)
                shared.put(f"{uri}/{b}", shared.pack([np.concatenate(hashes), np.concatenate(sizes).astype(np.int64), ends, np.frombuffer(b"".join(names), np.uint8)]))
            yield pa.RecordBatch.from_arrays([pa.array(list(by), pa.int32())], ["block"])

        n = self.blocks
        done = items.withColumn("block", (F.pmod(F.xxhash64("item", "text"), F.lit(n))).cast("int")).repartitionById(n, F.col("block")).mapInArrow(write, "block int")
        self.written = sorted(r["block"] for r in done.collect())  # a number for each block of items

    def load(self, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """The block's words, its windows (rows of words, padded on the left), their sizes and items, and the items' names."""
        hashes, sizes, ends, names = shared.unpack(shared.get(f"{self.uri}/{block}"), [U64, np.int64, np.int64, np.uint8])
        words, symbol = np.unique(hashes, return_inverse=True)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        windows = np.where(sizes > 0, np.maximum(sizes - WINDOW + 1, 1), 0)
        item = np.repeat(np.arange(len(sizes)), windows)
        start = np.arange(len(item)) - np.repeat(np.concatenate([[0], np.cumsum(windows)[:-1]]), windows) + bounds[:-1][item]
        size = np.minimum(sizes[item], WINDOW)
        column = np.arange(WINDOW)[None, :] - (WINDOW - size)[:, None]
        phrases = np.where(column >= 0, (symbol + 1)[np.minimum(start[:, None] + np.maximum(column, 0), max(len(symbol) - 1, 0))], 0) if len(item) else np.zeros((0, WINDOW), np.int64)
        raw = names.tobytes()
        return words, phrases, size, item, [raw[a:b].decode() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def occurrences(hashes: np.ndarray, bounds: np.ndarray, words: np.ndarray, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where (word of the shard) and which windows occur in the documents that bounds cuts out of hashes."""
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    if not len(sizes) or not len(hashes):
        return none
    at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
    known = words[at] == hashes
    before = np.concatenate([[False], known[:-1]])
    after = np.concatenate([known[1:], [False]])
    inner = bounds[(bounds > 0) & (bounds < len(hashes))]
    before[inner] = False
    after[inner - 1] = False
    start, stop = np.flatnonzero(known & ~before), np.flatnonzero(known & ~after) + 1
    long = stop - start >= int(sizes.min())
    start, width = start[long], (stop - start)[long]
    if not len(start):
        return none
    # each run and a separator after it; origin: the word of the shard at each place
    first = np.concatenate([[0], np.cumsum(width + 1)])
    origin = np.arange(first[-1]) + np.repeat(start - first[:-1], width + 1)
    text = np.zeros(first[-1], np.int64)
    inside = np.ones(first[-1], bool)
    inside[first[1:] - 1] = False
    text[inside] = at[origin[inside]] + 1
    index = FMIndex(text, len(words) + 1)
    which, low, high = index.search(phrases, sizes)
    n = high - low
    rows = np.arange(n.sum()) + np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    return origin[index.locate(rows)], np.repeat(which, n)


def _judge(parts: list, benchmark: Benchmark) -> tuple[np.ndarray, np.ndarray, list[list[str]], np.ndarray]:
    """Words and hit words of each document of a shard, the names of its items, and which words are hit."""
    hashes = np.concatenate([h for h, _ in parts])
    sizes = np.concatenate([s for _, s in parts])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    edge = np.zeros(len(hashes) + 1, np.int64)
    names: list[set[str]] = [set() for _ in sizes]
    for block in benchmark.written:
        words, phrases, size, item, ids = benchmark.load(block)
        where, which = occurrences(hashes, bounds, words, phrases, size)
        edge += np.bincount(where, minlength=len(edge)) - np.bincount(where + size[which], minlength=len(edge))
        doc = np.searchsorted(bounds, where, "right") - 1
        for pair in np.unique(doc * len(ids) + item[which]).tolist():
            names[pair // len(ids)].add(ids[pair % len(ids)])
    hit = np.cumsum(edge[:-1]) > 0
    sums = np.concatenate([[0], np.cumsum(hit)])
    return sizes, sums[bounds[1:]] - sums[bounds[:-1]], [sorted(n) for n in names], hit


def contamination(docs: DataFrame, items: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep, n_words, n_hit, items (their ids, sorted) and spans (merged UTF-8 byte ranges of hit words) of each row of docs."""
    return shared.beside(_contamination(docs, items, keep, text), keep, ["n_words", "n_hit", "items", "spans"])


def _contamination(docs: DataFrame, items: DataFrame, keep: list[str], text: str) -> DataFrame:
    benchmark = Benchmark(items)
    plain, inside = shared.text_of(docs, keep, text)

    def judged(lines: list[pa.Array], parts: list, places: list) -> pa.RecordBatch:
        sizes, n_hit, names, hit = _judge(parts, benchmark)
        starts, ends = np.concatenate([a for a, _ in places]), np.concatenate([b for _, b in places])
        spans: list[list] = []
        at = 0
        for n, h in zip(sizes.tolist(), n_hit.tolist(), strict=True):
            if h:
                own = hit[at : at + n]
                first = np.flatnonzero(own & ~np.concatenate([[False], own[:-1]]))
                last = np.flatnonzero(own & ~np.concatenate([own[1:], [False]]))
                spans.append([{"start": a, "end": b} for a, b in zip(starts[at + first].tolist(), ends[at + last].tolist(), strict=True)])
            else:
                spans.append([])
            at += n
        rows = pa.concat_arrays(lines)
        lines.clear()
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([rows, pa.array(sizes, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(spans, kind)], ["row", "n_words", "n_hit", "items", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, parts, places, n = [], [], [], 0
        for batch in batches:
            for piece in pieces(shared.texts(batch, inside), ALNUM):
                parts.append((piece.hashes(), piece.sizes))
                shift = np.repeat(piece.bounds[:-1], piece.sizes)
                places.append(((piece.starts - shift).astype(np.int32), (piece.ends - shift).astype(np.int32)))
                lines.append(batch.column("row").slice(piece.first, piece.docs))
                n += len(piece.starts)
                if n >= SHARD:
                    yield judged(lines, parts, places)
                    lines, parts, places, n = [], [], [], 0
        if lines:
            yield judged(lines, parts, places)

    return plain.mapInArrow(run, shared.widened(plain, "n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>"))


CONTAMINATED = "n_hit > 0 and 20 * n_hit >= n_words"


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """docs without the contaminated ones, and without the merged spans in the others; n_chars follows the text."""
    columns = docs.columns
    found = _contamination(docs, items, columns, text).where(f"not ({CONTAMINATED})").withColumn("t", F.col("row")[text])
    # the bytes between the spans
    pieces_ = """concat_ws('', transform(sequence(0, size(spans)), i -> decode(substring(cast(t as binary),
        cast(if(i = 0, 0, spans[i - 1].end) as int) + 1,
        cast(if(i = size(spans), octet_length(t), spans[i].start) - if(i = 0, 0, spans[i - 1].end) as int)), 'UTF-8')))"""
    cut = F.when(F.size("spans") > 0, F.expr(pieces_)).otherwise(F.col("t"))
    found = found.select("row", "spans", cut.alias("cut"))
    out = {k: F.col("row")[k] for k in columns} | {text: F.col("cut")}
    if "n_chars" in columns:
        out["n_chars"] = F.when(F.size("spans") > 0, F.char_length("cut").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("row")["n_chars"])
    return found.select(*(c.alias(k) for k, c in out.items()))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), F.expr(CONTAMINATED).alias("contaminated"))
