"""Operator 1: a quality classifier by n-gram perplexity, with interpolated modified Kneser-Ney smoothing.

After Chen and Goodman, "An empirical study of smoothing techniques for language modeling" (1999), and the
perplexity filter of Wenzek et al., "CCNet" (2020).  The model learns from four of five trusted documents, which are
the labelled documents of quality 1 that are not toxic; the fifth ones, all of them, give for each language the
``QUANTILE`` of perplexity that a document may have.

The model is made of counts, and is made and kept in shards of about ``SHARD_BYTES`` of training text:

1. Words are numbered in the order of their hashes.  A task cuts its training documents into batches of ``SENT`` tokens and
   sends each batch's distinct triples of numbers with their counts to the shard of the triple's middle word.  There the triples of a history and those of a tail are together,
   so that one shuffle serves all counts of triples and pairs; only the words before a word are summed in a second one.
2. A shard is files in the shared folder: for each triple its count; for each history its total and how many of its
   triples have a count of one, two and more; for each pair the words before it; for each word the words before it.
   Discounts come from sums over all shards.
3. A scoring task looks the n-grams of its batch up in one shard after another, in place, so that no n-gram of the
   scored corpus is shuffled.  Local files are mapped, not read.

A table's key has 40 bits besides those of its slot of two to four keys, so a lookup finds another key's count with
probability 4e-12.

``log10_prob`` and ``perplexity`` are the model's, a distribution over words.  What is compared with the threshold has one
rule more, the repeat rule (``repeats=False`` switches it off): a word that repeats the word before it, though trusted
text does not have that repeat (as a pair, or in a run as a triple), counts as an unknown word, ``log10_judged``.  Backed off
probabilities say nothing about a word's own return, so without it runs of one word would pass for text.

The perplexity of a short text says little, so it is averaged with ``PRIOR`` tokens of the held-out
documents' middle perplexity before it is compared.

Defined cases: a null or empty text has its end token only, and is kept; a null language is a language of its own;
languages without ``LEAST`` held-out documents share the threshold of all; without trusted documents
all is kept (threshold null); rows that repeat are scored each; labels that repeat a doc_id count by the
worst; a very long text is scored whole, in one batch; a document at its threshold is kept; other columns pass
unchanged whatever their names, and an output whose name is taken has an underscore behind it.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .tokens import U64, chain, pieces

TRAIN_DOCS, TRAIN_BYTES = 6_000, 16 << 20
HELD_DOCS = 3_000
QUANTILE = 0.995
LEAST = 20
PRIOR = 8
SHARD_BYTES = 8 << 20  # of training text whose triples a shard holds: some million
SENT = 1_000_000  # tokens whose triples are sent together
BATCH = 800_000  # tokens that are scored together
BROADCAST = 200_000  # rows of (doc_id, held)
CACHED = 64  # shards that a task keeps open
ORDER = 3

_BEGIN, _END = U64(0x243F6A8885A308D3), U64(0x13198A2E03707344)


def _stream(piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document two begins, its words, one end; the bounds; and which tokens are scored."""
    h, sizes = piece.hashes(), piece.sizes
    bounds = np.concatenate([[0], np.cumsum(sizes + ORDER)])
    out = np.full(bounds[-1], _BEGIN, U64)
    scored = np.ones(len(out), bool)
    for k in range(ORDER - 1):
        scored[bounds[:-1] + k] = False
    out[bounds[1:] - 1] = _END
    inner = scored.copy()
    inner[bounds[1:] - 1] = False
    out[inner] = h
    return out, bounds, scored


class Table:
    """Values of sorted keys, found by their leading bits; 40 bits of each key are kept besides."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(1, len(keys).bit_length() - 2)  # two to four keys a slot
        starts = np.searchsorted(keys >> U64(64 - bits), np.arange((1 << bits) + 1, dtype=U64))
        self.arrays = [starts.astype(np.int32), keys.astype(np.uint32), (keys >> U64(32)).astype(np.uint8), values]

    @classmethod
    def of(cls, arrays: list[np.ndarray]) -> Table:
        out = cls.__new__(cls)
        out.arrays = arrays
        return out

    def find(self, asked: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        starts, low, high, _ = self.arrays
        out = np.full(len(asked), -1, np.int64)
        if not len(low):
            return out
        slot = (asked >> U64(64 - (len(starts).bit_length() - 1))).view(np.int64)
        at, end = starts[slot], starts[slot + 1]
        rows = np.flatnonzero(at < end)
        at, end, short = at[rows], end[rows], asked[rows].astype(np.uint32)
        while len(rows):
            hit = low[at] == short
            alike = np.flatnonzero(hit)
            same = high[at[alike]] == (asked[rows[alike]] >> U64(32)).astype(np.uint8)
            hit[alike] = same
            alike = alike[same]
            out[rows[alike]] = at[alike]
            at += 1
            rest = np.flatnonzero(~hit & (at < end))
            at, end, rows, short = at[rest], end[rest], rows[rest], short[rest]
        return out

    def get(self, asked: np.ndarray, default: float) -> np.ndarray:
        at = self.find(asked)
        out = np.full(len(asked), default)
        out[at >= 0] = self.arrays[3][at[at >= 0]]
        return out


def _discounts(counts: np.ndarray) -> np.ndarray:
    """The discount for counts of 0, 1, 2 and 3 or more."""
    return _discounts_of(_of_each(counts))


def _of_each(counts: np.ndarray) -> np.ndarray:
    """How many counts are 0, 1, 2, 3, 4, and 5 or more."""
    return np.bincount(np.minimum(counts, 5), minlength=6)


def _discounts_of(each: np.ndarray) -> np.ndarray:
    n = each.astype(float)
    if min(n[1:5]) == 0:
        return np.array([0, 0.5, 0.75, 0.9])
    y = n[1] / (n[1] + 2 * n[2])
    return np.clip([0, 1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]], [0, 0.05, 0.1, 0.1], [0, 0.95, 1.9, 2.9])


def estimate(texts: pa.Array) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The model of texts that one task holds, as train() makes it of any number of them.  Tables by hash: log10 of the probabilities p1..p3 and of the weights b2, b3 that histories leave to shorter ones; 'unknown' is p1 of new words."""
    tokens, scored = [], []
    for piece in pieces(texts):
        t, _, s = _stream(piece)
        tokens.append(t)
        scored.append(s)
    tokens, scored = np.concatenate(tokens), np.concatenate(scored)
    words, ids = np.unique(tokens, return_inverse=True)
    ids, v = ids.astype(np.int32), len(words)
    del tokens
    at = np.flatnonzero(scored).astype(np.int32)
    del scored
    # every pair of neighbours once; those across documents are in no triple and get no count
    keys = ids[:-1].astype(np.int64) * v
    keys += ids[1:]
    pairs, pair = np.unique(keys, return_inverse=True)
    pair = pair.astype(np.int32)  # the pair that starts at each token
    del keys, ids
    triples = pair[at - 2].astype(np.int64) * len(pairs)  # (w1, w2) and then (w2, w3)
    triples += pair[at - 1]
    del pair, at
    triples, c3 = np.unique(triples, return_counts=True)
    head, tail = (triples // len(pairs)).astype(np.int32), (triples % len(pairs)).astype(np.int32)
    del triples
    # continuation counts: of a pair, the words before it; of a word, the words before it
    c2 = np.bincount(tail, minlength=len(pairs))
    seen = np.flatnonzero(c2)
    left, right = pairs[seen] // v, pairs[seen] % v
    c1 = np.bincount(right, minlength=v)

    def spread(counts: np.ndarray, history: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The discounted share of each n-gram in its history, and what each history leaves."""
        d = _discounts(counts)[np.minimum(counts, 3)]
        total = np.bincount(history, weights=counts, minlength=n)
        return (counts - d) / total[history], np.bincount(history, weights=d, minlength=n) / np.maximum(total, 1e-300)

    some = np.flatnonzero(c1)
    d1 = _discounts(c1[some])[np.minimum(c1[some], 3)]
    uniform = d1.sum() / c1.sum() / (len(some) + 1)
    p1 = np.full(v, uniform)
    p1[some] += (c1[some] - d1) / c1.sum()
    share, left2 = spread(c2[seen], left, v)
    p2 = np.zeros(len(pairs))
    p2[seen] = share + left2[left] * p1[right]
    share, left3 = spread(c3, head, len(pairs))
    p3 = share + left3[head] * p2[tail]

    hash2 = chain(words[pairs // v], words[pairs % v])
    hash3 = chain(hash2[head], words[pairs[tail] % v])
    history2, history3 = np.flatnonzero(left2 > 0), np.flatnonzero(left3 > 0)
    out = {"p1": (words[some], p1[some]), "p2": (hash2[seen], p2[seen]), "p3": (hash3, p3), "b2": (words[history2], left2[history2]), "b3": (hash2[history3], left3[history3])}
    return {k: (a, np.log10(b)) for k, (a, b) in out.items()} | {"unknown": (np.zeros(1, U64), np.log10([uniform]))}


# Counts and their shards


def _shard(words: np.ndarray, shards: int) -> np.ndarray:
    """Of each word hash; ascending with it."""
    return ((words >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)


def _squeeze(arrays: list[np.ndarray]) -> bytes:
    """Arrays of 8-byte items, byte by byte of all items, compressed."""
    raw = shared.pack([np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T) for a in arrays])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unsqueeze(blob: bytes, types: list) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd"), np.uint8)
    return [np.ascontiguousarray(a.reshape(8, -1).T).reshape(-1).view(t) for a, t in zip(shared.unpack(raw, [np.uint8] * len(types)), types, strict=True)]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the sum of each one's counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def _triples(a: np.ndarray, b: np.ndarray, c: np.ndarray, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of triples of word numbers under v: the distinct (b, a) and, of each triple, which of them it has and a key that sorts as (b, a, c)."""
    pairs, pair = np.unique(b.astype(np.int64) * v + a, return_inverse=True)
    return pairs, pair, pair.astype(np.int64) * v + c


def _freed(run: Callable) -> Callable:
    """run, after which the worker, which later tasks use again, gives its free memory back."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)

    return runs


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens and which are scored, some SENT tokens at a time."""
    tokens, scored, n = [], [], 0
    for batch in batches:
        for piece in pieces(batch.column("text")):
            t, _, s = _stream(piece)
            tokens.append(t)
            scored.append(s)
            n += len(t)
            if n >= SENT:
                yield np.concatenate(tokens), np.concatenate(scored)
                tokens, scored, n = [], [], 0
    if n:
        yield np.concatenate(tokens), np.concatenate(scored)


_SENT = "shard int, blob binary"


def _blobs(shards: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(blobs, pa.binary())], ["shard", "blob"])


def _received(batches: Iterator[pa.RecordBatch], types: list) -> tuple[int | None, list[list[np.ndarray]]]:
    """A task's shard, if anything came to it, and the arrays of its blobs."""
    shard, got = None, []
    for batch in batches:
        for shard, blob in zip(batch.column("shard").to_pylist(), batch.column("blob"), strict=True):  # noqa: B007
            got.append(_unsqueeze(blob.as_buffer().to_pybytes(), types))
    return shard, got


def _spellers(shards: int):
    """Sends the distinct words of each batch to their shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, _ in _streams(batches):
            words = np.unique(tokens)
            cuts = np.searchsorted(_shard(words, shards), np.arange(shards + 1))
            to = np.flatnonzero(np.diff(cuts)).tolist()
            yield _blobs(to, [_squeeze([words[cuts[s] : cuts[s + 1]]]) for s in to])

    return run


def _vocabulary(uri: str):
    """Writes a shard's distinct words, sorted; gives how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, got = _received(batches, [U64])
        if shard is not None:
            words = np.unique(np.concatenate([g[0] for g in got]))
            shared.put(f"{uri}/vocabulary{shard}", words.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(words)], pa.int64())], ["shard", "n"])

    return run


class Vocabulary:
    """The numbers of words: starts has the first number of each shard, and the end."""

    def __init__(self, uri: str, starts: list[int]):
        self.uri, self.starts = uri, np.array(starts, np.int64)

    def _parts(self, cuts: np.ndarray) -> Iterator[tuple[int, np.ndarray, slice]]:
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            yield int(self.starts[s]), shared.get(f"{self.uri}/vocabulary{s}").view(U64), slice(cuts[s], cuts[s + 1])

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """Of sorted words."""
        out, shards = np.empty(len(words), np.int64), len(self.starts) - 1
        for start, known, part in self._parts(np.searchsorted(_shard(words, shards), np.arange(shards + 1))):
            at = np.searchsorted(known, words[part])
            if at.max() >= len(known) or (known[at] != words[part]).any():
                raise ValueError("the rows of the trusted documents were others when they were read again")
            out[part] = start + at
        return out

    def words(self, numbers: np.ndarray) -> np.ndarray:
        """Of sorted numbers."""
        out = np.empty(len(numbers), U64)
        for start, known, part in self._parts(np.searchsorted(numbers, self.starts)):
            out[part] = known[numbers[part] - start]
        return out


def _senders(known: Vocabulary):
    """Sends each batch's distinct triples to the shard of their middle word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, scored in _streams(batches):
            words, ids = np.unique(tokens, return_inverse=True)
            ids, at, v = ids.astype(np.int32), np.flatnonzero(scored), len(words)
            del tokens, scored
            pairs, _, key = _triples(ids[at - 2], ids[at - 1], ids[at], v)
            del ids, at
            key, n = np.unique(key, return_counts=True)
            number = known.numbers(words)
            pair, c = key // v, number[key % v]
            del key
            a, b = number[pairs[pair] % v], number[pairs[pair] // v]
            cuts = np.searchsorted(b, known.starts)
            to = np.flatnonzero(np.diff(cuts)).tolist()
            yield _blobs(to, [_squeeze([a[i:j], np.diff(b[i:j], prepend=0), c[i:j], n[i:j].astype(np.int64)]) for i, j in ((cuts[s], cuts[s + 1]) for s in to)])

    return run


def _coded(columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows of counts as numbers of distinct rows, in as few bytes as these need, and the distinct rows' columns."""
    code = np.zeros(len(columns[0]), np.int64)
    for x in columns:
        values, of = np.unique(x, return_inverse=True)
        _, first, code = np.unique(code * max(1, len(values)) + of, return_index=True, return_inverse=True)
    kind = next(k for k in (np.uint8, np.uint16, np.uint32) if len(first) <= np.iinfo(k).max + 1)
    return code.astype(kind), [x[first] for x in columns]


def _table(keys: np.ndarray, columns: list[np.ndarray]) -> list[np.ndarray]:
    """The arrays of a Table of codes, and the columns."""
    order = np.argsort(keys)
    code, columns = _coded(columns)
    return [*Table(keys[order], code[order]).arrays, *columns]


def _read(raw: np.ndarray, widths: list[int]) -> list[tuple[Table, list[np.ndarray]]]:
    """Tables of so many columns."""
    kinds = [k for w in widths for k in [np.int32, np.uint32, np.uint8, np.uint8, *[np.int64] * w]]
    arrays, out = shared.unpack(np.asarray(raw), kinds), []  # plain arrays: indexing mapped ones takes longer
    for w in widths:
        starts, low, high, code = arrays[:4]
        code = code.view({1: np.uint8, 2: np.uint16, 4: np.uint32}[max(1, len(code) // max(1, len(low)))])
        out.append((Table.of([starts, low, high, code]), arrays[4 : 4 + w]))
        arrays = arrays[4 + w :]
    return out


def _split(history: np.ndarray, counts: np.ndarray, n: int) -> list[np.ndarray]:
    """Of each of n histories the sum of its counts, and how many are 1, 2, and 3 or more."""
    by = np.bincount(history * 3 + np.minimum(counts, 3) - 1, minlength=3 * n).reshape(n, 3)
    return [np.bincount(history, weights=counts, minlength=n).astype(np.int64), *(np.ascontiguousarray(x) for x in by.T.astype(np.int64))]


_FOUND = "shard int, gram int, blob binary, each array<long>, total long"


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["shard", "gram", "blob", "each", "total"])


def _counter(uri: str, known: Vocabulary):
    """Writes a shard's counts of triples, histories, pairs and words as histories; gives sums, and to each shard of words how many pairs end in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, got = _received(batches, [np.int64] * 4)
        if shard is None:
            return
        numbers = np.unique(np.concatenate([np.unique(x) for g in got for x in (g[0], np.cumsum(g[1]), g[2])]))
        words, v = known.words(numbers), len(numbers)
        a, b, c = (np.searchsorted(numbers, np.concatenate(x)).astype(np.int32) for x in ([g[0] for g in got], [np.cumsum(g[1]) for g in got], [g[2] for g in got]))
        counts = np.concatenate([g[3] for g in got])
        got.clear()
        pairs, _, key = _triples(a, b, c, v)
        del a, b, c
        key, c3 = _summed(key, counts)
        head, c = key // v, key % v
        del key, counts
        first, middle = words[pairs % v], pairs // v
        history = chain(first, words[middle])
        file = _table(chain(history[head], words[c]), [c3]) + _table(history, _split(head, c3, len(pairs)))
        tails, c2 = np.unique(middle[head] * v + c, return_counts=True)
        left, right = tails // v, tails % v
        file += _table(chain(words[left], words[right]), [c2])
        lefts, of = np.unique(left, return_inverse=True)
        file += _table(words[lefts], _split(of, c2, len(lefts)))
        shared.put(f"{uri}/{shard}", shared.pack(file))
        rows = [(shard, 3, None, _of_each(c3).tolist(), None), (shard, 2, None, _of_each(c2).tolist(), None)]
        rights, c1 = np.unique(right, return_counts=True)
        cuts = np.searchsorted(numbers[rights], known.starts)
        rows += [(s, 1, _squeeze([np.diff(numbers[rights[i:j]], prepend=0), c1[i:j].astype(np.int64)]), None, None) for s, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if j > i]
        yield _found(rows)

    return run


def _word_counter(uri: str, known: Vocabulary):
    """Writes a shard's counts of the words before each word; gives sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, got = _received(batches, [np.int64] * 2)
        if shard is None:
            return
        numbers, c1 = _summed(np.concatenate([np.cumsum(g[0]) for g in got]), np.concatenate([g[1] for g in got]))
        words = known.words(numbers)
        shared.put(f"{uri}/words{shard}", shared.pack(_table(words, [c1])))
        yield _found([(shard, 1, None, _of_each(c1).tolist(), int(c1.sum()))])

    return run


class Model:
    """The shards of a model in the shared folder, and the sums over all of them."""

    def __init__(self, uri: str, shards: int, sums: list[tuple[int, int, list[int], int | None]]):
        self.uri, self.shards = uri, shards
        self.have = {(k == 1, s) for s, k, _, _ in sums}
        each = {k: sum(np.array(e) for _, g, e, _ in sums if g == k) for k in (1, 2, 3)}
        self.discounts = {k: _discounts_of(each[k]) for k in each}
        self.total, words = sum(t for _, k, _, t in sums if k == 1), int(each[1][1:].sum())
        left = float(self.discounts[1][[0, 1, 2, 3, 3, 3]] @ each[1])
        self.unknown = left / self.total / (words + 1)
        self.open: dict = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"open": {}}

    def _tables(self, of_words: bool, i: int) -> list:
        """The tables of a shard: of histories, what their counts leave to shorter ones and the total instead of the numbers of counts."""
        if (of_words, i) not in self.open:
            if len(self.open) >= CACHED:
                del self.open[next(iter(self.open))]
            if of_words:
                ((table, (c1,)),) = _read(shared.get(f"{self.uri}/words{i}"), [1])
                self.open[of_words, i] = [(table, c1)]
            else:
                triples, histories, pairs, words = _read(shared.get(f"{self.uri}/{i}"), [1, 4, 1, 4])
                leave = lambda k, x: sum(d * n for d, n in zip(self.discounts[k][1:], x[1:], strict=True)) / np.maximum(x[0], 1)
                self.open[of_words, i] = [(triples[0], triples[1][0]), (histories[0], histories[1][0], leave(3, histories[1])), (pairs[0], pairs[1][0]), (words[0], words[1][0], leave(2, words[1]))]
        return self.open[of_words, i]

    def _parts(self, of_words: bool, words: np.ndarray) -> Iterator[tuple[list, np.ndarray]]:
        """The tables of each shard of the words that the model has, and the words' places."""
        shard = _shard(words, self.shards)
        order = np.argsort(shard, kind="stable")
        at = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for i in np.flatnonzero(np.diff(at)).tolist():
            if (of_words, i) in self.have:
                yield self._tables(of_words, i), order[at[i] : at[i + 1]]

    def log_probabilities(self, tokens: np.ndarray, scored: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 p of each scored token, and the same under the repeat rule."""
        at = np.flatnonzero(scored)
        before, middle, last = tokens[at - 2], tokens[at - 1], tokens[at]

        def counted(table: tuple, asked: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
            """The rows that the table has, and its columns for them."""
            place = table[0].find(asked)
            hit = place >= 0
            code = table[0].arrays[3][place[hit]]
            return rows[hit], [x[code] for x in table[1:]]

        def share(k: int, counts: np.ndarray) -> np.ndarray:
            return counts - self.discounts[k][np.minimum(counts, 3)]

        p = np.full(len(at), self.unknown)
        for tables, rows in self._parts(True, last):
            rows, (c1,) = counted(tables[0], last[rows], rows)
            p[rows] += share(1, c1) / self.total
        paired, tripled = np.zeros(len(at), bool), np.zeros(len(at), bool)
        sums = np.zeros(len(at))
        for (triples, histories, pairs, words), rows in self._parts(False, middle):
            rows, (total, leave) = counted(words, middle[rows], rows)  # what is no middle word is in no history
            p[rows] *= leave
            sums[rows] = total
            seen, (c2,) = counted(pairs, chain(middle[rows], last[rows]), rows)
            p[seen] += share(2, c2) / sums[seen]
            paired[seen] = True
            pair = chain(before[rows], middle[rows])
            rows, (total, leave) = counted(histories, pair, rows)
            p[rows] *= leave
            sums[rows] = total
            seen, (c3,) = counted(triples, chain(chain(before[rows], middle[rows]), last[rows]), rows)
            p[seen] += share(3, c3) / sums[seen]
            tripled[seen] = True
        out = np.log10(p)
        judged = out.copy()
        once = (last == middle) & ~tripled
        judged[once & ((middle == before) | ~paired)] = np.log10(self.unknown)
        return out, judged


def train(trusted: DataFrame, text: str = "text", shard_bytes: int = SHARD_BYTES) -> Model | None:
    """A model of all rows of trusted; None if there are none."""
    spark = trusted.sparkSession
    plain = trusted.select(F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0]
    if size is None:
        return None
    shards = size // shard_bytes + 1
    uri = shared.place(spark, "quality")

    def by_shard(df: DataFrame, f: Callable, schema: str) -> DataFrame:
        return df.repartitionById(shards, F.col("shard")).mapInArrow(_freed(f), schema)

    spelt = by_shard(plain.mapInArrow(_freed(_spellers(shards)), _SENT), _vocabulary(uri), "shard int, n long")
    sizes = {r["shard"]: r["n"] for r in spelt.collect()}  # a row a shard
    known = Vocabulary(uri, np.cumsum([0, *(sizes.get(s, 0) for s in range(shards))]).tolist())
    found = shared.materialise(by_shard(plain.mapInArrow(_freed(_senders(known)), _SENT), _counter(uri, known), _FOUND), "counts")
    words = by_shard(found.where("blob is not null").select("shard", "blob"), _word_counter(uri, known), _FOUND)
    sums = [r for df in (found.where("blob is null"), words) for r in df.select("shard", "gram", "each", "total").collect()]  # three rows a shard
    return Model(uri, shards, [tuple(r) for r in sums])


_SCORED = "n_tokens long, log10_prob double, log10_judged double"


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """keep, n_tokens, log10_prob and log10_judged of each row of docs."""
    return shared.beside(_score(docs, model, keep, text), keep, ["n_tokens", "log10_prob", "log10_judged"])


def _score(docs: DataFrame, model: Model, keep: list[str], text: str) -> DataFrame:
    plain, inside = shared.text_of(docs, keep, text)

    def scored(lines: list[pa.Array], got: list) -> pa.RecordBatch:
        tokens, mask = np.concatenate([t for t, _, _ in got]), np.concatenate([s for _, _, s in got])
        sizes = np.concatenate([np.diff(b) for _, b, _ in got]) - (ORDER - 1)
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        sums = [np.add.reduceat(x, first) for x in model.log_probabilities(tokens, mask)]
        rows = pa.concat_arrays(lines)
        lines.clear()
        return pa.RecordBatch.from_arrays([rows, pa.array(sizes, pa.int64()), *map(pa.array, sums)], ["row", "n_tokens", "log10_prob", "log10_judged"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, got, n = [], [], 0
        for batch in batches:
            for piece in pieces(shared.texts(batch, inside)):
                got.append(_stream(piece))
                lines.append(batch.column("row").slice(piece.first, piece.docs))
                n += len(got[-1][0])
                if n >= BATCH:
                    yield scored(lines, got)
                    lines, got, n = [], [], 0
        if got:
            yield scored(lines, got)

    return plain.mapInArrow(_freed(run), shared.widened(plain, _SCORED))


def _good(labels: DataFrame) -> DataFrame:
    """doc_id of the trusted documents, once each."""
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic")).where("quality = 1 and toxic = 0")


def trusted(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Training and held-out trusted documents (doc_id, lang, text): every one of them; by a hash of doc_id, every fifth is held out."""
    good = _good(labels).select("doc_id", (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.lit(5)) == 0).alias("held"))
    rows = docs.select("doc_id", "lang", "text").join(shared.bounded(shared.materialise(good, "trusted"), BROADCAST), "doc_id")
    return rows.where("not held").drop("held"), rows.where("held").drop("held")


def trusted_sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """trusted(), cut to a sample in the order of a hash, for those who try things out: no query and no stage uses it.

    A document that would exceed TRAIN_BYTES is passed over, so TRAIN_BYTES bounds what the one training task holds.  Every fifth goes to the held-out ones, so that small tables serve both.
    """
    good = _good(labels)
    order = F.xxhash64(F.col("doc_id"), F.lit(1))
    good = good.join(docs.select("doc_id"), "doc_id", "left_semi")
    picked = good.select("doc_id", order.alias("order")).orderBy("order").limit(TRAIN_DOCS + HELD_DOCS)
    picked = picked.withColumn("held", F.pmod("order", F.lit(5)) == 0)
    rows = docs.select("doc_id", "lang", "text").join(F.broadcast(picked), "doc_id")  # at most TRAIN_DOCS + HELD_DOCS rows of three short columns
    rows = shared.materialise(rows, "trusted")
    sizes = [(r["order"], r["n"]) for r in rows.where("not held").groupBy("order").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n")).orderBy("order").limit(TRAIN_DOCS).collect()]  # numbers only, TRAIN_DOCS at most
    total, fit = 0, []
    for key, n in sizes:
        if total + n <= TRAIN_BYTES:
            total += n
            fit.append(key)
    fit = docs.sparkSession.createDataFrame([(k,) for k in fit], "order long")
    train_rows = rows.where("not held").join(F.broadcast(fit), "order", "left_semi").orderBy("order", "text").limit(TRAIN_DOCS)
    return train_rows.select("doc_id", "lang", "text"), rows.where("held").orderBy("order").limit(HELD_DOCS).select("doc_id", "lang", "text")


def thresholds(scored: DataFrame) -> DataFrame:
    """(lang, middle, threshold, n): of each language of the held-out documents (lang, n_tokens, x), x in log10 per token."""
    middle = scored.groupBy("lang").agg(F.median("x").alias("middle"), F.count(F.lit(1)).alias("n"))
    rows = scored.join(middle.withColumnRenamed("lang", "l"), F.col("lang").eqNullSafe(F.col("l"))).withColumn("y", (F.col("x") * F.col("n_tokens") + PRIOR * F.col("middle")) / (F.col("n_tokens") + PRIOR))
    return rows.groupBy("lang").agg(F.first("middle").alias("middle"), F.percentile("y", F.lit(QUANTILE)).alias("threshold"), F.first("n").alias("n"))


OUTPUTS = ["n_tokens", "log10_prob", "perplexity", "log10_judged", "threshold", "kept"]


def classify(docs: DataFrame, labels: DataFrame, keep: list[str], repeats: bool = True) -> DataFrame:
    """keep and OUTPUTS of each row of docs (doc_id, lang, text)."""
    return shared.beside(_classified(docs, labels, keep, repeats), keep, OUTPUTS)


def _classified(docs: DataFrame, labels: DataFrame, keep: list[str], repeats: bool) -> DataFrame:
    fit, held = trusted(docs, labels)
    model = train(fit)
    if model is None:
        none = lambda kind: F.lit(None).cast(kind)
        return shared.packed(docs, keep, n_tokens=none("long"), log10_prob=none("double"), perplexity=none("double"), log10_judged=none("double"), threshold=none("double"), kept=F.lit(True))
    judged = "log10_judged" if repeats else "log10_prob"
    known = shared.materialise(score(held, model, ["lang"]).select("lang", "n_tokens", (-F.col(judged) / F.col("n_tokens")).alias("x")), "held")
    whole = thresholds(known.withColumn("lang", F.lit(""))).first()
    per = shared.materialise(thresholds(known).where(F.col("n") >= LEAST).select(F.col("lang").alias("of"), "middle", F.col("threshold").alias("limit")), "thresholds")
    scored = _score(docs.withColumn("__lang", F.col("lang")), model, [*keep, "__lang"], "text")
    out = scored.join(F.broadcast(per), scored["row"]["__lang"].eqNullSafe(per["of"]), "left")  # a row a language
    every = (F.lit(whole["middle"]), F.lit(whole["threshold"])) if whole else (F.lit(None).cast("double"), F.lit(None).cast("double"))
    middle, limit = F.coalesce("middle", every[0]), F.coalesce("limit", every[1])
    smooth = (-F.col(judged) + PRIOR * middle) / (F.col("n_tokens") + PRIOR)
    out = out.withColumns({"perplexity": F.pow(F.lit(10.0), -F.col("log10_prob") / F.col("n_tokens")), "threshold": F.pow(F.lit(10.0), limit)})
    return out.withColumn("kept", F.coalesce(smooth <= limit, F.lit(True)) | (F.col("n_tokens") <= 1))


def accepted(docs: DataFrame, labels: DataFrame, repeats: bool = True) -> DataFrame:
    """docs without the documents that the classifier rejects."""
    return _classified(docs, labels, docs.columns, repeats).where("kept").select(*(F.col("row")[k].alias(k) for k in docs.columns))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ["doc_id", "lang"])
