"""Operator 3: language-model scoring with a log-frequency Bloom filter.

After Talbot and Osborne, "Smoothed Bloom filter language models" (2007).  An n-gram of count c has
the quantised level ``1 + floor(log_b c)`` and is entered once for each level up to its own; a reader
probes level after level until one is missing.

The filter of a corpus grows with it, so it is not broadcast whole: it is cut by key range into shards of about
``SHARD_BYTES`` of text each, and the n-grams come to their shard, once, for both purposes:

1. A task cuts its documents into batches of ``BATCH`` tokens.  A batch's rows are written to the shared folder; its
   distinct n-gram keys, sorted, with the number of times that learned documents have them, go to the shards.
2. A shard's task sums the counts, enters them into the filter (words stay exact), probes it with every distinct
   key that was sent, and answers each batch in the order of its keys.  Its sums go to the driver.
3. The answers come back to the batches, which are read again and scored.

Every n-gram moves once, as a difference of four bytes mostly, and every answer once, as a byte; no task reads the
whole model, and what one holds does not grow with the corpus.  Word keys have 63 bits, those of longer n-grams 48,
which two of them share with a probability far under that of a false positive of the filter.  A batch's name holds its
content's fingerprint: a task that runs again writes the same, and answers to other content are an error, never used.

Probability of a word after a history h, absolute discounting down to add-one unigrams:
``max(c(hw)-D, 0)/c(h) + D*N(h)/c(h) * p(w|h')``.  The number N(h) of distinct successors is taken
as ``c(h)^beta``, with beta solved per order so that the sum over all histories is the number of
distinct n-grams of the whole corpus; D comes from the counts of counts.

Defined cases: a null text is empty and has only its end token; an empty table gives no rows; a null
doc_id is learned from (its checksum is taken as 0); repeated rows count each time; a very long text is one batch,
whole; there are no ties; where nothing is learned from, every word is unknown; kept columns pass unchanged whatever
their names, and an output whose name is taken has an underscore behind it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .tokens import U64, chain, mix, pieces

END = U64(0x5851F42D4C957F2D)
BASE = 1.5
BITS, PROBES = 8, 5
BATCH = 1_500_000  # tokens that are keyed and scored at once
SHARD_BYTES = 12 << 20  # of text whose n-grams a shard holds: some six million keys
ORDERS = 3

#: The least count of each level.
_LEVELS = np.unique(np.ceil(BASE ** np.arange(0, 100) - 1e-9))


def level(counts: np.ndarray) -> np.ndarray:
    """The quantised level, 1 for a count of 1."""
    return np.searchsorted(_LEVELS, counts.astype(np.float64), "right").astype(np.uint8)


#: The count that stands for each level: the middle of the counts that it holds.
LEVEL_COUNT = np.concatenate([[0.0], [(a + b - 1) / 2 for a, b in zip(_LEVELS[:-1], _LEVELS[1:], strict=True)]])


def stream(piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with an end after each document, the documents' bounds, and each token's place in its document."""
    h, sizes = piece.hashes(), piece.sizes
    bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
    out = np.full(bounds[-1], END, U64)
    keep = np.ones(len(out), bool)
    keep[bounds[1:] - 1] = False
    out[keep] = h
    at = np.arange(len(out)) - np.repeat(bounds[:-1], sizes + 1)
    return out, bounds, at


def grams(tokens: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """For each order from 1 the keys of the n-grams that end at each token; meaningless where at < order - 1."""
    out = [tokens]
    for _ in range(1, ORDERS):
        last = out[-1]
        keys = np.zeros_like(tokens)
        keys[1:] = chain(last[:-1], tokens[1:])
        out.append(keys)
    return out


# Keys and their way to the shards and back


def distinct(keys: np.ndarray, order: int, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of an order as they are sent, distinct and sorted, and how many of each are learned."""
    keys = np.sort((keys >> U64(1 if order == 1 else 16)) << U64(1) | learned.astype(U64))
    bit = (keys & U64(1)).astype(np.int64)
    keys >>= U64(1)
    if not len(keys):
        return keys, bit
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(bit, first)


def _steps(width: int) -> int:
    return (1 << (8 * width)) - 1


def _encode(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences of four bytes, six or eight where one needs more; counts of one byte with the larger ones apart."""
    steps = np.diff(keys, prepend=U64(0))
    most = int(steps[1:].max(initial=0))
    wide = next(w for w in (4, 6, 8) if most <= _steps(w))
    first = keys[:1].tobytes() or b"\0" * 8
    body = steps[1:].view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()
    big = np.flatnonzero(counts > 255)
    return np.array([len(keys), wide, len(big)], np.int64).tobytes() + first + body + np.minimum(counts, 255).astype(np.uint8).tobytes() + big.astype(np.int64).tobytes() + counts[big].astype(np.int64).tobytes()


def _decode(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, wide, big = np.frombuffer(raw, np.int64, 3).tolist()
    if not n:
        return np.empty(0, U64), np.empty(0, np.int64)
    at = 24
    steps = np.zeros((n, 8), np.uint8)
    steps[0] = np.frombuffer(raw, np.uint8, 8, at)
    steps[1:, :wide] = np.frombuffer(raw, np.uint8, (n - 1) * wide, at + 8).reshape(-1, wide)
    at += 8 + (n - 1) * wide
    counts = np.frombuffer(raw, np.uint8, n, at).astype(np.int64)
    at += n
    where = np.frombuffer(raw[at : at + 8 * big], np.int64)
    counts[where] = np.frombuffer(raw[at + 8 * big : at + 16 * big], np.int64)
    return np.cumsum(steps.reshape(-1).view(U64)), counts


def shard_of(keys: np.ndarray, order: int, shards: int) -> np.ndarray:
    """The range of the key space in which a sent key lies; ascending with the key."""
    return ((keys >> U64(31 if order == 1 else 16)) * U64(shards) >> U64(32)).astype(np.int64)


class _Batch:
    """Rows that are keyed and scored together."""

    def __init__(self) -> None:
        self.rows: list[pa.Array] = []
        self.texts: list[pa.Array] = []
        self.tokens: list[np.ndarray] = []
        self.at: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.n = 0

    def add(self, piece, row: pa.Array, text: pa.Array) -> None:  # noqa: ANN001
        tokens, bounds, at = stream(piece)
        self.rows.append(row)
        self.texts.append(text)
        self.tokens.append(tokens)
        self.at.append(at)
        self.sizes.append(np.diff(bounds))
        self.n += len(tokens)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.concatenate(self.tokens), np.concatenate(self.at), np.concatenate(self.sizes)


def _keyer(uri: str, shards: int):
    """Writes the batches of a partition and sends their keys: (shard, gram, batch, blob)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, now, learn = TaskContext.get().partitionId(), 0, _Batch(), []

        def close() -> Iterator[pa.RecordBatch]:
            tokens, at, sizes = now.arrays()
            name = f"{part:06d}-{number:06d}-{int(mix(tokens + np.arange(len(tokens), dtype=U64)).sum(dtype=U64)):016x}"
            out = pa.BufferOutputStream()
            table = pa.record_batch([pa.concat_arrays(now.rows), pa.concat_arrays(now.texts)], ["row", "text"])
            with pa.ipc.new_file(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(table)
            shared.put(f"{uri}/{name}", out.getvalue().to_pybytes())
            learned = np.repeat(np.concatenate(learn), sizes)
            rows = []
            for k, keys in enumerate(grams(tokens, at), 1):
                some = at >= k - 1
                keys, counts = distinct(keys[some], k, learned[some])
                cuts = np.searchsorted(shard_of(keys, k, shards), np.arange(shards + 1))
                rows += [(s, k, name, _encode(keys[a:b], counts[a:b])) for s, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.binary()))], ["shard", "gram", "batch", "blob"])

        for batch in batches:
            column, flags = batch.column("text"), batch.column("learn").to_numpy(zero_copy_only=False).astype(bool)
            for piece in pieces(column):
                end = piece.first + piece.docs
                now.add(piece, batch.column("row").slice(piece.first, piece.docs), column.slice(piece.first, piece.docs))
                learn.append(flags[piece.first : end])
                if now.n >= BATCH:
                    yield from close()
                    number, now, learn = number + 1, _Batch(), []
        if now.n:
            yield from close()

    return run


def _salt(lev: int) -> np.uint64:
    return U64(lev * 0x9E3779B97F4A7C15 % (1 << 64))


def _places(keys: np.ndarray, lev: int, bits: int) -> Iterator[np.ndarray]:
    """The bit numbers of each key at a level, one probe after another; bits is a power of two."""
    a = mix(keys + _salt(lev))
    b = (a >> U64(29)) | U64(1)
    for _ in range(PROBES):
        yield a & U64(bits - 1)
        a = a + b


def _filter(keys: np.ndarray, lev: np.ndarray) -> np.ndarray:
    """The shard's Bloom filter, of a power of two bits, BITS to twice that per entry."""
    entries = int(lev.sum(dtype=np.int64))
    bits = 1 << max(9, math.ceil(math.log2(max(1, entries * BITS))))
    flags = np.zeros(bits, bool)
    for j in range(1, int(lev.max(initial=0)) + 1):
        own = keys[lev >= j]
        for p in _places(own, j, bits):
            flags[p.view(np.int64)] = True
    return np.packbits(flags, bitorder="little")


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's answers (batch, gram, shard, blob) and, without a batch, its sums (gram, level, n, total)."""
    sent: list[list[tuple[str, np.ndarray, np.ndarray]]] = [[] for _ in range(ORDERS)]
    shard = 0
    for batch in batches:
        for shard, k, name, blob in zip(batch.column("shard").to_pylist(), batch.column("gram").to_pylist(), batch.column("batch").to_pylist(), batch.column("blob"), strict=True):  # noqa: B007
            sent[k - 1].append((name, *_decode(blob.as_buffer().to_pybytes())))
    found, sums = [], []
    for k, parts in enumerate(sent, 1):
        keys = np.concatenate([x for _, x, _ in parts] or [np.empty(0, U64)])
        counts = np.concatenate([x for _, _, x in parts] or [np.empty(0, np.int64)])
        bounds = np.cumsum([0, *(len(x) for _, x, _ in parts)])
        names = [x for x, _, _ in parts]
        parts.clear()
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, bool)
        first = np.flatnonzero(new)
        total = np.add.reduceat(counts[order], first) if len(first) else np.empty(0, np.int64)
        where = np.empty(len(order), np.int32)
        where[order] = np.cumsum(new) - 1
        has = total > 0
        lev = level(total[has])
        by, weight = np.bincount(lev, minlength=1), np.bincount(lev, weights=total[has], minlength=1)
        sums += [(k, j, int(by[j]), int(weight[j])) for j in np.flatnonzero(by).tolist()]
        found.append((keys[first], has, total, lev, where, bounds, names))
    longer = found[1:]
    bloom = _filter(np.concatenate([f[0][f[1]] for f in longer]), np.concatenate([f[3] for f in longer]))
    rows = []
    for k, (keys, _, total, _, where, bounds, names) in enumerate(found, 1):
        values = total if k == 1 else probe(bloom, keys)
        for name, a, b in zip(names, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            rows.append((name, k, shard, values[where[a:b]].tobytes(), None, None, None))
    rows += [(None, k, shard, None, j, n, t) for k, j, n, t in sums]
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    names = ["batch", "gram", "shard", "blob", "level", "n", "total"]
    for at in range(0, len(rows), 256):
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[at : at + 256]], t) for i, t in enumerate(kinds)], names)


def _beta(levels: dict[int, tuple[int, int]], distinct: int) -> float:
    """The power for which the sum of c^beta over all histories is the number of distinct longer n-grams."""
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if sum(n * (total / n) ** mid for n, total in levels.values()) < distinct:
            low = mid
        else:
            high = mid
    return (low + high) / 2


class Sums:
    """What scoring needs to know of the whole corpus: a few sums by order and level."""

    def __init__(self, sums: list[tuple[int, int, int, int]]):
        by: dict[int, dict[int, tuple[int, int]]] = {k: {} for k in range(1, ORDERS + 1)}
        for k, j, n, total in sums:
            by[k][j] = (n, total)
        self.total = sum(t for _, t in by[1].values())
        self.vocabulary = sum(n for n, _ in by[1].values())
        self.discount, self.beta = {}, {}
        for k in range(2, ORDERS + 1):
            one, two = by[k].get(1, (0, 0))[0], by[k].get(2, (0, 0))[0]
            self.discount[k] = min(0.95, max(0.1, one / (one + 2 * two))) if one else 0.5
            self.beta[k] = _beta(by[k - 1], sum(n for n, _ in by[k].values()))

    def probabilities(self, at: np.ndarray, words: np.ndarray, longer: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of each token the add-one and the model's probability, from exact word counts and the levels of longer n-grams (where at reaches them)."""
        base = (words + 1) / (self.total + self.vocabulary + 1)
        p = base.copy()
        history = words.astype(float)  # of the n-gram that ends at each token, one order down
        for k, lev in enumerate(longer, 2):
            where = np.flatnonzero(at >= k - 1)
            before = history[where - 1]
            count = np.minimum(LEVEL_COUNT[lev], np.minimum(before, history[where]))
            seen = before >= 1
            where_, count_, before = where[seen], count[seen], before[seen]
            d = self.discount[k]
            kinds = np.minimum(before ** self.beta[k], before)
            p[where_] = np.maximum(count_ - d, 0) / before + np.minimum(d * kinds / before, 0.999) * p[where_]
            history = np.zeros(len(words))
            history[where] = count
        return base, np.minimum(p, 1.0)


def probe(bloom: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The level of each key, probed level after level until one is missing."""
    out, rows, j = np.zeros(len(keys), np.uint8), np.arange(len(keys)), 0
    while len(keys):
        j += 1
        live = _present(bloom, keys, j, len(bloom) * 8)
        keys, rows = keys[live], rows[live]
        out[rows] = j
    return out


def _present(bloom: np.ndarray, keys: np.ndarray, j: int, bits: int) -> np.ndarray:
    """The places of the keys that pass every probe of level j; failed keys drop out probe by probe."""
    a = mix(keys + _salt(j))
    b = (a >> U64(29)) | U64(1)
    left = None
    for _ in range(PROBES):
        p = a & U64(bits - 1)
        hit = np.flatnonzero((bloom[(p >> U64(3)).view(np.int64)] >> (p & U64(7)).astype(np.uint8)) & np.uint8(1))
        left = hit if left is None else left[hit]
        a, b = a[hit], b[hit]
        a = a + b
    return left


_OUTPUTS = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scorer(uri: str, sums: Sums):
    """Scores each batch of a stream of answers sorted by (batch, gram, shard)."""

    def scored(name: str, answers: list[list[bytes]]) -> pa.RecordBatch:
        raw = pa.py_buffer(shared.get(f"{uri}/{name}"))
        table = pa.ipc.open_file(raw).read_all().combine_chunks().to_batches()[0]
        now = _Batch()
        for piece in pieces(table.column("text")):
            now.add(piece, None, None)
        tokens, at, sizes = now.arrays()
        counts = []
        for k, keys in enumerate(grams(tokens, at), 1):
            keys = keys[at >= k - 1] >> U64(1 if k == 1 else 16)
            _, back = np.unique(keys, return_inverse=True)
            values = np.frombuffer(b"".join(answers[k - 1]), np.int64 if k == 1 else np.uint8)
            if len(values) != int(back.max(initial=-1)) + 1:
                raise ValueError(f"batch {name}: {len(values)} answers to order {k}; the rows of docs were others when they were read again")
            counts.append(values[back])
        base, p = sums.probabilities(at, counts[0], counts[1:])
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        known, low, high = (np.add.reduceat(x, first) for x in (counts[0] > 0, np.log10(base), np.log10(p)))
        return pa.RecordBatch.from_arrays([table.column("row"), pa.array(sizes, pa.int64()), pa.array(known.astype(np.int64)), pa.array(np.full(len(sizes), sums.total, np.int64)), pa.array(low), pa.array(high)], ["row", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, answers = None, [[] for _ in range(ORDERS)]
        for batch in batches:
            for n, k, blob in zip(batch.column("batch").to_pylist(), batch.column("gram").to_pylist(), batch.column("blob"), strict=True):
                if n != name:
                    if name is not None:
                        yield scored(name, answers)
                    name, answers = n, [[] for _ in range(ORDERS)]
                answers[k - 1].append(blob.as_py())
        if name is not None:
            yield scored(name, answers)

    return run


def score(docs: DataFrame, keep: list[str], learn: Column | None = None, text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """keep, n_tokens, n_known, train_tokens, base_score and score of each row of docs, by a model of those rows for which learn is true (by default of all).

    Other documents are scored by a corpus's model in one union with it: ``learn`` tells the two apart.
    """
    spark = docs.sparkSession
    t = F.col(f"`{text}`").cast("binary")
    plain = shared.packed(docs, keep, text=F.coalesce(t, F.lit(b"")), learn=F.coalesce(F.lit(True) if learn is None else learn, F.lit(False)))
    size = docs.agg(F.sum(F.octet_length(t))).first()[0] or 0
    shards = size // shard_bytes + 1
    uri = shared.place(spark, "lm-batches")
    answers = (
        plain.mapInArrow(_keyer(uri, shards), "shard int, gram int, batch string, blob binary")
        .repartitionById(shards, F.col("shard"))
        .mapInArrow(_answers, "batch string, gram int, shard int, blob binary, level long, n long, total long")
    )
    answers = shared.materialise(answers, "lm-answers")
    rows = answers.where("batch is null").groupBy("gram", "level").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()  # at most ORDERS * the number of levels
    sums = Sums([tuple(r) for r in rows])
    back = answers.where("batch is not null").select("batch", "gram", "shard", "blob").repartition(max(shards, shared.partitions(spark)), "batch").sortWithinPartitions("batch", "gram", "shard")
    schema = shared.widened(plain, _OUTPUTS)
    return shared.beside(back.mapInArrow(_scorer(uri, sums), schema), keep, schema.names[1:])


HELD_OUT = "coalesce(crc32(cast(cast(doc_id as string) as binary)), 0) % 7 = 2"


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.expr(HELD_OUT).alias("held_out"))
    return score(docs, ["doc_id", "held_out"], ~F.col("held_out"))
