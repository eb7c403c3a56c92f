"""Operator 7: near-duplicate documents by banded MinHash and odd sketches, confirmed on full sets.

After Mitzenmacher, Pagh and Pham, "Efficient estimation for high similarities using odd sketches"
(2014): the MinHash samples of a set are folded into a bitmap of parities; the number of ones in the
XOR of two bitmaps estimates how many samples differ, most precisely where few do.

Steps, all of them distributed:

1. One pass over the texts: the set's size, a 128-bit fingerprint of the set, band keys and the sketch.
2. Documents of equal sets are one class.  From here on only classes are compared.
3. Band keys that two or more classes share are buckets.  In a bucket, classes whose sketches
   estimate a similarity of at least the level's ``loose`` are joined by a spanning forest, never by all pairs; a
   bucket over ``BUCKET`` classes joins all of them to its smallest class without looking at sketches
   (more candidates, never fewer).  The forest's components are the candidate groups.
4. In a candidate group links are confirmed on the full sets; pairs that confirmed links already
   connect are skipped.  A group of more than ``GROUP`` shingles is cut into blocks: inside each block,
   then every block against the best-linked classes of all blocks, then what the largest component
   has not taken in against all other blocks.  No pair is left out.
5. Components of the confirmed links, back to documents by class.

``LEVELS`` has the bands and ``loose`` of each threshold: at 0.85, 30 bands of 5 rows, at 0.80, 34 of 4.
A pair at the threshold shares no band with probability 2e-8, and ``loose`` is more than five standard
deviations of the sketch's bits below it.

Defined cases: a document without words (or a null text) is linked with nothing; one of fewer than five
words has its whole sequence as its set; a null doc_id never names a component of which another
document is part, and a group of null ids alone has a null component and is kept; rows that repeat a doc_id
are separate documents under one id; a very long text is one set, whole; ties of doc_id take either row;
other columns are ignored, or passed unchanged by ``deduplicated``, so no name can clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .components import components
from .tokens import U64, bytes_of, mix, pieces, shingles

WORDS = 5
SKETCH = 512  # bits
PER_CENT = 85
BUCKET = 2_000
GROUP = 4_000_000  # shingles: 32 MB
BROADCAST = 200_000  # rows of (doc_id, class, group), about 50 bytes each


@dataclass(frozen=True)
class Level:
    """A threshold, and the signatures and sketches that serve it."""

    per_cent: int
    bands: int
    rows: int
    loose: float

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def differ(self) -> int:
        """The most differing bits at which the estimate is still loose."""
        return int(SKETCH / 2 * (1 - np.exp(-4 * self.samples * (1 - self.loose) / SKETCH)))


LEVELS = {x.per_cent: x for x in (Level(85, 30, 5, 0.67), Level(80, 34, 4, 0.57))}
_SAMPLES, _BANDS = max(x.samples for x in LEVELS.values()), max(x.bands for x in LEVELS.values())

_random = np.random.default_rng(20140407)
_A = _random.integers(0, 1 << 32, _SAMPLES, dtype=np.uint32) | np.uint32(1)
_B = _random.integers(0, 1 << 32, _SAMPLES, dtype=np.uint32)
_SALT = mix(np.arange(1, _SAMPLES + 1, dtype=U64))
_BAND = mix(np.arange(1001, 1001 + _BANDS, dtype=U64))
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def fingerprint(keys: np.ndarray) -> bytes:
    """128 bits of the set, whatever its order."""
    return np.array([mix(keys ^ U64(0x9FB21C651E98DF25)).sum(dtype=U64), mix(keys ^ U64(0xC2B2AE3D27D4EB4F)).sum(dtype=U64)], U64).tobytes()


def min_hashes(keys: np.ndarray, n: int) -> np.ndarray:
    """The smallest value of each of n permutations over the set."""
    short = (keys >> U64(32)).astype(np.uint32)
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(short), 256):
        block = short[i : i + 256, None] * _A[:n]
        block += _B[:n]
        np.minimum(out, block.min(axis=0), out=out)
    return out


def bands(samples: np.ndarray, rows: int) -> np.ndarray:
    """Signatures (documents x samples) to band keys (documents x bands)."""
    out = np.tile(_BAND[: samples.shape[1] // rows], (len(samples), 1))
    for j in range(rows):
        out = mix(out + samples[:, j::rows].astype(U64))
    return out


def sketches(samples: np.ndarray) -> np.ndarray:
    """The odd sketch of each signature: bit b is the parity of the samples that fall on b."""
    at = mix(samples.astype(U64) + _SALT[: samples.shape[1]]) % U64(SKETCH)
    flat = (at + (np.arange(len(samples), dtype=U64) * U64(SKETCH))[:, None]).view(np.int64).ravel()
    return np.packbits((np.bincount(flat, minlength=len(samples) * SKETCH) & 1).astype(np.uint8).reshape(-1, SKETCH), axis=1)


def similar(sketch: np.ndarray, others: np.ndarray, level: Level) -> np.ndarray:
    """Which of the other sketches estimate a similarity of level.loose or more."""
    return _POPCOUNT[sketch ^ others].sum(axis=-1, dtype=np.int64) <= level.differ


def linked(a: np.ndarray, b: np.ndarray, per_cent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= per_cent * union."""
    if per_cent * max(len(a), len(b)) > 100 * min(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")  # merges two runs
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= per_cent * (len(both) - common)


_SIGNED = "n_shingles long, class binary, id long, bands array<long>, sketch binary, h long"


def _signed(batches: Iterator[pa.RecordBatch], level: Level) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch.column("text")):
            h, at = piece.hashes(), piece.word_bounds
            sets = [shingles(h[a:b], WORDS) for a, b in zip(at[:-1], at[1:], strict=True)]
            samples = np.stack([min_hashes(s, level.samples) for s in sets])
            empty = np.array([not len(s) for s in sets])
            keys, bits = bands(samples, level.rows), sketches(samples)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(piece.first, piece.docs),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([fingerprint(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([int.from_bytes(fingerprint(s)[:8], "little", signed=True) for s in sets], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * level.bands), pa.array(keys.view(np.int64).ravel())),
                    pa.array([None if e else x.tobytes() for e, x in zip(empty, bits, strict=True)], pa.binary()),
                    batch.column("h").slice(piece.first, piece.docs),
                ],
                ["doc_id", "n_shingles", "class", "id", "bands", "sketch", "h"],
            )


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The tables of equal neighbouring keys of a sorted stream, some whole keys at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key)
        last = k[-1]
        if held and held[-1].column(key)[-1] == last:
            held.append(batch)
            continue
        cut = batch.num_rows - 1
        while cut > 0 and k[cut - 1] == last:
            cut -= 1
        yield pa.Table.from_batches([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def _cuts(keys: np.ndarray) -> list[int]:
    return [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]


def forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the graph on 0..n-1 in which near(x, others) tells x's neighbours among others."""
    rest, out, queue = np.arange(n), [], []
    while len(rest):
        if queue:
            x = queue.pop()
        else:
            x, rest = int(rest[0]), rest[1:]
        hit = near(x, rest)
        for y in rest[hit].tolist():
            out.append((x, y))
            queue.append(y)
        rest = rest[~hit]
    return out


def _fixed(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A column of equally long binaries as rows of bytes."""
    return bytes_of(column.combine_chunks())[0].reshape(-1, width)


_EDGES = "u binary, v binary"


def _edges(pairs: list[tuple], kind: pa.DataType = pa.binary()) -> pa.RecordBatch:  # noqa: B008
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], kind) for i in (0, 1)], ["u", "v"])


def _bucketed(batches: Iterator[pa.RecordBatch], level: Level) -> Iterator[pa.RecordBatch]:
    """The spanning forest of each bucket; rows come sorted by key."""
    for table in runs(batches, "key"):
        keys = table.column("key").to_numpy()
        sketch, size, ids = _fixed(table.column("sketch"), SKETCH // 8), table.column("n_shingles").to_numpy(), table.column("id").to_pylist()
        out: set[tuple[int, int]] = set()
        cuts = np.array(_cuts(keys))
        width = np.diff(cuts)
        two = cuts[:-1][width == 2]  # most buckets
        small, large = np.minimum(size[two], size[two + 1]), np.maximum(size[two], size[two + 1])
        for a in two[similar(sketch[two], sketch[two + 1], level) & (100 * small >= level.per_cent * large)].tolist():
            out.add((ids[a], ids[a + 1]))
        for a, n in zip(cuts[:-1][width > 2].tolist(), width[width > 2].tolist(), strict=True):
            s, z = sketch[a : a + n], size[a : a + n]

            def near(x: int, others: np.ndarray, s: np.ndarray = s, z: np.ndarray = z) -> np.ndarray:
                return similar(s[x], s[others], level) & (100 * np.minimum(z[x], z[others]) >= level.per_cent * np.maximum(z[x], z[others]))

            out.update((ids[a + x], ids[a + y]) for x, y in forest(n, near))
        if out:
            yield _edges(sorted(out), pa.int64())


def candidate_groups(classes: DataFrame, level: Level, bucket: int = BUCKET) -> DataFrame:
    """(node, label): the ids of the classes that may have a link, and their candidate group.

    An id is half a fingerprint: should two classes have the same, they are candidates more, not fewer.
    What is shuffled for all classes is the narrow pair of band key and id; sketches only join the pairs
    of a bucket.
    """
    spark = classes.sparkSession
    spread = classes.select("id", F.explode("bands").alias("key"))
    buckets = shared.materialise(spread.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("u")).where("n > 1"), "buckets")
    found = shared.materialise(spread.join(buckets.hint("merge"), "key"), "bucketed")  # one strategy at every size
    few = found.where(F.col("n") <= bucket).select("key", "id").join(classes.select("id", "n_shingles", "sketch").hint("merge"), "id")
    forests = few.repartition(shared.partitions(spark), "key").sortWithinPartitions("key", "id").mapInArrow(partial(_bucketed, level=level), "u long, v long")
    star = found.where((F.col("n") > bucket) & (F.col("id") != F.col("u"))).select("u", F.col("id").alias("v"))
    return components(forests.union(star))


# Confirmation


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The full set of each row's text, where it is the set of the row's class; each class once a task."""
    done: set[bytes] = set()
    for batch in batches:
        for piece in pieces(batch.column("text")):
            h, at = piece.hashes(), piece.word_bounds
            sets = [shingles(h[a:b], WORDS) for a, b in zip(at[:-1], at[1:], strict=True)]
            rows = batch.slice(piece.first, piece.docs)
            names = rows.column("class").to_pylist()
            fits = [len(s) > 0 and fingerprint(s) == c for s, c in zip(sets, names, strict=True)]
            own = []
            for ok, c in zip(fits, names, strict=True):
                own.append(ok and c not in done)
                if ok:
                    done.add(c)
            own = pa.array(own, pa.bool_())
            rows = rows.select(["group", "class", "sketch", "total"]).append_column("keys", pa.array([s.tobytes() for s in sets], pa.binary()))
            yield rows.filter(own)


def _near(sets: list[np.ndarray], sketch: np.ndarray, size: np.ndarray, level: Level) -> Callable[[int, np.ndarray], np.ndarray]:
    def near(x: int, others: np.ndarray) -> np.ndarray:
        out = similar(sketch[x], sketch[others], level) & (100 * np.minimum(size[x], size[others]) >= level.per_cent * np.maximum(size[x], size[others]))
        for i in np.flatnonzero(out).tolist():
            out[i] = linked(sets[x], sets[int(others[i])], level.per_cent)
        return out

    return near


def _once(table: pa.Table, *more: str) -> pa.Table:
    """Rows sorted by (part, class, *more) without those that repeat their neighbour: several tasks may have sent a class."""
    if table.num_rows < 2:
        return table
    same = None
    for name in ("part", "class", *more):
        c = table.column(name).combine_chunks()
        equal = pa.compute.equal(c.slice(1), c.slice(0, len(c) - 1))
        same = equal if same is None else pa.compute.and_(same, equal)
    if not pa.compute.any(same).as_py():
        return table
    return table.filter(pa.concat_arrays([pa.array([True]), pa.compute.invert(same)]))


def _members(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, list[bytes]]:
    """The sets, sketches, sizes and classes of rows sorted by class within their part."""
    raw, at = bytes_of(table.column("keys").combine_chunks())
    sets = [raw[a:b].view(U64) if a % 8 == 0 and raw.ctypes.data % 8 == 0 else np.frombuffer(raw[a:b].tobytes(), U64) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return sets, _fixed(table.column("sketch"), SKETCH // 8), np.diff(at) // 8, table.column("class").to_pylist()


def _confirmed(batches: Iterator[pa.RecordBatch], level: Level) -> Iterator[pa.RecordBatch]:
    """The confirmed spanning forest of each part; rows come sorted by part."""
    for table in runs(batches, "part"):
        table = _once(table)
        parts = table.column("part").to_numpy()
        sets, sketch, size, ids = _members(table)
        pairs = []
        for a, b in zip((c := _cuts(parts))[:-1], c[1:], strict=True):
            pairs += [(ids[a + x], ids[a + y]) for x, y in forest(b - a, _near(sets[a:b], sketch[a:b], size[a:b], level))]
        if pairs:
            yield _edges(pairs)


def _crossed(batches: Iterator[pa.RecordBatch], level: Level) -> Iterator[pa.RecordBatch]:
    """Links between the rows with ``ask`` and the rows of another block and label, within each part."""
    for table in runs(batches, "part"):
        table = _once(table, "ask")
        parts = table.column("part").to_numpy()
        sets, sketch, size, ids = _members(table)
        ask, block = table.column("ask").to_numpy(zero_copy_only=False), table.column("block").to_numpy()
        names, label = np.unique(np.array(table.column("label").to_pylist(), object).astype("S32"), return_inverse=True)
        pairs = []
        for a, b in zip((c := _cuts(parts))[:-1], c[1:], strict=True):
            near, own = _near(sets[a:b], sketch[a:b], size[a:b], level), label[a:b].copy()
            for x in np.flatnonzero(ask[a:b]).tolist():
                others = np.flatnonzero((own != own[x]) & (block[a:b] != block[a + x]))
                for y in others[near(x, others)].tolist():
                    if own[y] != own[x]:
                        own[own == own[y]] = own[x]
                        pairs.append((ids[a + x], ids[a + y]))
        if pairs:
            yield _edges(pairs)


def _by_part(df: DataFrame, f: Callable, *more: str) -> DataFrame:
    """f over df's rows by (group, *more), in one sorted stream a partition."""
    spark = df.sparkSession
    part = F.xxhash64("group", *more)  # equal keys of different groups only put more classes side by side
    return df.withColumn("part", part).repartition(shared.partitions(spark), "part").sortWithinPartitions("part", "class", *(["ask"] if "ask" in df.columns else [])).mapInArrow(f, _EDGES)


def _numbers(blocks: str) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1)


def confirm(sets: DataFrame, level: Level, limit: int = GROUP) -> DataFrame:
    """The confirmed links (u, v), enough of them to connect what links connect, from (group, class, sketch, total, keys)."""
    confirmed, crossing = partial(_confirmed, level=level), partial(_crossed, level=level)
    small = _by_part(sets.where(F.col("total") <= limit), confirmed)
    large = sets.where(F.col("total") > limit)
    if not large.limit(1).count():
        return small
    spark = sets.sparkSession
    large = large.withColumn("blocks", F.ceil(2 * F.col("total") / limit)).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")))
    inside = shared.materialise(_by_part(large, confirmed, "block"), "inside")
    # the class of each block from which most links were found, against all blocks of its group
    degree = inside.groupBy(F.col("u").alias("class")).count()
    hubs = large.join(degree, "class").groupBy("group", "block").agg(F.max_by("class", F.struct("count", "class")).alias("class")).select("class")
    sent = large.join(hubs, "class").withColumn("home", F.col("block")).withColumn("block", F.explode(_numbers("blocks")))
    sent = sent.where("home != block").withColumn("ask", F.lit(True)).withColumn("label", F.col("class"))
    there = large.withColumn("home", F.col("block")).withColumn("ask", F.lit(False)).withColumn("label", F.col("class"))
    columns = ["group", "class", "sketch", "keys", "block", "home", "ask", "label"]
    both = sent.select(columns).union(there.select(columns)).withColumn("at", F.col("block")).withColumn("block", F.col("home"))
    hubbed = shared.materialise(_by_part(both, crossing, "at"), "hubbed")
    # what the group's largest component has not taken in, against every other block
    labels = components(inside.union(hubbed)).withColumnRenamed("node", "class")
    known = shared.materialise(large.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class")), "blocks")
    sizes = known.groupBy("group", "label").count()
    main = sizes.groupBy("group").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    known = known.join(main, "group").withColumn("ask", F.col("label") != F.col("main"))
    asking = known.where("ask").select("group", F.col("block").alias("asker")).distinct()
    out = known.where("ask").withColumn("other", F.explode(_numbers("blocks"))).where("other != block")
    pair = lambda a, b: F.concat_ws("-", F.least(a, b), F.greatest(a, b))
    columns = ["group", "class", "sketch", "keys", "block", "ask", "label", "pair"]
    out = out.withColumn("pair", pair(F.col("block"), F.col("other"))).select(columns)
    met = known.where("not ask").join(asking, "group").where("asker != block").withColumn("pair", pair(F.col("block"), F.col("asker"))).select(columns)
    # the rows that ask are in each pair of their block already, whichever of the two blocks asks
    crossed = _by_part(out.union(met), crossing, "pair")
    return small.union(inside).union(hubbed).union(crossed)


def near_duplicates(docs: DataFrame, limit: int = GROUP, bucket: int = BUCKET, per_cent: int = PER_CENT, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs (doc_id, text), at one of LEVELS."""
    level = LEVELS[per_cent]
    spark = docs.sparkSession
    t = F.col(f"`{text}`")
    # h tells rows of one doc_id, or of none, apart by their texts
    plain = docs.select("doc_id", t.cast("binary").alias("text"), F.xxhash64(t).alias("h"))
    kind = dict(plain.dtypes)["doc_id"]
    signed = shared.materialise(plain.mapInArrow(partial(_signed, level=level), f"doc_id {kind}, {_SIGNED}"), "signed")
    with shared.kept(spark) as keep:
        least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h"))
        classes = shared.materialise(signed.where("class is not null").groupBy("class").agg(least.alias("by"), *(F.first(c).alias(c) for c in ("n_shingles", "id", "bands", "sketch"))).select("class", F.col("by.doc_id").alias("first"), "by.h", "n_shingles", "id", "bands", "sketch"), "classes")
        groups = candidate_groups(classes, level, bucket).withColumnsRenamed({"node": "id", "label": "group"})
        members = groups.join(classes.select("id", "class", "first", "h", "n_shingles", "sketch"), "id")
        totals = members.groupBy("group").agg(F.sum("n_shingles").alias("total"))
        members = shared.materialise(members.join(totals, "group").select("first", F.col("h").alias("fh"), "class", "group", "sketch", "total"), "members")
        texts = plain.join(shared.bounded(members, BROADCAST), (F.col("h") == F.col("fh")) & F.col("doc_id").eqNullSafe(F.col("first"))).select("text", "group", "class", "sketch", "total")
        sets = texts.mapInArrow(_sets, "group long, class binary, sketch binary, total long, keys binary")
        sets = shared.materialise(sets, "sets")
        found = components(confirm(sets, level, limit)).withColumnRenamed("node", "class")
        firsts = found.join(classes.select("class", "first"), "class").groupBy("label").agg(F.min("first").alias("least"))
        of_class = classes.select("class", "first").join(found.join(firsts, "label").select("class", "least"), "class", "left").select("class", F.coalesce("least", "first").alias("least"))
        of_class = keep(of_class, "of_class")
    out = signed.select("doc_id", "n_shingles", "class").join(of_class, "class", "left")
    lone = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", "n_shingles", lone.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, limit: int = GROUP, bucket: int = BUCKET, per_cent: int = PER_CENT, text: str = "text") -> DataFrame:
    """docs with one document of each group: the one of the smallest doc_id; of rows that repeat it with the same text, one.

    Rows of a null id cannot be told apart by it: they stay if one of them does.
    """
    kept = shared.materialise(near_duplicates(docs, limit, bucket, per_cent, text).where("kept").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "kept")
    row = shared.packed(docs, docs.columns, id=F.col("doc_id"), t=F.col(f"`{text}`"))
    out = row.join(kept.select(F.col("doc_id").alias("own")).hint("merge"), F.col("id").eqNullSafe(F.col("own")), "left_semi")  # one strategy at every size
    repeated = kept.where("n > 1").select(F.col("doc_id").alias("own"))
    if repeated.limit(1).count():
        same = F.col("id").eqNullSafe(F.col("own"))
        out = out.join(repeated, same, "left_anti").union(out.join(repeated, same, "left_semi").dropDuplicates(["id", "t"]))
    return out.select(*(F.col("row")[k].alias(k) for k in docs.columns))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
