"""Operator 6: media columns, an archive data source with byte-range partitions.

``write_media`` turns texts into lossless 8-bit images (PNG, RGB, 64 pixels wide, so that a row of
pixels is 192 bytes) and packs them as members of ZIP archives in a folder.  The data source
``media_archive`` reads such a folder: the driver only lists archives and their sizes and plans byte
ranges; a task reads the archive's directory, takes the members whose offset lies in its range,
streams their payloads in Arrow batches of bounded size and retries each member on its own, by
its offset.  A member that still fails is a row with ``error``, so that nothing is lost silently.

Nothing shuffles, and memory is bounded by the archive and batch sizes and the longest member.  Archives
are named by the partition that writes them and put in place whole, so a repeated task replaces its own.

Defined cases: a null text is empty, and an empty text is one row of blanks; rows that repeat are members
of their own; a null key is carried as such, whatever its type; a very long text is one member, read whole; an empty
table or folder gives no rows; there are no ties; other columns are ignored, so no name can clash.  An archive whose
directory cannot be read is tried again like a member, and then is one row with ``error`` and the archive's name.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from . import shared

UNIT = 192
WIDTH = 64
ARCHIVE_BYTES = 32 << 20
RANGE_BYTES = 16 << 20
BATCH_BYTES = 8 << 20
RETRIES = 3

_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes) -> bytes:
    """A payload of whole rows as a PNG."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    raw = np.zeros((len(rows), UNIT + 1), np.uint8)  # each row behind its filter, 0
    raw[:, 1:] = rows
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 4)) + _chunk(b"IEND", b"")


def decode(media: bytes) -> np.ndarray:
    """The samples of a PNG that encode() made, row by row."""
    if not media.startswith(_SIGNATURE):
        raise ValueError("not a PNG")
    at, header, data = len(_SIGNATURE), None, []
    while at < len(media):
        (size,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + size]
        if struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError("checksum of a chunk")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    if header is None or header[0] != WIDTH or header[2:] != (8, 2, 0, 0, 0):
        raise ValueError("not 8-bit RGB of the given width")
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(header[1], UNIT + 1)
    if raw[:, 0].any():
        raise ValueError("a filter that encode() does not use")
    return raw[:, 1:]


_CELLS = np.arange(10) * WIDTH // 9


def feature(samples: np.ndarray) -> str:
    """Size, mean and deviation of the samples, and a difference hash over a grid of 8 rows and 9 columns of luma."""
    luma = samples.reshape(len(samples), WIDTH, 3).sum(axis=2, dtype=np.int64)
    rows = np.add.reduceat(luma, np.minimum(np.arange(8) * len(luma) // 8, len(luma) - 1), axis=0)
    cells = np.add.reduceat(rows, _CELLS[:-1], axis=1)
    width = np.diff(_CELLS)  # 7 or 8 pixels: means are compared, without dividing
    bits = np.packbits((cells[:, 1:] * width[:-1] > cells[:, :-1] * width[1:]).ravel())
    total, n = int(samples.sum(dtype=np.int64)), samples.size
    square = int((samples.astype(np.int64) ** 2).sum())
    return f"rgb {WIDTH}x{len(samples)} mean {total / n:.4f} var {square / n - (total / n) ** 2:.4f} dhash {bits.tobytes().hex()}"


# Writing


def _writer(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, members = TaskContext.get().partitionId(), 0, 0
        raw = io.BytesIO()
        archive = zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED)

        def close() -> None:
            archive.close()
            shared.put(f"{uri}/part-{part:06d}-{number:06d}.zip", raw.getvalue())

        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
                body = text.as_py() or b""
                payload = body + b" " * (-len(body) % UNIT or (UNIT if not body else 0))
                info = zipfile.ZipInfo(f"{members:08d}.png", (1980, 1, 1, 0, 0, 0))
                info.comment = json.dumps([key, len(body)]).encode()
                archive.writestr(info, encode(payload))
                members += 1
                if raw.tell() >= ARCHIVE_BYTES:
                    close()
                    number += 1
                    raw = io.BytesIO()
                    archive = zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED)
        if archive.infolist():
            close()
        yield pa.RecordBatch.from_arrays([pa.array([members], pa.int64())], ["members"])

    return run


def write_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> str:
    """The folder of the archives of all rows of docs; key must be a number or a string."""
    uri = shared.place(docs.sparkSession, "media")
    docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text")).mapInArrow(_writer(uri), "members long").agg(F.sum("members")).collect()
    return uri


# Reading


class Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        super().__init__(f"{path}:{start}")
        self.path, self.start, self.stop = path, start, stop


_SCHEMA = "key string, archive string, offset long, n_bytes long, media binary, error string"


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.batch_bytes = int(options.get("batchbytes", BATCH_BYTES))
        self.retries = int(options.get("retries", RETRIES))

    def partitions(self) -> list[Range]:
        fs, path = pafs.FileSystem.from_uri(self.uri)
        files = [f for f in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if f.extension == "zip"]
        out = [Range(f.path, at, min(at + self.range_bytes, f.size)) for f in sorted(files, key=lambda f: f.path) for at in range(0, f.size, self.range_bytes)]
        return out or [Range("", 0, 0)]

    def _member(self, fs: pafs.FileSystem, path: str, info: zipfile.ZipInfo) -> tuple[bytes | None, str | None]:
        """A member's bytes, opened afresh at its offset on each attempt."""
        problem = ""
        for _ in range(self.retries):
            try:
                with fs.open_input_file(path) as f:
                    f.seek(info.header_offset)
                    head = f.read(30)
                    if head[:4] != b"PK\x03\x04":
                        raise ValueError("no member here")
                    name, extra = struct.unpack("<HH", head[26:30])
                    f.seek(info.header_offset + 30 + name + extra)
                    data = f.read(info.compress_size)
                if info.compress_type != zipfile.ZIP_STORED:
                    data = zlib.decompress(data, -15)
                if len(data) != info.file_size or zlib.crc32(data) != info.CRC:
                    raise ValueError("checksum of a member")
                return data, None
            except (OSError, ValueError, struct.error, zlib.error) as e:
                problem = f"{type(e).__name__}: {e}"
        return None, problem

    def _directory(self, fs: pafs.FileSystem, partition: Range) -> tuple[list[zipfile.ZipInfo], str | None]:
        """The members whose offset lies in the range, and what was wrong with the archive if it cannot be read."""
        problem = None
        for _ in range(self.retries):
            try:
                with fs.open_input_file(partition.path) as f, zipfile.ZipFile(f) as z:
                    return [m for m in z.infolist() if partition.start <= m.header_offset < partition.stop], None
            except (OSError, ValueError, struct.error, zipfile.BadZipFile, NotImplementedError) as e:
                problem = f"{type(e).__name__}: {e}"
        return [], problem

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        names = ["key", "archive", "offset", "n_bytes", "media", "error"]
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        if not partition.path:
            return
        fs, _ = pafs.FileSystem.from_uri(self.uri)
        members, problem = self._directory(fs, partition)
        if problem and partition.start == 0:  # one row for the archive, from its first range
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((None, partition.path, None, None, None, problem), types, strict=True)], names)
        rows, held = [], 0
        for m in members:
            data, error = self._member(fs, partition.path, m)
            try:
                key, size = json.loads(m.comment or b"null") or (m.filename, None)
            except ValueError:
                key, size = m.filename, None
            rows.append((None if key is None else str(key), partition.path, m.header_offset, size, data, error))
            held += len(data or b"")
            if held >= self.batch_bytes:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


class MediaArchive(DataSource):
    """spark.read.format("media_archive").load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader({k.lower(): v for k, v in self.options.items()})


def read_media(spark: SparkSession, uri: str, **options: int) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(**{k: str(v) for k, v in options.items()}).load(uri)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    for batch in batches:
        rows = []
        for key, size, media, error in zip(*(batch.column(c).to_pylist() for c in ("key", "n_bytes", "media", "error")), strict=True):
            try:
                if media is None:
                    raise ValueError(error)
                samples = decode(media)
                payload = samples.tobytes()
                rows.append((key, size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples), None))
            except (ValueError, zlib.error) as e:
                rows.append((key, size, None, None, None, None, None, None, str(e)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def features(media: DataFrame) -> DataFrame:
    """Digests and features of each member, from its stored bytes."""
    schema = "key string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
    return media.select("key", "n_bytes", "media", "error").mapInArrow(_features, schema)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = features(read_media(spark, write_media(docs)))
    return found.select(F.col("key").cast(dict(docs.dtypes)["doc_id"]).alias("doc_id"), *found.columns[1:])
