"""What outlives a task: tables and files in the folder that all executors share."""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import discard, kept, materialise, place, scope, shared_folder  # noqa: F401


def free(name: str, taken: list[str]) -> str:
    """The name of an output beside the columns that the caller keeps: with underscores behind it if it is taken."""
    have = {t.lower() for t in taken}
    while name.lower() in have:
        name += "_"
    return name


def packed(df: DataFrame, keep: list[str], **more: object) -> DataFrame:
    """The columns to keep as one struct ``row`` and the named ones beside it, so that no name of theirs can clash."""
    return df.select(F.struct(*(F.col(f"`{k}`") for k in keep)).alias("row"), *(c.alias(k) for k, c in more.items()))


def beside(df: DataFrame, keep: list[str], outputs: list[str]) -> DataFrame:
    """packed() undone: the kept columns as they were, and the outputs under free names."""
    return df.select(*(F.col("row")[k].alias(k) for k in keep), *(F.col(o).alias(free(o, keep)) for o in outputs))


def text_of(df: DataFrame, keep: list[str], text: str) -> tuple[DataFrame, str | None]:
    """packed() for operators that read a text: as ``text`` beside the row, or, where it is kept, only within (a text travels once)."""
    if text in keep:
        return packed(df, keep), text
    return packed(df, keep, text=F.col(f"`{text}`").cast("binary")), None


def texts(batch: pa.RecordBatch, inside: str | None) -> pa.Array:
    """The texts of a batch of text_of()."""
    return batch.column("text") if inside is None else batch.column("row").field(inside)


def widened(df: DataFrame, fields: str) -> StructType:
    """The schema of df's ``row`` and more fields, in DDL."""
    return StructType([StructField("row", df.schema["row"].dataType), *StructType.fromDDL(fields).fields])


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most ``rows`` rows, else as it is; df should be materialised."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# Files written and read by tasks


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def put(uri: str, data: bytes) -> None:
    """Write a file whole or not at all: a repeated attempt replaces it by the same bytes."""
    fs, path = _open(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, path)


def get(uri: str) -> np.ndarray:
    """A file's bytes: mapped where the folder is a local mount, else read."""
    fs, path = _open(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.empty(0, np.uint8)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), np.uint8)


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays of whole 8-byte items one after another, behind their lengths in bytes."""
    raw = [a.tobytes() for a in arrays]
    raw = [r + b"\0" * (-len(r) % 8) for r in raw]
    return np.array([len(raw), *(a.nbytes for a in arrays)], np.int64).tobytes() + b"".join(raw)


def unpack(raw: np.ndarray, types: list) -> list[np.ndarray]:
    """The arrays of pack()."""
    n = int(raw[:8].view(np.int64)[0])
    sizes = raw[8 : 8 + 8 * n].view(np.int64)
    out, at = [], 8 + 8 * n
    for size, kind in zip(sizes.tolist(), types, strict=True):
        out.append(raw[at : at + size].view(kind))
        at += size + -size % 8
    return out
