"""The package on the executors, and the folder that all executors share."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_own: dict[str, str] = {}
_scopes: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The URI of the folder that all executors share: spark.checkpoint.dir.

    Where none is set, as in tests, a temporary folder serves if master and executors are on one machine; on a
    cluster that is an error, for executors would not find each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", "") or _own.get("dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own["dir"] = tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(base)
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    return str(path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString())


def place(spark: SparkSession, tag: str) -> str:
    """The URI of a new, unused subfolder."""
    at = f"{shared_folder(spark)}/graphloom/{tag}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(at)
    return at


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: what several plans read is computed once and outlives executors."""
    at = place(df.sparkSession, tag)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def discard(spark: SparkSession, *uris: str) -> None:
    """Remove folders that place() named; for tables that nothing reads any more."""
    for uri in uris:
        path = spark._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Whatever is placed inside is removed at the end; results must have been written elsewhere by then."""
    _scopes.append([])
    try:
        yield
    finally:
        discard(spark, *_scopes.pop())


@contextmanager
def lasting() -> Iterator[None]:
    """What is placed inside belongs to no scope around."""
    held = _scopes[:]
    _scopes.clear()
    try:
        yield
    finally:
        _scopes[:] = held


@contextmanager
def kept(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A scope() whose function writes a table that outlives it."""
    depth = len(_scopes)
    _scopes.append([])
    try:

        def keep(df: DataFrame, tag: str) -> DataFrame:
            inner = _scopes[depth:]
            del _scopes[depth:]
            try:
                return materialise(df, tag)  # belongs to the scope around, if there is one
            finally:
                _scopes.extend(inner)

        yield keep
    finally:
        discard(spark, *_scopes.pop())


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Python workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    at = os.path.join(tempfile.mkdtemp(prefix="graphloom-"), "graphloom.zip")
    Path(at).write_bytes(raw.getvalue())
    sc.addPyFile(at)
    _shipped.add(sc.applicationId)
