"""The stored graph: Parquet snapshots behind a pointer file.

A snapshot is a folder with a table each for files, symbols, occurrences, edges, meta and the search
index.  Edges are stored twice, sorted by source and by destination, so that lookups from
either end skip row groups by their bounds.  A new snapshot is written beside the old ones; then
the pointer is replaced in one rename, so readers see the old graph or the new one.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import derive, search
from ..operators.graph import Graph
from ..operators.search import SearchIndex
from ..schema import TABLES
from ..session import scope

#: What rows of a table are sorted by within its files.
SORTED = {"files": "path", "symbols": "name", "occurrences": "symbol_id", "edges": "src_id", "edges_by_dst": "dst_id", "meta": "key", "postings": "token", "documents": "doc"}


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.stats: list[dict] = []  # of the last write: table, rows, seconds
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def current(self) -> str | None:
        """The name of the snapshot that the pointer names."""
        at = self._path("CURRENT")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _point(self, snapshot: str) -> None:
        part = self._path(f".CURRENT-{uuid.uuid4().hex}")
        out = self._fs.create(part, True)
        out.write(bytearray(snapshot.encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        option = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(option, 1)
        options[0] = option.OVERWRITE
        context.rename(self._fs.makeQualified(part), self._fs.makeQualified(self._path("CURRENT")), options)

    def write(self, tables: dict[str, DataFrame], with_search: bool = True, point: bool = True, ready: tuple[str, ...] = ()) -> str:
        """Write a snapshot and, if asked, make it the current one; its name.  ready: tables that are stored already and cost nothing to read twice."""
        snapshot = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        self.stats = []

        def put(name: str, df: DataFrame) -> None:
            by = SORTED[name]
            df.repartitionByRange(by).sortWithinPartitions(by).write.parquet(f"{self.root}/{snapshot}/{name}")

        for name, schema in TABLES.items():
            began, seen = time.time(), Observation()
            # first as it comes, so that sampling the ranges does not derive it twice
            df = tables[name].select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))
            if name not in ready:
                df = df.observe(seen, F.count(F.lit(1)).alias("rows"))
            if name not in ready:
                df.write.parquet(f"{self.root}/{snapshot}/.{name}")
                df = self.spark.read.schema(schema).parquet(f"{self.root}/{snapshot}/.{name}")
            put(name, df)
            if name == "edges":
                put("edges_by_dst", df)
            if name not in ready:
                self._fs.delete(self._path(snapshot, f".{name}"), True)
            rows = df.count() if name in ready else seen.get["rows"]
            self.stats.append({"table": name, "rows": rows, "seconds": time.time() - began})
        if with_search:
            found = search.index(self.spark.read.schema(TABLES["symbols"]).parquet(f"{self.root}/{snapshot}/symbols"), keep=True)
            put("postings", found.postings)
            put("documents", found.documents)
        if point:
            self._point(snapshot)
        return snapshot

    def publish(self, snapshot: str) -> None:
        self._point(snapshot)

    def snapshots(self) -> list[str]:
        """The snapshots that are there, oldest first."""
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path()) if x.isDirectory())

    def discard(self, snapshot: str) -> None:
        """Remove a snapshot that is not the current one."""
        if snapshot == self.current():
            raise ValueError("the current snapshot cannot be removed")
        self._fs.delete(self._path(snapshot), True)

    def table(self, name: str, snapshot: str | None = None) -> DataFrame:
        at = snapshot or self.current()
        if at is None:
            raise FileNotFoundError(f"no snapshot in {self.root}")
        reader = self.spark.read.schema(TABLES[name]) if name in TABLES else self.spark.read.schema(TABLES["edges"]) if name == "edges_by_dst" else self.spark.read
        return reader.parquet(f"{self.root}/{at}/{name}")

    def graph(self, snapshot: str | None = None) -> Graph:
        at = snapshot or self.current()
        return Graph(**{name: self.table(name, at) for name in ("files", "symbols", "edges", "occurrences", "meta", "edges_by_dst")})

    def search_index(self, snapshot: str | None = None) -> SearchIndex:
        return SearchIndex(self.table("postings", snapshot), self.table("documents", snapshot))


def with_stats(tables: dict[str, DataFrame], now: int | None = None) -> dict[str, DataFrame]:
    """tables with index_timestamp, total_symbols and total_files (the one without a path too) in meta."""
    spark = tables["meta"].sparkSession
    stamp = spark.range(1).select(F.lit("index_timestamp").alias("key"), F.lit(str(int(time.time()) if now is None else now)).alias("value"))
    counts = [tables[t].agg(F.lit(f"total_{t}").alias("key"), F.count(F.lit(1)).cast("string").alias("value")) for t in ("symbols", "files")]
    old = tables["meta"].where(~F.col("key").isin("index_timestamp", "total_symbols", "total_files"))
    return tables | {"meta": old.union(stamp).union(counts[0]).union(counts[1])}


def ingest(spark: SparkSession, path: str, root: str, resolve: str = "ordered", now: int | None = None) -> Store:
    """Read an index and store its graph as a new snapshot."""
    from ..sources.scip import read_scip

    store = Store(spark, root)
    with scope(spark):
        store.write(with_stats(derive.build(lambda only: read_scip(spark, path, only=only), resolve), now), ready=("files", "symbols", "occurrences", "edges"))  # numbered tables are stored already
    return store
