"""The interface of a graph store, and the one over Spark: another backend can take its place behind tools and server."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession

from ..operators import derive, rollup, search
from ..schema import TABLES
from .store import Store, with_stats


class GraphStore(ABC):
    """What a store of code graphs does; queries return plain rows under their limits."""

    @abstractmethod
    def create_schema(self) -> None: ...

    @abstractmethod
    def write_batch(self, index: DataFrame) -> None: ...

    @abstractmethod
    def finalize(self) -> None: ...

    @abstractmethod
    def search_symbols(self, query: str, kind: str | None = None, limit: int = 50) -> list[dict]: ...

    @abstractmethod
    def find_callers(self, symbol: str, depth: int = 1, limit: int = 100) -> list[dict]: ...

    @abstractmethod
    def find_callees(self, symbol: str, depth: int = 1, limit: int = 100) -> list[dict]: ...

    @abstractmethod
    def get_neighborhood(self, symbol: str, depth: int = 1, edge_types: tuple[str, ...] | None = None, max_nodes: int = 160, max_edges: int = 360) -> dict: ...

    @abstractmethod
    def get_global_network(self, prefix: str = "", edge_types: tuple[str, ...] = ("calls", "ops_bind"), include_internal: bool = False, max_nodes: int = 100, max_edges: int = 320) -> dict: ...

    @abstractmethod
    def get_file_symbols(self, path: str, limit: int = 500, offset: int = 0) -> list[dict]: ...

    @abstractmethod
    def call_path(self, source: str, target: str, max_len: int = 10) -> list[dict]: ...

    @abstractmethod
    def get_callchain(self, symbol: str, max_depth: int = 20) -> list[dict]: ...

    @abstractmethod
    def find_ops_impls(self, field_name: str, struct_type: str | None = None) -> list[dict]: ...

    @abstractmethod
    def get_metadata(self) -> dict[str, str]: ...

    @abstractmethod
    def close(self) -> None: ...


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(True) for r in df.collect()]


class SparkGraphStore(GraphStore):
    """Over ``Store``.  Batches of index rows are gathered and derived at once by ``finalize``, which makes the new snapshot current."""

    def __init__(self, spark: SparkSession, root: str):
        self.store, self.spark, self._batches = Store(spark, root), spark, []

    def create_schema(self) -> None:
        """An empty graph, unless there is one."""
        if self.store.current() is None:
            self.store.write({k: self.spark.createDataFrame([], v) for k, v in TABLES.items()})

    def write_batch(self, index: DataFrame) -> None:
        self._batches.append(index)

    def finalize(self) -> None:
        if self._batches:
            every = self._batches[0]
            for more in self._batches[1:]:
                every = every.unionByName(more)
            self.store.write(with_stats(derive.build(every)))
            self._batches = []

    def search_symbols(self, query: str, kind: str | None = None, limit: int = 50) -> list[dict]:
        g = self.store.graph()
        return _rows(search.search_symbols(g.symbols, g.files, query, kind, limit, self.store.search_index()))

    def find_callers(self, symbol: str, depth: int = 1, limit: int = 100) -> list[dict]:
        return _rows(self.store.graph().find_callers(symbol, depth, limit))

    def find_callees(self, symbol: str, depth: int = 1, limit: int = 100) -> list[dict]:
        return _rows(self.store.graph().find_callees(symbol, depth, limit))

    def get_neighborhood(self, symbol: str, depth: int = 1, edge_types: tuple[str, ...] | None = None, max_nodes: int = 160, max_edges: int = 360) -> dict:
        return self.store.graph().get_neighborhood(symbol, depth, edge_types, max_nodes, max_edges)

    def get_global_network(self, prefix: str = "", edge_types: tuple[str, ...] = ("calls", "ops_bind"), include_internal: bool = False, max_nodes: int = 100, max_edges: int = 320) -> dict:
        net = rollup.global_network(self.store.graph(), prefix, edge_types, include_internal, max_nodes, max_edges)
        return {"nodes": _rows(net.nodes), "edges": _rows(net.edges), "totals": net.totals.first().asDict()}

    def get_file_symbols(self, path: str, limit: int = 500, offset: int = 0) -> list[dict]:
        return _rows(self.store.graph().get_file_symbols(path, limit, offset))

    def call_path(self, source: str, target: str, max_len: int = 10) -> list[dict]:
        return _rows(self.store.graph().call_path(source, target, max_len))

    def get_callchain(self, symbol: str, max_depth: int = 20) -> list[dict]:
        return _rows(self.store.graph().get_callchain(symbol, max_depth))

    def find_ops_impls(self, field_name: str, struct_type: str | None = None) -> list[dict]:
        return _rows(self.store.graph().find_ops_impls(field_name, struct_type))

    def get_metadata(self) -> dict[str, str]:
        return {r["key"]: r["value"] for r in self.store.graph().get_metadata().collect()}

    def close(self) -> None:
        """Nothing is held open."""
