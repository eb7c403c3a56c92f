"""Lookups and traversals over a stored code graph; every result is a lazy DataFrame with a total order.

Lines are 0-based, -1 where unknown.  Limits below 0 mean no limit.  An unknown symbol gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import bounded_int, evidence, is_definition, like, parse_metadata
from ..schema import CALL_TYPES, EDGE_TYPES, NEIGHBOURHOOD_TYPES
from ..session import materialise, shared_folder


def _limited(df: DataFrame, limit: int) -> DataFrame:
    return df if limit < 0 else df.limit(limit)


def _first(*columns: str) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in columns]


@dataclass
class Graph:
    """The tables of a graph; occurrences and meta may be left out where nothing asks for them."""

    files: DataFrame
    symbols: DataFrame
    edges: DataFrame
    occurrences: DataFrame | None = None
    meta: DataFrame | None = None
    edges_by_dst: DataFrame | None = None  # the same edges, stored by destination

    @property
    def spark(self) -> SparkSession:
        return self.symbols.sparkSession

    # Pieces

    def id_of(self, scip_symbol: str) -> int:
        """A symbol's id, -1 if it is not known: looked up first, so that filters on it reach the stored tables as literals."""
        found = self.symbols.where(F.col("scip_symbol") == scip_symbol).select("id").first()
        return -1 if found is None else found["id"]

    def _side(self, near: str) -> DataFrame:
        """The edges, in the layout that skips most when asked for this end."""
        return self.edges_by_dst if near == "dst_id" and self.edges_by_dst is not None else self.edges

    def _id(self, scip_symbol: str, out: str = "node") -> DataFrame:
        """One row at most: the id of a symbol."""
        return F.broadcast(self.symbols.where(F.col("scip_symbol") == scip_symbol).select(F.col("id").alias(out)).limit(1))

    def _paths(self, file_id: str) -> DataFrame:
        return self.files.select(F.col("id").alias(file_id), F.col("path"))

    def _calls(self, near: str = "src_id", types: tuple[str, ...] = CALL_TYPES) -> DataFrame:
        return self._side(near).where(F.col("type").isin(*types)).select("src_id", "dst_id", F.col("type").alias("edge_type"), "line", "file_id")

    def _step(self, edges: DataFrame, front: DataFrame | None, start: int, level: int) -> DataFrame:
        """The edges from a front (near, n) of nodes, each of which n walks reach; stored, so that no level is computed twice."""
        hop = edges.where(F.col("near") == start).withColumn("n", F.lit(1).cast("long")) if front is None else edges.join(front, "near")
        return materialise(hop.select(F.lit(level).alias("depth"), F.col("far").alias("node"), "edge_type", "line", "file_id", "n"), "walk")

    @staticmethod
    def _front(step: DataFrame) -> DataFrame:
        """Walks that end in the same node go on alike: one row a node, with their number (2^40 at most)."""
        return step.groupBy(F.col("node").alias("near")).agg(F.least(F.sum("n"), F.lit(1 << 40)).alias("n"))

    def _walk(self, scip_symbol: str, depth: int, near: str, far: str) -> DataFrame:
        """Each step of each walk of up to depth edges away from a symbol, with its end as ``node``; n: how many walks take it."""
        edges, start = self._calls(near).withColumnsRenamed({near: "near", far: "far"}), self.id_of(scip_symbol)
        levels: list[DataFrame] = []
        for level in range(1, max(depth, 1) + 1):
            levels.append(self._step(edges, self._front(levels[-1]) if levels else None, start, level))
        return reduce(DataFrame.union, levels)

    def _reach(self, scip_symbol: str, depth: int, near: str, far: str) -> DataFrame:
        """(node, depth): the least number of edges to each node; the symbol itself is at 0."""
        edges = self._calls(near).select(F.col(near).alias("near"), F.col(far).alias("far"))
        start = self.id_of(scip_symbol)
        front = seen = self.spark.range(start, start + 1).select(F.col("id").alias("node"), F.lit(0).alias("depth"))
        for level in range(1, max(depth, 1) + 1):
            hop = edges.where(F.col("near") == start) if level == 1 else edges.join(front.select(F.col("node").alias("near")), "near")
            new = hop.select(F.col("far").alias("node")).distinct()
            front = materialise(new.join(seen, "node", "left_anti").withColumn("depth", F.lit(level)), "front")
            seen = seen.union(front)
        return seen

    @staticmethod
    def _repeated(rows: DataFrame, limit: int, *order: Column) -> DataFrame:
        """Each row as often as walks take it, the first of them in the given order; rows beyond the limit are not repeated first."""
        some = rows if limit < 0 else rows.orderBy(*order).limit(limit).withColumn("n", F.least("n", F.lit(limit)))
        many = some.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n")
        return _limited(many.orderBy(*order), limit)

    def _named_walk(self, rows: DataFrame, limit: int) -> DataFrame:
        named = rows.join(self.symbols.select(F.col("id").alias("node"), "scip_symbol", "name", "kind"), "node").join(self._paths("file_id").withColumnRenamed("path", "file_path"), "file_id", "left")
        out = named.select("depth", "edge_type", "line", "scip_symbol", "name", "kind", "file_path", "n")
        return self._repeated(out, limit, *_first("depth", "line", "edge_type", "scip_symbol", "file_path"))

    # Callers, callees, paths

    def find_callers(self, scip_symbol: str, depth: int = 1, limit: int = 100, mode: str = "walks") -> DataFrame:
        """Who calls a symbol, up to depth calls away.  mode: ``walks`` has a row per step of each walk, ``nodes`` one per caller at its least depth."""
        if mode == "nodes":
            return self._nodes(self._reach(scip_symbol, depth, "dst_id", "src_id"), limit)
        return self._named_walk(self._walk(scip_symbol, depth, "dst_id", "src_id"), limit)

    def find_callees(self, scip_symbol: str, depth: int = 1, limit: int = 100, mode: str = "walks") -> DataFrame:
        if mode == "nodes":
            return self._nodes(self._reach(scip_symbol, depth, "src_id", "dst_id"), limit)
        return self._named_walk(self._walk(scip_symbol, depth, "src_id", "dst_id"), limit)

    def _nodes(self, reach: DataFrame, limit: int) -> DataFrame:
        out = reach.where("depth > 0").join(self.symbols.select(F.col("id").alias("node"), "scip_symbol", "name", "kind"), "node").select("depth", "scip_symbol", "name", "kind")
        return _limited(out.orderBy("depth", "scip_symbol"), limit)

    def call_path_arrivals(self, source: str, target: str, max_len: int = 10) -> DataFrame:
        """A row per arrival of a walk at the target, first the shortest, max_len rows at most; walks stop at the target."""
        edges = self._calls().withColumnsRenamed({"src_id": "near", "dst_id": "far"})
        start, goal, front, levels, arrived = self.id_of(source), self.id_of(target), None, [], 0
        for level in range(1, max_len + 1):
            step = self._step(edges, front, start, level)
            here = step.where(F.col("node") == goal)
            levels.append(here)
            arrived += here.agg(F.sum("n")).first()[0] or 0
            front = self._front(step.where(F.col("node") != goal))
            if arrived >= max_len:  # the shortest come first
                break
        rows = reduce(DataFrame.union, levels)
        to = self.symbols.select(F.col("id").alias("node"), "scip_symbol", "name", "kind", F.col("def_file_id").alias("file_id"))
        named = rows.drop("file_id").join(to, "node").join(self._paths("file_id").withColumnRenamed("path", "file_path"), "file_id", "left")
        return self._repeated(named.select("scip_symbol", "name", "kind", "file_path", "line", "edge_type", "depth", "n"), max_len, *_first("depth", "line", "edge_type"))

    def call_path(self, source: str, target: str, max_len: int = 10) -> DataFrame:
        """A shortest path, node by node: levels outwards that keep each node once with the edge it was reached by, then back."""
        shared_folder(self.spark)  # where levels are kept, so that none is computed twice
        edges = self._calls()
        ids = {r["scip_symbol"]: r["id"] for r in self.symbols.where(F.col("scip_symbol").isin(source, target)).select("scip_symbol", "id").collect()}
        empty = self.spark.createDataFrame([], "depth int, scip_symbol string, name string, kind string, file_path string, line int, edge_type string")
        if source not in ids or target not in ids:
            return empty
        seen = self.spark.createDataFrame([(ids[source],)], "node long")
        front, levels, hit = seen, [], []
        for _ in range(max_len):
            reached = edges.join(front.withColumnRenamed("node", "src_id"), "src_id").groupBy(F.col("dst_id").alias("node")).agg(F.min(F.struct("src_id", "line", "edge_type")).alias("by"))
            # the target may be the source: then a cycle is the path
            new = reached.join(seen.where(F.col("node") != ids[target]), "node", "left_anti").checkpoint()
            levels.append(new)
            hit = new.where(F.col("node") == ids[target]).limit(1).collect()
            if hit or not new.limit(1).count():
                break
            front = new.select("node")
            seen = seen.union(front)
        if not hit:
            return empty
        # back from the target: one row per level
        steps, node = [], ids[target]
        for depth in range(len(levels), 0, -1):
            by = levels[depth - 1].where(F.col("node") == node).first()["by"]
            steps.append((depth, node, by["line"], by["edge_type"]))
            node = by["src_id"]
        rows = self.spark.createDataFrame([(0, node, None, None), *reversed(steps)], "depth int, id long, line int, edge_type string")
        named = F.broadcast(rows).join(self.symbols.select("id", "scip_symbol", "name", "kind", F.col("def_file_id").alias("file_id")), "id").join(self._paths("file_id").withColumnRenamed("path", "file_path"), "file_id", "left")
        return named.orderBy("depth").select("depth", "scip_symbol", "name", "kind", "file_path", "line", "edge_type")

    def get_callchain(self, scip_symbol: str, max_depth: int = 20) -> DataFrame:
        """Upwards from a symbol, each time to the caller of the smallest line; ends without one or at a node of the chain.

        One literal look-up a level in the edges stored by destination, each of which skips all other row groups.
        """
        node, chain = self.id_of(scip_symbol), []
        if node >= 0:
            chain.append((0, node, None, None))
        seen = {node}
        for depth in range(1, max_depth + 1 if chain else 1):
            calls = self._side("dst_id").where(F.col("type").isin(*CALL_TYPES) & (F.col("dst_id") == node))
            up = calls.orderBy(*_first("line"), "edge_ord").select("src_id", "file_id", "line").first()
            if up is None or up["src_id"] in seen:
                break
            node = up["src_id"]
            seen.add(node)
            chain.append((depth, node, up["file_id"], up["line"]))
        rows = F.broadcast(self.spark.createDataFrame(chain, "depth int, node long, file_id long, line int"))  # max_depth + 1 rows at most
        named = rows.join(self.symbols.select(F.col("id").alias("node"), "scip_symbol", "name", "kind"), "node").join(self._paths("file_id").withColumnRenamed("path", "file_path"), "file_id", "left")
        return named.select("depth", "scip_symbol", "name", "kind", "file_path", "line").orderBy("depth")

    # One hop

    def find_type_definition(self, scip_symbol: str) -> DataFrame:
        hop = self.edges.where((F.col("type") == "type_of") & (F.col("src_id") == self.id_of(scip_symbol))).select(F.col("dst_id").alias("id"))
        to = self.symbols.select("id", F.col("scip_symbol").alias("type_symbol"), F.col("name").alias("type_name"), F.col("kind").alias("type_kind"), "signature", F.col("def_file_id").alias("file_id"), "def_start_line", "def_end_line")
        return hop.join(to, "id").join(self._paths("file_id").withColumnRenamed("path", "def_file_path"), "file_id", "left").select("type_symbol", "type_name", "type_kind", "signature", "def_file_path", "def_start_line", "def_end_line").orderBy("type_symbol")

    def struct_fields(self, scip_symbol: str) -> DataFrame:
        hop = self.edges.where((F.col("type") == "contains") & (F.col("src_id") == self.id_of(scip_symbol))).select(F.col("dst_id").alias("id"))
        return hop.join(self.symbols, "id").select("scip_symbol", "name", "kind", "signature", "def_start_line").orderBy(*_first("def_start_line", "scip_symbol"))

    def get_struct_layout(self, scip_symbol: str) -> DataFrame:
        """One row: the symbol, its name (null if unknown) and its fields by line."""
        fields = self.struct_fields(scip_symbol).agg(F.array_sort(F.collect_list(F.struct("def_start_line", "scip_symbol", "name", "kind", "signature"))).alias("f"))
        name = self.symbols.where(F.col("scip_symbol") == scip_symbol).agg(F.first("name").alias("struct_name"))
        return fields.crossJoin(name).select(F.lit(scip_symbol).alias("struct_symbol"), "struct_name", F.transform("f", lambda x: F.struct(x["scip_symbol"].alias("scip_symbol"), x["name"].alias("name"), x["kind"].alias("kind"), x["signature"].alias("signature"), x["def_start_line"].alias("def_start_line"))).alias("fields"))  # one row by one row

    def find_ops_impls(self, field_name: str, struct_type: str | None = None, literal: bool = False) -> DataFrame:
        """ops_bind edges whose metadata has the text; struct_type: how the table's name starts, or what its symbol contains."""
        hit = self.edges.where((F.col("type") == "ops_bind") & like(F.col("metadata"), field_name, literal))
        ops = self.symbols.select(F.col("id").alias("src_id"), F.col("scip_symbol").alias("ops_symbol"), F.col("name").alias("ops_name"))
        impl = self.symbols.select(F.col("id").alias("dst_id"), F.col("scip_symbol").alias("impl_symbol"), F.col("name").alias("impl_name"))
        out = hit.join(ops, "src_id").join(impl, "dst_id").join(self._paths("file_id").withColumnRenamed("path", "file_path"), "file_id", "left")
        if struct_type:
            out = out.where(F.startswith("ops_name", F.lit(struct_type)) | F.contains("ops_symbol", F.lit(struct_type)))
        return out.select("src_id", "dst_id", "type", "file_id", "line", "confidence", "metadata", "ops_symbol", "ops_name", "impl_symbol", "impl_name", "file_path").orderBy(*_first("src_id", "dst_id", "file_id", "line"))

    # Neighbourhood

    def get_neighborhood(self, scip_symbol: str, depth: int = 1, edge_types: tuple[str, ...] | None = None, max_nodes: int = 160, max_edges: int = 360) -> dict:
        """{center, nodes, edges, truncated, limits}: undirected, breadth first, under caps; at most max_edges + 1 edges are fetched a hop."""
        depth, max_nodes, max_edges = bounded_int(depth, 1, 1, 3), bounded_int(max_nodes, 160, 1, 500), bounded_int(max_edges, 360, 0, 1000)
        types = [t for t in (edge_types or NEIGHBOURHOOD_TYPES) if t in EDGE_TYPES]
        found = self.symbols.where(F.col("scip_symbol") == scip_symbol).select("id").first()
        limits = {"depth": depth, "max_nodes": max_nodes, "max_edges": max_edges}
        truncated = {"nodes": False, "edges": False}
        if found is None:
            return {"center": None, "nodes": [], "edges": [], "truncated": truncated, "limits": limits}
        order = [found["id"]]
        have, kept, seen, front = {found["id"]}, [], set(), [found["id"]]
        priority = F.when(F.col("type") == "calls", 0).when(F.col("type") == "ops_bind", 1).otherwise(2)
        for _ in range(depth if types else 0):
            if not front:
                break
            room = max_edges - len(kept)
            if room <= 0:
                truncated["edges"] = truncated["edges"] or bool(self._touching(front, types).limit(1).collect())
                break
            rows = self._touching(front, types).withColumn("priority", priority).orderBy("priority", "edge_ord").limit(room + 1).collect()
            if len(rows) > room:
                truncated["edges"] = True
                rows = rows[:room]
            front = []
            for r in rows:
                if r["edge_ord"] in seen:
                    continue
                seen.add(r["edge_ord"])
                fits = True
                for node in (r["src_id"], r["dst_id"]):
                    if node in have:
                        continue
                    if len(have) >= max_nodes:
                        truncated["nodes"], fits = True, False
                        break
                    have.add(node)
                    order.append(node)
                    front.append(node)
                if fits:
                    kept.append(r["edge_ord"])
        nodes = {r["id"]: r.asDict() for r in self.symbols.where(F.col("id").isin(order)).join(self._paths("def_file_id").withColumnRenamed("path", "def_file_path"), "def_file_id", "left").select("id", "scip_symbol", "name", "kind", "signature", "def_file_path", "def_start_line", "is_external").collect()}
        edges = {r["edge_ord"]: r.asDict(True) for r in self.edges.where(F.col("edge_ord").isin(kept)).join(self._paths("file_id"), "file_id", "left").select("edge_ord", "src_id", "dst_id", "type", "line", "path", "confidence", parse_metadata(F.col("metadata")).alias("metadata"), evidence(F.col("path"), F.col("line")).alias("evidence")).collect()}
        return {"center": nodes[order[0]], "nodes": [nodes[n] for n in order if n in nodes], "edges": [edges[e] for e in kept], "truncated": truncated, "limits": limits}

    def _touching(self, front: list[int], types: list[str]) -> DataFrame:
        """Edges of these types with an end in the front, of 500 nodes at most: two pushed-down filters, each edge once."""
        columns = ["edge_ord", "src_id", "dst_id", "type"]
        out = self._side("src_id").where(F.col("type").isin(types) & F.col("src_id").isin(front)).select(columns)
        back = self._side("dst_id").where(F.col("type").isin(types) & F.col("dst_id").isin(front) & ~F.col("src_id").isin(front)).select(columns)
        return out.union(back)

    # Lookups

    def get_symbol(self, name: str, kind: str | None = None, limit: int = 10) -> DataFrame:
        rows = self.symbols.where(F.col("name") == name)
        rows = rows if kind is None else rows.where(F.col("kind") == kind)
        out = rows.join(self._paths("def_file_id").withColumnRenamed("path", "def_file_path"), "def_file_id", "left")
        out = out.select("id", "scip_symbol", "name", "kind", "signature", "documentation", "def_file_path", "def_start_line", "def_end_line", "is_external")
        return _limited(out.orderBy(*_first("is_external", "def_start_line", "id")), limit)

    def get_definition_location(self, scip_symbol: str) -> DataFrame:
        rows = self.symbols.where(F.col("scip_symbol") == scip_symbol).join(self._paths("def_file_id").withColumnRenamed("path", "def_file_path"), "def_file_id", "left")
        return rows.select("scip_symbol", "name", "kind", "def_file_path", "def_start_line", "def_end_line")

    def find_references(self, scip_symbol: str, limit: int = 200) -> DataFrame:
        rows = self.occurrences.where(F.col("symbol_id") == self.id_of(scip_symbol)).join(self._paths("file_id").withColumnRenamed("path", "file_path"), "file_id")
        by = self.symbols.select(F.col("id").alias("enclosing_symbol_id"), F.col("name").alias("enclosing_name"), F.col("kind").alias("enclosing_kind"), F.col("scip_symbol").alias("enclosing_symbol"))
        rows = rows.join(by, "enclosing_symbol_id", "left").withColumn("is_definition", is_definition(F.col("role")))
        out = rows.orderBy("file_path", "start_line", "id").select("file_path", "start_line", "start_col", "end_line", "end_col", "role", "enclosing_name", "enclosing_kind", "enclosing_symbol", "is_definition")
        return _limited(out, limit)

    def get_file_symbols(self, path: str, limit: int = 500, offset: int = 0) -> DataFrame:
        """A page of a file's symbols by line, with the total of all pages on each row."""
        limit, offset = bounded_int(limit, 500, 1, 1000), bounded_int(offset, 0, 0, 1_000_000)
        file = self.files.where(F.col("path") == path).select(F.col("id").alias("def_file_id"), "path")
        rows = self.symbols.where("kind != 'module'").join(F.broadcast(file), "def_file_id")  # one row: a path is unique
        total = rows.agg(F.count(F.lit(1)).alias("total"))
        page = rows.orderBy(*_first("def_start_line", "name", "scip_symbol")).offset(offset).limit(limit)
        return page.crossJoin(total).select("id", "scip_symbol", "name", "kind", "signature", "def_start_line", "def_end_line", "is_external", "total")  # one row by a page

    def get_metadata(self) -> DataFrame:
        return self.meta.select("key", "value").orderBy("key")

    def resolve_one(self, name: str, prefer_kind: str | None = None) -> str | None:
        """The symbol that a name most likely means: defined and not external if there is one."""
        best = F.min_by("scip_symbol", F.struct((F.col("is_external") | (F.col("def_start_line") < 0)).cast("int"), "is_external", "def_start_line", "id"))
        for kind in dict.fromkeys((prefer_kind, None)):
            found = self.get_symbol(name, kind, 10).agg(best.alias("s")).first()["s"]
            if found is not None:
                return found
        return None

    def resolve_requested(self, scip_symbol: str | None = None, name: str | None = None, kind: str | None = None) -> str | None:
        if scip_symbol:
            return scip_symbol if self.symbols.where(F.col("scip_symbol") == scip_symbol).limit(1).count() else None
        return self.resolve_one(name, kind) if name else None

    def rank_candidates(self, query: str, limit: int = 12) -> DataFrame:
        """Symbols of a search by how they fit: exact names first, then defined ones, then by path."""
        rows = self.symbols.join(self._paths("def_file_id").withColumnRenamed("path", "def_file_path"), "def_file_id", "left").where(like(F.col("name"), query, literal=True))
        exact, defined = F.lower("name") == query.lower(), F.coalesce(F.col("def_start_line") >= 0, F.lit(False))
        return rows.orderBy(exact.desc(), defined.desc(), *_first("def_file_path", "id")).limit(limit).select("id", "scip_symbol", "name", "kind", "def_file_path", "def_start_line")

    def edges_between(self, nodes: DataFrame) -> DataFrame:
        """Edges with both ends among nodes (id)."""
        ids = nodes.select("id").distinct()
        out = self.edges.join(ids.withColumnRenamed("id", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi")
        return out.orderBy("edge_ord")
