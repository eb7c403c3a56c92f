"""Aggregations over a code graph: counts by type, and the network of directories."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bounded_int, check_prefix, group_label, group_path
from ..schema import CALL_TYPES
from ..session import materialise
from .graph import Graph


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type")


def table_counts(graph: Graph) -> DataFrame:
    """One row: how many symbols, files, occurrences and edges there are."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = one(graph.symbols, "symbols").crossJoin(one(graph.files, "files")).crossJoin(one(graph.edges, "edges"))  # one row each
    return out.crossJoin(one(graph.occurrences, "occurrences")) if graph.occurrences is not None else out


def file_stats(graph: Graph) -> DataFrame:
    """(path, symbols): the symbols of each file with a path, external ones aside."""
    own = graph.symbols.where("not is_external").groupBy(F.col("def_file_id").alias("id")).agg(F.count(F.lit(1)).alias("symbols"))
    return graph.files.where("path != ''").join(own, "id", "left").select("path", F.coalesce("symbols", F.lit(0)).alias("symbols"))


def _under(c: Column, prefix: str) -> Column:
    return (c == prefix) | F.startswith(c, F.lit(prefix + "/"))


def file_pairs(graph: Graph, edge_types: tuple[str, ...] = CALL_TYPES, prefix: str = "") -> DataFrame:
    """(src_path, dst_path, type, relationships, weight) between files, of edges with an end under the prefix."""
    paths = graph.files.where("path != ''").select(F.col("id").alias("def_file_id"), "path")
    of = graph.symbols.where("not is_external").select("id", "def_file_id").join(paths, "def_file_id").select("id", "path")
    rows = graph.edges.where(F.col("type").isin(*edge_types)).select("src_id", "dst_id", "type", "weight")
    rows = rows.join(of.select(F.col("id").alias("src_id"), F.col("path").alias("src_path")), "src_id").join(of.select(F.col("id").alias("dst_id"), F.col("path").alias("dst_path")), "dst_id")
    if prefix:
        rows = rows.where(_under(F.col("src_path"), prefix) | _under(F.col("dst_path"), prefix))
    return rows.groupBy("src_path", "dst_path", "type").agg(F.count(F.lit(1)).alias("relationships"), F.sum(F.coalesce("weight", F.lit(1))).alias("weight"))


@dataclass
class Network:
    """A directory network before and after its caps; totals is one row."""

    nodes: DataFrame
    edges: DataFrame
    totals: DataFrame
    all_nodes: DataFrame
    all_edges: DataFrame


def global_network(graph: Graph, prefix: str = "", edge_types: tuple[str, ...] = CALL_TYPES, include_internal: bool = False, max_nodes: int = 100, max_edges: int = 320) -> Network:
    """Directories one level below the prefix, and what runs between them.

    Files are rolled up twice: to pairs of files, which is where nearly all rows go, then to pairs of directories.
    """
    prefix = check_prefix(prefix)
    max_nodes, max_edges = bounded_int(max_nodes, 100, 2, 160), bounded_int(max_edges, 320, 1, 420)
    pairs = materialise(file_pairs(graph, edge_types, prefix), "pairs")  # all counts below are sums of it
    rolled = pairs.groupBy(group_path(F.col("src_path"), prefix).alias("source"), group_path(F.col("dst_path"), prefix).alias("target"), "type").agg(F.sum("relationships").alias("relationships"), F.sum("weight").alias("weight"))
    inside = F.col("source") == F.col("target")
    edges = rolled if include_internal else rolled.where(~inside)

    stats = file_stats(graph)
    group = group_path(F.col("path"), prefix)
    below = F.startswith("path", F.concat(group, F.lit("/")))
    files = stats.groupBy(group.alias("id")).agg(F.count(F.lit(1)).alias("files"), F.sum("symbols").alias("symbols"), F.bool_or(below).alias("can_drill"), F.bool_or(F.col("path") == group).alias("is_file"))
    counted = F.lit(True) if include_internal else ~inside
    ends = F.array(
        F.struct(F.col("source").alias("id"), F.lit(0).alias("incoming"), F.when(counted, F.col("relationships")).otherwise(0).alias("outgoing"), F.when(inside, F.col("relationships")).otherwise(0).alias("internal")),
        F.struct(F.col("target").alias("id"), F.when(counted, F.col("relationships")).otherwise(0).alias("incoming"), F.lit(0).alias("outgoing"), F.lit(0).alias("internal")),
    )
    flows = rolled.select(F.explode(ends).alias("e")).select("e.*").groupBy("id").agg(*(F.sum(c).alias(c) for c in ("incoming", "outgoing", "internal")))
    all_nodes = files.where(~F.col("id").isin("@outside", "@external")).join(flows, "id", "full")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("files", "symbols", "incoming", "outgoing", "internal")} | {c: F.coalesce(c, F.lit(False)) for c in ("can_drill", "is_file")}
    all_nodes = all_nodes.withColumns(zero).withColumns({"label": group_label(F.col("id")), "can_drill": F.col("can_drill") & ~F.startswith("id", F.lit("@"))}).select("id", "label", "files", "symbols", "incoming", "outgoing", "internal", "can_drill", "is_file")

    rank = [(F.col("incoming") + F.col("outgoing")).desc(), F.desc("symbols"), F.desc("files"), F.desc("id")]
    nodes = all_nodes.orderBy(*rank).limit(max_nodes)
    if prefix:  # what lies outside is always shown
        nodes = nodes.union(all_nodes.where("id = '@outside'")).distinct()
    known = F.broadcast(nodes.select("id"))  # at most max_nodes + 1
    between = edges.join(known.withColumnRenamed("id", "source"), "source", "left_semi").join(known.withColumnRenamed("id", "target"), "target", "left_semi")
    shown = between.orderBy(F.desc("relationships"), F.desc("weight"), F.desc("type"), F.desc("source"), F.desc("target")).limit(max_edges)
    sums = all_nodes.where("not startswith(id, '@') or id = '@root'").agg(F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.coalesce(F.sum("symbols"), F.lit(0)).alias("symbols"))
    totals = sums.crossJoin(pairs.agg(F.coalesce(F.sum("relationships"), F.lit(0)).alias("relationships"))).crossJoin(all_nodes.agg((F.count(F.lit(1)) > max_nodes).alias("nodes_truncated"))).crossJoin(between.agg((F.count(F.lit(1)) > max_edges).alias("edges_truncated")))  # one row each
    return Network(nodes, shown, totals, all_nodes, edges)
