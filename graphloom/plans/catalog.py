"""The registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.symbols import parse_symbol
from ..operators import derive, metrics, rollup, search
from ..operators.graph import Graph
from ..streaming import incremental
from . import projection
from . import scip_projection as sx
from .projection import Tables, graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

CUSTOMER, OTHER = "cxx . . $ Customer#000000007().", "cxx . . $ Customer#000000011()."
SUPPLIER, PART = "cxx . . $ Supplier#000000005_ops#", "cxx . . $ part_42."
_CALLS = "('calls', 'ops_bind')"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["g1_find_callers"](spark, sf_dir)


def _query(sql: str | None = None, with_graph: bool = True, with_index: bool = False) -> Callable:
    """Register a function of (spark, sf_dir) under its name; sql goes behind the graph's tables if with_graph, or the index's if with_index."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            sql_ = sql.strip()
            before = sx.SQL if with_index else projection.SQL
            ORACLE_SQL[f.__name__] = (before + (", " + sql_[5:] if sql_.startswith("WITH ") else sql_)) if with_graph else sql_
        return f

    return add


def _id(symbol: str) -> str:
    return f"(SELECT id FROM g_symbols WHERE scip_symbol = '{symbol}')"


# Traversals


def _walk_sql(near: str, far: str, depth: int) -> str:
    return f"""WITH w AS (SELECT 1 AS depth, {far} AS node, type AS edge_type, line, file_id FROM g_edges WHERE {near} = {_id(CUSTOMER)} AND type IN {_CALLS}
      UNION ALL SELECT depth + 1, e.{far}, e.type, e.line, e.file_id FROM w JOIN g_edges e ON e.{near} = w.node AND e.type IN {_CALLS} WHERE depth < {depth})
    SELECT w.depth, w.edge_type, w.line, s.scip_symbol, s.name, s.kind, f.path AS file_path FROM w JOIN g_symbols s ON s.id = w.node LEFT JOIN g_files f ON f.id = w.file_id"""


@_query(_walk_sql("dst_id", "src_id", 2))
def g1_find_callers(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).find_callers(CUSTOMER, 2, -1)


@_query(_walk_sql("src_id", "dst_id", 2))
def g2_find_callees(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).find_callees(CUSTOMER, 2, -1)


@_query(_walk_sql("dst_id", "src_id", 3))
def g1_find_callers_depth3(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).find_callers(CUSTOMER, 3, -1)


@_query(
    f"""WITH w AS (SELECT {_id(CUSTOMER)} AS node, 0 AS depth UNION SELECT e.src_id, depth + 1 FROM w JOIN g_edges e ON e.dst_id = w.node AND e.type IN {_CALLS} WHERE depth < 3)
    SELECT min(w.depth) AS depth, s.scip_symbol, s.name, s.kind FROM w JOIN g_symbols s ON s.id = w.node WHERE s.scip_symbol <> '{CUSTOMER}' GROUP BY ALL"""
)
def g1_callers_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).find_callers(CUSTOMER, 3, -1, mode="nodes")


@_query(
    f"""WITH w AS (SELECT 1 AS depth, dst_id AS node, type AS edge_type, line FROM g_edges WHERE src_id = {_id(CUSTOMER)} AND type IN {_CALLS}
      UNION ALL SELECT depth + 1, e.dst_id, e.type, e.line FROM w JOIN g_edges e ON e.src_id = w.node AND e.type IN {_CALLS} WHERE depth < 4 AND w.node <> {_id(OTHER)})
    SELECT s.scip_symbol, s.name, s.kind, f.path AS file_path, w.line, w.edge_type, w.depth FROM w JOIN g_symbols s ON s.id = w.node LEFT JOIN g_files f ON f.id = s.def_file_id
    WHERE s.scip_symbol = '{OTHER}' ORDER BY depth, line NULLS FIRST, edge_type LIMIT 4"""
)
def g3_call_path_arrivals(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).call_path_arrivals(CUSTOMER, OTHER, 4)


@_query(
    f"""WITH w AS (SELECT {_id(CUSTOMER)} AS node, 0 AS depth UNION SELECT e.dst_id, depth + 1 FROM w JOIN g_edges e ON e.src_id = w.node AND e.type IN {_CALLS} WHERE depth < 6),
    lvl AS (SELECT node, min(depth) AS d FROM w GROUP BY node),
    by_ AS (SELECT b.node, b.d, min(row(e.src_id, e.line, e.type)) AS e FROM g_edges e JOIN lvl a ON a.node = e.src_id JOIN lvl b ON b.node = e.dst_id AND b.d = a.d + 1 WHERE e.type IN {_CALLS} GROUP BY b.node, b.d),
    p AS (SELECT b.d AS depth, b.node, b.e[1] AS before, b.e[2] AS line, b.e[3] AS edge_type FROM by_ b WHERE b.node = {_id(OTHER)}
      UNION ALL SELECT b.d, b.node, b.e[1], b.e[2], b.e[3] FROM p JOIN by_ b ON b.node = p.before),
    chain AS (SELECT depth, node, line, edge_type FROM p UNION ALL SELECT 0, {_id(CUSTOMER)}, NULL, NULL WHERE EXISTS (SELECT 1 FROM p))
    SELECT c.depth, s.scip_symbol, s.name, s.kind, f.path AS file_path, c.line, c.edge_type FROM chain c JOIN g_symbols s ON s.id = c.node LEFT JOIN g_files f ON f.id = s.def_file_id"""
)
def g3_call_path(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).call_path(CUSTOMER, OTHER, 6)


@_query(
    f"""WITH c AS (SELECT 0 AS depth, {_id(CUSTOMER)} AS node, NULL::BIGINT AS file_id, NULL::INT AS line, [{_id(CUSTOMER)}] AS seen
      UNION ALL SELECT c.depth + 1, e.src_id, e.file_id, e.line, list_append(c.seen, e.src_id) FROM c JOIN (SELECT * FROM g_edges WHERE type IN {_CALLS} QUALIFY row_number() OVER (PARTITION BY dst_id ORDER BY line NULLS FIRST, edge_ord) = 1) e ON e.dst_id = c.node
      WHERE c.depth < 8 AND NOT list_contains(c.seen, e.src_id))
    SELECT c.depth, s.scip_symbol, s.name, s.kind, f.path AS file_path, c.line FROM c JOIN g_symbols s ON s.id = c.node LEFT JOIN g_files f ON f.id = c.file_id"""
)
def g4_get_callchain(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).get_callchain(CUSTOMER, 8)


@_query(f"SELECT edge_ord, src_id, dst_id, type, line FROM g_edges WHERE src_id = {_id(CUSTOMER)} OR dst_id = {_id(CUSTOMER)}")
def g5_neighborhood(spark: SparkSession, d: str) -> DataFrame:
    return _around(spark, graph(spark, d).get_neighborhood(CUSTOMER, 1, None, 500, 1000))


@_query(f"SELECT edge_ord, src_id, dst_id, type, line FROM g_edges WHERE (src_id = {_id(CUSTOMER)} OR dst_id = {_id(CUSTOMER)}) ORDER BY CASE type WHEN 'calls' THEN 0 WHEN 'ops_bind' THEN 1 ELSE 2 END, edge_ord LIMIT 15")
def g5_neighborhood_capped(spark: SparkSession, d: str) -> DataFrame:
    return _around(spark, graph(spark, d).get_neighborhood(CUSTOMER, 1, None, 500, 15))


def _around(spark: SparkSession, found: dict) -> DataFrame:
    rows = [(e["edge_ord"], e["src_id"], e["dst_id"], e["type"], e["line"]) for e in found["edges"]]
    return spark.createDataFrame(rows, "edge_ord long, src_id long, dst_id long, type string, line int")


_NEAR = "near{0} AS (SELECT DISTINCT unnest([src_id, dst_id]) AS id FROM g_edges WHERE type = 'type_of' AND (src_id IN (SELECT id FROM near{1}) OR dst_id IN (SELECT id FROM near{1})) UNION SELECT id FROM near{1})"


@_query(f"WITH near0 AS (SELECT {_id(PART)} AS id), {_NEAR.format(1, 0)} SELECT edge_ord, src_id, dst_id, type, line FROM g_edges WHERE type = 'type_of' AND (src_id IN (SELECT id FROM near1) OR dst_id IN (SELECT id FROM near1)) ORDER BY edge_ord LIMIT 1000")
def g5_neighborhood_depth2(spark: SparkSession, d: str) -> DataFrame:
    return _around(spark, graph(spark, d).get_neighborhood(PART, 2, ("type_of",), 500, 1000))


@_query(f"SELECT t.scip_symbol AS type_symbol, t.name AS type_name, t.kind AS type_kind, t.signature, f.path AS def_file_path, t.def_start_line, t.def_end_line FROM g_edges e JOIN g_symbols t ON t.id = e.dst_id LEFT JOIN g_files f ON f.id = t.def_file_id WHERE e.type = 'type_of' AND e.src_id = {_id(PART)}")
def g6_find_type_definition(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).find_type_definition(PART)


@_query(f"SELECT s.scip_symbol, s.name, s.kind, s.signature, s.def_start_line FROM g_edges e JOIN g_symbols s ON s.id = e.dst_id WHERE e.type = 'contains' AND e.src_id = {_id(SUPPLIER)}")
def g7_struct_fields(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).struct_fields(SUPPLIER)


@_query(f"SELECT '{SUPPLIER}' AS struct_symbol, (SELECT name FROM g_symbols WHERE scip_symbol = '{SUPPLIER}') AS struct_name, count(*) AS n_fields, string_agg(s.scip_symbol, ',' ORDER BY s.def_start_line, s.scip_symbol) AS fields FROM g_edges e JOIN g_symbols s ON s.id = e.dst_id WHERE e.type = 'contains' AND e.src_id = {_id(SUPPLIER)}")
def g7_get_struct_layout(spark: SparkSession, d: str) -> DataFrame:
    out = graph(spark, d).get_struct_layout(SUPPLIER)
    return out.select("struct_symbol", "struct_name", F.size("fields").cast("long").alias("n_fields"), F.array_join("fields.scip_symbol", ",").alias("fields"))


@_query("SELECT e.src_id, e.dst_id, e.type, e.file_id, e.line, e.confidence, e.metadata, a.scip_symbol AS ops_symbol, a.name AS ops_name, b.scip_symbol AS impl_symbol, b.name AS impl_name, f.path AS file_path FROM g_edges e JOIN g_symbols a ON a.id = e.src_id JOIN g_symbols b ON b.id = e.dst_id LEFT JOIN g_files f ON f.id = e.file_id WHERE e.type = 'ops_bind' AND e.metadata ILIKE '%customer#00000000%' AND (starts_with(a.name, 'Supplier#00000001') OR contains(a.scip_symbol, 'Supplier#00000001'))")
def g8_find_ops_impls(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).find_ops_impls("customer#00000000", "Supplier#00000001")


# Lookups

_SCORE = """WITH toks AS (SELECT doc_id AS doc, c, regexp_extract_all(strip_accents(lower(coalesce(x, ''))), '[\\p{L}\\p{N}]+') AS t FROM (SELECT doc_id, unnest(['text', 'lang', 'source']) AS c, unnest([text, lang, source]) AS x FROM documents)),
post AS (SELECT doc, c, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM toks), sizes AS (SELECT doc, sum(len(t)) AS size FROM toks GROUP BY doc),
stats AS (SELECT count(*) AS total, avg(size) AS mean FROM sizes),
p1 AS (SELECT a.doc, count(*) AS f FROM post a JOIN post b ON a.doc = b.doc AND a.c = b.c AND b.pos = a.pos + 1 WHERE a.token = 'of' AND b.token = 'the' GROUP BY a.doc),
p2 AS (SELECT doc, count(*) AS f FROM post WHERE starts_with(token, 'thi') GROUP BY doc),
p3 AS (SELECT doc FROM post WHERE c = 'source' AND token = 'src3'),
both_ AS (SELECT p1.doc, p1.f AS f1, p2.f AS f2 FROM p1 JOIN p2 ON p1.doc = p2.doc WHERE p1.doc NOT IN (SELECT doc FROM p3)),
idf AS (SELECT *, ln((total - n1 + 0.5) / (n1 + 0.5)) AS i1, ln((total - n2 + 0.5) / (n2 + 0.5)) AS i2 FROM stats, (SELECT count(*) AS n1 FROM p1), (SELECT count(*) AS n2 FROM p2))
SELECT b.doc, round(-(CASE WHEN i1 <= 0 THEN 1e-6 ELSE i1 END * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * size / mean))) - (CASE WHEN i2 <= 0 THEN 1e-6 ELSE i2 END * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score FROM both_ b JOIN sizes s ON s.doc = b.doc, idf"""


@_query(_SCORE, with_graph=False)
def l1_search(spark: SparkSession, d: str) -> DataFrame:
    found = search.ranked(projection.text_index(spark, d), '"of the" AND (thi* NOT source:src3)', projection.TEXTS)
    return found.select("doc", F.round("score", 6).alias("score"))


@_query("SELECT s.id, s.scip_symbol, s.name, s.kind, s.signature, s.documentation, f.path AS def_file_path, s.def_start_line, s.def_end_line, s.is_external FROM g_symbols s LEFT JOIN g_files f ON f.id = s.def_file_id WHERE name = 'red widget' AND kind = 'field' ORDER BY is_external, def_start_line, s.id LIMIT 10")
def l2_get_symbol(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).get_symbol("red widget", "field", 10)


@_query(f"SELECT scip_symbol, name, kind, f.path AS def_file_path, def_start_line, def_end_line FROM g_symbols s LEFT JOIN g_files f ON f.id = s.def_file_id WHERE scip_symbol = '{CUSTOMER}'")
def l3_get_definition_location(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).get_definition_location(CUSTOMER)


@_query(f"SELECT f.path AS file_path, start_line, start_col, end_line, end_col, role, e.name AS enclosing_name, e.kind AS enclosing_kind, e.scip_symbol AS enclosing_symbol, role & 1 = 1 AS is_definition FROM g_occurrences o JOIN g_files f ON f.id = o.file_id LEFT JOIN g_symbols e ON e.id = o.enclosing_symbol_id WHERE symbol_id = {_id(CUSTOMER)} ORDER BY f.path, start_line, o.id LIMIT 200")
def l4_find_references(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).find_references(CUSTOMER)


@_query("SELECT id, scip_symbol, name, kind, signature, def_start_line, def_end_line, is_external, total FROM (SELECT *, count(*) OVER () AS total FROM g_symbols WHERE kind <> 'module' AND def_file_id = (SELECT id FROM g_files WHERE path = 'include/brand_2.h')) ORDER BY def_start_line, name, scip_symbol LIMIT 50 OFFSET 5")
def l5_get_file_symbols(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).get_file_symbols("include/brand_2.h", 50, 5)


@_query("SELECT lower(r_name) AS key, r_regionkey::VARCHAR AS value FROM region", with_graph=False)
def l6_get_metadata(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).get_metadata()


@_query("SELECT scip_symbol FROM (SELECT * FROM g_symbols WHERE name = 'red widget' AND kind = 'field' ORDER BY is_external, def_start_line, id LIMIT 10) ORDER BY (is_external OR def_start_line < 0), is_external, def_start_line, id LIMIT 1")
def l7_resolve_one(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(graph(spark, d).resolve_one("red widget", "field"),)], "scip_symbol string")


@_query("SELECT s.id, scip_symbol, name, kind, f.path AS def_file_path, def_start_line FROM g_symbols s LEFT JOIN g_files f ON f.id = s.def_file_id WHERE name ILIKE '%red ring%' ORDER BY (lower(name) = 'red ring') DESC, coalesce(def_start_line >= 0, false) DESC, f.path, s.id LIMIT 12")
def l11_rank_candidates(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).rank_candidates("red ring", 12)


@_query("SELECT e.* FROM g_edges e WHERE src_id IN (SELECT id FROM g_symbols WHERE def_file_id IN (SELECT id FROM g_files WHERE starts_with(path, 'asia/'))) AND dst_id IN (SELECT id FROM g_symbols WHERE def_file_id IN (SELECT id FROM g_files WHERE starts_with(path, 'asia/')))")
def l12_edges_between(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    asia = g.files.where("startswith(path, 'asia/')").select(F.col("id").alias("def_file_id"))
    return g.edges_between(g.symbols.join(asia, "def_file_id", "left_semi"))


# Aggregations


@_query("SELECT type, count(*) AS n FROM g_edges GROUP BY type")
def a1_edge_counts(spark: SparkSession, d: str) -> DataFrame:
    return rollup.edge_counts(graph(spark, d).edges)


_STATS = "stats AS (SELECT f.path, count(s.id) AS symbols FROM g_files f LEFT JOIN g_symbols s ON s.def_file_id = f.id AND NOT s.is_external WHERE f.path <> '' GROUP BY f.path)"
_PAIRS = "pairs AS (SELECT a.path AS src_path, b.path AS dst_path, e.type, count(*) AS relationships, sum(e.weight)::BIGINT AS weight FROM g_edges e JOIN g_symbols s ON s.id = e.src_id AND NOT s.is_external JOIN g_symbols t ON t.id = e.dst_id AND NOT t.is_external JOIN g_files a ON a.id = s.def_file_id JOIN g_files b ON b.id = t.def_file_id WHERE e.type IN ({types}) {where} GROUP BY ALL)"


def _pairs(types: str = "'calls', 'ops_bind'", prefix: str = "") -> str:
    where = f"AND (a.path = '{prefix}' OR starts_with(a.path, '{prefix}/') OR b.path = '{prefix}' OR starts_with(b.path, '{prefix}/'))" if prefix else ""
    return _PAIRS.format(types=types, where=where)


def _group(c: str, prefix: str = "") -> str:
    if not prefix:
        return f"split_part({c}, '/', 1)"
    return f"CASE WHEN {c} = '{prefix}' THEN {c} WHEN starts_with({c}, '{prefix}/') THEN '{prefix}/' || split_part(substr({c}, {len(prefix) + 2}), '/', 1) ELSE '@outside' END"


def _network(prefix: str = "", types: str = "'calls', 'ops_bind'") -> str:
    g = lambda c: _group(c, prefix)
    return f"""{_STATS}, {_pairs(types, prefix)},
    rolled AS (SELECT {g("src_path")} AS source, {g("dst_path")} AS target, type, sum(relationships)::BIGINT AS relationships, sum(weight)::BIGINT AS weight FROM pairs GROUP BY ALL),
    flows AS (SELECT id, sum(i)::BIGINT AS incoming, sum(o)::BIGINT AS outgoing, sum(n)::BIGINT AS internal FROM (
        SELECT source AS id, 0 AS i, CASE WHEN source <> target THEN relationships ELSE 0 END AS o, CASE WHEN source = target THEN relationships ELSE 0 END AS n FROM rolled
        UNION ALL SELECT target, CASE WHEN source <> target THEN relationships ELSE 0 END, 0, 0 FROM rolled) GROUP BY id),
    grouped AS (SELECT {g("path")} AS id, count(*) AS files, sum(symbols)::BIGINT AS symbols, bool_or(starts_with(path, {g("path")} || '/')) AS can_drill, bool_or(path = {g("path")}) AS is_file FROM stats GROUP BY 1),
    nodes AS (SELECT coalesce(g.id, f.id) AS id, coalesce(files, 0) AS files, coalesce(symbols, 0) AS symbols, coalesce(incoming, 0) AS incoming, coalesce(outgoing, 0) AS outgoing, coalesce(internal, 0) AS internal, coalesce(can_drill, false) AS can_drill, coalesce(is_file, false) AS is_file FROM (SELECT * FROM grouped WHERE id <> '@outside') g FULL JOIN flows f ON f.id = g.id)"""


_LABEL = "CASE id WHEN '@outside' THEN 'outside scope' ELSE split_part(id, '/', -1) END AS label"


@_query(f"WITH {_STATS} SELECT * FROM stats")
def a2_file_stats(spark: SparkSession, d: str) -> DataFrame:
    return rollup.file_stats(graph(spark, d))


@_query(f"WITH {_pairs()} SELECT * FROM pairs")
def a3_file_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rollup.file_pairs(graph(spark, d))


@_query(f"WITH {_network()} SELECT id, {_LABEL}, files, symbols, incoming, outgoing, internal, can_drill, is_file FROM nodes")
def a4_network_nodes(spark: SparkSession, d: str) -> DataFrame:
    return rollup.global_network(graph(spark, d)).all_nodes


@_query(f"WITH {_network('asia')} SELECT id, {_LABEL}, files, symbols, incoming, outgoing, internal, can_drill, is_file FROM nodes")
def a4_network_prefix(spark: SparkSession, d: str) -> DataFrame:
    return rollup.global_network(graph(spark, d), "asia").all_nodes


_ALL = "'calls', 'ops_bind', 'references', 'contains'"


@_query(f"WITH {_network('', _ALL)}, kept AS (SELECT id FROM nodes ORDER BY incoming + outgoing DESC, symbols DESC, files DESC, id DESC LIMIT 4) SELECT source, target, type, relationships, weight FROM rolled WHERE source <> target AND source IN (SELECT id FROM kept) AND target IN (SELECT id FROM kept) ORDER BY relationships DESC, weight DESC, type DESC, source DESC, target DESC LIMIT 10")
def a5_network_edges(spark: SparkSession, d: str) -> DataFrame:
    return rollup.global_network(graph(spark, d), "", ("calls", "ops_bind", "references", "contains"), False, 4, 10).edges.select("source", "target", "type", "relationships", "weight")


@_query(f"WITH {_network('', _ALL)} SELECT id, files, symbols, incoming, outgoing, internal FROM nodes ORDER BY incoming + outgoing DESC, symbols DESC, files DESC, id DESC LIMIT 4")
def a5_network_top(spark: SparkSession, d: str) -> DataFrame:
    return rollup.global_network(graph(spark, d), "", ("calls", "ops_bind", "references", "contains"), False, 4, 10).nodes.select("id", "files", "symbols", "incoming", "outgoing", "internal")


@_query("SELECT (SELECT count(*) FROM g_symbols) AS symbols, (SELECT count(*) FROM g_files) AS files, (SELECT count(*) FROM g_edges) AS edges, (SELECT count(*) FROM g_occurrences) AS occurrences")
def a6_table_counts(spark: SparkSession, d: str) -> DataFrame:
    return rollup.table_counts(graph(spark, d))


@_query(
    """WITH n AS (SELECT (SELECT count(*) FROM g_edges e JOIN g_symbols s ON s.id = e.src_id WHERE e.type = 'contains' AND s.name = 'file_operations') AS file_operations_fields,
      (SELECT count(*) FROM g_edges WHERE type = 'ops_bind' AND metadata ILIKE '%read_iter%') AS read_iter_bindings,
      (SELECT count(*) FROM g_edges e JOIN g_symbols s ON s.id = e.dst_id WHERE e.type = 'ops_bind' AND metadata ILIKE '%read_iter%' AND s.name ILIKE '%ext4%') AS read_iter_ext4,
      (SELECT count(*) FROM g_symbols) AS symbols, (SELECT count(*) FROM g_edges WHERE type = 'ops_bind') AS ops_bind, (SELECT count(*) FROM g_edges WHERE type = 'contains') AS contains, (SELECT count(*) FROM g_symbols WHERE name = 'vfs_read') AS vfs_read),
    x AS (SELECT unnest(['file_operations_fields', 'read_iter_bindings', 'read_iter_ext4', 'symbols', 'ops_bind', 'contains', 'vfs_read']) AS id, unnest([30, 1, 1, 1000, 10, 10, 1])::BIGINT AS expected,
      unnest([file_operations_fields, read_iter_bindings, read_iter_ext4, symbols, ops_bind, contains, vfs_read]) AS actual FROM n)
    SELECT id, actual >= expected AS passed, expected, actual FROM x"""
)
def a7_canary_checks(spark: SparkSession, d: str) -> DataFrame:
    return metrics.canary_checks(graph(spark, d), {"symbols": 1000, "ops_bind": 10, "contains": 10})


@_query("WITH l AS (SELECT * FROM events ORDER BY ts DESC LIMIT 7) SELECT count(*) AS days, count(*) FILTER (value > 20) AS buildable, count(*) FILTER (value > 50) AS benchmark_ok, arg_max(event_id::VARCHAR, ts) AS head, arg_max(user_id, ts) AS symbols FROM l", with_graph=False)
def a8_dashboard(spark: SparkSession, d: str) -> DataFrame:
    rows = Tables(spark, d).events.select("ts", F.col("event_id").cast("string").alias("head"), (F.col("value") > 20).alias("buildable"), (F.col("value") > 50).alias("benchmark_ok"), F.col("user_id").alias("symbols"))
    return metrics.dashboard(rows)


def _cells(spark: SparkSession, d: str) -> DataFrame:
    runs = Tables(spark, d).events.select(
        F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"),
        F.col("event_type").alias("tier"),
        F.when(F.col("user_id") % 2 == 0, "A").otherwise("B").alias("arm"),
        F.when(F.col("event_id") % 11 == 0, "failed").alias("error"),
        F.struct(F.lit(1.0).alias("recall"), F.lit(1.0).alias("precision"), F.col("value").alias("f1")).alias("accuracy"),
        F.struct((F.col("event_id") % 997).alias("tokens_in"), F.col("user_id").alias("tokens_out"), F.create_map(F.lit("read"), (F.col("event_id") % 5).cast("int"), F.lit("grep"), F.lit(1)).alias("tool_calls"), (F.col("value") * 2).alias("wall_seconds")).alias("cost"),
    )
    return metrics.eval_cells(runs)


_CELLS = "cells AS (SELECT 'm' || (user_id % 3)::VARCHAR AS model, event_type AS tier, CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS arm, value AS f1, event_id % 997 + user_id AS tokens, event_id % 5 + 1 AS calls, value * 2 AS wall FROM events WHERE event_id % 11 <> 0)"
_MEDIANS = "median(f1)::DOUBLE AS f1, median(tokens)::DOUBLE AS tokens, median(calls)::DOUBLE AS calls, median(wall)::DOUBLE AS wall, count(*) AS n"


@_query(f"WITH {_CELLS} SELECT model, tier, arm, {_MEDIANS} FROM cells GROUP BY ALL", with_graph=False)
def a9_eval_medians(spark: SparkSession, d: str) -> DataFrame:
    return metrics.medians(_cells(spark, d))


@_query(
    f"""WITH {_CELLS}, m AS (SELECT tier, arm, {_MEDIANS} FROM cells GROUP BY tier, arm)
    SELECT a.tier, round(b.f1 - a.f1, 6) AS f1_change, printf('%+.1f%%', (b.tokens - a.tokens) / a.tokens * 100) AS tokens_gain, printf('%+.1f%%', (b.calls - a.calls) / a.calls * 100) AS calls_gain, greatest(a.n, b.n) AS n FROM m a JOIN m b ON a.tier = b.tier AND a.arm = 'A' AND b.arm = 'B'""",
    with_graph=False,
)
def a10_gain_table(spark: SparkSession, d: str) -> DataFrame:
    return metrics.gain_table(_cells(spark, d), "A", "B").withColumn("f1_change", F.round("f1_change", 6))


@_query(f"""WITH {_CELLS} SELECT model, median(f1) FILTER (arm = 'A') AS "A_f1", median(tokens) FILTER (arm = 'A') AS "A_tokens", median(f1) FILTER (arm = 'B') AS "B_f1", median(tokens) FILTER (arm = 'B') AS "B_tokens" FROM cells GROUP BY model""", with_graph=False)
def a11_model_matrix(spark: SparkSession, d: str) -> DataFrame:
    return metrics.model_matrix(_cells(spark, d), ["A", "B"])


@_query("SELECT count(*) AS total, count(*) FILTER (value > 70) AS rebuilt, count(*) FILTER (value > 70) / count(*)::DOUBLE AS fraction, count(*) FILTER (value > 70) / count(*)::DOUBLE > 0.3 AS refused FROM events", with_graph=False)
def a12_rebuilt_fraction(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rebuilt_fraction(Tables(spark, d).events.select((F.col("value") > 70).alias("rebuilt")))


# Derivation

_RANGES = "ranges AS (SELECT user_id AS doc_ord, (event_id % 5000)::INT AS start, (event_id % 5000 + event_id % 7 * 200)::INT AS \"end\", 0 AS col, event_id::VARCHAR AS symbol FROM events WHERE event_type = 'signup')"


def _ranges(t: Tables) -> DataFrame:
    line = F.col("event_id") % 5000
    rows = t.events.select(F.col("user_id").alias("doc_ord"), F.when(F.col("event_type") == "signup", 1).otherwise(8).alias("role"), line.cast("int").alias("sl"), F.lit(0).alias("sc"), line.cast("int").alias("body_start"), (line + F.col("event_id") % 7 * 200).cast("int").alias("body_end"), F.col("event_id").cast("string").alias("symbol"))
    return derive.definition_ranges(rows)


@_query(f"WITH {_RANGES} SELECT * FROM ranges", with_graph=False)
def i6_definition_ranges(spark: SparkSession, d: str) -> DataFrame:
    return _ranges(Tables(spark, d))


@_query(f"""WITH {_RANGES} SELECT e.event_id AS point, e.user_id AS doc_ord, (e.event_id % 5000)::INT AS line, (SELECT arg_max(symbol, row(start, "end", col, symbol)) FROM ranges r WHERE r.doc_ord = e.user_id AND r.start <= e.event_id % 5000 AND e.event_id % 5000 <= r."end") AS encloser FROM events e WHERE e.event_type <> 'signup'""", with_graph=False)
def i7_enclosing_match(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    points = t.events.where("event_type != 'signup'").select(F.col("event_id").alias("point"), F.col("user_id").alias("doc_ord"), (F.col("event_id") % 5000).cast("int").alias("line"))
    return derive.enclosing(points, _ranges(t))


@_query("SELECT src_id, dst_id, type, file_id, line FROM (SELECT o.id AS src_id, p.id AS dst_id, 'contains' AS type, p.def_file_id AS file_id, p.def_start_line AS line FROM g_symbols p JOIN g_symbols o ON o.scip_symbol = p.enclosing_symbol WHERE p.kind = 'field')")
def i10_recovered_contains(spark: SparkSession, d: str) -> DataFrame:
    return derive.recovered_contains(graph(spark, d).symbols).drop("metadata")


@_query("SELECT user_id, event_type, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1", with_graph=False)
def i11_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return derive.keep_first(Tables(spark, d).events.select("user_id", "event_type", "event_id", "ts", "value"), ["user_id", "event_type"], ["ts", "event_id"])


# The index of the driver's tables, through the whole of ingest


@_query("SELECT doc_ord, 'document' AS part, path, CASE (doc_ord - 1) % 3 WHEN 0 THEN 'CPP' WHEN 1 THEN 'C' ELSE 'Rust' END AS language, (SELECT count(*) FROM x_infos i WHERE i.doc_ord = d.doc_ord) AS n_symbols, (SELECT count(*) FROM x_occs o WHERE o.doc_ord = d.doc_ord) AS n_occurrences FROM x_docs d UNION ALL SELECT 0, 'metadata', '', '', 0, 0 UNION ALL SELECT (SELECT max(doc_ord) + 1 FROM x_docs), 'external', '', '', 5, 0", with_index=True)
def s1_scip_scan(spark: SparkSession, d: str) -> DataFrame:
    sizes = [F.sum(F.size(c)).cast("long").alias(f"n_{c}") for c in ("symbols", "occurrences")]  # large documents have several rows
    return sx.index(spark, d).groupBy("doc_ord", "part", F.col("relative_path").alias("path"), "language").agg(*sizes)


@_query("SELECT unnest(['project_root', 'tool_name', 'tool_version', 'tool_arguments']) AS key, unnest(['/kernel', 'tables', '1', '-a b']) AS value", with_index=True)
def i1_metadata(spark: SparkSession, d: str) -> DataFrame:
    return derive.metadata_rows(sx.index(spark, d, only="heads"))


_INFOS = "SELECT doc_ord, sym_ord, symbol AS scip_symbol, name, kind, signature, documentation, enclosing AS enclosing_symbol FROM x_infos"


def _infos(spark: SparkSession, d: str) -> DataFrame:
    return sx.derived(spark, d)[0].select("doc_ord", "sym_ord", "scip_symbol", "name", "kind", "signature", "documentation", "enclosing_symbol", "is_external")


@_query(f"{_INFOS} WHERE NOT ext", with_index=True)
def i2_symbol_project(spark: SparkSession, d: str) -> DataFrame:
    return _infos(spark, d).where("not is_external").drop("is_external")


@_query(f"{_INFOS} WHERE ext", with_index=True)
def i3_external_project(spark: SparkSession, d: str) -> DataFrame:
    return _infos(spark, d).where("is_external").drop("is_external")


@_query("SELECT doc_ord, occ_ord, symbol, role, sl::INT AS sl, 4 AS sc, sl::INT AS el, 20 AS ec FROM x_occs", with_index=True)
def i4_range_extract(spark: SparkSession, d: str) -> DataFrame:
    return sx.derived(spark, d)[1].select("doc_ord", "occ_ord", "symbol", "role", "sl", "sc", "el", "ec")


@_query("SELECT doc_ord, occ_ord, body_start::INT AS body_start, body_end::INT AS body_end FROM x_occs", with_index=True)
def i5_enclosing_range(spark: SparkSession, d: str) -> DataFrame:
    return sx.derived(spark, d)[1].select("doc_ord", "occ_ord", "body_start", "body_end")


def _references(spark: SparkSession, d: str, part: int) -> DataFrame:
    infos, occurrences = sx.derived(spark, d)
    rows = derive.reference_edges(occurrences, infos).where(F.col("part") == part)
    return rows.select("doc_ord", F.col("ord").alias("occ_ord"), "src", "dst", "type", "line", "metadata")


_STEP1 = "SELECT doc_ord, occ_ord, src, dst, type, line::INT AS line, metadata FROM x_step1 WHERE part = "


@_query(_STEP1 + "0", with_index=True)
def i8_edge_derive(spark: SparkSession, d: str) -> DataFrame:
    return _references(spark, d, 0)


@_query(_STEP1 + "1", with_index=True)
def i9_ops_bind_derive(spark: SparkSession, d: str) -> DataFrame:
    return _references(spark, d, 1)


@_query("SELECT doc_ord, 3 AS step, src, dst, line::INT AS line FROM x_step3 UNION ALL SELECT doc_ord, 4, src, dst, line::INT FROM x_step4", with_index=True)
def i10_contains_derive(spark: SparkSession, d: str) -> DataFrame:
    infos, occurrences = sx.derived(spark, d)
    return derive.contains_edges(occurrences, infos).select("doc_ord", "step", "src", "dst", "line")


@_query("SELECT * FROM x_step2", with_index=True)
def i10b_relationships(spark: SparkSession, d: str) -> DataFrame:
    return derive.relationship_edges(sx.derived(spark, d)[0]).select("doc_ord", "src", "dst", "type")


@_query("SELECT o.doc_ord + 1 AS file_id, o.sl::INT AS start_line, o.symbol FROM x_occs o WHERE NOT EXISTS (SELECT 1 FROM x_symbols s WHERE s.scip_symbol = o.symbol AND s.first_doc <= o.doc_ord)", with_index=True)
def i12_known_filter(spark: SparkSession, d: str) -> DataFrame:
    """What ingest left out, since only a later document brings its symbol."""
    g = sx.store(spark, d).graph()
    stored = g.occurrences.join(g.symbols.select(F.col("id").alias("symbol_id"), F.col("scip_symbol").alias("symbol")), "symbol_id").select("file_id", "start_line", "symbol")
    every = sx.derived(spark, d)[1].select((F.col("doc_ord") + 1).alias("file_id"), F.col("sl").alias("start_line"), "symbol")
    return every.exceptAll(stored)


@_query("SELECT path, language FROM x_files", with_index=True)
def i14_language(spark: SparkSession, d: str) -> DataFrame:
    return sx.store(spark, d).graph().files.select("path", "language")


@_query("SELECT id, scip_symbol, name, kind, def_file_id FROM x_symbols WHERE scip_symbol = 'local 1'", with_index=True)
def i15_local_symbol(spark: SparkSession, d: str) -> DataFrame:
    return sx.store(spark, d).graph().symbols.where("startswith(scip_symbol, 'local ')").select("id", "scip_symbol", "name", "kind", "def_file_id")


@_query("SELECT id, path, language FROM x_files", with_index=True)
def k3_write_files(spark: SparkSession, d: str) -> DataFrame:
    return sx.store(spark, d).graph().files.select("id", "path", "language")


@_query("SELECT * EXCLUDE (first_doc) FROM x_symbols", with_index=True)
def k4_write_symbols(spark: SparkSession, d: str) -> DataFrame:
    return sx.store(spark, d).graph().symbols.drop("subsystem")


@_query("SELECT * FROM x_occurrences", with_index=True)
def k5_write_occurrences(spark: SparkSession, d: str) -> DataFrame:
    return sx.store(spark, d).graph().occurrences


@_query("SELECT * EXCLUDE (file) FROM x_edges", with_index=True)
def k6_write_edges(spark: SparkSession, d: str) -> DataFrame:
    return sx.named_edges(sx.store(spark, d))


@_query("SELECT 'total_symbols' AS key, count(*)::VARCHAR AS value FROM x_symbols UNION ALL SELECT 'total_files', count(*)::VARCHAR FROM x_files UNION ALL SELECT 'index_timestamp', '1700000000' UNION ALL SELECT unnest(['project_root', 'tool_name', 'tool_version', 'tool_arguments']), unnest(['/kernel', 'tables', '1', '-a b'])", with_index=True)
def k9_finalize(spark: SparkSession, d: str) -> DataFrame:
    return sx.store(spark, d).graph().get_metadata()


@_query("SELECT src, dst, type FROM x_edges e JOIN x_symbols s ON s.scip_symbol = e.src WHERE coalesce(e.file + 1, s.def_file_id) % 5 <> 0", with_index=True)
def u2_delete_null_file_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges without a file go with their source symbol's file."""
    g = sx.store(spark, d).graph()
    left = incremental.delete_file_records({"symbols": g.symbols, "edges": g.edges, "occurrences": g.occurrences}, _touched(g))["edges"]
    names = g.symbols.select("id", "scip_symbol")
    return left.join(names.withColumnsRenamed({"id": "src_id", "scip_symbol": "src"}), "src_id").join(names.withColumnsRenamed({"id": "dst_id", "scip_symbol": "dst"}), "dst_id").select("src", "dst", "type")


@_query(sx.CHANGED, with_index=True)
def u3_ingest_incremental(spark: SparkSession, d: str) -> DataFrame:
    return sx.named_edges(sx.store(spark, d, moved=True))


@_query("SELECT src_id, dst_id, type, file_id, line, ord FROM (SELECT l_orderkey AS src_id, l_linenumber::BIGINT AS dst_id, l_returnflag AS type, CASE WHEN l_suppkey % 2 = 0 THEN l_suppkey END AS file_id, 0 AS line, l_partkey * 100000 + l_quantity::BIGINT * 1000 + l_suppkey AS ord FROM lineitem) QUALIFY file_id IS NULL OR row_number() OVER (PARTITION BY src_id, dst_id, type, file_id, line ORDER BY ord) = 1", with_graph=False)
def i13_edge_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = Tables(spark, d).lineitem.select(F.col("l_orderkey").alias("src_id"), F.col("l_linenumber").cast("long").alias("dst_id"), F.col("l_returnflag").alias("type"), F.when(F.col("l_suppkey") % 2 == 0, F.col("l_suppkey")).alias("file_id"), F.lit(0).alias("line"), (F.col("l_partkey") * 100000 + F.col("l_quantity").cast("long") * 1000 + F.col("l_suppkey")).alias("ord"), F.lit(0).alias("doc_ord"), F.lit(0).alias("step"), F.lit(0).alias("part"))
    return derive.dedupe_edges(rows).select("src_id", "dst_id", "type", "file_id", "line", "ord")


@_query("SELECT event_type AS key, arg_max(event_id, ts) AS value FROM events GROUP BY event_type", with_graph=False)
def k7_last_writer(spark: SparkSession, d: str) -> DataFrame:
    return derive.latest(Tables(spark, d).events.select(F.col("event_type").alias("key"), F.col("event_id").alias("value"), "ts"), "key", "value", "ts")


# Scalar functions


@_query("SELECT scip_symbol, 'cxx' AS scheme, '. . $' AS package, CASE kind WHEN 'function' THEN 'function' WHEN 'struct' THEN 'struct' ELSE 'global_var' END AS kind, kind AS own_kind, length(scip_symbol) - length(replace(scip_symbol, '#', '')) AS marks FROM g_symbols")
def f1_parse_symbol(spark: SparkSession, d: str) -> DataFrame:
    plain = F.replace("scip_symbol", F.lit("er#"), F.lit("er_"))
    rows = graph(spark, d).symbols.select("scip_symbol", "kind", parse_symbol(plain).alias("p"))
    return rows.select("scip_symbol", "p.scheme", "p.package", "p.kind", F.col("kind").alias("own_kind"), F.regexp_count("scip_symbol", F.lit("#")).cast("long").alias("marks"))


@_query("SELECT path, split_part(path, '/', 1) AS top, CASE WHEN starts_with(path, 'asia/') THEN 'asia/' || split_part(substr(path, 6), '/', 1) ELSE '@outside' END AS below, split_part(path, '/', 1) AS label FROM g_files")
def f6_group_path(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("path")
    return graph(spark, d).files.select("path", scalars.group_path(c).alias("top"), scalars.group_path(c, "asia").alias("below"), scalars.group_label(scalars.group_path(c)).alias("label"))


@_query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'obj/' || p_brand || '.o' WHEN p_size % 3 = 1 THEN p_type || '.o' END AS object FROM part", with_graph=False)
def f11_object_path(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    command = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("cc -c x.c -o obj/"), "p_brand", F.lit(".o -O2"))).when(F.col("p_size") % 3 == 2, F.lit("cc -c x.c"))
    return t.part.select("p_partkey", scalars.object_path(command, F.array(F.lit("cc"), F.lit("-o"), F.concat("p_type", F.lit(".o")))).alias("object"))


@_query("SELECT event_id, CASE WHEN s = '??' THEN 'untracked' WHEN s[2] <> ' ' THEN 'working_tree' WHEN s[1] <> ' ' THEN 'staged' WHEN value > 50 THEN 'mtime' END AS reason FROM (SELECT *, CASE event_id % 4 WHEN 0 THEN '??' WHEN 1 THEN ' M' WHEN 2 THEN 'M ' END AS s FROM events)", with_graph=False)
def f13_stale_reason(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("event_id") % 4
    return Tables(spark, d).events.select("event_id", scalars.stale_reason(F.when(m == 0, "??").when(m == 1, " M").when(m == 2, "M "), scalars.is_stale(F.col("value"), F.lit(50.0))).alias("reason"))


@_query("SELECT p_partkey FROM part WHERE p_name ILIKE '%RED_W%'", with_graph=False)
def f19_like(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).part.where(scalars.like(F.col("p_name"), "RED_W")).select("p_partkey")


# Changes


def _touched(g: Graph) -> DataFrame:
    return g.files.where("id % 5 = 0").select(F.col("id").alias("file_id"))


@_query("SELECT edge_ord, src_id, dst_id, type FROM g_edges WHERE file_id % 5 <> 0")
def u2_delete_file_edges(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    return incremental.delete_file_records({"symbols": g.symbols, "edges": g.edges, "occurrences": g.occurrences}, _touched(g))["edges"].select("edge_ord", "src_id", "dst_id", "type")


@_query("SELECT id, CASE WHEN def_file_id % 5 = 0 THEN NULL ELSE def_file_id END AS def_file_id, CASE WHEN def_file_id % 5 = 0 THEN -1 ELSE def_start_line END AS def_start_line FROM g_symbols")
def u2_delete_file_symbols(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    return incremental.delete_file_records({"symbols": g.symbols, "edges": g.edges, "occurrences": g.occurrences}, _touched(g))["symbols"].select("id", "def_file_id", "def_start_line")


@_query("SELECT src_id, dst_id, type, line FROM g_edges e WHERE NOT (type = 'contains' AND dst_id IN (SELECT id FROM g_symbols WHERE def_file_id % 5 = 0)) UNION ALL SELECT o.id, p.id, 'contains', p.def_start_line FROM g_symbols p JOIN g_symbols o ON o.scip_symbol = p.enclosing_symbol WHERE p.kind = 'field' AND p.def_file_id % 5 = 0")
def u4_scoped_contains(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    rest, again = incremental.scoped_contains_recovery(g.symbols, g.edges, _touched(g))
    columns = ["src_id", "dst_id", "type", "line"]
    return rest.select(columns).union(again.select(columns))


@_query("SELECT edge_ord, src_id, dst_id, type FROM g_edges WHERE NOT (dst_id IN (SELECT id FROM g_symbols WHERE id % 3 = 0) AND NOT EXISTS (SELECT 1 FROM g_occurrences o WHERE o.symbol_id = dst_id AND o.role & 1 = 1))")
def u5_scoped_gc(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    return incremental.scoped_gc(g.edges, g.occurrences, g.symbols.where("id % 3 = 0").select("id")).select("edge_ord", "src_id", "dst_id", "type")


@_query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-05 00:00:00'", with_graph=False)
def l10_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.files import rebuilt

    rows = Tables(spark, d).events.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("mtime"))
    return rebuilt(rows, 1704412800 * 1e6).select("event_id")
