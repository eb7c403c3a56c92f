"""A symbol index made of the driver's tables, written, read and ingested like a compiler's; the same as SQL, for the checks.

Nations are documents, customers functions with bodies, suppliers operation tables with three fields.  Orders are
references from a customer's body, line items references from an operation table's body or to its first field.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import derive
from ..schema import ITEM, OCCURRENCE, RELATIONSHIP, SYMBOL_INFO
from ..session import materialise, scope, shared_folder
from ..sources.scip import HEAD, IS_OCCURRENCE, IS_SYMBOL, read_scip, write_scip
from ..streaming import incremental
from .projection import Tables
from .store import Store, ingest

PREFIX = "scip clang c v1 "
TOUCHED = (4, 8)  # documents that the changed index has again


def _fn(k: Column) -> Column:
    return F.concat(F.lit(PREFIX + "fn_"), k.cast("string"), F.lit("()."))


def _sup(k: Column) -> Column:
    return F.concat(F.lit(PREFIX + "sup_"), k.cast("string"), F.lit("_ops#"))


def _ddl(kind) -> str:  # noqa: ANN001
    return kind.simpleString()


def _null(kind) -> Column:  # noqa: ANN001
    return F.lit(None).cast(_ddl(kind))


def _symbol(symbol: Column, display: Column | str, kind: int, docs: Column | None = None, signature: str = "", enclosing: Column | None = None, relations: Column | None = None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    none = F.array().cast(f"array<{_ddl(RELATIONSHIP)}>")
    parts = {"symbol": symbol, "display_name": lit(display), "kind": F.lit(kind), "documentation": docs if docs is not None else F.array().cast("array<string>"), "signature": F.lit(signature), "enclosing_symbol": enclosing if enclosing is not None else F.lit(""), "relationships": relations if relations is not None else none}
    return F.struct(*(c.alias(k) for k, c in parts.items())).cast(_ddl(SYMBOL_INFO))


def _relation(symbol: Column, which: str) -> Column:
    flags = [F.lit(k == which).alias(k) for k in ("is_reference", "is_implementation", "is_type_definition", "is_definition")]
    return F.array(F.struct(symbol.alias("symbol"), *flags))


def _occurrence(symbol: Column, role: int, line: Column, form: Column, body: Column | None = None, multi: Column | None = None) -> Column:
    """form: 0 three numbers, 1 four, 2 single line, 3 multi line; body: four numbers, multi: as a message, either may be null."""
    i = lambda *x: F.array(*(v.cast("int") if isinstance(v, Column) else F.lit(v) for v in x))
    lines = lambda sl, el, ec: F.struct(sl.cast("int").alias("sl"), F.lit(4).alias("sc"), el.cast("int").alias("el"), F.lit(ec).alias("ec"))
    none = F.array().cast("array<int>")
    by = dict(zip(OCCURRENCE.names, (f.dataType for f in OCCURRENCE), strict=True))
    parts = {
        "symbol": symbol,
        "symbol_roles": F.lit(role),
        "single_line": F.when(form == 2, F.struct(line.cast("int").alias("line"), F.lit(4).alias("sc"), F.lit(20).alias("ec"))),
        "multi_line": F.when(form == 3, lines(line, line, 20)),
        "range": F.when(form == 0, i(line, 4, 20)).when(form == 1, i(line, 4, line, 20)).otherwise(none),
        "single_line_enclosing": _null(by["single_line_enclosing"]),
        "multi_line_enclosing": multi if multi is not None else _null(by["multi_line_enclosing"]),
        "enclosing_range": F.coalesce(body, none) if body is not None else none,
    }
    return F.struct(*(c.alias(k) for k, c in parts.items())).cast(_ddl(OCCURRENCE))


def index_items(t: Tables, moved: bool = False) -> DataFrame:
    """Rows of the item schema.  moved: only the TOUCHED documents, whose functions of odd keys are gone and the others five lines down."""
    n = t.customer.count()
    docs = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    language = F.when(F.col("n_nationkey") % 3 == 0, "CPP").when(F.col("n_nationkey") % 3 == 1, "C").otherwise("Rust")
    docs = docs.select((F.col("n_nationkey") + 1).alias("doc_ord"), F.concat(F.lower("r_name"), F.lit("/"), F.replace(F.lower("n_name"), F.lit(" "), F.lit("_")), F.lit(".c")).alias("relative_path"), language.alias("language"))
    place = lambda key: (F.row_number().over(Window.partitionBy("doc_ord").orderBy(key)) - 1).cast("long")
    fn = t.customer.select(F.col("c_custkey").alias("k"), (F.col("c_nationkey") + 1).alias("doc_ord"), "c_name", "c_mktsegment").withColumn("l", 20 * place("k"))
    sup = t.supplier.select(F.col("s_suppkey").alias("k"), (F.col("s_nationkey") + 1).alias("doc_ord")).withColumn("b", 100_000 + 100 * place("k"))
    if moved:
        docs, sup = docs.where(F.col("doc_ord").isin(*TOUCHED)), sup.where(F.col("doc_ord").isin(*TOUCHED))
        fn = fn.where(F.col("doc_ord").isin(*TOUCHED) & (F.col("k") % 2 == 0)).withColumn("l", F.col("l") + 5)
    k = F.col("k")
    field = lambda j: F.concat(_sup(k), F.lit(f"f{j}."))
    row = lambda g, k1, k2, x: ["doc_ord", F.lit(g).alias("g"), k1.cast("long").alias("k1"), (k2 if isinstance(k2, Column) else F.lit(k2)).cast("long").alias("k2"), x.alias("x")]
    symbols = [
        fn.select(*row(0, k, 0, _symbol(_fn(k), F.col("c_name"), 17, F.array("c_mktsegment"), "int fn(void)"))),
        sup.select(*row(1, k, 0, _symbol(_sup(k), F.concat(F.lit("sup_"), k.cast("string"), F.lit("_ops")), 49, relations=_relation(_sup(k + 1), "is_implementation")))),
        *(sup.select(*row(1, k, j, _symbol(field(j), "", 0, enclosing=_sup(k) if j == 1 else None, relations=None if not which else _relation(_fn(k), which)))) for j, which in ((1, "is_type_definition"), (2, "is_definition"), (3, ""))),
        docs.select(*row(2, F.lit(0), 0, _symbol(F.lit("local 1"), "", 0))),
    ]
    four = F.col("k1") % 4
    c = fn.withColumn("k1", k)
    body = F.when(k % 3 == 0, F.array(F.col("l").cast("int"), F.lit(0), (F.col("l") + 18).cast("int"), F.lit(1)))
    multi = F.when(k % 3 == 1, F.struct(F.col("l").cast("int").alias("sl"), F.lit(0).alias("sc"), (F.col("l") + 18).cast("int").alias("el"), F.lit(1).alias("ec")))
    s = sup.withColumn("k1", k)
    span = lambda low, high: F.array((F.col("b") + low).cast("int"), F.lit(0), (F.col("b") + high).cast("int"), F.lit(1))
    orders = t.orders.join(fn.select(F.col("k").alias("o_custkey"), "doc_ord", "l"), "o_custkey").withColumn("k1", F.col("o_orderkey"))
    target = lambda key: _fn(F.col(key) % n + 1)
    binds = t.lineitem.where("l_linenumber = 1").join(sup.select(F.col("k").alias("l_suppkey"), "doc_ord", "b"), "l_suppkey").withColumn("k1", F.col("l_orderkey"))
    uses = t.lineitem.where("l_linenumber = 2").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "doc_ord", "l"), "l_orderkey").withColumn("k1", F.col("l_orderkey"))
    item = F.col("l_partkey") * 1_000_000_000 + F.col("l_suppkey") * 100 + F.col("l_quantity").cast("long")  # line numbers repeat within orders
    occurrences = [
        c.select(*row(0, k, 0, _occurrence(_fn(k), 1, F.col("l"), four, body, multi))),
        s.select(*row(1, k, 0, _occurrence(_sup(k), 1, F.col("b"), four, span(0, 60)))),
        *(s.select(*row(1, k, j, _occurrence(field(j), 1, F.col("b") + j, four, span(-1, 70) if j == 3 else None))) for j in (1, 2, 3)),
        orders.select(*row(2, F.col("k1"), 0, _occurrence(target("o_orderkey"), 8, F.col("l") + F.col("o_orderkey") % 25, four))),
        binds.select(*row(3, F.col("k1"), item, _occurrence(target("l_partkey"), 8, F.col("b") + 10 + F.col("l_partkey") % 50, four))),
        uses.select(*row(4, F.col("k1"), item, _occurrence(F.concat(_sup(F.col("l_suppkey")), F.lit("f1.")), 8, F.col("l") + F.col("l_quantity").cast("long") % 18, four))),
    ]

    def items(rows: list[DataFrame], part: str, what: int, into: str) -> DataFrame:
        values = {"part": F.lit(part), "what": F.lit(what), into: F.col("x")}
        every = reduce(DataFrame.union, rows)
        have = every.columns
        return every.select(*(values.get(f.name, F.col(f.name) if f.name in have else _null(f.dataType)).cast(_ddl(f.dataType)).alias(f.name) for f in ITEM))

    heads = items([docs.select(*row(0, F.lit(0), 0, F.lit(None)), "relative_path", "language")], "document", HEAD, "")
    meta = F.struct(F.lit("/kernel").alias("project_root"), F.lit("tables").alias("tool_name"), F.lit("1").alias("tool_version"), F.array(F.lit("-a"), F.lit("b")).alias("tool_arguments"))
    one = items([t.spark.range(1).select(F.lit(0).cast("long").alias("doc_ord"), F.lit(0).alias("g"), F.col("id").alias("k1"), F.col("id").alias("k2"), meta.alias("x"))], "metadata", HEAD, "metadata")
    every = one.union(heads).union(items(symbols, "document", IS_SYMBOL, "symbol")).union(items(occurrences, "document", IS_OCCURRENCE, "occurrence"))
    if moved:
        return every
    outside = t.region.select("r_regionkey", _symbol(F.concat(F.lit(PREFIX + "ext_"), F.col("r_regionkey").cast("string"), F.lit("().")), "", 17).alias("x"))
    last = t.nation.agg((F.max("n_nationkey") + 2).cast("long").alias("doc_ord"))
    outside = outside.crossJoin(F.broadcast(last)).select(*row(0, F.col("r_regionkey"), 0, F.col("x")))  # by one row
    return every.union(items([outside], "external", IS_SYMBOL, "symbol"))


_files: dict[tuple[str, str, bool], str] = {}
_stores: dict[tuple[str, str, bool], Store] = {}


def index(spark: SparkSession, sf_dir: str, moved: bool = False, only: str = "") -> DataFrame:
    """The written index, read again; only: as for the data source."""
    key = (spark.sparkContext.applicationId, sf_dir, moved)
    if key not in _files:
        shared_folder(spark)
        base = shared_folder(spark).removeprefix("file:")
        folder = os.path.join(base if os.path.isdir(base) else tempfile.mkdtemp(prefix="graphloom-"), "graphloom")
        os.makedirs(folder, exist_ok=True)
        path = os.path.join(folder, f"tables-{uuid.uuid4().hex}.scip")
        with scope(spark):
            write_scip(index_items(Tables(spark, sf_dir), moved), path)
        _files[key] = path
    return read_scip(spark, _files[key], only=only)


def store(spark: SparkSession, sf_dir: str, moved: bool = False) -> Store:
    """The ingested index; moved: after the changed documents have been applied to it."""
    key = (spark.sparkContext.applicationId, sf_dir, moved)
    if key not in _stores:
        index(spark, sf_dir)
        root = f"{shared_folder(spark)}/graphloom/scip-{uuid.uuid4().hex}"
        made = ingest(spark, _files[key[0], sf_dir, False], root, now=1_700_000_000)
        if moved:
            incremental.ingest_incremental(made, index(spark, sf_dir, True))
        _stores[key] = made
    return _stores[key]


_derived: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def derived(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Symbol informations and occurrences of the index, stored once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _derived:
        part = lambda only: index(spark, sf_dir, only=only)
        _derived[key] = materialise(derive.symbol_infos(part("symbols")), "infos"), materialise(derive.occurrence_rows(part("occurrences")), "occurrences")
    return _derived[key]


def named_edges(s: Store) -> DataFrame:
    """(src, dst, type, path, line, metadata) of the stored edges."""
    g = s.graph()
    names = g.symbols.select("id", "scip_symbol")
    rows = g.edges.join(names.withColumnsRenamed({"id": "src_id", "scip_symbol": "src"}), "src_id").join(names.withColumnsRenamed({"id": "dst_id", "scip_symbol": "dst"}), "dst_id")
    return rows.join(g.files.select(F.col("id").alias("file_id"), "path"), "file_id", "left").select("src", "dst", "type", "path", "line", "metadata")


def _index_sql(p: str, moved: bool) -> str:
    """The index as tables of prefix p: infos and occurrences with their places in their documents, ranges, enclosers, raw edges."""
    here = f"WHERE doc_ord IN {TOUCHED}" if moved else ""
    even = f"WHERE doc_ord IN {TOUCHED} AND k % 2 = 0" if moved else ""
    shift = " + 5" if moved else ""
    outside = "" if moved else f"UNION ALL SELECT (SELECT max(n_nationkey) + 2 FROM nation), 0, r_regionkey, 0, '{PREFIX}ext_' || r_regionkey || '().', 'ext_' || r_regionkey, 'function', '', '', NULL, true FROM region"
    sup = lambda k: f"'{PREFIX}sup_' || {k} || '_ops#'"
    fn = lambda k: f"'{PREFIX}fn_' || {k} || '().'"
    return f"""
{p}docs AS (SELECT * FROM (SELECT n_nationkey + 1 AS doc_ord, lower(r_name) || '/' || replace(lower(n_name), ' ', '_') || '.c' AS path, CASE n_nationkey % 3 WHEN 0 THEN 'C' WHEN 1 THEN 'C' ELSE 'Rust' END AS language FROM nation JOIN region ON n_regionkey = r_regionkey) {here}),
{p}fn AS (SELECT k, doc_ord, c_name, c_mktsegment, l{shift} AS l FROM (SELECT c_custkey AS k, c_nationkey + 1 AS doc_ord, c_name, c_mktsegment, 20 * (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) AS l FROM customer) {even}),
{p}sup AS (SELECT * FROM (SELECT s_suppkey AS k, s_nationkey + 1 AS doc_ord, 100000 + 100 * (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) AS b FROM supplier) {here}),
{p}j AS (SELECT unnest([1, 2, 3]) AS j),
{p}infos AS (SELECT *, row_number() OVER (PARTITION BY doc_ord ORDER BY g, k1, k2) - 1 AS sym_ord FROM (
    SELECT doc_ord, 0 AS g, k AS k1, 0 AS k2, {fn("k")} AS symbol, c_name AS name, 'function' AS kind, 'int fn(void)' AS signature, c_mktsegment AS documentation, NULL::VARCHAR AS enclosing, false AS ext FROM {p}fn
    UNION ALL SELECT doc_ord, 1, k, 0, {sup("k")}, 'sup_' || k || '_ops', 'struct', '', '', NULL, false FROM {p}sup
    UNION ALL SELECT doc_ord, 1, k, j, {sup("k")} || 'f' || j || '.', 'f' || j, 'field', '', '', {sup("k")}, false FROM {p}sup, {p}j
    UNION ALL SELECT doc_ord, 2, 0, 0, 'local 1', '1', 'variable', '', '', NULL, false FROM {p}docs
    {outside})),
{p}occs AS (SELECT *, row_number() OVER (PARTITION BY doc_ord ORDER BY g, k1, k2) - 1 AS occ_ord FROM (
    SELECT doc_ord, 0 AS g, k AS k1, 0 AS k2, {fn("k")} AS symbol, 1 AS role, l AS sl, l AS body_start, CASE WHEN k % 3 = 2 THEN l ELSE l + 18 END AS body_end FROM {p}fn
    UNION ALL SELECT doc_ord, 1, k, 0, {sup("k")}, 1, b, b, b + 60 FROM {p}sup
    UNION ALL SELECT doc_ord, 1, k, j, {sup("k")} || 'f' || j || '.', 1, b + j, CASE j WHEN 3 THEN b - 1 ELSE b + j END, CASE j WHEN 3 THEN b + 70 ELSE b + j END FROM {p}sup, {p}j
    UNION ALL SELECT doc_ord, 2, o_orderkey, 0, {fn("(o_orderkey % (SELECT count(*) FROM customer) + 1)")}, 8, l + o_orderkey % 25, l + o_orderkey % 25, l + o_orderkey % 25 FROM orders JOIN {p}fn ON k = o_custkey
    UNION ALL SELECT doc_ord, 3, l_orderkey, l_partkey * 1000000000 + l_suppkey * 100 + l_quantity::BIGINT, {fn("(l_partkey % (SELECT count(*) FROM customer) + 1)")}, 8, b + 10 + l_partkey % 50, b + 10 + l_partkey % 50, b + 10 + l_partkey % 50 FROM lineitem JOIN {p}sup ON k = l_suppkey WHERE l_linenumber = 1
    UNION ALL SELECT doc_ord, 4, l_orderkey, l_partkey * 1000000000 + l_suppkey * 100 + l_quantity::BIGINT, {sup("l_suppkey")} || 'f1.', 8, l + l_quantity::BIGINT % 18, l + l_quantity::BIGINT % 18, l + l_quantity::BIGINT % 18 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN {p}fn ON k = o_custkey WHERE l_linenumber = 2)),
{p}ranges AS (SELECT doc_ord, body_start AS s, body_end AS e, symbol FROM {p}occs WHERE role = 1),
{p}held AS (SELECT o.doc_ord, o.occ_ord, o.symbol, o.sl, max(row(r.s, r.e, 4, r.symbol)) AS m FROM {p}occs o JOIN {p}ranges r ON r.doc_ord = o.doc_ord AND r.s <= o.sl AND o.sl <= r.e WHERE role = 8 GROUP BY ALL),
{p}refs AS (SELECT h.doc_ord, h.occ_ord, m[4] AS src, h.symbol AS dst, h.sl AS line, coalesce(i.name, regexp_extract(h.symbol, '(fn_[0-9]+)', 1)) AS name FROM {p}held h LEFT JOIN {p}infos i ON i.doc_ord = h.doc_ord AND i.symbol = h.symbol),
{p}step1 AS (SELECT doc_ord, occ_ord, 0 AS part, src, dst, CASE WHEN dst LIKE '%().' THEN 'calls' ELSE 'references' END AS type, line, NULL::VARCHAR AS metadata FROM {p}refs
    UNION ALL SELECT doc_ord, occ_ord, 1, src, dst, 'ops_bind', line, '{{"field_name": "' || name || '", "inferred_field": true}}' FROM {p}refs WHERE src LIKE '%\\_ops#' ESCAPE '\\' AND dst LIKE '%().'),
{p}step2 AS (SELECT doc_ord, {sup("k")} AS src, {sup("(k + 1)")} AS dst, 'implements' AS type FROM {p}sup
    UNION ALL SELECT doc_ord, {sup("k")} || 'f1.', {fn("k")}, 'type_of' FROM {p}sup UNION ALL SELECT doc_ord, {sup("k")} || 'f2.', {fn("k")}, 'defines' FROM {p}sup),
{p}step3 AS (SELECT i.doc_ord, i.enclosing AS src, i.symbol AS dst, o.body_start AS line FROM {p}infos i JOIN {p}occs o ON o.doc_ord = i.doc_ord AND o.symbol = i.symbol AND o.role = 1 WHERE i.kind = 'field'),
{p}step4 AS (SELECT doc_ord, {sup("k")} AS src, {sup("k")} || 'f3.' AS dst, b + 3 AS line FROM {p}sup),
{p}raw AS (SELECT doc_ord, src, dst, type, doc_ord AS file, line, metadata FROM {p}step1 UNION ALL SELECT doc_ord, src, dst, type, NULL, -1, NULL FROM {p}step2
    UNION ALL SELECT doc_ord, src, dst, 'contains', doc_ord, line, NULL FROM {p}step3 UNION ALL SELECT doc_ord, src, dst, 'contains', doc_ord, line, NULL FROM {p}step4)"""


SQL = f"""
WITH {_index_sql("x_", False)},
x_files AS (SELECT 1 AS id, '' AS path, '' AS language UNION ALL SELECT doc_ord + 1, path, language FROM x_docs),
x_lines AS (SELECT doc_ord, symbol, body_start, body_end FROM x_occs WHERE role = 1),
x_symbols AS (SELECT row_number() OVER (ORDER BY i.doc_ord, sym_ord) AS id, i.symbol AS scip_symbol, name, kind, signature, documentation, CASE WHEN NOT ext THEN i.doc_ord + 1 END AS def_file_id,
    coalesce(body_start, -1)::INT AS def_start_line, coalesce(body_end, -1)::INT AS def_end_line, ext AS is_external, enclosing AS enclosing_symbol, i.doc_ord AS first_doc
    FROM (SELECT * FROM x_infos QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY doc_ord, sym_ord) = 1) i LEFT JOIN x_lines l ON l.doc_ord = i.doc_ord AND l.symbol = i.symbol),
x_occurrences AS (SELECT row_number() OVER (ORDER BY o.doc_ord, o.occ_ord) AS id, s.id AS symbol_id, o.doc_ord + 1 AS file_id, o.sl::INT AS start_line, 4 AS start_col, o.sl::INT AS end_line, 20 AS end_col, o.role, e.id AS enclosing_symbol_id
    FROM x_occs o JOIN x_symbols s ON s.scip_symbol = o.symbol AND s.first_doc <= o.doc_ord LEFT JOIN x_held h ON h.doc_ord = o.doc_ord AND h.occ_ord = o.occ_ord LEFT JOIN x_symbols e ON e.scip_symbol = h.m[4] AND e.first_doc <= o.doc_ord),
x_edges AS (SELECT DISTINCT r.src, r.dst, r.type, d.path, r.line::INT AS line, r.metadata, r.file FROM x_raw r JOIN x_symbols a ON a.scip_symbol = r.src AND a.first_doc <= r.doc_ord JOIN x_symbols b ON b.scip_symbol = r.dst AND b.first_doc <= r.doc_ord LEFT JOIN x_docs d ON d.doc_ord = r.file)
"""

#: The edges after the change: of the touched documents those of the new index, to any known symbol; none to what nothing defines any more.
CHANGED = f"""WITH {_index_sql("y_", True)},
y_edges AS (SELECT DISTINCT r.src, r.dst, r.type, d.path, r.line::INT AS line, r.metadata FROM y_raw r JOIN x_symbols a ON a.scip_symbol = r.src JOIN x_symbols b ON b.scip_symbol = r.dst LEFT JOIN x_docs d ON d.doc_ord = r.file),
old AS (SELECT e.src, e.dst, e.type, e.path, e.line, e.metadata FROM x_edges e JOIN x_symbols s ON s.scip_symbol = e.src WHERE coalesce(e.file, s.def_file_id - 1) NOT IN {TOUCHED}),
dead AS (SELECT scip_symbol FROM x_symbols WHERE def_file_id - 1 IN {TOUCHED} AND scip_symbol NOT IN (SELECT symbol FROM y_occs WHERE role = 1) AND scip_symbol NOT IN (SELECT symbol FROM x_occs WHERE role = 1 AND doc_ord NOT IN {TOUCHED}))
SELECT * FROM (SELECT * FROM old UNION ALL SELECT * FROM y_edges) WHERE dst NOT IN (SELECT scip_symbol FROM dead)"""
