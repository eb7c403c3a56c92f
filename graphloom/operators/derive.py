"""From index documents to the tables of a code graph.

Everything is keyed by ``doc_ord``; what belongs to one document is joined on it.  Which definition
encloses a reference is an interval join: definition ranges are spread over buckets of ``BUCKET`` lines, so
the join is an equi-join on (document, bucket) with the bounds as a residual, and the innermost
range is one maximum per reference.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_definition, is_ops_table, kind_of_number, language, ops_metadata
from ..functions.symbols import parse_symbol
from ..plans.ordinals import numbered
from ..schema import DEFAULT_KIND
from ..session import materialise

BUCKET = 64


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


def first_range(single: str, multi: str, short: str) -> Column:
    """struct(sl, sc, el, ec): of the single-line form, the multi-line form, three numbers or four; -1 where there is none."""
    s, m, r = F.col(single), F.col(multi), F.col(short)
    n = F.size(r)

    def four(*parts: Column) -> Column:
        return F.struct(*(p.cast("int").alias(k) for p, k in zip(parts, ("sl", "sc", "el", "ec"), strict=True)))

    at = lambda i: F.get(r, F.lit(i))
    none = F.lit(-1)
    return (
        F.when(s.isNotNull(), four(s["line"], s["sc"], s["line"], s["ec"]))
        .when(m.isNotNull(), four(m["sl"], m["sc"], m["el"], m["ec"]))
        .when(n == 3, four(at(0), at(1), at(0), at(2)))
        .when(n == 4, four(at(0), at(1), at(2), at(3)))
        .otherwise(four(none, none, none, none))
    )


def metadata_rows(index: DataFrame) -> DataFrame:
    """(key, value) rows of the index's metadata; of repeated keys the last counts."""
    m = F.col("metadata")
    rows = index.where("part = 'metadata'").select(
        F.explode(
            F.array(
                F.struct(F.lit("project_root").alias("key"), _filled(m["project_root"]).alias("value")),
                F.struct(F.lit("tool_name").alias("key"), m["tool_name"].alias("value")),
                F.struct(F.lit("tool_version").alias("key"), m["tool_version"].alias("value")),
                F.struct(F.lit("tool_arguments").alias("key"), F.when(F.size(m["tool_arguments"]) > 0, F.array_join(m["tool_arguments"], " ")).alias("value")),
            )
        ).alias("x"),
        "doc_ord",
    )
    return rows.where("x.value is not null").groupBy("x.key").agg(F.max_by("x.value", "doc_ord").alias("value")).select("key", "value")


def symbol_infos(index: DataFrame, qualify_locals: bool = False) -> DataFrame:
    """A row per symbol information: doc_ord, sym_ord and the projected attributes.

    Kind: the index's number, else what the descriptors say; a global variable within a type is a field.
    External symbols are neither refined nor enclosed.
    """
    rows = index.select("doc_ord", "part", "relative_path", "first", F.posexplode("symbols").alias("sym_ord", "s"))
    rows = rows.select("doc_ord", "part", F.col("relative_path").alias("path"), (F.coalesce("first", F.lit(0)) + F.col("sym_ord")).alias("sym_ord"), "s.*")
    rows = rows.withColumn("p", parse_symbol(F.col("symbol")))
    inner = F.col("part") == "document"
    kind = F.coalesce(kind_of_number(F.col("kind")), F.col("p.kind"), F.lit(DEFAULT_KIND))
    size = F.size("p.descriptors")
    parent = F.try_element_at(F.col("p.descriptors"), F.lit(-2))["suffix"]
    refined = F.when(inner & (kind == "global_var") & (size >= 2) & (parent == "#"), "field").otherwise(kind)
    rows = rows.select(
        "doc_ord",
        "sym_ord",
        "path",
        _qualified("symbol", qualify_locals).alias("scip_symbol"),
        F.coalesce(_filled(F.col("display_name")), F.col("p.short_name"), F.lit("")).alias("name"),
        refined.alias("kind"),
        F.col("signature"),
        F.array_join("documentation", "\n").alias("documentation"),
        F.when(inner, F.coalesce(_filled(F.col("enclosing_symbol")), _filled(F.col("p.enclosing_symbol")))).alias("enclosing_symbol"),
        (~inner).alias("is_external"),
        "relationships",
    )
    return rows.where("scip_symbol != ''")


def _qualified(symbol: str, qualify: bool) -> Column:
    c = F.col(symbol)
    return F.when(F.startswith(c, F.lit("local ")), F.concat(F.lit("local "), F.col("path"), F.lit(":"), F.substring(c, 7, 1 << 30))).otherwise(c) if qualify else c


def occurrence_rows(index: DataFrame, qualify_locals: bool = False) -> DataFrame:
    """A row per occurrence: doc_ord, occ_ord, symbol, role, its range and, for definitions, the range that they enclose."""
    rows = index.where("part = 'document'").select("doc_ord", F.col("relative_path").alias("path"), F.coalesce("first", F.lit(0)).alias("first"), F.posexplode("occurrences").alias("at", "o")).select("doc_ord", "path", (F.col("first") + F.col("at")).alias("occ_ord"), "o.*")
    rows = rows.withColumns({"r": first_range("single_line", "multi_line", "range"), "e": first_range("single_line_enclosing", "multi_line_enclosing", "enclosing_range")})
    own = F.col("e.sl").isNotNull() & (F.col("e.sl") >= 0) & (F.col("e.el") >= F.col("e.sl"))
    return rows.select(
        "doc_ord",
        "occ_ord",
        "path",
        _qualified("symbol", qualify_locals).alias("symbol"),
        F.col("symbol_roles").alias("role"),
        "r.*",
        F.when(own, F.col("e.sl")).otherwise(F.col("r.sl")).alias("body_start"),
        F.when(own, F.col("e.el")).otherwise(F.col("r.el")).alias("body_end"),
    )


def definition_ranges(occurrences: DataFrame) -> DataFrame:
    """(doc_ord, start, end, col, symbol) of each definition with a known place."""
    return occurrences.where(is_definition(F.col("role")) & (F.col("sl") >= 0)).select("doc_ord", F.col("body_start").alias("start"), F.col("body_end").alias("end"), F.col("sc").alias("col"), "symbol")


def enclosing(points: DataFrame, ranges: DataFrame, doc: str = "doc_ord", line: str = "line", bucket: int = BUCKET, other_than: str | None = None) -> DataFrame:
    """points with ``encloser``: of the document's ranges [start, end] that hold the point's line, the symbol of the greatest (start, end, col, symbol).

    points must have a unique ``point`` column; those in no range, or at an unknown line, keep null.
    other_than: a column of points whose own symbol does not enclose it.
    Ranges are spread up to the last line that is asked for in their document, however far they claim to go.
    """
    last = points.where(F.col(line) >= 0).groupBy(F.col(doc).alias("__doc")).agg(F.max(line).alias("__last"))
    asked = ranges.select(F.col(doc).alias("__doc"), "start", "end", "col", "symbol").join(last, "__doc").where("start <= __last and start <= end")
    spread = asked.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.least("end", "__last") / bucket)))).drop("__last")
    at = points.where(F.col(line) >= 0).select("point", F.col(doc).alias("__doc"), F.col(line).alias("__line"), F.floor(F.col(line) / bucket).alias("__bucket"), *([F.col(other_than).alias("__self")] if other_than else []))
    held = at.join(spread, ["__doc", "__bucket"]).where("start <= __line and __line <= end")
    if other_than:
        held = held.where("symbol != __self")
    best = held.groupBy("point").agg(F.max(F.struct("start", "end", "col", "symbol"))["symbol"].alias("encloser"))
    return points.join(best, "point", "left")


def _local_kinds(infos: DataFrame) -> DataFrame:
    """Kind and name of each symbol within its document; of repeated ones the last counts."""
    return infos.where("not is_external").groupBy("doc_ord", "scip_symbol").agg(F.max_by(F.struct("kind", "name"), "sym_ord").alias("known"))


def reference_edges(occurrences: DataFrame, infos: DataFrame) -> DataFrame:
    """calls, macro_expands and references of each enclosed reference, and ops_bind of functions within operation tables.

    Columns doc_ord, step, ord, part: the order in which a document gives its edges.
    """
    known = _local_kinds(infos)
    # each distinct symbol is parsed once; enclosing ones are symbols of definitions
    parsed = occurrences.select("symbol").distinct().withColumn("p", parse_symbol(F.col("symbol")))
    parsed = materialise(parsed.select("symbol", F.col("p.kind").alias("p_kind"), F.col("p.short_name").alias("p_name")), "parsed")

    def with_known(df: DataFrame, symbol: str, prefix: str) -> DataFrame:
        side = known.select(F.col("doc_ord"), F.col("scip_symbol").alias(symbol), F.col("known").alias("__k"))
        out = df.join(side, ["doc_ord", symbol], "left").join(parsed.withColumnRenamed("symbol", symbol), symbol, "left")
        kind = F.coalesce(F.col("__k.kind"), F.col("p_kind"), F.lit(DEFAULT_KIND))
        name = F.coalesce(F.col("__k.name"), _filled(F.col("p_name")), F.col(symbol))
        return out.withColumns({f"{prefix}_kind": kind, f"{prefix}_name": name}).drop("__k", "p_kind", "p_name")

    points = occurrences.where(~is_definition(F.col("role"))).select(F.struct("doc_ord", "occ_ord").alias("point"), "doc_ord", "occ_ord", "path", "symbol", F.col("sl").alias("line"))
    held = enclosing(points, definition_ranges(occurrences)).where("encloser is not null").drop("point")
    held = with_known(with_known(held, "symbol", "to"), "encloser", "from")
    kind = F.when(F.col("to_kind").isin("function", "method"), "calls").when(F.col("to_kind") == "macro", "macro_expands").otherwise("references")
    bind = F.col("from_kind").isin("struct", "global_var") & is_ops_table(F.col("from_name")) & F.col("to_kind").isin("function", "method")
    both = F.array(F.struct(F.lit(0).alias("part"), kind.alias("type"), F.lit(None).cast("string").alias("metadata")), F.when(bind, F.struct(F.lit(1).alias("part"), F.lit("ops_bind").alias("type"), ops_metadata(F.col("to_name")).alias("metadata"))))
    rows = held.select("doc_ord", F.col("occ_ord").alias("ord"), F.col("encloser").alias("src"), F.col("symbol").alias("dst"), "path", "line", F.explode(F.array_compact(both)).alias("e"))
    return rows.select("doc_ord", F.lit(1).alias("step"), "ord", "e.part", "src", "dst", "e.type", "path", "line", "e.metadata")


def relationship_edges(infos: DataFrame) -> DataFrame:
    """type_of, implements and defines of each relationship; without a file or line."""
    rel = infos.where("not is_external").select("doc_ord", F.col("sym_ord").alias("ord"), F.col("scip_symbol").alias("src"), F.posexplode("relationships").alias("r_ord", "r"))
    kinds = F.array_compact(F.array(F.when(F.col("r.is_type_definition"), "type_of"), F.when(F.col("r.is_implementation"), "implements"), F.when(F.col("r.is_definition"), "defines")))
    rows = rel.select("doc_ord", "ord", "r_ord", "src", F.col("r.symbol").alias("dst"), F.posexplode(kinds).alias("k", "type"))
    return rows.select("doc_ord", F.lit(2).alias("step"), "ord", (F.col("r_ord") * 3 + F.col("k")).alias("part"), "src", "dst", "type", F.lit("").alias("path"), F.lit(-1).alias("line"), F.lit(None).cast("string").alias("metadata"))


def contains_edges(occurrences: DataFrame, infos: DataFrame) -> DataFrame:
    """contains by the enclosing symbol's name, and by the place of a field's definition, each within the document."""
    inner = infos.where("not is_external")
    lines = definition_lines(occurrences, infos)
    known = inner.select("doc_ord", F.col("scip_symbol").alias("enclosing_symbol")).distinct()
    named = inner.join(known, ["doc_ord", "enclosing_symbol"], "left_semi").join(lines, ["doc_ord", "sym_ord"], "left")
    # only the last of a document's repeated symbols has the lines
    named = named.select("doc_ord", F.lit(3).alias("step"), F.col("sym_ord").alias("ord"), F.lit(0).alias("part"), F.col("enclosing_symbol").alias("src"), F.col("scip_symbol").alias("dst"), F.lit("contains").alias("type"), "path", F.coalesce("start", F.lit(-1)).alias("line"), F.lit(None).cast("string").alias("metadata"))
    fields = _local_kinds(infos).where("known.kind = 'field'").select("doc_ord", F.col("scip_symbol").alias("symbol"))
    points = occurrences.where(is_definition(F.col("role"))).join(fields, ["doc_ord", "symbol"], "left_semi").select(F.struct("doc_ord", "occ_ord").alias("point"), "doc_ord", F.col("occ_ord").alias("ord"), "path", "symbol", F.col("sl").alias("line"))
    placed = enclosing(points, definition_ranges(occurrences)).where("encloser is not null and encloser != symbol")
    placed = placed.select("doc_ord", F.lit(4).alias("step"), "ord", F.lit(0).alias("part"), F.col("encloser").alias("src"), F.col("symbol").alias("dst"), F.lit("contains").alias("type"), "path", "line", F.lit(None).cast("string").alias("metadata"))
    return named.unionByName(placed)


def definition_lines(occurrences: DataFrame, infos: DataFrame) -> DataFrame:
    """(doc_ord, sym_ord, start, end): the last definition's lines, for the last information of each symbol in its document."""
    last = infos.where("not is_external").groupBy("doc_ord", "scip_symbol").agg(F.max("sym_ord").alias("sym_ord"))
    rows = occurrences.where(is_definition(F.col("role")) & (F.col("sl") >= 0)).groupBy("doc_ord", F.col("symbol").alias("scip_symbol")).agg(F.max_by(F.struct(F.col("body_start").alias("start"), F.col("body_end").alias("end")), "occ_ord").alias("lines"))
    return last.join(rows, ["doc_ord", "scip_symbol"]).select("doc_ord", "sym_ord", "lines.start", "lines.end")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order: one minimum per key, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__first"))
    return best.select(*keys, "__first.*").select(df.columns)


def upsert_symbols(infos: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per symbol: the attributes of its first information, wherever that is; and first_doc, from which on it is known."""
    rows = infos.join(lines, ["doc_ord", "sym_ord"], "left")
    rows = rows.select("scip_symbol", "doc_ord", "sym_ord", "path", "name", "kind", "signature", "documentation", "is_external", "enclosing_symbol", F.coalesce("start", F.lit(-1)).alias("def_start_line"), F.coalesce("end", F.lit(-1)).alias("def_end_line"))
    return keep_first(rows, ["scip_symbol"], ["doc_ord", "sym_ord"]).withColumnsRenamed({"doc_ord": "first_doc"})


def dedupe_edges(edges: DataFrame, dedupe_null_file: bool = False) -> DataFrame:
    """The first edge of each (src_id, dst_id, type, file_id, line); edges without a file are all kept unless asked otherwise."""
    keys, order = ["src_id", "dst_id", "type", "file_id", "line"], ["doc_ord", "step", "ord", "part"]
    if dedupe_null_file:
        return keep_first(edges, keys, order)
    return keep_first(edges.where("file_id is not null"), keys, order).unionByName(edges.where("file_id is null"))


def build(index: DataFrame | Callable[[str], DataFrame], resolve: str = "ordered", qualify_locals: bool = False, dedupe_null_file: bool = False) -> dict[str, DataFrame]:
    """files, symbols, occurrences, edges and meta of an index.

    index: its rows, or a function that gives those of only its heads, symbols or occurrences, so that none is decoded twice.
    resolve: ``ordered`` drops what names a symbol that only a later document brings, as one pass over the file
    would; ``global`` keeps it.
    """
    part = index if callable(index) else lambda _: index
    infos = materialise(symbol_infos(part("symbols"), qualify_locals), "infos")
    occs = materialise(occurrence_rows(part("occurrences"), qualify_locals), "occurrences")
    index = materialise(part("heads").select("doc_ord", "part", "relative_path", "language", "metadata"), "heads")

    # metadata and external symbols count as a file without a path
    paths = index.groupBy(F.col("relative_path").alias("path")).agg(F.min_by(F.struct("doc_ord", "language"), "doc_ord").alias("f"))
    files = numbered(paths.select("path", language(F.col("f.language")).alias("language"), F.col("f.doc_ord").alias("o")), ["o", "path"], "id").select("id", "path", "language", F.lit(None).cast("string").alias("subsystem"), F.lit(None).cast("string").alias("sha"))
    file_ids = files.select(F.col("id").alias("file_id"), "path")

    firsts = numbered(upsert_symbols(infos, definition_lines(occs, infos)), ["first_doc", "sym_ord"], "id")
    with_file = firsts.join(file_ids.where("path != ''"), "path", "left")
    symbols = with_file.select("id", "scip_symbol", "name", "kind", "signature", "documentation", F.when(~F.col("is_external"), F.col("file_id")).alias("def_file_id"), "def_start_line", "def_end_line", "is_external", F.lit(None).cast("string").alias("subsystem"), "enclosing_symbol", "first_doc")
    symbols = materialise(symbols, "symbols")

    known = symbols.select(F.col("id").alias("kid"), "scip_symbol", "first_doc")

    def resolved(df: DataFrame, column: str, out: str, how: str = "inner") -> DataFrame:
        side = known.select(F.col("kid").alias(out), F.col("scip_symbol").alias(column), F.col("first_doc").alias("__first"))
        if resolve == "ordered":
            if how == "inner":
                return df.join(side, column).where("__first <= doc_ord").drop("__first")
            return df.join(side, column, how).withColumn(out, F.when(F.col("__first") <= F.col("doc_ord"), F.col(out))).drop("__first")
        return df.join(side, column, how).drop("__first")

    points = occs.withColumns({"point": F.struct("doc_ord", "occ_ord"), "line": F.when(is_definition(F.col("role")), -1).otherwise(F.col("sl"))})
    placed = enclosing(points, definition_ranges(occs)).drop("point", "line")
    placed = resolved(resolved(placed, "symbol", "symbol_id"), "encloser", "enclosing_symbol_id", "left").join(file_ids, "path", "left")
    occurrences = numbered(placed, ["doc_ord", "occ_ord"], "id").select("id", "symbol_id", "file_id", F.col("sl").alias("start_line"), F.col("sc").alias("start_col"), F.col("el").alias("end_line"), F.col("ec").alias("end_col"), "role", "enclosing_symbol_id")

    raw = reference_edges(occs, infos).unionByName(relationship_edges(infos)).unionByName(contains_edges(occs, infos))
    raw = materialise(resolved(resolved(raw, "src", "src_id"), "dst", "dst_id").join(file_ids.where("path != ''"), "path", "left"), "edges")
    recovered = recovered_contains(symbols).withColumns({"doc_ord": F.lit(1 << 62), "step": F.lit(5), "ord": F.lit(0), "part": F.lit(0)})
    columns = ["src_id", "dst_id", "type", "file_id", "line", "metadata", "doc_ord", "step", "ord", "part"]
    edges = dedupe_edges(raw.select(columns).unionByName(recovered.select(columns)), dedupe_null_file)
    edges = numbered(edges, ["doc_ord", "step", "ord", "part", "src_id", "dst_id", "type"], "edge_ord")
    edges = edges.select("edge_ord", "src_id", "dst_id", "type", "file_id", "line", F.lit(1).alias("weight"), F.lit(1.0).alias("confidence"), "metadata")
    return {"files": files, "symbols": symbols.drop("first_doc"), "occurrences": occurrences, "edges": edges, "meta": metadata_rows(index)}


def recovered_contains(symbols: DataFrame) -> DataFrame:
    """contains from each field's enclosing symbol, by name over all documents."""
    owner = symbols.select(F.col("id").alias("src_id"), F.col("scip_symbol").alias("enclosing_symbol"))
    rows = symbols.where("kind = 'field' and enclosing_symbol is not null").select(F.col("id").alias("dst_id"), "enclosing_symbol", F.col("def_file_id").alias("file_id"), F.col("def_start_line").alias("line"))
    return rows.join(owner, "enclosing_symbol").select("src_id", "dst_id", F.lit("contains").alias("type"), "file_id", "line", F.lit(None).cast("string").alias("metadata"))


def latest(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The last value of each key."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))
