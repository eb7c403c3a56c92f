"""Changes to a stored graph: re-indexed files replace what was known of them, as a batch or as a stream.

A change is one algebra over tables: anti-joins take away what belongs to the touched files, unions
bring what the new index has, and identifiers of known symbols and files stay.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import is_definition
from ..operators import derive
from ..operators.metrics import rebuilt_fraction
from ..plans.ordinals import numbered
from ..plans.store import Store
from ..schema import EDGES, OCCURRENCES
from ..session import materialise, scope
from ..sources import files as inputs

Tables = dict[str, DataFrame]
KEPT = 3  # snapshots that stay after a change, for readers that have begun


def delete_file_records(tables: Tables, touched: DataFrame) -> Tables:
    """tables without the occurrences and edges of the files touched (file_id), whose symbols lose their definition but stay.

    Edges without a file go with their source symbol's file, so that bringing them again does not repeat them.
    """
    gone = touched.select("file_id").distinct()
    mine = tables["symbols"].join(gone.withColumnRenamed("file_id", "def_file_id"), "def_file_id", "left_semi").select(F.col("id").alias("src_id"))
    edges = tables["edges"]
    kept = edges.where("file_id is not null").join(gone, "file_id", "left_anti").select(edges.columns).union(edges.where("file_id is null").join(mine, "src_id", "left_anti").select(edges.columns))
    mark = tables["symbols"].join(gone.select(F.col("file_id").alias("def_file_id"), F.lit(True).alias("__gone")), "def_file_id", "left")
    lost = F.col("__gone").isNotNull()
    symbols = mark.withColumns({"def_file_id": F.when(~lost, F.col("def_file_id")), "def_start_line": F.when(lost, -1).otherwise(F.col("def_start_line")), "def_end_line": F.when(lost, -1).otherwise(F.col("def_end_line"))})
    return tables | {"occurrences": tables["occurrences"].join(gone, "file_id", "left_anti").select(tables["occurrences"].columns), "edges": kept, "symbols": symbols.select(tables["symbols"].columns)}


def scoped_contains_recovery(symbols: DataFrame, edges: DataFrame, touched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges without the contains edges to symbols of the touched files, and those edges derived anew from the symbols' names."""
    here = symbols.join(touched.select(F.col("file_id").alias("def_file_id")).distinct(), "def_file_id", "left_semi").select(F.col("id").alias("dst_id"))
    rest = edges.where("not (type <=> 'contains')").union(edges.where("type = 'contains'").join(here, "dst_id", "left_anti").select(edges.columns))
    return rest, derive.recovered_contains(symbols).join(here, "dst_id", "left_semi")


def scoped_gc(edges: DataFrame, occurrences: DataFrame, candidates: DataFrame) -> DataFrame:
    """edges without those to a candidate (id) that no occurrence defines."""
    defined = occurrences.where(is_definition(F.col("role"))).select(F.col("symbol_id").alias("id")).distinct()
    dead = candidates.select("id").distinct().join(defined, "id", "left_anti").withColumnRenamed("id", "dst_id")
    return edges.join(dead, "dst_id", "left_anti").select(edges.columns)


def apply_changes(base: Tables, index: DataFrame) -> Tables:
    """The tables after the documents of index (partial) have replaced their former state."""
    infos, occs = materialise(derive.symbol_infos(index), "infos"), materialise(derive.occurrence_rows(index), "occurrences")
    paths = index.where("part = 'document'").groupBy(F.col("relative_path").alias("path")).agg(F.min_by(F.struct("doc_ord", "language"), "doc_ord").alias("f"))
    old_files = base["files"]
    most = lambda df, c: df.agg(F.coalesce(F.max(c), F.lit(0)).alias("__most"))
    fresh = paths.join(old_files, "path", "left_anti").select("path", derive.language(F.col("f.language")).alias("language"))
    fresh = numbered(fresh, ["path"], "__n").crossJoin(F.broadcast(most(old_files, "id")))  # one row
    files = materialise(old_files.unionByName(fresh.select((F.col("__most") + F.col("__n")).alias("id"), "path", "language", F.lit(None).cast("string").alias("subsystem"), F.lit(None).cast("string").alias("sha"))), "files")
    touched = old_files.join(paths, "path", "left_semi").select(F.col("id").alias("file_id"))

    candidates = base["symbols"].join(touched.withColumnRenamed("file_id", "def_file_id"), "def_file_id", "left_semi").select("id")
    less = delete_file_records(base, touched)

    # known symbols keep all but a definition they have lost; new ones are numbered on
    file_ids = files.select(F.col("id").alias("file_id"), "path")
    new = derive.upsert_symbols(infos, derive.definition_lines(occs, infos)).join(file_ids, "path", "left").withColumn("file_id", F.when(~F.col("is_external"), F.col("file_id")))
    again = new.select("scip_symbol", F.col("file_id").alias("__file"), F.col("def_start_line").alias("__start"), F.col("def_end_line").alias("__end"))
    old = less["symbols"].join(again, "scip_symbol", "left")
    fill = F.col("def_file_id").isNull() & F.col("__file").isNotNull()
    old = old.withColumns({"def_start_line": F.when(fill, F.col("__start")).otherwise(F.col("def_start_line")), "def_end_line": F.when(fill, F.col("__end")).otherwise(F.col("def_end_line")), "def_file_id": F.when(fill, F.col("__file")).otherwise(F.col("def_file_id"))})
    added = numbered(new.join(base["symbols"], "scip_symbol", "left_anti"), ["first_doc", "sym_ord"], "__n").crossJoin(F.broadcast(most(base["symbols"], "id")))  # one row
    added = added.select((F.col("__most") + F.col("__n")).alias("id"), "scip_symbol", "name", "kind", "signature", "documentation", F.col("file_id").alias("def_file_id"), "def_start_line", "def_end_line", "is_external", F.lit(None).cast("string").alias("subsystem"), "enclosing_symbol")
    symbols = materialise(old.select(base["symbols"].columns).unionByName(added), "symbols")
    known = symbols.select(F.col("id").alias("__id"), "scip_symbol")

    def resolved(df: DataFrame, column: str, out: str, how: str = "inner") -> DataFrame:
        return df.join(known.select(F.col("__id").alias(out), F.col("scip_symbol").alias(column)), column, how)

    points = occs.withColumns({"point": F.struct("doc_ord", "occ_ord"), "line": F.when(is_definition(F.col("role")), -1).otherwise(F.col("sl"))})
    placed = derive.enclosing(points, derive.definition_ranges(occs)).drop("point", "line")
    placed = resolved(resolved(placed, "symbol", "symbol_id"), "encloser", "enclosing_symbol_id", "left").join(file_ids, "path")
    placed = numbered(placed, ["doc_ord", "occ_ord"], "__n").crossJoin(F.broadcast(most(less["occurrences"], "id")))  # one row
    placed = placed.select((F.col("__most") + F.col("__n")).alias("id"), "symbol_id", "file_id", F.col("sl").alias("start_line"), F.col("sc").alias("start_col"), F.col("el").alias("end_line"), F.col("ec").alias("end_col"), "role", "enclosing_symbol_id")
    occurrences = materialise(less["occurrences"].select(OCCURRENCES.names).unionByName(placed), "occurrences")

    raw = derive.reference_edges(occs, infos).unionByName(derive.relationship_edges(infos)).unionByName(derive.contains_edges(occs, infos))
    raw = resolved(resolved(raw, "src", "src_id"), "dst", "dst_id").join(file_ids.where("path != ''"), "path", "left")
    rest, recovered = scoped_contains_recovery(symbols, less["edges"], touched)
    columns = ["src_id", "dst_id", "type", "file_id", "line", "metadata", "doc_ord", "step", "ord", "part"]
    recovered = recovered.withColumns({"doc_ord": F.lit(1 << 62), "step": F.lit(5), "ord": F.lit(0), "part": F.lit(0)})
    held = rest.select("src_id", "dst_id", "type", "file_id", "line", "metadata", F.lit(-1).cast("long").alias("doc_ord"), F.lit(0).alias("step"), F.col("edge_ord").alias("ord"), F.lit(0).alias("part"))
    edges = materialise(derive.dedupe_edges(held.unionByName(raw.select(columns)).unionByName(recovered.select(columns))), "edges")
    kept = rest.join(edges.where("doc_ord = -1").select(F.col("ord").alias("edge_ord")), "edge_ord", "left_semi").select(EDGES.names)
    grown = numbered(edges.where("doc_ord != -1"), ["doc_ord", "step", "ord", "part", "src_id", "dst_id", "type"], "__n").crossJoin(F.broadcast(most(base["edges"], "edge_ord")))  # one row
    grown = grown.select((F.col("__most") + F.col("__n")).alias("edge_ord"), "src_id", "dst_id", "type", "file_id", "line", F.lit(1).alias("weight"), F.lit(1.0).alias("confidence"), "metadata")
    edges = scoped_gc(kept.unionByName(grown), occurrences, candidates)
    return {"files": files, "symbols": symbols, "occurrences": occurrences, "edges": edges, "meta": base["meta"]}


def ingest_incremental(store: Store, index: DataFrame, stamp: int | None = None) -> dict:
    """Apply a partial index as a new snapshot; if anything fails the current one stays.  stamp: the graph's new index_timestamp."""
    began = time.time()
    graph = store.graph()
    base = {k: getattr(graph, k) for k in ("files", "symbols", "occurrences", "edges", "meta")}
    with scope(store.spark):
        tables = apply_changes(base, index)
        if stamp is not None:
            row = store.spark.range(1).select(F.lit("index_timestamp").alias("key"), F.lit(str(stamp)).alias("value"))
            tables["meta"] = tables["meta"].where("key != 'index_timestamp'").union(row)
        snapshot = store.write(tables, point=False, ready=("files", "symbols", "occurrences"))
    before = store.current()
    store.publish(snapshot)
    for old in store.snapshots()[:-KEPT]:
        if old not in (snapshot, before):
            store.discard(old)
    return {"files_touched": index.where("part = 'document'").select("relative_path").distinct().count(), "elapsed_s": time.time() - began}


def stream_changes(spark: SparkSession, folder: str, store: Store, checkpoint: str) -> StreamingQuery:
    """Apply each partial index (Parquet rows of the index schema) that lands in folder; every batch ends in one pointer swap, so a replay is harmless."""
    from ..schema import INDEX

    def each(batch: DataFrame, _: int) -> None:
        if batch.limit(1).count():
            ingest_incremental(store, batch)

    return spark.readStream.schema(INDEX).parquet(folder).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def plan_sync(spark: SparkSession, commands: str, root: str, baseline: float, threshold: float = 0.3) -> dict:
    """What a sync has to do: the compile commands whose objects are newer than the baseline, and whether they are too many."""
    entries = inputs.object_times(inputs.compile_commands(spark, commands), inputs.object_files(spark, root))
    row = rebuilt_fraction(entries.select((F.coalesce(F.col("mtime"), F.lit(0.0)) > baseline).alias("rebuilt")), threshold).first()
    return row.asDict() | {"entries": inputs.rebuilt(entries, baseline)}


def detect_and_filter(spark: SparkSession, commands: str, root: str, baseline: float, out: str) -> int:
    """Write the compile commands that are to be indexed again; how many they are."""
    return inputs.write_compile_commands(plan_sync(spark, commands, root, baseline)["entries"], out)
