import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from graphloom.operators import derive
from graphloom.operators.graph import Graph
from graphloom.plans import projection
from graphloom.plans.ordinals import numbered
from graphloom.plans.store import Store, ingest, with_stats
from graphloom.session import scope, shared_folder
from graphloom.sources import scip, wire
from graphloom.sources.scip import read_scip
from graphloom.streaming import incremental
from tests import fixture as fx


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return tmp_path_factory.mktemp("index")


@pytest.fixture(scope="module")
def store(spark, folder):
    (folder / "index.scip").write_bytes(fx.index())
    return ingest(spark, str(folder / "index.scip"), str(folder / "store"), now=1_700_000_000)


@pytest.fixture(scope="module")
def graph(store):
    return store.graph()


def test_source_ranges(spark, folder, store):
    whole = [r.asDict(True) for r in read_scip(spark, str(folder / "index.scip")).orderBy("doc_ord").collect()]
    cut = [r.asDict(True) for r in read_scip(spark, str(folder / "index.scip"), rangeBytes=1).orderBy("doc_ord", "first").collect()]
    assert whole[:4] == cut[:4]
    # external symbols come in rows of ranges
    assert [r["first"] for r in cut[4:]] == [0, 1]
    assert whole[4]["symbols"] == [s for r in cut[4:] for s in r["symbols"]]
    assert [(r["doc_ord"], r["part"]) for r in whole] == [(0, "metadata"), (1, "document"), (2, "document"), (3, "document"), (4, "external")]


def test_broken_wire():
    with pytest.raises(ValueError, match="long"):
        wire.varint(b"\xff" * 12, 0, 32)
    with pytest.raises(ValueError, match="truncated"):
        list(wire.fields(b"\x0a\x05ab"))


def test_missing_file(spark):
    with pytest.raises(Exception, match="FileNotFoundError"):
        read_scip(spark, "/nowhere/index.scip").collect()


def test_goldens(graph):
    assert graph.files.count() == 4
    assert graph.symbols.count() == 13
    assert graph.occurrences.count() == 13
    counts = {r["type"]: r["n"] for r in graph.edges.groupBy("type").agg(F.count("*").alias("n")).collect()}
    assert counts == {"calls": 5, "ops_bind": 3, "contains": 3, "type_of": 1}


def test_global_resolution_keeps_later_targets(spark, folder, store):
    edges = derive.build(read_scip(spark, str(folder / "index.scip")), resolve="global")["edges"]
    assert edges.where("type = 'implements'").count() == 1
    assert edges.count() == 13


def test_meta(graph):
    assert {r["key"]: r["value"] for r in graph.get_metadata().collect()} == {"project_root": "/kernel", "tool_name": "scip-clang", "tool_version": "0.3.5", "index_timestamp": "1700000000", "total_symbols": "13", "total_files": "4"}


def test_callers_chain_and_path(graph):
    rows = graph.find_callers(fx.READ).collect()
    assert [(r["line"], r["edge_type"]) for r in rows] == [(105, "calls"), (105, "ops_bind"), (210, "calls")]
    assert [r["name"] for r in graph.get_callchain(fx.READ).collect()] == ["ext4_file_read_iter", "ext4_file_operations"]
    path = graph.call_path_arrivals(fx.VFS_READ, fx.READ).collect()
    assert [(r["file_path"], r["line"]) for r in path] == [("fs/ext4/file.c", 210)]
    assert [r["name"] for r in graph.call_path(fx.VFS_READ, fx.READ).collect()] == ["vfs_read", "ext4_file_read_iter"]
    assert graph.find_callers("no such symbol").count() == 0
    assert graph.call_path(fx.READ, fx.VFS_READ).count() == 0


def test_one_hop(graph):
    layout = graph.get_struct_layout(fx.OPS).first()
    assert sorted(f["name"] for f in layout["fields"]) == ["open", "read_iter", "write_iter"]
    assert [r["type_name"] for r in graph.find_type_definition(fx.OPS + "read_iter.").collect()] == ["ext4_file_read_iter"]
    assert [r["impl_name"] for r in graph.find_ops_impls("write_iter").collect()] == ["ext4_file_write_iter"]
    refs = graph.find_references(fx.READ).collect()
    assert [(r["file_path"], r["start_line"], r["is_definition"], r["enclosing_name"]) for r in refs] == [("fs/ext4/file.c", 50, True, None), ("fs/ext4/file.c", 105, False, "ext4_file_operations"), ("fs/read_write.c", 210, False, "vfs_read")]


def test_neighbourhood_caps(graph):
    found = graph.get_neighborhood(fx.READ, 1)
    assert {n["name"] for n in found["nodes"]} == {"ext4_file_read_iter", "ext4_file_operations", "vfs_read", "read_iter"}
    assert found["truncated"] == {"nodes": False, "edges": False}
    few = graph.get_neighborhood(fx.READ, 1, max_nodes=2)
    assert len(few["nodes"]) == 2
    assert few["truncated"]["nodes"]
    one = graph.get_neighborhood(fx.READ, 1, max_edges=1)
    assert len(one["edges"]) == 1
    assert one["truncated"]["edges"]
    assert graph.get_neighborhood("no such symbol")["center"] is None


def test_enclosing_against_brute_force(spark):
    r = random.Random(3)
    ranges = [(r.randint(0, 2), s := r.randint(0, 400), s + r.choice([0, 1, 63, 64, 200]), r.randint(0, 3), f"s{r.randint(0, 30)}") for _ in range(300)]
    points = [(i, r.randint(0, 3), r.randint(-1, 500)) for i in range(400)]
    out = derive.enclosing(spark.createDataFrame(points, "point int, doc_ord int, line int"), spark.createDataFrame(ranges, "doc_ord int, start int, end int, col int, symbol string"))
    got = {x["point"]: x["encloser"] for x in out.collect()}
    for p, doc, line in points:
        held = [(s, e, c, n) for d, s, e, c, n in ranges if d == doc and s <= line <= e]
        assert got[p] == (max(held)[3] if held and line >= 0 else None)


def moved():
    """fs/ext4/file.c again: one function further down, one new, one gone."""
    fns = ((fx.READ, "ext4_file_read_iter"), (fx.WRITE, "ext4_file_write_iter"), (fx.P + "ext4_new().", "ext4_new"))
    return fx.document("fs/ext4/file.c", [fx.symbol(s, fx.FUNCTION, n) for s, n in fns], [fx.occurrence(fx.READ, 1, 500, (500, 510)), fx.occurrence(fx.WRITE, 1, 520, (520, 530)), fx.occurrence(fx.P + "ext4_new().", 1, 540, (540, 550)), fx.occurrence(fx.READ, 8, 545)])


def named(graph: Graph) -> Counter:
    s = graph.symbols.select("id", "scip_symbol")
    rows = graph.edges.join(s.withColumnsRenamed({"id": "src_id", "scip_symbol": "a"}), "src_id").join(s.withColumnsRenamed({"id": "dst_id", "scip_symbol": "b"}), "dst_id").select("a", "b", "type", "line")
    return Counter(map(tuple, rows.collect()))


def test_incremental_is_a_full_rebuild(spark, tmp_path):
    (tmp_path / "base.scip").write_bytes(fx.index())
    (tmp_path / "part.scip").write_bytes(fx.index([moved()], external=False))
    docs = fx.documents()
    (tmp_path / "full.scip").write_bytes(fx.index([moved(), *docs[1:]]))
    changed = ingest(spark, str(tmp_path / "base.scip"), str(tmp_path / "a"))
    before = changed.current()
    assert incremental.ingest_incremental(changed, read_scip(spark, str(tmp_path / "part.scip")))["files_touched"] == 1
    assert changed.current() != before
    full = ingest(spark, str(tmp_path / "full.scip"), str(tmp_path / "b"))
    a, b = changed.graph(), full.graph()
    assert named(a) == named(b)
    lines = lambda g: {r["scip_symbol"]: r["def_start_line"] for r in g.symbols.where("def_file_id is not null").collect()}
    assert {k: v for k, v in lines(a).items() if v >= 0} == {k: v for k, v in lines(b).items() if v >= 0}
    old = {r["scip_symbol"]: r["id"] for r in changed.graph(before).symbols.collect()}
    new = {r["scip_symbol"]: r["id"] for r in a.symbols.collect()}
    assert all(new[k] == v for k, v in old.items())


def test_failed_change_leaves_the_graph(spark, tmp_path, store):
    before = store.current()
    with pytest.raises(Exception, match="no_such_column"):
        incremental.ingest_incremental(store, spark.range(1).select("no_such_column"))
    assert store.current() == before


def test_stream_of_changes(spark, tmp_path):
    (tmp_path / "base.scip").write_bytes(fx.index())
    (tmp_path / "part.scip").write_bytes(fx.index([moved()], external=False))
    store = ingest(spark, str(tmp_path / "base.scip"), str(tmp_path / "s"))
    read_scip(spark, str(tmp_path / "part.scip")).coalesce(1).write.parquet(str(tmp_path / "drop"))
    query = incremental.stream_changes(spark, str(tmp_path / "drop"), store, str(tmp_path / "checkpoint"))
    query.awaitTermination(180)
    assert store.graph().symbols.where("name = 'ext4_new'").count() == 1


def test_repeated_ingest_overwrites(spark, tmp_path):
    (tmp_path / "i.scip").write_bytes(fx.index())
    store = ingest(spark, str(tmp_path / "i.scip"), str(tmp_path / "s"))
    first = store.current()
    store.write(with_stats(derive.build(read_scip(spark, str(tmp_path / "i.scip")))))
    assert store.graph().occurrences.count() == 13
    store.discard(first)
    with pytest.raises(ValueError, match="current"):
        store.discard(store.current())
    with pytest.raises(FileNotFoundError):
        Store(spark, str(tmp_path / "none")).table("files")


def test_large_document_comes_in_pieces(spark, tmp_path):
    """No row, and so no task, holds a document whole; places go on from row to row, and a part that is not asked for is left out."""
    lines = [(k * 40_000) % 3_000_001 for k in range(2 * scip.PIECE + 100)]
    occurrences = [fx.occurrence(fx.READ, 1 if k == 0 else 8, line, (line, line + 3) if k % 3 == 0 else None, ("three", "four", "single", "multi")[k % 4]) for k, line in enumerate(lines)]
    symbols = [fx.symbol(f"{fx.P}f{k}().", fx.FUNCTION, f"f{k}") for k in range(scip.PIECE + 3)]
    (tmp_path / "i.scip").write_bytes(fx.index([fx.document("a.c", symbols, occurrences), fx.document("b.c", symbols[:2], occurrences[:2]), fx.document("c.c", [], [])], external=False))
    rows = read_scip(spark, str(tmp_path / "i.scip")).where("part = 'document'").collect()
    assert max(max(len(r["symbols"]), len(r["occurrences"])) for r in rows) == scip.PIECE
    assert {r["doc_ord"]: (r["relative_path"], r["language"]) for r in rows} == {1: ("a.c", "C"), 2: ("b.c", "C"), 3: ("c.c", "C")}
    assert [len(r["occurrences"]) for r in rows if r["doc_ord"] > 1] == [2, 0]
    occs = derive.occurrence_rows(read_scip(spark, str(tmp_path / "i.scip"), only="occurrences")).where("doc_ord = 1").orderBy("occ_ord").collect()
    assert [(r["occ_ord"], r["sl"], r["el"], r["body_end"]) for r in occs] == [(k, line, line, line + 3 if k % 3 == 0 else line) for k, line in enumerate(lines)]
    infos = derive.symbol_infos(read_scip(spark, str(tmp_path / "i.scip"), only="symbols")).where("doc_ord = 1").orderBy("sym_ord").collect()
    assert [(r["sym_ord"], r["name"]) for r in infos] == [(k, f"f{k}") for k in range(len(symbols))]
    heads = read_scip(spark, str(tmp_path / "i.scip"), only="heads").where("part = 'document'").collect()
    assert [(r["relative_path"], r["symbols"], r["occurrences"]) for r in heads] == [("a.c", [], []), ("b.c", [], []), ("c.c", [], [])]


def test_tables_are_stored_as_they_are_asked_for(spark):
    """What lies in the metadata or the files of the projected graph does not wait for its edges; what is numbered is stored once."""
    g = projection.Projected(projection.Tables(spark, "/root/testdata/sf0.001"))
    assert g.get_metadata().count() == 5 and set(g._made) == {"meta"}
    assert g.get_definition_location("cxx . . $ Customer#000000007().").count() == 1 and set(g._made) == {"meta", "files", "symbols"}
    with scope(spark):
        edges = g.edges.count()
    assert edges == g.edges_by_dst.count() == g.edges.select("edge_ord").distinct().count() > 0  # outlives the scope in which it was asked for


def test_numbering_leaves_no_second_copy(spark):
    at = Path(shared_folder(spark).removeprefix("file:")) / "graphloom"
    before = set(at.glob("unnumbered-*"))
    rows = numbered(spark.range(100).select((F.col("id") * 7 % 100).alias("k")), ["k"], "n").collect()
    assert all(r["n"] == r["k"] + 1 for r in rows)
    assert set(at.glob("unnumbered-*")) == before
