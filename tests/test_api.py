import json
import os
import socket
import subprocess
import threading
import time
import urllib.error
import urllib.request

import pytest

from graphloom import api, cli
from graphloom.plans import reports
from graphloom.plans.graph_store import GraphStore, SparkGraphStore
from graphloom.plans.store import Store, ingest
from graphloom.server import server
from graphloom.sources import files as sources
from graphloom.sources.scip import read_scip
from tests import fixture as fx


@pytest.fixture(scope="module")
def tools(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("api")
    (at / "index.scip").write_bytes(fx.index())
    store = ingest(spark, str(at / "index.scip"), str(at / "store"), now=1_700_000_000)
    return api.Tools(store.graph(), store.search_index())


def test_tools(tools):
    assert "ext4_file_operations [ops_bind]  fs/ext4/file.c:106" in tools.find_callers("ext4_file_read_iter")
    assert tools.get_callchain("ext4_file_read_iter").splitlines()[1].strip().startswith("ext4_file_operations")
    assert {r["name"] for r in tools.found("read_iter")} == {"read_iter", "ext4_file_read_iter"}
    assert "ext4_file_read_iter [function]  fs/ext4/file.c:51" in tools.search_symbols("read_iter")
    assert tools.search_symbols("foo(").startswith("not a query")
    assert tools.index_status()["edge_counts"]["calls"] == 5
    assert fx.READ in tools.get_symbol("ext4_file_read_iter")
    assert "vfs_read" in tools.call_path("vfs_read", "ext4_file_read_iter")
    assert "fs/read_write.c:211:5  in vfs_read" in tools.find_references("ext4_file_read_iter")
    assert "3 fields" in tools.get_struct_layout("ext4_file_operations")
    assert "ext4_file_write_iter  in ext4_file_operations" in tools.find_ops_impls("write_iter")
    assert "symbols and" in tools.get_neighborhood("vfs_read") and tools.get_neighborhood("vfs_read", summary=False)["center"]["name"] == "vfs_read"
    assert api.call(tools, "find_callers", {"name": "nobody"}) == "no symbol is called 'nobody'"
    assert api.call(tools, "nothing", {}).startswith("no tool") and api.call(tools, "get_symbol", {"x": 1}).startswith("not understood")
    with pytest.raises(api.NotFound):
        tools.find_callees("nobody")


def test_requests(tools):
    ask = lambda at, **q: api.handle(tools, at, q)
    assert ask("/api/status")[0] == 200
    status, body = ask("/api/global-network", prefix="fs")
    assert status == 200
    assert {n["id"] for n in json.loads(body)["nodes"]} >= {"fs/ext4", "fs/read_write.c"}
    assert ask("/api/global-network", prefix="../x")[0] == 400
    assert ask("/api/neighborhood", name="vfs_read", edge_types="nonsense")[0] == 400
    assert ask("/api/neighborhood", name="nobody")[0] == 404
    assert ask("/api/file-symbols", path="fs/none.c")[0] == 404
    assert ask("/api/search", q="foo(")[0] == 400
    assert ask("/api/none")[0] == 404
    assert len(json.loads(ask("/api/file-symbols", path="fs/read_write.c")[1])) == 2


def tree(tools, at):
    (at / "fs").mkdir()
    (at / "fs" / "read_write.c").write_text("".join(f"line {i}\n" for i in range(250)) + "vfs_read is here\n" + "after\n" * 80)
    return api.Tools(tools.graph, tools.index, str(at))


def test_function_body(tools, tmp_path):
    at = tree(tools, tmp_path)
    os.utime(tmp_path / "fs" / "read_write.c", (1, 1))
    body = at.get_function_body("vfs_read").splitlines()
    assert body[0] == "// vfs_read [function]  fs/read_write.c:201" and body[1] == "   201\tline 200"
    assert len(body) == 32
    assert "stale" not in at.find_callers("vfs_read")
    assert "cannot be read" in at.get_function_body("ext4_file_open")
    assert "defined in no file" in at.get_function_body("sys_read")


@pytest.mark.parametrize("how", ["none", "committed", "working_tree", "untracked", "staged"])
def test_changed_files(tools, tmp_path, how):
    """A file that is newer than the index is stale, committed or not; its body is looked for as it is now."""
    at = tree(tools, tmp_path)
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    if how != "none":
        git("init", "-q")
    if how in ("committed", "working_tree"):
        git("add", ".")
        git("commit", "-qm", "one")
    if how == "staged":
        git("add", ".")
    if how == "working_tree":
        with (tmp_path / "fs" / "read_write.c").open("a") as f:
            f.write("more\n")
    reason = {"none": "mtime", "committed": "mtime"}.get(how, how)
    body = at.get_function_body("vfs_read").splitlines()
    assert f"({reason})" in body[1] and body[2].endswith("\tvfs_read is here")
    assert at.find_callers("ext4_file_read_iter").count("stale") == 0
    assert f"fs/read_write.c has changed after indexing ({reason})" in at.get_symbol("vfs_read")


def test_server(tools):
    with server(tools, 0, idle=0.5) as s:
        threading.Thread(target=s.serve_forever, daemon=True).start()
        url = f"http://127.0.0.1:{s.server_port}/api"
        # a client that says nothing does not keep the thread
        idle = socket.create_connection(("127.0.0.1", s.server_port))
        with urllib.request.urlopen(f"{url}/status", timeout=60) as r:
            assert json.loads(r.read())["edge_counts"]["calls"] == 5
        idle.close()
        for path, code in (("/neighborhood?name=nobody", 404), ("/global-network?prefix=../x", 400), ("/none", 404)):
            with pytest.raises(urllib.error.HTTPError) as e:
                urllib.request.urlopen(url + path, timeout=60)
            assert e.value.code == code
        s.shutdown()


def test_commands(spark, tmp_path, capsys):
    """init, then sync with an indexer that is a script: up to date, too many changes, one change."""
    from tests.test_ingest import moved

    (tmp_path / "compile_commands.json").write_text(json.dumps([{"directory": "/", "file": f"f{i}.c", "command": f"cc -c f{i}.c -o f{i}.o"} for i in range(4)]))
    assert cli.main(["sync", str(tmp_path)], spark) == 1
    (tmp_path / "full.bin").write_bytes(fx.index())
    (tmp_path / "part.bin").write_bytes(fx.index([moved()], external=False))
    script = tmp_path / "indexer.sh"
    script.write_text(f"#!/bin/sh\nfor a in \"$@\"; do case $a in --index-output-path=*) out=${{a#*=}};; --compdb-path=*) db=${{a#*=}};; esac; done\ncase $db in *filtered*) cp {tmp_path}/part.bin $out;; *) cp {tmp_path}/full.bin $out;; esac\n")
    script.chmod(0o755)
    assert cli.main(["init", str(tmp_path), "--indexer", str(script)], spark) == 0
    assert "symbols: 13 rows" in capsys.readouterr().out
    assert cli.main(["init", str(tmp_path)], spark) == 1
    assert cli.main(["sync", str(tmp_path), "--indexer", str(script)], spark) == 0
    assert "up to date" in capsys.readouterr().out
    for i in range(4):
        (tmp_path / f"f{i}.o").write_bytes(b"object")
        if i == 0:
            os.utime(tmp_path / "f0.o", (2**31, 2**31))
        else:
            os.utime(tmp_path / f"f{i}.o", (1, 1))
    assert cli.main(["sync", str(tmp_path), "--indexer", str(script), "--threshold", "0.2"], spark) == 1
    before = api.Tools(Store(spark, str(tmp_path / ".graphloom")).graph()).baseline
    time.sleep(1.1)
    assert cli.main(["sync", str(tmp_path), "--indexer", str(script)], spark) == 0
    after = api.Tools(Store(spark, str(tmp_path / ".graphloom")).graph())
    assert after.baseline > before
    assert after.graph.symbols.where("name = 'ext4_new'").count() == 1


def test_graph_store(spark, tmp_path):
    (tmp_path / "i.scip").write_bytes(fx.index())
    with pytest.raises(TypeError):
        GraphStore()
    s = SparkGraphStore(spark, str(tmp_path / "s"))
    s.create_schema()
    assert s.find_callers(fx.READ) == []
    s.write_batch(read_scip(spark, str(tmp_path / "i.scip")))
    s.finalize()
    assert [r["line"] for r in s.find_callers(fx.READ)] == [105, 105, 210]
    assert s.get_metadata()["total_symbols"] == "13"
    s.close()


def test_written_views(tools, tmp_path):
    manifest = reports.bake(tools.graph, str(tmp_path), "read_iter", "ext4_file_read_iter", "ext4_file_operations", "vfs_read")
    assert [m["count"] for m in manifest] == [1, 2, 3, 2]
    row = reports.health(tools.graph, str(tmp_path), ts="2024-01-01", head="abc", buildable=True)
    assert row["symbols"] == 13 and not row["benchmark_ok"]
    assert sources.metrics_rows(tools.graph.spark, str(tmp_path / "metrics.jsonl")).first()["ops_bind"] == 3
