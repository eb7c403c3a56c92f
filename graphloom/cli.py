"""Commands: ``python -m graphloom init | sync | serve | view PATH``.

PATH is a source tree with a compile database.  The graph lies in ``PATH/.graphloom``; the index is made by an external
indexer, a command that gets ``--compdb-path`` and ``--index-output-path`` (``--indexer``).
"""

from __future__ import annotations

import argparse
import json
import shutil
import subprocess
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

from . import api
from .plans.store import Store, ingest
from .server import server
from .sources.scip import read_scip
from .streaming import incremental


def _index(indexer: str, commands: Path, out: Path, root: Path) -> None:
    done = subprocess.run([indexer, f"--compdb-path={commands}", f"--index-output-path={out}"], cwd=root, timeout=3600)
    if done.returncode or not out.exists():
        raise RuntimeError(f"{indexer} failed with {done.returncode}")


def init(spark: SparkSession, root: Path, indexer: str, force: bool = False, skip_build: bool = False) -> int:
    """Index the tree, unless there is an index, and ingest it."""
    commands, index, at = root / "compile_commands.json", root / "index.scip", root / ".graphloom"
    if not commands.exists():
        print(f"{commands} is missing: build with a compile database first")
        return 1
    if (at / "CURRENT").exists() and not force:
        print(f"{at} holds a graph already; --force builds it again")
        return 1
    if skip_build and not index.exists():
        print(f"{index} is missing, and --skip-build was asked for")
        return 1
    if not skip_build and (force or not index.exists()):
        _index(indexer, commands, index, root)
    store = ingest(spark, str(index), str(at))
    for row in store.stats:
        print(f"{row['table']}: {row['rows']} rows in {row['seconds']:.1f} s")
    print(json.dumps(api.Tools(store.graph()).index_status()["edge_counts"]))
    return 0


def sync(spark: SparkSession, root: Path, indexer: str, threshold: float = 0.3, force_full: bool = False) -> int:
    """Index again what was built since the graph was, and apply it; too many changes are refused."""
    commands, at = root / "compile_commands.json", root / ".graphloom"
    if not (at / "CURRENT").exists() or not commands.exists():
        print(f"{at} or {commands} is missing: run init first")
        return 1
    if force_full:
        return init(spark, root, indexer, True, (root / "index.scip").exists())
    store = Store(spark, str(at))
    baseline = api.Tools(store.graph()).baseline
    began = int(time.time())
    plan = incremental.plan_sync(spark, str(commands), str(root), baseline, threshold)
    if not plan["rebuilt"]:
        print("the graph is up to date")
        return 0
    print(f"{plan['rebuilt']} of {plan['total']} translation units were built again")
    if plan["refused"]:
        print(f"that is above {threshold:.0%}: run init --force")
        return 1
    part, filtered = at / f"part-{began}.scip", at / "filtered_compile_commands.json"
    incremental.inputs.write_compile_commands(plan["entries"], str(filtered))
    try:
        _index(indexer, filtered, part, root)
        report = incremental.ingest_incremental(store, read_scip(spark, str(part)), began)
    finally:
        part.unlink(missing_ok=True)
    print(f"{report['files_touched']} files in {report['elapsed_s']:.1f} s")
    return 0


def serve(tools: api.Tools) -> int:
    """Answer tools over standard input and output: a JSON object {"tool", "arguments"} a line, and one {"text"} a line back."""
    for line in sys.stdin:
        if not line.strip():
            continue
        try:
            asked = json.loads(line)
            text = api.call(tools, asked.get("tool", ""), asked.get("arguments") or {})
        except (ValueError, AttributeError) as e:
            text = f"not understood: {e}"
        print(json.dumps({"text": text}), flush=True)
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="graphloom", description="Code-graph analytics.")
    parser.add_argument("command", choices=["init", "sync", "serve", "view"])
    parser.add_argument("path", nargs="?", default=".")
    parser.add_argument("--indexer", default=shutil.which("scip-clang") or "scip-clang")
    parser.add_argument("--force", action="store_true")
    parser.add_argument("--skip-build", action="store_true")
    parser.add_argument("--force-full", action="store_true")
    parser.add_argument("--threshold", type=float, default=0.3)
    parser.add_argument("--port", type=int, default=8000)
    a = parser.parse_args(argv)
    root = Path(a.path).resolve()
    if not root.is_dir():
        print(f"{root} is no folder")
        return 1
    if a.command in ("serve", "view") and not (root / ".graphloom" / "CURRENT").exists():
        print(f"{root} has no graph: run init first")
        return 1
    spark = spark or SparkSession.builder.appName("graphloom").getOrCreate()
    if a.command == "init":
        return init(spark, root, a.indexer, a.force, a.skip_build)
    if a.command == "sync":
        return sync(spark, root, a.indexer, a.threshold, a.force_full)
    store = Store(spark, str(root / ".graphloom"))
    tools = api.Tools(store.graph(), store.search_index(), str(root))
    if a.command == "serve":
        return serve(tools)
    with server(tools, a.port) as s:
        print(f"http://127.0.0.1:{s.server_port}/api/status", flush=True)
        s.serve_forever()
    return 0
