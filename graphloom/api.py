"""The agent-facing surface: each tool's answer as text or JSON, over a stored graph."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.scalars import bounded_int, check_offset, check_prefix, edge_text, place
from .operators import rollup, search
from .operators.graph import Graph
from .operators.search import SearchIndex
from .schema import EDGE_TYPES
from .sources import files


class NotFound(LookupError):
    """No such symbol or file: 404."""


def _rows(df) -> list[dict]:  # noqa: ANN001
    return [r.asDict(True) for r in df.collect()]  # results are under the caps of their operators


def stale_reason(root: str, path: str | None, baseline: int) -> str | None:
    """Why a file is no longer what was indexed, or None.

    Its time decides: a committed change counts too.  The state of the work tree only tells what kind of change it is.
    """
    if not path or not baseline or not root:
        return None
    try:
        if os.stat(os.path.join(root, path)).st_mtime <= baseline:
            return None
    except OSError:
        return None
    status = files.work_tree_status(root, path)
    if status == "??":
        return "untracked"
    if status and status[1] not in " ?":
        return "working_tree"
    return "staged" if status and status[0] not in " ?" else "mtime"


class Tools:
    """Answers for agents, as text.  Names are resolved to the likeliest symbol first; root is the source tree, if there is one.

    An answer about a symbol ends in a note if the symbol's file has changed since it was indexed.
    """

    #: Rows of an answer that has no limit of its own.
    MOST = 1000

    def __init__(self, graph: Graph, index: SearchIndex | None = None, root: str = ""):
        self.graph, self.index, self.root = graph, index, root

    @property
    def baseline(self) -> int:
        """When the graph was indexed, in seconds; 0 if that is not known."""
        row = self.graph.meta.where("key = 'index_timestamp'").select("value").first() if self.graph.meta is not None else None
        try:
            return int(float(row["value"])) if row else 0
        except (TypeError, ValueError):
            return 0

    def _need(self, name: str, kind: str | None = None) -> str:
        found = self.graph.resolve_one(name, kind)
        if found is None:
            raise NotFound(name)
        return found

    def _note(self, symbol: str | None = None, path: str | None = None) -> str:
        if path is None and symbol:
            row = self.graph.get_definition_location(symbol).first()
            path = row["def_file_path"] if row else None
        reason = stale_reason(self.root, path, self.baseline)
        return f"\n[stale: {path} has changed after indexing ({reason}); look at the file itself]" if reason else ""

    @staticmethod
    def _listed(rows: list[dict], with_symbol: bool = False) -> str:
        out = []
        for r in rows:
            line = r.get("def_start_line")
            at = "(external)" if line is None or line < 0 or not r.get("def_file_path") else f"{r['def_file_path']}:{line + 1}"
            out.append(f"{r['name']} [{r['kind']}]  {at}" + (f"\n    {r['signature']}" if r.get("signature") else "") + (f"\n    {r['scip_symbol']}" if with_symbol else ""))
        return "\n".join(out)

    def search_symbols(self, query: str, kind: str | None = None, limit: int = 20) -> str:
        try:
            rows = self.found(query, kind, limit)
        except ValueError as e:
            return f"not a query: {e}"
        return self._listed(rows) or f"nothing matches {query!r}"

    def found(self, query: str, kind: str | None = None, limit: int = 20) -> list[dict]:
        return _rows(search.search_symbols(self.graph.symbols, self.graph.files, query, kind, limit, self.index))

    def get_symbol(self, name: str, kind: str | None = None, limit: int = 10) -> str:
        rows = _rows(self.graph.get_symbol(name, kind, limit))
        if not rows:
            return f"no symbol is called {name!r}"
        return self._listed(rows, True) + self._note(path=rows[0]["def_file_path"])

    def find_callers(self, name: str, depth: int = 1, limit: int = 50) -> str:
        return self._edges("callers", name, self.graph.find_callers, depth, limit)

    def find_callees(self, name: str, depth: int = 1, limit: int = 50) -> str:
        return self._edges("callees", name, self.graph.find_callees, depth, limit)

    def _edges(self, what: str, name: str, f: Callable[..., DataFrame], depth: int, limit: int) -> str:
        symbol = self._need(name)
        text = edge_text(F.col("depth"), F.col("name"), F.col("edge_type"), F.col("file_path"), F.col("line"))
        rows = [r["t"] for r in f(symbol, depth, limit).select(text.alias("t")).collect()]
        return "\n".join([f"{what} of {name}, {len(rows)}:", *rows]) + self._note(symbol) if rows else f"{name} has no {what}" + self._note(symbol)

    def call_path(self, source: str, target: str, max_len: int = 10) -> str:
        a, b = self._need(source), self._need(target)
        rows = _rows(self.graph.call_path(a, b, max_len))
        lines = [f"{'  ' * r['depth']}{r['name']}" + ("" if r["line"] is None else f"  <- {r['edge_type']} at line {r['line']}") for r in rows]
        return "\n".join(lines or [f"no path of up to {max_len} calls from {source} to {target}"]) + self._note(a)

    def get_callchain(self, name: str, max_depth: int = 20) -> str:
        symbol = self._need(name)
        rows = self.graph.get_callchain(symbol, max_depth).select("name", place(F.col("file_path"), F.col("line")).alias("at")).collect()
        return "\n".join(f"{'  ' * i}{r['name']}  {r['at']}" for i, r in enumerate(rows)) + self._note(symbol)

    def find_references(self, name: str, limit: int = 100) -> str:
        symbol = self._need(name)
        rows = _rows(self.graph.find_references(symbol, limit))
        lines = [f"{r['file_path']}:{r['start_line'] + 1}:{r['start_col'] + 1}" + ("  definition" if r["is_definition"] else "") + (f"  in {r['enclosing_name']}" if r["enclosing_name"] else "") for r in rows]
        return "\n".join([f"references to {name}, {len(rows)}:", *lines]) + self._note(symbol)

    def find_type_definition(self, name: str) -> str:
        symbol = self._need(name)
        rows = [r | {"name": r["type_name"], "kind": r["type_kind"], "scip_symbol": r["type_symbol"]} for r in _rows(self.graph.find_type_definition(symbol).limit(self.MOST))]
        return (self._listed(rows, True) or f"the type of {name} is not known") + self._note(symbol)

    def get_struct_layout(self, name: str) -> str:
        symbol = self._need(name, "struct")
        row = self.graph.get_struct_layout(symbol).first().asDict(True)
        lines = [f"{f['name']} [{f['kind']}]" + (f"  {f['signature']}" if f["signature"] else "") + (f"  line {f['def_start_line'] + 1}" if (f["def_start_line"] or -1) >= 0 else "") for f in row["fields"]]
        return "\n".join([f"{row['struct_name']}, {len(lines)} fields:", *lines]) + self._note(symbol)

    def find_ops_impls(self, field: str, struct_type: str | None = None) -> str:
        rows = _rows(self.graph.find_ops_impls(field, struct_type).limit(self.MOST + 1))
        lines = [f"{r['impl_name']}  in {r['ops_name']}  {r['file_path']}:{r['line']}" for r in rows[: self.MOST]]
        if len(rows) > self.MOST:
            lines.append(f"... more than {self.MOST}")
        return "\n".join(lines) or f"no table binds {field!r}"

    def get_neighborhood(self, name: str, depth: int = 1, edge_types: str = "", summary: bool = True) -> str | dict:
        types = tuple(t.strip() for t in edge_types.split(",") if t.strip()) or None
        symbol = self._need(name)
        found = self.graph.get_neighborhood(symbol, depth, types)
        if not summary:
            return found
        names = {n["id"]: n["name"] for n in found["nodes"]}
        cut = [k for k, v in found["truncated"].items() if v]
        lines = [f"{names.get(e['src_id'])} -{e['type']}-> {names.get(e['dst_id'])}" for e in found["edges"]]
        return "\n".join([f"{len(found['nodes'])} symbols and {len(lines)} edges around {name}" + (f", cut at the cap of {' and '.join(cut)}" if cut else "") + ":", *lines]) + self._note(symbol)

    def get_function_body(self, name: str, kind: str | None = None, context: int = 0) -> str:
        """The numbered source lines of the first defined symbol of that name; of a file that has changed, what follows the name now."""
        candidates = self.graph.get_symbol(name, kind).collect()
        if not candidates:
            raise NotFound(name)
        r = next((c for c in candidates if c["def_file_path"] and c["def_start_line"] is not None and c["def_start_line"] >= 0), None)
        if r is None:
            return f"{name} is defined in no file of the tree ({candidates[0]['scip_symbol']})"
        path, head = r["def_file_path"], f"// {r['name']} [{r['kind']}]  {r['def_file_path']}:{r['def_start_line'] + 1}"
        if not os.path.isfile(os.path.join(self.root, path)):
            return f"{head}\n// {path} cannot be read under {self.root or '.'}"
        lines = files.source_lines(self.graph.spark, self.root, path)
        reason = stale_reason(self.root, path, self.baseline)
        if reason:
            live = [x["text"] for x in files.source_grep(lines, name).collect()]
            if live:
                return "\n".join([head, f"// changed after indexing ({reason}): this is the file as it is now, from the first line with the name", *live])
            head += f"\n// changed after indexing ({reason}), and the name is no longer in it: lines may be off"
        rows = files.source_range(lines, r["def_start_line"], r["def_end_line"], context).select(files.number_line(F.col("line"), F.col("text")).alias("text"))
        return "\n".join([head, *(x["text"] for x in rows.collect())])

    def index_status(self) -> dict:
        return {"metadata": {r["key"]: r["value"] for r in self.graph.get_metadata().collect()}, "edge_counts": {r["type"]: r["n"] for r in rollup.edge_counts(self.graph.edges).collect()}}


TOOLS = ("search_symbols", "get_symbol", "get_function_body", "find_callers", "find_callees", "call_path", "get_callchain", "find_references", "find_type_definition", "get_struct_layout", "find_ops_impls", "get_neighborhood", "index_status")


def call(tools: Tools, name: str, arguments: dict) -> str:
    """A tool's answer by its name; what is not known or not well asked is an answer too."""
    if name not in TOOLS:
        return f"no tool is called {name!r}"
    try:
        out = getattr(tools, name)(**arguments)
    except NotFound as e:
        return f"no symbol is called {str(e)!r}"
    except (TypeError, ValueError) as e:
        return f"not understood: {e}"
    return out if isinstance(out, str) else json.dumps(out, default=str)


def _types(text: str | None) -> tuple[str, ...] | None:
    if not text:
        return None
    types = tuple(t for t in text.split(",") if t)
    if unknown := set(types) - set(EDGE_TYPES):
        raise ValueError(f"unknown edge types {sorted(unknown)}")
    return types


def handle(tools: Tools, path: str, query: dict[str, str]) -> tuple[int, str]:
    """Status and JSON body of a read-only request."""
    graph = tools.graph
    try:
        if path.startswith("/api/"):
            path = path[4:]

        def symbol() -> str:
            found = graph.resolve_requested(query.get("scip"), query.get("name"), query.get("kind"))
            if found is None:
                raise NotFound(query.get("scip") or query.get("name") or "")
            return found

        if path == "/status":
            out: Any = tools.index_status() | {"fragment_limits": {"max_depth": 2, "max_nodes": 160, "max_edges": 360}, "global_network_limits": {"max_nodes": 100, "max_edges": 320}, "file_symbol_limits": {"max_symbols": 1000, "max_offset": 1_000_000}}
        elif path == "/body":
            out = {"body": tools.get_function_body(query.get("name", ""), query.get("kind"), bounded_int(query.get("context"), 0, 0, 200))}
        elif path == "/search":
            out = tools.found(query.get("q", ""), query.get("kind"), bounded_int(query.get("limit"), 50, 1, 1000))
        elif path == "/resolve":
            if not query.get("name"):
                raise ValueError("a name is needed")
            out = {"scip_symbol": graph.resolve_one(query["name"], query.get("kind")), "candidates": _rows(graph.get_symbol(query["name"], query.get("kind"), 10))}
        elif path == "/global-network":
            net = rollup.global_network(graph, check_prefix(query.get("prefix")), _types(query.get("edge_types")) or ("calls", "ops_bind"), query.get("include_internal") in ("1", "true"), bounded_int(query.get("max_nodes"), 100, 2, 100), bounded_int(query.get("max_edges"), 320, 1, 320))
            out = {"nodes": _rows(net.nodes), "edges": _rows(net.edges), "totals": net.totals.first().asDict()}
        elif path == "/file-symbols":
            name = check_prefix(query.get("path"))
            if not name or not graph.files.where(F.col("path") == name).limit(1).count():
                raise NotFound(name)
            out = _rows(graph.get_file_symbols(name, bounded_int(query.get("limit") or query.get("max_symbols"), 500, 1, 1000), check_offset(query.get("offset", "0"))))
        elif path in ("/neighborhood", "/fragment"):
            out = graph.get_neighborhood(symbol(), bounded_int(query.get("depth"), 1, 1, 2), _types(query.get("edge_types")), bounded_int(query.get("max_nodes"), 160, 1, 160), bounded_int(query.get("max_edges"), 360, 0, 360))
        elif path in ("/callers", "/callees"):
            f = graph.find_callers if path == "/callers" else graph.find_callees
            out = _rows(f(symbol(), bounded_int(query.get("depth"), 1, 1, 3), bounded_int(query.get("limit"), 100, 1, 500)))
        elif path == "/struct":
            out = graph.get_struct_layout(symbol()).first().asDict(True)
        elif path == "/callchain":
            out = _rows(graph.get_callchain(symbol()))
        elif path == "/ops":
            out = _rows(graph.find_ops_impls(query.get("field", ""), query.get("struct_type")).limit(Tools.MOST))
        else:
            raise NotFound(path)
    except NotFound as e:
        return 404, json.dumps({"error": f"not found: {e}"})
    except ValueError as e:
        return 400, json.dumps({"error": str(e)})
    return 200, json.dumps(out, default=str)
