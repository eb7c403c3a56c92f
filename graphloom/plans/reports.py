"""What is written for people: evaluation reports, baked views, daily metrics."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics, rollup
from ..operators.graph import Graph
from ..sources.files import append_metrics


def _table(rows: list[dict]) -> str:
    if not rows:
        return "no rows\n"
    columns = list(rows[0])
    show = lambda v: f"{v:.3f}" if isinstance(v, float) else "" if v is None else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(show(r[c]) for c in columns) + " |" for r in rows]) + "\n"


def eval_report(cells: DataFrame, arm_a: str, arm_b: str, folder: str) -> dict:
    """Write report.md and report.json of the evaluation: medians, gains by tier, and models if there are several."""
    rows = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731  # a row per model, tier and arm
    out = {"medians": rows(metrics.medians(cells)), "gains": rows(metrics.gain_table(cells, arm_a, arm_b)), "models": rows(metrics.model_matrix(cells, [arm_a, arm_b]))}
    at = Path(folder)
    at.mkdir(parents=True, exist_ok=True)
    (at / "report.json").write_text(json.dumps(out, indent=2))
    parts = [f"## {k}\n\n{_table(v)}" for k, v in out.items() if k != "models" or v]
    (at / "report.md").write_text("# Evaluation\n\n" + "\n".join(parts))
    return out


def bake(graph: Graph, folder: str, ops_field: str, chain_of: str, struct: str, fragment_of: str) -> list[dict]:
    """Write four views as JSON and a manifest of them: bindings of a field, a call chain, a struct's fields, a neighbourhood."""
    at = Path(folder)
    at.mkdir(parents=True, exist_ok=True)
    name = lambda n: graph.resolve_one(n) or ""
    views = {
        f"ops_{ops_field}": ("Bindings of " + ops_field, "ops", [r.asDict() for r in graph.find_ops_impls(ops_field).collect()]),
        f"callchain_{chain_of}": ("Call chain of " + chain_of, "chain", [r.asDict() for r in graph.get_callchain(name(chain_of)).collect()]),
        f"struct_{struct}": ("Fields of " + struct, "struct", [r.asDict() for r in graph.struct_fields(name(struct)).collect()]),
        f"fragment_{fragment_of}": ("Around " + fragment_of, "fragment", graph.get_neighborhood(name(fragment_of))),
    }
    manifest = []
    for key, (title, view, body) in views.items():
        (at / f"snapshot_{key}.json").write_text(json.dumps(body, indent=2, default=str))
        manifest.append({"key": key, "title": title, "view": view, "file": f"snapshot_{key}.json", "count": len(body["nodes"]) if isinstance(body, dict) else len(body)})
    (at / "manifest.json").write_text(json.dumps(manifest, indent=2))
    return manifest


def health(graph: Graph, folder: str, **facts: object) -> dict:
    """Write metrics.json of a graph, with its checks, and append its row to metrics.jsonl."""
    counts = rollup.table_counts(graph).first().asDict()
    checks = [r.asDict() for r in metrics.canary_checks(graph).collect()]
    types = {r["type"]: r["n"] for r in rollup.edge_counts(graph.edges).collect()}
    row = {"symbols": counts["symbols"], "edges": counts["edges"], "ops_bind": types.get("ops_bind", 0), "contains": types.get("contains", 0), "benchmark_pass": sum(c["passed"] for c in checks), "benchmark_total": len(checks), "benchmark_ok": all(c["passed"] for c in checks)} | facts
    at = Path(folder)
    at.mkdir(parents=True, exist_ok=True)
    (at / "metrics.json").write_text(json.dumps(row | {"counts": counts, "checks": checks}, indent=2, default=str))
    spark = graph.spark
    append_metrics(spark.range(1).select(*(F.lit(v).alias(k) for k, v in row.items())), str(at / "metrics.jsonl"))
    return row
