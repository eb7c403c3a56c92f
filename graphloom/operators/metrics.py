"""Health checks, dashboards and evaluation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import gain, like
from .graph import Graph

#: Checks on a real index: id, and the least that is expected.
CHECKS = {"file_operations_fields": 30, "read_iter_bindings": 1, "read_iter_ext4": 1, "symbols": 400_001, "ops_bind": 5_001, "contains": 100_001, "vfs_read": 1}


def canary_checks(graph: Graph, expected: dict[str, int] | None = None) -> DataFrame:
    """(id, passed, expected, actual) of each check: two passes, one over symbols and one over edges."""
    least = CHECKS | (expected or {})
    names = graph.symbols.select(F.col("id").alias("src_id"), F.col("name").alias("src_name"))
    to = graph.symbols.select(F.col("id").alias("dst_id"), F.col("name").alias("dst_name"))
    edges = graph.edges.where(F.col("type").isin("contains", "ops_bind")).join(names, "src_id", "left").join(to, "dst_id", "left")
    bind, read = F.col("type") == "ops_bind", like(F.col("metadata"), "read_iter")
    counts = edges.agg(
        F.count_if((F.col("type") == "contains") & (F.col("src_name") == "file_operations")).alias("file_operations_fields"),
        F.count_if(bind & read).alias("read_iter_bindings"),
        F.count_if(bind & read & like(F.col("dst_name"), "ext4")).alias("read_iter_ext4"),
        F.count_if(bind).alias("ops_bind"),
        F.count_if(F.col("type") == "contains").alias("contains"),
    ).crossJoin(graph.symbols.agg(F.count(F.lit(1)).alias("symbols"), F.count_if(F.col("name") == "vfs_read").alias("vfs_read")))  # one row each
    each = F.array(*(F.struct(F.lit(k).alias("id"), (F.col(k) >= n).alias("passed"), F.lit(n).cast("long").alias("expected"), F.col(k).alias("actual")) for k, n in least.items()))
    return counts.select(F.explode(each).alias("c")).select("c.*")


def dashboard(rows: DataFrame, days: int = 7) -> DataFrame:
    """One row over the latest days: builds and benchmarks that went well, and the newest head and symbols."""
    last = rows.orderBy(F.desc("ts")).limit(days)
    return last.agg(F.count(F.lit(1)).alias("days"), F.count_if("buildable").alias("buildable"), F.count_if("benchmark_ok").alias("benchmark_ok"), F.max_by("head", "ts").alias("head"), F.max_by("symbols", "ts").alias("symbols"))


def eval_cells(runs: DataFrame) -> DataFrame:
    """model, tier, arm, f1, tokens, calls and wall of the evaluation rows that have both accuracy and cost."""
    ok = F.col("accuracy").isNotNull() & F.col("cost").isNotNull()
    if "error" in runs.columns:
        ok = ok & F.col("error").isNull()
    calls = F.aggregate(F.coalesce(F.map_values("cost.tool_calls"), F.array().cast("array<int>")), F.lit(0).cast("long"), lambda a, x: a + x)
    return runs.where(ok).select("model", "tier", "arm", F.col("accuracy.f1").alias("f1"), (F.col("cost.tokens_in") + F.col("cost.tokens_out")).alias("tokens"), calls.alias("calls"), F.col("cost.wall_seconds").alias("wall"))


MEASURES = ("f1", "tokens", "calls", "wall")


def medians(cells: DataFrame, by: tuple[str, ...] = ("model", "tier", "arm")) -> DataFrame:
    return cells.groupBy(*by).agg(*(F.median(m).alias(m) for m in MEASURES), F.count(F.lit(1)).alias("n")).orderBy(*by)


def gain_table(cells: DataFrame, arm_a: str, arm_b: str) -> DataFrame:
    """By tier, arm b against arm a: the change of f1, and of tokens and calls in per cent; tiers without either arm are left out."""
    table = cells.groupBy("tier").pivot("arm", [arm_a, arm_b]).agg(*(F.median(m).alias(m) for m in MEASURES[:3]), F.count(F.lit(1)).alias("n"))
    of = lambda arm, m: F.col(f"`{arm}_{m}`")
    change: list[Column] = [(of(arm_b, "f1") - of(arm_a, "f1")).alias("f1_change")]
    change += [gain(of(arm_b, m), of(arm_a, m)).alias(f"{m}_gain") for m in ("tokens", "calls")]
    return table.where(of(arm_a, "n").isNotNull() & of(arm_b, "n").isNotNull()).select("tier", *change, F.greatest(of(arm_a, "n"), of(arm_b, "n")).alias("n")).orderBy("tier")


def model_matrix(cells: DataFrame, arms: list[str]) -> DataFrame:
    """Median f1 and tokens by model and arm; no rows unless there are two models."""
    table = cells.groupBy("model").pivot("arm", arms).agg(F.median("f1").alias("f1"), F.median("tokens").alias("tokens"))
    several = cells.agg((F.countDistinct("model") >= 2).alias("several"))
    return table.crossJoin(F.broadcast(several)).where("several").drop("several").orderBy("model")  # one row


def rebuilt_fraction(units: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One row from (rebuilt): how many there are, their share, and whether it is too large for an incremental run."""
    share = F.when(F.count(F.lit(1)) > 0, F.count_if("rebuilt") / F.count(F.lit(1))).otherwise(0.0)
    return units.agg(F.count(F.lit(1)).alias("total"), F.count_if("rebuilt").alias("rebuilt"), share.alias("fraction"), (share > threshold).alias("refused"))
