"""The other inputs: compile commands, object files, source text, evaluation runs, metrics, work-tree state."""

from __future__ import annotations

import subprocess
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import object_candidates, object_path
from ..schema import COMPILE_COMMANDS


def compile_commands(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a compile database, each with its place ``n``."""
    rows = spark.read.schema(COMPILE_COMMANDS).option("multiLine", True).json(path)
    return rows.withColumn("n", F.monotonically_increasing_id())  # one file, one task: the order of the array


def object_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime) of the object files under root, relative to it; contents are not read."""
    base = root.rstrip("/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.o").load(base).select("path", "modificationTime")
    plain = F.regexp_replace("path", "^file:/*", "/")
    return rows.select(F.substring(plain, len(base) + 2, 1 << 30).alias("path"), F.col("modificationTime").cast("double").alias("mtime"))


def object_times(entries: DataFrame, objects: DataFrame) -> DataFrame:
    """entries with the mtime of their object: of its candidate paths the first that exists; null if none does."""
    where = entries.withColumn("__object", object_path(F.col("command"), F.col("arguments")))
    tried = where.select("n", F.posexplode(object_candidates(F.col("__object"))).alias("i", "path")).withColumn("path", F.regexp_replace("path", "^/+", ""))
    found = tried.join(objects, "path").groupBy("n").agg(F.min_by("mtime", "i").alias("mtime"))
    return where.join(found, "n", "left").withColumnRenamed("__object", "object")


def rebuilt(entries: DataFrame, baseline: float) -> DataFrame:
    """entries (with mtime) whose object is newer than the baseline."""
    return entries.where(F.col("mtime") > baseline)


def write_compile_commands(entries: DataFrame, path: str) -> int:
    """Write the entries as a compile database, streamed row by row; how many there were.  None writes no file."""
    columns = [c for c in ("directory", "file", "command", "arguments", "output") if c in entries.columns]
    rows = entries.orderBy("n").select(F.to_json(F.struct(*columns), {"ignoreNullFields": "true", "pretty": "true"}).alias("j"))
    n, out = 0, None
    try:
        for r in rows.toLocalIterator():
            out = out or Path(path).open("w")
            out.write(("[\n" if not n else ",\n") + "\n".join("  " + x for x in r["j"].splitlines()))
            n += 1
        if out:
            out.write("\n]\n")
    finally:
        if out:
            out.close()
    return n


def source_lines(spark: SparkSession, root: str, path: str = "**") -> DataFrame:
    """(path, line, text), lines from 0; undecodable bytes are replaced."""
    rows = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/{path}").select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("t"))
    lines = F.split(F.regexp_replace("t", "\n$", ""), "\r?\n", -1)
    return rows.select("path", F.posexplode(lines).alias("line", "text"))


def source_range(lines: DataFrame, start: int, end: int, context: int = 0) -> DataFrame:
    """The lines start..end of one file, and context around them; none if start is not one of its lines."""
    rows = lines.where((F.col("line") >= start - context) & (F.col("line") <= end + context))
    return rows.where(F.lit(start >= 0)).join(lines.where(F.col("line") == start).select("path"), "path", "left_semi").orderBy("path", "line")


def source_grep(lines: DataFrame, text: str, max_lines: int = 60) -> DataFrame:
    """The first line of each file that contains the text, and what follows, max_lines in all; numbered."""
    first = lines.where(F.contains("text", F.lit(text))).groupBy("path").agg(F.min("line").alias("first"))
    rows = lines.join(first, "path").where((F.col("line") >= F.col("first")) & (F.col("line") < F.col("first") + max_lines))
    return rows.select("path", "line", number_line(F.col("line"), F.rtrim("text")).alias("text")).orderBy("path", "line")


def number_line(line: Column, text: Column) -> Column:
    return F.concat(F.format_string("%6d", line + 1), F.lit("\t"), text)


def eval_runs(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame:
    """The runs of a folder, a JSON object a file; files that are none are left out."""
    reader = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED")
    schema = schema or "run_id string, task_id string, tier string, arm string, model string, replicate int, error string, accuracy struct<recall: double, precision: double, f1: double>, cost struct<tokens_in: long, tokens_out: long, tokens_cache: long, tool_calls: map<string, int>, wall_seconds: double>"
    return reader.schema(schema).json(f"{folder}/*.json")


METRICS = "ts string, head string, ref string, buildable boolean, benchmark_pass int, benchmark_total int, benchmark_ok boolean, symbols long, edges long, ops_bind long, contains long, db_mb double, build_s double, scip_s double, ingest_s double"


def metrics_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS).json(path).where("ts is not null")


def append_metrics(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("append").json(path)


def work_tree_status(root: str, path: str) -> str | None:
    """The two letters of a file's state in its work tree; null if it is clean or there is no work tree."""
    try:
        done = subprocess.run(["git", "status", "--porcelain", "--", path], cwd=root, capture_output=True, text=True, timeout=10)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout[:2] if done.returncode == 0 and len(done.stdout) >= 2 else None
