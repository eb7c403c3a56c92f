"""Operator 2: line dedup by site-relative frequency, in DataFrame functions only.

Pages are grouped by host; a line is boilerplate of a host if it is on at least ``MIN_PAGES`` of its
pages and on more than ``RATIO`` of all of them.  Boilerplate lines are dropped, blank lines and the
order of the others stay.  The floor is what repetition itself needs: at 2 pages, a host's one pair of
copies would lose all its lines.

Lines shuffle as hashes, counted before the shuffle, so neither a hot host nor a hot line gathers in
one task.  The lines that pass number at most (lines a page) / RATIO for each host; they join
back as one array per host, broadcast if they are at most ``BROADCAST`` in all, else by a join on the
host, whose hot keys adaptive execution splits.

Defined cases: a null text stays null and its row counts as a page; a null host is a host of its own; white
space around a line does not tell lines apart; a line counts once a page; a page of boilerplate only keeps
its row with an empty text; repeated rows are pages of their own; a very long text is cut into lines whole, and
a line of any length is one hash; a line at exactly the ratio stays; an empty table gives no rows; other columns pass
unchanged whatever their names, and an output whose name is taken has an underscore behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

RATIO = 0.05
MIN_PAGES = 3
BROADCAST = 200_000  # (host, line) pairs: 8 bytes a line, and the hosts' names


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _key(line: Column) -> Column:
    return F.xxhash64(_bare(line))


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float, min_pages: int) -> DataFrame:
    """(host, total, lines): the pages of each host, and the hashes of its boilerplate lines, if any."""
    rows = pages.select(F.col(host).alias("host"), F.col(text).alias("text"))
    totals = rows.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    keys = F.array_distinct(F.transform(F.filter(F.split("text", "\n", -1), lambda x: _bare(x) != ""), lambda x: _key(x)))
    counts = rows.select("host", F.explode(keys).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    often = counts.join(totals.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).where(F.col("n") > ratio * F.col("total"))
    return often.groupBy("host").agg(F.collect_set("line").alias("lines"))


def dedup_lines(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """pages with text cleaned, and n_lines and n_dropped added."""
    out = _deduped(pages, host, text, ratio, min_pages)
    kept = [F.col("cleaned").alias(k) if k == text else F.col("row")[k].alias(k) for k in pages.columns]
    return out.select(*kept, *(F.col(c).alias(shared.free(c, pages.columns)) for c in ("n_lines", "n_dropped")))


def _deduped(pages: DataFrame, host: str, text: str, ratio: float, min_pages: int) -> DataFrame:
    """row, and cleaned, n_lines and n_dropped of each."""
    found = shared.materialise(boilerplate(pages, host, text, ratio, min_pages), "boilerplate")
    pairs = found.agg(F.sum(F.size("lines"))).first()[0] or 0
    side = F.broadcast(found) if pairs <= BROADCAST else found
    rows = shared.packed(pages, pages.columns)
    t = F.col("row")[text]
    joined = rows.join(side, F.col("row")[host].eqNullSafe(F.col("host")), "left")
    lines = F.split(t, "\n", -1)
    left = F.filter(lines, lambda x: ~F.array_contains("lines", _key(x)) | (_bare(x) == ""))
    out = joined.withColumn("left", F.when(F.col("lines").isNotNull(), left).otherwise(lines))
    n = F.when(t.isNull(), 0).otherwise(F.size(lines)).cast("long")
    dropped = F.when(t.isNull(), 0).otherwise(F.size(lines) - F.size("left")).cast("long")
    out = out.select("row", "left", n.alias("n_lines"), dropped.alias("n_dropped"))
    return out.withColumn("cleaned", F.when(F.col("n_dropped") > 0, F.array_join("left", "\n")).otherwise(t))


def cleaned(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """docs without boilerplate lines; n_chars follows the text."""
    out = _deduped(docs, host, text, RATIO, MIN_PAGES)
    new = {k: F.col("row")[k] for k in docs.columns} | {text: F.col("cleaned")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_dropped") > 0, F.char_length("cleaned").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("row")["n_chars"])
    return out.select(*(c.alias(k) for k, c in new.items()))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_lines(docs).select("doc_id", "source", "n_lines", "n_dropped", "text")


ORACLE_SQL = f"""
WITH pages AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
lines AS (SELECT r, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM pages),
keyed AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS k FROM lines),
totals AS (SELECT source, count(*) AS total FROM pages GROUP BY source),
often AS (SELECT c.source, c.k FROM (SELECT source, k, count(DISTINCT r) AS n FROM keyed WHERE k <> '' GROUP BY source, k) c
          JOIN totals t ON t.source IS NOT DISTINCT FROM c.source WHERE n >= {MIN_PAGES} AND n > {RATIO} * total),
marked AS (SELECT l.r, l.line, l.i, o.k IS NULL AS stays FROM keyed l LEFT JOIN often o ON o.source IS NOT DISTINCT FROM l.source AND o.k = l.k),
cleaned AS (SELECT r, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays), '') AS text FROM marked GROUP BY r)
SELECT p.doc_id, p.source, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_dropped, 0) AS n_dropped,
       CASE WHEN p.text IS NULL THEN NULL ELSE coalesce(c.text, p.text) END AS text
FROM pages p LEFT JOIN cleaned c ON c.r = p.r
"""
