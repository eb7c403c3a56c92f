"""Dense numbers over a total order, without sorting a table in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, materialise, place

_ROWS = (1 << 33) - 1  # of a partition, in the numbers that Spark gives rows
ROWS = 1_000_000  # that a task sorts, some hundred megabytes


def ranges(df: DataFrame) -> int:
    """Into how many ranges a stored table goes: a task's memory does not grow with the table."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.count() // ROWS + 1)


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """df with ``out``: 1, 2, ... in the given order, nulls first.

    Rows go to ranges of the order, are sorted within them and counted where they lie; only one row a range,
    its size, is summed in one place, whatever the order's columns hold.  Both tables are stored: the first so that sampling
    the ranges does not derive the rows twice, and only until the second is; the second, in that order, so that numbers stay what they are.
    """
    spark, keys = df.sparkSession, [F.col(c).asc_nulls_first() for c in order]
    at = place(spark, "unnumbered")
    df.write.parquet(at)
    rows = spark.read.schema(df.schema).parquet(at)
    ranged = rows.repartitionByRange(ranges(rows), *keys).sortWithinPartitions(*keys)
    placed = materialise(ranged.withColumn("__m", F.monotonically_increasing_id()), "numbered")
    discard(spark, at)
    placed = placed.withColumn("__part", F.shiftright("__m", 33))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    rows = placed.join(F.broadcast(materialise(sizes, "sizes")), "__part")  # a row a range
    return rows.withColumn(out, F.col("__before") + F.col("__m").bitwiseAND(_ROWS) + 1).drop("__m", "__part", "__before")
