"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (u, v); label: the smallest node reachable.

    Each round takes the smallest label among the neighbours and then that label's own label, so
    the rounds grow with the logarithm of a path's length; labels are written to the shared folder
    between rounds.  Nothing is gathered by node but a minimum, which is combined before the shuffle.
    """
    spark = edges.sparkSession
    kept = []

    def store(df: DataFrame) -> DataFrame:
        at = shared.place(spark, "components")
        df.write.parquet(at)
        kept.append(at)
        return spark.read.schema(df.schema).parquet(at)

    both = store(edges.select("u", "v").union(edges.select("v", "u")).where("u != v").distinct())
    labels = store(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label"), F.lit(True).alias("moved")))
    while labels.where("moved").limit(1).count():
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        best = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = best.join(jump, "label", "left").select("node", F.least("label", F.coalesce("next", "label")).alias("label"), "old")
        labels = store(new.select("node", "label", (F.col("label") != F.col("old")).alias("moved")))
    shared.discard(spark, *kept[:-1])
    return labels.select("node", "label")
