"""Helpers of the corpus operators: connected components and defined ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.plans.frames import written

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def bound_batches(spark: SparkSession, rows: int = 2000, size: int = 8 << 20) -> None:
    """Keeps Arrow batches small: the default of 10,000 long texts does not fit beside an executor's heap."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable from each node of the undirected edges (a, b).

    Alternates large and small stars (Kiveris et al., 2014): every node hands its larger, then its smaller
    neighbours to the smallest one it sees, until all hang on their root. Each step is two shuffled joins of
    edge rows with one row per node, so no neighbourhood is gathered in a task, and is written to the
    shared folder. Nodes without an edge have no row. Loops and repeated edges do no harm.
    """
    live = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    live, before = written(live), None
    for _ in range(rounds):
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        live = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        state = live.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if state == before:
            return live.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                live.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = state
    raise RuntimeError("components did not settle")
