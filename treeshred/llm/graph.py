"""Connected components of an edge table, by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_folder, fresh_folder


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Columns ``u`` and ``v`` of any links to rows (node, component): the smallest node reachable, for every node that has a link.

    Self links and nulls are dropped. Each round shuffles the links twice, is written to the shared folder, and the
    number of rounds grows with the logarithm of the longest chain. Only two numbers a round come to the driver.
    """
    spark = edges.sparkSession
    now = edges.select("u", "v").where("u <> v").distinct()
    mark, old = None, None
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(lowest, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), "m"), F.struct("u", "m"))).alias("e"))
        small = small.select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        path = fresh_folder(spark, "components")
        small.write.parquet(path)
        now = spark.read.schema("u long, v long").parquet(path)
        if old:
            drop_folder(spark, old)
        old, was, mark = path, mark, _mark(now)
        if mark == was:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
