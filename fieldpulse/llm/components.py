"""Connected components of a link table, as Spark joins (no links or labels on the driver)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def smallest_reachable(spark: SparkSession, links: DataFrame, rounds: int = 64) -> DataFrame:
    """(v, root): for each vertex of ``links`` (a, b) the smallest vertex reachable from it.

    Each round takes the smallest root among the neighbours (a partial
    aggregate, so a vertex with very many links is combined within the tasks)
    and then the root's own root, which halves the remaining distances.  Every
    round is written to the shared scratch folder, which cuts the lineage.
    """
    path = scratch_path(spark, "components")
    edges = f"{path}/edges"
    (links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
     .filter("a <> b").distinct().write.parquet(edges))
    both = spark.read.parquet(edges)
    both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("v"), F.least("a", "m").alias("root"), F.lit(True).alias("moved")).write.parquet(f"{path}/r0")
    for k in range(rounds):
        now = spark.read.parquet(f"{path}/r{k}")
        if k and not now.filter("moved").limit(1).count():
            break
        near = (both.join(now.select(F.col("v").alias("b"), F.col("root").alias("m")), "b")
                .groupBy("a").agg(F.min("m").alias("m")))
        seen = (now.select("v", F.col("root").alias("old")).join(near, now["v"] == near["a"])
                .select("v", "old", F.least("old", "m").alias("root")))
        above = now.select(F.col("v").alias("root"), F.col("root").alias("top"))
        (seen.join(above, "root", "left")
         .select("v", F.coalesce(F.least("root", "top"), "root").alias("root"), "old")
         .select("v", "root", (F.col("root") < F.col("old")).alias("moved"))
         .write.parquet(f"{path}/r{k + 1}"))
    else:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    return spark.read.parquet(f"{path}/r{k}").select("v", "root")
