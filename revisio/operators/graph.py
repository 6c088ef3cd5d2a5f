"""One hop along citations from seed records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def snowball(edges: DataFrame, seeds: DataFrame, known: DataFrame, per_seed: int) -> DataFrame:
    """``(found, n_seeds, first_seed)``: records that seeds cite or that cite seeds, known ones left out.

    ``edges`` has ``src`` and ``dst``, ``seeds`` and ``known`` have ``node``;
    a seed gives at most ``per_seed`` records a direction, the least first.
    """
    out = edges.join(seeds.withColumnRenamed("node", "src"), "src").select(F.col("src").alias("seed"), F.col("dst").alias("found"), F.lit("backward").alias("way"))
    into = edges.join(seeds.withColumnRenamed("node", "dst"), "dst").select(F.col("dst").alias("seed"), F.col("src").alias("found"), F.lit("forward").alias("way"))
    hops = out.unionByName(into).distinct()
    capped = hops.withColumn("r", F.row_number().over(W.partitionBy("seed", "way").orderBy("found"))).where(F.col("r") <= per_seed)
    new = capped.join(known.withColumnRenamed("node", "found"), "found", "left_anti")
    return new.groupBy("found").agg(F.countDistinct("seed").alias("n_seeds"), F.min("seed").alias("first_seed"))


def snowball_ordered(edges: DataFrame, seeds: DataFrame, known: DataFrame, per_seed: int, most_seeds: int, most: int) -> DataFrame:
    """``(found, seed, way, place)``: what the first ``most_seeds`` seeds lead to, each record once at its first finding, the first ``most`` of them.

    Findings are ordered by the seeds' ``ord``, what a seed cites (way 0) before
    what cites it (1), then by node.  The limits are the operator's: it serves
    a search by hand.
    """
    first = seeds.orderBy("ord", "node").limit(most_seeds).select(F.col("node").alias("seed"), F.col("ord").alias("o"))
    out = edges.join(first, edges["src"] == first["seed"]).select("seed", "o", F.lit(0).alias("way"), F.col("dst").alias("found"))
    into = edges.join(first, edges["dst"] == first["seed"]).select("seed", "o", F.lit(1).alias("way"), F.col("src").alias("found"))
    capped = out.unionByName(into).distinct().withColumn("r", F.row_number().over(W.partitionBy("seed", "way").orderBy("found"))).where(F.col("r") <= per_seed)
    new = capped.join(known.withColumnRenamed("node", "found"), "found", "left_anti")
    once = new.groupBy("found").agg(F.min(F.struct("o", "seed", "way")).alias("a")).select("found", "a.*")
    # at most so many rows are numbered
    top = once.orderBy("o", "seed", "way", "found").limit(most)
    return top.select("found", "seed", "way", F.row_number().over(W.orderBy("o", "seed", "way", "found")).cast("long").alias("place"))
