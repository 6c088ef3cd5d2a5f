"""Reading the Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of ``folder``; the scan is pruned to the columns that a query uses."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def synthetic_records(spark: SparkSession, source: str, query: str, n: int) -> DataFrame:
    """``n`` made-up records that depend on source and query alone; about one in seven repeats the DOI of the one before."""
    h = F.xxhash64(F.lit(source), F.lit(query), "id")
    again = F.pmod(h, F.lit(7)) == 0
    base = F.when(again & (F.col("id") > 0), F.col("id") - 1).otherwise(F.col("id"))
    return spark.range(n).select(
        F.col("id").alias("ord"), F.lit(source).alias("source"), F.concat(F.lit("10.5555/"), F.substring(F.sha1(F.encode(F.concat(F.lit(query), base.cast("string")), "UTF-8")), 1, 10)).alias("doi"),
        F.concat(F.lit(query + ": study "), (base + 1).cast("string")).alias("title"), (1990 + F.pmod(F.xxhash64(base), F.lit(35))).cast("int").alias("year"),
    )
