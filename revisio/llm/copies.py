"""Copies of a record that differ in formatting only.

Partitions are refined step by step: rows are first grouped by cheap
invariants of the formatting (how many letters and digits the title has, a
histogram of its letters, the length of its DOI); only rows of classes with
several members get the costlier exact key, and only they are shuffled with
their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revisio.functions.text import bare_doi
from revisio.plans.lineage import written

#: Letters whose counts are the histogram.
HISTOGRAM = "aeiorstnlu"


def stripped(c: Column) -> Column:
    """A text without ordinary white space, punctuation and case; look-alike and invisible characters stay."""
    x = F.regexp_replace(c, r"[\s\p{P}$+<=>^`|~]+", "")
    return F.translate(F.lower(F.upper(x)), "ς", "σ")


def formatting_copies(rows: DataFrame, *, id_col: str = "ord", title_col: str = "title", doi_col: str = "doi") -> DataFrame:
    """``(id, first, copies)`` of each row of a class of two or more: the class's least id and its row count.

    Rows whose title is null or has no letter or digit take no part.  A DOI
    that names no study counts as missing, and missing equals missing.  A hot
    class is counted by partial aggregates; its rows meet one class row by
    hash, so a join that is skewed can be split.
    """
    t = stripped(F.col(title_col))
    base = rows.select(F.col(id_col).alias("id"), t.alias("t"), F.coalesce(bare_doi(F.col(doi_col)), F.lit("")).alias("d")).where("t <> ''")
    counts = [F.length("t") - F.length(F.replace("t", F.lit(ch), F.lit(""))) for ch in HISTOGRAM]
    cheap = F.xxhash64(F.length("t"), F.length("d"), *counts)
    inv = base.withColumn("inv", cheap)
    several = inv.groupBy("inv").agg(F.count("*").alias("n")).where("n > 1").select("inv")
    exact = written(inv.join(several, "inv", "left_semi").select("id", F.xxhash64("t", "d").alias("a"), F.crc32(F.encode(F.concat("t", "d"), "UTF-8")).alias("b")), "copies")
    groups = exact.groupBy("a", "b").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    return exact.join(groups, ["a", "b"]).select("id", "first", "copies")


def copy_links(rows: DataFrame, **names: str) -> DataFrame:
    """``(first_ord, copy_ord)``: each row whose title and DOI an earlier row has in another or the same formatting."""
    return formatting_copies(rows, **names).where("id <> first").select(F.col("first").alias("first_ord"), F.col("id").alias("copy_ord")).distinct()


def collapsed(rows: DataFrame, **names: str) -> DataFrame:
    """``(first_ord, copies)``: one record for each class of copies and each single row that has a title."""
    title = names.get("title_col", "title")
    id_col = names.get("id_col", "ord")
    c = formatting_copies(rows, **names)
    own = rows.where(stripped(F.col(title)) != "").select(F.col(id_col).alias("id"))
    out = own.join(c, "id", "left").where("first is null or first = id")
    return out.select(F.col("id").alias("first_ord"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies")).distinct()
