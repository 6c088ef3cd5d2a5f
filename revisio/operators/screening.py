"""Screening: pivots of decisions, agreement, adjudication, relevance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revisio.functions.text import tokens


def decision(c: Column) -> Column:
    """The label that a spelling of a decision means; null for blank or unknown ones."""
    x = F.regexp_replace(F.lower(F.trim(c)), r"[^a-z]", "")
    return (
        F.when(x.isin("include", "included", "incl", "yes", "accept"), "include")
        .when(x.isin("exclude", "excluded", "excl", "no", "reject"), "exclude")
        .when(x.isin("maybe", "unsure", "unclear", "uncertain"), "maybe")
    )


def unit_confidence(c: Column) -> Column:
    """A confidence from 0 to 1; one above 1 is a percentage."""
    return F.when(c > 1, c / 100).otherwise(c)


def pivoted(votes: DataFrame, item: str, role: str, value: str, order: str, roles: tuple[str, ...]) -> DataFrame:
    """A row an item with the last value of each role."""
    return votes.groupBy(item).agg(*[F.max_by(F.when(F.col(role) == r, F.col(value)), F.when(F.col(role) == r, F.col(order))).alias(r) for r in roles])


def best_decision(votes: DataFrame, item: str, value: str, confidence: str, order: str) -> DataFrame:
    """The decision with the highest confidence of each item, the earliest of equals."""
    by = F.struct(F.coalesce(confidence, F.lit(float("-inf"))), -F.col(order))
    return votes.groupBy(item).agg(F.max_by(value, by).alias(value), F.max(confidence).alias(confidence))


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two columns of labels: ``n, observed, expected, kappa``.

    One row; kappa is 1 if chance agreement is complete and null without rows.
    """
    c = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).count()
    n = c.agg(F.sum("count").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("count")).otherwise(0)).alias("same"))
    pa = c.groupBy(F.col(a).alias("l")).agg(F.sum("count").alias("na"))
    pb = c.groupBy(F.col(b).alias("l")).agg(F.sum("count").alias("nb"))
    both = pa.join(pb, "l").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("cross"))
    x = n.withColumn("one", F.lit(1)).join(both.withColumn("one", F.lit(1)), "one")
    po = F.try_divide(F.col("same"), F.col("n"))
    pe = F.try_divide(F.col("cross"), F.col("n") * F.col("n"))
    return x.select(F.coalesce("n", F.lit(0)).cast("long").alias("n"), po.alias("observed"), pe.alias("expected"), F.when(pe >= 1, 1.0).otherwise(F.try_divide(po - pe, 1 - pe)).alias("kappa"))


def adjudicated(a: Column, b: Column, third: Column) -> Column:
    """Two equal clear decisions stand; else the third one; without it only two exclusions exclude."""
    clear = (a == b) & a.isin("include", "exclude")
    return F.when(clear, a).otherwise(F.coalesce(third, F.when((a == "exclude") & (b == "exclude"), "exclude").otherwise("include")))


def affinity(decision: Column, confidence: Column, text: Column, terms: tuple[str, ...]) -> Column:
    """A relevance grade from 1 to 10: from decision and confidence, or from the share of the terms in an unscreened text."""
    c = F.least(F.greatest(F.coalesce(confidence, F.lit(0.5)), F.lit(0.0)), F.lit(1.0))
    own = tokens(F.coalesce(text, F.lit("")))
    share = F.size(F.array_intersect(own, F.array(*map(F.lit, terms)))) / F.lit(float(len(terms)))
    free = F.when(F.size(own) == 0, 3.0).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(10.0), F.bround(1 + 9 * F.least(F.lit(1.0), share * 2)))))
    graded = F.when(decision == "include", F.bround(6 + 4 * c)).when(decision == "exclude", F.bround(4 - 3 * c)).when(decision == "maybe", F.bround(4 + 3 * c)).otherwise(free)
    return graded.cast("int")
