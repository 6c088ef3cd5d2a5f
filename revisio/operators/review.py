"""A review's tables joined to its outputs: who was included, why others were not, what was extracted, and whether it all adds up.

Tables: ``records`` (``uid`` and bibliographic columns), ``decisions``
(``uid, decision``), ``eligibility`` (``uid, eligible, retrieved, reason``),
``extractions`` (``uid, label, ...``), ``appraisals`` (``uid, label, overall``).
Every join is by key; small sides are left to the optimiser.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revisio.operators import flow


def included(eligibility: DataFrame, records: DataFrame) -> DataFrame:
    """The records of eligible studies, in the records' order if they have an ``ord``."""
    return records.join(eligibility.where("eligible").select("uid").distinct(), "uid")


def resolvable(ids: Column, url: Column) -> Column:
    """Whether a record can be looked up: it has an identifier or an address."""
    return (F.size(F.coalesce(ids, F.array().cast("array<string>"))) > 0) | (F.coalesce(F.trim(url), F.lit("")) != "")


def citation_gate(eligibility: DataFrame, records: DataFrame) -> DataFrame:
    """``eligibility`` in which studies that cannot be looked up are not eligible and say why; ``records`` has ``uid, resolvable``."""
    ok = records.groupBy("uid").agg(F.max("resolvable").alias("found"))
    j = eligibility.join(ok, "uid", "left")
    lost = F.col("eligible") & ~F.coalesce("found", F.lit(False))
    return j.select(*[F.when(lost, False).otherwise(F.col("eligible")).alias("eligible") if c == "eligible" else F.when(lost, "No resolvable identifier").otherwise(F.col("reason")).alias("reason") if c == "reason" else F.col(c) for c in eligibility.columns])


def with_titles(rows: DataFrame, records: DataFrame, size: int) -> DataFrame:
    """``rows`` with the first ``size`` characters of their record's title and its DOI; rows without record stay."""
    r = records.groupBy("uid").agg(F.min_by("title", "ord").alias("title"), F.min_by("doi", "ord").alias("doi"))
    return rows.join(r, "uid", "left").withColumn("title", F.left(F.coalesce("title", F.lit("")), F.lit(size)))


def status(records: DataFrame, decisions: DataFrame, eligibility: DataFrame) -> DataFrame:
    """``records`` with ``status``: included, full_text_excluded or screened_out."""
    e = eligibility.groupBy("uid").agg(F.max("eligible").alias("eligible"))
    d = decisions.where("decision = 'include'").select("uid").distinct().withColumn("kept", F.lit(True))
    s = F.when(F.col("eligible"), "included").when(F.col("kept"), "full_text_excluded").otherwise("screened_out")
    return records.join(e, "uid", "left").join(d, "uid", "left").withColumn("status", s).drop("eligible", "kept")


def excluded_with_reason(eligibility: DataFrame, records: DataFrame) -> DataFrame:
    """``(uid, title, reason)`` of full texts that were read and left out."""
    e = eligibility.where("retrieved and not eligible").select("uid", F.coalesce(F.nullif(F.trim("reason"), F.lit("")), F.lit("Other")).alias("reason"))
    return with_titles(e, records, 140).select("uid", "title", "reason")


def with_appraisal(extractions: DataFrame, appraisals: DataFrame) -> DataFrame:
    """``extractions`` with the overall judgement of their study by ``uid``, else by label (the last of several), else a dash."""
    last = lambda key: appraisals.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by("overall", "ord").alias(f"by_{key}"))
    j = extractions.join(last("uid"), "uid", "left").join(last("label"), "label", "left")
    return j.withColumn("overall", F.coalesce("by_uid", "by_label", F.lit("—"))).drop("by_uid", "by_label")


def characteristics(extractions: DataFrame, effects: DataFrame, size: int = 120) -> DataFrame:
    """One row a study: shortened fields and its first effect."""
    first = effects.groupBy("uid").agg(F.min_by(F.struct("measure", "estimate", "lower", "upper"), "ord").alias("e"), F.count("*").alias("n_effects"))
    text = [F.left(F.coalesce(c, F.lit("")), F.lit(size)).alias(c) for c, kind in extractions.dtypes if kind == "string" and c != "uid"]
    return extractions.select("uid", *text).join(first, "uid", "left").select("uid", *[c for c, k in extractions.dtypes if k == "string" and c != "uid"], "e.*", "n_effects")


def digest(effects: DataFrame, most: int = 4) -> DataFrame:
    """``(uid, line)``: a study's first effects in one line; a study's effects are few."""
    one = F.concat_ws(" ", "outcome", "measure", F.format_string("%.3f", F.col("estimate").cast("double")))
    ranked = F.slice(F.array_sort(F.collect_list(F.struct("ord", one.alias("x")))), 1, most)
    return effects.where("estimate is not null").groupBy("uid").agg(F.array_join(F.transform(ranked, lambda x: x["x"]), "; ").alias("line"))


def judgement_shares(appraisals: DataFrame) -> DataFrame:
    """``(domain, level, n, pct)``: the first judgement of each study in each domain, in percent of the studies that have the domain."""
    first = appraisals.groupBy("uid", "domain").agg(F.min_by("level", "ord").alias("level"))
    n = first.groupBy("domain", "level").agg(F.count("*").alias("n"))
    total = n.groupBy("domain").agg(F.sum("n").alias("all"))
    return n.join(total, "domain").select("domain", "level", "n", (100 * F.col("n") / F.col("all")).alias("pct"))


def strategy_hits(strategy: DataFrame, records: DataFrame) -> DataFrame:
    """``strategy`` with the number of records of each source, 0 for none."""
    n = records.groupBy("source").agg(F.count("*").alias("hits"))
    return strategy.join(n, "source", "left").na.fill(0, ["hits"])


def counts(records: DataFrame, unique: DataFrame, decisions: DataFrame, eligibility: DataFrame) -> DataFrame:
    """The fifteen counts of a flow diagram, one row.

    ``records`` has ``source``; ``unique`` has ``uid``; ``decisions`` the final
    one of each item; ``eligibility`` ``uid, eligible, retrieved``.
    """
    one = F.lit(1).alias("one")
    src = F.coalesce("source", F.lit(""))
    a = records.agg(F.count("*").alias("identified"), F.count_if(~flow.is_register(src)).alias("databases"), F.count_if(flow.is_register(src)).alias("registers"), F.count_distinct(src).alias("sources")).select(one, "*")
    b = unique.agg(F.count("*").alias("unique_records")).select(one, "*")
    d = decisions.agg(F.count("*").alias("screened"), F.count_if(F.col("decision") == "include").alias("sought"), F.count_if(F.col("decision") == "maybe").alias("unsure")).select(one, "*")
    read, yes = F.coalesce("retrieved", F.lit(False)), F.coalesce("eligible", F.lit(False))
    e = eligibility.agg(F.count_if(read).alias("assessed"), F.count_if(yes).alias("included"), F.count_if(yes & read).alias("included_read"), F.count_if(read & ~yes).alias("full_text_excluded"), F.count_if(~read).alias("not_retrieved")).select(one, "*")
    j = a.join(b, "one").join(d, "one").join(e, "one")
    return j.withColumns({"duplicates": F.col("identified") - F.col("unique_records"), "excluded": F.col("screened") - F.col("sought"), "unscreened": F.col("unique_records") - F.col("screened")}).drop("one")


#: The balance equations and cross-checks of a flow: name, both sides.
LEDGER = (
    ("identified = databases + registers", "identified", "databases + registers"),
    ("identified = unique + duplicates", "identified", "unique_records + duplicates"),
    ("unique = screened + unscreened", "unique_records", "screened + unscreened"),
    ("screened = sought + excluded", "screened", "sought + excluded"),
    ("sought = assessed + not retrieved", "sought", "assessed + not_retrieved"),
    ("assessed = included + excluded full texts", "assessed", "included_read + full_text_excluded"),
    ("included were read", "included", "included_read"),
    ("screened <= unique", "least(screened, unique_records)", "screened"),
    ("sought <= screened", "least(sought, screened)", "sought"),
    ("sources named", "least(sources, identified)", "sources"),
)


def ledger(counted: DataFrame) -> DataFrame:
    """``(check_name, lhs, rhs, passed)``, a row for each of the ten checks."""
    return flow.checks({n: (F.expr(a), F.expr(b)) for n, a, b in LEDGER}, counted)


def grounding(included_: DataFrame, extractions: DataFrame, numbered: DataFrame, forest: DataFrame, pooled: DataFrame) -> DataFrame:
    """``(check_name, lhs, rhs, passed)``: every included study is extracted, citable and numbered, and each pool rests on what it shows.

    ``lhs`` counts what is at fault and ``rhs`` is 0.  ``forest`` has ``outcome,
    uid``; ``pooled`` has ``outcome, k, lower, estimate, upper``.
    """
    missing = lambda a, b: a.select("uid").distinct().join(b.select("uid").distinct(), "uid", "left_anti")
    size = pooled.join(forest.groupBy("outcome").agg(F.count("*").alias("rows")), "outcome", "left").where("not (k <=> rows)")
    faults = {
        "included studies extracted": missing(included_, extractions), "included studies citable": included_.where("not resolvable"), "included studies numbered": missing(included_, numbered),
        "pools of two studies and more": pooled.where("k < 2"), "forest rows equal k": size, "intervals in order": pooled.where("not (lower <= estimate and estimate <= upper)"), "forest studies in the corpus": missing(forest, numbered),
    }
    rows = [d.agg(F.count("*").alias("lhs")).select(F.lit(n).alias("check_name"), "lhs", F.lit(0).cast("long").alias("rhs"), (F.col("lhs") == 0).alias("passed")) for n, d in faults.items()]
    return reduce(lambda a, b: a.unionByName(b), rows)


def report_of(checks: DataFrame) -> DataFrame:
    """``(n_checks, n_failures, passed)``."""
    return checks.agg(F.count("*").alias("n_checks"), F.count_if(~F.col("passed")).alias("n_failures"), F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"))
