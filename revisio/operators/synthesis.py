"""From a table of reported effects to one result an outcome.

``effects`` has ``study, ord, outcome, measure, estimate, se, lower, upper, n_i,
n_c, sample_size``; any column may be null.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revisio.functions.effects import ATANH, LOG, LOGIT, back, usable
from revisio.operators import pooling
from revisio.plans.lineage import written

#: The measures that can be pooled, and the outcome of effects that name none.
MEASURES = (*LOG, *LOGIT, *ATANH, "SMD", "MD", "RD", "G")
UNNAMED = "Primary outcome"


def supported(measure: Column) -> Column:
    return F.upper(measure).isin(*MEASURES)


def labelled(effects: DataFrame) -> DataFrame:
    """The effects that have an estimate, each with an outcome: its own, else the one its study names first, else a default."""
    own = F.nullif(F.trim("outcome"), F.lit(""))
    first = effects.where(own.isNotNull()).groupBy("study").agg(F.min_by(own, "ord").alias("declared"))
    return effects.where("estimate is not null").join(first, "study", "left").withColumn("outcome", F.coalesce(own, "declared", F.lit(UNNAMED))).drop("declared")


def dominant(effects: DataFrame, configured: str) -> DataFrame:
    """``(outcome, measure, n)``: each outcome's most frequent measure; of equally frequent ones the configured, else the first by name."""
    n = effects.where(F.col("measure").isNotNull()).groupBy("outcome", F.upper("measure").alias("measure")).agg(F.count("*").alias("n"))
    by = F.struct(-F.col("n"), (F.col("measure") != configured.upper()).cast("int"), F.col("measure"))
    return n.groupBy("outcome").agg(F.min_by("measure", by).alias("measure"), F.max("n").alias("n"))


def analysed(effects: DataFrame, configured: str) -> DataFrame:
    """``(outcome, measure, study, ord, y, v)``: the usable effects of each outcome's dominant measure on the analysis scale."""
    e = labelled(effects).withColumn("measure", F.upper("measure"))
    u = usable(F.col("measure"), *[F.col(c).cast("double") for c in ("estimate", "se", "lower", "upper")])
    j = e.where(supported(F.col("measure"))).join(dominant(e, configured).select("outcome", "measure"), ["outcome", "measure"]).withColumn("u", u)
    return j.where("u is not null").select("outcome", "measure", "study", "ord", F.col("u.y").alias("y"), (F.col("u.se") * F.col("u.se")).alias("v"))


def participants(effects: DataFrame) -> DataFrame:
    """``(outcome, participants)``: the sum of both arms over the effects, else of the sample sizes of the studies, else null."""
    e = labelled(effects)
    arms = e.groupBy("outcome").agg(F.sum(F.col("n_i") + F.col("n_c")).alias("arms"))
    size = e.groupBy("outcome", "study").agg(F.max("sample_size").alias("s")).groupBy("outcome").agg(F.sum("s").alias("sizes"))
    return arms.join(size, "outcome").select("outcome", F.coalesce(F.when(F.col("arms") > 0, F.col("arms")), "sizes").alias("participants"))


def band(i2: Column) -> Column:
    """What a share of heterogeneity in percent is called."""
    return F.when(i2 < 40, "low").when(i2 < 60, "moderate").when(i2 < 75, "substantial").when(i2.isNotNull(), "considerable")


def primary(results: DataFrame) -> DataFrame:
    """The outcome with most studies, the first by ``ord`` of equals."""
    return results.agg(F.min_by("outcome", F.struct(-F.col("k"), F.col("ord"))).alias("outcome"))


def results(effects: DataFrame, configured: str, least: int = 2) -> DataFrame:
    """One row an outcome with at least so many usable studies, by moments.

    ``outcome, measure, k, ord, estimate, lower, upper`` (natural scale), ``tau2, q,
    i2, i2_band, significant, participants``.  Whether a result is significant is
    read on the analysis scale, where no effect is 0 for ratios too.
    """
    e = written(analysed(effects, configured), "analysed")
    first = e.groupBy("outcome").agg(F.min("ord").alias("ord"), F.first("measure").alias("measure"))
    p = pooling.random_pool(e, ["outcome"]).where(F.col("k") >= least).join(first, "outcome").join(participants(effects), "outcome", "left")
    natural = lambda c: back(F.col(c), F.col("measure"))
    return p.select(
        "outcome", "measure", "k", "ord", natural("mu").alias("estimate"), natural("lower").alias("lower"), natural("upper").alias("upper"),
        "tau2", "q", "i2", band(F.col("i2")).alias("i2_band"), ((F.col("lower") > 0) | (F.col("upper") < 0)).alias("significant"), "participants",
    )


RESULT = "k int, tau2 double, mu double, lower double, upper double, p double, pi_lower double, pi_upper double, q_p double, egger_p double, begg_p double, missing int, adjusted double, small_study boolean"


def result_of(y: np.ndarray, v: np.ndarray) -> dict[str, object]:
    """The whole analysis of one outcome: REML with the Hartung-Knapp interval from three studies on, and the tests of small-study effects."""
    r = pooling.pool_reml(y, v)
    k = len(y)
    out: dict[str, object] = {n: r[n] for n in ("k", "tau2", "mu", "p", "pi_lower", "pi_upper", "q_p")}
    out |= {"lower": r["hk_lower"] if k >= 3 else r["lower"], "upper": r["hk_upper"] if k >= 3 else r["upper"]}
    out |= {"egger_p": None, "begg_p": None, "missing": None, "adjusted": None, "small_study": None}
    if k >= 3:
        fill = pooling.trim_and_fill(y, v)
        s = np.sqrt(v)
        line = pooling.line(1 / s, y / s)
        out |= {"egger_p": line["p_intercept"], "begg_p": pooling.begg(y, v)["p"], "missing": fill["missing"], "adjusted": fill["adjusted"], "small_study": line["p_intercept"] is not None and line["p_intercept"] < 0.10}
    return out


def full_results(effects: DataFrame, configured: str) -> DataFrame:
    """:func:`result_of` of every outcome, a task an outcome's studies."""
    return pooling.by_group(analysed(effects, configured), "outcome", result_of, RESULT)


def reml_leave_one_out(y: np.ndarray, v: np.ndarray) -> dict[str, object]:
    """How far the REML pool moves if each study in turn is left out: the least and the greatest of the pools; null for fewer than three studies."""
    if len(y) < 3:
        return {"k": len(y), "least": None, "greatest": None}
    mus = [pooling.pooled(np.delete(y, i), np.delete(v, i), pooling.tau2_reml) for i in range(len(y))]
    return {"k": len(y), "least": min(mus), "greatest": max(mus)}
