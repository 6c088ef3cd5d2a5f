"""Consensus of several annotators by a competence-and-spamming mixture.

Each decision is either the truth, with the rater's competence as probability,
or drawn from the rater's own guess distribution.  Expectation-maximisation
finds both, the share of included items, and each item's posterior.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revisio.operators.screening import decision
from revisio.plans.lineage import written

LABELS = ("include", "exclude", "maybe")
#: The truths an item can have; "maybe" can only be a guess.
TRUTHS = ("include", "exclude")
ROUNDS = 40
CLOSE = 2e-3
SMOOTH = 0.5


def votes(screening: DataFrame, log: DataFrame) -> DataFrame:
    """``(uid, rater, label)``: one vote of each rater on each item, the latest if there are several.

    Decisions of the log count where ``screening`` has no row of that role for
    the item; the role stands for the unknown rater then.  Blank decisions and
    null items are no votes.
    """
    s = screening.select("uid", F.lower(F.trim("reviewer")).alias("role"), F.nullif(F.trim("rater"), F.lit("")).alias("rater"), decision(F.col("decision")).alias("label"), "decided_at", "vote_id")
    roles = F.array(*[F.struct(F.lit(r).alias("role"), decision(F.col(r)).alias("label")) for r in ("reviewer_1", "reviewer_2", "adjudicator")])
    more = log.select("uid", F.explode(roles).alias("r")).select("uid", "r.role", "r.label").where("label is not null").distinct()
    more = more.join(s.select("uid", "role").distinct(), ["uid", "role"], "left_anti")
    own = s.select("uid", F.coalesce("rater", F.concat(F.lit("role:"), F.coalesce("role", F.lit("?")))).alias("rater"), "label", F.struct("decided_at", "vote_id").alias("at"))
    late = F.struct(F.lit(None).cast("timestamp").alias("decided_at"), F.lit(None).cast("long").alias("vote_id"))
    both = own.unionByName(more.select("uid", F.concat(F.lit("role:"), F.col("role")).alias("rater"), "label", late.alias("at")))
    return both.where("label is not null and uid is not null").groupBy("uid", "rater").agg(F.max_by("label", "at").alias("label"))


def _posteriors(v: DataFrame, raters: DataFrame, share: float) -> DataFrame:
    """One row an item: its votes with the raters' parameters, and the posterior of inclusion."""
    guess = F.when(F.col("label") == "include", F.col("g_include")).when(F.col("label") == "exclude", F.col("g_exclude")).otherwise(F.col("g_maybe"))
    with_p = v.join(raters, "rater").select("uid", "rater", "label", "trust", guess.alias("guess"))
    lik = lambda t: F.sum(F.ln(F.when(F.col("label") == t, F.col("trust")).otherwise(0.0) + (1 - F.col("trust")) * F.col("guess")))
    items = with_p.groupBy("uid").agg(F.collect_list(F.struct("rater", "label", "trust", "guess")).alias("votes"), lik("include").alias("li"), lik("exclude").alias("le"))
    odds = F.col("le") - F.col("li") + F.ln(F.lit((1 - share) / share))
    return items.select("uid", "votes", (1 / (1 + F.exp(F.least(F.greatest(odds, F.lit(-500.0)), F.lit(500.0))))).alias("p"))


def fitted(v: DataFrame) -> tuple[DataFrame, float]:
    """The raters' parameters ``(rater, n, trust, g_include, g_exclude, g_maybe)`` and the share of included items.

    Every round is one shuffle by item and a partial aggregate by rater; a
    rater with a third of all votes is summed in parts.  Only two numbers a
    round come to the driver: the largest change and the share.  Raters meet
    votes in a join that the optimiser broadcasts if the raters are few enough.
    """
    start = [F.lit(x).alias(f"g_{y}") for x, y in zip((0.4, 0.5, 0.1), LABELS)]
    raters = written(v.groupBy("rater").agg(F.count("*").alias("n")).select("rater", "n", F.lit(0.8).alias("trust"), *start), "raters")
    share = 0.5
    for _ in range(ROUNDS):
        each = _posteriors(v, raters, share).select("p", F.size("votes").alias("k"), F.explode("votes").alias("x"))
        right = F.when(F.col("x.label") == "include", F.col("p")).when(F.col("x.label") == "exclude", 1 - F.col("p")).otherwise(0.0)
        told = right * F.col("x.trust") / (F.col("x.trust") + (1 - F.col("x.trust")) * F.col("x.guess"))
        guessed = [F.sum(F.when(F.col("x.label") == y, 1 - F.col("told")).otherwise(0.0)).alias(f"s_{y}") for y in LABELS]
        sums = each.withColumn("told", told).groupBy("x.rater").agg(F.count("*").alias("n"), F.sum("told").alias("told"), *guessed, F.sum(F.col("p") / F.col("k")).alias("inc"), F.sum(1 / F.col("k")).alias("items"))
        total = sum(F.col(f"s_{y}") for y in LABELS) + len(LABELS) * SMOOTH
        new = sums.select("rater", "n", ((F.col("told") + SMOOTH) / (F.col("n") + 2 * SMOOTH)).alias("trust"), *[((F.col(f"s_{y}") + SMOOTH) / total).alias(f"g_{y}") for y in LABELS], "inc", "items")
        new = written(new, "raters")
        seen = new.join(raters.select("rater", F.col("trust").alias("old")), "rater").agg(F.max(F.abs(F.col("trust") - F.col("old"))), F.sum("inc"), F.sum("items")).first()
        raters = new.drop("inc", "items")
        if seen[0] is None:  # no votes at all
            break
        share = min(max(seen[1] / seen[2], 1e-6), 1 - 1e-6)
        if seen[0] < CLOSE:
            break
    return raters, share


def consensus(screening: DataFrame, log: DataFrame) -> DataFrame:
    """``(uid, consensus, posterior, n_votes, agreement)`` of each item with a vote.

    ``agreement`` is the share of pairs of an item's votes that are equal, null
    for a single vote; ``consensus`` is null if both truths are equally likely.
    """
    v = written(votes(screening, log), "votes")
    raters, share = fitted(v)
    n = lambda y: F.size(F.filter("votes", lambda x: x["label"] == y))
    k = F.size("votes")
    same = sum(n(y) * (n(y) - 1) for y in LABELS)
    best = F.when(F.abs(F.col("p") - 0.5) < 1e-9, None).when(F.col("p") > 0.5, "include").otherwise("exclude")
    return _posteriors(v, raters, share).select("uid", best.alias("consensus"), F.greatest("p", 1 - F.col("p")).alias("posterior"), k.alias("n_votes"), F.when(k > 1, same / (k * (k - 1))).alias("agreement"))


def reliability(screening: DataFrame, log: DataFrame) -> DataFrame:
    """``(rater, n_votes, competence, guess_include, guess_exclude, guess_maybe)`` of each rater."""
    raters, _ = fitted(written(votes(screening, log), "votes"))
    return raters.select("rater", F.col("n").alias("n_votes"), F.col("trust").alias("competence"), *[F.col(f"g_{y}").alias(f"guess_{y}") for y in LABELS])


def unsupported(screening: DataFrame, log: DataFrame) -> DataFrame:
    """``(uid)``: items whose recorded final decision is not the consensus; open items are left out."""
    final = log.select("uid", decision(F.col("final")).alias("final")).where("final in ('include', 'exclude')").distinct()
    return final.join(consensus(screening, log), "uid").where("consensus <> final").select("uid").distinct()
