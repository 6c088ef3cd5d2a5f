"""A mix in which each source has its target share of the tokens.

Sizes are counts of tokens of a public tokenizer.  The largest total is taken
that all sources can serve within their repeats, in the sense of the least
distance from the targets: a source that cannot reach its share gives all it
may.  A source's budget is filled by complete epochs of all its documents and
a rest chosen by Efraimidis-Spirakis sampling: documents are sorted by
exponential keys scaled by their quality weight, and the prefix whose tokens
fit the rest is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from revisio.llm.tokens import VOCABULARY, encode_corpus
from revisio.plans.lineage import written

#: Ranges of the sampling key in which tokens are summed before documents are chosen.
SLICES = 4096
SEED = 20_240_611


def source_name(c: Column) -> Column:
    return F.nullif(F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}]+", ""), F.lit(""))


def sized(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, source, tokens, weight)`` of the documents that have tokens.

    The quality weight is the mean of the share of letters in the text and a
    length factor that tends to 1; both lie between 0 and 1.
    """
    n = encode_corpus(docs.select("doc_id", "text"), vocabulary=vocabulary).select("doc_id", F.size("ids").alias("tokens"))
    letters = F.coalesce(F.try_divide(F.length(F.regexp_replace("text", r"[^\p{L}\p{M}\s]+", "")), F.length("text")), F.lit(0.0))
    q = docs.select("doc_id", source_name(F.col("source")).alias("source"), (0.5 * letters + 0.5 * F.coalesce(F.length("text"), F.lit(0)) / (F.coalesce(F.length("text"), F.lit(0)) + 200.0)).alias("weight"))
    return n.where("tokens > 0").groupBy("doc_id").agg(F.max("tokens").alias("tokens")).join(q.groupBy("doc_id").agg(F.max("source").alias("source"), F.max("weight").alias("weight")), "doc_id")


def sampling_key(doc_id: Column, weight: Column) -> Column:
    """An exponential variate of rate ``weight`` from a hash of the id: the same in every run and partitioning."""
    u = (F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(SEED)), 11) + 0.5) / float(1 << 53)
    return -F.ln(u) / F.greatest(weight, F.lit(1e-9))


def budgets(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, target_share, have, budget, epochs, rest)`` of each source of the targets.

    The total is what the documents of the named sources hold once.  A source
    gives its share of it, or what its repeats allow; what is lost so is
    handed to sources that still have room, in proportion to their targets,
    until nothing moves.  Sources without documents get nothing; documents of
    sources without target are not used.
    """
    have = docs.groupBy("source").agg(F.sum("tokens").cast("double").alias("have"))
    t = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    t = t.where("source is not null").join(have, "source", "left").na.fill({"have": 0.0, "target_share": 0.0, "max_repeats": 1})
    # targets are one row a source; the rounds below are plain columns over that small table
    all_ = W.partitionBy(F.lit(0))
    t = t.withColumn("cap", F.col("have") * F.col("max_repeats")).withColumn("budget", F.lit(0.0)).withColumn("total", F.sum("have").over(all_))
    t = written(t, "targets")
    for _ in range(max(1, t.count())):
        open_share = F.sum(F.when(F.col("budget") < F.col("cap"), F.col("target_share")).otherwise(0.0)).over(all_)
        left = F.greatest(F.lit(0.0), F.col("total") - F.sum("budget").over(all_))
        gain = F.when((F.col("budget") < F.col("cap")) & (open_share > 0), left * F.try_divide("target_share", open_share)).otherwise(0.0)
        t = written(t.withColumn("budget", F.least("cap", F.col("budget") + gain)), "targets")
    e = F.coalesce(F.floor(F.try_divide("budget", "have") + 1e-9), F.lit(0)).cast("int")
    return t.select("source", "target_share", "have", "budget", e.alias("epochs"), F.when(F.col("have") > 0, F.col("budget") - e * F.col("have")).otherwise(0.0).alias("rest"))


def _chosen(d: DataFrame, b: DataFrame) -> DataFrame:
    """``(doc_id, source, tokens, copies)``: documents in the mix.

    The prefix sums by key are taken in two steps: tokens per slice of the
    keys' range, summed over the slices, then within the one slice of each
    source where the budget ends.  No source is ordered as a whole, so one
    with a third of all documents is no hot spot.
    """
    keyed = d.join(F.broadcast(b.select("source", "epochs", "rest")), "source").withColumn("key", sampling_key(F.col("doc_id"), F.col("weight")))
    # exponential keys by their distribution function: slices hold about equally many documents
    keyed = keyed.withColumn("slice", F.floor((1 - F.exp(-0.7 * F.col("key"))) * SLICES).cast("int"))
    per = keyed.groupBy("source", "slice").agg(F.sum("tokens").alias("n"))
    upto = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    before = per.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).select("source", "slice", "before", (F.col("before") + F.col("n")).alias("through"))
    k = keyed.join(before, ["source", "slice"])
    # whole slices below the budget, and the slice in which it ends
    edge = k.where("through > rest and before < rest")
    own = W.partitionBy("source", "slice").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    part = edge.withColumn("sum", F.col("before") + F.sum("tokens").over(own)).select("doc_id", (F.col("sum") <= F.col("rest")).alias("fits"))
    out = k.join(part, "doc_id", "left").withColumn("copies", F.col("epochs") + F.when(F.col("through") <= F.col("rest"), 1).otherwise(F.coalesce(F.col("fits").cast("int"), F.lit(0))))
    return out.where("copies > 0").select("doc_id", "source", "tokens", "copies")


def mixed(docs: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, source, tokens, copies)``: how often each document is in the mix; none more than its source's ``max_repeats``.

    Documents without tokens, without source or of a source without target are
    out.  A repeated ``doc_id`` counts once.  Within a source, keys decide;
    equal keys are ordered by id.
    """
    d = written(sized(docs, vocabulary), "sized")
    return _chosen(d, written(budgets(d, targets), "budgets"))


def shares(docs: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(source, target_share, reached_share, n_docs, tokens, most_copies)`` of each source of the targets."""
    d = written(sized(docs, vocabulary), "sized")
    b = written(budgets(d, targets), "budgets")
    got = _chosen(d, b).groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    out = b.select("source", "target_share").join(got, "source", "left").na.fill(0, ["n_docs", "tokens", "most_copies"])
    return out.select("source", "target_share", F.try_divide(F.col("tokens").cast("double"), F.sum("tokens").over(W.partitionBy(F.lit(0)))).alias("reached_share"), "n_docs", "tokens", "most_copies")
