"""Queries of the core operators over the tables, with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revisio.functions import effects as E
from revisio.functions.text import bare_doi, norm_title, surname
from revisio.operators import flow, graph, pooling, resolve, screening, texts
from revisio.plans.lineage import written
from revisio.sources import citations, sinks
from revisio.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

# ---- effects: nations are studies, regions outcomes, line statuses arms ----

_ARMS = """
arms AS (
  SELECT r_name AS outcome, n_name AS study, n_nationkey AS moderator,
         CAST(sum(CASE WHEN l_linestatus = 'O' AND l_quantity > 10 + s_nationkey THEN 1 ELSE 0 END) AS DOUBLE) AS a,
         CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS DOUBLE) AS n1,
         CAST(sum(CASE WHEN l_linestatus = 'F' AND l_quantity > 25 THEN 1 ELSE 0 END) AS DOUBLE) AS c,
         CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE) AS n2
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY r_name, n_name, n_nationkey)"""
_EFF = _ARMS + """,
eff AS (SELECT outcome, study, moderator, ln((a / n1) / (c / n2)) AS y, 1 / a - 1 / n1 + 1 / c - 1 / n2 AS v, n1 + n2 AS patients FROM arms WHERE a > 0 AND c > 0)"""
_FIX = _EFF + """,
fx AS (SELECT outcome, count(*) AS k, sum(y / v) / sum(1 / v) AS mu, sum(1 / v) AS sw, sum(1 / (v * v)) AS sw2 FROM eff GROUP BY outcome),
ht AS (SELECT outcome, q, k, mu, sw, CASE WHEN k > 1 THEN greatest(0, (q - (k - 1)) / (sw - sw2 / sw)) ELSE 0 END AS tau2
       FROM (SELECT outcome, sum((y - mu) * (y - mu) / v) AS q FROM eff JOIN fx USING (outcome) GROUP BY outcome) JOIN fx USING (outcome)),
rn AS (SELECT outcome, sum(y / (v + tau2)) / sum(1 / (v + tau2)) AS mu_re, 1 / sqrt(sum(1 / (v + tau2))) AS se FROM eff JOIN ht USING (outcome) GROUP BY outcome)"""


def arms(s: SparkSession, d: str) -> DataFrame:
    li, su, na, re = (table(s, d, t) for t in ("lineitem", "supplier", "nation", "region"))
    # counts per supplier first: the dimension joins see a row a supplier and threshold only
    o, f = F.col("l_linestatus") == "O", F.col("l_linestatus") == "F"
    j = li.select("l_suppkey", "l_linestatus", "l_quantity").join(su.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    n = j.groupBy("s_nationkey").agg(F.count_if(o & (F.col("l_quantity") > 10 + F.col("s_nationkey"))).alias("a"), F.count_if(o).alias("n1"), F.count_if(f & (F.col("l_quantity") > 25)).alias("c"), F.count_if(f).alias("n2"))
    n = n.join(na, F.col("s_nationkey") == F.col("n_nationkey")).join(re, F.col("n_regionkey") == F.col("r_regionkey"))
    # a row a study: written once, so that what follows does not scan the lines again for each of its sums
    return written(n.select(F.col("r_name").alias("outcome"), F.col("n_name").alias("study"), F.col("n_nationkey").alias("moderator"), *[F.col(c).cast("double") for c in ("a", "n1", "c", "n2")]), "arms")


def studies(s: SparkSession, d: str, measure: str = "RR") -> DataFrame:
    e = arms(s, d).withColumn("e", E.two_by_two(F.col("a"), F.col("n1"), F.col("c"), F.col("n2"), measure)).where("a > 0 and c > 0")
    return e.select("outcome", "study", "moderator", F.col("e.y").alias("y"), F.col("e.v").alias("v"), (F.col("n1") + F.col("n2")).alias("patients"))


def _r(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if c in names else F.col(c) for c in df.columns])


def pooled(s: SparkSession, d: str) -> DataFrame:
    """Flagship: the pooled risk ratio of each outcome and how heterogeneous it is."""
    p = pooling.random_pool(studies(s, d), ["outcome"])
    p = p.select("outcome", F.col("k").cast("long").alias("k"), F.exp("mu").alias("risk_ratio"), F.exp("lower").alias("lower"), F.exp("upper").alias("upper"), "tau2", "q", "i2")
    return _r(p, "risk_ratio", "lower", "upper", "tau2", "q", "i2", places=5)


def _two(s: SparkSession, d: str) -> DataFrame:
    """Order totals of two statuses by nation: means, deviations, numbers."""
    o, c = table(s, d, "orders"), table(s, d, "customer")
    j = o.select("o_custkey", "o_orderstatus", "o_totalprice").join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    x = lambda st: F.when(F.col("o_orderstatus") == st, F.col("o_totalprice"))
    return j.groupBy("c_nationkey").agg(*[f(x(st)).alias(f"{n}_{st}") for st in ("O", "F") for n, f in (("m", F.avg), ("s", F.stddev_samp), ("n", F.count))])


_TWO = """two AS (SELECT c_nationkey,
  avg(o_totalprice) FILTER (o_orderstatus = 'O') AS m1, stddev_samp(o_totalprice) FILTER (o_orderstatus = 'O') AS s1, CAST(count(*) FILTER (o_orderstatus = 'O') AS DOUBLE) AS n1,
  avg(o_totalprice) FILTER (o_orderstatus = 'F') AS m2, stddev_samp(o_totalprice) FILTER (o_orderstatus = 'F') AS s2, CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) AS n2
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey)"""


def effects_md(s: SparkSession, d: str) -> DataFrame:
    args = [F.col(c) for c in ("m_O", "s_O", "n_O", "m_F", "s_F", "n_F")]
    t = _two(s, d).select("c_nationkey", E.mean_difference(*args).alias("md"), E.hedges_g(*args).alias("g"))
    return _r(t.select("c_nationkey", F.col("md.y").alias("md"), F.sqrt("md.v").alias("md_se"), F.col("g.y").alias("g"), F.col("g.v").alias("g_var")), "md", "md_se", "g", "g_var", places=4)


def _by_measure(s: SparkSession, d: str) -> DataFrame:
    a = arms(s, d)
    parts = [a.select("study", F.lit(m).alias("measure"), E.two_by_two(F.col("a"), F.col("n1"), F.col("c"), F.col("n2"), m).alias("e")) for m in ("OR", "RR", "RD")]
    return _r(parts[0].unionByName(parts[1]).unionByName(parts[2]).select("study", "measure", F.col("e.y").alias("y"), F.col("e.v").alias("v")), "y", "v")


def usable_effects(s: SparkSession, d: str) -> DataFrame:
    """Line discounts as reported effects, some of them impossible on their scale."""
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_returnflag")
    m = F.when(F.col("l_returnflag") == "A", "RR").when(F.col("l_returnflag") == "N", "PROP").otherwise("MD")
    u = li.withColumn("u", E.usable(m, F.col("l_discount"), F.col("l_tax"), F.lit(None).cast("double"), F.lit(None).cast("double"))).where("u is not null")
    return _r(u.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.avg("u.y").alias("mean_y"), F.avg("u.se").alias("mean_se")), "mean_y", "mean_se")


# ---- records, screening, texts ---------------------------------------------


def _norm(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "records")
    return r.select("ord", norm_title(F.coalesce("title", F.lit(""))).alias("norm"), F.coalesce(bare_doi(F.col("doi")), F.lit("")).alias("bare"), F.coalesce(surname(F.try_element_at("authors", F.lit(1))), F.lit("")).alias("first_author"))


def flow_counts(s: SparkSession, d: str) -> DataFrame:
    r, log, ft = table(s, d, "records"), table(s, d, "screening_log"), table(s, d, "fulltext")
    fin = log.where("trim(final) <> ''").groupBy("uid").agg(F.max(F.lower(F.trim("final"))).alias("final"))
    got = ft.where("retrieved").select("uid").distinct().withColumn("got", F.lit(1))
    one = F.lit(1).alias("one")
    a = r.agg(F.count("*").alias("identified")).select(one, "*")
    b = fin.join(got, "uid", "left").agg(F.count("*").alias("screened"), F.count_if(F.col("final") == "included").alias("sought"), F.count_if((F.col("final") == "included") & F.col("got").isNotNull()).alias("assessed")).select(one, "*")
    return a.join(b, "one").select("identified", "screened", (F.col("screened") - F.col("sought")).alias("excluded"), "sought", (F.col("sought") - F.col("assessed")).alias("not_retrieved"), "assessed")


def ledger(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    return flow.checks({"screened = excluded + sought": (c("screened"), c("excluded") + c("sought")), "sought = assessed + not retrieved": (c("sought"), c("assessed") + c("not_retrieved")), "assessed <= identified": (F.least("assessed", "identified"), c("assessed"))}, flow_counts(s, d))


def kappa(s: SparkSession, d: str) -> DataFrame:
    return _r(screening.kappa(table(s, d, "screening_log").select("reviewer_1", "reviewer_2"), "reviewer_1", "reviewer_2"), "observed", "expected", "kappa", places=8)


def screen_pivot(s: SparkSession, d: str) -> DataFrame:
    return screening.pivoted(table(s, d, "screening"), "uid", "reviewer", "decision", "vote_id", ("reviewer_1", "reviewer_2", "adjudicator"))


def best_decision(s: SparkSession, d: str) -> DataFrame:
    """The surest vote of each item, whatever the spelling or the scale; votes without confidence count least."""
    v = table(s, d, "screening").withColumns({"decision": screening.decision(F.col("decision")), "confidence": screening.unit_confidence(F.col("confidence"))}).where("decision is not null")
    return screening.best_decision(v, "uid", "decision", "confidence", "vote_id")


def adjudicate(s: SparkSession, d: str) -> DataFrame:
    log = table(s, d, "screening_log").distinct()
    third = F.nullif(F.trim("adjudicator"), F.lit(""))
    return log.groupBy(screening.adjudicated(F.col("reviewer_1"), F.col("reviewer_2"), third).alias("decision")).agg(F.count("*").alias("n"))


TERMS = ("fatigue", "placebo", "sleep", "quality", "trial", "pain")


def affinity(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "records")
    g = screening.affinity(F.lit(None).cast("string"), F.lit(None).cast("double"), F.concat_ws(" ", "title", "abstract"), TERMS)
    return r.groupBy(g.alias("grade")).agg(F.count("*").alias("n"), F.sum("ord").alias("ords"))


def workbook(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "records").select("ord", "year", F.explode("found_by").alias("src"))
    return r.groupBy(F.lower(F.trim("src")).alias("src")).agg(F.count("*").alias("n"), F.count("year").alias("with_year"), F.countDistinct("ord").alias("rows"))


def numbered(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer").select("c_custkey", "c_nationkey", "c_name")
    return flow.numbered(c, ["c_nationkey", "c_name", "c_custkey"], "number").select("c_custkey", F.col("number").cast("long").alias("number"))


def audit(s: SparkSession, d: str) -> DataFrame:
    v, f = table(s, d, "screening"), table(s, d, "fulltext")
    u = flow.union_events([("screening", v.withColumn("key", F.coalesce("uid", F.lit("")))), ("fulltext", f.withColumn("key", F.coalesce("uid", F.lit(""))).withColumnRenamed("ft_id", "vote_id").withColumnRenamed("source", "decision"))], "key", "decision", "vote_id")
    return u.select("phase", "item", "detail", F.col("seq").cast("long").alias("seq"))


def anti(s: SparkSession, d: str) -> DataFrame:
    f, v = table(s, d, "fulltext").select("uid").distinct(), table(s, d, "screening_log").select("uid").distinct()
    a = v.join(f, "uid", "left_anti").withColumn("missing", F.lit("fulltext"))
    b = f.join(v, "uid", "left_anti").withColumn("missing", F.lit("screening"))
    return a.unionByName(b)


def source_cap(s: SparkSession, d: str, cap: int = 50) -> DataFrame:
    from pyspark.sql import Window as W

    r = table(s, d, "records").select("ord", "source_id", F.lower(F.trim(F.coalesce("source", F.lit("")))).alias("src"))
    first = r.groupBy("src", "source_id").agg(F.min("ord").alias("ord"))
    return first.withColumn("r", F.row_number().over(W.partitionBy("src").orderBy("ord"))).where(F.col("r") <= cap).select("src", "source_id", "ord")


def dedup_ids(s: SparkSession, d: str) -> DataFrame:
    """Clusters of records by their own DOI and PubMed number alone, the least row naming each."""
    return resolve.clusters(table(s, d, "records"), fuzzy=False).where("ord <> cluster")


def dedup_merged(s: SparkSession, d: str) -> DataFrame:
    m = resolve.deduplicated(table(s, d, "records"))
    return m.select("cluster", "base_ord", "n_records", "title", "doi", "year", "journal", F.size("found_by").alias("n_sources"))


def uids(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "records").select("ord", resolve.uid().alias("uid"))


def snowball(s: SparkSession, d: str) -> DataFrame:
    """Parts ordered together as citing each other: from the line numbered 1 to the others of its order."""
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    one, rest = li.where("l_linenumber = 1"), li.where("l_linenumber > 1")
    edges = one.select("l_orderkey", F.col("l_partkey").alias("src")).join(rest.select("l_orderkey", F.col("l_partkey").alias("dst")), "l_orderkey").select("src", "dst").distinct().where("src <> dst")
    seeds = table(s, d, "part").where("p_size = 1").select(F.col("p_partkey").alias("node"))
    return graph.snowball(edges, seeds, seeds, 5)


def deinvert(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents")
    t = texts.deinverted(texts.inverted(docs, "doc_id", "text"), "doc_id")
    return t.select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("digest"))


def match_documents(s: SparkSession, d: str) -> DataFrame:
    """Reports matched to records: by equal DOI, else by equal normalised title; the least row of several."""
    p = table(s, d, "pdf_documents").select("pdf_id", bare_doi(F.col("doi")).alias("doi"), F.nullif(norm_title(F.col("title")), F.lit("")).alias("t"))
    r = table(s, d, "records").select("ord", bare_doi(F.col("doi")).alias("doi"), F.nullif(norm_title(F.col("title")), F.lit("")).alias("t"))
    by_doi = p.join(r.where("doi is not null").groupBy("doi").agg(F.min("ord").alias("a")), "doi", "left").select("pdf_id", "t", "a")
    both = by_doi.join(r.where("t is not null").groupBy("t").agg(F.min("ord").alias("b")), "t", "left")
    return both.select("pdf_id", F.coalesce("a", "b").alias("ord"), F.when(F.col("a").isNotNull(), "doi").when(F.col("b").isNotNull(), "title").alias("how"))


def queries_text(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "mix_targets").select("source", F.array(F.array("source", F.lit("sleep quality")), F.array(F.lit("trial"))).alias("g"))
    return g.select("source", *[texts.boolean_query(F.col("g"), *f).alias(n) for n, f in texts.DIALECTS.items()])


def _meta(work: Callable, schema: str, *more: str, places: int = 6) -> Query:
    names = [c.split()[0] for c in schema.split(", ") if c.endswith("double")]
    return lambda s, d: _r(pooling.by_group(studies(s, d), "outcome", work, schema, *more), *names, places=places)


def queries() -> dict[str, Query]:
    st = studies
    return {
        "pooled_risk_ratio": pooled,
        "effects_2x2": _by_measure,
        "effects_md": effects_md,
        "usable_effects": usable_effects,
        "forest": lambda s, d: _r(pooling.forest(st(s, d), ["outcome"], "study"), "y", "lower", "upper", "weight_pct"),
        "leave_one_out": lambda s, d: _r(pooling.leave_one_out(st(s, d), ["outcome"], "study"), "mu", "se", "tau2", places=5),
        "cumulative": lambda s, d: _r(pooling.cumulative(st(s, d), ["outcome"], "study"), "mu", "se"),
        "subgroup_q": lambda s, d: _r(pooling.between(st(s, d).withColumn("all", F.lit("all")), ["all"], "outcome").select("n_groups", "q_between"), "q_between", places=4),
        "egger": lambda s, d: _r(pooling.egger(st(s, d), ["outcome"]), "intercept", "slope", "t", places=4),
        "funnel_line": lambda s, d: _r(pooling.funnel_line(st(s, d), ["outcome"]), "slope", "intercept", places=5),
        "pool_reml": _meta(pooling.pool_reml, "k int, tau2 double, mu double, se_wald double, lower double, upper double, hk_lower double, hk_upper double, p double, pi_lower double, pi_upper double, q_p double, tau2_lower double, tau2_upper double"),
        "begg": _meta(pooling.begg, "k int, tau double, p double"),
        "trim_and_fill": _meta(pooling.trim_and_fill, "k int, missing int, side string, adjusted double"),
        "meta_regression": _meta(pooling.meta_regression, "k int, intercept double, slope double, se_intercept double, se_slope double, p_slope double, tau2 double", "moderator"),
        "normalised_records": _norm,
        "flow_by_source": lambda s, d: flow.by_source(table(s, d, "records")),
        "flow_counts": flow_counts,
        "exclusion_reasons": lambda s, d: flow.reasons(table(s, d, "screening").where(screening.decision(F.col("decision")) == "exclude"), "reason"),
        "ledger_checks": ledger,
        "kappa": kappa,
        "screen_pivot": screen_pivot,
        "best_decision": best_decision,
        "adjudicate": adjudicate,
        "affinity": affinity,
        "workbook_summary": workbook,
        "citation_numbers": numbered,
        "audit_events": audit,
        "anti_checks": anti,
        "source_union_cap": source_cap,
        "dedup_merged": dedup_merged,
        "snowball": snowball,
        "deinvert": deinvert,
        "match_documents": match_documents,
        "query_translate": queries_text,
        "captions": lambda s, d: texts.captions(table(s, d, "pdf_documents"), "pdf_id", "full_text"),
        "bibtex_round_trip": lambda s, d: citations.parse_files(sinks.bibtex(table(s, d, "records").where("ord is not null"), "ord").select(F.concat(F.col("ord").cast("string"), F.lit(".bib")).alias("path"), F.col("entry").alias("text"))).select("file", "title", "doi", "year"),
    }


_DOI = r"""nullif(regexp_extract(regexp_replace(regexp_replace(lower(trim(regexp_replace(coalesce(doi, ''), '[\s ]+', ' ', 'g'))), '^(https?://[^/]*/|info:doi/|doi\s*:?\s*)+', ''), '[\s.,;]+$', ''), '^(10\.[1-9][0-9]{3,8}(\.[0-9]+)*/\S+|10\.0*[1-9][0-9]*/\S+)$', 1), '')"""
_TITLE = r"""trim(regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))"""


#: A decision's label in SQL, whatever its spelling.
_DECISION = """CASE WHEN regexp_replace(lower(trim(decision)), '[^a-z]', '', 'g') IN ('include', 'included', 'incl', 'yes', 'accept') THEN 'include' WHEN regexp_replace(lower(trim(decision)), '[^a-z]', '', 'g') IN ('exclude', 'excluded', 'excl', 'no', 'reject') THEN 'exclude' WHEN regexp_replace(lower(trim(decision)), '[^a-z]', '', 'g') IN ('maybe', 'unsure', 'unclear', 'uncertain') THEN 'maybe' END"""


def oracle_sql() -> dict[str, str]:
    final = "fin AS (SELECT uid, max(lower(trim(final))) AS final FROM screening_log WHERE trim(final) <> '' GROUP BY uid), got AS (SELECT DISTINCT uid FROM fulltext WHERE retrieved)"
    counts = f"""WITH {final}, b AS (SELECT count(*) AS screened, count(*) FILTER (final = 'included') AS sought, count(*) FILTER (final = 'included' AND got.uid IS NOT NULL) AS assessed FROM fin LEFT JOIN got USING (uid)),
      fc AS (SELECT (SELECT count(*) FROM records) AS identified, screened, screened - sought AS excluded, sought, sought - assessed AS not_retrieved, assessed FROM b)"""
    return {
        "pooled_risk_ratio": f"WITH {_FIX} SELECT outcome, CAST(k AS BIGINT) AS k, round(exp(mu_re), 5) AS risk_ratio, round(exp(mu_re - 1.959963984540054 * se), 5) AS lower, round(exp(mu_re + 1.959963984540054 * se), 5) AS upper, round(tau2, 5) AS tau2, round(q, 5) AS q, round(CASE WHEN q > 0 THEN greatest(0, (q - (k - 1)) / q * 100) ELSE 0 END, 5) AS i2 FROM ht JOIN rn USING (outcome)",
        "effects_2x2": f"""WITH {_ARMS} SELECT study, 'OR' AS measure, round(ln((a * (n2 - c)) / ((n1 - a) * c)), 6) AS y, round(1 / a + 1 / (n1 - a) + 1 / c + 1 / (n2 - c), 6) AS v FROM arms
          UNION ALL SELECT study, 'RR', round(ln((a / n1) / (c / n2)), 6), round(1 / a - 1 / n1 + 1 / c - 1 / n2, 6) FROM arms
          UNION ALL SELECT study, 'RD', round(a / n1 - c / n2, 6), round(a / n1 * (1 - a / n1) / n1 + c / n2 * (1 - c / n2) / n2, 6) FROM arms""",
        "effects_md": f"""WITH {_TWO}, x AS (SELECT *, n1 + n2 - 2 AS df, sqrt(((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2) / (n1 + n2 - 2)) AS sp FROM two),
          g AS (SELECT *, exp(lgamma(df / 2) - 0.5 * ln(df / 2) - lgamma((df - 1) / 2)) * (m1 - m2) / sp AS g FROM x)
          SELECT c_nationkey, round(m1 - m2, 4) AS md, round(sqrt(s1 * s1 / n1 + s2 * s2 / n2), 4) AS md_se, round(g, 4) AS g, round((n1 + n2) / (n1 * n2) + g * g / (2 * df), 4) AS g_var FROM g""",
        "usable_effects": """WITH u AS (SELECT l_returnflag, CASE WHEN l_returnflag = 'A' THEN CASE WHEN l_discount > 0 THEN ln(l_discount) END WHEN l_returnflag = 'N' THEN CASE WHEN l_discount > 0 AND l_discount < 1 THEN ln(l_discount / (1 - l_discount)) END ELSE l_discount END AS y,
          CASE WHEN l_returnflag = 'N' THEN CASE WHEN l_discount > 0 AND l_discount < 1 THEN l_tax / (l_discount * (1 - l_discount)) END ELSE l_tax END AS se FROM lineitem WHERE l_tax > 0)
          SELECT l_returnflag, count(*) AS n, round(avg(y), 6) AS mean_y, round(avg(se), 6) AS mean_se FROM u WHERE y IS NOT NULL AND se > 0 GROUP BY l_returnflag""",
        "forest": f"WITH {_FIX} SELECT outcome, study, round(y, 6) AS y, round(y - 1.959963984540054 * sqrt(v), 6) AS lower, round(y + 1.959963984540054 * sqrt(v), 6) AS upper, round(100 / v / sw, 6) AS weight_pct FROM eff JOIN fx USING (outcome)",
        "leave_one_out": f"""WITH {_FIX}, p AS (SELECT a.outcome, a.study, b.y, b.v FROM eff a JOIN eff b ON a.outcome = b.outcome AND a.study <> b.study JOIN fx ON fx.outcome = a.outcome AND fx.k >= 3),
          f2 AS (SELECT outcome, study, count(*) AS k, sum(y / v) / sum(1 / v) AS mu, sum(1 / v) AS sw, sum(1 / (v * v)) AS sw2 FROM p GROUP BY outcome, study),
          h2 AS (SELECT outcome, study, greatest(0, (sum((p.y - f2.mu) * (p.y - f2.mu) / p.v) - (max(k) - 1)) / (max(sw) - max(sw2) / max(sw))) AS tau2 FROM p JOIN f2 USING (outcome, study) GROUP BY outcome, study)
          SELECT outcome, study, round(sum(y / (v + tau2)) / sum(1 / (v + tau2)), 5) AS mu, round(1 / sqrt(sum(1 / (v + tau2))), 5) AS se, round(max(tau2), 5) AS tau2 FROM p JOIN h2 USING (outcome, study) GROUP BY outcome, study""",
        "cumulative": f"WITH {_EFF} SELECT outcome, study, count(*) OVER w AS k, round(sum(y / v) OVER w / sum(1 / v) OVER w, 6) AS mu, round(1 / sqrt(sum(1 / v) OVER w), 6) AS se FROM eff WINDOW w AS (PARTITION BY outcome ORDER BY study ROWS UNBOUNDED PRECEDING)",
        "subgroup_q": f"WITH {_FIX}, g AS (SELECT mu_re AS y, se * se AS v FROM rn), m AS (SELECT sum(y / v) / sum(1 / v) AS mu FROM g) SELECT count(*) AS n_groups, round(sum((y - mu) * (y - mu) / v), 4) AS q_between FROM g, m",
        "egger": f"""WITH {_EFF}, z AS (SELECT outcome, y / sqrt(v) AS snd, 1 / sqrt(v) AS prec FROM eff),
          r AS (SELECT outcome, count(*) AS k, regr_intercept(snd, prec) AS b0, regr_slope(snd, prec) AS b1, regr_sxx(snd, prec) AS sxx, regr_syy(snd, prec) AS syy, avg(prec) AS mx FROM z GROUP BY outcome HAVING count(*) >= 3)
          SELECT outcome, k, round(b0, 4) AS intercept, round(b1, 4) AS slope, round(b0 / sqrt(greatest(0, syy - b1 * b1 * sxx) / (k - 2) * (1.0 / k + mx * mx / sxx)), 4) AS t FROM r""",
        "funnel_line": f"""WITH {_EFF}, m AS (SELECT outcome, count(*) AS k, sum(sqrt(v) / v) / sum(1 / v) AS ms, sum(y / v) / sum(1 / v) AS my FROM eff GROUP BY outcome),
          x AS (SELECT outcome, max(ms) AS ms, max(my) AS my, sum((sqrt(v) - ms) * (y - my) / v) / sum((sqrt(v) - ms) * (sqrt(v) - ms) / v) AS slope FROM eff JOIN m USING (outcome) WHERE k >= 3 GROUP BY outcome)
          SELECT outcome, round(slope, 5) AS slope, round(my - slope * ms, 5) AS intercept FROM x""",
        "normalised_records": f"SELECT ord, {_TITLE} AS norm, coalesce({_DOI}, '') AS bare, coalesce(lower(regexp_split_to_array(trim(replace(authors[1], ',', ' ')), '\\s+')[1]), '') AS first_author FROM records",
        "flow_by_source": "SELECT source, count(*) AS n, regexp_matches(lower(coalesce(source, '')), 'clinicaltrials|clinical-trials|prospero|ictrp|isrctn|anzctr|drks|chictr|ctri|eudract|regist') AS register FROM records GROUP BY source",
        "flow_counts": counts + " SELECT * FROM fc",
        "exclusion_reasons": f"SELECT coalesce(nullif(trim(reason), ''), 'Other') AS reason, count(*) AS n FROM screening WHERE {_DECISION} = 'exclude' GROUP BY 1",
        "ledger_checks": counts + """ SELECT 'screened = excluded + sought' AS check_name, screened AS lhs, excluded + sought AS rhs, screened = excluded + sought AS passed FROM fc
          UNION ALL SELECT 'sought = assessed + not retrieved', sought, assessed + not_retrieved, sought = assessed + not_retrieved FROM fc
          UNION ALL SELECT 'assessed <= identified', least(assessed, identified), assessed, least(assessed, identified) = assessed FROM fc""",
        "kappa": """WITH p AS (SELECT reviewer_1 AS a, reviewer_2 AS b FROM screening_log WHERE reviewer_1 IS NOT NULL AND reviewer_2 IS NOT NULL), n AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (a = b) AS DOUBLE) AS same FROM p),
          e AS (SELECT CAST(sum(x.c * y.c) AS DOUBLE) AS cross_ FROM (SELECT a AS l, count(*) AS c FROM p GROUP BY a) x JOIN (SELECT b AS l, count(*) AS c FROM p GROUP BY b) y USING (l))
          SELECT CAST(n AS BIGINT) AS n, round(same / n, 8) AS observed, round(cross_ / (n * n), 8) AS expected, round((same / n - cross_ / (n * n)) / (1 - cross_ / (n * n)), 8) AS kappa FROM n, e""",
        "screen_pivot": "SELECT uid, arg_max(decision, vote_id) FILTER (reviewer = 'reviewer_1') AS reviewer_1, arg_max(decision, vote_id) FILTER (reviewer = 'reviewer_2') AS reviewer_2, arg_max(decision, vote_id) FILTER (reviewer = 'adjudicator') AS adjudicator FROM screening GROUP BY uid",
        "best_decision": f"SELECT uid, decision, confidence FROM (SELECT uid, vote_id, {_DECISION} AS decision, CASE WHEN confidence > 1 THEN confidence / 100 ELSE confidence END AS confidence FROM screening) WHERE decision IS NOT NULL QUALIFY row_number() OVER (PARTITION BY uid ORDER BY confidence DESC NULLS LAST, vote_id) = 1",
        "adjudicate": """SELECT CASE WHEN reviewer_1 = reviewer_2 AND reviewer_1 IN ('include', 'exclude') THEN reviewer_1 ELSE coalesce(nullif(trim(adjudicator), ''), CASE WHEN reviewer_1 = 'exclude' AND reviewer_2 = 'exclude' THEN 'exclude' ELSE 'include' END) END AS decision, count(*) AS n
          FROM (SELECT DISTINCT * FROM screening_log) GROUP BY 1""",
        "affinity": f"""WITH t AS (SELECT ord, list_distinct(list_filter(regexp_split_to_array(lower(concat_ws(' ', title, abstract)), '[^a-z0-9]+'), lambda x: length(x) > 2)) AS w FROM records)
          SELECT CAST(CASE WHEN len(w) = 0 THEN 3 ELSE greatest(1, least(10, round_even(1 + 9 * least(1.0, len(list_intersect(w, ['{"', '".join(TERMS)}'])) / CAST({len(TERMS)} AS DOUBLE) * 2), 0))) END AS INTEGER) AS grade, count(*) AS n, CAST(sum(ord) AS BIGINT) AS ords FROM t GROUP BY 1""",
        "workbook_summary": "SELECT lower(trim(src)) AS src, count(*) AS n, count(year) AS with_year, count(DISTINCT ord) AS rows FROM (SELECT ord, year, unnest(found_by) AS src FROM records) GROUP BY 1",
        "citation_numbers": "SELECT c_custkey, row_number() OVER (ORDER BY c_nationkey, c_name, c_custkey) AS number FROM customer",
        "audit_events": """SELECT phase, item, detail, row_number() OVER (PARTITION BY phase ORDER BY o, item) AS seq FROM (SELECT 'screening' AS phase, coalesce(uid, '') AS item, decision AS detail, vote_id AS o FROM screening UNION ALL SELECT 'fulltext', coalesce(uid, ''), source, ft_id FROM fulltext)""",
        "anti_checks": "SELECT DISTINCT uid, 'fulltext' AS missing FROM screening_log v WHERE NOT EXISTS (SELECT 1 FROM fulltext f WHERE f.uid = v.uid) UNION ALL SELECT DISTINCT uid, 'screening' FROM fulltext f WHERE NOT EXISTS (SELECT 1 FROM screening_log v WHERE f.uid = v.uid)",
        "source_union_cap": "SELECT src, source_id, ord FROM (SELECT lower(trim(coalesce(source, ''))) AS src, source_id, min(ord) AS ord FROM records GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY src ORDER BY ord) <= 50",
        "snowball": """WITH e AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber > 1 WHERE a.l_partkey <> b.l_partkey),
          seeds AS (SELECT p_partkey AS node FROM part WHERE p_size = 1),
          h AS (SELECT DISTINCT src AS seed, dst AS found, 'backward' AS way FROM e WHERE src IN (SELECT node FROM seeds) UNION SELECT DISTINCT dst, src, 'forward' FROM e WHERE dst IN (SELECT node FROM seeds)),
          c AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY seed, way ORDER BY found) <= 5)
          SELECT found, count(DISTINCT seed) AS n_seeds, min(seed) AS first_seed FROM c WHERE found NOT IN (SELECT node FROM seeds) GROUP BY found""",
        "deinvert": "SELECT doc_id, md5(array_to_string(list_filter(regexp_split_to_array(text, '[ \\n\\t]+'), lambda x: x <> ''), ' ')) AS digest FROM documents WHERE text IS NOT NULL AND len(list_filter(regexp_split_to_array(text, '[ \\n\\t]+'), lambda x: x <> '')) > 0",
        "match_documents": f"""WITH r AS (SELECT ord, {_DOI} AS d, nullif({_TITLE}, '') AS t FROM records), p AS (SELECT pdf_id, {_DOI} AS d, nullif({_TITLE}, '') AS t FROM pdf_documents),
          a AS (SELECT d, min(ord) AS a FROM r WHERE d IS NOT NULL GROUP BY d), b AS (SELECT t, min(ord) AS b FROM r WHERE t IS NOT NULL GROUP BY t)
          SELECT pdf_id, coalesce(a, b) AS ord, CASE WHEN a IS NOT NULL THEN 'doi' WHEN b IS NOT NULL THEN 'title' END AS how FROM p LEFT JOIN a USING (d) LEFT JOIN b USING (t)""",
        "query_translate": """SELECT source, '(' || source || '[Title/Abstract] OR "sleep quality"[Title/Abstract]) AND (trial[Title/Abstract])' AS pubmed, '(abs:' || source || ' OR abs:"sleep quality") AND (abs:trial)' AS arxiv,
          '((TITLE:' || source || ' OR ABSTRACT:' || source || ') OR (TITLE:"sleep quality" OR ABSTRACT:"sleep quality")) AND ((TITLE:trial OR ABSTRACT:trial))' AS europepmc,
          'TITLE-ABS-KEY(' || source || ' OR "sleep quality") AND TITLE-ABS-KEY(trial)' AS scopus, 'TS=(' || source || ' OR "sleep quality") AND TS=(trial)' AS wos,
          '("Abstract":' || source || ' OR "Abstract":"sleep quality") AND ("Abstract":trial)' AS ieee, '(' || source || ' OR "sleep quality") AND (trial)' AS plain FROM mix_targets""",
        "captions": f"""WITH l AS (SELECT pdf_id, unnest(string_split(full_text, chr(10))) AS line FROM pdf_documents) SELECT pdf_id, regexp_extract(line, '{texts.CAPTION}', 1) AS label, left(regexp_extract(line, '{texts.CAPTION}', 2), 300) AS caption FROM l WHERE regexp_matches(line, '{texts.CAPTION}')""",
    }
