"""Queries of a review's outputs, effects and texts over the tables, with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revisio.functions import effects as E
from revisio.functions import text as X
from revisio.operators import flow, pooling, resolve, review, screening, synthesis, texts
from revisio.plans import core_queries as C
from revisio.plans.lineage import written
from revisio.sources import sinks
from revisio.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
_SPACE = "regexp_replace(lower(trim({0})), '[^a-z]', '', 'g')"


def _dec(c: str) -> str:
    x = _SPACE.format(c)
    return f"CASE WHEN {x} IN ('include', 'included', 'incl', 'yes', 'accept') THEN 'include' WHEN {x} IN ('exclude', 'excluded', 'excl', 'no', 'reject') THEN 'exclude' WHEN {x} IN ('maybe', 'unsure', 'unclear', 'uncertain') THEN 'maybe' END"


def _doi(c: str) -> str:
    return C._DOI.replace("coalesce(doi, '')", f"coalesce({c}, '')")


def _own(scheme: str) -> str:
    return f"nullif(trim(ids['{scheme}']), '')"


_UID = f"""coalesce('doi:' || coalesce({_doi(_own('doi'))}, {_doi('doi')}), 'pmid:' || lower(coalesce({_own('pmid')}, nullif(trim(pmid), ''))), {', '.join(f"'{s}:' || lower({_own(s)})" for s in ('pmcid', 'arxiv', 'openalex', 's2'))},
  'sha:' || left(sha1(lower(trim(coalesce(nullif(trim(title), ''), source_id, '')))), 16))"""
_R = f"r AS (SELECT *, {_UID} AS uid FROM records)"
_FINAL = f"d AS (SELECT uid, max(x) AS decision FROM (SELECT uid, {_dec('final')} AS x FROM screening_log) WHERE x IS NOT NULL GROUP BY uid)"
_ELIG = "e AS (SELECT d.uid, coalesce(got, false) AS retrieved, coalesce(got, false) AND n > 1 AS eligible, CASE WHEN got THEN '' ELSE 'No full text' END AS reason FROM d LEFT JOIN (SELECT uid, bool_or(retrieved) AS got, count(*) AS n FROM fulltext GROUP BY uid) USING (uid) WHERE decision = 'include')".replace("n > 1", "pmc").replace("count(*) AS n", "bool_or(source = 'pmc') AS pmc")


def _records(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "records").withColumn("uid", resolve.uid())


def _decisions(s: SparkSession, d: str) -> DataFrame:
    x = screening.decision(F.col("final"))
    return table(s, d, "screening_log").select("uid", x.alias("decision")).where("decision is not null").groupBy("uid").agg(F.max("decision").alias("decision"))


def _eligibility(s: SparkSession, d: str) -> DataFrame:
    """Items that were sought; those with a full text from the archive count as eligible."""
    f = table(s, d, "fulltext").groupBy("uid").agg(F.bool_or("retrieved").alias("got"), F.bool_or(F.col("source") == "pmc").alias("pmc"))
    j = _decisions(s, d).where("decision = 'include'").join(f, "uid", "left")
    got = F.coalesce("got", F.lit(False))
    return j.select("uid", got.alias("retrieved"), F.coalesce(got & F.col("pmc"), F.lit(False)).alias("eligible"), F.when(got, "").otherwise("No full text").alias("reason"))


def _counts(s: SparkSession, d: str) -> DataFrame:
    r = _records(s, d)
    return review.counts(r, r.select("uid").distinct(), _decisions(s, d), _eligibility(s, d))


_COUNTS = f"""{_R}, {_FINAL}, {_ELIG}, cnt AS (SELECT a.*, b.*, c.*, x.*, identified - unique_records AS duplicates, screened - sought AS excluded, unique_records - screened AS unscreened FROM
  (SELECT count(*) AS identified, count(*) FILTER (NOT reg) AS databases, count(*) FILTER (reg) AS registers, count(DISTINCT src) AS sources FROM (SELECT coalesce(source, '') AS src, regexp_matches(lower(coalesce(source, '')), 'clinicaltrials|clinical-trials|prospero|ictrp|isrctn|anzctr|drks|chictr|ctri|eudract|regist') AS reg FROM r)) a,
  (SELECT count(DISTINCT uid) AS unique_records FROM r) b,
  (SELECT count(*) AS screened, count(*) FILTER (decision = 'include') AS sought, count(*) FILTER (decision = 'maybe') AS unsure FROM d) c,
  (SELECT count(*) FILTER (retrieved) AS assessed, count(*) FILTER (eligible) AS included, count(*) FILTER (eligible AND retrieved) AS included_read, count(*) FILTER (retrieved AND NOT eligible) AS full_text_excluded, count(*) FILTER (NOT retrieved) AS not_retrieved FROM e) x)"""


def _ledger_sql() -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS check_name, CAST({a} AS BIGINT) AS lhs, CAST({b} AS BIGINT) AS rhs, ({a}) = ({b}) AS passed FROM cnt" for n, a, b in review.LEDGER)


def _extractions(s: SparkSession, d: str) -> DataFrame:
    """Full texts as extractions: the newest row of each item, labelled with its source."""
    return table(s, d, "fulltext").groupBy("uid").agg(F.max_by("source", "ft_id").alias("label"), F.max_by(F.coalesce("text", F.lit("")), "ft_id").alias("text"), F.max("ft_id").alias("ord"))


def _appraisals(s: SparkSession, d: str) -> DataFrame:
    """Votes as judgements: a role is a domain, a decision a level."""
    return table(s, d, "screening").select("uid", F.col("reviewer").alias("domain"), screening.decision(F.col("decision")).alias("level"), F.col("vote_id").alias("ord")).where("level is not null")


_APPR = f"ap AS (SELECT * FROM (SELECT uid, reviewer AS domain, {_dec('decision')} AS level, vote_id AS ord FROM screening) WHERE level IS NOT NULL)"


def effects_table(s: SparkSession, d: str) -> DataFrame:
    """Effects of mixed measures: nations are studies, regions outcomes (some unnamed), the measure goes by the nation's number."""
    a = C.arms(s, d)
    k = F.col("moderator")
    m = F.when(k % 5 == 0, "OR").when(k % 7 == 0, "XX").otherwise("RR")
    rr, odds = (E.two_by_two(F.col("a"), F.col("n1"), F.col("c"), F.col("n2"), x) for x in ("RR", "OR"))
    e = F.when(m == "OR", odds).otherwise(rr)
    return written(a.select(F.col("study"), k.alias("ord"), F.when(k % 6 == 0, F.lit(None)).otherwise(F.col("outcome")).alias("outcome"), m.alias("measure"), F.exp(e["y"]).alias("estimate"), F.sqrt(e["v"]).alias("se"), F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper"), F.when(k % 4 > 0, F.col("n1")).alias("n_i"), F.col("n2").alias("n_c"), (F.col("n1") + 1).alias("sample_size")), "effects")


_EFFECTS = C._ARMS + """,
et0 AS (SELECT study, moderator AS ord, CASE WHEN moderator % 6 <> 0 THEN outcome END AS outcome, CASE WHEN moderator % 5 = 0 THEN 'OR' WHEN moderator % 7 = 0 THEN 'XX' ELSE 'RR' END AS measure,
  CASE WHEN moderator % 5 = 0 THEN ln(a * (n2 - c) / ((n1 - a) * c)) ELSE ln((a / n1) / (c / n2)) END AS y, CASE WHEN moderator % 5 = 0 THEN 1 / a + 1 / (n1 - a) + 1 / c + 1 / (n2 - c) ELSE 1 / a - 1 / n1 + 1 / c - 1 / n2 END AS v,
  CASE WHEN moderator % 4 > 0 THEN n1 END AS n_i, n2 AS n_c, n1 + 1 AS sample_size FROM arms),
et AS (SELECT * REPLACE (coalesce(outcome, 'Primary outcome') AS outcome) FROM et0),
dm AS (SELECT outcome, measure, n FROM (SELECT outcome, measure, count(*) AS n FROM et GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY outcome ORDER BY n DESC, (measure <> 'OR')::INT, measure) = 1),
ana AS (SELECT et.* FROM et JOIN dm USING (outcome, measure) WHERE measure IN ('OR', 'RR')),
pa AS (SELECT outcome, coalesce(sum(n_i + n_c), sum(sample_size)) AS participants FROM et GROUP BY outcome),
af AS (SELECT outcome, count(*) AS k, min(ord) AS ord, max(measure) AS measure, sum(y / v) / sum(1 / v) AS mu, sum(1 / v) AS sw, sum(1 / (v * v)) AS sw2 FROM ana GROUP BY outcome),
ah AS (SELECT outcome, max(k) AS k, max(af.ord) AS ord, max(af.measure) AS measure, sum((y - mu) * (y - mu) / v) AS q, max(sw) AS sw, max(sw2) AS sw2 FROM ana JOIN af USING (outcome) GROUP BY outcome),
att AS (SELECT *, CASE WHEN k > 1 THEN greatest(0, (q - (k - 1)) / (sw - sw2 / sw)) ELSE 0 END AS tau2, CASE WHEN q > 0 THEN greatest(0, (q - (k - 1)) / q * 100) ELSE 0 END AS i2 FROM ah),
ar AS (SELECT outcome, sum(y / (v + tau2)) / sum(1 / (v + tau2)) AS mu, 1 / sqrt(sum(1 / (v + tau2))) AS se FROM ana JOIN att USING (outcome) GROUP BY outcome)"""
_Z = "1.959963984540054"
_RESULTS = f"""{_EFFECTS}, res AS (SELECT outcome, measure, CAST(k AS BIGINT) AS k, ord, round(exp(mu), 5) AS estimate, round(exp(mu - {_Z} * se), 5) AS lower, round(exp(mu + {_Z} * se), 5) AS upper, round(tau2, 5) AS tau2, round(q, 5) AS q, round(i2, 5) AS i2,
  CASE WHEN i2 < 40 THEN 'low' WHEN i2 < 60 THEN 'moderate' WHEN i2 < 75 THEN 'substantial' ELSE 'considerable' END AS i2_band, (mu - {_Z} * se > 0 OR mu + {_Z} * se < 0) AS significant, participants FROM att JOIN ar USING (outcome) LEFT JOIN pa USING (outcome) WHERE k >= 2)"""


def _results(s: SparkSession, d: str) -> DataFrame:
    return written(C._r(synthesis.results(effects_table(s, d), "OR").withColumn("k", F.col("k").cast("long")), "estimate", "lower", "upper", "tau2", "q", "i2", places=5), "results")


def effect_forms(s: SparkSession, d: str) -> DataFrame:
    """Effects of one study in other forms: log odds with a half, logit proportion, Fisher's z, the direct g, deviations from errors and intervals."""
    a, c, n1, n2 = (F.col(x) for x in ("a", "c", "n1", "n2"))
    two = C._two(s, d).select(F.col("c_nationkey").alias("moderator"), *[F.col(f"{x}_{y}") for x in "msn" for y in "OF"])
    j = C.arms(s, d).join(two, "moderator")
    g = E.hedges_g_direct(*[F.col(x) for x in ("m_O", "s_O", "n_O", "m_F", "s_F", "n_F")])
    half, logit, z = E.log_odds_half(a, n1 - a, c, n2 - c), E.logit_proportion(a, n1), E.fisher_z(a / n1, n1)
    out = j.select("study", half["y"].alias("half_y"), half["v"].alias("half_v"), logit["y"].alias("logit_y"), logit["v"].alias("logit_v"), z["y"].alias("z_y"), z["v"].alias("z_v"), g["y"].alias("g_y"), g["v"].alias("g_v"), E.sd_from_se(F.col("s_O") / F.sqrt("n_O"), F.col("n_O")).alias("sd_se"), E.sd_from_ci(F.col("m_O") - 2, F.col("m_O") + 2, F.col("n_O")).alias("sd_ci"))
    return C._r(out, *out.columns[1:], places=4)


def recomputed(s: SparkSession, d: str) -> DataFrame:
    """The best effect that each study's data give: some lack counts, some deviations, some all but an interval."""
    two = C._two(s, d).select(F.col("c_nationkey").alias("moderator"), *[F.col(f"{x}_{y}") for x in "msn" for y in "OF"])
    j = C.arms(s, d).join(two, "moderator")
    k = F.col("moderator")
    m = F.when(k % 3 == 0, "OR").when(k % 3 == 1, "MD").otherwise("SMD")
    row = {"a": F.when(k % 2 == 0, F.col("a")), "c": F.col("c"), "n1": F.when(m == "OR", F.col("n1")).otherwise(F.col("n_O")), "n2": F.when(m == "OR", F.col("n2")).otherwise(F.col("n_F")), "m1": F.when(k % 4 > 0, F.col("m_O")), "m2": F.col("m_F"), "s1": F.when(k % 5 > 0, F.col("s_O")), "s2": F.col("s_F"), "estimate": F.lit(1.5), "lower": F.lit(1.2), "upper": F.lit(1.875)}
    out = j.select("study", m.alias("measure"), E.recomputed(row, m).alias("e")).select("study", "measure", F.col("e.y").alias("y"), F.col("e.v").alias("v"), F.col("e.provenance").alias("provenance"))
    return C._r(out, "y", "v", places=4)


def _i2(s: SparkSession, d: str) -> DataFrame:
    t = pooling.i2_interval(C.studies(s, d), ["outcome"]).select("outcome", "i2", "h", "i2_lower", "i2_upper")
    return C._r(t, "i2", "h", "i2_lower", "i2_upper", places=3)


_I2 = f"""WITH {C._FIX}, x AS (SELECT outcome, k, q, CASE WHEN q > 0 THEN greatest(0, (q - (k - 1)) / q * 100) ELSE 0 END AS i2, CASE WHEN k > 1 THEN sqrt(greatest(q / (k - 1), 1)) ELSE 1 END AS h FROM ht),
  y AS (SELECT *, CASE WHEN k < 3 OR q <= 0 THEN NULL WHEN q > k THEN (ln(q) - ln(k - 1)) / (2 * (sqrt(2 * q) - sqrt(2.0 * k - 3))) ELSE sqrt(1 / (2.0 * (k - 2)) * (1 - 1 / (3 * pow(k - 2, 2)))) END AS se FROM x WHERE k >= 1)
  SELECT outcome, round(i2, 3) AS i2, round(h, 3) AS h, CASE WHEN k >= 3 AND q > 0 THEN round(greatest(0, 100 * (1 - exp(-2 * (ln(h) - {_Z} * se)))), 3) END AS i2_lower, CASE WHEN k >= 3 AND q > 0 THEN round(greatest(0, 100 * (1 - exp(-2 * (ln(h) + {_Z} * se)))), 3) END AS i2_upper FROM y"""

_REML = f"""WITH RECURSIVE {C._EFF}, l AS (SELECT outcome, list(y ORDER BY study) AS ys, list(v ORDER BY study) AS vs FROM eff GROUP BY outcome),
  it(outcome, ys, vs, t, n) AS (SELECT outcome, ys, vs, CAST(CASE WHEN len(ys) > 1 THEN 0.01 ELSE 0 END AS DOUBLE), 0 FROM l UNION ALL
    SELECT outcome, ys, vs, greatest(CAST(0 AS DOUBLE), list_sum(list_transform(range(1, len(ys) + 1), lambda i: ((ys[i] - mu) * (ys[i] - mu) - vs[i]) / ((vs[i] + t) * (vs[i] + t)))) / list_sum(list_transform(vs, lambda x: 1 / ((x + t) * (x + t)))) + 1 / list_sum(list_transform(vs, lambda x: 1 / (x + t)))), n + 1
    FROM (SELECT *, list_sum(list_transform(range(1, len(ys) + 1), lambda i: ys[i] / (vs[i] + t))) / list_sum(list_transform(vs, lambda x: 1 / (x + t))) AS mu FROM it) WHERE n < 1500)
  SELECT outcome, len(ys) AS k, round(t, 5) AS tau2, round(list_sum(list_transform(range(1, len(ys) + 1), lambda i: ys[i] / (vs[i] + t))) / list_sum(list_transform(vs, lambda x: 1 / (x + t))), 5) AS mu, round(1 / sqrt(list_sum(list_transform(vs, lambda x: 1 / (x + t)))), 5) AS se FROM it WHERE n = 1500"""
_TAU = f"""WITH {C._FIX}, z AS (SELECT outcome, study, (y - mu) / sqrt(v - 1 / sw) AS d, v FROM eff JOIN fx USING (outcome)),
  p AS (SELECT a.outcome, sign(a.d - b.d) * sign(a.v - b.v) AS s, (a.d = b.d)::INT AS td, (a.v = b.v)::INT AS tv FROM z a JOIN z b ON a.outcome = b.outcome AND a.study < b.study)
  SELECT outcome, tau FROM (SELECT DISTINCT outcome FROM eff) LEFT JOIN (SELECT p.outcome, round(sum(s) / sqrt((count(*) - sum(td)) * (count(*) - sum(tv))), 6) AS tau FROM p JOIN fx USING (outcome) WHERE k >= 3 GROUP BY p.outcome) USING (outcome)"""


def text_forms(s: SparkSession, d: str) -> DataFrame:
    """Titles and names of records in the forms that outputs need."""
    t, a = F.coalesce("title", F.lit("")), F.coalesce(F.try_element_at("authors", F.lit(1)), F.lit(""))
    return table(s, d, "records").select(
        "ord", X.ascii_fold(a).alias("folded"), X.slug(t).alias("slug"), X.words_only(t).alias("words"), X.html_escaped(t).alias("html"), X.latex_escaped(t).alias("latex"), X.leading_year(F.col("retrieval_date")).alias("year"), X.squeeze(X.blank_to_null(F.col("journal"))).alias("journal"), X.year_in(F.col("raw")).alias("raw_year"), F.size(X.other_ids(F.coalesce("ids", F.create_map().cast("map<string,string>")), "doi", "pmid")).alias("n_other"), F.array_join("found_by", "; ").alias("found_by"),
    )


_TEXT = r"""SELECT ord, regexp_replace(strip_accents(coalesce(authors[1], '')), '[^\x00-\x7f]', '', 'g') AS folded,
  coalesce(nullif(regexp_replace(left(regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', '-', 'g'), '^-+', ''), 48), '-+$', ''), ''), 'review') AS slug, trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', ' ', 'g')) AS words,
  replace(replace(replace(replace(coalesce(title, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS html,
  replace(replace(replace(regexp_replace(replace(coalesce(title, ''), '\', chr(1)), '([&%$#_{}])', '\\\1', 'g'), '~', '\textasciitilde{}'), '^', '\textasciicircum{}'), chr(1), '\textbackslash{}') AS latex,
  TRY_CAST(left(retrieval_date, 4) AS INTEGER) AS year, trim(regexp_replace(CASE WHEN trim(journal) <> '' THEN journal END, '\s+', ' ', 'g')) AS journal, CAST(nullif(regexp_extract(raw, '((?:19|20)[0-9]{2})', 1), '') AS INTEGER) AS raw_year,
  CAST(len(list_filter(map_entries(coalesce(ids, MAP {})), lambda x: x.key NOT IN ('doi', 'pmid') AND x.value <> '')) AS INTEGER) AS n_other, array_to_string(found_by, '; ') AS found_by FROM records"""


def _styles(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "records")
    args = [F.coalesce("authors", F.array().cast("array<string>")), F.col("year"), F.coalesce("title", F.lit("")), F.coalesce("journal", F.lit(""))]
    return r.select("ord", *[sinks.citation(*args, style=x, number=F.col("ord")).alias(x) for x in ("numeric", "vancouver", "apa", "harvard")])


_NAMES = "array_to_string(coalesce(authors, [])[1:6], ', ') || CASE WHEN len(coalesce(authors, [])) > 6 THEN ', et al' ELSE '' END"
_STYLES = f"""WITH x AS (SELECT ord, {_NAMES} AS n, coalesce(CAST(year AS VARCHAR), 'n.d.') AS y, coalesce(title, '') AS t, coalesce(journal, '') AS j FROM records)
  SELECT ord, n || '. ' || t || '. ' || j || '. ' || y || '.' AS numeric, ord || '. ' || n || '. ' || t || '. ' || j || '. ' || y || '.' AS vancouver, n || ' (' || y || '). ' || t || '. ' || j || '.' AS apa, n || ' ' || y || '. ‘' || t || '’, ' || j || '.' AS harvard FROM x""".replace("\\u2018", "‘").replace("\\u2019", "’")


def translated(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "mix_targets").select("source", F.array(F.array("source", F.lit("sleep quality")), F.array(F.lit("trial"))).alias("g"), F.when(F.length("source") % 2 == 0, 2010).alias("a"), F.when(F.length("source") % 3 == 0, 2020).alias("b"))
    return g.select("source", *[texts.dated_query(n, F.lit("q"), F.col("a"), F.col("b")).alias(n) for n in texts.DIALECTS])


_DATED = """WITH g AS (SELECT source, CASE WHEN length(source) % 2 = 0 THEN 2010 END AS a, CASE WHEN length(source) % 3 = 0 THEN 2020 END AS b FROM mix_targets)
  SELECT source, 'q' || CASE WHEN a IS NULL AND b IS NULL THEN '' ELSE ' AND ("' || coalesce(a::VARCHAR, '1800') || '"[Date - Publication] : "' || coalesce(b::VARCHAR, '3000') || '"[Date - Publication])' END AS pubmed,
  'q' || CASE WHEN a IS NULL AND b IS NULL THEN '' ELSE ' AND (PUB_YEAR:[' || coalesce(a::VARCHAR, '1800') || ' TO ' || coalesce(b::VARCHAR, '3000') || '])' END AS europepmc,
  'q' || coalesce(' AND PUBYEAR > ' || (a - 1), '') || coalesce(' AND PUBYEAR < ' || (b + 1), '') AS scopus, 'q' || CASE WHEN a IS NULL AND b IS NULL THEN '' ELSE ' AND PY=(' || coalesce(a::VARCHAR, '1800') || '-' || coalesce(b::VARCHAR, '3000') || ')' END AS wos, 'q' AS arxiv, 'q' AS ieee, 'q' AS plain FROM g"""


def _grounding(s: SparkSession, d: str) -> DataFrame:
    r = _records(s, d)
    inc = written(review.included(_eligibility(s, d), r).select("uid", review.resolvable(resolve.id_keys(), F.col("url")).alias("resolvable")), "included")
    pool = _results(s, d)
    fx = written(synthesis.analysed(effects_table(s, d), "OR").join(pool.select("outcome"), "outcome", "left_semi"), "forest")
    forest = fx.select("outcome", F.col("study").alias("uid"))
    return review.grounding(inc, _extractions(s, d), r.select("uid").unionByName(forest.select("uid")), forest, pool)


_GROUND = f"""WITH {_R}, {_FINAL}, {_ELIG}, i AS (SELECT r.* FROM r JOIN (SELECT DISTINCT uid FROM e WHERE eligible) USING (uid)), {_RESULTS},
  f AS (SELECT ana.outcome, study AS uid FROM ana JOIN res USING (outcome)), c(check_name, lhs) AS (
  SELECT 'included studies extracted', count(DISTINCT uid) FROM i WHERE uid NOT IN (SELECT uid FROM fulltext) UNION ALL SELECT 'included studies citable', count(*) FROM i WHERE uid LIKE 'sha:%' AND coalesce(trim(url), '') = ''
  UNION ALL SELECT 'included studies numbered', 0 UNION ALL SELECT 'pools of two studies and more', count(*) FROM res WHERE k < 2 UNION ALL SELECT 'forest rows equal k', count(*) FROM res WHERE k <> (SELECT count(*) FROM f WHERE f.outcome = res.outcome)
  UNION ALL SELECT 'intervals in order', count(*) FROM res WHERE NOT (lower <= estimate AND estimate <= upper) UNION ALL SELECT 'forest studies in the corpus', 0)
  SELECT check_name, lhs, CAST(0 AS BIGINT) AS rhs, lhs = 0 AS passed FROM c"""


def graded(s: SparkSession, d: str) -> DataFrame:
    """Relevance grades of records: by the best decision on them, else by their words."""
    v = table(s, d, "screening").withColumns({"decision": screening.decision(F.col("decision")), "confidence": screening.unit_confidence(F.col("confidence"))}).where("decision is not null")
    best = screening.best_decision(v, "uid", "decision", "confidence", "vote_id")
    j = _records(s, d).join(best, "uid", "left")
    g = screening.affinity(F.col("decision"), F.col("confidence"), F.concat_ws(" ", "title", "abstract"), C.TERMS)
    return j.select("ord", "found_by", "authors", "decision", g.alias("grade"))


_BEST = f"bd AS (SELECT uid, x AS decision, c AS confidence FROM (SELECT uid, vote_id, {_dec('decision')} AS x, CASE WHEN confidence > 1 THEN confidence / 100 ELSE confidence END AS c FROM screening) WHERE x IS NOT NULL QUALIFY row_number() OVER (PARTITION BY uid ORDER BY c DESC NULLS LAST, vote_id) = 1)"
_GRADE = f"""{_R}, {_BEST}, gw AS (SELECT r.ord, r.found_by, r.authors, bd.decision, least(greatest(coalesce(bd.confidence, 0.5), 0), 1) AS c, list_distinct(list_filter(regexp_split_to_array(lower(concat_ws(' ', title, abstract)), '[^a-z0-9]+'), lambda x: length(x) > 2)) AS w FROM r LEFT JOIN bd USING (uid)),
  gr AS (SELECT ord, found_by, authors, decision, CAST(CASE decision WHEN 'include' THEN round_even(6 + 4 * c, 0) WHEN 'exclude' THEN round_even(4 - 3 * c, 0) WHEN 'maybe' THEN round_even(4 + 3 * c, 0) ELSE CASE WHEN len(w) = 0 THEN 3 ELSE greatest(1, least(10, round_even(1 + 9 * least(1.0, len(list_intersect(w, ['{"', '".join(C.TERMS)}'])) / CAST({len(C.TERMS)} AS DOUBLE) * 2), 0))) END END AS INTEGER) AS grade FROM gw)"""


def workbook_full(s: SparkSession, d: str) -> DataFrame:
    g = graded(s, d).select("ord", "decision", "grade", F.explode(F.array_distinct("found_by")).alias("src"))
    is_ = lambda x: F.count_if(F.col("decision") == x).alias(x)
    return g.groupBy("src").agg(F.count("*").alias("n"), F.round(F.avg("grade"), 1).alias("mean_grade"), is_("include"), is_("exclude"), is_("maybe"))


def snowball_limited(s: SparkSession, d: str) -> DataFrame:
    from revisio.operators import graph

    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    one, rest = li.where("l_linenumber = 1"), li.where("l_linenumber > 1")
    edges = one.select("l_orderkey", F.col("l_partkey").alias("src")).join(rest.select("l_orderkey", F.col("l_partkey").alias("dst")), "l_orderkey").select("src", "dst").distinct().where("src <> dst")
    seeds = table(s, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_partkey").alias("ord")).where("node % 3 = 0")
    return graph.snowball_ordered(edges, seeds, seeds.select("node"), 5, 60, 200)


def _stats_sql() -> str:
    q = lambda p: p.replace("'", "''")
    parts = " UNION ALL ".join(f"SELECT ft_id, {n} AS rank, '{k}' AS kind, lower(regexp_replace(f, '\\s+', '', 'g')) AS found FROM (SELECT ft_id, unnest(regexp_extract_all(text, '{q(p)}')) AS f FROM fulltext)" for n, (k, p) in enumerate(texts.STATISTICS.items()))
    return f"WITH x AS ({parts}), o AS (SELECT ft_id, found, arg_min(kind, rank) AS kind, min(rank) AS rank FROM x GROUP BY ft_id, found) SELECT ft_id, kind, found FROM o QUALIFY row_number() OVER (PARTITION BY ft_id ORDER BY rank, found) <= 200"


_HEAD = texts.SPLIT.replace("(?imd)", "(?i)")
_SECTIONS = f"""l AS (SELECT pdf_id, unnest(string_split(full_text, chr(10))) AS line, generate_subscripts(string_split(full_text, chr(10)), 1) AS n FROM pdf_documents),
  h AS (SELECT *, CASE WHEN regexp_matches(line, '{_HEAD}') THEN lower(regexp_extract(line, '{_HEAD}', 1)) END AS head FROM l),
  g AS (SELECT *, count(head) OVER (PARTITION BY pdf_id ORDER BY n) AS sec FROM h),
  b AS (SELECT pdf_id, sec, max(head) AS heading, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE head IS NULL), ''), '^\\s+|\\s+$', '', 'g') AS body FROM g WHERE sec > 0 GROUP BY 1, 2),
  sc AS (SELECT pdf_id, heading, arg_max(body, sec) AS body FROM b WHERE body <> '' GROUP BY 1, 2)"""
_REFS = f"""WITH {_SECTIONS}, x AS (SELECT pdf_id, heading, list_filter(list_transform(string_split(regexp_replace(body, '(?m)^[ \\t]*(?:\\[[0-9]+\\]|[0-9]+\\.)[ \\t]+', chr(1), 'g'), chr(1)), lambda v: trim(regexp_replace(v, '\\s+', ' ', 'g'))), lambda v: length(v) > 12)[1:200] AS refs FROM sc WHERE heading IN ('references', 'bibliography'))
  SELECT pdf_id, CAST(n AS INTEGER) AS n, reference FROM (SELECT pdf_id, unnest(refs) AS reference, generate_subscripts(refs, 1) AS n FROM x)"""
_WINDOW = r"""WITH b AS (SELECT ft_id, text, regexp_replace(text, '(?is)\n[ \t]*references[ \t]*\n.*$', '') AS body FROM fulltext),
  p AS (SELECT *, CASE WHEN regexp_matches(body, '(?im)^[ \t]*results[ \t]*$') THEN length(regexp_extract(body, '(?ism)\A(.*?)^[ \t]*results[ \t]*$', 1)) + 1 ELSE 0 END AS pos FROM b)
  SELECT ft_id, CASE WHEN length(text) <= 300 THEN text ELSE substring(body, greatest(1, pos - 75), 300) END AS kept FROM p"""
_CITE = """WITH b AS (SELECT ord, coalesce(nullif(regexp_replace(regexp_replace(strip_accents(lower(regexp_split_to_array(trim(replace(authors[1], ',', ' ')), '\\s+')[1])), '[^\\x00-\\x7f]', '', 'g'), '[^a-z]', '', 'g'), ''), 'anon') || coalesce(CAST(year AS VARCHAR), 'nd') AS base FROM records),
  n AS (SELECT ord, base, row_number() OVER (PARTITION BY base ORDER BY ord) - 1 AS r FROM b)
  SELECT ord, base || CASE WHEN r = 0 THEN '' WHEN r <= 26 THEN chr(CAST(96 + r AS INTEGER)) WHEN r <= 702 THEN chr(CAST(97 + (r - 27) // 26 AS INTEGER)) || chr(CAST(97 + (r - 1) % 26 AS INTEGER)) ELSE 'x' || r END AS key FROM n"""
_REACH = f"""WITH RECURSIVE k AS (SELECT DISTINCT ord, unnest(list_filter([{', '.join([f"'doi:' || coalesce({_doi(_own('doi'))}, {_doi('doi')})", f"'pmid:' || lower(coalesce({_own('pmid')}, nullif(trim(pmid), '')))"] + [f"'{s}:' || lower({_own(s)})" for s in ('pmcid', 'arxiv', 'openalex', 's2')])}], lambda x: x IS NOT NULL)) AS key FROM records),
  m AS (SELECT key, min(ord) AS lo FROM k GROUP BY key), g AS (SELECT DISTINCT k.ord AS a, lo AS b FROM k JOIN m USING (key)), u AS (SELECT a, b FROM g UNION SELECT b, a FROM g),
  reach(a, b) AS (SELECT DISTINCT a, a FROM u UNION SELECT r.a, u.b FROM reach r JOIN u ON r.b = u.a)
  SELECT a AS ord, min(b) AS cluster FROM reach GROUP BY a HAVING a <> min(b)"""
_SNOW = """WITH e AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber > 1 WHERE a.l_partkey <> b.l_partkey),
  known AS (SELECT p_partkey AS node FROM part WHERE p_partkey % 3 = 0), seeds AS (SELECT node FROM known ORDER BY node LIMIT 60),
  h AS (SELECT src AS seed, 0 AS way, dst AS found FROM e WHERE src IN (SELECT node FROM seeds) UNION SELECT dst, 1, src FROM e WHERE dst IN (SELECT node FROM seeds)),
  c AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY seed, way ORDER BY found) <= 5), n AS (SELECT found, seed, way FROM c WHERE found NOT IN (SELECT node FROM known) QUALIFY row_number() OVER (PARTITION BY found ORDER BY seed, way) = 1)
  SELECT found, seed, way, row_number() OVER (ORDER BY seed, way, found) AS place FROM n QUALIFY place <= 200"""


def queries() -> dict[str, Query]:
    el, ap = _eligibility, _appraisals
    return {
        "uid": lambda s, d: _records(s, d).select("ord", "uid"),
        "flow_full": _counts,
        "ledger_full": lambda s, d: review.ledger(_counts(s, d)),
        "grounding": _grounding,
        "integrity_report": lambda s, d: review.report_of(review.ledger(_counts(s, d)).unionByName(_grounding(s, d))),
        "included_records": lambda s, d: review.included(el(s, d), _records(s, d)).select("uid", "ord", "title"),
        "screening_titles": lambda s, d: review.with_titles(table(s, d, "screening").select("vote_id", "uid"), _records(s, d), 120),
        "extraction_appraisal": lambda s, d: review.with_appraisal(_extractions(s, d).select("uid", "label"), ap(s, d).select("uid", F.col("domain").alias("label"), F.col("level").alias("overall"), "ord")),
        "citation_gate": lambda s, d: review.citation_gate(el(s, d), _records(s, d).select("uid", review.resolvable(resolve.id_keys(), F.col("url")).alias("resolvable"))).select("uid", "eligible", "retrieved", "reason"),
        "record_status": lambda s, d: review.status(_records(s, d).select("uid", "ord"), _decisions(s, d), el(s, d)),
        "excluded_full_texts": lambda s, d: review.excluded_with_reason(el(s, d), _records(s, d)),
        "characteristics": lambda s, d: review.characteristics(_extractions(s, d).drop("ord"), ap(s, d).select("uid", "ord", F.col("level").alias("measure"), F.col("ord").alias("estimate"), F.lit(0).alias("lower"), F.lit(1).alias("upper"))),
        "study_digest": lambda s, d: review.digest(effects_table(s, d).withColumn("uid", F.col("measure"))),
        "judgement_tally": lambda s, d: C._r(review.judgement_shares(ap(s, d)), "pct", places=4),
        "strategy_hits": lambda s, d: review.strategy_hits(table(s, d, "source_trust").select("source", "kind"), table(s, d, "records")),
        "events_per_phase": lambda s, d: flow.per_phase(C.audit(s, d)),
        "sources_union": lambda s, d: flow.by_source(table(s, d, "records").select(X.words_only(F.coalesce("source", F.lit(""))).alias("source")).unionByName(table(s, d, "fulltext").select(X.words_only(F.coalesce("source", F.lit(""))).alias("source")))),
        "record_numbers": lambda s, d: flow.citation_numbers(table(s, d, "records")).select("ord", F.col("number").cast("long").alias("number")),
        "cite_keys": lambda s, d: sinks.cite_keys(table(s, d, "records"), "ord"),
        "citation_styles": _styles,
        "text_forms": text_forms,
        "reviewer_labels": lambda s, d: table(s, d, "screening").groupBy(X.reviewer_label(F.col("reviewer")).alias("label")).agg(F.count("*").alias("n")),
        "query_dates": translated,
        "graded_records": lambda s, d: graded(s, d).select("ord", "decision", "grade"),
        "workbook_full": workbook_full,
        "decision_tally": lambda s, d: C._r(texts.tally(ap(s, d).select(F.col("domain").alias("reviewer"), F.col("level").alias("decision")), "reviewer", "decision"), "pct", places=4),
        "screen_pivot_clean": lambda s, d: screening.pivoted(ap(s, d), "uid", "domain", "level", "ord", ("reviewer_1", "reviewer_2", "adjudicator")),
        "dominant_measure": lambda s, d: synthesis.dominant(synthesis.labelled(effects_table(s, d)), "OR"),
        "participants": lambda s, d: synthesis.participants(effects_table(s, d)),
        "outcome_results": _results,
        "primary_outcome": lambda s, d: synthesis.primary(_results(s, d)),
        "full_results": lambda s, d: synthesis.full_results(effects_table(s, d), "OR"),
        "effect_forms": effect_forms,
        "recomputed_effects": recomputed,
        "i2_interval": _i2,
        "egger_test": lambda s, d: C._r(pooling.egger_test(C.studies(s, d), ["outcome"]), "intercept", "slope", "t", "p"),
        "funnel_points": lambda s, d: C._r(pooling.funnel_points(C.studies(s, d), ["outcome"], "study"), "y", "se"),
        "reml_pool": lambda s, d: C._r(pooling.by_group(C.studies(s, d), "outcome", lambda y, v: {k: x for k, x in zip(("k", "tau2", "mu", "se"), (lambda r: (r["k"], r["tau2"], r["mu"], r["se_wald"]))(pooling.pool_reml(y, v)))}, "k long, tau2 double, mu double, se double"), "tau2", "mu", "se", places=5),
        "reml_leave_one_out": lambda s, d: C._r(pooling.by_group(C.studies(s, d), "outcome", synthesis.reml_leave_one_out, "k int, least double, greatest double"), "least", "greatest"),
        "begg_tau": lambda s, d: C._r(pooling.by_group(C.studies(s, d), "outcome", pooling.begg, "tau double"), "tau"),
        "dedup_ids": C.dedup_ids,
        "snowball_limited": snowball_limited,
        "harvest_statistics": lambda s, d: texts.statistics(table(s, d, "fulltext"), "ft_id", "text").drop("context"),
        "sections": lambda s, d: texts.sections(table(s, d, "pdf_documents"), "pdf_id", "full_text"),
        "references": lambda s, d: texts.references(table(s, d, "pdf_documents"), "pdf_id", "full_text"),
        "relevant_window": lambda s, d: table(s, d, "fulltext").select("ft_id", texts.relevant_window(F.col("text"), 300).alias("kept")),
    }


def oracle_sql() -> dict[str, str]:
    base = f"{_R}, {_FINAL}, {_ELIG}"
    title = "t AS (SELECT uid, title, doi FROM r QUALIFY row_number() OVER (PARTITION BY uid ORDER BY ord) = 1)"
    ids = "uid NOT LIKE 'sha:%' OR coalesce(trim(url), '') <> ''"
    words = "trim(regexp_replace(lower(coalesce(source, '')), '[^a-z0-9]+', ' ', 'g'))"
    return {
        "uid": f"WITH {_R} SELECT ord, uid FROM r",
        "flow_full": f"WITH {_COUNTS} SELECT * FROM cnt",
        "ledger_full": f"WITH {_COUNTS} {_ledger_sql()}",
        "grounding": _GROUND,
        "integrity_report": f"SELECT count(*) AS n_checks, count(*) FILTER (NOT passed) AS n_failures, bool_and(passed) AS passed FROM (SELECT * FROM (WITH {_COUNTS} {_ledger_sql()}) UNION ALL SELECT * FROM ({_GROUND}))",
        "included_records": f"WITH {base} SELECT uid, ord, title FROM r WHERE uid IN (SELECT uid FROM e WHERE eligible)",
        "screening_titles": f"WITH {_R}, {title} SELECT vote_id, uid, left(coalesce(title, ''), 120) AS title, doi FROM (SELECT vote_id, uid FROM screening) LEFT JOIN t USING (uid)",
        "extraction_appraisal": f"WITH {_APPR}, x AS (SELECT uid, arg_max(source, ft_id) AS label FROM fulltext GROUP BY uid), a AS (SELECT uid, arg_max(level, ord) AS v FROM ap GROUP BY uid), b AS (SELECT domain AS label, arg_max(level, ord) AS w FROM ap GROUP BY domain) SELECT uid, label, coalesce(v, w, '—') AS overall FROM x LEFT JOIN a USING (uid) LEFT JOIN b USING (label)",
        "citation_gate": f"WITH {base}, k AS (SELECT uid, bool_or({ids}) AS found FROM r GROUP BY uid) SELECT uid, eligible AND coalesce(found, false) AS eligible, retrieved, CASE WHEN eligible AND NOT coalesce(found, false) THEN 'No resolvable identifier' ELSE reason END AS reason FROM e LEFT JOIN k USING (uid)",
        "record_status": f"WITH {base} SELECT uid, ord, CASE WHEN uid IN (SELECT uid FROM e WHERE eligible) THEN 'included' WHEN uid IN (SELECT uid FROM d WHERE decision = 'include') THEN 'full_text_excluded' ELSE 'screened_out' END AS status FROM r",
        "excluded_full_texts": f"WITH {base}, {title} SELECT uid, left(coalesce(title, ''), 140) AS title, coalesce(nullif(trim(reason), ''), 'Other') AS reason FROM e LEFT JOIN t USING (uid) WHERE retrieved AND NOT eligible",
        "characteristics": f"WITH {_APPR}, x AS (SELECT uid, arg_max(source, ft_id) AS label, arg_max(coalesce(text, ''), ft_id) AS text FROM fulltext GROUP BY uid), f AS (SELECT uid, arg_min(level, ord) AS measure, min(ord) AS estimate, count(*) AS n_effects FROM ap GROUP BY uid) SELECT uid, left(coalesce(label, ''), 120) AS label, left(text, 120) AS text, measure, estimate, CASE WHEN estimate IS NOT NULL THEN 0 END AS lower, CASE WHEN estimate IS NOT NULL THEN 1 END AS upper, n_effects FROM x LEFT JOIN f USING (uid)",
        "study_digest": f"WITH {_EFFECTS}, x AS (SELECT measure AS uid, ord, concat_ws(' ', outcome, measure, printf('%.3f', exp(y))) AS x FROM et0 QUALIFY row_number() OVER (PARTITION BY measure ORDER BY ord) <= 4) SELECT uid, string_agg(x, '; ' ORDER BY ord) AS line FROM x GROUP BY uid",
        "judgement_tally": f"WITH {_APPR}, f AS (SELECT uid, domain, arg_min(level, ord) AS level FROM ap GROUP BY 1, 2), n AS (SELECT domain, level, count(*) AS n FROM f GROUP BY 1, 2) SELECT domain, level, n, round(100.0 * n / sum(n) OVER (PARTITION BY domain), 4) AS pct FROM n",
        "strategy_hits": "SELECT t.source, kind, coalesce(hits, 0) AS hits FROM source_trust t LEFT JOIN (SELECT source, count(*) AS hits FROM records GROUP BY source) USING (source)",
        "events_per_phase": "SELECT 'screening' AS phase, count(*) AS n FROM screening UNION ALL SELECT 'fulltext', count(*) FROM fulltext",
        "sources_union": f"SELECT source, count(*) AS n, regexp_matches(source, 'clinicaltrials|clinical-trials|prospero|ictrp|isrctn|anzctr|drks|chictr|ctri|eudract|regist') AS register FROM (SELECT {words} AS source FROM records UNION ALL SELECT {words} FROM fulltext) GROUP BY source",
        "record_numbers": f"SELECT ord, row_number() OVER (ORDER BY coalesce(nullif(regexp_replace(strip_accents(lower(regexp_split_to_array(trim(replace(authors[1], ',', ' ')), '\\s+')[1])), '[^\\x00-\\x7f]', '', 'g'), ''), 'zzzz') COLLATE \"BINARY\", coalesce(year, 9999), {C._TITLE}, ord) AS number FROM records".replace(' COLLATE "BINARY"', ""),
        "cite_keys": _CITE,
        "citation_styles": _STYLES,
        "text_forms": _TEXT,
        "reviewer_labels": "SELECT CASE WHEN reviewer ~ '.*[0-9]+$' THEN 'Reviewer ' || regexp_extract(reviewer, '([0-9]+)$', 1) ELSE upper(left(reviewer, 1)) || substr(reviewer, 2) END AS label, count(*) AS n FROM screening GROUP BY 1",
        "query_dates": _DATED,
        "graded_records": f"WITH {_GRADE} SELECT ord, decision, grade FROM gr",
        "workbook_full": f"WITH {_GRADE} SELECT src, count(*) AS n, round(avg(grade), 1) AS mean_grade, count(*) FILTER (decision = 'include') AS include, count(*) FILTER (decision = 'exclude') AS exclude, count(*) FILTER (decision = 'maybe') AS maybe FROM (SELECT ord, decision, grade, unnest(list_distinct(found_by)) AS src FROM gr) GROUP BY src",
        "decision_tally": f"WITH {_APPR}, n AS (SELECT domain AS reviewer, level AS decision, count(*) AS n FROM ap GROUP BY 1, 2) SELECT reviewer, decision, n, round(100.0 * n / sum(n) OVER (PARTITION BY reviewer), 4) AS pct FROM n",
        "screen_pivot_clean": f"WITH {_APPR} SELECT uid, arg_max(level, ord) FILTER (domain = 'reviewer_1') AS reviewer_1, arg_max(level, ord) FILTER (domain = 'reviewer_2') AS reviewer_2, arg_max(level, ord) FILTER (domain = 'adjudicator') AS adjudicator FROM ap GROUP BY uid",
        "dominant_measure": f"WITH {_EFFECTS} SELECT outcome, measure, n FROM dm",
        "participants": f"WITH {_EFFECTS} SELECT * FROM pa",
        "outcome_results": f"WITH {_RESULTS} SELECT * FROM res",
        "primary_outcome": f"WITH {_RESULTS} SELECT outcome FROM res ORDER BY k DESC, ord LIMIT 1",
        "effect_forms": f"""WITH {C._ARMS}, {C._TWO}, j AS (SELECT *, a / arms.n1 AS p FROM arms JOIN (SELECT c_nationkey, m1, s1, n1 AS k1, m2, s2, n2 AS k2 FROM two) ON c_nationkey = moderator),
          x AS (SELECT *, sqrt(((k1 - 1) * s1 * s1 + (k2 - 1) * s2 * s2) / (k1 + k2 - 2)) AS sp, 1 - 3 / (4 * (k1 + k2 - 2) - 1) AS jj FROM j)
          SELECT study, round(ln(a) - ln(n1 - a) - ln(c) + ln(n2 - c), 4) AS half_y, round(1 / a + 1 / (n1 - a) + 1 / c + 1 / (n2 - c), 4) AS half_v, round(ln(a) - ln(n1 - a), 4) AS logit_y, round(1 / a + 1 / (n1 - a), 4) AS logit_v, round(atanh(p), 4) AS z_y, round(1 / (n1 - 3), 4) AS z_v,
          round(jj * (m1 - m2) / sp, 4) AS g_y, round(jj * jj * ((k1 + k2) / (k1 * k2) + ((m1 - m2) / sp) * ((m1 - m2) / sp) / (2 * (k1 + k2 - 2))), 4) AS g_v, round(s1, 4) AS sd_se, round(4 / (2 * {_Z}) * sqrt(k1), 4) AS sd_ci FROM x""",
        "recomputed_effects": f"""WITH {C._ARMS}, {C._TWO}, j AS (SELECT study, moderator AS k, a, c, arms.n1, arms.n2, m1, CASE WHEN moderator % 5 > 0 THEN s1 ELSE s2 END AS s1, m2, s2, k1, k2, CASE WHEN moderator % 3 = 0 THEN 'OR' WHEN moderator % 3 = 1 THEN 'MD' ELSE 'SMD' END AS measure FROM arms JOIN (SELECT c_nationkey, m1, s1, n1 AS k1, m2, s2, n2 AS k2 FROM two) ON c_nationkey = moderator),
          x AS (SELECT *, k1 + k2 - 2 AS df, sqrt(((k1 - 1) * s1 * s1 + (k2 - 1) * s2 * s2) / (k1 + k2 - 2)) AS sp, CASE WHEN measure = 'OR' AND k % 2 = 0 THEN 'counts' WHEN measure <> 'OR' AND k % 4 > 0 THEN 'means' ELSE 'interval' END AS provenance FROM j),
          g AS (SELECT *, exp(lgamma(df / 2) - 0.5 * ln(df / 2) - lgamma((df - 1) / 2)) * (m1 - m2) / sp AS g, (CASE WHEN measure = 'OR' THEN ln(1.875) - ln(1.2) ELSE 1.875 - 1.2 END) / (2 * {_Z}) AS se FROM x)
          SELECT study, measure, round(CASE provenance WHEN 'counts' THEN ln(a * (n2 - c) / ((n1 - a) * c)) WHEN 'means' THEN CASE measure WHEN 'MD' THEN m1 - m2 ELSE g END ELSE CASE measure WHEN 'OR' THEN ln(1.5) ELSE 1.5 END END, 4) AS y,
          round(CASE provenance WHEN 'counts' THEN 1 / a + 1 / (n1 - a) + 1 / c + 1 / (n2 - c) WHEN 'means' THEN CASE measure WHEN 'MD' THEN s1 * s1 / k1 + s2 * s2 / k2 ELSE (k1 + k2) / (k1 * k2) + g * g / (2 * df) END ELSE se * se END, 4) AS v, provenance FROM g""",
        "i2_interval": _I2,
        "funnel_points": f"WITH {C._EFF} SELECT outcome, study, round(y, 6) AS y, round(sqrt(v), 6) AS se FROM eff",
        "reml_pool": _REML,
        "begg_tau": _TAU,
        "dedup_ids": _REACH,
        "snowball_limited": _SNOW,
        "harvest_statistics": _stats_sql(),
        "sections": f"WITH {_SECTIONS} SELECT * FROM sc",
        "references": _REFS,
        "relevant_window": _WINDOW,
    }
