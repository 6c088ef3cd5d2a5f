"""Effect sizes as column expressions: estimate and variance on the analysis scale."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from revisio.functions import dist

Z = 1.959963984540054
LOG, LOGIT, ATANH = ("OR", "RR", "HR", "IRR", "ROM"), ("PROP",), ("COR", "R")


def _double(c: Column) -> Column:
    return c.cast("double")


def _pair(y: Column, v: Column, ok: Column) -> Column:
    return F.when(ok, F.struct(y.alias("y"), v.alias("v")))


def two_by_two(a: Column, n1: Column, c: Column, n2: Column, measure: str) -> Column:
    """Log odds ratio, log risk ratio or risk difference of a 2x2 table, with its variance.

    Ratios of a table with an empty cell get a pseudo-count that is the
    opposite arm's share of all patients; tables empty in both arms, and
    impossible ones, give null.
    """
    a, n1, c, n2 = map(_double, (a, n1, c, n2))
    b, d = n1 - a, n2 - c
    ok = (b + d).isNotNull() & (n1 > 0) & (n2 > 0) & (F.least(a, b, c, d) >= 0)
    if measure == "RD":
        p, q = F.try_divide(a, n1), F.try_divide(c, n2)
        return _pair(p - q, F.try_divide(p * (1 - p), n1) + F.try_divide(q * (1 - q), n2), ok)
    ok = ok & ~((a == 0) & (c == 0)) & ~((b == 0) & (d == 0))
    empty = F.least(a, b, c, d) == 0
    k1 = F.when(empty, F.try_divide(n2, n1 + n2)).otherwise(0.0)
    k2 = F.when(empty, F.try_divide(n1, n1 + n2)).otherwise(0.0)
    a, b, c, d = a + k1, b + k1, c + k2, d + k2
    inv = lambda x: F.try_divide(F.lit(1.0), x)
    if measure == "OR":
        return _pair(F.ln(F.try_divide(a * d, b * c)), inv(a) + inv(b) + inv(c) + inv(d), ok)
    if measure == "RR":
        return _pair(F.ln(F.try_divide(a * (c + d), c * (a + b))), inv(a) - inv(a + b) + inv(c) - inv(c + d), ok)
    raise ValueError(f"no 2x2 measure {measure}")


def mean_difference(m1: Column, s1: Column, n1: Column, m2: Column, s2: Column, n2: Column) -> Column:
    m1, s1, n1, m2, s2, n2 = map(_double, (m1, s1, n1, m2, s2, n2))
    return _pair(m1 - m2, F.try_divide(s1 * s1, n1) + F.try_divide(s2 * s2, n2), (n1 > 0) & (n2 > 0))


def lgamma(x: Column) -> Column:
    """The logarithm of the gamma function of positive numbers: Stirling's series after a shift by eight."""
    z = x + 8.0
    s = (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, F.lit(5.0)))
    return s - sum((F.ln(x + float(i)) for i in range(8)), F.lit(0.0))


def hedges_g(m1: Column, s1: Column, n1: Column, m2: Column, s2: Column, n2: Column) -> Column:
    """The standardised mean difference with the exact small-sample factor."""
    m1, s1, n1, m2, s2, n2 = map(_double, (m1, s1, n1, m2, s2, n2))
    df = n1 + n2 - 2
    sp = F.sqrt(F.try_divide((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2, df))
    ok = (n1 > 0) & (n2 > 0) & (df > 1) & (sp > 0)
    dfs = F.when(df > 1, df)
    j = F.exp(lgamma(dfs / 2) - 0.5 * F.ln(dfs / 2) - lgamma((dfs - 1) / 2))
    g = j * F.try_divide(m1 - m2, sp)
    return _pair(g, F.try_divide(n1 + n2, n1 * n2) + g * g / (2 * dfs), ok)


def scale_of(measure: Column) -> Column:
    m = F.upper(measure)
    return F.when(m.isin(*LOG), "log").when(m.isin(*LOGIT), "logit").when(m.isin(*ATANH), "ztrans").otherwise("identity")


def _to_scale(x: Column, scale: Column) -> Column:
    return (
        F.when((scale == "log") & (x > 0), F.ln(F.when(x > 0, x)))
        .when((scale == "logit") & (x > 0) & (x < 1), F.ln(F.try_divide(x, 1 - x)))
        .when((scale == "ztrans") & (x > -1) & (x < 1), F.atanh(x))
        .when(scale == "identity", x)
    )


def back(x: Column, measure: Column) -> Column:
    """From the analysis scale to the natural one."""
    s = scale_of(measure)
    return F.when(s == "log", F.exp(x)).when(s == "logit", 1 / (1 + F.exp(-x))).when(s == "ztrans", F.tanh(x)).otherwise(x)


def usable(measure: Column, estimate: Column, se: Column, lower: Column, upper: Column) -> Column:
    """``(y, se)`` on the analysis scale; null for missing, infinite or impossible values.

    The standard error of ratios is one of the logarithm; that of proportions
    and correlations is carried over by the delta method; where it is missing
    the interval gives it.
    """
    s = scale_of(measure)
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    y = _to_scale(estimate, s)
    from_ci = (_to_scale(upper, s) - _to_scale(lower, s)) / (2 * Z)
    own = F.when(s == "logit", F.try_divide(se, estimate * (1 - estimate))).when(s == "ztrans", F.try_divide(se, 1 - estimate * estimate)).otherwise(se)
    e = F.when(se.isNull(), from_ci).when(se > 0, own)
    ok = fine(estimate) & fine(y) & fine(e) & (e > 0) & (se.isNull() | fine(se))
    return F.when(ok, F.struct(y.alias("y"), e.alias("se")))


def se_from_ci(lower: Column, upper: Column, measure: Column) -> Column:
    s = scale_of(measure)
    return (_to_scale(upper, s) - _to_scale(lower, s)) / (2 * Z)


@F.pandas_udf(DoubleType())
def norm_ppf(p: pd.Series) -> pd.Series:
    q = NormalDist().inv_cdf
    return p.map(lambda x: q(x) if x == x and 0 < x < 1 else None).astype("float64")


def mean_sd_from_quartiles(n: Column, q1: Column, median: Column, q3: Column) -> Column:
    """Mean and standard deviation from a median with quartiles; null for fewer than two values or a wrong order."""
    n, q1, median, q3 = map(_double, (n, q1, median, q3))
    mean = (0.7 + 0.39 / n) * (q1 + q3) / 2 + (0.3 - 0.39 / n) * median
    sd = F.try_divide(q3 - q1, 2 * norm_ppf((0.75 * n - 0.125) / (n + 0.25)))
    return F.when((n >= 2) & (q1 <= median) & (median <= q3), F.struct(mean.alias("mean"), sd.alias("sd")))


def mean_sd_from_range(n: Column, low: Column, median: Column, high: Column) -> Column:
    """Mean and standard deviation from a median with the extremes."""
    n, low, median, high = map(_double, (n, low, median, high))
    w = 4 / (4 + F.pow(n, F.lit(0.75)))
    sd = F.try_divide(high - low, 2 * norm_ppf((n - 0.375) / (n + 0.25)))
    return F.when((n >= 2) & (low <= median) & (median <= high), F.struct((w * (low + high) / 2 + (1 - w) * median).alias("mean"), sd.alias("sd")))


def mean_sd_from_five(n: Column, low: Column, q1: Column, median: Column, q3: Column, high: Column) -> Column:
    """Mean and standard deviation from the five-number summary, weighing extremes and quartiles by the number of values."""
    n, low, q1, median, q3, high = map(_double, (n, low, q1, median, q3, high))
    w1, w2 = 2.2 / (2.2 + F.pow(n, F.lit(0.75))), 0.7 - 0.72 / F.pow(n, F.lit(0.55))
    mean = w1 * (low + high) / 2 + w2 * (q1 + q3) / 2 + (1 - w1 - w2) * median
    sd = F.try_divide(high - low, 4 * norm_ppf((n - 0.375) / (n + 0.25))) + F.try_divide(q3 - q1, 4 * norm_ppf((0.75 * n - 0.125) / (n + 0.25)))
    return F.when((n >= 2) & (low <= q1) & (q1 <= median) & (median <= q3) & (q3 <= high), F.struct(mean.alias("mean"), sd.alias("sd")))


def sd_from_se(se: Column, n: Column) -> Column:
    return F.when((n > 0) & (se > 0), _double(se) * F.sqrt(n))


def sd_from_ci(lower: Column, upper: Column, n: Column) -> Column:
    """The standard deviation of one group from the normal 95 % interval of its mean."""
    return F.when((n > 0) & (upper > lower), (_double(upper) - lower) / (2 * Z) * F.sqrt(n))


@F.pandas_udf(DoubleType())
def t_upper(p: pd.Series, df: pd.Series) -> pd.Series:
    """The t value that is exceeded with half of ``p`` as probability."""
    return pd.Series([dist.t_ppf(1 - a / 2, b) if a == a and b == b and 0 < a < 1 and b > 0 else None for a, b in zip(p, df)], dtype="float64")


def sd_from_p(m1: Column, n1: Column, m2: Column, n2: Column, p: Column) -> Column:
    """The common standard deviation of two groups from the p value of their difference's t test."""
    m1, n1, m2, n2, p = map(_double, (m1, n1, m2, n2, p))
    t = t_upper(p, n1 + n2 - 2)
    return F.when((n1 > 0) & (n2 > 0) & (t > 0) & (m1 != m2), F.abs(m1 - m2) / (t * F.sqrt(1 / n1 + 1 / n2)))


def hedges_g_direct(m1: Column, s1: Column, n1: Column, m2: Column, s2: Column, n2: Column) -> Column:
    """The standardised mean difference with the usual approximation of the small-sample factor, which also scales the variance."""
    m1, s1, n1, m2, s2, n2 = map(_double, (m1, s1, n1, m2, s2, n2))
    df = n1 + n2 - 2
    sp = F.sqrt(F.try_divide((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2, df))
    d, j = F.try_divide(m1 - m2, sp), 1 - F.try_divide(F.lit(3.0), 4 * df - 1)
    return _pair(j * d, j * j * (F.try_divide(n1 + n2, n1 * n2) + F.try_divide(d * d, 2 * df)), (n1 > 0) & (n2 > 0) & (df > 1) & (sp > 0))


def log_odds_half(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The log odds ratio of four cells, a half added to each if one is empty."""
    more = F.when(F.least(a, b, c, d) == 0, 0.5).otherwise(0.0)
    cells = [_double(x) + more for x in (a, b, c, d)]
    y = F.ln(cells[0]) - F.ln(cells[1]) - F.ln(cells[2]) + F.ln(cells[3])
    return _pair(y, sum((F.try_divide(F.lit(1.0), x) for x in cells[1:]), F.try_divide(F.lit(1.0), cells[0])), F.least(a, b, c, d) >= 0)


def fisher_z(r: Column, n: Column) -> Column:
    """A correlation on Fisher's scale; values at the ends are drawn in by a millionth."""
    edge = F.lit(1 - 1e-6)
    return _pair(F.atanh(F.least(F.greatest(_double(r), -edge), edge)), F.try_divide(F.lit(1.0), _double(n) - 3), n > 3)


def logit_proportion(events: Column, n: Column) -> Column:
    """A proportion on the logit scale; with none or all events a half is added to both sides."""
    e, m = _double(events), _double(n)
    more = F.when((e == 0) | (e == m), 0.5).otherwise(0.0)
    yes, no = e + more, m - e + more
    ok = (m > 0) & (e >= 0) & (e <= m)
    return _pair(F.when(ok, F.ln(yes) - F.ln(no)), F.try_divide(F.lit(1.0), yes) + F.try_divide(F.lit(1.0), no), ok)


def recomputed(row: dict[str, Column], measure: Column) -> Column:
    """``(y, v, provenance)`` on the analysis scale from the best raw data that a row offers; null if it offers none.

    ``row`` has columns by name, missing ones null: ``a, n1, c, n2`` (counts),
    ``m1, s1, m2, s2`` (means and deviations), ``med1, q1_1, q3_1`` and the
    same of arm 2, ``se1, se2``, ``p``, ``estimate, lower, upper``.  Counts come
    first for the measures of 2x2 tables, then means, whose missing deviations
    are taken from quartiles, standard errors, the p value or the other arm;
    last the reported estimate with its interval.
    """
    no = F.lit(None).cast("double")
    g = lambda n: _double(row[n]) if n in row else no
    m = F.upper(measure)
    n1, n2 = g("n1"), g("n2")
    counts = F.coalesce(*[F.when(m == x, two_by_two(g("a"), n1, g("c"), n2, x)) for x in ("OR", "RR", "RD")])
    # what a table has no column for is not even asked
    arm = {i: mean_sd_from_quartiles(n, g(f"q1_{i}"), g(f"med{i}"), g(f"q3_{i}")) for i, n in ((1, n1), (2, n2)) if f"med{i}" in row}
    mean = [F.coalesce(g(f"m{i}"), arm[i]["mean"] if i in arm else no) for i in (1, 2)]
    by_p = sd_from_p(mean[0], n1, mean[1], n2, g("p")) if "p" in row else no
    own = [F.coalesce(g(f"s{i}"), arm[i]["sd"] if i in arm else no, sd_from_se(g(f"se{i}"), n)) for i, n in ((1, n1), (2, n2))]
    sd = [F.coalesce(own[0], own[1], by_p), F.coalesce(own[1], own[0], by_p)]
    args = (mean[0], sd[0], n1, mean[1], sd[1], n2)
    means = F.when(m == "SMD", hedges_g(*args)).when(m == "MD", mean_difference(*args))
    se = se_from_ci(g("lower"), g("upper"), m)
    ci = F.when(se > 0, F.struct(_to_scale(g("estimate"), scale_of(m)).alias("y"), (se * se).alias("v")))
    kind = "struct<y:double,v:double>"
    ways = F.array(*[F.struct(w.cast(kind).alias("w"), F.lit(n).alias("n")) for n, w in (("counts", counts), ("means", means), ("interval", ci))])
    # each way stands in the plan once
    good = F.filter(ways, lambda x: x["w"]["y"].isNotNull() & (x["w"]["v"] > 0))
    return F.get(F.transform(good, lambda x: F.struct(x["w"]["y"].alias("y"), x["w"]["v"].alias("v"), x["n"].alias("provenance"))), 0)
