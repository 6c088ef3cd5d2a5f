"""The surviving record of each study: the best value of every field among its rows.

Rows of one study are found through shared identifiers and titles.  For each
field only real values compete: a whole plain abstract, a DOI that names a
study, a possible year, a known source.  Among rows of equal trust the more
current value wins.  Currency is reasoned from values: which kind of value
follows which (the registrant of a DOI, the source's name, the distance of a
year from the study's first) is learnt from the first and the last dated rows of
all studies as precedence.  A study's own dates and this precedence order its
values partially, and a topologically latest one is taken, dated or not.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revisio.functions.text import bare_doi, surname
from revisio.llm import cuts, looks
from revisio.operators.components import components
from revisio.plans.lineage import written

#: Titles shorter than this, in letters and digits, are rubrics ("Editorial").
RUBRIC_LENGTH = 20
EARLIEST = 1800
#: Capitals of other scripts with the shape of Latin ones, and the Greek small letters written as Latin ones.
CAPITALS = "АВЕКМНОРСТУХІЅЈΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
CAPITALS_LATIN = "ABEKMHOPCTYXISJABEZHIKMNOPTYX"
#: What publishers and indexes add to an abstract.
ADDED_BEFORE = r"(?i)^\W*abstract\b"
ADDED_AFTER = r"(?i)all rights reserved|copyright\s*(©|\(c\)|\d{4})|©"
#: One kind of value precedes another if studies that show it first outnumber the others by so many standard errors.
ERRORS = 2.0


def _fold_table() -> tuple[str, str]:
    shape = dict(zip(CAPITALS, CAPITALS_LATIN))
    table = {}
    for cp in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        ch = chr(cp)
        base = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c)).upper()
        base = shape.get(base, base)
        if len(base) == 1 and base != ch:
            table[ch] = base
    return "".join(table), "".join(table.values())


_ACCENTED, _BASE = _fold_table()


def title_key(c: Column) -> Column:
    """Letters and digits of a title in capitals without accents, look-alikes as Latin letters; "" for none."""
    x = F.upper(F.when(looks.is_plain(c), c).otherwise(F.upper(F.translate(looks.mapped(c), _ACCENTED, _BASE))))
    x = F.when(looks.is_plain(x), x).otherwise(F.translate(x, _ACCENTED + CAPITALS, _BASE + CAPITALS_LATIN))
    return F.coalesce(F.regexp_replace(x, r"[^\p{L}\p{N}]+", ""), F.lit(""))


def studies(records: DataFrame) -> DataFrame:
    """``(ord, study)``: the least ``ord`` of the row's study; rows that share nothing with others are left out.

    A title links rows unless it is a rubric: short, or borne by rows of
    several PubMed ids or more than two DOIs; then journal, volume, pages and
    first author must agree too.  Identifiers link where given.
    """
    ident = lambda name: F.nullif(F.lower(F.trim(F.try_element_at("ids", F.lit(name)))), F.lit(""))
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    pmid = F.coalesce(some(F.col("pmid")), ident("pmid"))
    place = F.concat_ws("|", some(F.col("journal")), some(F.col("volume")), some(F.col("pages")), surname(F.try_element_at("authors", F.lit(1))))
    t = records.select(
        "ord", title_key(F.col("title")).alias("t"), F.coalesce(bare_doi(F.col("doi")), bare_doi(ident("doi"))).alias("doi"),
        F.when(pmid.rlike(r"^[1-9]\d*$"), pmid).alias("pmid"), ident("pmcid").alias("pmcid"), ident("openalex").alias("openalex"), place.alias("place"),
    )
    t = written(t.withColumn("th", F.when(F.col("t") != "", F.xxhash64("t"))).withColumn("short", F.length("t") < RUBRIC_LENGTH).drop("t"), "study-keys")
    shared = t.where("th is not null and not short").groupBy("th").agg(F.min("pmid").alias("a"), F.max("pmid").alias("b"), F.count_distinct("doi").alias("n"))
    rubric = shared.where("a <> b or n > 2").select("th", F.lit(True).alias("rubric"))
    k = t.join(rubric, "th", "left")
    by_title = F.when(F.col("short") | F.col("rubric"), F.when(F.size(F.split("place", r"\|")) == 4, F.xxhash64(F.lit("place"), "th", "place"))).otherwise(F.xxhash64(F.lit("title"), "th"))
    keys = F.array(F.when(F.col("th").isNotNull(), by_title), *[F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(c), c)) for c in ("doi", "pmid", "pmcid", "openalex")])
    links = k.select("ord", F.explode(keys).alias("key")).where("key is not null")
    return components(links, node="ord").withColumnRenamed("component", "study")


def retrieved(c: Column) -> Column:
    """A retrieval date in either of its two formats."""
    return F.coalesce(F.try_to_date(c, "yyyy-MM-dd"), F.try_to_date(c, "dd/MM/yyyy"))


def plain_whole(text: Column) -> Column:
    """Whether an abstract has ordinary characters only and nothing added to it.

    Cyrillic and Greek letters are ordinary in texts that also have letters of
    that script that no Latin letter looks like; full-width punctuation is
    ordinary beside ideographs.  A text given twice over is not alone.
    """
    beyond = F.regexp_replace(text, r"[\x00-\x7f]+", " ")
    native = beyond.rlike("[бгджзийлптфцчшщыьэюяБГДЖЗИЛПФЦЧШЩЭЮЯ]")
    mixed = text.rlike(r"\p{IsLatin}\p{IsCyrillic}|\p{IsCyrillic}\p{IsLatin}")
    odd = beyond.rlike("[" + looks.BLANKS + looks.INVISIBLE + "‐‑" + "".join(looks.LIGATURES) + "０-９Ａ-Ｚａ-ｚ．－％＝＜＞＋／]|[\u0300-\u036f]")
    cyr = F.when(beyond.rlike("[" + looks.CYRILLIC + "]"), F.when(native, mixed).otherwise(True)).otherwise(False)
    greek = beyond.rlike("[" + looks.GREEK + "]") & ~beyond.rlike("[δεζηθλξπστφχψω]")
    wide = beyond.rlike("[，（）！？：；]") & ~beyond.rlike(r"[぀-鿿]")
    half = F.floor((F.length(text) - 1) / 2).cast("int")
    twice = (F.length(text) > 40) & (F.left(text, half) == F.right(text, half))
    added = F.left(text, F.lit(20)).rlike(ADDED_BEFORE) | F.right(text, F.lit(160)).rlike(ADDED_AFTER) | (text.contains("<") & text.rlike(r"</?[A-Za-z][^<>]*>")) | (text.contains("&") & text.rlike(r"&(lt|gt|amp|quot|apos|nbsp|#\d+);"))
    return ~F.when(twice | added, True).when(looks.is_plain(text), False).otherwise(odd | cyr | greek | wide)


def transitions(values: DataFrame) -> DataFrame:
    """``(field, a, b)``: the kinds of the first and the last dated value of each group of ``group, field, cls, at``, where they differ."""
    dated = values.where("at is not null and cls is not null")
    ends = dated.groupBy("group", "field").agg(F.min_by("cls", F.struct("at", "cls")).alias("a"), F.max_by("cls", F.struct("at", "cls")).alias("b"), F.min("at").alias("x"), F.max("at").alias("y"))
    return ends.where("a <> b and x < y").select("field", "a", "b")


def precedence(steps: DataFrame) -> DataFrame:
    """``(field, cls, after)``: kinds of values and the kinds that come later, closed under transitivity.

    Each of the :func:`transitions` is a vote; votes that disagree within
    chance give no order, and kinds that precede each other in a circle are in
    none.  All sums are partial, so a group with a third of all rows is one
    vote like others.
    """
    n = steps.groupBy("field", "a", "b").agg(F.count("*").alias("n"))
    back = n.select("field", F.col("a").alias("b"), F.col("b").alias("a"), F.col("n").alias("m"))
    votes = n.join(back, ["field", "a", "b"], "left").na.fill(0, ["m"])
    now = written(votes.where(F.col("n") - F.col("m") > ERRORS * F.sqrt(F.col("n") + F.col("m"))).select("field", F.col("a").alias("cls"), F.col("b").alias("after")), "precedence")
    size = now.count()
    while size:  # paths double in length each round
        more = now.select("field", "cls", F.col("after").alias("mid")).join(now.select("field", F.col("cls").alias("mid"), "after"), ["field", "mid"]).select("field", "cls", "after")
        now = written(now.unionByName(more).distinct(), "precedence")
        grown = now.count()
        if grown == size:
            break
        size = grown
    return now.join(now.select("field", F.col("after").alias("cls"), F.col("cls").alias("after")), ["field", "cls", "after"], "left_anti")


def latest(values: DataFrame, order: DataFrame) -> DataFrame:
    """``(group, field, value)``: a topologically latest value of each group and field.

    ``values`` has ``group, field, value, cls, at, ord``; ``order`` is a
    :func:`precedence`.  Dates order the dated values, the precedence of their
    kinds the others.  Nothing may come after the value taken: an undated one
    that follows the latest dated one by precedence, else that one; without
    dates, one that precedes none.  Among equals the one of most rows counts,
    then the least ``ord``.  No pairs of values are formed: kinds meet kinds.
    """
    key = ["group", "field"]
    v = written(values.where("value is not null").groupBy(*key, "value", "cls").agg(F.min("at").alias("at"), F.count("*").alias("n"), F.min("ord").alias("ord")), "values")
    kinds = v.select(*key, "cls").distinct()
    over = kinds.join(order, ["field", "cls"]).join(kinds.withColumnRenamed("cls", "after"), [*key, "after"]).select(*key, "cls").distinct().withColumn("over", F.lit(True))
    dated = v.where("at is not null").groupBy(*key).agg(F.max_by("cls", F.struct("at", "n", -F.col("ord"))).alias("d"))
    j = v.join(over, [*key, "cls"], "left").join(dated, key, "left")
    j = j.join(order.select("field", F.col("cls").alias("d"), F.col("after").alias("cls"), F.lit(True).alias("follows")), ["field", "d", "cls"], "left")
    undated, free = F.col("at").isNull(), F.col("over").isNull()
    rank = F.when(undated & free & F.col("follows"), 3).when(~undated, 2).when(free, 1).otherwise(0)
    return j.groupBy(*key).agg(F.max_by("value", F.struct(rank.alias("r"), F.when(~undated, F.col("at")).alias("at"), "n", (-F.col("ord")).alias("o"))).alias("value"))


FIELDS = ("doi", "source", "year")


def _fields(newest: int | None) -> dict[str, Column]:
    """The real DOI, the known source and the possible year of a row."""
    return {"doi": F.col("doi"), "source": F.col("known"), "year": F.when(F.col("year").between(EARLIEST, newest + 1 if newest else 2**31 - 1), F.col("year")).cast("string")}


def _kind(field: str, value: Column, y0: Column) -> Column:
    """What kind of value it is: a DOI's registrant, a source, a year's distance from the study's first."""
    return {"doi": F.substring_index(value, "/", 1), "source": value, "year": (value.cast("int") - y0).cast("string")}[field]


def _values(rows: DataFrame, first: DataFrame, newest: int | None) -> DataFrame:
    """``(group, field, value, cls, at, ord, rank)`` of the rows; ``first`` has each study's first year ``y0``."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), c.alias("value"), _kind(f, c, F.col("y0")).alias("cls")) for f, c in _fields(newest).items()])
    v = rows.join(first.select("study", "y0"), "study").select(F.col("study").alias("group"), "ord", "at", "rank", F.explode(each).alias("e"))
    return v.select("group", "ord", "at", "rank", "e.field", "e.value", "e.cls").where("value is not null")


def _study_rows(records: DataFrame, trust: DataFrame) -> DataFrame:
    """The rows of studies with two or more: ``study, first_ord, ord``, real values, trust rank, retrieval date and what is told of the abstract."""
    member = studies(records)
    several = member.groupBy("study").agg(F.min("ord").alias("first_ord"), F.count("*").alias("n")).where("n > 1").select("study", "first_ord")
    name = F.regexp_replace(F.lower("source"), r"\W+", "")
    src = trust.select(name.alias("s"), F.col("source").alias("known"), "trust_rank").dropDuplicates(["s"])
    # one pass over the abstracts: their endings, their hash and whether they are plain
    base = records.select(
        F.lit("records").alias("tbl"), F.col("ord").alias("row_id"), "source", F.col("abstract").alias("text"),
        name.alias("s"), bare_doi(F.col("doi")).alias("doi"), "year", retrieved(F.col("retrieval_date")).alias("at"),
        F.xxhash64(F.when(F.col("abstract").rlike(r"\s\s|[\t\n\r]|^\s|\s$"), F.trim(F.regexp_replace("abstract", r"\s+", " "))).otherwise(F.col("abstract"))).alias("h"), F.length("abstract").alias("len"), plain_whole(F.col("abstract")).alias("plain"),
    )
    ends = cuts.ended(base).withColumnRenamed("row_id", "ord")
    return written(member.join(several, "study").join(ends, "ord").join(src, "s", "left").withColumn("rank", F.coalesce("trust_rank", F.lit(2**31 - 1))), "study-rows")


def surviving(records: DataFrame, trust: DataFrame) -> DataFrame:
    """``(first_ord, field, best)`` of each study with two or more rows; fields that no row can fill are absent.

    A year is possible from 1800 to the year after the newest retrieval.
    ``abstract``: the least ``ord``, as text, of the rows whose abstract is the
    study's whole abstract, plain and alone; of several such texts the one in
    most rows counts, then the shortest.  ``doi``, ``source``, ``year``: from
    the most trusted row with a real value; where equally trusted rows differ,
    the topologically latest value (:func:`latest`).  A row without a known
    source is trusted least.  Every choice is a minimum or maximum of a partial
    aggregate, so a study with a third of all rows is no hot spot.
    """
    rows = _study_rows(records, trust)
    newest = rows.agg(F.max(F.year("at"))).first()[0]
    # one aggregate: the values of the most trusted rows with the least and the greatest hash, and the first and last dated values
    aggs = []
    for f, c in _fields(newest).items():
        h, dated = F.xxhash64(c), F.when(c.isNotNull(), F.col("at"))
        order = lambda x: F.when(c.isNotNull(), F.struct("rank", x.alias("h")))  # noqa: B023, E731
        when = F.when(dated.isNotNull(), F.struct("at", c.alias("c")))
        aggs.append(F.struct(F.lit(f).alias("field"), F.min(F.when(c.isNotNull(), F.col("rank"))).alias("top"), F.min_by(c, order(h)).alias("a"), F.min_by(c, order(F.bitwise_not(h))).alias("b"), F.min(when).alias("x"), F.max(when).alias("y")))
    years = _fields(newest)["year"].cast("int")
    per = rows.groupBy("study").agg(F.min("first_ord").alias("first_ord"), F.min(years).alias("y0"), F.array(*aggs).alias("e"))
    per = written(per.select("study", "first_ord", "y0", F.explode("e").alias("e")).select("study", "first_ord", "y0", "e.*").where("a is not null"), "trusted")
    # where equally trusted rows differ, currency decides
    ties = per.where("a <> b").select(F.col("study").alias("group"), "field", "top")
    tied = _values(rows.join(ties.select(F.col("group").alias("study")).distinct(), "study", "left_semi"), per.groupBy("study").agg(F.min("y0").alias("y0")), newest)
    kind = lambda c: F.coalesce(*[F.when(F.col("field") == f, _kind(f, F.col(c), F.col("y0"))) for f in FIELDS])
    steps = per.where("x.at < y.at and x.c <> y.c").select("field", kind("x.c").alias("a"), kind("y.c").alias("b")).where("a <> b")
    newer = latest(tied.join(ties, ["group", "field"]).where("rank = top"), precedence(steps)).select(F.col("group").alias("study"), "field", F.col("value").alias("newer"))
    single = per.join(newer, ["study", "field"], "left").select("first_ord", "field", F.coalesce("newer", "a").alias("best"))
    whole = rows.where("plain and not cut and not gap").groupBy("first_ord", "h").agg(F.count("*").alias("n"), F.min("len").alias("len"), F.min("ord").alias("ord"))
    abstract = whole.groupBy("first_ord").agg(F.min_by(F.col("ord").cast("string"), F.struct(-F.col("n"), F.col("len"), F.col("ord"))).alias("best"))
    return single.unionByName(abstract.select("first_ord", F.lit("abstract").alias("field"), "best"))


def current(records: DataFrame, trust: DataFrame) -> DataFrame:
    """``(first_ord, field, best)``: the most current DOI, source and year of each study with two or more rows, whoever gives it."""
    rows = _study_rows(records, trust)
    newest = rows.agg(F.max(F.year("at"))).first()[0]
    first = rows.groupBy("study").agg(F.min("first_ord").alias("first_ord"), F.min(_fields(newest)["year"].cast("int")).alias("y0"))
    values = written(_values(rows, first, newest), "kinds")
    return latest(values, precedence(transitions(values))).join(first, F.col("group") == F.col("study")).select("first_ord", "field", F.col("value").alias("best"))
