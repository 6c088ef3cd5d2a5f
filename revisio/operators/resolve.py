"""Entity resolution of bibliographic records: identifiers, fuzzy titles, merge onto the richest record."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from revisio.functions.text import bare_doi, norm_title, surname
from revisio.operators.components import components

SCHEMES = ("doi", "pmid", "pmcid", "arxiv", "openalex", "s2")
FILLED = ("doi", "pmid", "abstract", "journal", "journal_abbrev", "volume", "issue", "pages", "url", "retrieval_date")


def _some(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def identifier(scheme: str) -> Column:
    """A record's identifier of a scheme, lower case: from the map, else from its own column."""
    own = _some(F.try_element_at("ids", F.lit(scheme)))
    if scheme == "doi":
        return F.coalesce(bare_doi(own), bare_doi(F.col("doi")))
    return F.lower(F.coalesce(own, _some(F.col("pmid"))) if scheme == "pmid" else own)


def id_keys() -> Column:
    """All ``scheme:value`` keys of a record."""
    return F.array_distinct(F.filter(F.array(*[F.concat(F.lit(f"{s}:"), identifier(s)) for s in SCHEMES]), lambda x: x.isNotNull()))


def uid() -> Column:
    """The first identifier in the order of the schemes, else a hash of title or source id."""
    ids = [F.concat(F.lit(f"{s}:"), identifier(s)) for s in SCHEMES]
    text = F.coalesce(_some(F.col("title")), F.col("source_id"), F.lit(""))
    return F.coalesce(*ids, F.concat(F.lit("sha:"), F.substring(F.sha1(F.encode(F.lower(F.trim(text)), "UTF-8")), 1, 16)))


def token_sort_ratio(a: str, b: str) -> float:
    """100 times twice the longest common subsequence of the sorted words over the length of both."""
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    if not a or not b:
        return 0.0
    # the subsequence by bit vectors: a row of the table in one integer
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for ch in b:
        hit = row & at.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return 200 * (len(a) - row.bit_count()) / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def title_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_sort_ratio(x, y) if x and y else 0.0 for x, y in zip(a, b)], dtype="float64")


def fuzzy_links(records: DataFrame) -> DataFrame:
    """``(ord, match)``: each record without identifier and the first earlier one that it is likely a copy of.

    Titles must be as good as equal (ratio of 99 and more), or alike (90 and
    more) with the same year and first author.  Equal titles, and those of
    the same words, meet by an aggregate: the first row of a title stands for
    all, however many bear it.  Other titles are compared if they share a
    piece, without which their ratio is below 99 (see :func:`_pieces`), or
    the year and author.
    """
    t = records.select("ord", norm_title(F.col("title")).alias("t"), "year", surname(F.try_element_at("authors", F.lit(1))).alias("author"), (F.size(id_keys()) > 0).alias("has_id")).where("t <> ''")
    t = t.withColumn("s", F.array_join(F.array_sort(F.split("t", " ")), " "))
    first = t.groupBy("s").agg(F.min("ord").alias("first"), F.min(F.when(~F.col("has_id"), F.col("ord"))).alias("free"))
    # as good as equal, each set of words once
    right = first.select(F.col("s").alias("tb"), F.col("first").alias("match"), F.explode(_pieces("s")).alias("key"))
    left = first.where("free is not null").select(F.col("s").alias("ta"), F.col("free").alias("ord"), F.explode(_probes("s")).alias("key"))
    close = left.join(right, "key").where(F.col("match") < F.col("ord"))
    close = close.where(_alike(0.99)).dropDuplicates(["ta", "tb"]).where(title_ratio("ta", "tb") >= 99).groupBy("ta").agg(F.min("match").alias("match"))
    # the same year and author
    y = t.where("year is not null and author <> ''").groupBy("t", "year", "author").agg(F.min("ord").alias("first"), F.min(F.when(~F.col("has_id"), F.col("ord"))).alias("free"))
    right = y.select("year", "author", F.col("t").alias("tb"), F.col("first").alias("match"))
    same = y.where("free is not null").select("year", "author", F.col("t").alias("ta"), F.col("free").alias("ord")).join(right, ["year", "author"]).where(F.col("match") < F.col("ord"))
    same = same.where(_alike(0.9)).where(title_ratio("ta", "tb") >= 90).groupBy("ta", "year", "author").agg(F.min("match").alias("match2"))
    free = t.where("not has_id").join(first.select("s", "first"), "s").join(close.withColumnRenamed("ta", "s"), "s", "left").join(same.withColumnRenamed("ta", "t"), ["t", "year", "author"], "left")
    m = F.least("first", "match", "match2")
    return free.select("ord", m.alias("match")).where("match < ord")


def _piece(of: str, length: Column, i: Column, start: Column) -> Column:
    """The key of a text's ``i``-th piece, as cut from a text of the given length."""
    n = _edits(length) + 1
    at, end = F.floor(i * length / n), F.floor((i + 1) * length / n)
    return F.xxhash64(length, i, F.substr(F.col(of), (start + at + 1).cast("int"), (end - at).cast("int")))


def _edits(length: Column) -> Column:
    """Insertions and deletions at most between a text of this length and one of a ratio of 99 and more."""
    return F.floor(2 * length / 99).cast("int")


def _pieces(s: str) -> Column:
    """Keys of the pieces of a text: one more than the edits it may have, so one piece is whole."""
    size = F.length(s)
    return F.transform(F.sequence(F.lit(0), _edits(size)), lambda i: _piece(s, size, i, F.lit(0)))


def _probes(s: str) -> Column:
    """Keys of all pieces by which a text can meet one of a ratio of 99 and more.

    Of d edits some whole piece i has just i before it and d - i after it (the
    edits before a piece less its number start at 0 and end below, and fall by
    one only at a whole piece).  So it is moved by -i, -i + 2, ... or i places,
    and what is left of the difference in length is at most d - i.
    """
    size = F.length(s)
    most = _edits(size)

    def of_length(off: Column) -> Column:
        other = size - off
        edits = F.floor((size + other) / 100).cast("int")
        n = _edits(other) + 1

        def of_piece(i: Column) -> Column:
            moves = F.filter(F.sequence(-i, i, F.lit(2)), lambda m: F.abs(off - m) <= edits - i)
            at, end = F.floor(i * other / n), F.floor((i + 1) * other / n)
            inside = F.filter(moves, lambda m: (at + m >= 0) & (end + m <= size))
            return F.transform(inside, lambda m: _piece(s, other, i, m))

        return F.flatten(F.transform(F.sequence(F.lit(0), edits), of_piece))

    return F.array_distinct(F.flatten(F.transform(F.sequence(-most, most), of_length)))


def _alike(least: float) -> Column:
    """Different titles whose lengths allow the ratio."""
    a, b = F.length("ta"), F.length("tb")
    return (F.col("ta") != F.col("tb")) & (2 * F.least(a, b) >= least * (a + b))


def clusters(records: DataFrame, fuzzy: bool = True) -> DataFrame:
    """``(ord, cluster)`` of every record: those linked by identifiers or fuzzy titles, named by their least ``ord``."""
    ids = records.select("ord", F.explode(id_keys()).alias("key"))
    own = records.select("ord", F.concat(F.lit("row:"), F.col("ord")).alias("key"))
    links = ids.unionByName(own)
    if fuzzy:
        links = links.unionByName(fuzzy_links(records).select("ord", F.concat(F.lit("row:"), F.col("match")).alias("key")))
    return components(links.select("ord", F.xxhash64("key").alias("key")), node="ord").withColumnRenamed("component", "cluster")


def merged(records: DataFrame, member: DataFrame) -> DataFrame:
    """One record a cluster: the richest one, its gaps filled from the next richest, ids and sources united.

    Richness is the abstract's length, ten an author and three an identifier;
    ties go to the least ``ord``.  All fields are aggregates, none needs the
    members of a cluster in one place.
    """
    rich = F.coalesce(F.length("abstract"), F.lit(0)) + 10 * F.coalesce(F.size("authors"), F.lit(0)) + 3 * F.size(id_keys())
    r = records.join(member, "ord").withColumn("by", F.struct((-rich).alias("rich"), F.col("ord")))
    fill = [F.min_by(c, F.when(_some(F.col(c)).isNotNull(), F.col("by"))).alias(c) for c in FILLED]
    base = [F.min_by(c, "by").alias(c) for c in ("title", "source", "entry_type")]
    return r.groupBy("cluster").agg(
        F.min_by("ord", "by").alias("base_ord"), F.count("*").alias("n_records"), *base, *fill,
        F.min_by("year", F.when(F.col("year").isNotNull(), F.col("by"))).alias("year"),
        F.min_by("authors", F.struct((-F.size("authors")).alias("n"), F.col("by"))).alias("authors"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.size("found_by") > 0, F.col("found_by")).otherwise(F.array("source")))))).alias("found_by"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(id_keys())))).alias("id_keys"),
    )


def deduplicated(records: DataFrame, fuzzy: bool = True) -> DataFrame:
    """One merged record for each study; see :func:`clusters` and :func:`merged`."""
    return merged(records, clusters(records, fuzzy))
