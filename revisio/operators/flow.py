"""Flow counts, balance checks, audit events and numbering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from revisio.functions.text import ascii_fold, norm_title, surname
from revisio.plans.lineage import written

#: Name parts by which a source is a register.
REGISTER_HINTS = ("clinicaltrials", "clinical-trials", "prospero", "ictrp", "isrctn", "anzctr", "drks", "chictr", "ctri", "eudract", "regist")


def is_register(source: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(source).contains(h) for h in REGISTER_HINTS])


def by_source(records: DataFrame) -> DataFrame:
    """``(source, n, register)``."""
    return records.groupBy("source").agg(F.count("*").alias("n")).withColumn("register", is_register(F.coalesce("source", F.lit(""))))


def reasons(excluded: DataFrame, reason: str) -> DataFrame:
    """``(reason, n)``; an empty reason counts as "Other"."""
    return excluded.groupBy(F.coalesce(F.nullif(F.trim(reason), F.lit("")), F.lit("Other")).alias("reason")).agg(F.count("*").alias("n"))


def union_events(parts: list[tuple[str, DataFrame]], key: str, label: str, order: str) -> DataFrame:
    """``(phase, item, detail, seq)``: events of all phases, in the order of the phases, numbered within their phase.

    All phases are numbered at once by ranges of the whole order; a phase's
    numbers begin after the last one of the phase before.  So no phase is
    sorted by one task.
    """
    all_ = [d.select(F.lit(rank).alias("rank"), F.lit(phase).alias("phase"), F.col(key).cast("string").alias("item"), F.col(label).cast("string").alias("detail"), F.col(order).cast("long").alias("o")) for rank, (phase, d) in enumerate(parts)]
    n = numbered(reduce(lambda a, b: a.unionByName(b), all_), ["rank", "o", "item", "detail"], "number")
    begin = n.groupBy("phase").agg(F.min("number").alias("begin"))
    return n.join(begin, "phase").select("phase", "item", "detail", (F.col("number") - F.col("begin") + 1).alias("seq"))


def per_phase(events: DataFrame) -> DataFrame:
    """``(phase, n)``."""
    return events.groupBy("phase").agg(F.count("*").alias("n"))


def numbered(rows: DataFrame, order: list[str | Column], name: str, slices: int | None = None) -> DataFrame:
    """Rows with their number in a total order, without bringing all rows into one task.

    Rows are range-partitioned by the order, into as many ranges as the session
    shuffles into unless told otherwise; the counts of the ranges are summed and
    added to the numbers within.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    p = rows.repartitionByRange(slices or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols).withColumn("_p", F.spark_partition_id())
    # written once: a second evaluation could draw other ranges
    p = written(p.withColumn("_n", F.row_number().over(W.partitionBy("_p").orderBy(*cols))), "numbered")
    sizes = p.groupBy("_p").count()
    before = sizes.withColumn("_b", F.coalesce(F.sum("count").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_p", "_b")
    return p.join(F.broadcast(before), "_p").withColumn(name, F.col("_b") + F.col("_n")).drop("_p", "_n", "_b")


def citation_numbers(records: DataFrame) -> DataFrame:
    """``records`` with ``number``: by the first author's surname without accents, then year, then title, then ``ord``; missing ones last."""
    name = F.coalesce(F.nullif(ascii_fold(surname(F.try_element_at("authors", F.lit(1)))), F.lit("")), F.lit("zzzz"))
    return numbered(records, [name, F.coalesce("year", F.lit(9999)), norm_title(F.coalesce("title", F.lit(""))), F.col("ord")], "number")


def checks(counts: dict[str, tuple[Column, Column]], source: DataFrame) -> DataFrame:
    """``(check, lhs, rhs, passed)`` of a one-row table of counts."""
    rows = F.array(*[F.struct(F.lit(n).alias("check_name"), a.cast("long").alias("lhs"), b.cast("long").alias("rhs")) for n, (a, b) in counts.items()])
    return source.select(F.explode(rows).alias("c")).select("c.check_name", "c.lhs", "c.rhs", (F.col("c.lhs") == F.col("c.rhs")).alias("passed"))
