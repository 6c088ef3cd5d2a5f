"""Texts cut off by field limits or in transfer, and how often each source cuts.

Lengths are computed again under other encodings (code points, UTF-8 bytes,
entity escaping, JSON escaping, line ends of two characters).  Grouped by
source and encoding, a hidden storage limit shows as a length that far more
texts have than the lengths around it.  What the texts at the limits end with,
less what texts of nearby lengths end with, is how cut texts end.  Then the
endings are inspected: an ending counts as cut if, by what the limits taught,
most texts that end so were cut; at a limit the same endings weigh more.  Marks
that say themselves that a text was cut, and closing lines, which need no stop,
are judged by what they say.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revisio.plans.lineage import written

ENCODINGS = ("chars", "bytes", "entities", "json", "crlf")
#: Labels of closing lines that end without a stop.
LABELS = ("Keywords", "Registration", "Funding")
#: What stands for a missing text.
PLACEHOLDER = r"(?i)^\W*((no |the )?(abstract|text|summary|full text)?\W*(is )?(not (available|provided|found)|unavailable|missing|available|withheld|pending|to follow)|null|none|nil|nan?|n/?a|abstract|unknown|tbd|-*)\W*$".replace(r"\W", r"[^\p{L}\p{N}]")
#: Marks that editors and systems leave where they cut; in brackets at the end, these words.
MARKER = r"(?i)(\.\.\.|…|\[\s*(\.\.\.|…)\s*\]|�)\s*$|</?[\w:]{0,20}$"
SAID = r"(?i)\b(truncated|continued|cut off|abridged)\b[^()\[\]]*[)\]]\s*$"
CLOSED = r"[.!?。！？．｡]\s*[\"'”’»)）\]』」“]*$|[\]』」]$"
#: A word with a stop that may be an abbreviation.
SHORT_WORD = r"(?<![\p{L}.])(?:(?:\p{L}{1,3}\.){2,}|\p{L}{1,5}\.)"
#: Kinds of endings that no whole text should have; so much is believed of them before any limit was seen.
SUSPECT, OTHER = ("open", "bare", "odd", "weak"), ("word", "clean")
#: Rows at limits, and usual ones, that are counted for a kind of ending before any was seen: suspect kinds, others.
BELIEF = ((8.0, 1.0), (4.0, 4.0))
#: A kind of ending is one of cut texts if limits have it so many times as often as the lengths around them.
LIFT = 3.0
#: A length is a limit if its count exceeds what its neighbours have by so many standard errors.
ERRORS = 6.0
#: Neighbours of a length: from NEAR + 1 to FAR away, on both sides.
NEAR, FAR = 2, 12
#: Characters that some encoding lengthens or that open and close.
SIGNS = r"""[^&<>"'\\\n\r\t()（）«»「」『』„“”]+"""


def _count(signs: Column, *wanted: str) -> Column:
    return reduce(lambda a, b: a + b, [F.length(signs) - F.length(F.replace(signs, F.lit(ch), F.lit(""))) for ch in wanted])


def lengths(x: Column, signs: Column) -> dict[str, Column]:
    """The length of a text under each encoding; ``signs`` are its special characters."""
    chars = F.length(x)
    beyond = F.when(F.octet_length(x) > chars, chars - F.length(F.regexp_replace(x, r"[^\x00-\x7f]+", ""))).otherwise(0)
    return {
        "chars": chars,
        "bytes": F.octet_length(x),
        "entities": chars + 4 * _count(signs, "&", "'") + 3 * _count(signs, "<", ">") + 5 * _count(signs, "\""),
        "json": chars + _count(signs, "\"", "\\", "\n", "\r", "\t") + 5 * beyond,
        "crlf": chars + _count(signs, "\n"),
    }


def _open(x: str) -> Column:
    """Whether a bracket or quotation in the column stays open, wherever it opened: its last opening sign comes after its last closing one.

    Straight quotation marks, and “ where no „ is, open only before a character and after a blank, a bracket or nothing.
    """
    after = lambda s: f"length(substring_index({x}, {s}, -1))"
    pairs = F.expr(f"exists(array(struct('(' as a, '（' as b, ')' as c, '）' as d), struct('«' as a, '«' as b, '»' as c, '»' as d), struct('「' as a, '『' as b, '」' as c, '』' as d)), p -> least({after('p.a')}, {after('p.b')}) < least({after('p.c')}, {after('p.d')}))")

    def opens(*signs: str) -> str:
        n = " least(" + ", ".join(map(after, signs)) + ")" if len(signs) > 1 else after(signs[0])
        return f"({n} > 0 and {n} < length({x}) and substr(concat(' ', {x}), length({x}) - {n}, 3) rlike r'^[\\s(（][\"“\\u0027]\\S')"

    round_ = F.expr(f"""case when octet_length({x}) = length({x}) then instr({x}, '(') > 0 and {after("'('")} < {after("')'")} end""")
    pairs = F.coalesce(round_, pairs)  # a text in ASCII has no other brackets
    straight = F.expr(f"""(instr({x}, '"') > 0 or instr({x}, "'") > 0) and {opens("'\"'", '"\'"')}""")
    curled = F.expr(f"case when instr({x}, '„') > 0 then {after("'„'")} < {after("'“'")} when instr({x}, '“') > 0 then {after("'“'")} < {after("'”'")} and {opens("'“'")} else false end")
    return pairs | straight | curled


_LABEL = r"\b(" + "|".join(LABELS) + r"):\s[^.!?]*$"


def _ending(x: Column, y: Column, gap: Column) -> Column:
    """How a text ends: gap; marked (says that it was cut); open, bare, odd (kinds of SUSPECT); label; word (a short word with a stop); clean.  ``y`` are the last characters."""
    number = r"(?:\bCI|[=–±-]|\b[a-z]{2,})\s\d{1,3}\.$"
    said = F.when(F.right(y, F.lit(1)).isin(")", "]"), F.substring_index(F.substring_index(x, "(", -1), "[", -1).rlike(SAID)).otherwise(False)
    line = F.regexp_replace(F.substring_index(x, "\n", -1), r"[\p{Zs}\p{Cf}]+", " ")
    return (
        F.when(gap, "gap")
        .when(y.rlike(MARKER) | said, "marked")
        .when(_open("x"), "open")
        .when(~F.right(y, F.lit(1)).isin(".", "!", "?") & line.rlike(_LABEL), "label")
        .when(~y.rlike(CLOSED), "bare")
        .when(y.rlike(number + r"|(^|[\s(])\p{Lu}\.$|[,;:]\)?\.?$"), "odd")
        .when(y.rlike(SHORT_WORD + "$"), "word")
        .otherwise("clean")
    )


def inspected(texts: DataFrame, with_lengths: bool = True) -> DataFrame:
    """For ``(tbl, row_id, source, text)``: lengths, the kind of ending and what is needed to judge it; further columns stay."""
    x = F.when(F.right("text", F.lit(1)).rlike(r"[\s\p{Zs}\p{Cf}>]"), F.regexp_replace("text", r"([\s\p{Zs}\p{Cf}]*</[\w:]+>)*[\s\p{Zs}\p{Cf}]*$", "")).otherwise(F.col("text"))
    gap = F.col("text").isNull() | F.col("text").rlike(PLACEHOLDER)
    signs = [F.regexp_replace("text", SIGNS, "").alias("signs")] if with_lengths else []
    keep = [c for c in texts.columns if c not in ("tbl", "row_id", "source", "text")]
    t = texts.select("*", x.alias("x"), *signs, gap.alias("gap")).withColumn("y", F.regexp_replace(F.right("x", F.lit(48)), r"[\p{Zs}\p{Cf}]+", " "))
    src = F.coalesce(F.nullif(F.regexp_replace(F.lower(F.trim("source")), r"\s+", " "), F.lit("")), F.lit("(none)"))
    n = lengths(F.col("text"), F.col("signs")) if with_lengths else {}
    kind = t.select("tbl", "row_id", src.alias("source"), *keep, *[c.alias(e) for e, c in n.items()], _ending(F.col("x"), F.col("y"), F.col("gap")).alias("kind"), F.xxhash64("text").alias("text_hash"), "x", "y")
    tail = F.trim(F.regexp_replace(F.lower(F.regexp_extract(F.regexp_replace(F.substring_index("x", "\n", -1), r"[\p{Zs}\p{Cf}]+", " "), r"[:;,]\s*([^:;,]*)$", 1)), r"\d", "9"))
    return kind.select(*[c for c in kind.columns if c not in "xy"], F.when(F.col("kind") == "word", F.regexp_extract("y", SHORT_WORD + "$", 0)).otherwise("").alias("word"), F.when(F.col("kind") == "label", tail).alias("tail"))


def abbreviations(texts: DataFrame) -> DataFrame:
    """``(word)``: short words with a stop after which texts mostly go on in lower case or with a digit."""
    parts = texts.select(F.split("text", r"\.[ \n]").alias("p")).where("size(p) > 1")
    last_and_next = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.concat(F.substring_index(F.element_at("p", i), " ", -1), F.lit(". "), F.substring(F.element_at("p", i + 1), 1, 1)))
    hits = parts.select(F.explode(F.filter(last_and_next, lambda m: (F.length(m) < 14) | (F.length(F.replace(m, F.lit("."), F.lit(""))) + 2 < F.length(m)))).alias("m")).where(F.length("m") > 2)
    n = hits.groupBy("m").count()
    by = n.groupBy(F.regexp_extract("m", SHORT_WORD + r"(?= \S$)", 0).alias("word")).agg(F.sum(F.when(F.col("m").rlike(r"[\p{Ll}\d(]$"), F.col("count")).otherwise(0)).alias("low"), F.sum("count").alias("all"))
    return by.where("word <> '' and low * 2 > all").select("word")


def limits(rows: DataFrame) -> DataFrame:
    """``(tbl, source, encoding, length, kinds, excess)``: the hidden limits of each source, under the encoding that shows them best.

    ``kinds`` has, for each kind of ending, the rows at the limit and how many
    rows of that kind the lengths around it have on average; ``excess`` is how
    many rows more there are in all.  Closing lines are left out: a text may be
    made to end with one at its full length.
    """
    each = F.explode(F.array(*[F.struct(F.lit(e).alias("encoding"), F.col(e).alias("length")) for e in ENCODINGS]))
    n = rows.where("kind not in ('gap', 'label')").select("tbl", "source", "ending", each.alias("e")).groupBy("tbl", "source", "e.encoding", "e.length", "ending").agg(F.count("*").alias("c"))
    near = n.withColumn("off", F.explode(F.sequence(F.lit(-FAR), F.lit(FAR)))).where(f"off = 0 or abs(off) > {NEAR}")
    key = ["tbl", "source", "encoding", "length"]
    at = near.select("tbl", "source", "encoding", (F.col("length") + F.col("off")).alias("length"), "ending", F.when(F.col("off") == 0, F.col("c")).otherwise(0).alias("here"), F.when(F.col("off") != 0, F.col("c")).otherwise(0).alias("there"))
    at = at.groupBy(*key, "ending").agg(F.sum("here").alias("here"), (F.sum("there") / (2 * (FAR - NEAR))).alias("usual"))
    at = at.groupBy(*key).agg(F.sum("here").alias("n"), F.sum("usual").alias("u"), F.collect_list(F.struct("ending", "here", "usual")).alias("kinds"))
    found = at.withColumn("excess", F.col("n") - F.col("u")).where(F.col("excess") > ERRORS * F.sqrt(F.col("u") + 1))
    best = found.groupBy("tbl", "source").agg(F.max_by("encoding", F.struct("excess", "encoding")).alias("encoding"))
    return found.join(best, ["tbl", "source", "encoding"]).select(*key, "kinds", "excess")


def taught(lim: DataFrame) -> DataFrame:
    """``(ending, theta, lift)``: the share of cut texts that end so, and how many times as often as around them the limits have such endings.

    Texts at a limit are cut ones and as many whole ones as nearby lengths
    have.  So an ending of whole texts has a lift of 1, however many of those
    there are, and one of cut texts a high one.  Few rows hardly move what is
    believed at the start (BELIEF).  One row for each kind of ending.
    """
    spark = lim.sparkSession
    start = spark.createDataFrame([(e, *(BELIEF[0] if e in SUSPECT else BELIEF[1])) for e in (*SUSPECT, *OTHER)], "ending string, here double, usual double")
    seen = lim.select(F.explode("kinds").alias("k")).select("k.ending", F.col("k.here").cast("double").alias("here"), "k.usual").where(F.col("ending").isin(*SUSPECT, *OTHER))
    t = start.unionByName(seen).groupBy("ending").agg(F.sum("here").alias("here"), F.sum("usual").alias("usual"))
    more = F.greatest(F.col("here") - F.col("usual"), F.lit(0.0))
    one = F.lit(1).alias("one")
    all_ = t.agg(F.sum(more).alias("all")).select("*", one)
    return t.select("*", one).join(all_, "one").select("ending", (more / F.col("all")).alias("theta"), (F.col("here") / F.col("usual")).alias("lift"))


def corpus(records: DataFrame, fulltext: DataFrame) -> DataFrame:
    """The texts of both tables as ``(tbl, row_id, source, text)``."""
    a = records.select(F.lit("records").alias("tbl"), F.col("ord").alias("row_id"), "source", F.col("abstract").alias("text"))
    b = fulltext.select(F.lit("fulltext").alias("tbl"), F.col("ft_id").alias("row_id"), "source", "text")
    return a.unionByName(b)


def _by_ending(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """``rows`` with ``cut``: whether the ending alone shows a cut."""
    short = abbreviations(texts).withColumn("abbr", F.lit(True))
    # an unterminated closing line is whole if its value is a usual one and not the start of a far more usual one
    tails = rows.where("kind = 'label' and tail <> ''").groupBy("tail").agg(F.countDistinct("text_hash").alias("n"))
    begun = tails.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("tail") - 1, F.lit(1))), lambda i: F.substring("tail", F.lit(1), i))).alias("tail"), "n", F.col("tail").alias("whole"))
    begun = begun.where("tail <> whole").groupBy("tail").agg(F.max("n").alias("longer"))
    usual = tails.join(begun, "tail", "left").select("tail", ((F.col("n") >= 2) & (F.coalesce("longer", F.lit(0)) < 12 * F.col("n"))).alias("usual_tail"))
    j = rows.join(short, "word", "left").join(usual, "tail", "left")
    weak = (F.col("kind") == "word") & F.coalesce("abbr", F.lit(False))
    whole = F.col("kind").isin("gap", "word", "clean") & ~weak | ((F.col("kind") == "label") & F.coalesce("usual_tail", F.lit(False)))
    return j.withColumn("ending", F.when(weak, "weak").otherwise(F.col("kind"))).withColumn("cut", ~whole)


def ended(texts: DataFrame) -> DataFrame:
    """``(row_id, cut, gap)`` and the further columns of ``texts``, by the endings alone."""
    rows = written(inspected(texts, with_lengths=False), "ends")
    keep = [c for c in texts.columns if c not in ("tbl", "row_id", "source", "text")]
    return _by_ending(rows, texts).select("row_id", *keep, "cut", (F.col("kind") == "gap").alias("gap"))


def judged(texts: DataFrame) -> DataFrame:
    """``(tbl, row_id, source, cut, gap)`` of every row; null, empty, blank and placeholder texts are not cut.

    The limits and what they teach are small: a row for each limit and kind of
    ending.
    """
    j = written(_by_ending(written(inspected(texts), "cuts"), texts).drop("text_hash", "word", "tail", "abbr", "usual_tail"), "endings")
    lim = written(limits(j), "limits")
    model = written(taught(lim), "taught")
    # at a limit: the cuts there that end so, against the rows that would end so anyway
    per = lim.select("tbl", "source", "encoding", "length", "excess", F.explode("kinds").alias("k")).select("tbl", "source", "encoding", "length", "excess", "k.ending", "k.usual").join(model.select("ending", "theta"), "ending")
    sure = per.where(F.col("excess") * F.col("theta") > F.col("usual")).groupBy("tbl", "source", "ending").agg(F.collect_set(F.struct("encoding", "length")).alias("at"))
    by_ending = model.select("ending", "lift")
    j = j.join(by_ending, "ending", "left").join(sure, ["tbl", "source", "ending"], "left")
    at_limit = reduce(lambda a, b: a | b, [F.array_contains("at", F.struct(F.lit(e).alias("encoding"), F.col(e).alias("length"))) for e in ENCODINGS])
    said = F.col("kind").isin("marked", "label") & F.col("cut")
    cut = said | (F.coalesce("lift", F.lit(0.0)) > LIFT) | F.coalesce(at_limit, F.lit(False))
    return j.select("tbl", "row_id", "source", cut.alias("cut"), (F.col("kind") == "gap").alias("gap"))


def cut_rows(records: DataFrame, fulltext: DataFrame) -> DataFrame:
    """``(tbl, row_id)``: rows whose text was cut; a row repeated with its id comes once."""
    return judged(corpus(records, fulltext)).where("cut").select("tbl", "row_id").distinct()


def cut_shares(records: DataFrame, fulltext: DataFrame) -> DataFrame:
    """``(tbl, source, n_texts, n_cut, cut_share)``: how often each source cuts, placeholders left out."""
    by = judged(corpus(records, fulltext)).where("not gap").groupBy("tbl", "source").agg(F.count("*").alias("n_texts"), F.count_if("cut").alias("n_cut"))
    return by.withColumn("cut_share", F.col("n_cut") / F.col("n_texts"))
