"""Text operators on documents: sections, captions, reported statistics, references, inverted abstracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Headings that open a section.
HEADINGS = (
    "abstract", "background", "introduction", "related work", "materials and methods", "methods", "materials", "patients and methods", "study design", "data and methods", "statistical analysis",
    "results", "findings", "discussion", "limitations", "conclusion", "conclusions", "references", "bibliography", "acknowledgements", "supplementary", "appendix",
)
SPLIT = r"(?imd)^[ \t]*(?:\d+(?:\.\d+)*\.?[ \t]+)?(" + "|".join(sorted(HEADINGS, key=len, reverse=True)) + r")[ \t]*:?[ \t]*$"

#: A number as reports print it, and what stands between the ends of an interval.
_NUM = r"[-−]?(?:\d+\.)?\d+"
_TO = r"(?:\s*[,;–-]\s*|\s+to\s+)"
#: Names of effect measures and of measures of accuracy.
EFFECTS = ("aOR", "aHR", "OR", "RR", "HR", "SMD", "MD", "Cohen's d", "Hedges' g")
ACCURACY = ("AUROC", "AUPRC", "AUC", "F1", "accuracy", "sensitivity", "specificity", "precision", "recall")
#: Kinds of reported statistics, in the order in which a finding is given to one of them.
STATISTICS = {
    "p_value": r"(?i)\bp *[<>=≤≥] *0?\.\d+",
    "ci": rf"(?i)\b95 *% *CI[ :]*[\[(]?{_NUM}{_TO}{_NUM}",
    "n": r"(?i)\bn *= *\d+\b",
    "effect": rf"(?i)\b(?:{'|'.join(EFFECTS)}) *[=:] *{_NUM}",
    "mean_sd": rf"{_NUM} *± *(?:\d+\.)?\d+",
    "metric": rf"(?i)\b(?:{'|'.join(ACCURACY)})\b(?: (?:was|of|at|is))*[ =:]*(?:0?\.\d+|\d+(?:\.\d+)? ?%)",
}


def statistics(docs: DataFrame, id_col: str, text_col: str, most: int = 200) -> DataFrame:
    """``(id, kind, found, context)``: reported statistics of each text, each once by its letters and digits.

    ``context`` is the statistic with up to thirty characters before it (since
    the one before) and ten after it.  What two kinds match counts for the
    first of them; a text gives at most ``most``, the first kinds first.
    """

    def of(rank: int, kind: str, pattern: str) -> Column:
        parts = F.split(F.regexp_replace(F.translate(text_col, "\u0001\u0002", ""), pattern, "\u0001$0\u0002"), "\u0001")
        before = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.right(F.substring_index(x, "\u0002", -1), F.lit(30)))
        return F.transform(
            F.arrays_zip(before.alias("b"), F.slice(parts, 2, 2**31 - 2).alias("x")),
            lambda z: F.struct(F.lit(rank).alias("rank"), F.lower(F.regexp_replace(F.substring_index(z["x"], "\u0002", 1), r"\s+", "")).alias("found"), F.lit(kind).alias("kind"), F.concat(z["b"], F.substring_index(z["x"], "\u0002", 1), F.left(F.substring_index(z["x"], "\u0002", -1), F.lit(10))).alias("context")),
        )

    each = F.concat(*[of(n, k, p) for n, (k, p) in enumerate(STATISTICS.items())])
    once = docs.select(id_col, F.explode(each).alias("f")).groupBy(id_col, "f.found").agg(F.min("f").alias("f"))
    first = once.groupBy(id_col).agg(F.slice(F.array_sort(F.collect_list("f")), 1, most).alias("f"))
    return first.select(id_col, F.explode("f").alias("f")).select(id_col, "f.kind", "f.found", "f.context")


def sections(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, heading, body)``: the text under each heading line, the last one of repeated headings; empty ones are dropped."""
    heads = F.regexp_extract_all(text_col, F.lit(SPLIT), F.lit(1))
    bodies = F.slice(F.split(text_col, SPLIT), 2, 2**31 - 2)
    rows = docs.select(id_col, F.posexplode(F.arrays_zip(heads.alias("h"), bodies.alias("b"))).alias("pos", "x"))
    s = rows.select(id_col, "pos", F.lower("x.h").alias("heading"), F.regexp_replace("x.b", r"^\s+|\s+$", "").alias("body")).where("body <> ''")
    return s.groupBy(id_col, "heading").agg(F.max_by("body", "pos").alias("body"))


#: A caption's line: what it belongs to with its number, and its text.
CAPTION = r"(?i)^\s*((?:supplementary\s+)?(?:figure|fig|table)\b\.?\s*\d+)\s*[.:]?\s*(\S.*)$"


def captions(docs: DataFrame, id_col: str, text_col: str, size: int = 300) -> DataFrame:
    """``(id, label, caption)`` of each line that is a figure's or table's caption, its text shortened."""
    line = docs.select(id_col, F.explode(F.split(text_col, "\n")).alias("line"))
    return line.where(F.col("line").rlike(CAPTION)).select(id_col, F.regexp_extract("line", CAPTION, 1).alias("label"), F.left(F.regexp_extract("line", CAPTION, 2), F.lit(size)).alias("caption"))


def references(docs: DataFrame, id_col: str, text_col: str, most: int = 200) -> DataFrame:
    """``(id, n, reference)``: the numbered entries of more than twelve characters in the section of references or the bibliography, white space as blanks."""
    s = sections(docs, id_col, text_col).where("heading in ('references', 'bibliography')")
    marked = F.split(F.regexp_replace("body", r"(?m)^[ \t]*(?:\[\d+\]|\d+\.)[ \t]+", "\u0001"), "\u0001")
    flat = F.filter(F.transform(marked, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: F.length(x) > 12)
    return s.select(id_col, "heading", F.posexplode(F.slice(flat, 1, most)).alias("n", "reference")).select(id_col, (F.col("n") + 1).alias("n"), "reference")


def working_text(abstract: Column, sections_: Column, captions_: Column, statistics_: Column, size: int = 60_000) -> Column:
    """A report in one text, parts with their names, shortened: the abstract, its sections but the references, its captions and its statistics."""
    kept = F.map_filter(sections_, lambda k, v: ~F.lower(k).isin("references", "bibliography") & (v != ""))
    part = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}\n"), c))
    body = F.array_join(F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat(F.upper(e["key"]), F.lit("\n"), e["value"])), "\n\n")
    return F.left(F.concat_ws("\n\n", part("ABSTRACT", abstract), F.nullif(body, F.lit("")), part("CAPTIONS", F.array_join(captions_, "\n")), part("STATISTICS", F.array_join(statistics_, "; "))), F.lit(size))


def inverted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, word, position)``: the inverted index of a text's words, counted from 0."""
    return docs.where(F.col(text_col).isNotNull()).select(id_col, F.posexplode(F.filter(F.split(text_col, r"[ \n\t]+"), lambda w: w != "")).alias("position", "word")).select(id_col, "word", "position")


def deinverted(index: DataFrame, id_col: str) -> DataFrame:
    """``(id, text)``: words put back in the order of their positions."""
    words = F.array_sort(F.collect_list(F.struct("position", "word")))
    return index.groupBy(id_col).agg(F.array_join(F.transform(words, lambda x: x["word"]), " ").alias("text"))


def boolean_query(groups: Column, term: str = "{}", group: str = "({})") -> Column:
    """Terms of a group joined by OR, groups by AND; terms of several words are quoted; ``term`` and ``group`` wrap them."""
    fill = lambda pattern, x: F.replace(F.lit(pattern), F.lit("{}"), x)
    quoted = lambda t: fill(term, F.when(F.trim(t).contains(" "), F.concat(F.lit('"'), F.trim(t), F.lit('"'))).otherwise(F.trim(t)))
    one = lambda g: fill(group, F.array_join(F.transform(g, quoted), " OR "))
    return F.array_join(F.transform(F.filter(groups, lambda g: F.size(g) > 0), one), " AND ")


#: How the search dialects wrap a term and a group.
DIALECTS = {
    "pubmed": ("{}[Title/Abstract]", "({})"),
    "europepmc": ("(TITLE:{} OR ABSTRACT:{})", "({})"),
    "scopus": ("{}", "TITLE-ABS-KEY({})"),
    "wos": ("{}", "TS=({})"),
    "arxiv": ("abs:{}", "({})"),
    "ieee": ('"Abstract":{}', "({})"),
    "plain": ("{}", "({})"),
}


#: How the dialects limit years; both, the first alone, the last alone.  Where only one form exists, open ends are 1800 and 3000.
SPAN = {
    "pubmed": ' AND ("{a}"[Date - Publication] : "{b}"[Date - Publication])',
    "europepmc": " AND (PUB_YEAR:[{a} TO {b}])",
    "wos": " AND PY=({a}-{b})",
}


def dated_query(dialect: str, query: Column, first: Column, last: Column) -> Column:
    """A query limited to years; either end may be null, and dialects without a form for it stay as they are."""
    none = first.isNull() & last.isNull()
    if dialect == "scopus":
        more = F.concat(F.coalesce(F.concat(F.lit(" AND PUBYEAR > "), (first - 1).cast("string")), F.lit("")), F.coalesce(F.concat(F.lit(" AND PUBYEAR < "), (last + 1).cast("string")), F.lit("")))
    elif dialect in SPAN:
        more = F.replace(F.replace(F.lit(SPAN[dialect]), F.lit("{a}"), F.coalesce(first.cast("string"), F.lit("1800"))), F.lit("{b}"), F.coalesce(last.cast("string"), F.lit("3000")))
    else:
        return query
    return F.when(none, query).otherwise(F.concat(query, more))


#: The elements of a JATS body that hold text.
BODY = ("title", "p", "td", "th", "label", "caption")


def body_text(xml: Column) -> Column:
    """The text of an article's body in a JATS document, in order: titles, paragraphs, tables, labels, captions; null for what is no XML body."""
    parts = F.xpath(xml, F.lit("//body//text()[" + " or ".join(f"ancestor::{e}" for e in BODY) + "]"))
    return F.nullif(F.trim(F.regexp_replace(F.array_join(parts, " "), r"\s+", " ")), F.lit(""))


def relevant_window(text: Column, size: int, digest: Column | None = None, digest_size: int = 12_000) -> Column:
    """A long text without its references, from a little before its results heading on, ``size`` characters; shorter ones stay whole.  A digest comes first, shortened only to ``digest_size``."""
    body = F.regexp_replace(text, r"(?is)\n[ \t]*references[ \t]*\n.*$", "")
    at = F.greatest(F.lit(1), F.regexp_instr(body, F.lit(r"(?imd)^[ \t]*results[ \t]*$")) - size // 4)
    window = F.when(F.length(text) <= size, text).otherwise(F.substring(body, at, F.lit(size)))
    return window if digest is None else F.concat_ws("\n\n", F.left(digest, F.lit(digest_size)), window)


def short_label(name: Column) -> Column:
    """The acronym in parentheses of an arm's name, else its first three words."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"\(([A-Z][A-Z0-9-]{1,9})\)", 1), F.lit("")), F.array_join(F.slice(F.split(F.trim(name), r"\s+"), 1, 3), " "))


def first_available(*channels: Column) -> Column:
    """The first channel with a text: full text before preprint before abstract, say."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in channels])


def tally(rows: DataFrame, by: str, level: str) -> DataFrame:
    """``(by, level, n, pct)``: counts of levels and their share of the key's rows in percent."""
    n = rows.groupBy(by, level).agg(F.count("*").alias("n"))
    total = rows.groupBy(by).agg(F.count("*").alias("total"))
    k = n[by].eqNullSafe(total[by])
    return n.join(total, k).select(n[by], level, "n", (100 * F.col("n") / F.col("total")).alias("pct"))
