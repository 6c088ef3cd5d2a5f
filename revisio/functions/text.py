"""Column expressions on strings: white space, identifiers, titles."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    """Empty and blank strings become null: the input knows both forms of "missing"."""
    return F.when(F.trim(c) != "", c)


def squeeze(c: Column) -> Column:
    """White space runs become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def bare_doi(c: Column) -> Column:
    """A DOI in lower case without resolver address, scheme word or trailing stop; null if it is none.

    A DOI needs the form ``10.registrant/suffix``.  The registrant 0000 is not
    given out, so such values are placeholders.
    """
    x = F.lower(F.trim(F.regexp_replace(c, r"[\s\u00a0]+", " ")))
    x = F.regexp_replace(x, r"^(https?://[^/]*/|info:doi/|doi\s*:?\s*)+", "")
    x = F.regexp_replace(x, r"[\s.,;]+$", "")
    return F.when(x.rlike(r"^10\.\d{4,9}(\.\d+)*/\S+$") & ~x.rlike(r"^10\.0+/"), x)


def norm_title(c: Column) -> Column:
    """Lower case, letters, digits and blanks of a title."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9 ]", ""), r" +", " "))


def surname(c: Column) -> Column:
    """The first word of an author's name, lower case; a comma parts words too."""
    return F.lower(F.element_at(F.split(F.trim(F.regexp_replace(c, ",", " ")), r"\s+"), 1))


def tokens(c: Column) -> Column:
    """Distinct words of more than two letters or digits, lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda t: F.length(t) > 2))


def year_in(c: Column) -> Column:
    """The first year from 1900 to 2099 in a text."""
    return F.nullif(F.regexp_extract(c, r"((?:19|20)\d{2})", 1), F.lit("")).cast("int")


def _fold_table() -> tuple[str, str]:
    """Letters of Latin blocks with the ASCII letter that their decomposition begins with."""
    table = {}
    for cp in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        plain = unicodedata.normalize("NFKD", chr(cp)).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            table[chr(cp)] = plain
    return "".join(table), "".join(table.values())


_ACCENTED, _ASCII = _fold_table()


def ascii_fold(c: Column) -> Column:
    """A text in ASCII: accents are taken off, what has no ASCII base is dropped."""
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(F.regexp_replace(F.translate(c, _ACCENTED, _ASCII), r"[^\x00-\x7f]", ""))


def words_only(c: Column) -> Column:
    """Lower case with every run of other characters than letters a-z and digits as one blank: titles of reports."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def slug(c: Column, size: int = 48) -> Column:
    """A name for files: words parted by hyphens, shortened, no hyphen at either end; "review" for none."""
    x = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.left(x, F.lit(size)), "-+$", ""), F.lit("")), F.lit("review"))


def html_escaped(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def latex_escaped(c: Column) -> Column:
    """The characters with a meaning in LaTeX, written so that they show."""
    marked = F.replace(c, F.lit("\\"), F.lit("\u0001"))
    marked = F.regexp_replace(marked, r"([&%$#_{}])", r"\\$1")
    for sign, name in (("~", "\\textasciitilde{}"), ("^", "\\textasciicircum{}"), ("\u0001", "\\textbackslash{}")):
        marked = F.replace(marked, F.lit(sign), F.lit(name))
    return marked


def reviewer_label(role: Column) -> Column:
    """How a role is shown in reports: "Reviewer 2", "Adjudicator"."""
    n = F.regexp_extract(role, r"(\d+)$", 1)
    return F.when(n != "", F.concat(F.lit("Reviewer "), n)).otherwise(F.initcap(F.replace(role, F.lit("_"), F.lit(" "))))


def leading_year(c: Column) -> Column:
    """The year a date begins with; null if its first four characters are no number."""
    return F.substring(c, 1, 4).try_cast("int")


def other_ids(ids: Column, *known: str) -> Column:
    """The entries of a map of identifiers that are not among the known schemes and not empty."""
    return F.map_filter(ids, lambda k, v: ~k.isin(*known) & (v != ""))


def outer_json(c: Column) -> Column:
    """The outermost braces of an answer in prose or fences; null if there are none."""
    return F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit(""))
