"""Text that looks the same in other characters.

Look-alike letters, full-width forms, ligatures, special blanks and invisible
characters are mapped to ordinary ones; what is left of the difference,
composed against combined accents, is settled by grouping under the accent-
sensitive Unicode collation.  The least mapped text of a class, in binary
order, is its canonical member and is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revisio.plans.lineage import written

# Letters of other scripts that have the shape of a Latin letter.
CYRILLIC = "аеорсухіѕјһԁԛԝАВЕКМНОРСТУХІЅЈԌԚԜ"
CYRILLIC_LATIN = "aeopcyxisjhdqwABEKMHOPCTYXISJGQW"
GREEK = "ονΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲϳϹͿ"
GREEK_LATIN = "ovABEZHIKMNOPTYXcjCJ"
#: Characters that show as a blank or as a hyphen.
BLANKS = "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
HYPHENS = "\u2010\u2011\u2012\ufe63"
#: Characters that do not show.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
FULL_WIDTH = "".join(map(chr, range(0xFF01, 0xFF5F)))
ORDINARY = "".join(map(chr, range(0x21, 0x7F)))

_FROM = CYRILLIC + GREEK + FULL_WIDTH + BLANKS + HYPHENS + INVISIBLE
_TO = CYRILLIC_LATIN + GREEK_LATIN + ORDINARY + " " * len(BLANKS) + "-" * len(HYPHENS)


def is_plain(c: Column) -> Column:
    """Whether a text has none but the ordinary ASCII characters."""
    return F.octet_length(c) == F.length(c)


def mapped(c: Column) -> Column:
    """``c`` with each look-alike character replaced and each invisible one dropped; null stays null."""
    x = F.translate(c, _FROM, _TO)
    for lig, plain in LIGATURES.items():
        x = F.replace(x, F.lit(lig), F.lit(plain))
    return F.when(is_plain(c), c).otherwise(x)


def loose_key(c: Column) -> Column:
    """A hash that is equal for mapped texts that are equal but for how accents are composed.

    Ideographs do not compose and stay; other characters beyond ASCII go, with
    the letters before combining marks.  An ASCII text is its own key.
    """
    return F.xxhash64(F.when(is_plain(c), c).otherwise(F.regexp_replace(c, r"[\x00-\x7f]\p{M}+|[^\x00-\x7f一-鿿]", "")))


def _values(rows: DataFrame, id_col: str, fields: tuple[str, ...]) -> DataFrame:
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])
    return rows.select(F.col(id_col).alias("id"), F.explode(each).alias("v")).select("id", "v.field", "v.text").where("text <> ''")


def classes(rows: DataFrame, id_col: str, fields: tuple[str, ...]) -> DataFrame:
    """``(field, id, raw, cls, canonical)``: the members of all classes that hold more than one string.

    ``raw`` is a hash of the string as it is, ``cls`` names the class,
    ``canonical`` is its canonical text where that isn't plain ASCII, else null
    (the mapped text is canonical then).  Only hashes of plain texts are
    shuffled.  Null and empty texts are in no class; repeated rows are members
    like others.
    """
    m = _values(rows, id_col, fields).withColumn("m", mapped(F.col("text")))
    keyed = m.select("field", "id", F.xxhash64("text").alias("raw"), loose_key(F.col("m")).alias("k"), F.when(~is_plain(F.col("m")), F.col("m")).alias("m"))
    several = keyed.groupBy("field", "k").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("field", "k")
    members = written(keyed.join(several, ["field", "k"]), "looks")
    accented = members.where("m is not null").select("field", "k", "m").distinct()
    by_sight = F.expr("m collate UNICODE")
    canon = accented.groupBy("field", "k", by_sight.alias("seen")).agg(F.min("m").alias("canonical"))
    named = accented.withColumn("seen", by_sight).join(canon, ["field", "k", "seen"]).select("field", "k", "m", "canonical")
    plain = members.where("m is null").select("field", "id", "raw", F.col("k").alias("cls"), F.lit(None).cast("string").alias("canonical"))
    rest = members.where("m is not null").join(named, ["field", "k", "m"]).select("field", "id", "raw", F.xxhash64("canonical").alias("cls"), "canonical")
    return plain.unionByName(rest)


def same_looking_pairs(rows: DataFrame, *, id_col: str = "ord", fields: tuple[str, ...] = ("title", "abstract")) -> DataFrame:
    """``(field, ord_a, ord_b)``: pairs of rows, the smaller id first, whose text looks the same but is another string.

    The strings of a class are paired, then their rows: no pair of equal
    strings is ever formed, so many copies of one string cost nothing by
    themselves.  Each pair comes once even if an id is repeated.
    """
    c = written(classes(rows, id_col, fields).select("field", "cls", "raw", "id").distinct(), "looks-classes")
    strings = c.select("field", "cls", "raw").distinct()
    other = strings.withColumnRenamed("raw", "raw_b")
    two = strings.join(other, ["field", "cls"]).where("raw < raw_b")
    left = c.withColumnRenamed("id", "id_a").join(two, ["field", "cls", "raw"])
    right = c.select("field", "cls", F.col("raw").alias("raw_b"), F.col("id").alias("id_b"))
    pairs = left.join(right, ["field", "cls", "raw_b"]).where("id_a <> id_b")
    return pairs.select("field", F.least("id_a", "id_b").alias("ord_a"), F.greatest("id_a", "id_b").alias("ord_b"))


def canonical_texts(rows: DataFrame, *, id_col: str = "ord", fields: tuple[str, ...] = ("title", "abstract")) -> DataFrame:
    """``(ord, field, canonical)``: each non-empty text in its canonical form.

    Texts that share a class with others get the class's member, all others
    their mapped text.
    """
    members = classes(rows, id_col, fields).where("canonical is not null").select("field", "id", "canonical").distinct()
    own = _values(rows, id_col, fields).select("field", "id", mapped(F.col("text")).alias("m"))
    return own.join(members, ["field", "id"], "left").select(F.col("id").alias(id_col), "field", F.coalesce("canonical", "m").alias("canonical"))
