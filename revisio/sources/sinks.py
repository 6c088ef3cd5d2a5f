"""Writing results: tables, a checksummed manifest, BibTeX."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revisio.functions.text import ascii_fold, surname
from revisio.operators.flow import numbered


def save(df: DataFrame, path: str, kind: str = "parquet", by: str | None = None) -> None:
    """Writes a table as Parquet, CSV with header or JSON lines, partitioned by a column if named."""
    w = df.write.mode("overwrite")
    w = w.partitionBy(by) if by else w
    w.option("header", True).csv(path) if kind == "csv" else getattr(w, kind)(path)


def manifest(spark: SparkSession, path: str, **parameters: object) -> DataFrame:
    """``(file, bytes, sha256, parameters)`` of every file below a folder; a file is hashed in its task and must fit it."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    told = F.create_map(*[F.lit(str(x)) for kv in sorted(parameters.items()) for x in kv]) if parameters else F.create_map().cast("map<string,string>")
    return f.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), told.alias("parameters"))


def citation(authors: Column, year: Column, title: Column, journal: Column, style: str = "numeric", number: Column | None = None) -> Column:
    """A reference with up to six authors, in the style "numeric", "vancouver", "apa" or "harvard"."""
    many = F.size(authors) > 6
    names = F.concat(F.array_join(F.slice(authors, 1, 6), ", "), F.when(many, ", et al").otherwise(""))
    y = F.coalesce(year.cast("string"), F.lit("n.d."))
    if style == "apa":
        return F.concat(names, F.lit(" ("), y, F.lit("). "), title, F.lit(". "), journal, F.lit("."))
    if style == "harvard":
        return F.concat(names, F.lit(" "), y, F.lit(". \u2018"), title, F.lit("\u2019, "), journal, F.lit("."))
    body = F.concat_ws(" ", F.concat(names, F.lit(".")), F.concat(title, F.lit(".")), F.concat(journal, F.lit(".")), F.concat(y, F.lit(".")))
    return F.concat(number.cast("string"), F.lit(". "), body) if style == "vancouver" and number is not None else body


def letters(n: Column) -> Column:
    """1 is a, 26 is z, 27 is aa: no end to the letters."""
    z = F.lit(ord("a"))
    one = lambda k: F.chr(z + k)
    return F.when(n <= 26, one(n - 1)).when(n <= 702, F.concat(one(F.floor((n - 27) / 26)), one(F.pmod(n - 1, F.lit(26))))).otherwise(F.concat(F.lit("x"), n.cast("string")))


def cite_keys(records: DataFrame, id_col: str) -> DataFrame:
    """``(id, key)``: first author and year; where several share them, all but the first have a letter: a, b, c.

    Keys are numbered by ranges of key and id, so one that a third of all
    records share is no single task's work.
    """
    base = F.concat(F.coalesce(F.nullif(F.regexp_replace(ascii_fold(surname(F.try_element_at("authors", F.lit(1)))), "[^a-z]", ""), F.lit("")), F.lit("anon")), F.coalesce(F.col("year").cast("string"), F.lit("nd")))
    n = numbered(records.select(id_col, base.alias("base")), ["base", id_col], "number")
    first = n.groupBy("base").agg(F.min("number").alias("first"))
    k = n.join(first, "base").withColumn("r", F.col("number") - F.col("first"))
    return k.select(id_col, F.when(F.col("r") == 0, F.col("base")).otherwise(F.concat("base", letters(F.col("r")))).alias("key"))


def bibtex(records: DataFrame, id_col: str) -> DataFrame:
    """``(id, entry)``: a BibTeX entry of each record; braces and backslashes in a value are taken out, other signs of LaTeX escaped."""
    safe = lambda c: F.regexp_replace(F.regexp_replace(c, r"[{}\\\\]", ""), r"([&%$#_])", r"\\$1")
    field = lambda n, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"  {n} = {{"), c, F.lit("},\n"))).otherwise("")
    body = F.concat(field("title", safe(F.col("title"))), field("author", safe(F.array_join("authors", " and "))), field("journal", safe(F.col("journal"))), field("year", F.col("year").cast("string")), field("doi", F.col("doi")))
    r = records.join(cite_keys(records, id_col), id_col)
    return r.select(id_col, F.concat(F.lit("@"), F.coalesce(F.nullif("entry_type", F.lit("")), F.lit("misc")), F.lit("{"), F.col("key"), F.lit(",\n"), body, F.lit("}\n")).alias("entry"))


def handoff(records: DataFrame, decisions: DataFrame, path: str) -> None:
    """Saves the records that passed screening as JSON lines of eight columns."""
    kept = records.join(decisions.where("decision = 'include'").select("uid").distinct(), "uid", "left_semi")
    save(kept.select("uid", "title", "abstract", "doi", "pmid", "year", "journal", "url"), path, "json")


def included_csv(included: DataFrame, path: str) -> None:
    """Saves ``uid, citation, doi, source, year`` of the included records."""
    save(included.select("uid", citation(F.col("authors"), F.col("year"), F.col("title"), F.col("journal")).alias("citation"), "doi", "source", "year"), path, "csv")


def all_sources(records: DataFrame, path: str) -> None:
    """Saves all records with their status as CSV and as JSON lines, side by side."""
    flat = records.select(*[F.concat_ws("; ", c).alias(c) if kind == "array<string>" else F.to_json(c).alias(c) if kind.startswith(("map", "struct", "array")) else F.col(c) for c, kind in records.dtypes])
    save(flat, f"{path}/csv", "csv")
    save(records, f"{path}/json", "json")


def dossier(tables: dict[str, DataFrame], path: str) -> None:
    """Saves each table in a folder of its name: CSV for flat ones, JSON lines for nested ones."""
    for name, t in tables.items():
        nested = any(kind.startswith(("map", "struct", "array")) for _, kind in t.dtypes)
        save(t, f"{path}/{name}", "json" if nested else "csv")


def save_state(tables: dict[str, DataFrame], path: str) -> None:
    """Saves the tables of a run, to go on from later."""
    for name, t in tables.items():
        save(t, f"{path}/{name}")


def resumed(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    """The tables of a saved run."""
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def worksheet(questions: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """``(tool, domain, question, answer)``: an instrument's form, blank or filled in; ``questions`` is the instrument's table."""
    if answers is None:
        return questions.select("tool", "domain", "question", F.lit("").alias("answer"))
    return questions.join(answers, ["tool", "domain", "question"], "left").select(*answers.columns[:-1] if "uid" in answers.columns else ("tool", "domain", "question"), F.coalesce("answer", F.lit("")).alias("answer"))
