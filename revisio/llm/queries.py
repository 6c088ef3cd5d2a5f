"""The queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from revisio.llm import best, consensus, copies, cuts, looks, mixing, scans, sentences, tokens
from revisio.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda s, d: best.surviving(table(s, d, "records"), table(s, d, "source_trust")),
        "p1_current": lambda s, d: best.current(table(s, d, "records"), table(s, d, "source_trust")),
        "p2_found": lambda s, d: scans.noise(table(s, d, "pdf_documents")),
        "p2_paragraphs": lambda s, d: scans.paragraphs(table(s, d, "pdf_documents")),
        "p3_found": lambda s, d: copies.copy_links(table(s, d, "records")),
        "p3_collapsed": lambda s, d: copies.collapsed(table(s, d, "records")),
        "p4_found": lambda s, d: consensus.unsupported(table(s, d, "screening"), table(s, d, "screening_log")),
        "p4_consensus": lambda s, d: consensus.consensus(table(s, d, "screening"), table(s, d, "screening_log")),
        "p4_raters": lambda s, d: consensus.reliability(table(s, d, "screening"), table(s, d, "screening_log")),
        "p5_found": lambda s, d: looks.same_looking_pairs(table(s, d, "records")),
        "p6_found": lambda s, d: cuts.cut_rows(table(s, d, "records"), table(s, d, "fulltext")),
        "p6_shares": lambda s, d: cuts.cut_shares(table(s, d, "records"), table(s, d, "fulltext")),
        "p7_ids": lambda s, d: tokens.encode_corpus(table(s, d, "documents")),
        "p8_mix": lambda s, d: mixing.mixed(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p8_shares": lambda s, d: mixing.shares(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p9_found": lambda s, d: sentences.sentence_ends(table(s, d, "documents")),
    }


#: DuckDB's form of a bare DOI.
_DOI = r"""coalesce(nullif(regexp_extract(regexp_replace(regexp_replace(lower(trim(regexp_replace(coalesce(doi, ''), '[\s\u00a0]+', ' ', 'g'))), '^(https?://[^/]*/|info:doi/|doi\s*:?\s*)+', ''), '[\s.,;]+$', ''), '^(10\.[1-9][0-9]{3,8}(\.[0-9]+)*/\S+|10\.0*[1-9][0-9]*/\S+)$', 1), ''), '')""".replace("\\u00a0", "\u00a0")


def _shown(field: str) -> str:
    """A text as it shows, in DuckDB: look-alikes mapped, accents composed."""
    sql = f"translate({field}, '{looks._FROM.replace(chr(39), chr(39) * 2)}', '{looks._TO.replace(chr(39), chr(39) * 2)}')"
    for lig, plain in looks.LIGATURES.items():
        sql = f"replace({sql}, '{lig}', '{plain}')"
    return f"nfc_normalize({sql})"


def oracle_sql() -> dict[str, str]:
    pairs = " UNION ALL ".join(
        f"SELECT '{f}' AS field, a.ord AS ord_a, b.ord AS ord_b FROM (SELECT ord, {f} AS t, {_shown(f)} AS k FROM records WHERE {f} <> '') a JOIN (SELECT ord, {f} AS t, {_shown(f)} AS k FROM records WHERE {f} <> '') b ON a.k = b.k AND a.ord < b.ord AND a.t <> b.t" for f in ("title", "abstract")
    )
    return {
        "p3_found": rf"""WITH k AS (SELECT ord, replace(lower(upper(regexp_replace(title, '[\s\p{{P}}$+<=>^`|~]+', '', 'g'))), 'ς', 'σ') AS t, {_DOI} AS d FROM records),
          c AS (SELECT ord, min(ord) OVER (PARTITION BY t, d) AS first_ord FROM k WHERE t <> '') SELECT first_ord, ord AS copy_ord FROM c WHERE ord <> first_ord""",
        "p3_collapsed": rf"""WITH k AS (SELECT ord, replace(lower(upper(regexp_replace(title, '[\s\p{{P}}$+<=>^`|~]+', '', 'g'))), 'ς', 'σ') AS t, {_DOI} AS d FROM records)
          SELECT min(ord) AS first_ord, count(*) AS copies FROM k WHERE t <> '' GROUP BY t, d""",
        "p5_found": pairs,
    }
