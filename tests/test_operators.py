"""Core operators on small tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

from revisio.functions import effects as E
from revisio.functions.text import bare_doi, norm_title, surname
from revisio.operators import flow, pooling, resolve, screening, texts
from revisio.operators.components import components
from revisio.sources import citations, pages, sinks

RECORD = "ord long, source string, source_id string, doi string, pmid string, title string, abstract string, authors array<string>, year int, journal string, journal_abbrev string, volume string, issue string, pages string, entry_type string, url string, ids map<string,string>, found_by array<string>, retrieval_date string"


def rec(ord, title="", doi="", pmid="", ids=None, **more):
    base = dict(ord=ord, source="pubmed", source_id=str(ord), doi=doi, pmid=pmid, title=title, abstract="", authors=[], year=None, journal="", journal_abbrev="", volume="", issue="", pages="", entry_type="article", url="", ids=ids or {}, found_by=[], retrieval_date="")
    return tuple((base | more).values())


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), RECORD)


def test_two_by_two(spark):
    d = spark.createDataFrame([(10, 50, 5, 50), (0, 10, 0, 10), (0, 10, 3, 10), (11, 10, 3, 10), (None, 10, 3, 10)], "a int, n1 int, c int, n2 int")
    got = [r.e for r in d.select(E.two_by_two(*map(F.col, ("a", "n1", "c", "n2")), "OR").alias("e")).collect()]
    assert got[0].y == pytest.approx(0.81093, abs=1e-5)
    assert got[1] is None and got[3] is None and got[4] is None
    assert got[2].y < 0
    rr = d.limit(1).select(E.two_by_two(*map(F.col, ("a", "n1", "c", "n2")), "RR").alias("e")).first().e
    assert (rr.y, rr.v) == (pytest.approx(0.69315, abs=1e-5), pytest.approx(0.26))


def test_hedges_g_and_quartiles(spark):
    one = spark.range(1)
    g = one.select(E.hedges_g(*map(F.lit, (10.0, 2.0, 30.0, 8.0, 2.5, 30.0))).alias("e")).first().e
    assert g.y == pytest.approx(0.872, abs=1e-3)
    q = one.select(E.mean_sd_from_quartiles(*map(F.lit, (100.0, 8.0, 10.0, 12.0))).alias("e"), E.mean_sd_from_quartiles(*map(F.lit, (100.0, 11.0, 10.0, 12.0))).alias("bad")).first()
    assert q.e.mean == pytest.approx(10) and q.e.sd == pytest.approx(3.0, abs=0.05) and q.bad is None


def test_usable_drops_impossible_values(spark):
    rows = [("OR", 2.0, 0.1), ("OR", -1.0, 0.1), ("MD", float("nan"), 0.1), ("MD", float("inf"), 0.1), ("MD", 1.0, 0.0), ("PROP", 0.3, 0.02), ("PROP", 1.2, 0.02), ("MD", None, 0.1)]
    d = spark.createDataFrame(rows, "m string, e double, s double")
    no = F.lit(None).cast("double")
    got = [r.u is not None for r in d.select(E.usable(F.col("m"), F.col("e"), F.col("s"), no, no).alias("u")).collect()]
    assert got == [True, False, False, False, False, True, False, False]


def test_pool_of_one_and_of_none(spark):
    e = spark.createDataFrame([("a", 0.5, 0.1), ("b", 0.1, 0.2), ("b", 0.9, 0.2), ("c", None, 0.1)], "g string, y double, v double")
    got = {r.g: r for r in pooling.random_pool(e, ["g"]).collect()}
    assert set(got) == {"a", "b"} and got["a"].tau2 == 0 and got["b"].mu == pytest.approx(0.5)
    assert pooling.random_pool(e.limit(0), ["g"]).count() == 0


def test_components_of_long_chains_and_of_any_graph(spark):
    """A chain of a thousand nodes in any order, and random graphs against brute force; the rounds are few."""
    import random

    rng = random.Random(1)
    names = rng.sample(range(10_000), 1000)
    chain = [(names[i + d], f"k{i}") for i in range(999) for d in (0, 1)]
    got = components(spark.createDataFrame(chain, "node long, key string")).collect()
    assert {r.component for r in got} == {min(names)} and len(got) == 1000
    links = [(rng.randrange(300), f"k{rng.randrange(200)}") for _ in range(330)]
    root = {n: n for n, _ in links}
    changed = True
    while changed:
        changed = False
        for k in {k for _, k in links}:
            of = [n for n, x in links if x == k]
            low = min(root[n] for n in of)
            for n in of:
                if root[n] != low:
                    root[n], changed = low, True
    assert {tuple(r) for r in components(spark.createDataFrame(links, "node long, key string")).collect()} == set(root.items())


def test_components(spark):
    links = spark.createDataFrame([(5, "x"), (3, "x"), (3, "y"), (9, "y"), (1, "z"), (4, None)], "node long, key string")
    assert {tuple(r) for r in components(links).collect()} == {(5, 3), (3, 3), (9, 3), (1, 1)}


def test_chain_of_links_is_one_component(spark):
    links = spark.range(40).select(F.col("id").alias("node"), F.explode(F.array("id", F.col("id") + 1)).alias("key"))
    assert components(links).select("component").distinct().count() == 1


def test_bare_doi(spark):
    forms = ["10.1234/AB.c", " https://doi.org/10.1234/ab.C ", "DOI: 10.1234/ab.c.", "info:doi/10.1234/ab.c", "10.0000/unknown", "10.1234/", "n/a", "", None]
    got = [r.d for r in spark.createDataFrame([(f,) for f in forms], "x string").select(bare_doi(F.col("x")).alias("d")).collect()]
    assert got == ["10.1234/ab.c"] * 4 + [None] * 5


def test_dedup_cases(spark):
    same_doi = frame(spark, rec(1, "A", doi="10.1234/x"), rec(2, "A", doi="10.1234/X", abstract="long one"))
    m = resolve.deduplicated(same_doi).collect()
    assert len(m) == 1 and m[0].base_ord == 2 and m[0].n_records == 2
    dotted = frame(spark, rec(1, "A trial of sleep"), rec(2, "A trial of sleep."))
    assert resolve.deduplicated(dotted).count() == 1
    other = frame(spark, rec(1, "Drug X for chronic pain in older adults", authors=["Ann B"], year=2001), rec(2, "Drug Y for chronic pain in older adults", authors=["Bob C"], year=2005))
    assert resolve.deduplicated(other).count() == 2
    near = frame(spark, rec(1, "Computer aided detection in colonoscopy: a trial", authors=["Ann B"], year=2001), rec(2, "Computer aided detection at colonoscopy: a trial", authors=["Ann, B"], year=2001))
    assert resolve.deduplicated(near).count() == 1
    ids = frame(spark, rec(1, "T", doi="10.1234/y", pmid="7", found_by=["a"]), rec(2, "T2", ids={"pmid": "7"}, found_by=["b"], journal="J"))
    r = resolve.deduplicated(ids).collect()
    assert len(r) == 1 and r[0].found_by == ["a", "b"] and r[0].journal == "J"
    assert resolve.deduplicated(frame(spark, rec(1)).limit(0)).count() == 0


def test_uid(spark):
    got = [r.u for r in frame(spark, rec(1, "T", doi="10.1234/Z"), rec(2, " Title "), rec(3, None)).select(resolve.uid().alias("u")).collect()]
    assert got[0] == "doi:10.1234/z" and got[1] == "sha:" + hashlib.sha1(b"title").hexdigest()[:16] and got[2].startswith("sha:")


def test_token_sort_ratio():
    assert resolve.token_sort_ratio("b a", "a b") == 100
    assert resolve.token_sort_ratio("abcd", "abxd") == 75
    assert resolve.token_sort_ratio("", "x") == 0


def test_kappa(spark):
    d = spark.createDataFrame([("i", "i"), ("e", "e"), ("i", None)], "a string, b string")
    assert screening.kappa(d, "a", "b").first().kappa == 1.0
    swapped = spark.createDataFrame([("a", "b"), ("b", "a")] * 2, "a string, b string")
    assert screening.kappa(swapped, "a", "b").first().kappa < 0
    assert screening.kappa(d.limit(0), "a", "b").first().kappa is None


def test_affinity_half_even(spark):
    d = spark.createDataFrame([("include", 0.625), ("exclude", 2.0), ("maybe", None), (None, None)], "d string, c double")
    assert [r.g for r in d.select(screening.affinity(F.col("d"), F.col("c"), F.lit("sleep"), ("sleep", "pain")).alias("g")).collect()] == [8, 1, 6, 10]


def test_numbering_has_no_gap(spark):
    d = spark.range(500).select(F.col("id"), (F.col("id") % 7).alias("g"))
    got = [r.n for r in flow.numbered(d, ["g", "id"], "n", slices=5).orderBy("g", "id").collect()]
    assert got == list(range(1, 501))


def test_sections_and_inversion(spark):
    d = spark.createDataFrame([(1, "x\nMethods\nfirst\nResults:\n\nMETHODS\nlast one\n"), (2, None), (3, "")], "i int, t string")
    assert {(r.heading, r.body) for r in texts.sections(d, "i", "t").collect()} == {("methods", "last one")}
    t = spark.createDataFrame([(1, "to be or not to be"), (2, None)], "i int, t string")
    assert [tuple(r) for r in texts.deinverted(texts.inverted(t, "i", "t"), "i").collect()] == [(1, "to be or not to be")]


def test_statistics(spark):
    d = spark.createDataFrame([(1, "n = 40, p < 0.05 and P<0.05; 3.1 ± 0.2 (95% CI 1.2 to 3.4)")], "i int, t string")
    got = {(r.kind, r.found) for r in texts.statistics(d, "i", "t").collect()}
    assert got == {("n", "n=40"), ("p_value", "p<0.05"), ("mean_sd", "3.1±0.2"), ("ci", "95%ci1.2to3.4")}
    more = spark.createDataFrame([(1, "We found aOR = 1.4 and the AUC was 0.91 in all"), (2, None)], "i int, t string")
    got = {r.kind: r for r in texts.statistics(more, "i", "t").collect()}
    assert (got["effect"].found, got["effect"].context) == ("aor=1.4", "We found aOR = 1.4 and the A") and got["metric"].found == "aucwas0.91"


RIS = "TY  - JOUR\nTI  - A trial of\n   sleep\nAU  - Doe, A\nAU  - Roe, B\nPY  - 2010/01\nSP  - 1\nEP  - 9\nDO  - https://doi.org/10.1234/r\nER  - \n"
BIB = '@comment{x}\n@article{k1,\n title = {A {Nested} title},\n author = "Doe, A and Roe, B",\n year = 2011,\n pages = {1--9},\n doi = {doi:10.1234/b}\n}\n'
NBIB = "PMID- 77\nTI  - A long\n      title\nFAU - Doe, A\nDP  - 2012 Jan\nAID - 10.1234/n [doi]\n\nPMID- 78\nTI  - Second\n"
XML = "<xml><records><record><titles><title>An xml title</title></titles><dates><year>2013</year></dates><contributors><authors><author>Doe, A</author></authors></contributors></record></records></xml>"
CSV = 'Article Title,Authors,Publication Year,DOI\n"A, b",Doe A; Roe B,2014,10.1234/c\n,,,\n'


def test_citation_formats(spark):
    files = spark.createDataFrame([("a.ris", RIS), ("b.bib", BIB), ("c.nbib", NBIB), ("d.xml", XML), ("e.csv", CSV), ("f.xml", "<broken"), ("g", "@article{k, title={Sniffed}}"), ("h.ris", None)], "path string, text string")
    got = {(r.file, r.n): r for r in citations.parse_files(files).collect()}
    assert got["a.ris", 1].title == "A trial of sleep" and got["a.ris", 1].pages == "1-9" and got["a.ris", 1].doi == "10.1234/r" and got["a.ris", 1].year == 2010
    assert got["b.bib", 1].title == "A Nested title" and got["b.bib", 1].authors == ["Doe, A", "Roe, B"] and got["b.bib", 1].pages == "1-9"
    assert got["c.nbib", 1].title == "A long title" and got["c.nbib", 1].doi == "10.1234/n" and got["c.nbib", 2].pmid == "78"
    assert got["d.xml", 1].title == "An xml title" and got["d.xml", 1].year == 2013
    assert got["e.csv", 1].title == "A, b" and ("e.csv", 2) not in got
    assert got["f.xml", 0].entry_type == "error" and got["g", 1].title == "Sniffed"


def test_service_pages(spark):
    alex = '{"results":[{"id":"W1","doi":"https://doi.org/10.1234/A","title":"T","publication_year":2010,"abstract_inverted_index":{"to":[0,2],"be":[1]},"primary_location":{"source":{"display_name":"J"}}},{"id":"W2","title":null}]}'
    cross = '{"message":{"items":[{"DOI":"10.1234/B","title":["U"],"container-title":["K"],"issued":{"date-parts":[[2011,2]]}}]}}'
    trial = '{"studies":[{"protocolSection":{"identificationModule":{"nctId":"N1","briefTitle":"V"}}}]}'
    one = lambda s: spark.createDataFrame([(s,), ("no json",)], "value string")
    a = pages.records_of(one(alex), "openalex").collect()
    assert [(r.title, r.doi, r.abstract, r.journal) for r in a] == [("T", "10.1234/a", "to be to", "J")]
    c = pages.records_of(one(cross), "crossref").first()
    assert (c.title, c.year, c.journal) == ("U", 2011, "K")
    assert pages.records_of(one(trial), "clinicaltrials").first().title == "V"
    for s in pages.SERVICES:
        assert pages.records_of(one("{}"), s).count() == 0


def test_sinks(spark, tmp_path):
    d = frame(spark, rec(1, "T", authors=["Doe, A"], year=2001), rec(2, "U", authors=["Doe, B"], year=2001))
    assert {r.key for r in sinks.cite_keys(d, "ord").collect()} == {"doe2001", "doe2001a"}
    sinks.save(d.select("ord", "title"), str(tmp_path / "out"), "csv")
    m = sinks.manifest(spark, str(tmp_path / "out")).collect()
    assert m and all(len(r.sha256) == 64 for r in m)


def test_stream_of_records(spark, tmp_path):
    from revisio.streaming import ingest

    d = frame(spark, rec(1, "T", doi="10.1234/s", retrieval_date="2021-01-01"), rec(2, "T", doi="10.1234/S", retrieval_date="2021-01-02"), rec(3, "U", retrieval_date="2021-01-02"))
    d.write.parquet(str(tmp_path / "in"))
    q = ingest.append_new(ingest.new_records(spark, str(tmp_path / "in"), d.schema), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_fuzzy_links_against_all_pairs(spark):
    import random

    rng = random.Random(4)
    base = ["sleep and pain in older adults a randomised trial", "effect of light on mood in shift workers", "letter to the editor"]
    rows = []
    for i in range(90):
        t = rng.choice(base)
        if rng.random() < 0.5:
            p = rng.randrange(len(t))
            t = t[:p] + rng.choice("abc x") + t[p + rng.randrange(2) :]
        rows.append(rec(i, t, pmid="9" if rng.random() < 0.2 else "", authors=[rng.choice(["Doe, A", "Roe B"])] if rng.random() < 0.8 else [], year=rng.choice([2000, 2001, None])))
    d = frame(spark, *rows)
    flat = d.select("ord", norm_title(F.col("title")).alias("t"), "year", surname(F.try_element_at("authors", F.lit(1))).alias("a"), (F.size(resolve.id_keys()) > 0).alias("h")).orderBy("ord").collect()
    want = {}
    for i, r in enumerate(flat):
        for q in flat[:i]:
            x = resolve.token_sort_ratio(r.t, q.t)
            if not r.h and (x >= 99 or (x >= 90 and r.year is not None and r.year == q.year and r.a and r.a == q.a)):
                want[r.ord] = q.ord
                break
    assert {r.ord: r.match for r in resolve.fuzzy_links(d).collect()} == want


def test_titles_that_differ_in_several_words_against_all_pairs(spark):
    import random

    rng = random.Random(11)
    words = ["sleep", "pain", "older", "adults", "randomised", "controlled", "trial", "lower", "back", "stepped", "wedge", "effect", "of", "light", "mood", "shift", "workers"]
    long = [" ".join(rng.choice(words) for _ in range(n)) for n in (9, 18, 27, 40)]
    rows = [rec(0, "exercise given to adults with pain (lower back)"), rec(1, "exercise given to adults with pain (lower\nback)")]
    for i in range(2, 80):
        t = rng.choice(long)
        for _ in range(rng.choice([0, 1, 2, 3, 5])):
            p = rng.randrange(len(t))
            t = t[:p] + rng.choice(["", " ", "q", "-"]) + t[p + rng.randrange(2) :]
        rows.append(rec(i, t, pmid="9" if rng.random() < 0.2 else ""))
    d = frame(spark, *rows)
    flat = d.select("ord", norm_title(F.col("title")).alias("t"), (F.size(resolve.id_keys()) > 0).alias("h")).orderBy("ord").collect()
    want = {r.ord: m for i, r in enumerate(flat) if not r.h and (m := next((q.ord for q in flat[:i] if resolve.token_sort_ratio(r.t, q.t) >= 99), None)) is not None}
    assert len(want) > 10
    assert {r.ord: r.match for r in resolve.fuzzy_links(d).collect()} == want


def test_small_text_operators(spark):
    xml = "<article><front><p>no</p></front><body><sec><p>One <i>two</i></p><p>three</p></sec></body></article>"
    long = "x" * 90 + "\nResults\n" + "y" * 90 + "\nReferences\n1. z"
    d = spark.createDataFrame([(xml, long, "standard care as usual (SCU)", "", None), (None, "short", "sham light in the morning", "b", "c")], "x string, t string, n string, a string, b string")
    r = d.select(texts.body_text(F.col("x")).alias("x"), texts.relevant_window(F.col("t"), 100).alias("t"), texts.short_label(F.col("n")).alias("n"), texts.first_available(F.col("a"), F.col("b")).alias("f")).collect()
    assert r[0].x == "One two three" and r[1].x is None
    assert "Results" in r[0].t and "References" not in r[0].t and len(r[0].t) <= 100 and r[1].t == "short"
    assert [x.n for x in r] == ["SCU", "sham light in"] and [x.f for x in r] == [None, "b"]


def test_synthetic_records(spark):
    from revisio.sources.tables import synthetic_records

    a = synthetic_records(spark, "s", "q", 50).collect()
    assert a == synthetic_records(spark, "s", "q", 50).collect() and 40 <= len({r.doi for r in a}) < 50


def test_all_votes_count_whatever_their_spelling_and_scale(spark, tmp_path):
    from revisio.plans import core_queries

    rows = [(1, "a", "include", 0.7, None), (2, "a", "excl.", 90.0, "dose"), (3, "b", "Include ", None, None), (4, "c", "EXCLUDE", 0.8, "dose"), (5, "c", "maybe", 0.8, None), (6, "c", "include", None, None), (7, "d", "", 0.9, None), (8, "e", "exclude ", 0.6, "")]
    spark.createDataFrame(rows, "vote_id long, uid string, decision string, confidence double, reason string").write.parquet(str(tmp_path / "screening.parquet"))
    q = core_queries.queries()
    best = {r.uid: (r.decision, r.confidence) for r in q["best_decision"](spark, str(tmp_path)).collect()}
    assert best == {"a": ("exclude", 0.9), "b": ("include", None), "c": ("exclude", 0.8), "e": ("exclude", 0.6)}
    assert {tuple(r) for r in q["exclusion_reasons"](spark, str(tmp_path)).collect()} == {("dose", 2), ("Other", 1)}


def test_saved_outputs_and_resume(spark, tmp_path):
    d = frame(spark, rec(1, "A trial", "10.1234/a", authors=["Doe J"], year=2001, ids={"doi": "10.1234/a"}), rec(2, "B", authors=[], found_by=["x", "y"])).withColumn("uid", F.col("ord").cast("string"))
    votes = spark.createDataFrame([("1", "include"), ("2", "exclude")], "uid string, decision string")
    base = str(tmp_path)
    sinks.handoff(d, votes, f"{base}/handoff")
    assert [r.uid for r in spark.read.json(f"{base}/handoff").collect()] == ["1"]
    sinks.included_csv(d.where("ord = 1"), f"{base}/included")
    assert spark.read.csv(f"{base}/included", header=True).first().citation == "Doe J. A trial. . 2001."
    sinks.all_sources(d, f"{base}/sources")
    assert {r.found_by for r in spark.read.csv(f"{base}/sources/csv", header=True).collect()} == {None, "x; y"} and spark.read.json(f"{base}/sources/json").count() == 2
    sinks.dossier({"votes": votes, "records": d}, f"{base}/dossier")
    assert spark.read.csv(f"{base}/dossier/votes", header=True).count() == spark.read.json(f"{base}/dossier/records").count() == 2
    sinks.save_state({"votes": votes}, f"{base}/state")
    assert sinks.resumed(spark, f"{base}/state", "votes")["votes"].count() == 2
    q = spark.createDataFrame([("t", "d", "q1"), ("t", "d", "q2")], "tool string, domain string, question string")
    a = spark.createDataFrame([("t", "d", "q1", "Yes")], "tool string, domain string, question string, answer string")
    assert {r.answer for r in sinks.worksheet(q).collect()} == {""} and {(r.question, r.answer) for r in sinks.worksheet(q, a).collect()} == {("q1", "Yes"), ("q2", "")}


def test_more_effect_forms(spark):
    one = spark.range(1)
    five = one.select(E.mean_sd_from_five(*map(F.lit, (100.0, 2.0, 8.0, 10.0, 12.0, 18.0))).alias("e"), E.mean_sd_from_five(*map(F.lit, (100.0, 9.0, 8.0, 10.0, 12.0, 18.0))).alias("bad")).first()
    assert five.e.mean == pytest.approx(10) and five.e.sd == pytest.approx(3.1, abs=0.2) and five.bad is None
    # t of 2.0 with 58 degrees of freedom has p = 0.0502
    sd = one.select(E.sd_from_p(*map(F.lit, (5.0, 30, 4.0, 30, 0.0502))).alias("s")).first().s
    assert sd == pytest.approx(1 / (2.0 * (2 / 30) ** 0.5), rel=1e-3)
    assert one.select(E.log_odds_half(*map(F.lit, (0, 10, 5, 5))).alias("e")).first().e.y < 0


def test_xml_pages(spark):
    pubmed = "<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>7</PMID><Article><Journal><JournalIssue><PubDate><Year>2001</Year></PubDate></JournalIssue><Title>J</Title></Journal><ArticleTitle>A <i>b</i> trial</ArticleTitle><Abstract><AbstractText>One.</AbstractText><AbstractText>Two.</AbstractText></Abstract></Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType=\"doi\">10.1234/X</ArticleId></ArticleIdList></PubmedData></PubmedArticle></PubmedArticleSet>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><entry><id>http://arxiv.org/abs/1</id><published>2019-05-01</published><title>On\n  x</title><summary>S.</summary><arxiv:doi>10.1234/y</arxiv:doi></entry></feed>'
    page = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    r = pages.xml_records_of(page(pubmed, "", None), "pubmed").collect()
    assert [(x.source_id, x.title, x.doi, x.year, x.journal, x.abstract) for x in r] == [("7", "A b trial", "10.1234/x", 2001, "J", "One. Two.")]
    r = pages.xml_records_of(page(atom, "no xml"), "arxiv").collect()
    assert [(x.title, x.doi, x.year, x.abstract) for x in r] == [("On x", "10.1234/y", 2019, "S.")]
    assert pages.preprints(spark.createDataFrame([("bioRxiv",), ("Other",), (None,)], "publisher string")).count() == 1
