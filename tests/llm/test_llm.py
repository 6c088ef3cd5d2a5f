"""Operators for training data on small tables, against brute force where SQL cannot say it."""

import collections
import itertools
import math
import random
import unicodedata
from datetime import datetime
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from revisio.llm import best, consensus, copies, cuts, looks, mixing, scans, sentences, tokens

RECORDS = "ord long, source string, doi string, pmid string, title string, abstract string, authors array<string>, year int, journal string, volume string, pages string, entry_type string, ids map<string,string>, retrieval_date string, a int, k int, h string"


def rec(ord, title=None, doi=None, pmid=None, abstract=None, source="pubmed", year=None, entry_type="article", at="2021-01-01", **more):
    base = dict(ord=ord, source=source, doi=doi, pmid=pmid, title=title, abstract=abstract, authors=[], year=year, journal="", volume="", pages="", entry_type=entry_type, ids={}, retrieval_date=at, a=1, k=2, h="x")
    return tuple((base | more).values())


def records(spark, *rows):
    return spark.createDataFrame(list(rows), RECORDS)


# ---- tokens ---------------------------------------------------------------


@pytest.fixture(scope="module")
def coder():
    return tokens.PairIndexCoder(open(tokens.VOCABULARY, encoding="utf-8").read())


def reference(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.VOCABULARY)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(list(texts), add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_the_library(coder, text):
    ends, flat = coder.encode([text])
    assert flat.tolist() == reference([text])[0]


def test_tokens_of_odd_texts(spark):
    texts = ["", None, "  \n\t ", "<|endoftext|> x", "aaaa" * 5000, "naïve “x” 试验 😀", "the the"]
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, ids int, id int")
    got = {r.doc_id: r.ids for r in tokens.encode_corpus(d).collect()}
    want = reference([t or "" for t in texts])
    assert [got[i] for i in range(len(texts))] == want and got[0] == got[1] == []
    assert tokens.encode_corpus(d.limit(0)).count() == 0
    assert tokens.encode_corpus(d.unionAll(d)).count() == 2 * len(texts)


# ---- look-alikes ------------------------------------------------------------


def shown(text):
    table = dict(itertools.zip_longest(map(ord, looks._FROM), looks._TO))
    text = text.translate(table)
    for a, b in looks.LIGATURES.items():
        text = text.replace(a, b)
    return unicodedata.normalize("NFC", text)


def test_same_looking_pairs_against_brute_force(spark):
    rng = random.Random(1)
    base = ["naïve trial of sleep", "São Lino", "office file", "试验（一）", "Москва и море"]
    change = [lambda s: unicodedata.normalize("NFD", s), lambda s: s.replace("a", "а"), lambda s: s.replace(" ", " "), lambda s: s[:3] + "​" + s[3:], lambda s: s.replace("ffi", "ﬃ"), lambda s: s.replace("e", "ｅ"), lambda s: s.upper(), lambda s: s.replace(" ", "  "), lambda s: s, lambda s: s + "."]
    rows = [rec(i, title=rng.choice(change)(rng.choice(base)), abstract=rng.choice(change)(rng.choice(base))) for i in range(150)]
    rows += [rec(200, title=None, abstract=""), rec(201, title="", abstract=None)]
    got = {tuple(r) for r in looks.same_looking_pairs(records(spark, *rows)).collect()}
    want = set()
    for field, k in (("title", 4), ("abstract", 5)):
        for a, b in itertools.combinations([r for r in rows if r[k]], 2):
            if a[k] != b[k] and shown(a[k]) == shown(b[k]):
                want.add((field, a[0], b[0]))
    assert got == want and got
    assert looks.same_looking_pairs(records(spark, *rows).limit(0)).count() == 0
    canon = {(r.ord, r.field): r.canonical for r in looks.canonical_texts(records(spark, *rows)).collect()}
    assert all(canon[a, f] == canon[b, f] for f, a, b in got)


# ---- copies -----------------------------------------------------------------


def test_copies(spark):
    rows = [
        rec(1, "Effect of X: a trial", "10.1234/a"), rec(2, "effect of x - A  TRIAL.", "https://doi.org/10.1234/A"), rec(3, "Effect of X: a trial", "n/a"), rec(4, "EFFECT OF X\na trial", None),
        rec(5, "Effect of Х: a trial", "10.1234/a"), rec(6, None, "10.1234/a"), rec(7, "...", "10.1234/a"), rec(8, "Effect of Y: a trial", "10.1234/a"), rec(9, "trial a: X of Effect", "10.1234/a"),
    ]
    d = records(spark, *rows)
    assert {tuple(r) for r in copies.copy_links(d).collect()} == {(1, 2), (3, 4)}
    assert {r.first_ord: r.copies for r in copies.collapsed(d).collect()} == {1: 2, 3: 2, 5: 1, 8: 1, 9: 1}
    assert copies.copy_links(d.limit(0)).count() == 0


def test_a_hot_class_of_copies(spark):
    d = spark.range(3000).select(F.col("id").alias("ord"), F.when(F.col("id") % 3 == 0, "Editorial").otherwise(F.concat(F.lit("t"), "id")).alias("title"), F.lit("").alias("doi"))
    got = copies.copy_links(d)
    assert got.count() == 999 and got.select("first_ord").distinct().count() == 1


# ---- best record --------------------------------------------------------------


def test_best_values(spark):
    whole = "Sleep is short. We gave X to 20 adults. X may help sleep in adults."
    rows = [
        rec(1, "A trial of X for sleep in older adults", "10.1234/p.v1", abstract=whole[:45], source="BioRxiv ", year=2010, entry_type="preprint"),
        rec(2, "A trial of X for sleep in older adults.", "n/a", pmid="77", abstract="<p>" + whole + "</p>", year=9999),
        rec(3, None, None, pmid="77", abstract=whole, source="core", year=2011),
        rec(4, "A TRIAL OF X FOR SLEEP IN OLDER ADULTS", "doi: 10.1234/X", abstract=whole + " Copyright © 2010 The Authors. All rights reserved.", source="crossref", year=2012),
        rec(5, "Erratum to: A trial of X for sleep in older adults", "10.1234/e"),
        rec(6, "Editorial", "10.1234/f"), rec(7, "Editorial", "10.1234/g"), rec(8, "Editorial", "10.1234/g", source=None, year=2000),
        rec(9, None), rec(10, "", ""),
    ]
    trust = spark.createDataFrame([("pubmed", 1, "index"), ("crossref", 4, "index"), ("core", 7, "index"), ("biorxiv", 9, "preprint")], "source string, trust_rank int, kind string")
    got = {(r.first_ord, r.field): r.best for r in best.surviving(records(spark, *rows), trust).collect()}
    assert got == {(1, "doi"): "10.1234/x", (1, "source"): "pubmed", (1, "year"): "2012", (1, "abstract"): "3", (7, "doi"): "10.1234/g", (7, "source"): "pubmed", (7, "year"): "2000"}
    assert best.surviving(records(spark, *rows).limit(0), trust).count() == 0


def test_currency_decides_between_equally_trusted_rows(spark):
    """Other studies' dates teach that one registrant's DOIs are followed by another's; an undated row wins by that."""
    rows = []
    for i in range(20):
        title = f"A trial of substance {'abcdefghijklmnopqrst'[i] * 5} for sleep in older adults"
        rows += [rec(10 * i, title, f"10.1101/p{i}", at="2020-01-01", year=2020), rec(10 * i + 1, title, f"10.1016/f{i}", at="2021-06-01", year=2021)]
    tie = "Another trial of something for sleep in older adults"
    rows += [rec(500, tie, "10.1101/p", at="2022-01-01", year=2020), rec(501, tie, "10.1016/f", at=None, year=None)]
    trust = spark.createDataFrame([("pubmed", 1, "index")], "source string, trust_rank int, kind string")
    got = {(r.first_ord, r.field): r.best for r in best.surviving(records(spark, *rows), trust).collect()}
    assert got[500, "doi"] == "10.1016/f" and got[0, "doi"] == "10.1016/f0" and got[0, "year"] == "2021"
    # without the other studies nothing is learnt and the dated value stands
    alone = {(r.first_ord, r.field): r.best for r in best.surviving(records(spark, *rows[-2:]), trust).collect()}
    assert alone[500, "doi"] == "10.1101/p"
    now = {(r.first_ord, r.field): r.best for r in best.current(records(spark, *rows), trust).collect()}
    assert now[500, "doi"] == "10.1016/f" and now[500, "year"] == "2020"


def test_precedence_and_latest_values(spark):
    from datetime import date

    steps = spark.createDataFrame([("f", "a", "b")] * 9 + [("f", "b", "c")] * 9 + [("f", "c", "d")] * 3 + [("f", "d", "c")] * 3 + [("f", "x", "y"), ("f", "y", "x")], "field string, a string, b string")
    order = best.precedence(steps)
    assert {(r.cls, r.after) for r in order.collect()} == {("a", "b"), ("b", "c"), ("a", "c")}
    d = [(g, "f", v, v[0], at, n) for n, (g, v, at) in enumerate([(1, "a1", date(2021, 1, 1)), (1, "c1", None), (1, "a2", date(2022, 1, 1)), (2, "b1", None), (2, "a1", None), (3, "c1", date(2020, 1, 1)), (3, "a1", date(2021, 1, 1)), (4, "z1", None), (4, "z2", None), (4, "z2", None)])]
    v = spark.createDataFrame([*d, (5, "f", None, None, None, 9)], "group long, field string, value string, cls string, at date, ord long")
    # undated c follows a; dates beat what was learnt; what nothing orders goes by the number of rows
    assert {r.group: r.value for r in best.latest(v, order).collect()} == {1: "c1", 2: "b1", 3: "a1", 4: "z2"}
    assert best.latest(v.limit(0), best.precedence(steps.limit(0))).count() == 0


# ---- cut texts ----------------------------------------------------------------


def test_endings(spark):
    cut = ["We gave X to 20 adu", "The effect was 3.2 (95% CI 1.", "Findings (ABSTRACT TRUNCATED)", "We found that...", "One. Two [...]", "He wrote: «Small sample. No", "A full one. T�", "<p>Begun and then<su", "We saw J."]
    whole = ["All is well.", "Is it safe?", "It ended (see Fig. 2).", "He said “ready.”", "试验结束。", "X fell by 6.5.", "<p>All is well.</p>", "No abstract available.", "n/a", "-", "", "   ", None, "A" * 50_000 + "."]
    rows = [rec(i, abstract=x) for i, x in enumerate(cut + whole)]
    got = {r.row_id for r in cuts.cut_rows(records(spark, *rows), spark.createDataFrame([], "ft_id long, source string, text string")).collect()}
    assert got == set(range(len(cut)))


def test_hidden_limit_in_bytes(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcé ") for _ in range(300)) for _ in range(120)]
    rows = [rec(i, abstract=t.encode()[:100].decode(errors="ignore")) for i, t in enumerate(texts)]
    corpus = cuts.corpus(records(spark, *rows), spark.createDataFrame([], "ft_id long, source string, text string"))
    lim = cuts.limits(cuts._by_ending(cuts.inspected(corpus), corpus))
    assert {(r.source, r.encoding) for r in lim.where("length in (99, 100)").collect()} == {("pubmed", "bytes")}


def test_a_limit_decides_on_clean_ends(spark):
    """A text that ends with a sentence is cut at its source's limit and whole elsewhere; without the limit it is whole."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(60))[: n - 1]
    rows = [rec(i, abstract=text(200) + "x", source="limited") for i in range(300)]
    rows += [rec(400 + i, abstract=text(150 + rng.randint(0, 400)) + ".", source="free") for i in range(300)]
    clean = text(200) + "."
    rows += [rec(900, abstract=clean, source="limited"), rec(901, abstract=clean, source="free"), rec(902, abstract=text(180) + ".", source="limited")]
    none = spark.createDataFrame([], "ft_id long, source string, text string")
    got = {r.row_id for r in cuts.cut_rows(records(spark, *rows), none).collect()}
    assert got == set(range(300)) | {900}
    few = [r for r in rows if r[0] >= 297]  # no limit shows in these
    assert {r.row_id for r in cuts.cut_rows(records(spark, *few), none).collect()} == set(range(297, 300))


def test_endings_far_from_the_end(spark):
    """Quotations opened and closing lines begun long before the end; long markers; texts of other scripts without stops."""
    long = "word " * 400
    cut = ["He said: «" + long + "and left.", "(see " + long + "there.", "It is. [" + "much of this abstract, which is very long indeed, was truncated at this place]", "该效果能否持续"]
    whole = ["It is so. Keywords: " + ", ".join(f"term{i}" for i in range(90)), "He said «" + long + "» and left."]
    rows = [rec(i, abstract=x) for i, x in enumerate(cut + whole + ["And so" + whole[0]])]
    got = {r.row_id for r in cuts.cut_rows(records(spark, *rows), spark.createDataFrame([], "ft_id long, source string, text string")).collect()}
    assert got == set(range(len(cut)))


# ---- consensus ------------------------------------------------------------------


def test_consensus_recovers_truth_and_spammers(spark):
    rng = random.Random(5)
    truth = {f"u{i}": rng.choice(["include", "exclude"]) for i in range(300)}
    skill = {"good1": 0.95, "good2": 0.9, "fair": 0.75, "spam1": 0.0, "spam2": 0.0}
    rows, n = [], 0
    for u, t in truth.items():
        for r, p in skill.items():
            n += 1
            rows.append((n, u, "reviewer_1", r, t if rng.random() < p else rng.choice(["include", "EXCLUDE ", "maybe"]), datetime(2022, 1, 1)))
    rows += rows[:50] + [(n + 1, "u0", "reviewer_2", "good1", None, None), (n + 2, None, None, None, "include", None)]
    v = spark.createDataFrame(rows, "vote_id long, uid string, reviewer string, rater string, decision string, decided_at timestamp")
    flip = {"u1", "u2", "u3"}
    other = {"include": "Excluded", "exclude": "included "}
    log = spark.createDataFrame([(u, None, None, None, other[t] if u in flip else t) for u, t in truth.items()] + [("u9", "", "", "", ""), ("nobody", "include", "include", None, "included")], "uid string, reviewer_1 string, reviewer_2 string, adjudicator string, final string")
    got = {r.uid: r for r in consensus.consensus(v, log).collect()}
    assert sum(got[u].consensus == t for u, t in truth.items()) > 285
    r = {x.rater: x.competence for x in consensus.reliability(v, log).collect()}
    assert min(r["good1"], r["good2"]) > 0.8 > r["fair"] > 0.5 > max(r["spam1"], r["spam2"])
    wrong = {x.uid for x in consensus.unsupported(v, log).collect()}
    assert flip <= wrong and "u9" not in wrong and len(wrong) < 20
    assert consensus.unsupported(v.limit(0), log.limit(0)).count() == 0


# ---- mixing -----------------------------------------------------------------------


def test_mix(spark):
    d = spark.createDataFrame([(i, "word " * (5 + i % 7), "A" if i < 300 else " b" if i < 330 else "c") for i in range(360)] + [(900, None, "A"), (901, "", "b"), (902, "x", None), (1, "word " * 6, "A")], "doc_id long, text string, source string")
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 3), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    rows = mixing.mixed(d, t).collect()
    assert {r.source for r in rows} == {"a", "b"} and max(r.copies for r in rows if r.source == "b") <= 3 and max(r.copies for r in rows if r.source == "a") == 1
    assert len({r.doc_id for r in rows}) == len(rows)
    s = {r.source: r for r in mixing.shares(d, t).collect()}
    assert s["gone"].n_docs == 0 and math.isclose(sum(r.reached_share for r in s.values()), 1)
    assert mixing.mixed(d.limit(0), t).count() == 0
    # the sampled rest is what sorting all keys gives
    b = {r.source: r for r in mixing.budgets(mixing.sized(d), t).collect()}
    keyed = sorted((r.key, r.doc_id, r.tokens) for r in mixing.sized(d).where("source = 'a'").withColumn("key", mixing.sampling_key(F.col("doc_id"), F.col("weight"))).collect())
    total, want = 0, set()
    for _, i, n in keyed:
        total += n
        if total <= b["a"].rest or b["a"].epochs:
            want.add(i)
    assert {r.doc_id for r in rows if r.source == "a"} == want


# ---- sentences ----------------------------------------------------------------------


KNOWN = {w: (1, 0.0) for w in ("Dr", "Prof", "J", "K", "al")}


@lru_cache
def chain():
    rng = random.Random(2)
    said = ["Dr. Roe met Prof. Doe.", "All went well.", "It was late.", "We saw J. K. Roe et al. in May.", "Many came.", "Was it safe?", "It was!", "They met Dr. Moe and Prof. Low again.", "ผลดีมาก"]
    return sentences.fit(["".join(rng.choice(said) + rng.choice([" ", " ", "\n\n"]) for _ in range(12)) for _ in range(120)], KNOWN)


def units(text):
    ends = sentences.decode(text, KNOWN, chain())
    return [text[a:b].strip() for a, b in zip([0, *ends], ends)]


def test_units():
    assert units('Dr. Roe came. The note read: "Unclear. No blinding." All left.') == ["Dr. Roe came.", 'The note read: "Unclear. No blinding."', "All left."]
    assert units("审稿人写道：“不清楚。样本小。”两名评审员筛选。“是否？”他问道。") == ["审稿人写道：“不清楚。样本小。”", "两名评审员筛选。", "“是否？”他问道。"]
    assert units("It fell by 3.2 points. It rose.Then it ended") == ["It fell by 3.2 points.", "It rose.", "Then it ended"]
    assert units("Methods\nWe met. All left.") == ["Methods", "We met.", "All left."]
    assert units("ผลดีมาก ควรทำต่อ\nจบแล้ว")[-1] == "จบแล้ว"
    assert units("") == [] == units("  \n ")
    assert units("...") == ["..."]


def test_viterbi_finds_the_best_of_all_sequences():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = 7
        m = sentences.Chain()
        m.move = rng.normal(size=m.move.shape)
        e, letters, gaps = rng.normal(size=n).tolist(), (rng.random(n) < 0.6).tolist(), rng.integers(1, 60, n).tolist()

        def score(tags):
            s, before, open_ = 0.0, True, False
            for tag, x, let, g in zip(tags, e, letters, gaps):
                open_ = open_ or let
                if tag and not open_:
                    return -np.inf
                s += m.move[int(before), int(tag), sentences._bin(g)] + (x if tag else 0)
                before, open_ = tag, open_ and not tag
            return s

        want = max(itertools.product([False, True], repeat=n), key=score)
        assert math.isclose(score(m.decode(e, letters, gaps)), score(want))


def test_the_chain_decides():
    text = "We saw Dr. Roe. All went well. They met Prof. Low et al. in May. J. K. Moe came."
    assert units(text) == ["We saw Dr. Roe.", "All went well.", "They met Prof. Low et al. in May.", "J. K. Moe came."]
    rule = sentences.Chain()
    rule.w = np.array([5.0])  # every free place is a boundary
    assert len(sentences.decode(text, KNOWN, rule)) > 4
    # transitions count: a strong weight against boundaries close to each other takes one away
    near = sentences.Chain()
    near.ids, near.w, near.move = chain().ids, chain().w, chain().move.copy()
    near.move[1, 1] -= 100
    assert len(sentences.decode(text, KNOWN, near)) < 4


def test_gradient_of_the_chain():
    """Expected tags are the derivative of the log partition sum."""
    rng = np.random.default_rng(5)
    n, size = 3, 4
    on, letters, bins = np.ones((n, size), bool), rng.random((n, size)) < 0.7, rng.integers(0, sentences.BINS, (n, size)).astype(np.int8)
    fixed, many, x = np.full((n, size), -1, np.int8), np.ones(n), np.arange(n * size).reshape(-1, 1)
    m = sentences.Chain()
    m.w, m.move = rng.normal(size=n * size), rng.normal(size=m.move.shape)
    p, pairs = sentences._expected(m, x, on, letters, bins, fixed, many)
    want, two = np.zeros((n, size)), np.zeros_like(m.move)
    for i in range(n):
        total = 0.0
        for tags in itertools.product([0, 1], repeat=size):
            s, before, open_, moves = 0.0, 1, False, []
            for t, tag in enumerate(tags):
                open_ = open_ or letters[i, t]
                if tag and not open_:
                    break
                moves.append((before, tag, bins[i, t]))
                s += m.move[before, tag, bins[i, t]] + tag * m.w[i * size + t]
                before, open_ = tag, open_ and not tag
            else:
                total += np.exp(s)
                want[i] += np.exp(s) * np.array(tags)
                for k in moves:
                    two[k] += np.exp(s) / 1.0
        want[i] /= total
        assert np.allclose(p[i], want[i])
    assert np.allclose(pairs.sum(), n * size)


def test_words_joined_or_broadcast(spark):
    rng = random.Random(6)
    said = ["Dr. Roe saw men.", "All left.", "They met Prof. Low.", "Many came."]
    d = spark.createDataFrame([(i, "".join(x + rng.choice([" ", "\n\n"]) for x in rng.sample(said, 4))) for i in range(60)], "doc_id long, text string")
    a, b = (sorted(map(tuple, sentences.sentence_ends(d, broadcast_words=n).collect())) for n in (10**6, 0))
    assert a == b and len(a) == 240


def test_keys_are_the_same_in_sql(spark):
    texts = ["Dr. Roe (n. 3.) met am 3. Mai. It ended.Then J. K. came at 7.9. See Fig. 2. «Pas. » Fin...", "د. Roe. المتوسط. هل"]
    got = {r.key for r in sentences.word_statistics(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    own = {p.key for t in texts for p in sentences.places(t) if p.key and not (t[p.end : p.end + 1].isalnum())}
    assert got and got <= own


def test_sentence_rows(spark):
    d = spark.createDataFrame([(1, "One. Two.", 0), (2, None, 0), (3, " ", 0), (4, "x" * 100_000, 0), (1, "One. Two.", 0)], "doc_id long, text string, end_pos int")
    got = collections.Counter(tuple(r) for r in sentences.sentence_ends(d).collect())
    assert got == {(1, 4): 2, (1, 9): 2, (4, 100_000): 1}
    assert sentences.sentence_ends(d.limit(0)).count() == 0


# ---- scanned text -----------------------------------------------------------------------


def report(pages=3, seed=1):
    rng = random.Random(seed)
    vocab = "the trial of sleep showed results between groups and adults were allocated to treatment under conditions".split()
    lines, truth = ["A trial of sleep", "Doe A, Roe B", ""], []
    for p in range(1, pages + 1):
        for _ in range(25):
            lines.append(" ".join(rng.choice(vocab) for _ in range(8)))
        lines += [f"Page {p} of {pages}", "ANNALS OF SLEEP RESEARCH"]
        truth += [len(lines) - 1, len(lines)]
    return lines, truth


def test_noise_in_reports(spark):
    rows = []
    for k in range(60):
        lines, _ = report(seed=k)
        rows.append((k, "\n".join(lines), 3))
    lines, running = report(seed=99)
    lines[5] = "adults were allo-"
    lines[6] = "cated to tr3atm€nt"[:9] + "treatm€nt under conditions"
    rows += [(99, "\n".join(lines), 3), (100, None, 3), (101, "", None), (102, "one line", None)]
    part = "\n".join(lines[4:9])
    rows = [(*r, {"methods": part, "other": "a b\nc"} if r[0] == 99 else None) for r in rows]
    d = spark.createDataFrame(rows, "pdf_id long, full_text string, n_pages int, sections map<string,string>")
    got = collections.defaultdict(set)
    for r in scans.noise(d).where("pdf_id >= 99").collect():
        got[r.kind].add((r.pdf_id, r.line_no))
    assert got["running"] == {(99, n) for n in running}
    assert (99, 6) in got["hyphen"] and (99, 7) in got["ocr"]
    parts = {(r.pdf_id, r.part): r.repaired for r in scans.paragraphs(d).where("pdf_id >= 99").collect()}
    text = {i: x for (i, part), x in parts.items() if part == "full_text"}
    assert "allocated to treatment under conditions" in parts[99, "methods"] and parts[99, "other"] == "a b c"
    assert "allocated to treatment under conditions" in text[99] and "Page 1" not in text[99]
    assert text[100] is None and text[101] == "" and text[102] == "one line"


def test_shapes():
    assert scans.shape("final") == scans.shape("f1nal") == scans.shape("fina|")
    assert scans.shape("modern") != scans.shape("sleep")


def test_confusions_that_others_hide_are_undone():
    right = "uncertain nutrition function conclusions studies median handled disputed".split()
    words = scans.Words({w: 100 for w in right})
    read = "iincertain niitrition fiinction concliisions stuclies meclian hanclled clisputed".split()
    assert [words.right(w, collections.Counter(), {}) for w in read] == right
    assert [words.right(w, collections.Counter(), {}) for w in right] == [None] * len(right)


def test_line_model_is_fitted_on_all_reports(spark):
    rng = random.Random(5)
    body = lambda n: [" ".join("".join(rng.choice("abcdefgmnoprst") for _ in range(6)) for _ in range(7)) for _ in range(n)]
    stamped = "\n".join([*body(6), "Nightly Journal of Sleep 2019;12:345", *body(6)])
    plain = ["\n".join(body(6)) for _ in range(400)]
    signed = ["\n".join(x + " ©" * (k % 2) for k, x in enumerate(body(8))) for _ in range(100)]  # lines of body that read like stamps
    # by the hash of the id, the plain reports come first
    ids = [r.id for r in spark.range(500).orderBy(F.xxhash64("id")).collect()]
    rows = [*zip(ids, plain + signed), (-1, stamped)]
    d = spark.createDataFrame([(i, t, None) for i, t in rows], "pdf_id long, full_text string, n_pages int").repartition(5)
    seen = [scans.observations(t, None)[1] for _, t in rows]
    of_all, of_some = scans.LineModel().fit(seen), scans.LineModel().fit(seen[:400])
    assert list(np.flatnonzero(of_some.label(seen[-1]) == scans.RUNNING)) == [6]
    assert not (of_all.label(seen[-1]) == scans.RUNNING).any()
    assert not scans.noise(d).where("pdf_id = -1 AND kind = 'running'").count()


def test_expectations_by_length_are_those_of_each_text():
    rng = np.random.default_rng(3)
    model, texts = scans.LineModel(), [rng.integers(0, 2, (n, 8), np.int8) for n in (1, 7, 2, 7, 40, 1)]
    assert (scans.unpacked(scans.packed(texts[1])) == texts[1]).all()
    want = np.zeros(39)
    for x in texts:
        seen, move = np.exp(model.seen(x)), np.exp(model.move)
        ahead, back = [np.exp(model.start) * seen[0]], [np.ones(3)]
        for b in seen[1:]:
            ahead.append(ahead[-1] @ move * b)
        for b in seen[:0:-1]:
            back.insert(0, move @ (b * back[0]))
        g = np.array(ahead) * np.array(back) / ahead[-1].sum()
        moves = sum((np.outer(ahead[t], seen[t + 1] * back[t + 1]) * move / ahead[-1].sum() for t in range(len(x) - 1)), np.zeros((3, 3)))
        want += np.concatenate([(g.T @ x).ravel(), g.sum(0), moves.ravel(), g[0]])
    assert np.allclose(model.expected([scans.packed(x) for x in texts]), want)
    assert not model.expected([]).any()
