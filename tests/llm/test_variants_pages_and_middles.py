import collections
import hashlib
import html
import random
import re
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.helpers import SCHEMA, awkward, awkward_documents, empty, prose
from tessera.llm import automata, dom, fim, queries, spelling, wrappers

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Spelling variants


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows, slip=199, least_chars=6, least_n=5, times=5):
    count = collections.Counter()
    for d, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = crc32(f"{'' if d is None else d}:{w}".encode())
            if h % slip == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least_chars:
                count[w] += 1
    n = {w: k for w, k in count.items() if k >= least_n}
    near = {w: [x for x in n if x != w and one_edit(w, x)] for w in n}
    form = {w: min((x for x in near[w] if n[x] >= times * n[w]), key=lambda x: (-n[x], x), default=None) for w in n}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n)


def variants(found):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found.collect())


def misspelled(seed=4):
    """Words and their misspellings, chains of forms, ties, runs of one letter, and a very long word."""
    rng = random.Random(seed)
    words = ["orchard", "Lanterns", "überflug", "meadows", "meadowz", "aaaaaaa", "aaaaaaaa", "x" * 3000, "élégant"]
    out = [[i, " ".join(rng.choice(words) for _ in range(60))] for i in range(40)]
    for i in range(40, 80):
        w = list(rng.choice(words[:6]))
        k = rng.randrange(len(w))
        w[k : k + rng.randrange(2)] = rng.choice(["", "e", "q"])
        out.append([i, " ".join(["".join(w)] * rng.randrange(4, 9)) + ", " + "x" * 2999])
    out += [[90, " ".join(["fathoms"] * 250 + ["fathomz"] * 50 + ["fathozz"] * 10)], [91, "fathezz fathezz fathozz"], [None, "orchard " * 7]]
    return out + [r[:2] for r in awkward_documents()]


@pytest.mark.parametrize("most_words,slip", [(60_000, 199), (7, 3)])
def test_variants_equal_brute_force(spark, most_words, slip):
    rows = misspelled()
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, word string, n long")
    got = variants(spelling.spelling_variants(docs, slip=slip, most_words=most_words))
    assert got == brute_variants(rows, slip=slip)
    assert slip == 3 or any(f is not None and f != r for _, f, r, *_ in got)  # a chain


def test_hot_half_is_dealt_to_several_automata(spark):
    rng = random.Random(2)
    words = sorted({"commonstart" + "".join(rng.choice("abc") for _ in range(5)) for _ in range(150)} | {"b" + "".join(rng.choice("abc") for _ in range(5)) + "commonendings" for _ in range(80)})
    rows = [(w, rng.choice([5, 6, 25, 26, 200])) for w in words]
    counts = spark.createDataFrame(rows, "word string, n long")
    n = dict(rows)
    want = {w: sorted(x for x in n if x != w and one_edit(w, x)) for w in n}
    for most in (1000, 20):
        for r in spelling.near_words(counts, most_words=most).collect():
            forms = [x for x in want[r["word"]] if n[x] >= 5 * n[r["word"]]]
            assert r["n_near"] == len(want[r["word"]]) and r["form"] == min(forms, key=lambda x: (-n[x], x), default=None)


def test_variants_of_nothing(spark):
    assert spelling.spelling_variants(empty(spark)).count() == 0
    assert spelling.spelling_variants(spark.createDataFrame([(1, None), (2, ""), (3, "once only")], "doc_id long, text string")).count() == 0


@given(st.sets(st.text("abé", max_size=7), max_size=40), st.lists(st.text("abé", max_size=7), max_size=10))
@settings(max_examples=80, deadline=None)
def test_automaton_is_minimal_and_finds_all(words, others):
    words = sorted(words)
    a = automata.Automaton(words)
    assert a.number(words).tolist() == list(range(len(words)))
    languages = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in {w[:k] for w in words for k in range(len(w) + 1)} | {""}}
    assert a.states == len(languages)
    asked = words + others
    exact = np.asarray([len(w) // 2 for w in asked], np.int64)
    q, k = a.within_one(automata.Words(asked), exact)
    got = list(zip(q.tolist(), k.tolist(), strict=True))
    assert len(got) == len(set(got))
    assert set(got) == {(i, j) for i, w in enumerate(asked) for j, x in enumerate(words) if one_edit(w, x) and x[: len(w) // 2] == w[: len(w) // 2]}


# Pages


TITLES = ["Vom Wetter", "Das Tal", "Die Brücke", "On rivers", "Of mills", "Stone walls", "Le moulin", "La vallée", "Une pierre", "Nubes"]


def site(rng, k, blocks):
    """A page of one of three sites that all wrap the same blocks differently."""
    marked = [f"<p>{html.escape(b)}" for b in blocks[1:]]
    lead = html.escape(blocks[0])
    menu = "".join(f'<li><a href="/{w}">{w}</a>' for w in prose(rng, 4).split())
    ad, side = prose(rng, 9), prose(rng, 12)
    notes = "".join(f'<div class="c"><b>{w}</b> says<p>{prose(rng, 20)}</p></div>' for w in ("ann", "bo"))
    if k == 0:
        return f'<html><head><title>{lead}</title><style>p{{}}</style></head><body><nav><ul>{menu}</ul></nav><!-- x --><div class="ad">{ad}</div><article><h1>{lead}</h1>{"</p>".join(marked)}</article><section id="comments">{notes}</section><footer>&copy; me</footer>'
    if k == 1:
        return f'<title>{lead}</title><div id=top><ul>{menu}</ul></div><div class=page><div class="col-1"><h1>{lead}</h1>{"".join(marked)}<div class="share">Share it</div></div><div class="sidebar">{side}<ul>{menu}</ul></div></div><div class="cookie-notice">We use them</div><form><label>Mail</label><input></form><script>var a="<p>no</p>";</script>'
    return f'<TITLE>{lead}</TITLE><table><tr><td><ul>{menu}</ul></td><td><h2>{lead}</h2>{"".join(marked)}<p>Written by the editors of this site, who thank you.</td></tr></table><noscript>on</noscript><aside><p>{side}</aside><p hidden>unseen</p>'


def sites():
    rng = random.Random(6)
    pages, want = [], {}
    for k in range(3):
        for i, title in enumerate(TITLES):
            blocks = [f"{title} {k}", *[prose(rng, rng.randrange(20, 60)).capitalize() + " <&> é." for _ in range(rng.randrange(2, 6))]]
            page = 100 * k + i
            pages.append((page, f"https://u@host{k}.example.org:80/a/{i}", site(rng, k, blocks), "clash", 3))
            want[page] = "\n\n".join(blocks)
        copy = pages[-1]
        pages += [(copy[0] + 40 + j, *copy[1:]) for j in range(30)]  # copies don't make their text a template
        want |= {copy[0] + 40 + j: want[copy[0]] for j in range(30)}
    pages += [(900, None, None, None, None), (901, "no url", "", None, None), (902, "https://host0.example.org", "<nav>only</nav>", None, None), (None, "https://lone.example.org/x", "<p>One\t page\n&nbsp;alone<br>of its host</p>", None, None)]
    want |= {900: "", 901: "", 902: "", None: "One page alone of its host"}
    return pages, want


PAGES = "page_id long, url string, html string, text string, slots int"


@pytest.mark.parametrize("at_once", [64, 1])
def test_articles_come_back_from_their_sites(spark, at_once):
    pages, want = sites()
    got = wrappers.extract_pages(spark.createDataFrame(pages, PAGES), shapes_at_once=at_once)
    assert got.columns == ["page_id", "url", "slots", "text", "n_chars"]
    rows = {r["page_id"]: r for r in got.collect()}
    assert len(rows) == len(pages)
    assert {k: r["text"] for k, r in rows.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in rows.values())


def test_given_pages_equal_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r["text"] for r in wrappers.extract_pages(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"</?(?:b|i)>|<br>", lambda m: " " if m[0] == "<br>" else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner))
        assert got[r["page_id"]] == "\n\n".join(b for b in blocks if b)


def test_joined_wrappers_are_as_broadcast_ones(spark, monkeypatch):
    pages, want = sites()
    monkeypatch.setattr(wrappers, "MOST_BROADCAST", -1)
    assert {r["page_id"]: r["text"] for r in wrappers.extract_pages(spark.createDataFrame(pages, PAGES)).collect()} == want


def test_pages_of_awkward_makes(spark):
    deep = "<div>" * 4000 + "core" + "</div>" * 4000
    rows = [(1, "u", deep), (2, "u", "a <b"), (3, "u", "<p title='x>y'>q</p><!-- never closed"), (4, "u", "<script>x"), (5, "u", "word" * 100_000), (6, "u", "1 < 2 &am &#x41; &bogus;"), (7, "u", "<ul><li>a<li>b</ul>" * 2000)]
    got = {r["page_id"]: r["text"] for r in wrappers.extract_pages(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got[1] == "core" and got[2] == "a" and got[3] == "q" and got[4] == "" and got[5] == rows[4][2] and got[6] == "1 < 2 &am A &bogus;" and got[7].startswith("a\n\nb\n\na")
    assert wrappers.extract_pages(spark.createDataFrame([], PAGES)).count() == 0


@given(st.text("<>/pdivul&;= \"'!-abcript\n", max_size=120))
@settings(max_examples=200, deadline=None)
def test_any_markup_gives_a_tree(page):
    shape, blocks = wrappers.folded(page)
    assert [b[0] for b in blocks] == sorted(b[0] for b in blocks) and all(b[2] == dom.spaced(b[2]) or "&" in b[2] for b in blocks)
    assert wrappers.wrapper_of([(1, shape, {})])[0][0] == 1


# Fill in the middle


def brute_middle(d, text, seed=7, fim=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    sha = hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()
    h = [int(sha[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(s in text for s in fim_marks) or h[2] % 100 >= fim:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


fim_marks = ("<P>", "<S>", "<M>")
LINED = [[1, "a\nb\n\nc"], [2, "\n\n\n"], [3, "tail\n"], [4, "has <S> in it\nx"], [5, "😀 line\n日本\r\nx y\n"], [6, "<\nP>\n<S\n>"], [7, "line of many words\n" * 5000], [8, "x" * 200_000], [5, "another of five\n2"]]


@pytest.mark.parametrize("fim_percent,spm_percent", [(100, 50), (60, 20)])
def test_middles_equal_brute_force_and_come_back(spark, fim_percent, spm_percent):
    rows = LINED + [[i, "".join(prose(random.Random(i), 4) + "\n" for _ in range(i % 9))] for i in range(10, 90)] + [r[:2] for r in awkward_documents()]
    docs = spark.createDataFrame([(*r, "clash", i, "_u") for i, r in enumerate(rows)], "doc_id long, text string, FORM string, place long, _units string")
    out = fim.fill_in_middle(docs, fim_percent=fim_percent, spm_percent=spm_percent)
    assert out.columns == ["doc_id", "text", "place", "_units", *fim.RESULTS]
    got = out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).orderBy("place").collect()
    assert len(got) == len(rows)
    for r, (d, text) in zip(got, rows, strict=True):
        assert (r["n_units"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute_middle(d, text, fim=fim_percent, spm=spm_percent)
        assert r["back"] == (text or "")
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_middles_of_an_empty_table_and_other_sentinels(spark):
    assert fim.fill_in_middle(empty(spark)).count() == 0
    marks = ("[pre]", "{suf}", "(mid)")
    x = fim.fill_in_middle(awkward(spark), sentinels=marks)
    assert x.filter(~fim.restored(F.col("output"), F.col("form"), marks).eqNullSafe(F.coalesce("text", F.lit("")))).count() == 0
    with pytest.raises(ValueError):
        fim.fill_in_middle(awkward(spark), sentinels=("<P>", "<S>", "x<"))


def test_middles_are_native(spark):
    plan = queries.op13_fill_in_middle(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
    assert SCHEMA.startswith("doc_id long")
