"""URL filters, decontamination, quality rules, token counts, main text."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from brute import local_alignment, pagerank, quality_counts

from turnmill.llm import common, decontaminate, html, quality, tokens, urls
from turnmill.llm.common import Words

public_tokenizers = pytest.importorskip("public_tokenizers")
ODD = [(None, None), (1, None), (2, ""), (2, ""), (3, " \n\t "), (4, "x" * 5000), (5, "one two three"), (6, "ä ß 漢字 😀\r\n| a | b\x0c")]


def docs(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


# ------------------------------------------------------------------ word kernel
def test_words_follow_the_pattern():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab é漢\n\t\x0b  ") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    w = Words(pa.array([*texts, None, "z" * (3 << 20), "tail z" + "z" * 10]))
    want = [(i, x) for i, t in enumerate([*texts, "", "z" * (3 << 20), "tail z" + "z" * 10]) for x in re.findall(r"[^\x20\x09-\x0D]+", t)]
    assert w.doc.tolist() == [i for i, _ in want]
    assert [w.raw[a:b].tobytes().decode() for a, b in zip(w.start, w.end, strict=True)] == [x for _, x in want]
    names = {}
    for h, (_, x) in zip(w.hash.tolist(), want, strict=True):
        assert names.setdefault(h, x) == x
    assert len(set(names.values())) == len(names)


# ------------------------------------------------------------------------- urls
def test_rules_and_parts(spark):
    rows = [
        (1, "http://A.Net/x"), (2, "https://x.example.net/en/1?q#f"), (3, "http://example.net/fr/"), (4, "ftp://w.Example.COM/de/"), (5, "http://k.org/fr/a"),
        (6, None), (7, "none"), (8, "http://notexample.com/de/"), (9, "http://a.net"), (10, "http://a.net?x"), (10, "http://É.net/"),
    ]
    df = spark.createDataFrame([(i, u, None) for i, u in rows], "page_id long, url string, html string")
    got = {(r.page_id, r.host): (r.path, r.rule, r.verdict) for r in urls.url_filter(df).collect()}
    assert got[1, "a.net"] == ("/x", "net/", "block")
    assert got[2, "x.example.net"] == ("/en/1", "example.net/en/", "allow")
    assert got[3, "example.net"] == ("/fr/", "net/", "block")
    assert got[4, "w.example.com"][1:] == ("example.com/de/", "block")
    assert got[5, "k.org"][1:] == ("org/fr/", "allow")
    assert got[6, ""] == ("", None, "allow") and got[7, ""] == ("", None, "allow")
    assert got[8, "notexample.com"][1] is None
    assert got[9, "a.net"][:2] == ("", None) and got[10, "a.net"][:2] == ("", None)
    assert got[10, "É.net"][1] == "net/"
    assert urls.url_filter(df.limit(0)).count() == 0


def test_propagation_equals_brute_force(spark):
    rng = random.Random(2)
    edges = {(f"h{rng.randint(0, 30)}", f"h{rng.randint(0, 30)}"): rng.randint(1, 5) for _ in range(120)}
    edges = {k: n for k, n in edges.items() if k[0] != k[1]}
    seeds = {f"h{i}": (0.5 if i < 4 else 0.0, 1.0 if i > 27 else 0.0) for i in range(31)}
    e = spark.createDataFrame([(*k, n) for k, n in edges.items()], "src string, dst string, links long")
    s = spark.createDataFrame([(h, *x) for h, x in seeds.items()], "host string, trust double, distrust double")
    got = {r.host: (r.trust, r.distrust) for r in urls.propagate(e, s).collect()}
    trust = pagerank(edges, {h: x[0] for h, x in seeds.items()})
    distrust = pagerank({(b, a): n for (a, b), n in edges.items()}, {h: x[1] for h, x in seeds.items()})
    assert all(abs(got[h][0] - 0.15 * trust[h]) < 1e-5 and abs(got[h][1] - 0.15 * distrust[h]) < 1e-5 for h in seeds)


def test_shares_that_decide_equal_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    edges = {(f"h{rng.randint(0, 20)}", f"h{rng.randint(0, 20)}"): rng.randint(1, 5) for _ in range(70)}
    edges = {k: n for k, n in edges.items() if k[0] != k[1]}
    seeds = {f"h{i}": (0.5 * (i < 4), 0.25 * (i > 15)) for i in range(23)}  # two of them without links
    e = spark.createDataFrame([(*k, n) for k, n in edges.items()], "src string, dst string, links long")
    s = spark.createDataFrame([(h, *x) for h, x in seeds.items()], "host string, trust double, distrust double")
    want = {}
    for way, graph in enumerate((edges, {(b, a): n for (a, b), n in edges.items()})):
        own, every = {h: x[way] for h, x in seeds.items()}, dict.fromkeys(seeds, 1.0)
        x, y = pagerank(graph, own), pagerank(graph, every)
        for h in seeds:
            want[h, way] = (x[h] - own[h]) / (y[h] - 1) if y[h] > 1 + 1e-9 else 0.0
    for fan in (20_000, 2):  # a host's links in one task, or dealt
        monkeypatch.setattr(urls, "FAN", fan)
        got = {(r.host, way): v for r in urls.propagate(e, s, tolerance=1e-7).collect() for way, v in enumerate((r.trust_share, r.distrust_share))}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in want)


def linked(pages):
    """Rows (page_id, url, html) of (host, path, linked hosts)."""
    return [(i, f"http://{host}{path}", " ".join(f"<a href='http://{t}/'>x</a>" for t in to)) for i, (host, path, to) in enumerate(pages)]


def test_hosts_with_few_blocked_pages_keep_the_others(spark):
    pages = [(h, f"/de/{i}" if not i else f"/{i}", [o]) for h, o in (("one.example.com", "two.example.com"), ("two.example.com", "one.example.com")) for i in range(10)]
    got = urls.url_filter(spark.createDataFrame(linked(pages), "page_id long, url string, html string")).collect()
    assert sum(r.verdict == "block" for r in got) == 2 and all(r.distrust < 0.25 for r in got)


def test_trusted_links_do_not_hide_where_a_host_links_to(spark):
    pages = [("cat.x", "/", ["bad.net"]), ("bad.net", "/", [])] + [(f"t{k}.org", "/fr/", ["cat.x"]) for k in range(20)] + [("fair.x", "/", ["cat.x", "t1.org", "t2.org", "t3.org"]), ("alone.x", "/", [])]
    df = spark.createDataFrame(linked(pages), "page_id long, url string, html string")
    got = {r.host: r for r in urls.url_filter(df).collect()}
    assert got["cat.x"].verdict == "block" and got["cat.x"].distrust == pytest.approx(1.0)
    assert {h: got[h].verdict for h in ("fair.x", "alone.x", "t1.org", "bad.net")} == {"fair.x": "allow", "alone.x": "allow", "t1.org": "allow", "bad.net": "block"}
    import duckdb

    con = duckdb.connect()
    con.register("pages", df.toArrow())
    want = con.sql(urls.oracle("pages")).fetchall()
    assert sorted((r[0], r[4], round(r[5], 5), round(r[6], 5)) for r in want) == sorted((r.page_id, r.verdict, round(r.trust, 5), round(r.distrust, 5)) for r in got.values())


def test_walks_that_do_not_end_are_an_error(spark):
    e = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "src string, dst string, links long")
    s = spark.createDataFrame([("a", 1.0, 0.0), ("b", 0.0, 1.0)], "host string, trust double, distrust double")
    got = {r.host: r.trust for r in urls.propagate(e, s).collect()}
    assert abs(got["a"] - 0.15 / (1 - 0.85**2)) < 1e-4 and abs(got["b"] - 0.15 * 0.85 / (1 - 0.85**2)) < 1e-4
    with pytest.raises(RuntimeError):
        urls.propagate(e, s, rounds=20)


def test_many_hosts_take_the_salted_join(spark, monkeypatch):
    rows = [(i, f"http://h{i % 7}.net/x" if i % 3 else None, None) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS path", "3 AS rule", "4 AS trust")
    usual = sorted(map(str, urls.url_filter(df).collect()))
    monkeypatch.setattr(common, "LOOKUP_ROWS", 0)
    assert sorted(map(str, urls.url_filter(df).collect())) == usual and len(usual) == 60


def test_long_html_is_read_to_its_end(spark):
    rows = [(1, "http://k.x/", "<p>" + "y " * 400_000 + "<a href=http://evil.example.com/de/>"), (2, "http://evil.example.com/de/", "")]
    got = {r.host: r.verdict for r in urls.url_filter(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {"k.x": "block", "evil.example.com": "block"}


def test_links_carry_trust_and_distrust(spark):
    rows = [
        (1, "http://good.org/fr/", "<a href='http://a.x/1'>"), (2, "http://a.x/", '<A class=k HREF="//b.x/">'), (3, "http://evil.example.com/de/", ""),
        (4, "http://c.x/", "<a href=http://evil.example.com/de/1>"), (4, "http://c.x/", "<a href=http://evil.example.com/de/1>"),
    ]
    got = {r.host: (r.trust > 0, r.verdict) for r in urls.url_filter(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {"good.org": (True, "allow"), "a.x": (True, "allow"), "evil.example.com": (False, "block"), "c.x": (False, "block")}


def test_distrust_reaches_every_host_that_links_to_a_popular_target(spark):
    rows = [(0, "http://evil.example.com/de/", "")] + [(i, f"http://k{i}.x/", "<a href=http://evil.example.com/de/1>") for i in range(1, 9)]
    rows += [(20 + i, "http://hub.x/", f"<a href=http://n{i}.x/>" if i else "<a href=http://evil.example.com/>") for i in range(5)]
    got = {r.host: r.verdict for r in urls.url_filter(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {"evil.example.com": "block", "hub.x": "allow"} | {f"k{i}.x": "block" for i in range(1, 9)}


# --------------------------------------------------------------- decontamination
def test_alignment_equals_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = rng.integers(0, 6, rng.integers(1, 25)), rng.integers(0, 6, rng.integers(1, 60))
        score, lo, hi = decontaminate.align(a, b)
        assert score == local_alignment(a.tolist(), b.tolist())
        assert score == 0 or local_alignment(a.tolist(), b[lo:hi].tolist()) == score


def test_edited_copies_are_found(spark):
    rng = random.Random(4)
    items = [(i, " ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(15, 60)))) for i in range(40)] + [(90, "tiny item"), (91, ""), (92, None), (0, "")]
    rows, want = [], set()
    for i, t in items[:40]:
        w = t.split()
        for _ in range(len(w) // 8):
            k = rng.randrange(len(w))
            w[k : k + rng.randint(0, 1)] = ["new"] * rng.randint(0, 2)
        rows.append((i, "before it. " + " ".join(w).upper() + ", after"))
        want.add((i, i))
    rows += [(100, "a Tiny, item here"), (101, None), (102, ""), (103, "some clean words " * 30), (100, "a Tiny, item here"), (None, items[3][1])]
    want |= {(100, 90), (None, 3)}
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(docs(spark, rows), bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    left = decontaminate.clean(docs(spark, rows), bench)
    assert {r.doc_id for r in left.collect()} == {101, 102, 103}
    assert decontaminate.contaminated(docs(spark, rows), bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs(spark, rows).limit(0), bench).count() == 0


def test_common_seeds_alone_still_count(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "RARE_LEAST", 0)
    monkeypatch.setattr(decontaminate, "RARE_SHARE", 0.0)
    item = " ".join(f"c{i}" for i in range(20))
    rows = [(i, item) for i in range(30)] + [(99, " ".join(f"c{i}" for i in range(6)) + " and other words")]
    got = decontaminate.contaminated(docs(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {r.doc_id for r in got.collect()} == set(range(30))


def test_edited_copies_beside_many_verbatim_ones_are_found(spark):
    items = [(1, " ".join(f"a{i}" for i in range(38))), (2, " ".join(f"b{i}" for i in range(59)))]
    rows = [(k, items[k % 2][1]) for k in range(300)]
    for k, (t, step) in enumerate([(items[0][1], 6), (items[1][1], 7), (items[0][1], 5), (items[1][1], 10)]):
        rows.append((1000 + k, " ".join(f"e{i}" if i % step == step - 1 else x for i, x in enumerate(t.split()))))
    rows.append((2000, " ".join(items[0][1].split()[:8]) + " and other words"))
    got = decontaminate.contaminated(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in got.collect()} == {*range(300), 1000, 1001, 1002, 1003}


def test_whole_query_equals_brute_force(spark):
    """Every document against every item without windows; a pair needs a run of ``SEED`` common words to be a candidate."""
    rng = random.Random(14)
    voc = [f"w{k}" for k in range(60)]
    items = [(i + 0.5, " ".join(rng.choice(voc) for _ in range(rng.randint(5, 30)))) for i in range(12)]
    rows = []
    for i in range(120):
        w = [rng.choice(voc) for _ in range(rng.randint(0, 40))]
        if i % 2:
            x = rng.choice(items)[1].split()
            for _ in range(rng.randint(0, len(x) // 3)):
                x[rng.randrange(len(x))] = f"e{rng.randrange(99)}"
            w[rng.randint(0, len(w)) : 0] = x
        rows.append((i, " ".join(w)))
    rows.append((500, "z " * 300_000 + items[0][1]))
    want = set()
    n = decontaminate.SEED
    for d, t in rows[:-1]:
        b = t.split()
        for i, x in items:
            a = x.split()
            runs = {tuple(a[k : k + n]) for k in range(len(a) - n + 1)}
            if any(tuple(b[k : k + n]) in runs for k in range(len(b) - n + 1)):
                score = local_alignment(a, b) / (decontaminate.MATCH * len(a))
                if score >= 0.6:
                    want.add((d, i, round(score, 9)))
    df = docs(spark, rows).selectExpr("*", "0 AS item_id", "'k' AS score", "1 AS first_word")
    bench = spark.createDataFrame(items, "item_id double, text string").selectExpr("*", "1 AS doc_id", "2 AS seed")
    got = decontaminate.contaminated(df, bench)
    assert dict(got.dtypes)["item_id"] == dict(decontaminate.contaminated(df, bench.limit(0)).dtypes)["item_id"] == "double"
    found = {(r.doc_id, r.item_id, round(r.score, 9)) for r in got.collect()}
    assert (500, 0.5, 1.0) in found and {x for x in found if x[0] != 500} == want
    assert decontaminate.clean(df, bench).columns == df.columns


# ----------------------------------------------------------------------- quality
def test_counts_equal_brute_force(spark):
    rng = random.Random(5)
    rows = ODD + [(10 + i, "".join(rng.choice(["a ", "b ", "c\n", "ü ", "# ", "a b c d e f ", "line\n", "\r", "\n"]) for _ in range(rng.randint(0, 80)))) for i in range(200)]
    got = quality.quality(docs(spark, rows).selectExpr("*", "1 AS n_words", "2 AS kept", "3 AS pattern", "4 AS votes")).collect()
    want = sorted(repr((i, *quality_counts(t))) for i, t in rows)
    assert sorted(repr((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in got) == want
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in got)
    assert not any(r.kept and r.base_failed for r in got)
    assert quality.quality(docs(spark, []).limit(0)).count() == 0


def test_em_separates_good_from_bad(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("aeioustrnlm") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    good = [(i, "\n".join(" ".join(rng.choice(vocabulary) for _ in range(12)) + "." for _ in range(10))) for i in range(150)]
    bad = [(1000 + i, " | ".join(rng.choice(vocabulary) + "###" for _ in range(80))) for i in range(20)] + [(2000 + i, " ".join(x.upper() + "!!" for x in rng.choices(vocabulary, k=90))) for i in range(15)]
    kept = {r.doc_id for r in quality.quality(docs(spark, good + bad)).where("kept").collect()}
    assert kept == {i for i, _ in good}


# ------------------------------------------------------------------------ tokens
PIECES = ["a", "b", " ", "  ", "\n", "'re", "'s", "é", "漢", "😀", "<|endoftext|>", "1", "23", "!!", "don't", " ", "　", "\x1c", "\x85", "    ", "word", "²", "\xa0"]


def test_counts_equal_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = tokens.load(path)
    rng = random.Random(7)
    rows = ODD + [(10 + i, "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 200)))) for i in range(300)]
    for chunk, overlap in ((tokens.CHUNK, tokens.OVERLAP), (150, 70)):
        got = tokens.token_counts(docs(spark, rows), path, chunk=chunk, overlap=overlap).collect()
        want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
        assert sorted(repr((r.doc_id, r.n_bytes, r.n_tokens)) for r in got) == sorted(map(repr, want))
        assert all(r.over_limit == (r.n_tokens > 1024) for r in got)


def test_splices_of_long_texts():
    library = tokens.load(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(8)
    widened = 0
    for k in range(150):
        x = "".join(rng.choice(PIECES) if rng.random() < (0.2 if k % 2 else 0.9) else "q" for _ in range(1500))
        n, w = tokens.count_long(library, x, 200, 70)
        widened += w
        assert n == len(library.encode(x, add_special_tokens=False).ids)
    assert widened
    assert tokens.count_long(library, "q" * 3000, 200, 70)[0] == len(library.encode("q" * 3000, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(spark, name):
    path = public_tokenizers.path(name)
    t = tokens.load(path)
    texts = ["Hello  World", "", "ä漢 123", "x" * 300]
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(docs(spark, list(enumerate(texts))), path, chunk=50).collect()}
    one = (lambda x: len(t.encode(x, add_special_tokens=False).ids)) if name.endswith(".json") else (lambda x: len(t.encode(x)))
    assert got == {i: one(x) for i, x in enumerate(texts)}


# -------------------------------------------------------------------------- html
def apart(page):
    """Blocks inside articles, and the others."""
    found = html.blocks(page)
    return [t for t, sure in found if sure], [t for t, sure in found if not sure]


@pytest.mark.parametrize(
    ("page", "core", "rest"),
    [
        ("<article><h1>T &amp; U</h1><p>a<b>b</b>\n c<br>d<p>e&nbsp;f</article><footer>x</footer>", ["T & U", "ab c d", "e f"], []),
        ("<nav>n</nav><main><p class='ad'>x<p>y<div id=comments><p>c</p></div>z</main>", ["y", "z"], []),
        ("<article>t<aside>s</aside>u<form><input>f</form></article>", ["t", "u"], []),
        ("<p title=\"a>b\">x<!-- <p>y --><script>if(a<b){'</p>'}</script>w</p>", [], ["xw"]),
        ("<header>h</header><div class='cookie-notice'>c</div><p>body<table><tr><td>1<td>2</table>", [], ["body", "1 2"]),
        ("", [], []),
        ("plain &lt;text&gt;", [], ["plain <text>"]),
        ("<article>open <b>never closed", ["open never closed"], []),
        ("<div role=navigation><div>a</div></div><div>b</div>", [], ["b"]),
        ("<article><p title='the hidden truth'>a<p data-x='see id=ad'>b<p hidden>c<p class='code-comment'>d<p class=notice-of-meeting>e</article>", ["a", "b", "d", "e"], []),
        ("<article><div class='article-header'><h1>a</h1></div>Let <math><mi>x</mi></math> be <object>b</object><canvas>c</canvas></article>", ["a", "Let x be bc"], []),
        ("<div><aside>s<p>t</div><article>a</article>", ["a"], []),
        ("<body><aside>s<article>a<aside>t</aside>b</article><p>c", ["a", "b"], ["c"]),
        ("<article><ul><li class=ad>x<li>y</ul><div class='site-footer'>f</div><div class='comment-list'><article>c</article></div>z</article>", ["y", "z"], []),
        ("<article><h1 class='page-header'>The Title</h1><div class='section-header'><h2>Results</h2></div><p>x</article>", ["The Title", "Results", "x"], []),
        ("<article><figure class='banner'><figcaption>f</figcaption></figure><section id='comment'>critic</section><div class='comments'>c</div></article>", ["f", "critic"], []),
        ("<div>main story</div><article>teaser</article>", ["teaser"], ["main story"]),
        ("<p>a<template>x<template>y</template>z</template>b <svg><svg></svg><text>t</text></svg>c</p>", [], ["ab c"]),
        ("<nav>n<nav>m</nav>o</nav><div class='sidebar left'>s</div>t", [], ["t"]),
    ],
)
def test_blocks(page, core, rest):
    assert apart(page) == (core, rest)


def test_random_pages_equal_brute_force():
    """Well-formed pages built from a tree, whose text is read off the tree."""
    rng = random.Random(9)

    def furniture():
        return rng.choice(["nav", "footer", "aside", "form", "div class='ad'", "div id=cookie-banner", "section role='search'", "ul class='menu main'", "p aria-hidden=true"])

    def tree(depth, inside, out, buffer):
        html_ = []

        def flush():
            if "".join(buffer).strip():
                out.append(" ".join("".join(buffer).split()))
            buffer.clear()

        for _ in range(rng.randint(1, 4)):
            kind = rng.random()
            if kind < 0.4:
                x = rng.choice(["some ", "words &amp; more ", "x\n y ", "<b>bold</b> ", "a<!-- <nav> -->b "])
                html_.append(x)
                buffer.append(re.sub("<[^>]*>", "", x.replace("<!-- <nav> -->", "").replace("&amp;", "&")))
            elif kind < 0.6:
                name = furniture()
                tag = name.split()[0]
                flush()
                html_.append(f"<{name}>gone <i>too</i>{'<div>in</div>' if tag != 'p' else ''}</{tag}>")
            elif depth:
                name = rng.choice(["div", "section title='nav > aside'", "ul", "blockquote data-k=\"class='ad'\"", "div class='menu-card of-day'"])
                flush()
                html_.append(f"<{name}>")
                html_.append(tree(depth - 1, inside, out, buffer))
                flush()
                html_.append(f"</{name.split()[0]}>")
        return "".join(html_)

    for k in range(300):
        out, buffer = [], []
        body = tree(3, True, out, buffer)
        if "".join(buffer).strip():
            out.append(" ".join("".join(buffer).split()))
        assert apart(f"<body><header>h</header><article>{body}</article><footer>f</footer></body>") == (out, [])
        assert apart(f"<body><header>h</header>{body}<footer>f</footer></body>") == ([], out)


def test_an_article_that_two_pages_show_stays(spark):
    story = " ".join(f"s{k}" for k in range(80))
    menu = " ".join(f"m{k}" for k in range(12))
    rows = [(i, f"http://h.x/{i}", f"<div>{menu}</div><div>{story if i < 2 else ' '.join(f'u{i}x{k}' for k in range(30))}</div>") for i in range(20)]
    rows.append((99, "http://h.x/long", "<div>" + "q " * 200_000 + f"</div><div>{menu}</div>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS page", "3 AS at", "4 AS text")
    got = {r.page_id: r.text for r in html.main_text(df).collect()}
    assert got[0] == got[1] == story and not any("m3" in t for t in got.values()) and got[99].count("q") == 200_000


def test_undecided_blocks_of_a_host_equal_brute_force(spark):
    """Whole query on hosts without article elements, and on pages that have undecided text beside one."""
    rng = random.Random(11)
    pool = [f"w{k}" for k in range(12)]
    shared = [" ".join(rng.choices(pool, k=rng.randint(8, 16))) for _ in range(4)]
    rows, parts = [], {}
    for i in range(60):
        host = f"h{i % 3}.x"
        texts = [rng.choice(shared) if rng.random() < 0.5 else " ".join(rng.choices(pool, k=rng.randint(3, 14))) for _ in range(rng.randint(1, 4))]
        sure = f"own text {shared[0]}" if i % 4 == 0 else None
        parts[i] = (host, texts, sure)
        rows.append((i, f"http://{host}/{i}", "".join(f"<div>{t}</div>" for t in texts[:1]) + (f"<article>{sure}</article>" if sure else "") + "".join(f"<p>{t}</p>" for t in texts[1:])))
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for host in {h for h, _, _ in parts.values()}:
        pages = {i: [w for t in texts for w in t.split()] for i, (h, texts, _) in parts.items() if h == host}
        runs = {i: {tuple(t[k : k + html.RUN]) for k in range(len(t) - html.RUN + 1)} for i, t in pages.items()}
        need = max(2, min(html.PAGES, html.SHARE * len(pages)))
        for i, tokens_ in pages.items():
            drop = {k + j for k in range(len(tokens_) - html.RUN + 1) if sum(tuple(tokens_[k : k + html.RUN]) in r for r in runs.values()) >= need for j in range(html.RUN)}
            out, at = [], 0
            for n, t in enumerate(parts[i][1]):
                kept = [w for k, w in enumerate(t.split(), at) if k not in drop]
                at += len(t.split())
                out += [" ".join(kept)] if kept else []
                if n == 0 and parts[i][2]:
                    out.append(parts[i][2])
            assert got[i] == "\n".join(out)


def test_host_repeats_go_and_articles_stay(spark):
    menu = "<div>Start page of the site with links to all parts</div>"
    page = lambda i: f"<body>{menu}<p>{' '.join(f'u{i}x{k}' for k in range(9))}</p></body>"
    rows = [(i, f"http://h.x/{i}", page(i)) for i in range(3)] + [(8, "http://other.x/", page(8)), (9, None, None), (10, "http://h.x/a", "<article>same</article>"), (11, "http://h.x/b", "<article>same</article>"), (8, "http://other.x/", page(8))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.main_text(df).collect()}
    assert got[0] == " ".join(f"u0x{k}" for k in range(9))
    assert got[8].startswith("Start page") and got[9] == "" and got[10] == got[11] == "same"
    assert html.main_text(df).count() == len(rows) and html.main_text(df.limit(0)).count() == 0
    assert all(r.n_chars == len(r.text) for r in html.main_text(df).collect())
