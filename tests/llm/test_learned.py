"""Personal data, toxicity, the pipeline and the registry."""

import ast
import hashlib
import random
from pathlib import Path

import duckdb
import pyarrow as pa
import numpy as np
import pytest
from brute import pii as brute_pii

import corpus_pipeline
from turnmill.llm import pii, queries, toxicity

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]
PARTS = ["a", "b", ".", "@", "-", "+", " ", "12", "3", "4", "(", ")", "@x.y", "1.2.3.4", "300.1.1.1", "+123 456 7890", " at x dot com", "4111 1111 1111 1111", "漢", "\n", "5.6.7.8.9"]


def docs(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


# --------------------------------------------------------------------------- pii
def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    for _ in range(6000):
        t = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(t) == brute_pii(t), t


def test_long_runs_stay_linear():
    for t in ("a" * 300_000 + "@", "1" * 300_000, "+1" + " " * 300_000, "a@" * 50_000, "1." * 100_000, "1-" * 100_000, "(111) " * 50_000, "1234 " * 60_000, "aB3" * 100_000, "a1-" * 100_000, "1234567890 " * 30_000):
        spans = pii.base_spans(t)
        pii.loose_spans(t, spans)


def test_query_columns(spark):
    rows = [(1, "x me@site.com or 4111 1111 1111 1111 and 10.0.0.1, +1 202 555 0123 x"), (2, None), (3, ""), (3, ""), (4, "call (202) 555-0199 by phone")]
    rows += [(100 + i, f"phone: (202) 555-01{i:02d} and mail a{i}@b.com") for i in range(20)]
    got = {r.doc_id: r for r in pii.pii(docs(spark, rows)).collect()}
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (1, 1, 1, 1)
    base = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in brute_pii(rows[0][1]))
    assert got[1].base_sha256 == hashlib.sha256(base.encode()).hexdigest() and set(base.split(",")) <= set(got[1].spans.split(","))
    assert got[2].spans == "" and got[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[4].n_phone == 0 and got[4].spans == "phone:5:19"
    assert pii.pii(docs(spark, []).limit(0)).count() == 0


def test_model_adds_secrets_and_spellings_and_leaves_clean_text(spark):
    rng = random.Random(5)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = [(i, f"some words token = \"{hexa(40)}\" and more") for i in range(30)]
    rows += [(100 + i, f"api_key: {hexa(24)}Z9 then mail bob{i}[At]example[Dot]com please") for i in range(10)]
    rows += [(200 + i, f"checksum sha256 {hexa(64)} of the file") for i in range(30)] + [(300 + i, "std::vector at 12:30:45, version 1.2.3, token of love") for i in range(10)]
    rows += [(400, "host fe80::1ff:fe23:4567:890a is up"), (401, "password = changeme_example_value"), (402, "0" * 500 + "1.2.3.4 is an address"), (403, "1000.2.3.4 none")]
    df = docs(spark, rows).selectExpr("*", "1 AS spans", "2 AS base", "3 AS n_spans")
    got = {r.doc_id: r for r in pii.pii(df).collect()}
    assert all(got[i].n_secret == 1 and got[i].spans.startswith("secret:") for i in range(30))
    assert all(got[100 + i].n_secret == 1 and "email:" in got[100 + i].spans and got[100 + i].n_email == 0 for i in range(10))
    assert not any(got[i].n_spans for i in [*range(200, 230), *range(300, 310), 401, 403])
    assert got[402].n_ip == 1


def test_model_turns_doubtful_candidates_down(spark):
    rng = random.Random(6)
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    word = lambda: pick("abcdefghij", 9) + pick("ABCDEFGHIJ", 9) + pick("0123456789", 6)
    wrong = [x for x in ("4" + pick("0123456789", 15) for _ in range(100)) if not pii.luhn(x)][:40]
    right = [x for x in ("4" + pick("0123456789", 15) for _ in range(1500)) if pii.luhn(x)][:80]
    rows = [(i, f"part number {x} in stock") for i, x in enumerate(wrong)]
    rows += [(100 + i, f"paid {x} today, mail a{i}@b.com, host 10.0.0.{i}, call +1 202 555 01{i:02d}") for i, x in enumerate(right)]
    rows += [(300 + i, f"commit {pick('0123456789abcde', 20)}f1 on main") for i in range(40)] + [(400 + i, f"we counted {pick('123456789', 10)} of them") for i in range(40)]
    rows += [(500 + i, f"password = {word()} and more") for i in range(40)] + [(600 + i, f"log in with the token {word()} please") for i in range(20)]
    rows += [(700, None), (701, ""), (702, "word " * 200_000 + wrong[0])]
    got = {r.doc_id: r for r in pii.pii(docs(spark, rows)).collect()}
    for lo, hi in ((0, 40), (300, 340), (400, 440), (702, 703)):
        assert all(got[i].n_rejected == 1 and got[i].spans == "" for i in range(lo, hi) if i in got), lo
    assert all(got[i].n_spans == 4 and got[i].n_rejected == 0 for i in range(100, 180))
    assert all(got[i].n_secret == 1 and got[i].n_rejected == 0 for i in [*range(500, 540), *range(600, 620)])
    assert got[700].n_rejected == got[701].n_rejected == 0


def test_a_fit_that_does_not_settle_warns():
    with pytest.warns(UserWarning, match="rounds"):
        pii.fit([("email=+++00", 9), ("card~0-+00", 4), ("phone~0+000", 3)], rounds=1)


def test_features_are_counted_once_a_row_and_the_descent_settles(spark):
    words = spark.createDataFrame([(1, ["idiots", "idiot"]), (1, ["fool"]), (0, ["idiom", "fool"]), (0, []), (0, None)], "label int, words array<string>").na.fill({"label": 0})
    words = words.selectExpr("label", "coalesce(words, array()) AS words")
    got = {r.feature: (r.toxic, r.clean) for r in toxicity.feature_counts(words).collect()}
    want: dict = {}
    for label, row in ((1, ["idiots", "idiot"]), (1, ["fool"]), (0, ["idiom", "fool"])):
        for f in {f for w in row for f in toxicity.features_of(w)}:
            a, b = want.get(f, (0, 0))
            want[f] = (a + label, b + 1 - label)
    assert got == want and got["^idi"] == (1, 1)
    rng = np.random.default_rng(3)
    x = (rng.random((400, 6)) < 0.2) * rng.random((400, 6))
    y = (x @ np.array([4.0, 3, -2, 0, 1, 0]) > 0.5).astype(float)
    row, col = np.nonzero(x)
    w, b = toxicity.logistic(row, col, x[row, col], y, 6, l2=0.01, rounds=3000)
    r = (1 / (1 + np.exp(-x @ w - b)) - y) / len(y)
    assert abs(r.sum()) < 1e-4 and np.abs(x.T @ r + 0.01 * w).max() < 1e-4


def test_redaction(spark):
    df = docs(spark, [(1, "to me@site.com now", "k"), (2, None, "k")], "doc_id long, text string, base string")
    got = {r.doc_id: (r.text, r.base) for r in pii.redact(df).collect()}
    assert got == {1: ("to [EMAIL] now", "k"), 2: (None, "k")}
    assert pii.mask("abcdef", [(0, 0, 3), (2, 1, 5)]) == "[EMAIL]f"


# ---------------------------------------------------------------------- toxicity
def corpus(n=400, seed=2):
    rng = random.Random(seed)
    voc = ["".join(rng.choice("aeioustrnlmdg") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rude = ["idiot", "moron", "stupid", "loser"]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(voc) for _ in range(40)]
        bad = i % 4 == 0
        for _ in range(4 if bad else 0):
            w[rng.randrange(40)] = rng.choice(rude)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_restores_and_scores(spark):
    rows, labels = corpus()
    more = [(5001, "some words 1d10t and m0r0n and stuuupid"), (5002, "they are l o s e r and i d i o t people"), (5003, "some words and more"), (5004, None), (5005, ""), (5003, "some words and more")]
    tox = spark.createDataFrame([*labels, (1, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    df = docs(spark, rows + more)
    got = {r.doc_id: r for r in toxicity.toxicity(df, tox).collect()}
    wrong = [i for i, _, t in labels if got[i].held_out and got[i].predicted != t]
    assert len(wrong) <= 1
    assert got[5001].predicted == 1 and got[5002].predicted == 1 and got[5003].predicted == 0
    assert got[5004].score == got[5005].score and 0 <= got[5004].score < 0.5
    assert all(r.held_out == toxicity.held_out(i) for i, r in got.items())
    model = toxicity.train(df, tox)
    assert [toxicity.restore(x, model.lm) for x in ("m0r0n", "stuuupid", "i.d.i.o.t", "THE!!", "plain")] == ["moron", "stupid", "idiot", "the", "plain"]
    assert toxicity.toxicity(df.limit(0), tox).count() == 0
    assert toxicity.toxicity(df.limit(3), tox.limit(0)).count() == 3


def test_long_texts_ties_and_clashing_columns(spark):
    rows, labels = corpus(120)
    df = docs(spark, [*rows, (7000, "word " * 200_000 + "1d10t moron idiot stupid loser"), (7001, "word " * 10)]).selectExpr("*", "0.5 AS score", "1 AS predicted", "2 AS label", "3 AS words")
    tox = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS text")
    got = {r.doc_id: r for r in toxicity.toxicity(df, tox).collect()}
    assert got[7000].score > got[7001].score and got[7000].predicted == 1
    none = toxicity.toxicity(df, spark.createDataFrame([(1, 1, 0), (3, 1, 1)] if not toxicity.held_out(1) and not toxicity.held_out(3) else [(2, 1, 0), (4, 1, 1)], "doc_id long, quality int, toxic int"), threshold=0.5)
    assert all(r.predicted == int(r.score >= 0.5) for r in none.collect())


def test_labels_of_the_held_out_fifth_are_not_used(spark):
    rows, labels = corpus(200)
    flipped = [(i, q, 1 - t if toxicity.held_out(i) else t) for i, q, t in labels]
    score = lambda x: {r.doc_id: r.score for r in toxicity.toxicity(docs(spark, rows), spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()}
    assert score(labels) == score(flipped)


def test_spelled_words_stay_in_their_row():
    from turnmill.llm.common import Words

    w = Words(pa.array(["i d i", "o t x", "l o s e r", "a a a a a"]))
    assert toxicity.spelled(w) == [(2, "loser")]


# ------------------------------------------------------------ pipeline, registry
def test_pipeline_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard", "decontaminate", "pii", "mixing"]
    rows, labels = corpus(120)
    item = " ".join(f"item{i}" for i in range(30))
    long = " ".join(f"clean{i}" for i in range(60))
    rows += [(900, long), (901, long + " tail"), (902, f"intro {item} outro"), (903, "write to me@site.com please " + " ".join(f"p{i}" for i in range(20))), (904, None)]
    df = docs(spark, [(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    keys = lambda x: {r.doc_id for r in x.collect()}
    stages = dict(corpus_pipeline.STAGES)
    table = {"labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "benchmark": spark.createDataFrame([(1, item)], "item_id long, text string")}
    original = corpus_pipeline.table
    corpus_pipeline.table = lambda s, d, name: table[name]
    try:
        a = stages["toxicity"](spark, df, "")
        assert a.columns == df.columns and keys(a) == {i for i, _ in rows} - {i for i, _, t in labels if t}
        b = stages["jaccard"](spark, a, "")
        assert b.columns == df.columns and keys(a) - keys(b) == {901}
        c = stages["decontaminate"](spark, b, "")
        assert c.columns == df.columns and keys(b) - keys(c) == {902}
        d = stages["pii"](spark, c, "")
        assert d.columns == df.columns and keys(d) == keys(c)
        r = d.where("doc_id = 903").first()
        assert "[EMAIL]" in r.text and r.n_chars == len(r.text)
        assert set(df.columns) < set(stages["mixing"](spark, d, "").columns)
    finally:
        corpus_pipeline.table = original


def test_run_over_a_small_table(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "text", "copy_no"} <= set(out.columns)


def test_queries_and_sql(spark):
    names = queries.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert set(queries.oracle_sql()) <= set(names)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = names["op7_mixing"](spark, SF)
    got = con.execute(queries.oracle_sql()["op7_mixing"])
    cols = [d[0] for d in got.description]
    clean = lambda row: repr([round(x, 9) if isinstance(x, float) else x for x in row])
    assert sorted(clean(r) for r in df.select(*cols).collect()) == sorted(clean(r) for r in got.fetchall())


@pytest.mark.parametrize("name", ["op1_urls", "op2_decontaminate", "op3_quality", "op5_html", "op6_jaccard", "op8_repeats", "op9_pii", "op10_toxicity"])
def test_queries_run(spark, name):
    assert queries.queries()[name](spark, SF).count() > 0


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "turnmill").rglob("*.py"):
        if "llm" not in path.parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n.split(".") for n in names), path
