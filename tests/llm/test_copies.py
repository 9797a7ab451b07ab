"""Near-duplicate join, components, suffix array, mixing."""

import math
import random
import time
from collections import Counter
from pathlib import Path

import pytest
from brute import near, repeats, shingles
from pyspark.sql import functions as F

from turnmill.llm import common, jaccard, mixing, suffixes
from turnmill.llm.components import components


def docs(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


# -------------------------------------------------------------------- components
def test_components_equal_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, i) for i in range(5001, 5060)] + [(7, 7), (9999, 9999), (None, 4)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_that_are_not_done_are_an_error(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(64)], "a long, b long")
    with pytest.raises(RuntimeError):
        components(edges, rounds=1)


# ----------------------------------------------------------------------- jaccard
@pytest.fixture(scope="module")
def crowd():
    rng = random.Random(2)
    voc = [f"v{k}" for k in range(300)]
    line, base = [rng.choice(voc) for _ in range(12)], [rng.choice(voc) for _ in range(90)]
    rows = []
    for i in range(350):
        r = rng.random()
        if r < 0.35:
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(90)] = f"e{rng.randrange(10**6)}"
        elif r < 0.7:
            w = line + [rng.choice(voc) for _ in range(rng.randint(3, 150))]
        elif r < 0.8 and rows:
            w = rng.choice(rows)[1].split()
        else:
            w = [rng.choice(voc) for _ in range(rng.randint(0, 40))]
        rows.append((i, " ".join(w)))
    return rows + [(900, None), (901, ""), (902, " "), (903, "a b"), (904, "a b"), (5, rows[5][1]), (5, "other text for a known key here")]


@pytest.mark.parametrize(("block", "small"), [(1024, 64), (16, 8)])
def test_links_and_classes_equal_brute_force(spark, crowd, monkeypatch, block, small):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "SMALL", small)
    got = sorted(map(tuple, jaccard.near_duplicates(docs(spark, crowd)).collect()))
    assert got == near(crowd)


def test_pairs_of_frequent_passages_are_linked(spark, monkeypatch):
    """All shared shingles of a pair lie in buckets that are too large for the comparison by brute force."""
    monkeypatch.setattr(jaccard, "SMALL", 4)
    rng = random.Random(4)
    pool = [" ".join(f"p{k}x{j}" for j in range(30)) for k in range(24)]
    rows = []
    for i in range(400):
        w = " ".join(rng.sample(pool, 6)).split()
        at = rng.randrange(170)
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w[:at], *(f"e{i}x{j}" for j in range(10)), *w[at + 10 :]]))]
    sets = [shingles(t) for _, t in rows]
    pairs = [(a, a + 1) for a in range(0, len(rows), 2)]
    assert all(0.8 <= len(sets[a] & sets[b]) / len(sets[a] | sets[b]) < 0.9 for a, b in pairs)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(docs(spark, rows)).collect()}
    lost = [p for p in pairs if got[p[0]][0] != got[p[1]][0] or not got[p[0]][1]]
    assert not lost


def test_no_shuffle_file_outlives_its_step(spark, crowd):
    """Each step ends in a checkpoint; on many partitions the files of all steps together filled the disk."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    folders = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    kept = lambda: {p for d in folders for p in Path(d).glob("*/shuffle_*")}
    before, setting = kept(), spark.conf.get(key)
    lazy = jaccard.near_duplicates(docs(spark, crowd))
    for _ in range(50):  # files are removed in the background
        left = kept() - before
        if not left:
            break
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(key) == setting
    assert sorted(map(tuple, lazy.collect())) == near(crowd)
    assert sorted(map(tuple, lazy.collect())) == near(crowd)


def test_one_of_each_keeps_other_columns(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "a"), (2, text + " end", "b"), (3, "quite another text of its own", "c"), (3, "quite another text of its own", "c"), (4, None, "d"), (5, None, "e")]
    df = docs(spark, rows, "doc_id long, text string, `set` string").withColumn("size", F.lit(1))
    got = jaccard.one_of_each(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == [1, 3, 4, 5]
    assert jaccard.one_of_each(df.limit(0)).count() == 0


# ---------------------------------------------------------------------- suffixes
@pytest.mark.parametrize("hot", [suffixes.HOT, 2])
@pytest.mark.parametrize("least", [50, 12])
def test_repeats_equal_brute_force(spark, hot, least):
    rng = random.Random(3)
    voc = [f"w{k}" for k in range(40)]
    passages = [[rng.choice(voc) for _ in range(rng.randint(8, 90))] for _ in range(12)]
    rows = []
    for i in range(150):
        w = []
        for _ in range(rng.randint(0, 6)):
            w += rng.choice(passages)[rng.randint(0, 8) :] if rng.random() < 0.5 else [rng.choice(voc) for _ in range(rng.randint(1, 60))]
            if rng.random() < 0.1:
                w += ["is", "onhe."] * rng.randint(10, 60)
        rows.append((i, " ".join(w)))
    rows += [(1000, rows[5][1]), (1001, None), (1002, ""), (7, rows[7][1]), (None, rows[9][1])]
    got = {tuple(r)[:3] for r in suffixes.repeats(docs(spark, rows), least, hot=hot).collect()}
    want = repeats(rows, least)
    # an unnamed copy of a named text is no second key
    plain = repeats([r for r in rows if r[0] is not None], least)
    assert {x for x in got if x[0] not in (None, 9)} == {x for x in want if x[0] not in (None, 9)}
    assert {x for x in got if x[0] == 9} == {x for x in plain if x[0] == 9}


def test_a_hot_key_beside_many_others(spark):
    """The join that sets hot keys apart leaves every other key's rows in one task, however adaptive execution reads them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = random.Random(8)
        pool = [" ".join(f"p{k}x{j}" for j in range(70)) for k in range(60)]
        common = " ".join(f"c{j}" for j in range(80))
        rows = [(i, f"a{i} {rng.choice(pool)} b{i} {common if i % 3 else rng.choice(pool)} d{i}") for i in range(300)]
        want = repeats(rows, 50)
        for later in (False, True):
            got = {tuple(r)[:3] for r in suffixes.repeats(docs(spark, rows).repartition(8), 50, hot=40, later=later).collect()}
            if not later:
                assert got == want
        assert {x[0] for x in got} <= {x[0] for x in want} and sum(x[2] - x[1] for x in got) == sum(x[2] - x[1] for x in want) - 70 * len({p for p in pool if sum(p in t for _, t in rows) > 1}) - 80
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_dealt_keys_stay_together_over_an_adaptive_join(spark):
    from turnmill.llm.common import apply, checkpoint, dealt

    import pyarrow as pa

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(0, 20_000, numPartitions=8).select((F.col("id") % 500).alias("key"))
        few = checkpoint(spark.range(3).select(F.col("id").alias("key")))

        def keys(batches):
            seen = {k for b in batches for k in b.column(0).to_pylist()}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.int64())], ["key"])

        assert apply(dealt(rows.join(few, "key", "left_anti"), "key"), keys, "key long").count() == 497
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_cutting_repeats_leaves_each_passage_once(spark):
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [(i, f"begin own{i} {shared} own{i} end") for i in range(5)] + [(9, None), (10, "short")]
    left = suffixes.without_repeats(docs(spark, rows, "doc_id long, text string")).collect()
    assert sum(shared in (r.text or "") for r in left) == 1
    assert all(f"begin own{r.doc_id}" in r.text and f"own{r.doc_id} end" in r.text for r in left if r.doc_id < 5)
    assert suffixes.repeats(docs(spark, []).limit(0)).count() == 0


# ------------------------------------------------------------------------ mixing
def quantile(u, mean):
    k, p = 0, math.exp(-mean)
    cdf = p
    while cdf <= u and k < 400:
        k += 1
        p *= mean / k
        cdf += p
    return k


def test_poisson_inverts_the_distribution(spark):
    cases = [(i / 97, m) for i in range(97) for m in (0.01, 0.7, 3.0, 8.0)]
    got = spark.createDataFrame(cases, "u double, m double").select("u", "m", mixing.poisson(F.col("u"), F.col("m")).alias("k")).collect()
    assert all(r.k == quantile(r.u, r.m) for r in got)


def test_shares_follow_the_weights(spark):
    rows = [(i, "x" * 100, "big") for i in range(4000)] + [(10_000 + i, "y" * 50, "small") for i in range(400)] + [(20_000, "z" * 9, None), (20_001, None, "big"), (20_002, "", "void")]
    df = docs(spark, rows, "doc_id long, text string, source string").withColumn("rate", F.lit(1))
    out = mixing.mixed(df, {"big": 1.0, "small": 3.0}).cache()
    size = Counter()
    for r in out.collect():
        size[r.source] += len(r.text or "")
    total = 420_009
    assert abs(size["small"] / total - 0.75) < 0.05 and abs(size["big"] / total - 0.25) < 0.03
    assert size[None] == 0 and "void" not in size
    keys = [r.shuffle_key for r in out.collect()]
    assert keys == sorted(keys)
    again = mixing.mixed(df.repartition(7), {"big": 1.0, "small": 3.0})
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))
    assert mixing.mixed(df.limit(0)).count() == 0


def test_many_sources_take_the_salted_join(spark, monkeypatch):
    rows = [(i, "x" * (1 + i % 7), f"s{i % 5}") for i in range(300)] + [(1, "xx", "s1")]
    df = docs(spark, rows, "doc_id long, text string, source string")
    usual = sorted(map(str, mixing.mixed(df).collect()))
    monkeypatch.setattr(common, "LOOKUP_ROWS", 0)
    assert sorted(map(str, mixing.mixed(df).collect())) == usual
