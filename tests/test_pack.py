import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnmill.functions import stats
from turnmill.operators import consume, metrics, pack, select

#: The golden cases: lengths, roles (u, a), cap, pieces, messages in none.
GOLDEN = [
    ([3, 3, 3, 3], "uaua", 20, [[0, 1, 2, 3]], []),
    ([2, 4, 2, 4, 2, 4], "uauaua", 8, [[0, 1], [0, 2, 3], [0, 4, 5]], []),
    ([2, 3, 3, 2, 2, 3], "uauaua", 8, [[0, 1], [0, 2, 3], [0, 4, 5]], []),
    ([2, 3, 2, 9, 2, 3], "uauaua", 9, [[0, 1], [0, 4, 5]], [2, 3]),
    ([5, 6, 1, 2, 1, 2], "uauaua", 9, [[0, 2, 3], [0, 4, 5]], [1]),
    ([2, 4, 2, 4, 5], "uauau", 8, [[0, 1], [0, 2, 3]], [4]),
    ([10, 1, 1, 1], "uaua", 9, [], [0, 1, 2, 3]),
]


def frame(spark, cases):
    rows = [(i, list(range(len(n))), ["user" if x == "u" else "assistant" for x in r], n, [k if x == "a" else 0 for k, x in zip(n, r, strict=True)]) for i, (n, r) in enumerate(cases)]
    return spark.createDataFrame(rows, "rec_id int, idx array<int>, roles array<string>, n_tok array<bigint>, n_scored array<bigint>")


def model(n, roles, cap):
    """What a split should give, written for one conversation."""
    if sum(n) <= cap:
        return [list(range(len(n)))] if "a" in roles else []
    if n[0] > cap:
        return []
    out, begin, opening = [], 0, True
    while begin < len(n):
        lead = [] if opening else [0]
        room = cap - sum(n[j] for j in lead)
        end = begin
        while end < len(n) and sum(n[begin : end + 1]) <= room:
            end += 1
        opening = False
        if end == begin:
            begin += 2 if roles[begin] == "u" else 1
            continue
        if end < len(n) and end - begin > 1 and roles[end - 1] == "u":
            end -= 1
        piece = lead + list(range(begin, end))
        if any(roles[j] == "a" for j in piece):
            out.append(piece)
        begin = end + (1 if end < len(n) and roles[end] != "u" else 0)
    return out


@pytest.mark.parametrize("case", range(len(GOLDEN)))
def test_golden_splits(spark, case):
    n, roles, cap, want, lost = GOLDEN[case]
    p = pack.packed(frame(spark, [(n, roles)]), cap).first()
    assert p.plan == want and model(n, roles, cap) == want
    if not want:
        assert p.reason == "unsplittable"
    elif p.outcome == "split":
        d = pack.dropped(pack.packed(frame(spark, [(n, roles)]), cap)).first()
        assert (d.dropped_messages, d.dropped_tokens) == (len(lost), sum(n[j] for j in lost))


def test_random_splits(spark):
    rng = random.Random(4)
    cases = []
    for _ in range(300):
        k = rng.randint(1, 14)
        roles = "".join("ua"[i % 2] if rng.random() < 0.8 else rng.choice("ua") for i in range(k))
        cases.append(([rng.randint(1, 9) for _ in range(k)], roles))
    for cap in (6, 12, 25):
        got = {r.rec_id: r.plan for r in pack.packed(frame(spark, cases), cap).select("rec_id", "plan").collect()}
        assert all(got[i] == model(n, r, cap) for i, (n, r) in enumerate(cases))


def test_policies_and_counters(spark):
    cases = [([3, 3], "ua"), ([9, 9], "ua"), ([3], "u"), ([20, 1], "ua")]
    skip = pack.packed(frame(spark, cases), 10, "skip").orderBy("rec_id").collect()
    assert [r.reason for r in skip] == [None, "overlength", "no_scored_tokens", "overlength"]
    p = pack.packed(frame(spark, cases), 12)
    c = pack.counters(p, pack.samples(p)).first()
    assert c.records_in == c.kept_records + c.skipped == 4 and c.unsplittable == 2


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=40))
def test_distribution(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v int")
    got = stats.distribution(df, "v").first()
    s = sorted(values)
    pick = lambda p: s[min(len(s) - 1, int(len(s) * p))] if s else 0
    assert got.n == len(s) and got.total_tokens == sum(s) and got["mean"] == (sum(s) // len(s) if s else 0)
    assert all(got[k] == pick(p) for k, p in stats.POINTS.items()) and got["max"] == (max(s) if s else 0)


def test_thresholds(spark):
    got = {r.threshold: r for r in stats.thresholds(spark.createDataFrame([(1000,), (3000,), (5000,)], "v int"), "v", (3000,)).collect()}[3000]
    assert (got.records_over, got.tokens_if_capped, got.frac_tokens_kept_if_capped) == (1, 7000, 0.777778)
    assert stats.thresholds(spark.createDataFrame([], "v int"), "v").count() == 8


def test_bit_length(spark):
    got = [r[0] for r in spark.range(5).select(stats.bit_length(F.col("id"))).collect()]
    assert got == [k.bit_length() for k in range(5)]


def test_holdout_cuts_the_last_group(spark):
    rows = [(i, k, 1) for i, k in enumerate("aaabbccccc")]
    df = spark.createDataFrame(rows, "rec_id int, prompt_key string, n_messages int")
    got = select.holdout(df, 4).collect()
    head = [r for r in got if r.split == "head"]
    keys = {r.prompt_key for r in head}
    assert len(head) == 4 and sorted(r.head_pos for r in head) == [0, 1, 2, 3]
    assert not keys & {r.prompt_key for r in got if r.split == "tail"}
    assert all(r.prompt_key in keys for r in got if r.split == "dropped")
    assert select.leaks(select.holdout(df, 4)).isEmpty()
    assert {r.split for r in select.holdout(df, 0).collect()} == {"tail"}


def test_a_hot_prompt_is_cut_before_the_shuffle(spark):
    df = spark.range(0, 20_000, 1, 8).select("id", F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("prompt_key"), F.lit(1).alias("n_messages"))
    df = df.withColumnRenamed("id", "rec_id")
    for out in (select.heads(df, 50), select.capped(df, 3)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        first = plan.index("WindowGroupLimit")
        assert plan.index("WindowGroupLimit", first + 1) > plan.index("Exchange hashpartitioning(prompt_key", first) > first  # one above, one below the shuffle
    got = select.heads(df, 50).orderBy("head_pos").collect()
    assert [r.head_pos for r in got] == list(range(50))


def test_a_long_conversation_splits_in_linear_time(spark):
    import time

    n = 20_000
    case = spark.range(1).selectExpr("CAST(id AS INT) AS rec_id", f"sequence(0, {n - 1}) AS idx", f"transform(sequence(0, {n - 1}), i -> if(i % 2 = 0, 'user', 'assistant')) AS roles", f"transform(sequence(0, {n - 1}), i -> CAST(1 + i % 7 AS BIGINT)) AS n_tok", f"transform(sequence(0, {n - 1}), i -> CAST(i % 2 * (1 + i % 7) AS BIGINT)) AS n_scored")
    begin = time.time()
    plan = pack.packed(case, 200).first().plan
    assert time.time() - begin < 30
    assert plan[:20] == model([1 + i % 7 for i in range(1200)], "ua" * 600, 200)[:20]


def test_cap_and_order_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, f"k{i % 7}", 1) for i in range(100)] + [(200, "", -1)], "rec_id int, prompt_key string, n_messages int")
    seen = set()
    for n in (1, 4, 16):
        c = select.capped(df.repartition(n), 2)
        assert c.count() == 14
        o = select.ordered(select.holdout(c.repartition(n), 3))
        seen.add(tuple((r.rec_id, r.split) for r in o.orderBy("pos").collect()))
    assert len(seen) == 1


def test_shards_and_strides(spark):
    order = spark.range(10).select(F.col("id").alias("pos"))
    got = [r[0] for r in select.shards(order, 4).groupBy("shard").count().orderBy("shard").select("count").collect()]
    assert got == [3, 3, 3, 1]
    assert sorted(r.pos for r in select.strided(order, 4).collect()) == [0, 2, 4, 6]
    assert sorted(r.pos for r in select.strided(spark.range(3).select(F.col("id").alias("pos")), 4).collect()) == [0, 1, 2]


def test_length_buckets(spark):
    df = spark.createDataFrame(list(enumerate([9, 1, 5, 3, 7, 2, 8])), "sample_no int, n_tok int")
    got = consume.length_buckets(df, 3).collect()
    assert sorted(r.n_tok for r in got) == [1, 2, 3, 5, 7, 8]
    assert {(r.rank, r.n_tok) for r in got} == {(0, 1), (1, 2), (2, 3), (0, 5), (1, 7), (2, 8)}


def test_eval_prefix_sizes():
    assert [consume.n_eval(n) for n in (4, 5, 100, 3519)] == [0, 1, 15, 64]


def test_warm_up(spark):
    got = [r[0] for r in spark.range(3).select(consume.warm_up(F.col("id"), 20, 1.0)).collect()]
    assert got == [0.5, 1.0, 1.0]


def test_early_stop(spark):
    evals = spark.createDataFrame([("r", i, v) for i, v in enumerate([1.0, 0.5, 0.55, 0.7, 0.65, 0.7])], "run string, step int, loss double")
    assert [r.strikes for r in metrics.strikes(evals, 0.1).orderBy("step").collect()] == [0, 0, 0, 1, 2, 3]
    assert metrics.early_stop(evals, 0.1, 3).first().stop_step == 5


def test_padding_and_truncation(spark):
    df = spark.createDataFrame([(1, 0, [1, 2, 3], [-100, 2, 3]), (2, 0, [4], [-100])], "rec_id int, batch int, input_ids array<bigint>, labels array<bigint>")
    rows = {r.rec_id: r for r in consume.padded(df).collect()}
    assert rows[2].ids == [4, 0, 0] and rows[2].lab == [-100] * 3 and rows[2].att == [1, 0, 0]
    assert [r.rec_id for r in consume.truncated(df, 2).collect()] == [1]
