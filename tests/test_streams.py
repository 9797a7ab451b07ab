"""Streams: one small state a run, batches that can run again, and the planning run over packed samples."""

import json
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from turnmill.operators import metrics
from turnmill.options import PackOptions, PlanOptions
from turnmill.plans import packing, training
from turnmill.sources import samples
from turnmill.streaming import live


def line(i, turns=1):
    return json.dumps({"messages": [x for k in range(turns) for x in ({"role": "user", "content": f"q {i} {k}"}, {"role": "assistant", "content": f"answer {i} {k}"})]})


def test_verdicts_over_many_batches_equal_those_of_all_rows(spark, tmp_path):
    rng = random.Random(8)
    rows = [(f"r{k}", i, round(1 / (1 + i * (k + 1) / 9) + rng.random() / 3, 3)) for k in range(5) for i in range(24)]
    logs, out, state = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "state")
    logs.mkdir()
    for part in range(4):
        some = [r for r in rows if r[1] // 6 == part]
        rng.shuffle(some)
        (logs / f"{part}.json").write_text("\n".join(json.dumps({"run": r, "step": s, "eval_loss": v, "kind": "eval"}) for r, s, v in some + some[:2]))
        assert live.watch(live.metric_stream(spark, str(logs)), out, state, 0.05, 3).awaitTermination(120)
    df = spark.createDataFrame(rows, "run string, step bigint, loss double")
    want = {r.run: r.stop_step for r in metrics.early_stop(df, 0.05, 3).collect()}
    got = {r.run: r for r in live.verdicts(spark, out).collect()}
    assert {k: r.stop_step for k, r in got.items()} == want and any(want.values())
    judged = spark.read.parquet(f"{out}/batch=*")
    strikes = {(r.run, r.step): (r.best, r.strikes) for r in metrics.strikes(df, 0.05).collect()}
    assert {(r.run, r.step): (r.best, r.strikes) for r in judged.collect()} == strikes and judged.count() == len(rows)


def test_packed_batches_write_nothing_twice(spark, tmp_path):
    src, out, state = tmp_path / "chat", str(tmp_path / "out"), str(tmp_path / "state")
    src.mkdir()
    go = lambda: live.pack_stream(live.chat_stream(spark, str(src)), out, state, PackOptions(max_len=40)).awaitTermination(180)
    (src / "a.jsonl").write_text("\n".join([*(line(i, 1 + i % 3) for i in range(8)), line(3, 1), "", "broken {", json.dumps({"messages": [{"role": "system", "content": "s"}]})]))
    assert go()
    first = spark.read.parquet(out).count()
    (src / "b.jsonl").write_text("\n".join([*(line(i, 1 + i % 3) for i in range(4, 12)), "broken {"]))  # half of it is known
    assert go()
    rows = spark.read.parquet(out)
    assert rows.select("rec_id", "piece_no").distinct().count() == rows.count() > first
    assert rows.select("input_ids").distinct().count() == rows.count()
    total = {(r.kind, r.key): r.n for r in spark.read.parquet(f"{out}.summary").groupBy("kind", "key").agg(F.sum("n").alias("n")).collect()}
    assert total["lines", "parsed"] == 13 and total["lines", "unparseable"] == 1 and total["samples", "written"] == rows.count()
    assert total["reason", "unsupported_role_for_this_corpus:system"] == 1
    # a batch that runs again gives what it gave
    lines = spark.createDataFrame([(i, line(i, 3)) for i in range(5)], "rec_id long, value string")
    assert sorted(map(str, live.packed(lines, PackOptions(max_len=40))[0].collect())) == sorted(map(str, live.packed(lines.repartition(3), PackOptions(max_len=40))[0].collect()))


def test_planning_run_over_packed_samples(spark, tmp_path):
    src, out = tmp_path / "chat.jsonl", str(tmp_path / "out")
    src.write_text("\n".join(line(i, 1 + i % 5) for i in range(43)))
    packing.run(spark, str(src), out, PackOptions(max_len=4096, holdout_head=8, shards=3, verify=2, block_tokens=200))
    options = PlanOptions(eval_max=6, max_len=80, steps=30, accum=2)
    facts = training.run(spark, out, str(tmp_path / "plan"), 4, options)
    order = [r.n for r in samples.read(spark, out).select("shard", F.size("input_ids").alias("n"), F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("m")).orderBy("shard", "f", "m").collect()]
    cut = [min(n, 80) for n in order]
    train = sorted(range(6, 43), key=lambda i: cut[i])  # stable
    assert facts["samples"] == 43 and facts["n_eval"] == 6 and facts["n_train"] == 36
    assert facts["truncated"] == sum(n > 80 for n in order) > 0 and facts["left_out"] == train[36:]
    placed = {r.sample_no: r for r in spark.read.parquet(f"{tmp_path}/plan/placed").collect()}
    blocks = {tuple(train[4 * b : 4 * b + 4]) for b in range(9)}
    by_seq = {seq: tuple(sorted((r.rank, r.sample_no) for r in placed.values() if r.part == "train" and r.seq == seq)) for seq in range(9)}
    assert {tuple(no for _, no in v) for v in by_seq.values()} == blocks
    steps = spark.read.parquet(f"{tmp_path}/plan/steps").collect()
    assert len(steps) == 30 * 2 * 4
    for r in steps:
        assert placed[r.sample_no].rank == r.rank and placed[r.sample_no].seq == (r.step * 2 + r.micro) % 9
    rates = {r.step: r for r in spark.read.parquet(f"{tmp_path}/plan/rates").collect()}
    assert rates[0].lr == pytest.approx(1e-4 / 3) and rates[0].logged_lr == rates[1].lr and rates[29].lr == 1e-4
    assert rates[3].tokens == sum(r.n_tok for r in steps if r.step == 3)
    with pytest.raises(ValueError, match="held-out head"):
        training.run(spark, out, str(tmp_path / "plan"), 4, replace(options, eval_max=9))
    with pytest.raises(ValueError, match="fewer than"):
        training.run(spark, out, str(tmp_path / "plan"), 4, replace(options, min_samples=99))
