"""Packing runs that go on from earlier ones, line numbers, rejected samples, checks over whole conversations."""

import json
import random

import pytest
from pyspark.sql import functions as F

from turnmill.functions import tokens
from turnmill.operators import render, verify
from turnmill.options import PackOptions
from turnmill.plans import packing
from turnmill.sources import chat, samples


def chats(n=24):
    out = []
    for i in range(n):
        turns = []
        for k in range(1 + i % 4):
            turns += [{"role": "user", "content": f"question {i} {k} " + "x y " * (i % 7)}, {"role": "assistant", "content": f"answer {i} {k}"}]
        out.append(json.dumps({"messages": turns}))
    return out


def texts(spark, out):
    return sorted(tuple(r.input_ids) for r in samples.read(spark, out).collect())


def without_options(manifest):
    return {k: v for k, v in manifest.items() if k != "options"}


OPTIONS = PackOptions(max_len=48, holdout_head=4, shards=6, verify=4, resume=True)


def test_a_reordered_source_loses_and_doubles_nothing(spark, tmp_path):
    src, out = tmp_path / "chat.jsonl", str(tmp_path / "out")
    lines = chats()
    src.write_text("\n".join(lines))
    _, first = packing.run(spark, str(src), out, OPTIONS)
    random.Random(2).shuffle(lines)
    src.write_text("\n".join(lines))
    code, second = packing.run(spark, str(src), out, OPTIONS)
    assert code == 0 and second["src_digest"] != first["src_digest"]
    fresh = str(tmp_path / "fresh")
    _, want = packing.run(spark, str(src), fresh, OPTIONS)
    assert texts(spark, out) == texts(spark, fresh) and len(set(texts(spark, out))) == second["samples"]
    assert without_options(second) == without_options(want)


def test_only_changed_shards_are_encoded_and_the_manifest_is_whole(spark, tmp_path, monkeypatch):
    log, src, out = tmp_path / "log", tmp_path / "chat.jsonl", str(tmp_path / "out")
    name, path = tmp_path / "words", str(log)
    name.write_text("a tokenizer")

    def from_file(_):
        def load():
            class Words:
                offsets = None

                def encode_batch(self, rows):
                    import re
                    import zlib

                    with open(path, "a") as f:
                        f.write("".join("x\n" for t in rows if "answer" in t))
                    return [[zlib.crc32(x.encode()) for x in re.findall(r"<[|/\w]+>|\w+|\s+|.", t)] for t in rows]

            return Words()

        return load

    monkeypatch.setattr(tokens, "ENCODED", tokens.ENCODED.replace("int>", "bigint>"))
    monkeypatch.setattr(tokens, "from_file", from_file)
    monkeypatch.setattr(packing.render, "encoded", lambda m, load, strict: plain(m, load, strict))

    def plain(m, load, strict):
        one = tokens.encoder(load)
        t = render.segments(m).withColumn("text", F.array_join(F.transform("segments", lambda s: s["text"]), "")).withColumn("ids", one(F.col("text")))
        labels = F.when(F.col("role") == "assistant", F.col("ids")).otherwise(F.transform("ids", lambda _: F.lit(-100).cast("bigint")))
        t = t.withColumn("labels", labels).withColumn("n_tok", F.size("ids").cast("long"))
        return t.select("rec_id", "msg_idx", "role", "ids", "labels", "n_tok", F.when(F.col("role") == "assistant", F.col("n_tok")).otherwise(F.lit(0).cast("long")).alias("n_scored"), F.lit(None).cast("string").alias("reason"))

    encoded = lambda: len(log.read_text().splitlines()) if log.exists() else 0
    options = PackOptions(max_len=4096, holdout_head=0, shards=6, verify=0, resume=True, tokenizer=str(name))
    lines = chats()
    src.write_text("\n".join(lines))
    _, first = packing.run(spark, str(src), out, options)
    whole = encoded()
    assert whole >= 60
    _, again = packing.run(spark, str(src), out, options)
    assert encoded() == whole and without_options(again) == without_options(first)
    lines[5] = lines[5].replace("answer", "another answer")
    src.write_text("\n".join(lines))
    _, changed = packing.run(spark, str(src), out, options)
    assert 0 < encoded() - whole <= whole / 3
    fresh = str(tmp_path / "fresh")
    _, want = packing.run(spark, str(src), fresh, options)
    assert without_options(changed) == without_options(want) and texts(spark, out) == texts(spark, fresh)


def test_fewer_shards_and_a_run_that_died(spark, tmp_path):
    from dataclasses import replace

    src, out = tmp_path / "chat.jsonl", str(tmp_path / "out")
    src.write_text("\n".join(chats()))
    _, first = packing.run(spark, str(src), out, OPTIONS)
    _, second = packing.run(spark, str(src), out, replace(OPTIONS, shards=2))
    assert second["samples"] == first["samples"] == samples.read(spark, out).count()
    samples.drop_shards(spark, f"{out}.summary", {1})  # as if the run had died between samples and summary
    _, third = packing.run(spark, str(src), out, replace(OPTIONS, shards=2))
    assert without_options(third) == without_options(second) and samples.read(spark, out).count() == third["samples"]


def test_rejected_samples_are_kept_aside_and_counted(spark, tmp_path, monkeypatch):
    src, out = tmp_path / "chat.jsonl", str(tmp_path / "out")
    src.write_text("\n".join(chats()))
    _, clean = packing.run(spark, str(src), out, OPTIONS)
    assembled = packing.pack.assembled
    bad = lambda c: F.when(F.col("rec_id") % 5 == 0, F.transform(c, lambda x: x + 1)).otherwise(c)
    monkeypatch.setattr(packing.pack, "assembled", lambda *a: assembled(*a).withColumn("labels", bad(F.col("labels"))))
    other = str(tmp_path / "other")
    code, m = packing.run(spark, str(src), other, OPTIONS)
    aside = samples.rejected(spark, other)
    assert code == 0 and m["rejected_samples"] == {"V5_violation": aside.count()} and m["samples"] + aside.count() == clean["samples"]
    assert {r.rec_id % 5 for r in aside.select("rec_id").collect()} == {0} and {r.reason for r in aside.select("reason").collect()} == {"V5_violation"}


def test_no_writing_task_is_larger_than_asked(spark, tmp_path):
    rows = [(i, i % 2, 0, [7] * (1 + i % 9), [7] * (1 + i % 9)) for i in range(200)]
    df = spark.createDataFrame(rows, "pos long, shard long, piece_no int, input_ids array<bigint>, labels array<bigint>")
    out = str(tmp_path / "out")
    samples.write(df, out, room=60)
    got = samples.read(spark, out).select("shard", F.size("input_ids").alias("n"), F.col("_metadata.file_path").alias("f"))
    sizes = [r.n for r in got.groupBy("f").agg(F.sum("n").alias("n")).collect()]
    assert len(sizes) > 10 and max(sizes) < 60 + 9
    assert samples.merge(spark, out, f"{out}.one") == 200
    merged = [len(r.input_ids) for r in spark.read.schema(samples.SAMPLE).json(f"{out}.one").collect()]
    assert merged == [1 + i % 9 for s in (0, 1) for i in range(s, 200, 2)]


def test_line_numbers_do_not_depend_on_splits_and_move_no_record(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.jsonl").write_text("\n\n".join(json.dumps({"messages": [{"role": "user", "content": f"q{k} {i}" * (i % 40)}]}) for i in range(300)) + "\nbroken {\n \n")
    seen = set()
    try:
        for size in ("128m", "3000", "900"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "100")
            r = chat.read(spark, str(tmp_path))
            got = sorted((x.rec_id, x.digest, x.messages is None) for x in r.collect())
            assert [g[0] for g in got] == list(range(903)) and sum(g[2] for g in got) == 3
            seen.add(tuple(got))
            plan = r._jdf.queryExecution().executedPlan().toString()
            above = plan[: plan.index("FileScan text")] if "FileScan text" in plan else plan
            assert "SortMergeJoin" not in above and "hashpartitioning" not in above and "rangepartitioning" not in above
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(seen) == 1


def test_malformed_elements_give_reasons(spark, tmp_path):
    user, reply = {"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}
    rows = [[user, reply], [user, "text", reply], ["text", user], [user, None], [{"role": "user", "content": 5}], [user, {"role": "assistant", "content": ["x"]}, 3], [reply, 4, user], [7], []]
    (tmp_path / "c.jsonl").write_text("\n".join([*(json.dumps({"messages": m}) for m in rows), json.dumps({"messages": "x"}), json.dumps({"m": 1})]))
    r = chat.read(spark, str(tmp_path / "c.jsonl"))
    assert [x.n_messages for x in chat.index(r).orderBy("rec_id").collect()] == [2, 3, -1, 2, -1, 3, -1, -1, 0, -1, -1]
    why = {x.rec_id: x.reason for x in render.reasons(chat.messages(r)).collect()}
    assert why == {0: None, 1: "error:AttributeError", 2: "error:AttributeError", 3: "error:AttributeError", 4: "content_not_str:int", 5: "content_not_str:list", 6: "error:AttributeError", 7: "error:AttributeError"}
    code, m = packing.run(spark, str(tmp_path / "c.jsonl"), str(tmp_path / "out"), PackOptions(holdout_head=0, verify=8, shards=1))
    assert code == 0 and m["skip_reasons"] == {"content_not_str:list": 1, "error:AttributeError": 2} and m["unparseable"] == 6


def test_faults_that_only_whole_conversations_show(spark):
    m = spark.createDataFrame([(1, 0, "user", "hello there"), (1, 1, "assistant", "fine words"), (1, 2, "user", "go on"), (1, 3, "assistant", "more")], "rec_id long, msg_idx long, role string, content string")
    t = render.tokenized(m).cache()
    assert verify.conversation_faults(t).count() == 0 and verify.mask_faults(t).count() == 0
    # a message without its last marker and line end: its last word and the next message's first one merge
    cut = t.where("msg_idx > 1").withColumn("segments", F.when(F.col("msg_idx") == 2, F.slice("segments", 3, 1)).otherwise(F.slice("segments", 7, 3)))
    cut = cut.withColumn("pieces", F.flatten(F.transform("segments", lambda s: F.when(s["marker"], F.array(s["text"])).otherwise(F.regexp_extract_all(s["text"], F.lit(tokens.PATTERN), F.lit(0))))))
    cut = cut.withColumn("labels", F.transform("pieces", lambda _: F.lit(-100).cast("bigint")))
    assert [r.whole for r in verify.conversation_faults(cut).collect()] == [False]
    # a prompt that isn't that of the messages before it: one of them is missing from the rendered pieces
    lost = t.withColumn("pieces", F.when(F.col("msg_idx") == 2, F.slice("pieces", 2, 3)).otherwise(F.col("pieces")))
    assert [r.prompts for r in verify.conversation_faults(lost).collect()] == [False]
    # as many scored tokens as there should be, one place early
    early = t.withColumn("labels", F.when(F.col("role") == "assistant", F.transform("ids", lambda x, i: F.when((i >= 8) & (i < F.size("ids") - 2), x).otherwise(-100))).otherwise(F.col("labels")))
    assert [r.msg_idx for r in verify.mask_faults(early).orderBy("msg_idx").collect()] == [1, 3]
