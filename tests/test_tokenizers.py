import json

import pytest
from pyspark.sql import functions as F

from turnmill.functions.tokens import encoder, from_file, round_trips
from turnmill.operators import metrics, render, verify
from turnmill.options import VERIFY_FAILED, PackOptions
from turnmill.plans import packing
from turnmill.sources import samples

pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")


def loader():
    """A loader that travels to the workers by value: the tests aren't on their path."""
    path = public_tokenizers.path("byte_bpe_50k.json")

    def load():
        import tokenizers

        class Bpe:
            def __init__(self):
                self.t = tokenizers.Tokenizer.from_file(path)

            def encode_batch(self, texts):
                return [e.ids for e in self.t.encode_batch(texts, add_special_tokens=False)]

            def decode(self, ids):
                return self.t.decode(ids, skip_special_tokens=False)

        return Bpe()

    return load


def test_other_tokenizers_plug_in(spark):
    texts = ["hello world", "", None, "ä 漢\n"]
    load = loader()
    own = load()
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(encoder(load)(F.col("t"))).collect()]
    assert got == own.encode_batch([t or "" for t in texts])
    assert all(r[0] for r in df.select(round_trips(load, render.END)(F.col("t"))).collect())


def test_filter_with_a_tokenizer(spark):
    m = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "fine")], "rec_id int, msg_idx int, role string, content string")
    assert verify.round_trip(m, round_trips(loader(), render.END)(F.col("content"))).first().kept


@pytest.fixture(scope="module")
def chat_tokenizer(tmp_path_factory):
    """The vocabulary with the chat format's markers as special tokens, and runs of line ends as words of their own: without that
    the joined text has other tokens than its segments, which verification reports."""
    import tokenizers
    from tokenizers import pre_tokenizers

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.add_special_tokens([render.START, render.END, render.THINK, render.THINK_END])
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(tokenizers.Regex(r"\n+"), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False)])
    path = tmp_path_factory.mktemp("tokenizer") / "chat.json"
    t.save(str(path))
    return str(path)


def test_packing_run_with_a_tokenizer(spark, tmp_path, chat_tokenizer):
    t = from_file(chat_tokenizer)()
    src, out = tmp_path / "chat.jsonl", str(tmp_path / "out")
    chats = [[x for k in range(1 + i % 3) for x in ({"role": "user", "content": f" asks {i} {k} ä漢 "}, {"role": "assistant", "content": f"It's {i}, I'm sure {k}!"})] for i in range(20)]
    src.write_text("\n".join(json.dumps({"messages": m}) for m in chats))
    options = PackOptions(max_len=4096, holdout_head=4, shards=2, verify=8, resume=True, tokenizer=chat_tokenizer)
    code, manifest = packing.run(spark, str(src), out, options)
    assert code == 0 and manifest["verification"]["ok"] and manifest["samples"] == 20
    text = lambda m: "".join(render.START + "user\n" + x["content"].strip() + render.END + "\n" if x["role"] == "user" else render.ASSISTANT_PREFIX + x["content"].strip() + render.END + "\n" for x in m)
    got = sorted(r.input_ids for r in samples.read(spark, out).collect())
    assert got == sorted(t.encode_batch([text(m) for m in chats]))
    scored = {t.decode([x for x in r.labels if x != -100]) for r in samples.read(spark, out).collect()}
    assert scored == {"".join(x["content"].strip() + render.END for x in m if x["role"] == "assistant") for m in chats}
    # another content under the same path is another run
    src.write_text("\n".join(json.dumps({"messages": m}) for m in chats[:10]))
    _, second = packing.run(spark, str(src), out, options)
    assert second["samples"] == 10 and second["src_digest"] != manifest["src_digest"]


def test_a_tokenizer_without_the_markers_fails_verification(spark, tmp_path):
    src = tmp_path / "chat.jsonl"
    src.write_text(json.dumps({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}))
    code, manifest = packing.run(spark, str(src), str(tmp_path / "out"), PackOptions(holdout_head=0, verify=2, tokenizer=public_tokenizers.path("byte_bpe_50k.json")))
    assert code == VERIFY_FAILED and manifest["verification"]["faults"] == 1


def test_planted_faults_are_seen(spark, chat_tokenizer):
    m = spark.createDataFrame([(1, 0, "user", "hello there"), (1, 1, "assistant", "fine words")], "rec_id long, msg_idx long, role string, content string")
    cut = F.transform("segments", lambda s: F.when(s["scored"] & ~s["marker"], F.struct(F.lit("fine wo").alias("text"), s["scored"].alias("scored"), s["marker"].alias("marker"))).otherwise(s))
    t = render.tokenized(m)
    # a word cut in two: its halves are two tokens, the text taken whole has one
    halves = F.flatten(F.transform("segments", lambda s: F.when(s["text"] == "fine words", F.array(F.struct(F.lit("fine wo").alias("text"), s["scored"].alias("scored"), s["marker"].alias("marker")), F.struct(F.lit("rds").alias("text"), s["scored"].alias("scored"), s["marker"].alias("marker")))).otherwise(F.array(s))))
    split = t.withColumn("segments", halves).withColumn("pieces", F.flatten(F.transform("segments", lambda s: F.when(s["marker"], F.array(s["text"])).otherwise(F.regexp_extract_all(s["text"], F.lit(r"(?s)[A-Za-z0-9]+|[^A-Za-z0-9]"), F.lit(0))))))
    assert [r.msg_idx for r in verify.tokens_equal(split).collect()] == [1] and verify.tokens_equal(t).count() == 0
    assert verify.render_equal(render.segments(m).withColumn("segments", cut)).count() == 1
    assert verify.mask_faults(t.withColumn("labels", F.array_repeat(F.lit(-100), F.size("labels")))).count() == 1
    bad = t.withColumn("labels", F.transform("labels", lambda x, i: F.when(i == 12, -100).otherwise(x)))
    spans = verify.scored_spans(bad).first()
    assert not (spans.contiguous and spans.decoded)
    e = render.encoded(m, from_file(chat_tokenizer)).cache()
    assert verify.encoded_faults(e).count() == 0
    assert verify.encoded_faults(e.withColumn("labels", F.col("ids"))).count() == 1  # a scored user turn
    assert verify.manifest_ok(0, 10, 10) and not verify.manifest_ok(1, 1, 10) and not verify.manifest_ok(0, 11, 10)


def test_memory_fit(spark):
    r = metrics.memory_fit(spark.createDataFrame([(1.0, 5.0), (2.0, 7.0), (4.0, 11.0), (None, 1.0)], "t double, gb double"), "t", "gb").first()
    assert (round(r.slope, 9), round(r.intercept, 9), r.n) == (2.0, 3.0, 3)
    assert metrics.memory_fit(spark.createDataFrame([], "t double, gb double"), "t", "gb").first().slope is None
