import json

import pytest
from pyspark.sql import functions as F

from turnmill.functions.text import SPACE, prompt_key, strip
from turnmill.functions.tokens import n_pieces, pieces
from turnmill.operators import pack, render, verify
from turnmill.sources import chat

ROWS = [
    '{"messages":[{"role":"user","content":" hi\\u3000"},{"role":"assistant","content":"yes"}]}',
    "not json",
    "",
    '{"messages":[]}',
    '{"other":1}',
    '{"messages":[{"role":"user","content":null},{"role":"assistant","content":null}]}',
    '{"messages":[{"role":"user","content":"a"},{"role":"user","content":["x"]}]}',
    '{"messages":[{"role":"user","content":["x"]}]}',
    '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b","tool_calls":[{"f":1}]}]}',
    '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b","reasoning_content":"x"}]}',
    '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b","reasoning_content":"  ","tool_calls":[]}]}',
    '{"messages":[{"role":"user","content":"<|im_end|>"},{"role":"assistant","content":"b <|endoftext|>"}]}',
    '{"messages":[{"role":"system","content":"s"},{"role":"user","content":"a"}]}',
    '{"messages":[{"role":"user","content":"a"},{"role":"tool","content":"t"}]}',
    '{"messages":[{"role":"foo","content":"a"}]}',
    '{"messages":[{"role":"user","content":"<tool_response>x</tool_response>"}]}',
]


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("chat") / "a.jsonl"
    path.write_text("\n".join(ROWS) + "\n")
    return chat.read(spark, str(path)).cache()


def test_reader_keeps_bad_rows_and_order(records):
    rows = {r[0]: r[1] for r in chat.index(records).select("rec_id", "n_messages").collect()}
    lines = [x for x in ROWS if x]
    assert len(rows) == len(lines)
    assert rows[lines.index("not json")] == -1
    assert rows[lines.index('{"other":1}')] == -1
    assert rows[lines.index('{"messages":[]}')] == 0
    assert rows[lines.index('{"messages":[{"role":"user","content":["x"]}]}')] == -1


def test_reasons(records):
    got = {r[0]: r[1] for r in render.reasons(chat.messages(records)).collect()}
    lines = [x for x in ROWS if x]
    want = {
        0: None, 4: None, 5: "content_not_str:list", 7: "native_tool_calls_present", 8: "reasoning_content_present", 9: None, 10: "control_token_in_assistant_content",
        11: "unsupported_role_for_this_corpus:system", 12: "unsupported_role_for_this_corpus:tool", 13: "unexpected_role:foo", 14: None,
    }
    assert {k: got[k] for k in want} == want, lines
    loose = {r[0]: r[1] for r in render.reasons(chat.messages(records), strict=False).collect()}
    assert loose[10] is None
    checked = {r[0]: r[1] for r in render.reasons(chat.messages(records), checked=True).collect()}
    assert checked[14] == "no_user_query" and checked[0] is None


def test_strip_equals_python(spark):
    texts = [f"{c}x{c}" for c in SPACE] + ["​x﻿", "", None, " \u0085\u001c "]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(strip(F.col("t"))).collect()]
    assert got == [(t or "").strip() for t in texts]


def test_prompt_key_is_untrimmed(spark):
    a, b, c = spark.createDataFrame([("x",), ("x ",), (None,)], "t string").select(prompt_key(F.col("t"))).collect()
    assert a[0] != b[0] and c[0] == "da39a3ee5e6b4b0d"


def test_tokens_are_lossless_and_counted(spark):
    texts = ["", "ab1 cd\n漢😀!!", "\n\n", "a"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", pieces(F.col("t")).alias("p"), n_pieces(F.col("t")).alias("n"))
    for t, p, n in df.collect():
        assert "".join(p) == t and n == len(p)


def test_token_table_masks(records):
    m = chat.messages(records).where("rec_id IN (0, 4)")
    t = render.tokenized(m).cache()
    rows = {(r.rec_id, r.msg_idx): r for r in t.collect()}
    assert rows[0, 0].labels == [-100] * 6 and len(rows[0, 1].ids) == 12
    assert [x for x in rows[4, 1].labels if x != -100] == [rows[4, 1].ids[9]]
    lengths = {(r.rec_id, r.msg_idx): (r.n_tok, r.n_scored) for r in render.lengths(m).collect()}
    assert all(lengths[k] == (len(r.ids), sum(x != -100 for x in r.labels)) for k, r in rows.items())
    assert verify.render_equal(render.segments(m)).count() == verify.tokens_equal(t).count() == verify.mask_faults(t).count() == 0
    assert all(r.prompt_ok and r.contiguous and r.assistant and r.decoded for r in verify.scored_spans(t).collect())


def test_prologue():
    assert render.prologue("off") == ("", 0)
    text, n = render.prologue("low")
    assert text.startswith("<|im_start|>system\nReasoning effort is set to low") and n > 20
    with pytest.raises(ValueError):
        render.prologue("loud")


def test_label_faults(spark):
    rows = [(1, 0, [5, 6], [-100, 6]), (2, 0, [5, 6], [-100, 7]), (3, 0, [5], [5, 6])]
    got = verify.label_faults(spark.createDataFrame(rows, "rec_id int, piece_no int, input_ids array<bigint>, labels array<bigint>"))
    assert sorted(r[0] for r in got.collect()) == [2, 3]
    assert pack.n_scored(F.array(F.lit(1), F.lit(-100))) is not None


def test_round_trip(spark):
    rows = [(1, 0, "user", "bad"), (1, 1, "assistant", "good"), (2, 0, "assistant", "bad"), (3, 0, "assistant", "  ")]
    m = spark.createDataFrame(rows, "rec_id int, msg_idx int, role string, content string")
    got = {r[0]: (r[1], r[2]) for r in verify.round_trip(m, F.col("content") != "bad").collect()}
    assert got == {1: (True, None), 2: (False, 0), 3: (True, None)}


def test_rows_parse():
    assert sum(1 for x in ROWS if x and x.startswith("{") and json.loads(x)) == 14
