"""Checks of rendered, masked and packed data; each gives counts that must agree, or rows that must not exist."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.tokens import IGNORE, Tokenizer, conversation_checker, pieces
from .pack import running
from .render import ASSISTANT_PREFIX, END, START


def render_equal(segmented: DataFrame) -> DataFrame:
    """V1: messages whose joined segments differ from an independently concatenated text."""
    text = strip(F.col("content"))
    plain = F.when(F.col("role") == "user", F.concat(F.lit(START + "user\n"), text, F.lit(END + "\n"))).otherwise(F.concat(F.lit(ASSISTANT_PREFIX), text, F.lit(END + "\n")))
    joined = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return segmented.where(joined != plain).select("rec_id", "msg_idx")


def tokens_equal(tokens: DataFrame) -> DataFrame:
    """V2: messages whose tokens, segment by segment, differ from those of the texts between markers taken whole: a token
    crosses a cut."""
    state = lambda out, text: F.struct(out.alias("out"), text.alias("text"))
    step = lambda a, s: F.when(s["marker"], state(F.concat(a["out"], pieces(a["text"]), F.array(s["text"])), F.lit(""))).otherwise(state(a["out"], F.concat(a["text"], s["text"])))
    whole = F.aggregate("segments", state(F.array().cast("array<string>"), F.lit("")), step, lambda a: F.concat(a["out"], pieces(a["text"])))
    return tokens.where(whole != F.col("pieces")).select("rec_id", "msg_idx")


def encoded_faults(encoded: DataFrame) -> DataFrame:
    """V2, V3, V3b and V4 for a table of ``render.encoded``: messages that fail a check, or score in several stretches or in a user's turn."""
    at = F.filter(F.sequence(F.lit(1), F.size("labels")), lambda i: F.element_at("labels", i) != IGNORE)
    one = F.when(F.size("ids") > 0, (F.size(at) == 0) | ((F.col("role") == "assistant") & (F.element_at(at, -1) - F.element_at(at, 1) + 1 == F.size(at)))).otherwise(F.lit(True))
    return encoded.where(~(F.col("whole") & F.col("prompt") & F.col("decoded") & one)).select("rec_id", "msg_idx", "whole", "prompt", "decoded")


def label_ok() -> Column:
    """V5 of one sample: labels are -100 or the id, as many as ids."""
    return (F.size("input_ids") == F.size("labels")) & F.forall(F.arrays_zip("input_ids", "labels"), lambda z: F.coalesce((z["labels"] == IGNORE) | (z["labels"] == z["input_ids"]), F.lit(False)))


def sample_reason() -> Column:
    """Why an assembled sample is not written, or null."""
    return F.when(~F.exists("labels", lambda x: x != IGNORE), "no_scored_tokens").when(~label_ok(), "V5_violation")


def scored_spans(tokens: DataFrame) -> DataFrame:
    """V3, V3b, V3c, V4 of each assistant message: the masked prefix is the generation prompt, the scored run is one
    stretch of an assistant message and spells content and end marker."""
    at = F.filter(F.sequence(F.lit(1), F.size("labels")), lambda i: F.element_at("labels", i) != IGNORE)
    x = tokens.withColumn("at", at)
    prefix = F.array_join(F.slice("pieces", 1, F.element_at("at", 1) - 1), "")
    spelled = F.array_join(F.transform("at", lambda i: F.element_at("pieces", i)), "")
    want = F.array_join(F.transform(F.filter("segments", lambda s: s["scored"]), lambda s: s["text"]), "")
    scored = x.where(F.size("at") > 0)
    return scored.select(
        "rec_id", "msg_idx", (prefix == ASSISTANT_PREFIX).alias("prompt_ok"),
        (F.element_at("at", -1) - F.element_at("at", 1) + 1 == F.size("at")).alias("contiguous"), (F.col("role") == "assistant").alias("assistant"), (spelled == want).alias("decoded"),
    )


def label_faults(samples: DataFrame) -> DataFrame:
    """V5: samples whose labels are neither -100 nor the id, or of another length."""
    return samples.where(~label_ok()).select("rec_id", "piece_no")


def mask_faults(tokens: DataFrame) -> DataFrame:
    """V6: messages whose labels differ, place by place, from labels set anew from offsets: the scored segments' stretches of the joined
    text, measured in code points, against where each token begins in it."""
    width = lambda x: F.length(x).cast("long")
    step = lambda a, s: F.struct((a["at"] + width(s["text"])).alias("at"), F.when(s["scored"], F.concat(a["on"], F.array(F.struct(a["at"].alias("s"), (a["at"] + width(s["text"])).alias("e"))))).otherwise(a["on"]).alias("on"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<s: bigint, e: bigint>>").alias("on"))
    stretches = F.aggregate("segments", zero, step, lambda a: a["on"])
    starts = F.slice(running(F.transform("pieces", width)), 1, F.size("pieces"))
    x = tokens.withColumn("__on", stretches).withColumn("__starts", starts)
    anew = F.zip_with("ids", "__starts", lambda i, p: F.when(F.exists("__on", lambda o: (o["s"] <= p) & (p < o["e"])), i).otherwise(F.lit(IGNORE).cast("bigint")))
    return x.where(~anew.eqNullSafe(F.col("labels"))).select("rec_id", "msg_idx")


def conversation_faults(tokens: DataFrame) -> DataFrame:
    """V2 and V3 over whole conversations of ``render.tokenized``: records whose tokens, message by message, differ from those of the
    whole text between markers, or whose text up to a reply's first scored token isn't the prompt rendered from the messages before it.

    For the records of a verification sample: a conversation is one row.
    """
    m = F.sort_array(F.collect_list(F.struct("msg_idx", "role", "segments", "pieces", "labels")))
    x = tokens.groupBy("rec_id").agg(m.alias("m"))
    state = lambda out, text: F.struct(out.alias("out"), text.alias("text"))
    step = lambda a, s: F.when(s["marker"], state(F.concat(a["out"], pieces(a["text"]), F.array(s["text"])), F.lit(""))).otherwise(state(a["out"], F.concat(a["text"], s["text"])))
    whole = F.aggregate(F.flatten("m.segments"), state(F.array().cast("array<string>"), F.lit("")), step, lambda a: F.concat(a["out"], pieces(a["text"])))
    body = lambda v: F.array_join(F.transform(F.filter(v["segments"], lambda s: s["scored"] & ~s["marker"]), lambda s: s["text"]), "")
    asked = lambda v: F.array_join(F.transform(F.filter(v["segments"], lambda s: ~s["marker"]), lambda s: s["text"]), "")
    # rendered again from role and content: the user's text stands between "user\n" and the last line end
    again = lambda v: F.when(v["role"] == "user", F.concat(F.lit(START), asked(v).substr(F.lit(1), F.length(asked(v)) - 1), F.lit(END + "\n"))).otherwise(F.concat(F.lit(ASSISTANT_PREFIX), body(v), F.lit(END + "\n")))
    text = lambda upto: F.array_join(F.flatten(F.transform(F.slice("m", 1, upto), lambda v: v["pieces"])), "")
    head = lambda v: F.array_join(F.slice(v["pieces"], 1, F.greatest(F.array_position(F.transform(v["labels"], lambda y: y != IGNORE), True) - 1, F.lit(0)).cast("int")), "")
    prompt = lambda v, k: F.concat(text(k), head(v)) == F.concat(F.array_join(F.transform(F.slice("m", 1, k), again), ""), F.lit(ASSISTANT_PREFIX))
    replies = F.filter(F.transform("m", lambda v, k: F.when(v["role"] == "assistant", prompt(v, k)).otherwise(F.lit(True))), lambda ok: ~ok)
    return x.select("rec_id", (whole == F.flatten("m.pieces")).alias("whole"), (F.size(replies) == 0).alias("prompts")).where(~(F.col("whole") & F.col("prompts")))


def encoded_conversation_faults(tokens: DataFrame, messages: DataFrame, load: Callable[[], Tokenizer]) -> DataFrame:
    """V2, V3 and V6 over whole conversations of another tokenizer: the conversation is rendered from its messages, encoded once with
    offsets, and compared with the messages' ids; each reply's prompt is rendered from the messages before it and encoded by itself;
    labels are set anew from the offsets of the replies and compared place by place (for tokenizers that give offsets).
    """
    text = strip(F.col("content"))
    m = F.sort_array(F.collect_list(F.struct("msg_idx", "role", "text", "ids", "labels")))
    x = tokens.join(messages.select("rec_id", "msg_idx", text.alias("text")), ["rec_id", "msg_idx"]).groupBy("rec_id").agg(m.alias("m"))
    check = conversation_checker(load, (START, END, ASSISTANT_PREFIX))
    c = check(*(F.col(f"m.{k}") for k in ("role", "text", "ids", "labels")))
    return x.select("rec_id", c.alias("c")).select("rec_id", "c.*").where(~(F.col("whole") & F.col("prompts") & F.col("mask")))


def manifest_ok(overlap: int, eval_max: int, holdout_head: int) -> bool:
    """V9: no prompt on both sides, and the consumer's evaluation set within the held-out head."""
    return overlap == 0 and eval_max <= holdout_head


def round_trip(messages: DataFrame, ok: F.Column) -> DataFrame:
    """(rec_id, kept, first_bad): a record is dropped if any non-empty assistant turn fails ``ok``; other turns don't count.

    ``ok``: a boolean column over the message table, true where decoding the encoded turn gives it back. A turn whose
    content is no string (``content_type``) fails.
    """
    odd = F.col("content_type").isNotNull() if "content_type" in messages.columns else F.lit(False)
    turn = (F.col("role") == "assistant") & ((strip(F.col("content")) != "") | odd)
    bad = F.when(turn & (odd | ~F.coalesce(ok, F.lit(False))), F.col("msg_idx"))
    return messages.groupBy("rec_id").agg(F.min(bad).alias("first_bad")).select("rec_id", F.col("first_bad").isNull().alias("kept"), "first_bad")
