"""Messages to segments and tokens, and why a conversation is rejected.

A message table has ``rec_id, msg_idx, role, content`` and may have ``content_type`` (Python name of a content that is not
a string), ``tool_calls`` (truthy) and ``reasoning`` (string).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.tokens import IGNORE, n_pieces, pieces, segment_encoder, token_id

#: The chat format's markers, the text between them, and the instructions of each mode.
START, END, DOCUMENT_END = "<|im_start|>", "<|im_end|>", "<|endoftext|>"
THINK = "<think>"
THINK_END = "</think>"
ASSISTANT_PREFIX = START + "assistant\n" + THINK + "\n\n" + THINK_END + "\n\n"
INSTRUCTIONS = {
    "off": "",
    "medium": "",
    "low": "Reasoning effort is set to low. Keep your thinking brief and focused, moving directly to the conclusion without unnecessary elaboration.",
    "xhigh": "Reasoning effort is set to xhigh. Please think carefully through the task, validate key assumptions, consider plausible alternatives, and prioritize correctness, consistency, and clarity in the final answer.",
}
FORBIDDEN = (START, END, DOCUMENT_END)


def optional(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def message_reason(df: DataFrame, strict: bool = True) -> Column:
    """The first reason to reject a message, in order: shape, content type, tool calls, reasoning, control tokens, role."""
    role, text = F.col("role"), strip(F.col("content"))
    assistant = role == "assistant"
    odd, calls, thought = optional(df, "content_type", "string"), optional(df, "tool_calls", "boolean"), optional(df, "reasoning", "string")
    shape = optional(df, "shape", "string")
    control = F.lit(False)
    for k in FORBIDDEN if strict else ():
        control = control | F.contains(text, F.lit(k))
    return (
        F.when(shape.isNotNull(), shape)
        .when(odd.isNotNull(), F.concat(F.lit("content_not_str:"), odd))
        .when(assistant & F.coalesce(calls, F.lit(False)), "native_tool_calls_present")
        .when(assistant & (strip(thought) != ""), "reasoning_content_present")
        .when(assistant & control, "control_token_in_assistant_content")
        .when(role.isin("system", "tool"), F.concat(F.lit("unsupported_role_for_this_corpus:"), role))
        .when(~F.coalesce(role.isin("user", "assistant"), F.lit(False)), F.concat(F.lit("unexpected_role:"), F.coalesce(role, F.lit("None"))))
    )


def record_reason(reason: str = "reason") -> Column:
    """Aggregate over a record's messages: a leading system message first, else the first message's reason that has one."""
    first = F.min_by("role", "msg_idx") == "system"
    at = F.min(F.when(F.col(reason).isNotNull(), F.struct(F.col("msg_idx"), F.col(reason).alias("r"))))["r"]
    return F.when(first, "unsupported_role_for_this_corpus:system").otherwise(at)


def reasons(messages: DataFrame, strict: bool = True, checked: bool = False) -> DataFrame:
    """(rec_id, reason); null: accepted. ``checked`` adds what the verifying renderer asks for: a user turn that is no bare
    tool response."""
    text = strip(F.col("content"))
    query = (F.col("role") == "user") & ~(text.startswith("<tool_response>") & text.endswith("</tool_response>"))
    m = messages.select("rec_id", "msg_idx", "role", message_reason(messages, strict).alias("reason"), query.alias("query"))
    reason = record_reason()
    if checked:
        reason = F.when(~F.coalesce(F.bool_or("query"), F.lit(False)), "no_user_query").otherwise(reason)
    return m.groupBy("rec_id").agg(reason.alias("reason"))


def segments(messages: DataFrame) -> DataFrame:
    """The table with ``segments``: (text, scored, marker) in order; a marker is one token. Only user and assistant messages."""
    seg = lambda t, scored, marker: F.struct((t if isinstance(t, Column) else F.lit(t)).alias("text"), F.lit(scored).alias("scored"), F.lit(marker).alias("marker"))
    text = strip(F.col("content"))
    user = F.array(seg(START, False, True), seg("user\n", False, False), seg(text, False, False), seg(END, False, True), seg("\n", False, False))
    reply = F.array(
        seg(START, False, True), seg("assistant\n", False, False), seg(THINK, False, True), seg("\n\n", False, False), seg(THINK_END, False, True), seg("\n\n", False, False),
        seg(text, True, False), seg(END, True, True), seg("\n", False, False),
    )
    kept = F.filter(F.when(F.col("role") == "user", user).otherwise(reply), lambda s: s["text"] != "")
    return messages.where(F.col("role").isin("user", "assistant")).withColumn("segments", kept)


def prologue(mode: str) -> tuple[str, int]:
    """Text that a mode puts before a conversation and its tokens by the native tokenizer."""
    import re

    from ..functions.tokens import PATTERN

    if mode not in INSTRUCTIONS:
        raise ValueError("bad_thinking_mode")
    if not INSTRUCTIONS[mode]:
        return "", 0
    body = "system\n" + INSTRUCTIONS[mode]
    return START + body + END + "\n", len(re.findall(PATTERN, body)) + 3


def lengths(messages: DataFrame, strict: bool = True) -> DataFrame:
    """``n_tok``, ``n_scored`` and ``reason`` of each message, thin rows made where the texts are read, without tokens."""
    own = n_pieces(strip(F.col("content")))
    tokens = F.when(F.col("role") == "user", own + 5).when(F.col("role") == "assistant", own + 11).otherwise(0)
    scored = F.when(F.col("role") == "assistant", own + 1).otherwise(0)
    return messages.select("rec_id", "msg_idx", "role", tokens.cast("long").alias("n_tok"), scored.cast("long").alias("n_scored"), message_reason(messages, strict).alias("reason"))


def record_lengths(lengths_: DataFrame) -> DataFrame:
    """(rec_id, raw_tokens, scored_tokens, n_messages) of accepted records: one shuffle of thin, pre-aggregated rows."""
    x = lengths_.groupBy("rec_id").agg(record_reason().alias("reason"), F.sum("n_tok").alias("raw_tokens"), F.sum("n_scored").alias("scored_tokens"), F.count("*").alias("n_messages"))
    return x.where("reason IS NULL").drop("reason")


def tokenized(messages: DataFrame) -> DataFrame:
    """Token table: per message ``pieces``, ``ids`` and ``labels`` (the ids where scored, else -100)."""
    flat = lambda f: F.flatten(F.transform("segments", f))
    one = lambda s: F.when(s["marker"], F.array(s["text"])).otherwise(pieces(s["text"]))
    t = segments(messages).withColumn("pieces", flat(one)).withColumn("mask", flat(lambda s: F.array_repeat(s["scored"], F.size(one(s)))))
    t = t.withColumn("ids", F.transform("pieces", token_id))
    return t.withColumn("labels", F.zip_with("ids", "mask", lambda i, m: F.when(m, i).otherwise(F.lit(IGNORE).cast("bigint")))).select("rec_id", "msg_idx", "role", "segments", "pieces", "ids", "labels")


def encoded(messages: DataFrame, load, strict: bool = True) -> DataFrame:
    """Token table by another tokenizer: per message ``ids`` and ``labels``, the checks ``whole``, ``prompt`` and ``decoded``,
    ``n_tok``, ``n_scored`` and ``reason``. Messages of other roles have no tokens, only a reason."""
    one = segment_encoder(load, ASSISTANT_PREFIX)
    known = segments(messages).withColumn("reason", message_reason(messages, strict))
    x = known.withColumn("t", one(F.transform("segments", lambda s: s["text"]), F.transform("segments", lambda s: s["scored"])))
    x = x.select("rec_id", "msg_idx", "role", "t.*", "reason").withColumn("n_tok", F.size("ids").cast("long")).withColumn("n_scored", F.size(F.filter("labels", lambda v: v != IGNORE)).cast("long"))
    other = messages.where(~F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False)))
    none, yes, zero = F.array().cast("array<int>"), F.lit(True), F.lit(0).cast("long")
    rest = other.select("rec_id", "msg_idx", "role", none.alias("ids"), none.alias("labels"), yes.alias("whole"), yes.alias("prompt"), yes.alias("decoded"), message_reason(messages, strict).alias("reason"), zero.alias("n_tok"), zero.alias("n_scored"))
    return x.unionByName(rest)
