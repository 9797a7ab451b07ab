"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them, a posterior decides."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NEWLINE, U, Words, checkpoint, map_arrow, mix

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_distinct", "n_upper", "n_lower", "n_bangs", "n_ended", "n_letters", "n_marked")
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
ENDS = np.isin(np.arange(256), np.frombuffer(b".!?\"'):;", np.uint8))
WINDOW = 5


def doubled(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = np.zeros(len(s), bool)
    if len(s) > 1:
        eq = s[1:] == s[:-1]
        same[1:] |= eq
        same[:-1] |= eq
    out = np.empty(len(s), bool)
    out[order] = same
    return out


def count_text(col: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each row of a string column, for all rows at once."""
    n = len(col)
    w = Words(col)
    per = lambda doc, weights=None: np.bincount(doc, weights, minlength=n).astype(np.int64)
    byte_doc = np.repeat(np.arange(n), np.diff(w.text_off))
    where = lambda mask: per(byte_doc[mask])
    out = {"n_words": per(w.doc), "word_chars": where(~w.sep & ((w.raw & 0xC0) != 0x80)), "n_symbols": where(SYMBOLS[w.raw])}

    lines = Words(col, NEWLINE)
    spoken = np.zeros(len(lines.start), bool)
    if len(w.start):
        spoken[np.searchsorted(lines.start, w.start, "right") - 1] = True
    tag = mix(np.arange(n, dtype=U) + U(1))
    doc = lines.doc[spoken]
    keys = lines.hash[spoken] ^ tag[doc]
    _, kept = np.unique(keys, return_index=True)
    out["n_dup_lines"] = per(doc) - per(doc[kept])

    grams, at = w.grams(WINDOW)
    again = at[doubled(grams ^ tag[w.doc[at]])] if len(at) else at
    cover = np.zeros(len(w.start), bool)
    for j in range(WINDOW):
        cover[again + j] = True
    out["n_repeat_words"] = per(w.doc[cover])

    out["n_lines"] = per(doc)
    _, kept = np.unique(w.hash ^ tag[w.doc], return_index=True)
    out["n_distinct"] = per(w.doc[kept])
    out["n_upper"] = where((w.raw >= 65) & (w.raw <= 90))
    out["n_lower"] = where((w.raw >= 97) & (w.raw <= 122))
    out["n_bangs"] = where(w.raw == 33)
    out["n_letters"] = out["n_upper"] + out["n_lower"] + where(w.raw >= 0xC0)
    edge = SYMBOLS[w.raw[w.start]] | SYMBOLS[w.raw[w.end - 1]]
    out["n_marked"] = per(w.doc[edge])
    last = np.zeros(0, np.int64)
    if len(w.start):  # the last word of each line
        line = np.searchsorted(lines.start, w.start, "right")
        last = np.flatnonzero(np.append(line[1:] != line[:-1], True))
    out["n_ended"] = per(w.doc[last[ENDS[w.raw[w.end[last] - 1]]]])
    return out


def features(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and the counts of each row's whole text (null: empty)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        counts = count_text(b.column(1))
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(counts[c]) for c in COUNTS + MORE)], [key, *COUNTS, *MORE])

    kind = docs.schema[key].dataType.simpleString()
    return map_arrow(docs.select(key, text), run, f"`{key}` {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS + MORE), text)


def rule(bad: F.Column, good: F.Column) -> F.Column:
    return F.when(bad, "-").when(good, "+").otherwise("0")


def votes() -> F.Column:
    """The votes of all rules as one string; ``+`` good, ``-`` bad, ``0`` abstains."""
    c = F.col
    per_word = lambda x: c(x) / F.greatest(c("n_words"), F.lit(1))
    per_line = lambda x: c(x) / F.greatest(c("n_lines"), F.lit(1))
    caps = c("n_upper") / F.greatest(c("n_upper") + c("n_lower"), F.lit(1))
    long = c("n_words") >= 10
    return F.concat(
        rule(c("n_words") < 10, c("n_words") >= 30),
        rule(long & (per_word("n_repeat_words") > 0.15), long & (per_word("n_repeat_words") < 0.05)),
        rule(per_word("n_symbols") > 0.1, long & (per_word("n_symbols") < 0.01)),
        rule((c("n_dup_lines") >= 2) & (per_line("n_dup_lines") > 0.3), (c("n_lines") >= 3) & (c("n_dup_lines") == 0)),
        rule((per_word("word_chars") > 15) | (per_word("word_chars") < 2), long & per_word("word_chars").between(3, 9)),
        rule(long & (caps > 0.4), long & (caps < 0.15)),
        rule((c("n_words") >= 50) & (per_word("n_distinct") < 0.15) & (c("n_words") < 2000), (c("n_words").between(50, 2000)) & (per_word("n_distinct") > 0.3)),
        rule(long & (per_word("n_bangs") > 0.2), long & (per_word("n_bangs") < 0.02)),
        rule(per_word("n_marked") > 0.25, long & (per_word("n_marked") < 0.05)),
        rule(long & (c("n_letters") / F.greatest(c("word_chars"), F.lit(1)) < 0.85), long & (c("n_letters") / F.greatest(c("word_chars"), F.lit(1)) > 0.93)),
        rule((c("n_lines") >= 2) & (per_line("n_ended") < 0.2), long & (per_line("n_ended") > 0.7)),
    )


def fit(patterns: list[tuple[str, int]], rounds: int = 60) -> dict[str, float]:
    """Dawid-Skene style expectation-maximisation over vote patterns and their counts: pattern -> probability of good.

    Each rule has its own chance of either vote in either class, given that it votes; the classes start apart by whether any rule objects.
    """
    if not patterns:
        return {}
    names = sorted(patterns)
    v = np.array([["-0+".index(x) for x in p] for p, _ in names])
    n = np.array([c for _, c in names], float)
    post = np.where((v == 0).any(1), 0.1, 0.9)
    for _ in range(rounds):
        score = []
        for weight in (n * post, n * (1 - post)):
            said = np.stack([(weight[:, None] * (v == k)).sum(0) + 0.5 for k in (0, 2)])
            chance = np.zeros((3, v.shape[1]))  # an abstention tells nothing
            chance[[0, 2]] = np.log(said / said.sum(0))
            score.append(math.log((weight.sum() + 1) / (n.sum() + 2)) + chance[v, np.arange(v.shape[1])].sum(1))
        new = 1 / (1 + np.exp(np.clip(score[1] - score[0], -60, 60)))
        done, post = np.abs(new - post).max() < 1e-6, new
        if done:
            break
    return {p: float(x) for (p, _), x in zip(names, post, strict=True)}


def quality(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """Counts, votes, ``posterior`` and ``kept`` for every row of ``docs``.

    Null and empty texts have zero counts and fail the base rule. Repeated rows are judged one by one. An empty table
    gives an empty result. Other columns of ``docs`` are not read. The driver sees only the distinct vote patterns
    (at most three to the number of rules) with their counts over all rows.
    """
    f = checkpoint(features(docs, text, key).withColumn("votes", votes()))
    post = fit([(r[0], r[1]) for r in f.groupBy("votes").count().collect()])
    # a row a pattern, at most three to the number of rules: small enough to go to every task
    known = docs.sparkSession.createDataFrame(sorted(post.items()), "votes string, posterior double")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        f.join(F.broadcast(known), "votes")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
        .select(key, *COUNTS, "base_failed", "kept", "posterior", "votes")
    )
