"""Fit, skip, truncate or split conversations against a length limit; what is lost is counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import IGNORE
from .render import record_reason


def per_record(lengths: DataFrame) -> DataFrame:
    """(rec_id, idx, roles, n_tok, n_scored) of accepted records: one row a conversation, messages in order, thin arrays."""
    m = F.sort_array(F.collect_list(F.struct("msg_idx", "role", "n_tok", "n_scored")))
    x = lengths.groupBy("rec_id").agg(m.alias("m"), record_reason().alias("reason")).where("reason IS NULL")
    return x.select("rec_id", *(F.col(f"m.{c}").alias(a) for c, a in (("msg_idx", "idx"), ("role", "roles"), ("n_tok", "n_tok"), ("n_scored", "n_scored"))))


#: Steps of a binary search: enough for arrays of 2^31 entries.
HALVINGS = 32


def running(values: Column) -> Column:
    """Prefix sums, beginning with 0: one pass that carries the array and grows it at its end in chunks of sums of their own, so that
    the copying is n times the square root of n and not the square of n."""
    width = F.greatest(F.ceil(F.sqrt(F.size(values))).cast("int"), F.lit(1))
    chunks = F.transform(F.sequence(F.lit(0), F.greatest((F.size(values) - 1).cast("int"), F.lit(0)), width), lambda i: F.slice(values, i + 1, width))
    zero = F.lit(0).cast("long")
    inner = lambda chunk: F.aggregate(chunk, F.array(zero), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    each = F.transform(chunks, inner)  # of each chunk, beginning with 0
    starts = F.aggregate(each, F.array(zero), lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + F.element_at(c, -1))))
    moved = F.zip_with(each, F.slice(starts, 1, F.size(each)), lambda c, s: F.transform(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), lambda x: x + s))
    return F.concat(F.array(zero), F.flatten(moved))


def last_within(sums: Column, low: Column, high: Column, limit: Column) -> Column:
    """The largest place from ``low`` to ``high`` whose prefix sum is at most ``limit``; ``low`` if there is none. By halving."""
    state = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"] + 1, 1)
        return F.when(s["lo"] >= s["hi"], s).otherwise(F.when(F.element_at(sums, mid + 1) <= limit, state(mid, s["hi"])).otherwise(state(s["lo"], mid - 1)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), state(low, high), halve, lambda s: s["lo"])


def pieces(n_tok: Column, n_scored: Column, roles: Column, base: int, cap: int) -> Column:
    """Message positions (from 0) of each piece of at most ``cap`` tokens.

    One fold over as many steps as there are messages; its state is where the next piece begins, whether it is the first,
    and where the pieces so far begin and end. Prefix sums are columns of their own, outside the state; a piece's end is found in them by halving.
    ``n_tok``, ``n_scored`` and ``roles``: arrays, or structs ``(sums, marks)`` of ``prefix``.
    """
    return spans(running(n_tok), running(n_scored), n_tok, roles, base, cap)


def spans(p: Column, s: Column, n_tok: Column, r: Column, base: int, cap: int) -> Column:
    """``pieces`` from prefix sums ``p`` of tokens and ``s`` of scored ones, which should be columns and not expressions, as each step
    looks at them."""
    n = F.size(n_tok)
    at = lambda arr, i: F.element_at(arr, i + 1)
    opening, marked = F.element_at(n_tok, 1), F.element_at(s, 2)
    piece = "struct<a: int, k: int, first: boolean>"
    zero = F.struct(F.lit(0).alias("a"), F.lit(True).alias("first"), F.array().cast(f"array<{piece}>").alias("out"))

    def step(state: Column, _: Column) -> Column:
        a, first, out = (state[x] for x in ("a", "first", "out"))
        head = F.when(first, F.lit(0)).otherwise(opening)
        end = last_within(p, a, n, at(p, a) + F.lit(cap - base) - head)

        def moved(end: Column) -> Column:
            back = (end < n) & (end - 1 > a) & (at(r, end - 1) == "user")
            k = F.when(back, end - 1).otherwise(end)
            scored = at(s, k) - at(s, a) + F.when(first, F.lit(0)).otherwise(marked)
            stuck = end == a
            resume = F.when((k < n) & (at(r, F.least(k, n - 1)) != "user"), k + 1).otherwise(k)
            new_a = F.when(stuck, a + F.when(at(r, a) == "user", 2).otherwise(1)).otherwise(resume)
            own = F.struct(a.alias("a"), k.cast("int").alias("k"), first.alias("first"))
            new_out = F.when(~stuck & (scored > 0), F.concat(out, F.array(own))).otherwise(out)
            return F.struct(new_a.cast("int").alias("a"), F.lit(False).alias("first"), new_out.alias("out"))

        # the end is looked up once: a lambda over an array of it alone
        once = F.element_at(F.transform(F.array(end), moved), 1)
        return F.when(a < n, once).otherwise(state)

    found = F.aggregate(F.sequence(F.lit(1), n), zero, step, lambda state: state["out"])
    body = lambda x: F.sequence(x["a"], x["k"] - 1)
    whole = F.transform(found, lambda x: F.when(x["first"], body(x)).otherwise(F.concat(F.array(F.lit(0)), body(x))))
    return F.when((n == 0) | (base + F.element_at(n_tok, 1) > cap), F.array().cast("array<array<int>>")).otherwise(whole)


def packed(records: DataFrame, cap: int, policy: str = "split", base: int = 0) -> DataFrame:
    """Per record: ``raw`` tokens, ``outcome`` (fit, skipped, truncated, split), ``reason`` of a skip, ``plan`` (pieces).

    ``records``: (rec_id, idx, roles, n_tok, n_scored) of accepted conversations. A truncated sample is its first ``cap``
    tokens, whatever they score; a piece without scored tokens is none.
    """
    raw = F.aggregate("n_tok", F.lit(base).cast("long"), lambda a, x: a + x)
    scored = F.aggregate("n_scored", F.lit(0).cast("long"), lambda a, x: a + x)
    x = records.withColumn("raw", raw).withColumn("scored", scored)
    every = F.array(F.sequence(F.lit(0), F.size("n_tok") - 1))
    fits = F.col("raw") <= cap
    if policy == "split":
        over = ~fits
        x = x.withColumn("__p", F.when(over, running(F.col("n_tok")))).withColumn("__s", F.when(over, running(F.col("n_scored"))))
        plan = F.when(fits, every).otherwise(spans(F.col("__p"), F.col("__s"), F.col("n_tok"), F.col("roles"), base, cap))
    elif policy == "truncate":
        plan = every
    else:
        plan = F.when(fits, every).otherwise(F.array().cast("array<array<int>>"))
    x = x.withColumn("plan", plan).drop("__p", "__s")
    over = {"split": "unsplittable", "skip": "overlength", "truncate": "no_scored_tokens"}[policy]
    reason = F.when(fits & (F.col("scored") == 0), "no_scored_tokens").when(~fits & (F.size("plan") == 0), over)
    outcome = F.when(reason.isNotNull(), "skipped").when(fits, "fit").otherwise({"split": "split", "truncate": "truncated"}.get(policy, "skipped"))
    return x.withColumn("reason", reason).withColumn("outcome", outcome).withColumn("plan", F.when(reason.isNotNull(), F.array().cast("array<array<int>>")).otherwise(F.col("plan")))


def samples(plans: DataFrame, base: int = 0) -> DataFrame:
    """(rec_id, piece_no, order, n_tok, n_scored) of each planned piece, before tokens are attached."""
    x = plans.select("rec_id", "idx", "n_tok", "n_scored", F.posexplode("plan").alias("piece_no", "order"))
    total = lambda c: F.aggregate("order", F.lit(0).cast("long"), lambda a, j: a + F.element_at(c, j + 1))
    return x.select("rec_id", "piece_no", F.transform("order", lambda j: F.element_at("idx", j + 1)).alias("order"), (total(F.col("n_tok")) + base).alias("n_tok"), total(F.col("n_scored")).alias("n_scored"))


def together(messages: DataFrame) -> DataFrame:
    """The messages dealt by record before they become tokens: texts are a quarter of their tokens' size in a shuffle, and where
    ``assembled`` then groups by record nothing moves again. As many tasks as shuffles have, so few large files don't hold it up."""
    return messages.repartition(int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "rec_id")


def assembled(pieces_: DataFrame, tokens: DataFrame, cap: int | None = None) -> DataFrame:
    """(rec_id, piece_no, input_ids, labels): planned pieces with the messages' tokens in order, cut to ``cap`` if given."""
    per = tokens.groupBy("rec_id").agg(F.map_from_entries(F.collect_list(F.struct("msg_idx", F.struct("ids", "labels").alias("v")))).alias("m"))
    x = pieces_.join(per, "rec_id")
    line = lambda f: F.flatten(F.transform("order", lambda j: F.element_at("m", j)[f]))
    cut = (lambda c: F.slice(c, 1, cap)) if cap else (lambda c: c)
    return x.select("rec_id", "piece_no", cut(line("ids")).alias("input_ids"), cut(line("labels")).alias("labels"))


def n_scored(labels: Column) -> Column:
    return F.size(F.filter(labels, lambda x: x != IGNORE)).cast("long")


def dropped(plans: DataFrame) -> DataFrame:
    """(rec_id, dropped_messages, dropped_tokens) of split records: messages that no piece has."""
    used = F.array_distinct(F.flatten("plan"))
    lost = F.filter(F.sequence(F.lit(0), F.size("n_tok") - 1), lambda j: ~F.array_contains(used, j))
    x = plans.where("outcome = 'split'").withColumn("lost", lost)
    return x.select("rec_id", F.size("lost").cast("long").alias("dropped_messages"), F.aggregate("lost", F.lit(0).cast("long"), lambda a, j: a + F.element_at(F.col("n_tok"), j + 1)).alias("dropped_tokens"))


def counters(plans: DataFrame, pieces_: DataFrame) -> DataFrame:
    """One row: records in, by outcome, samples, and tokens raw, emitted and scored. ``records_in`` = kept + skipped."""
    a = plans.agg(
        F.count("*").alias("records_in"), F.count_if(F.col("outcome") != "skipped").alias("kept_records"), F.count_if(F.col("outcome") == "skipped").alias("skipped"),
        F.count_if(F.col("outcome") == "truncated").alias("truncated"), F.count_if(F.coalesce(F.col("reason") == "unsplittable", F.lit(False))).alias("unsplittable"),
        F.coalesce(F.sum("raw"), F.lit(0)).alias("raw_tokens"),
    )
    b = pieces_.agg(F.count("*").alias("samples"), F.coalesce(F.sum("n_tok"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("n_scored"), F.lit(0)).alias("scored_tokens"))
    c = a.join(F.broadcast(b))
    return c.withColumn("scored_fraction", F.when(F.col("tokens") > 0, F.round(F.col("scored_tokens") / F.col("tokens"), 6)).otherwise(0.0))
