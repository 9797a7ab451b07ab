"""A packing run from chat lines to samples and a manifest."""

from __future__ import annotations

from dataclasses import asdict
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..functions import tokens
from ..functions.tokens import PATTERN
from ..operators import pack, render, select, verify
from ..options import EMPTY_OUTPUT, PACK_OK, STATS_OK, VERIFY_FAILED, PackOptions
from ..session import checkpoint
from ..sources import chat, samples


def verification(messages: DataFrame) -> dict:
    """Counts of all mask checks over some records' messages; ``ok`` only if something was checked and nothing failed."""
    rows = checkpoint(messages)
    cut = checkpoint(render.tokenized(rows))
    spans = verify.scored_spans(cut).agg(F.count("*"), F.count_if("prompt_ok"), F.count_if("decoded"), F.count_if("contiguous"), F.count_if(~F.col("assistant"))).first()
    out = {
        "records": rows.select("rec_id").distinct().count(), "turns": spans[0], "prompt_ok": spans[1], "decoded": spans[2], "contiguous": spans[3], "foreign": spans[4],
        "render_faults": verify.render_equal(render.segments(rows)).count(), "token_faults": verify.tokens_equal(cut).count(), "mask_faults": verify.mask_faults(cut).count(),
        "conversation_faults": verify.conversation_faults(cut).count(),
    }
    faults = any(out[k] for k in ("foreign", "render_faults", "token_faults", "mask_faults", "conversation_faults"))
    out["ok"] = out["records"] > 0 and spans[0] == spans[1] == spans[2] == spans[3] and not faults
    return out


def encoded_verification(messages: DataFrame, load, strict: bool = True) -> dict:
    """The same for another tokenizer."""
    rows = checkpoint(messages)
    coded = checkpoint(render.encoded(rows, load, strict))
    faults, whole = verify.encoded_faults(coded).count(), verify.encoded_conversation_faults(coded, rows, load).count()
    seen = coded.agg(F.count_distinct("rec_id"), F.count_if(F.col("n_scored") > 0)).first()
    return {"records": seen[0], "turns": seen[1], "faults": faults, "conversation_faults": whole, "ok": seen[0] > 0 and not faults and not whole}


def counted(rows: DataFrame, kind: str, key: Column | str) -> DataFrame:
    """Summary rows: how many rows of a shard have each key."""
    key = F.col(key) if isinstance(key, str) else key
    return rows.groupBy("shard", key.cast("string").alias("key")).agg(F.count("*").alias("n")).select("shard", F.lit(kind).alias("kind"), "key", "n")


def summed(rows: DataFrame, **values: Column) -> DataFrame:
    """Summary rows of kind ``total``: sums of each shard by name."""
    one = rows.groupBy("shard").agg(*(F.coalesce(F.sum(v), F.lit(0)).cast("long").alias(k) for k, v in values.items()))
    return one.select("shard", F.lit("total").alias("kind"), F.explode(F.create_map(*(x for k in values for x in (F.lit(k), F.col(k))))).alias("key", "n"))


def merged(summary: DataFrame) -> dict:
    """The manifest's counts and lengths from summaries of any number of shards and runs: sums of counts, so nothing is read again."""
    rows = checkpoint(summary.groupBy("kind", "key").agg(F.sum("n").alias("n")))
    named = {(r.kind, r.key): r.n for r in rows.where("kind IN ('reason', 'rejected', 'total')").collect()}
    raw, out = rows.where("kind = 'raw'"), rows.where("kind = 'out'")
    pick = lambda kind: {k: n for (of, k), n in sorted(named.items()) if of == kind}
    totals = {k: 0 for k in ("records", "samples", "tokens", "scored_tokens", "dropped_messages", "dropped_tokens")} | pick("total")
    return totals | {
        "skip_reasons": pick("reason"), "rejected_samples": pick("rejected"), "raw_lengths": stats.distribution(raw, "key", "n").first().asDict(),
        "raw_over": {str(r["threshold"]): r.asDict() for r in stats.thresholds(raw, "key", weight="n").collect()}, "out_lengths": stats.distribution(out, "key", "n").first().asDict(),
    }


def run(spark: SparkSession, src: str, out: str, options: PackOptions = PackOptions()) -> tuple[int, dict]:
    """Read chat lines, select, verify, pack and write; returns a result code and the manifest.

    Selection looks at thin keys alone. With ``resume`` shards whose signature stands (options, tokenizer, template, and each
    record's place, split and content) are kept, and only the other shards' records are rendered and encoded; every shard leaves a summary
    of counts and lengths, and the manifest adds these up, so it is that of a run from scratch. Verification runs over a sample of
    all selected records before anything is written; a failure leaves earlier results as they are. Samples that a check rejects go
    to ``out.rejected`` with the reason and are counted. ``options.tokenizer`` names a tokenizer file.
    """
    records = chat.read(spark, src)
    index = chat.index(records)
    messages = chat.messages(records)
    split = checkpoint(select.holdout(select.capped(index, options.max_per_prompt, options.shuffle_seed), options.holdout_head, options.shuffle_seed))
    if not select.leaks(split).isEmpty():
        raise RuntimeError("eval/train prompt leakage")
    order = checkpoint(select.shards(select.ordered(split, options.shuffle_seed, options.limit), options.shards).select("rec_id", "pos", "shard", "split"))
    strict = not options.allow_loose_special
    load = tokens.from_file(options.tokenizer) if options.tokenizer else None
    template = "".join((render.ASSISTANT_PREFIX, render.END, *render.INSTRUCTIONS.values()))
    manifest: dict = {"options": asdict(options), "unparseable": index.where("n_messages < 0").count(), "selected": order.count(), "head": order.where("split = 'head'").count(), "overlap": 0}
    manifest |= {
        "src_digest": samples.content_digest(records.select("rec_id", "digest")), "template_digest": samples.signature(template),
        "tokenizer_digest": samples.signature(Path(options.tokenizer).read_bytes() if load else PATTERN),
    }
    if options.verify:
        picked = messages.join(F.broadcast(select.strided(order, options.verify).select("rec_id")), "rec_id", "left_semi")
        picked = picked.join(render.reasons(picked, strict).where("reason IS NULL").select("rec_id"), "rec_id", "left_semi")
        manifest["verification"] = encoded_verification(picked, load, strict) if load else verification(picked)
        if not manifest["verification"]["ok"]:
            samples.write_manifest(spark, manifest | {"result": "VERIFY_FAILED"}, f"{out}.failed")
            return VERIFY_FAILED, manifest
    same = {k: v for k, v in asdict(options).items() if k not in ("resume", "verify", "stats_only")}
    base = samples.signature(sorted(same.items()), manifest["template_digest"], manifest["tokenizer_digest"])
    signatures = checkpoint(samples.plan_signatures(order.join(records.select("rec_id", "digest"), "rec_id"), base))
    old = samples.done(spark, out) if options.resume and not options.stats_only else None
    fresh = signatures if old is None else signatures.join(old, ["shard", "signature"], "left_anti")
    standing = None if old is None else checkpoint(signatures.join(old, ["shard", "signature"], "left_semi"))
    only = None if old is None else [r.shard for r in fresh.select("shard").collect()]
    todo = order if only is None else order.where(F.col("shard").isin(only))

    chosen = messages.join(todo.select("rec_id"), "rec_id", "left_semi")
    why = checkpoint(todo.join(render.reasons(chosen, strict), "rec_id", "left"))
    good = chosen.join(why.where("reason IS NULL").select("rec_id"), "rec_id", "left_semi")
    intro, lead = render.prologue(options.thinking)
    if load:
        lead = len(load().encode_batch([intro])[0])
        coded = render.encoded(good, load, strict)
        coded = coded if options.stats_only else checkpoint(coded)
    lengths = pack.per_record(coded.select("rec_id", "msg_idx", "role", "n_tok", "n_scored", "reason") if load else render.lengths(good, strict))
    plans = checkpoint(pack.packed(lengths, options.max_len, options.overlength, lead).join(todo, "rec_id"))
    parts = [
        counted(why.where("reason IS NOT NULL"), "reason", "reason"), counted(plans.where("reason IS NOT NULL"), "reason", "reason"), counted(plans, "raw", "raw"),
        summed(todo, records=F.lit(1)), summed(pack.dropped(plans).join(todo, "rec_id"), dropped_messages=F.col("dropped_messages"), dropped_tokens=F.col("dropped_tokens")),
    ]
    if options.stats_only:
        counts = merged(reduce(DataFrame.unionByName, parts))
        manifest |= {k: counts[k] for k in ("skip_reasons", "raw_lengths", "raw_over")}
        samples.write_manifest(spark, manifest | {"result": "STATS_OK"}, f"{out}.stats")
        return STATS_OK, manifest
    if only is None or only:
        built = pack.assembled(pack.samples(plans, lead), coded if load else render.tokenized(pack.together(good)), options.max_len if options.overlength == "truncate" else None)
        # samples are assembled once; what is written, rejected and counted is read from this table
        built.withColumn("reason", verify.sample_reason()).join(todo, "rec_id").write.mode("overwrite").parquet(f"{out}.staging")
        staged = spark.read.parquet(f"{out}.staging")
        samples.write_done(spark, standing, out)  # what is about to be replaced doesn't count as finished if this run dies
        kept = staged.where("reason IS NULL")
        samples.write(kept, out, only, options.block_tokens)
        samples.write_rejected(staged.where("reason IS NOT NULL"), out, only)
        sizes = kept.select("shard", F.size("input_ids").alias("n"), pack.n_scored(F.col("labels")).alias("scored"))
        parts += [counted(sizes, "out", "n"), summed(sizes, samples=F.lit(1), tokens=F.col("n"), scored_tokens=F.col("scored")), counted(staged.where("reason IS NOT NULL"), "rejected", "reason")]
        samples.write_summary(reduce(DataFrame.unionByName, parts), out, only)
        n = signatures.agg(F.coalesce(F.max("shard"), F.lit(-1))).first()[0] + 1
        for path in (out, f"{out}.summary", f"{out}.rejected"):
            samples.drop_shards(spark, path, beyond=n)  # of an earlier run with more shards
        samples.write_done(spark, signatures, out)
        samples.discard(spark, f"{out}.staging")
    manifest |= merged(samples.summary(spark, out)) if manifest["selected"] else merged(reduce(DataFrame.unionByName, parts))
    manifest["result"] = "PACK_OK" if manifest["samples"] else "EMPTY_OUTPUT"
    samples.write_manifest(spark, manifest, f"{out}.manifest")
    return (PACK_OK if manifest["samples"] else EMPTY_OUTPUT), manifest


def filter_lines(spark: SparkSession, src: str, out: str, ok) -> tuple[int, int]:
    """Lines whose assistant turns all round-trip, written as they are: (kept, dropped). Lines that can't be read go.

    ``ok`` maps a content column to a boolean one. A line is parsed where it stands, so its text needs no join.
    """
    raw = chat.lines(spark, src).where(F.trim("value") != "")
    parsed = raw.withColumn("m", F.from_json("value", "messages array<struct<role: string, content: variant>>, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    rows = parsed.where(F.col("m._bad").isNull()).select("value", F.coalesce("m.messages", F.array().cast("array<struct<role: string, content: variant>>")).alias("messages")).withColumn("rec_id", F.monotonically_increasing_id())
    rows = checkpoint(rows)  # the numbers must not change between the two uses
    turns = rows.select("rec_id", F.posexplode("messages").alias("msg_idx", "m")).select("rec_id", "msg_idx", F.col("m.role").alias("role"), chat.text(F.col("m.content")).alias("content"), chat.kind(F.col("m.content")).alias("content_type"))
    verdict = verify.round_trip(turns, ok(F.col("content")))
    kept = rows.join(verdict.where("NOT kept").select("rec_id"), "rec_id", "left_anti")
    kept.select("value").write.mode("overwrite").text(out)
    n = spark.read.text(out).count()
    return n, raw.count() - n
