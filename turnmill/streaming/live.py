"""Metric logs and chat records as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import pack, render, verify
from ..options import PackOptions
from ..session import checkpoint
from ..sources import chat

METRIC = (
    "run string, ts timestamp, step bigint, total_steps bigint, loss double, grad_norm double, lr double, peak_gib double, sec_per_step double, tok_per_s double, "
    "cum_s double, ctx_tokens bigint, trainable_tokens bigint, world int, global_batch int, eval_loss double, kind string"
)


def metric_stream(spark: SparkSession, path: str) -> DataFrame:
    """Step and evaluation rows of rotated JSON logs in a folder."""
    return spark.readStream.schema(METRIC).json(path)


def windowed(stream: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Per run and window: steps, mean loss and tokens; rows later than the watermark are left out."""
    steps = stream.where("kind IS NULL").withWatermark("ts", late)
    return steps.groupBy("run", F.window("ts", width)).agg(F.count("*").alias("steps"), F.avg("loss").alias("mean_loss"), F.sum("ctx_tokens").alias("tokens"))


#: What is kept of a run between batches, whatever their number, and what an evaluation row becomes.
STATE = "last bigint, best double, strikes bigint, stop_step bigint, late bigint"
JUDGED = "run string, step bigint, loss double, best double, strikes bigint, stop_step bigint, late bigint"


def judged(stream: DataFrame, delta: float = 0.0018, patience: int = 3) -> DataFrame:
    """Each evaluation row with the best so far, the strikes up to it and the first step with ``patience`` of them: one small state a
    run. Where the best falls the evaluation itself is no strike, so a count of the trailing strikes is all that has to be kept.

    Rows of a batch are taken in order of their steps. A row that is not after the last one seen, as one that came twice, changes
    nothing and is counted as late.
    """

    def judge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, best, strikes, stop, late = state.get if state.exists else (None, None, 0, None, 0)
        rows = pd.concat(list(frames)).dropna(subset=["step", "loss"]).sort_values(["step", "loss"], kind="stable")
        out = []
        for step, loss in zip(rows["step"].tolist(), rows["loss"].tolist(), strict=True):
            if last is not None and step <= last:
                late += 1
                continue
            last, best = int(step), loss if best is None else min(best, loss)
            strikes = 0 if loss <= best + delta else strikes + 1
            if stop is None and strikes >= patience:
                stop = last
            out.append((key[0], last, loss, best, strikes, stop, late))
        state.update((last, best, strikes, stop, late))
        frame = pd.DataFrame(out, columns=["run", "step", "loss", "best", "strikes", "stop_step", "late"])
        yield frame.astype({"step": "Int64", "strikes": "Int64", "stop_step": "Int64", "late": "Int64"})

    evals = stream.where("kind = 'eval'").select("run", "step", F.col("eval_loss").alias("loss"))
    return evals.groupBy("run").applyInPandasWithState(judge, JUDGED, STATE, "append", GroupStateTimeout.NoTimeout)


def watch(stream: DataFrame, out: str, state: str, delta: float = 0.0018, patience: int = 3) -> StreamingQuery:
    """Judged evaluation rows in ``out``, and of each batch the last verdict of each run it has in ``out``.verdict; a batch that runs
    again overwrites itself. Earlier batches are never read."""

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")
        last = rows.groupBy("run").agg(*(F.max_by(c, "step").alias(c) for c in ("best", "strikes", "stop_step", "late")), F.max("step").alias("step"))
        last.write.mode("overwrite").parquet(f"{out}.verdict/batch={number}")
        rows.unpersist()

    return judged(stream, delta, patience).writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start()


def verdicts(spark: SparkSession, out: str) -> DataFrame:
    """(run, step, best, strikes, stop_step, late): what holds now for each run."""
    kind = "run string, best double, strikes bigint, stop_step bigint, late bigint, step bigint, batch int"
    rows = spark.read.schema(kind).parquet(f"{out}.verdict")
    return rows.groupBy("run").agg(*(F.max_by(c, "batch").alias(c) for c in ("step", "best", "strikes", "stop_step", "late")))


def chat_stream(spark: SparkSession, path: str) -> DataFrame:
    """(rec_id, value): lines of a folder's files that aren't blank, each content once, whatever file or batch it comes with. ``rec_id``
    is taken from the line's MD5; the state holds one digest a line."""
    lines = spark.readStream.text(path).where(F.col("value").rlike(r"\S"))
    keyed = lines.withColumn("rec_id", F.conv(F.substring(F.md5(F.col("value").cast("binary")), 1, 15), 16, 10).cast("long"))
    return keyed.dropDuplicates(["rec_id"])


def pack_stream(stream: DataFrame, out: str, state: str, options: PackOptions = PackOptions()) -> StreamingQuery:
    """Pack chat lines as they come: samples of each batch in ``out``/batch=N, counts in ``out``.summary/batch=N.

    Order, hold-out and caps need the whole corpus and are a packing run's matter. A batch that runs again, after a failure between
    its writes and its commit, overwrites what it wrote.
    """

    def batch(rows: DataFrame, number: int) -> None:
        samples_, counts = packed(checkpoint(rows), options)
        samples_.write.mode("overwrite").parquet(f"{out}/batch={number}")
        counts.coalesce(1).write.mode("overwrite").parquet(f"{out}.summary/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start()


def packed(lines: DataFrame, options: PackOptions) -> tuple[DataFrame, DataFrame]:
    """Samples (rec_id, piece_no, input_ids, labels) of chat lines (rec_id, value), and counts (kind, key, n)."""
    records = chat.parsed(lines)
    readable = chat.index(records).where("n_messages >= 0").select("rec_id")
    messages = chat.messages(records).join(readable, "rec_id", "left_semi")
    why = checkpoint(render.reasons(messages, not options.allow_loose_special))
    good = messages.join(why.where("reason IS NULL").select("rec_id"), "rec_id", "left_semi")
    base = render.prologue(options.thinking)[1]
    plans = checkpoint(pack.packed(pack.per_record(render.lengths(good)), options.max_len, options.overlength, base))
    cap = options.max_len if options.overlength == "truncate" else None
    built = checkpoint(pack.assembled(pack.samples(plans, base), render.tokenized(good), cap).withColumn("reason", verify.sample_reason()))
    tell = lambda df, kind, key: df.groupBy(key.cast("string").alias("key")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "key", "n")
    skipped = why.select("reason").unionByName(plans.select("reason")).where("reason IS NOT NULL")
    counts = tell(records, "lines", F.when(F.col("messages").isNull(), "unparseable").otherwise("parsed"))
    counts = counts.unionByName(tell(skipped, "reason", F.col("reason"))).unionByName(tell(built, "samples", F.coalesce("reason", F.lit("written"))))
    return built.where("reason IS NULL").drop("reason"), counts
