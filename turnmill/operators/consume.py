"""What a trainer does with samples: evaluation prefix, length buckets, shards, padding, schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import seeded
from ..functions.tokens import IGNORE
from ..session import global_rank


def n_eval(n: int, frac: float = 0.15, cap: int = 64) -> int:
    """Samples of the evaluation prefix: at least one if there are over four, at most ``cap`` (0: no cap)."""
    k = max(1, int(n * frac)) if n > 4 else 0
    return min(k, cap) if cap else k


def eval_prefix(ranked: DataFrame, frac: float = 0.15, cap: int = 64) -> DataFrame:
    """``ranked`` (with ``pos``) with ``part``: eval or train. The size is one aggregate, joined back."""
    k = F.when(F.col("__n") > 4, F.greatest(F.lit(1).cast("long"), F.floor(F.col("__n") * F.lit(frac)))).otherwise(F.lit(0))
    k = F.least(k, F.lit(cap)) if cap else k
    return ranked.join(F.broadcast(ranked.agg(F.count("*").alias("__n")))).withColumn("part", F.when(F.col("pos") < k, "eval").otherwise("train")).drop("__n")


def length_buckets(samples: DataFrame, workers: int, seed: int = 1234, length: str = "n_tok", key: str = "sample_no") -> DataFrame:
    """(key, length, block, rank, step): blocks of ``workers`` samples of like length, shuffled; each worker gets one of each.

    The samples are in stable order of length; the last n % workers, the longest, have no block and are left out.
    """
    pos = global_rank(samples.select(F.col(key), F.col(length)), length, key, name="__pos")
    n = pos.agg(F.count("*").alias("__n"))
    x = pos.join(F.broadcast(n)).withColumn("block", F.floor(F.col("__pos") / workers)).withColumn("rank", F.col("__pos") % workers)
    x = x.where(F.col("block") < F.floor(F.col("__n") / workers)).drop("__pos", "__n")
    order = global_rank(x.select("block").distinct().withColumn("__k", seeded(seed, "block")), "__k", "block", name="step").select("block", "step")
    return x.join(order, "block").select(key, length, "block", "rank", "step")


def strided_shards(ranked: DataFrame, workers: int) -> DataFrame:
    return ranked.withColumn("rank", F.pmod(F.col("pos"), F.lit(workers)))


def coverage(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """Samples of each rank, their sum and whether it is what was expected (a count)."""
    per = ranked.groupBy("rank").agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n").alias("total")).join(F.broadcast(expected.agg(F.count("*").alias("expected"))))
    return per.join(F.broadcast(total)).withColumn("ok", F.col("total") == F.col("expected"))


def padded(samples: DataFrame, pad: int = 0) -> DataFrame:
    """Rectangles: ``ids``, ``lab`` and ``att`` of each sample, as long as the longest of its ``batch``."""
    longest = samples.groupBy("batch").agg(F.max(F.size("input_ids")).alias("width"))
    x = samples.join(longest, "batch")
    more = F.col("width") - F.size("input_ids")
    return x.select(
        "*", F.concat("input_ids", F.array_repeat(F.lit(pad).cast("bigint"), more)).alias("ids"), F.concat("labels", F.array_repeat(F.lit(IGNORE).cast("bigint"), more)).alias("lab"),
        F.concat(F.array_repeat(F.lit(1), F.size("input_ids")), F.array_repeat(F.lit(0), more)).alias("att"),
    )


def truncated(samples: DataFrame, cap: int) -> DataFrame:
    """The consumer's reader: both arrays cut to ``cap``, samples without a scored label left out."""
    x = samples.withColumn("input_ids", F.slice("input_ids", 1, cap)).withColumn("labels", F.slice("labels", 1, cap))
    return x.where(F.exists("labels", lambda v: v != IGNORE))


def shifted(labels: Column) -> Column:
    """Targets: position t predicts label t + 1."""
    return F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0)))


def longest(samples: DataFrame, cap: int, length: str = "n_tok", key: str = "sample_no") -> DataFrame:
    """The longest sample of at most ``cap`` tokens; of several the first."""
    return samples.where(F.col(length) <= cap).orderBy(F.col(length).desc(), key).limit(1)


def sweep(lengths: Column, best: Column) -> Column:
    """Sorted distinct lengths, none above the best."""
    return F.array_sort(F.array_distinct(F.transform(lengths, lambda x: F.least(x, best))))


def dealt(train: DataFrame, workers: int, bucketed: bool = True, seed: int = 1234) -> DataFrame:
    """(sample_no, n_tok, rank, seq) of (pos, sample_no, n_tok): each worker's samples in its order; by length buckets, or every
    ``workers``-th one. Buckets leave out the last n % workers, the longest."""
    if bucketed:
        return length_buckets(train, workers, seed).select("sample_no", "n_tok", "rank", F.col("step").alias("seq"))
    return strided_shards(train, workers).select("sample_no", "n_tok", F.col("rank").cast("long").alias("rank"), F.floor(F.col("pos") / workers).alias("seq"))


def cyclic(ranked: DataFrame, steps: int, accum: int) -> DataFrame:
    """(step, micro, rank, sample_no, n_tok): micro-step m of step s takes a worker's sample (s * accum + m) mod n, n being how many it has.

    ``ranked``: (sample_no, n_tok, rank, seq). The steps are thin and meet the samples in one join on (rank, seq).
    """
    spark = ranked.sparkSession
    per = ranked.groupBy("rank").agg(F.count("*").alias("__n"))  # one row a worker
    x = spark.range(steps * accum).select(F.floor(F.col("id") / accum).alias("step"), F.pmod("id", F.lit(accum)).alias("micro"), F.col("id").alias("__u"))
    due = x.join(F.broadcast(per)).withColumn("seq", F.pmod("__u", F.col("__n")))
    return due.join(ranked, ["rank", "seq"]).select("step", "micro", "rank", "sample_no", "n_tok")


def warm_up(step: Column, steps: int, lr: float) -> Column:
    """Learning rate: linear over the first tenth, then flat."""
    return F.lit(lr) * F.least(F.lit(1.0), (step + 1) / F.lit(float(max(1, int(0.1 * steps)))))


def mean_loss(losses: DataFrame, value: str = "loss") -> DataFrame:
    """Unweighted mean over samples; 0 for none. Decimal sums, so the order of rows doesn't show."""
    return losses.agg((F.coalesce(F.sum(F.col(value).cast("decimal(28,9)")), F.lit(0)).cast("double") / F.greatest(F.count(value), F.lit(1))).alias("mean_loss"), F.count(value).alias("n"))
