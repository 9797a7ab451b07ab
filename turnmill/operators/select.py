"""Which records are used: prompt groups, seeded caps, a held-out head that shares no prompt with the rest, order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import prompt_key, seeded
from ..session import global_rank


def index(messages: DataFrame) -> DataFrame:
    """(rec_id, prompt_key, n_messages) from a message table; the key is of the first user message, untrimmed."""
    first = F.min(F.when(F.col("role") == "user", F.struct("msg_idx", "content")))["content"]
    return messages.groupBy("rec_id").agg(prompt_key(first).alias("prompt_key"), F.count("*").cast("int").alias("n_messages"))


def groups(records: DataFrame) -> DataFrame:
    """(prompt_key, n_records) of readable records."""
    return records.where("n_messages >= 0").groupBy("prompt_key").agg(F.count("*").alias("n_records"))


def capped(records: DataFrame, per_prompt: int, seed: int = 1234) -> DataFrame:
    """At most ``per_prompt`` records of each group, sampled by a seeded hash and not by their order (0: all).

    Groups are cut by rank on the group's key; the window keeps only ``per_prompt`` rows of a group in each task before
    the shuffle, so a hot prompt stays small.
    """
    records = records.where("n_messages >= 0")
    if not per_prompt:
        return records
    w = Window.partitionBy("prompt_key").orderBy(seeded(seed, "prompt_key", "rec_id"), "rec_id")
    return records.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= per_prompt).drop("__rn")


def heads(records: DataFrame, size: int, seed: int = 1234) -> DataFrame:
    """The held-out records: whole groups in seeded order until ``size`` are taken, the last one cut.

    Every group has a record, so the first ``size`` groups suffice; only their keys are ranked. Each task keeps ``size`` records of a
    group at most before the shuffle (a rank below a constant makes the limit of a window's group), so a prompt that half of all
    records share stays small.
    """
    if not size:
        return records.limit(0).withColumn("head_pos", F.lit(0).cast("long"))
    by_group = records.groupBy("prompt_key").agg(F.count("*").alias("n"))
    first = by_group.orderBy(seeded(seed, "prompt_key"), "prompt_key").limit(size)
    order = Window.orderBy(seeded(seed, "prompt_key"), "prompt_key").rowsBetween(Window.unboundedPreceding, -1)
    prior = first.withColumn("prior", F.coalesce(F.sum("n").over(order), F.lit(0))).where(F.col("prior") < size).select("prompt_key", "prior")
    inside = Window.partitionBy("prompt_key").orderBy("rec_id")
    taken = records.join(F.broadcast(prior), "prompt_key").withColumn("__i", F.row_number().over(inside)).where(F.col("__i") <= size)
    return taken.withColumn("head_pos", (F.col("prior") + F.col("__i") - 1).cast("long")).where(F.col("head_pos") < size).drop("prior", "__i")


def holdout(records: DataFrame, size: int = 64, seed: int = 1234) -> DataFrame:
    """``records`` with ``split``: head, tail, or dropped (the rest of a group that the head has cut)."""
    head = heads(records, size, seed)
    keys = head.select("prompt_key").distinct().withColumn("__in", F.lit(True))
    return (
        records.join(F.broadcast(head.select("rec_id", "head_pos")), "rec_id", "left")
        .join(F.broadcast(keys), "prompt_key", "left")
        .withColumn("split", F.when(F.col("head_pos").isNotNull(), "head").when(F.col("__in"), "dropped").otherwise("tail"))
        .drop("__in")
    )


def ordered(split: DataFrame, seed: int = 1234, limit: int = 0) -> DataFrame:
    """(rec_id, prompt_key, split, pos): the head in its order, then the tail shuffled by a seeded hash."""
    rows = split.where("split <> 'dropped'").withColumn("__k", F.when(F.col("split") == "head", F.lit("")).otherwise(seeded(seed, F.lit("tail"), F.col("rec_id"))))
    rows = rows.withColumn("__h", F.coalesce("head_pos", F.lit(1 << 62))).select("rec_id", "prompt_key", "split", "__h", "__k")
    out = global_rank(rows, "__h", "__k", "rec_id").drop("__h", "__k")
    return out.where(F.col("pos") < limit) if limit else out


def leaks(split: DataFrame) -> DataFrame:
    """Prompt keys in both head and tail; there must be none."""
    return split.where("split = 'head'").select("prompt_key").intersect(split.where("split = 'tail'").select("prompt_key"))


def shards(order: DataFrame, n_shards: int) -> DataFrame:
    """``order`` with ``shard``: contiguous runs of ceil(n / shards) records; the last ones may be short or missing."""
    n = order.agg(F.count("*").alias("__n"))
    per = F.greatest(F.ceil(F.col("__n") / n_shards), F.lit(1))
    return order.join(F.broadcast(n)).withColumn("shard", F.floor(F.col("pos") / per).cast("long")).drop("__n")


def strided(order: DataFrame, size: int) -> DataFrame:
    """Every step-th record, at most ``size``, for verification."""
    n = order.agg(F.count("*").alias("__n"))
    step = F.greatest(F.lit(1).cast("long"), F.floor(F.col("__n") / size))
    x = order.join(F.broadcast(n)).withColumn("__s", step)
    return x.where((F.col("pos") % F.col("__s") == 0) & (F.floor(F.col("pos") / F.col("__s")) < size)).drop("__n", "__s")
