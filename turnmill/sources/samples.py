"""Packed samples and manifests: ordered shards of compact JSON lines, signatures for resuming, one-row reports."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint

SAMPLE = "input_ids array<bigint>, labels array<bigint>"
#: Long rows of a shard's summary: counts by kind and key, so shards of several runs merge by addition.
SUMMARY = "kind string, key string, n bigint, shard bigint"


def blocks(thin: DataFrame, room: int) -> DataFrame:
    """``thin`` (shard, pos, piece_no, n_tok) with ``block``: runs of about ``room`` tokens inside each shard, numbered through all
    shards in order. A run is longer only by its last sample."""
    before = Window.partitionBy("shard").orderBy("pos", "piece_no").rowsBetween(Window.unboundedPreceding, -1)
    x = checkpoint(thin.withColumn("__k", F.floor(F.coalesce(F.sum("n_tok").over(before), F.lit(0)) / room)))
    k = x.select("shard", "__k").distinct()  # one row a file
    number = k.withColumn("block", (F.row_number().over(Window.orderBy("shard", "__k")) - 1).cast("int"))
    return x.join(F.broadcast(number), ["shard", "__k"]).drop("__k")


def write(samples: DataFrame, path: str, only: list[int] | None = None, room: int = 64 << 20) -> None:
    """Rows (shard, pos, piece_no, input_ids, labels) as ``shard=N`` folders, each in order; ``only`` replaces those shards.

    A file has about ``room`` tokens at most, whatever the shard has, so no task writes more; files of a shard are in the order of
    their names. Shards of ``only`` that have no row any more, and with ``only`` unset all earlier ones, are removed.
    """
    spark = samples.sparkSession
    rows = samples.where(F.col("shard").isin(only)) if only is not None else samples
    thin = blocks(rows.select("shard", "pos", "piece_no", F.size("input_ids").cast("long").alias("n_tok")), room)
    n = (thin.agg(F.max("block")).first()[0] or 0) + 1
    drop_shards(spark, path, None if only is None else set(only))
    rows = rows.join(thin.select("shard", "pos", "piece_no", "block"), ["shard", "pos", "piece_no"]).repartitionById(n, F.col("block")).sortWithinPartitions("shard", "pos", "piece_no")
    lines = rows.select("shard", F.to_json(F.struct("input_ids", "labels")).alias("value"))
    lines.write.mode("append" if only is not None else "overwrite").partitionBy("shard").text(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_shards(spark: SparkSession, path: str, only: set[int] | None = None, beyond: int | None = None) -> None:
    """Delete the folders of some shards, of all, or of those from ``beyond`` on."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in fs.listStatus(root) if fs.exists(root) else ():
        name = f.getPath().getName()
        if name.startswith("shard=") and (n := int(name[6:])) >= (beyond or 0) and (only is None or n in only):
            fs.delete(f.getPath(), True)


def merge(spark: SparkSession, path: str, out: str) -> int:
    """All shards as one file, in order; the number of lines. One task writes it, so only where a single file is asked for."""
    rows = spark.read.text(path).select("shard", "value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    rows.repartition(1).sortWithinPartitions("shard", "f", "b", "m").select("value").write.mode("overwrite").text(out)
    return spark.read.text(out).count()


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SAMPLE + ", shard bigint").json(path)


def signature(*parts: object) -> str:
    """Of a run's options, tokenizer and template: shards of another signature aren't reused."""
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:16]


def plan_signatures(order: DataFrame, base: str) -> DataFrame:
    """(shard, signature) of (shard, pos, rec_id, split, digest): the base, and places, split and content of the shard's records."""
    sums = (F.sum(F.xxhash64("rec_id", "pos", "split", "digest", F.lit(k)).cast("decimal(38,0)")).cast("string") for k in (1, 2))
    return order.groupBy("shard").agg(F.concat_ws(":", F.lit(base), F.col("shard").cast("string"), F.count("*").cast("string"), *sums).alias("signature"))


def done(spark: SparkSession, path: str) -> DataFrame | None:
    """(shard, signature) of the shards that a run has finished: an earlier run's, if its summary is there as well."""
    from pyspark.errors import AnalysisException

    try:
        known = spark.read.schema("shard bigint, signature string").json(f"{path}.done")
        return known.join(summary(spark, path).select("shard").distinct(), "shard", "left_semi")
    except AnalysisException:
        return None


def write_done(spark: SparkSession, signatures: DataFrame | None, path: str) -> None:
    """The finished shards; none: as if there had been no run."""
    if signatures is None:
        discard(spark, f"{path}.done")
    else:
        signatures.coalesce(1).write.mode("overwrite").json(f"{path}.done")


def summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SUMMARY).parquet(f"{path}.summary")


def write_summary(rows: DataFrame, path: str, only: list[int] | None = None) -> None:
    """Counts (shard, kind, key, n) beside the shards; ``only`` replaces those of some shards, which all have rows."""
    drop_shards(rows.sparkSession, f"{path}.summary", None if only is None else set(only))
    rows.select("kind", "key", "n", "shard").repartition("shard").write.mode("append" if only is not None else "overwrite").partitionBy("shard").parquet(f"{path}.summary")


def write_rejected(rows: DataFrame, path: str, only: list[int] | None = None) -> None:
    """Samples that a check rejected (shard, rec_id, piece_no, reason, input_ids, labels), beside the others."""
    drop_shards(rows.sparkSession, f"{path}.rejected", None if only is None else set(only))
    rows.select("rec_id", "piece_no", "reason", "input_ids", "labels", "shard").write.mode("append" if only is not None else "overwrite").partitionBy("shard").parquet(f"{path}.rejected")


def rejected(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("rec_id bigint, piece_no int, reason string, input_ids array<bigint>, labels array<bigint>, shard bigint").parquet(f"{path}.rejected")


def write_manifest(spark: SparkSession, manifest: dict, path: str) -> None:
    """One JSON document as a folder with a single part, by Spark's commit."""
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def content_digest(lines: DataFrame) -> str:
    """A digest of (rec_id, digest), a source's lines and their places: one partial aggregate, for files of any size."""
    r = lines.agg(F.count("*"), *(F.coalesce(F.sum(F.xxhash64("rec_id", "digest", F.lit(k)).cast("decimal(38,0)")), F.lit(0)).cast("string") for k in (1, 2))).first()
    return hashlib.sha256("|".join(map(str, r)).encode()).hexdigest()
