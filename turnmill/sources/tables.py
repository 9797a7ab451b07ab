"""The driver's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as a message table."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("rec_id"), F.col("turn").alias("msg_idx"), "role", F.col("text").alias("content"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as one-message records: copies of a text make prompt groups with several members."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rec_id"), F.lit(0).cast("long").alias("msg_idx"), F.lit("user").alias("role"), F.col("text").alias("content"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as metrics: a user is a run, its events in time are steps."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").where("value IS NOT NULL")
    return e.select(F.col("user_id").alias("run"), (F.row_number().over(w) - 1).cast("long").alias("step"), F.col("value").alias("loss"))
