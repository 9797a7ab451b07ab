"""Sessions, the shared folder, and the global rank that several operators need."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def session(master: str = "local[*]", app: str = "turnmill", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; ``conf`` keys have dots as underscores doubled (``a__b``)."""
    b = SparkSession.builder.master(master).appName(app)
    for k, v in {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false"}.items():
        b = b.config(k, v)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in ``spark.checkpoint.dir``; in a folder of our own only where that is unset."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is unset: it must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="turnmill-"))
    return df.checkpoint(eager=True)


def global_rank(df: DataFrame, *order: str, name: str = "pos") -> DataFrame:
    """``df`` with its position (from 0) in the order of some columns, without bringing all rows into one task.

    Rows are dealt by range and sorted there; positions add up from the partitions' sizes, one row each. The dealt rows go
    to the shared folder first, so that both passes see the same partitions. Pass thin tables and join back.
    """
    dealt = checkpoint(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__row", F.monotonically_increasing_id()))
    part, row = F.shiftright("__row", 33), F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))
    size = dealt.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = size.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return dealt.withColumn("__part", part).withColumn("__at", row).join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__at")).drop("__part", "__row", "__at", "__before")
