"""Exact order statistics by the rule sorted[min(n - 1, int(n * p))], and length reports, from value counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

POINTS = {"p01": 0.01, "p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95, "p99": 0.99}
THRESHOLDS = (2048, 4096, 8192, 16384, 24576, 32768, 65536, 131072)


def occurrences(weight: str | None) -> F.Column:
    return F.sum(weight) if weight else F.count("*")


def value_counts(df: DataFrame, value: str, weight: str | None = None) -> DataFrame:
    """How often each value occurs, and how many are less. A window over distinct values, not over rows; rows that are counts
    themselves have a ``weight``."""
    n = df.groupBy(F.col(value).cast("long").alias("v")).agg(occurrences(weight).alias("c"))
    w = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    return n.withColumn("below", F.coalesce(F.sum("c").over(w), F.lit(0)))


def distribution(df: DataFrame, value: str, weight: str | None = None) -> DataFrame:
    """One row: n, total_tokens, mean (integer), exact quantiles, max; zeros for an empty table."""
    counts = value_counts(df, value, weight)
    whole = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("v") * F.col("c")), F.lit(0)).alias("total"), F.coalesce(F.max("v"), F.lit(0)).alias("max"))
    both = counts.join(F.broadcast(whole), how="right")

    def at(p: float) -> F.Column:
        k = F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(p)))
        return F.coalesce(F.max(F.when((F.col("below") <= k) & (k < F.col("below") + F.col("c")), F.col("v"))), F.lit(0))

    n, total = F.max("n"), F.max("total")
    return both.agg(
        n.alias("n"), total.alias("total_tokens"), F.when(n > 0, F.floor(total / n)).otherwise(0).cast("long").alias("mean"),
        *(at(p).alias(name) for name, p in POINTS.items()), F.max("max").alias("max"),
    )


def thresholds(df: DataFrame, value: str, cuts: tuple[int, ...] = THRESHOLDS, weight: str | None = None) -> DataFrame:
    """Per cut: records over it (strictly) and their share, tokens if records were capped, and the share kept."""
    counts = df.groupBy(F.col(value).cast("long").alias("v")).agg(occurrences(weight).alias("c"))
    cells = []
    for t in cuts:
        cells.append(F.struct(F.lit(t).cast("long").alias("threshold"), F.coalesce(F.sum(F.when(F.col("v") > t, F.col("c")).otherwise(0)), F.lit(0)).alias("over"), F.coalesce(F.sum(F.least(F.col("v"), F.lit(t)) * F.col("c")), F.lit(0)).alias("kept")))
    one = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("v") * F.col("c")), F.lit(0)).alias("total"), F.array(*cells).alias("cells"))
    x = one.select("n", "total", F.explode("cells").alias("x"))
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6)).otherwise(F.lit(0.0))
    return x.select(
        "x.threshold", F.col("x.over").alias("records_over"), share("x.over", "n").alias("frac_records_over"),
        F.col("x.kept").alias("tokens_if_capped"), share("x.kept", "total").alias("frac_tokens_kept_if_capped"),
    )


def bit_length(n: F.Column) -> F.Column:
    """Bits of a non-negative integer; 0 has none."""
    return F.when(n == 0, F.lit(0)).otherwise(F.length(F.bin(n)))
