"""Step and evaluation metrics of runs: (run, step, value), every window inside one run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_best(evals: DataFrame, value: str = "loss") -> DataFrame:
    """``best`` so far at each evaluation, and whether it is new (strictly less than all before)."""
    w = Window.partitionBy("run").orderBy("step")
    before = F.min(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return evals.withColumn("best", F.min(value).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("is_best", before.isNull() | (F.col(value) < before))


def strikes(evals: DataFrame, delta: float, value: str = "loss") -> DataFrame:
    """``strikes`` at each evaluation: the length of the trailing run above the best so far by more than ``delta``.

    The best is that of the evaluation at hand, so earlier ones are judged anew. It only falls, and where it falls the
    evaluation itself is no strike: so the last place without one is a running maximum, and two windows do.
    """
    w = Window.partitionBy("run").orderBy("step")
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    x = evals.withColumn("__n", F.row_number().over(w)).withColumn("best", F.min(value).over(up_to))
    last = F.max(F.when(F.col(value) <= F.col("best") + delta, F.col("__n"))).over(up_to)
    return x.withColumn("strikes", (F.col("__n") - F.coalesce(last, F.lit(0))).cast("long")).drop("__n")


def memory_fit(points: DataFrame, length: str, used: str) -> DataFrame:
    """One row: ``slope``, ``intercept`` and ``n`` of the least-squares line of memory over length; null without two lengths."""
    return points.agg(F.regr_slope(used, length).alias("slope"), F.regr_intercept(used, length).alias("intercept"), F.regr_count(used, length).alias("n"))


def early_stop(evals: DataFrame, delta: float = 0.0018, patience: int = 3, value: str = "loss") -> DataFrame:
    """(run, stop_step): the first evaluation with ``patience`` strikes; null if none."""
    x = strikes(evals, delta, value)
    return x.groupBy("run").agg(F.min(F.when(F.col("strikes") >= patience, F.col("step"))).alias("stop_step"))


def upper_median(df: DataFrame, value: str, name: str) -> DataFrame:
    """(run, name): sorted[n // 2], by rank within the run."""
    w = Window.partitionBy("run").orderBy(value)
    x = df.withColumn("__rn", F.row_number().over(w)).withColumn("__n", F.count("*").over(Window.partitionBy("run")))
    return x.where(F.col("__rn") == F.floor(F.col("__n") / 2) + 1).select("run", F.col(value).alias(name))


def throughput(steps: DataFrame, seconds: str = "sec", tokens: str = "tok") -> DataFrame:
    """(run, med_sec, med_tok, tok_per_s): the ratio of the medians."""
    x = upper_median(steps, seconds, "med_sec").join(upper_median(steps, tokens, "med_tok"), "run")
    return x.withColumn("tok_per_s", F.col("med_tok") / F.greatest(F.col("med_sec"), F.lit(1e-9)))


def loss_ends(steps: DataFrame, value: str = "loss", k: int = 3) -> DataFrame:
    """(run, first3, last3, delta, decreased): means of the first and last ``k`` losses."""
    up, down = Window.partitionBy("run").orderBy("step"), Window.partitionBy("run").orderBy(F.col("step").desc())
    x = steps.withColumn("__a", F.row_number().over(up)).withColumn("__z", F.row_number().over(down))
    mean = lambda c: F.sum(F.when(F.col(c) <= k, F.col(value).cast("decimal(28,9)"))).cast("double") / F.count_if(F.col(c) <= k)
    y = x.groupBy("run").agg(mean("__a").alias("first3"), mean("__z").alias("last3"))
    return y.withColumn("delta", F.col("last3") - F.col("first3")).withColumn("decreased", F.col("last3") < F.col("first3"))


def eval_summary(evals: DataFrame, tolerance: float = 0.02, value: str = "loss") -> DataFrame:
    """(run, n_evals, eval_min, best_step, eval_decreased, overfit); of equal minima the first. Null verdicts under two evaluations."""
    x = evals.groupBy("run").agg(
        F.count("*").alias("n_evals"), F.min(value).alias("eval_min"), F.min(F.struct(value, "step"))["step"].alias("best_step"),
        F.min_by(value, "step").alias("__first"), F.max_by(value, "step").alias("__last"),
    )
    two = F.col("n_evals") >= 2
    return x.withColumn("eval_decreased", F.when(two, F.col("__last") < F.col("__first"))).withColumn("overfit", F.when(two, F.col("__last") > F.col("eval_min") * (1 + tolerance))).drop("__first", "__last")


def cumulative(steps: DataFrame, seconds: str = "sec") -> DataFrame:
    w = Window.partitionBy("run").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("cum_s", F.sum(F.col(seconds).cast("decimal(28,9)")).over(w).cast("double"))


def epochs(n_steps: F.Column, workers: int, accum: int, n_train: F.Column) -> F.Column:
    return F.round(n_steps * workers * accum / F.greatest(n_train, F.lit(1)), 2)


def verdict(ends: DataFrame, summary: DataFrame, sizes: DataFrame, min_samples: int = 8) -> DataFrame:
    """(run, enough, verdict): losses fell, held-out loss didn't rise, no overfitting, enough samples (run, n_train)."""
    x = ends.join(summary, "run", "left").join(sizes, "run", "left").withColumn("enough", F.coalesce(F.col("n_train") >= min_samples, F.lit(False)))
    ok = F.col("decreased") & F.coalesce("eval_decreased", F.lit(True)) & ~F.coalesce("overfit", F.lit(False)) & F.col("enough")
    return x.withColumn("verdict", F.when(ok, "SFT_DDP_OK").otherwise("SFT_DDP_SUSPECT"))


def complete(steps: DataFrame, planned: int, killed: str | None = None) -> DataFrame:
    """(run, rows, complete): as many step rows as planned, and no kill marker if there is such a column."""
    marker = F.coalesce(F.bool_or(killed), F.lit(False)) if killed else F.lit(False)
    x = steps.groupBy("run").agg(F.count("*").alias("rows"), marker.alias("__killed"))
    return x.withColumn("complete", (F.col("rows") == planned) & ~F.col("__killed")).drop("__killed")


def report(steps: DataFrame, evals: DataFrame, sizes: DataFrame, tolerance: float = 0.02, min_samples: int = 8) -> DataFrame:
    """(run, report): a JSON document a run with its losses and evaluations in order, their summaries and the verdict."""
    verdicts = verdict(loss_ends(steps), eval_summary(evals, tolerance), sizes, min_samples)
    losses = steps.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("step", "loss")))["loss"].alias("losses"))
    history = evals.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("step", F.col("loss").alias("eval_loss")))).alias("eval_hist"))
    x = verdicts.join(losses, "run").join(history, "run", "left")
    return x.select("run", F.to_json(F.struct(*[c for c in x.columns if c != "run"])).alias("report"))


def logged_rate(step: F.Column, rate) -> F.Column:
    """The rate that a step's row shows: the scheduler has moved on by then, so it is the next step's."""
    return rate(step + 1)
