"""Queries on metric series; ``events`` stand in, a user for a run."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import consume, metrics
from ..sources.tables import series, table
from .conversations import query

DELTA, PATIENCE = 0.5, 3
S = "s AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step, value AS loss FROM events WHERE value IS NOT NULL)"
STRIKES = f"""{S}, w AS (SELECT *, min(loss) OVER (PARTITION BY run ORDER BY step) AS best FROM s),
  k AS (SELECT w.run, w.step, w.loss, w.best, max(CASE WHEN p.loss <= w.best + {DELTA}::DOUBLE THEN p.step END) AS last FROM w JOIN s p ON p.run = w.run AND p.step <= w.step GROUP BY ALL)"""


def runs(spark, sf_dir):
    return series(spark, sf_dir).withColumn("sec", F.col("loss") / 2 + 1).withColumn("tok", (F.col("step") * 7 % 11 + 1) * 100)


@query(f"WITH {S} SELECT run, step, min(loss) OVER (PARTITION BY run ORDER BY step) AS best, coalesce(loss < min(loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best FROM s")
def running_best(spark, sf_dir):
    return metrics.running_best(series(spark, sf_dir)).select("run", "step", "best", "is_best")


@query(f"WITH {STRIKES} SELECT run, step, step - last AS strikes FROM k")
def strikes(spark, sf_dir):
    return metrics.strikes(series(spark, sf_dir), DELTA).select("run", "step", "strikes")


@query(f"WITH {STRIKES} SELECT run, min(step) FILTER (step - last >= {PATIENCE}) AS stop_step FROM k GROUP BY run")
def early_stop(spark, sf_dir):
    return metrics.early_stop(series(spark, sf_dir), DELTA, PATIENCE)


RUNS = f"{S}, r AS (SELECT *, loss / 2 + 1 AS sec, (step * 7 % 11 + 1) * 100 AS tok FROM s)"


@query(f"""WITH {RUNS}, a AS (SELECT run, list(sec ORDER BY sec) AS a, list(tok ORDER BY tok) AS b, count(*) AS n FROM r GROUP BY run)
  SELECT run, a[n // 2 + 1] AS med_sec, b[n // 2 + 1] AS med_tok, b[n // 2 + 1] / greatest(a[n // 2 + 1], 1e-9::DOUBLE) AS tok_per_s FROM a""")
def throughput_medians(spark, sf_dir):
    return metrics.throughput(runs(spark, sf_dir))


ENDS = f"""{S}, e AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step) AS a, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS z FROM s),
  ends AS (SELECT run, CAST(sum(loss::DECIMAL(28, 9)) FILTER (a <= 3) AS DOUBLE) / count(*) FILTER (a <= 3) AS first3, CAST(sum(loss::DECIMAL(28, 9)) FILTER (z <= 3) AS DOUBLE) / count(*) FILTER (z <= 3) AS last3 FROM e GROUP BY run)"""


@query(f"WITH {ENDS} SELECT *, last3 - first3 AS delta, last3 < first3 AS decreased FROM ends")
def loss_ends(spark, sf_dir):
    return metrics.loss_ends(series(spark, sf_dir))


SUMMARY = """sm AS (SELECT run, count(*) AS n_evals, min(loss) AS eval_min, (min({'l': loss, 's': step})).s AS best_step, CASE WHEN count(*) >= 2 THEN arg_max(loss, step) < arg_min(loss, step) END AS eval_decreased,
  CASE WHEN count(*) >= 2 THEN arg_max(loss, step) > min(loss) * 1.02::DOUBLE END AS overfit FROM s GROUP BY run)"""


@query(f"WITH {S}, {SUMMARY} SELECT * FROM sm")
def eval_summary(spark, sf_dir):
    return metrics.eval_summary(series(spark, sf_dir))


@query(f"""WITH {ENDS}, {SUMMARY} SELECT run, n_evals >= 8 AS enough, CASE WHEN last3 < first3 AND coalesce(eval_decreased, true) AND NOT coalesce(overfit, false) AND n_evals >= 8 THEN 'SFT_DDP_OK' ELSE 'SFT_DDP_SUSPECT' END AS verdict
  FROM ends JOIN sm USING (run)""")
def run_verdict(spark, sf_dir):
    s = series(spark, sf_dir)
    return metrics.verdict(metrics.loss_ends(s), metrics.eval_summary(s), s.groupBy("run").agg(F.count("*").alias("n_train"))).select("run", "enough", "verdict")


@query(f"WITH {RUNS} SELECT run, step, CAST(sum(sec::DECIMAL(28, 9)) OVER (PARTITION BY run ORDER BY step) AS DOUBLE) AS cum_s FROM r")
def cumulative_seconds(spark, sf_dir):
    return metrics.cumulative(runs(spark, sf_dir)).select("run", "step", "cum_s")


@query("SELECT CAST(coalesce(sum(value::DECIMAL(28, 9)), 0) AS DOUBLE) / greatest(count(value), 1) AS mean_loss, count(value) AS n FROM events")
def mean_loss(spark, sf_dir):
    return consume.mean_loss(series(spark, sf_dir))


@query(f"WITH {S} SELECT run, round(count(*) * 4 * 2 / greatest(count(DISTINCT step // 2), 1)::DOUBLE, 2) AS epochs FROM s GROUP BY run")
def run_epochs(spark, sf_dir):
    x = series(spark, sf_dir).groupBy("run").agg(F.count("*").alias("n"), F.countDistinct(F.floor(F.col("step") / 2)).alias("m"))
    return x.select("run", metrics.epochs(F.col("n"), 4, 2, F.col("m")).alias("epochs"))


@query(f"WITH {S} SELECT run, count(*) AS rows, count(*) = 20 AS complete FROM s GROUP BY run")
def run_complete(spark, sf_dir):
    return metrics.complete(series(spark, sf_dir), 20)


@query("SELECT round(regr_slope(value, length(event_type)), 6) AS slope, round(regr_intercept(value, length(event_type)), 6) AS intercept, CAST(regr_count(value, length(event_type)) AS BIGINT) AS n FROM events")
def memory_fit(spark, sf_dir):
    points = table(spark, sf_dir, "events").select("value", F.length("event_type").alias("length"))
    return metrics.memory_fit(points, "length", "value").select(F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"), "n")
