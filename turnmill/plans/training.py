"""A planning run: which samples a training run evaluates on, which worker takes which at every step, at which rate."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import consume, metrics, verify
from ..options import PlanOptions
from ..session import checkpoint, global_rank
from ..sources import samples
from .conversations import CAP, NO, SEED, numbered, query


@dataclass(frozen=True)
class Plan:
    """``placed``: each sample's part (eval, train, left_out), worker and place in its list; ``steps``: each step's samples;
    ``rates``: each step's rate, logged rate and tokens."""

    placed: DataFrame
    steps: DataFrame
    rates: DataFrame


def plan(rows: DataFrame, workers: int, options: PlanOptions = PlanOptions()) -> Plan:
    """The plan of samples (sample_no, n_tok), numbered from 0 in the order of their file.

    Samples are read up to ``max_len`` tokens; the first ones are for evaluation, dealt to workers by turns; the rest are dealt by length
    buckets, which leave the longest n % workers out, or by turns.
    """
    read = rows.select("sample_no", F.col("n_tok").alias("raw_tok"), F.least("n_tok", F.lit(options.max_len)).cast("long").alias("n_tok"), F.col("sample_no").alias("pos"))
    parts = checkpoint(consume.eval_prefix(read, options.eval_frac, options.eval_max))
    train, held = parts.where("part = 'train'"), parts.where("part = 'eval'")
    first = train.agg(F.min("pos").alias("__first"))
    ordered = train.join(F.broadcast(first)).withColumn("pos", F.col("pos") - F.col("__first")).drop("__first")
    ranked = checkpoint(consume.dealt(ordered, workers, options.length_bucketed, options.bucket_seed))
    taken = ranked.unionByName(consume.dealt(held, workers, bucketed=False)).select("sample_no", "rank", "seq")
    placed = parts.join(taken, "sample_no", "left")
    part = F.when(F.col("rank").isNull(), "left_out").otherwise(F.col("part"))
    placed = placed.select("sample_no", "n_tok", (F.col("raw_tok") > options.max_len).alias("truncated"), part.alias("part"), "rank", "seq")
    steps = consume.cyclic(ranked, options.steps, options.accum)
    rate = lambda step: consume.warm_up(step, options.steps, options.lr)
    sums = steps.groupBy("step").agg(F.count("*").alias("n_samples"), F.sum("n_tok").alias("tokens"), F.max("n_tok").alias("longest"))
    rates = sums.select("step", rate(F.col("step")).alias("lr"), metrics.logged_rate(F.col("step"), rate).alias("logged_lr"), "n_samples", "tokens", "longest")
    return Plan(placed, steps, rates)


def report(placed: DataFrame) -> DataFrame:
    """One row: samples by part, how many were cut, and the numbers of those left out (fewer than there are workers)."""
    out = F.sort_array(F.collect_list(F.when(F.col("part") == "left_out", F.col("sample_no"))))
    count = lambda p: F.count_if(F.col("part") == p)
    return placed.agg(F.count("*").alias("samples"), count("eval").alias("n_eval"), count("train").alias("n_train"), F.count_if("truncated").alias("truncated"), out.alias("left_out"))


def run(spark: SparkSession, packed: str, out: str, workers: int, options: PlanOptions = PlanOptions()) -> dict:
    """Plan the samples of a packing run: tables ``placed``, ``steps`` and ``rates`` under ``out`` and a report.

    The run's manifest is looked at first: its prompts must not be on both sides, and the evaluation prefix must fit in its held-out head.
    """
    manifest = samples.read_manifest(spark, f"{packed}.manifest")
    if not verify.manifest_ok(manifest["overlap"], options.eval_max, manifest["options"]["holdout_head"]):
        raise ValueError("the evaluation set doesn't fit in the held-out head, or prompts overlap")
    rows = samples.read(spark, packed).select("shard", F.size("input_ids").cast("long").alias("n_tok"), F.exists(F.slice("labels", 1, options.max_len), lambda x: x != -100).alias("scores"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"))
    rows = rows.withColumn("m", F.monotonically_increasing_id())
    unscored = rows.where("NOT scores").count()
    made = plan(global_rank(rows.where("scores").drop("scores"), "shard", "f", "b", "m", name="sample_no"), workers, options)
    for name in ("placed", "steps", "rates"):
        getattr(made, name).write.mode("overwrite").parquet(f"{out}/{name}")
    facts = report(spark.read.parquet(f"{out}/placed")).first().asDict() | {"unscored": unscored, "workers": workers, "options": asdict(options)}
    if facts["n_train"] < options.min_samples:
        raise ValueError(f"{facts['n_train']} samples to train on, fewer than {options.min_samples}")
    samples.write_manifest(spark, facts, f"{out}/report")
    return facts


# ------------------------------------------------------------------ queries
WORKERS = 4
OPTIONS = PlanOptions(max_len=CAP, steps=120, accum=3, bucket_seed=SEED)
PLAN = f"""{NO},
part AS (SELECT sample_no, least(n_tok, {CAP}) AS n_tok, n_tok > {CAP} AS truncated,
  sample_no < (SELECT CASE WHEN count(*) > 4 THEN least(greatest(1, CAST(floor(count(*) * 0.15::DOUBLE) AS BIGINT)), 64) ELSE 0 END FROM s) AS held FROM s),
b AS (SELECT *, row_number() OVER (ORDER BY n_tok, sample_no) - 1 AS p, count(*) OVER () AS n FROM part WHERE NOT held),
k AS (SELECT sample_no, n_tok, p // {WORKERS} AS block, p % {WORKERS} AS rank FROM b WHERE p // {WORKERS} < n // {WORKERS}),
o AS (SELECT block, row_number() OVER (ORDER BY md5('{SEED}:' || block), block) - 1 AS seq FROM (SELECT DISTINCT block FROM k)),
ranked AS (SELECT sample_no, n_tok, rank, seq FROM k JOIN o USING (block)),
taken AS (SELECT sample_no, rank, seq FROM ranked UNION ALL SELECT sample_no, sample_no % {WORKERS}, sample_no // {WORKERS} FROM part WHERE held),
placed AS (SELECT sample_no, CAST(n_tok AS BIGINT) AS n_tok, truncated, CASE WHEN rank IS NULL THEN 'left_out' WHEN held THEN 'eval' ELSE 'train' END AS part, rank, seq FROM part LEFT JOIN taken USING (sample_no)),
due AS (SELECT u // {OPTIONS.accum} AS step, u % {OPTIONS.accum} AS micro, rank, u % n AS seq FROM range({OPTIONS.steps * OPTIONS.accum}) r(u), (SELECT rank, count(*) AS n FROM ranked GROUP BY rank)),
steps AS (SELECT step, micro, rank, sample_no, CAST(n_tok AS BIGINT) AS n_tok FROM due JOIN ranked USING (rank, seq))"""


def conversation_plan(spark: SparkSession, sf_dir: str) -> Plan:
    return plan(numbered(spark, sf_dir), WORKERS, OPTIONS)


@query(f"{PLAN} SELECT sample_no, n_tok, truncated, part, rank, seq FROM placed")
def training_plan(spark, sf_dir):
    return conversation_plan(spark, sf_dir).placed


@query(f"{PLAN} SELECT count(*) AS samples, count(*) FILTER (part = 'eval') AS n_eval, count(*) FILTER (part = 'train') AS n_train, count(*) FILTER (truncated) AS truncated, coalesce(string_agg(sample_no::VARCHAR, ',' ORDER BY sample_no) FILTER (part = 'left_out'), '') AS left_out FROM placed")
def plan_report(spark, sf_dir):
    return report(conversation_plan(spark, sf_dir).placed).withColumn("left_out", F.array_join(F.col("left_out").cast("array<string>"), ","))


@query(f"{PLAN} SELECT step, micro, rank, sample_no, n_tok FROM steps")
def cyclic_schedule(spark, sf_dir):
    return conversation_plan(spark, sf_dir).steps


@query(f"""{PLAN} SELECT step, {OPTIONS.lr}::DOUBLE * least(1.0::DOUBLE, (step + 1) / {max(1, OPTIONS.steps // 10)}.0::DOUBLE) AS lr, {OPTIONS.lr}::DOUBLE * least(1.0::DOUBLE, (step + 2) / {max(1, OPTIONS.steps // 10)}.0::DOUBLE) AS logged_lr,
  count(*) AS n_samples, CAST(sum(n_tok) AS BIGINT) AS tokens, max(n_tok) AS longest FROM steps GROUP BY step""")
def lr_schedule(spark, sf_dir):
    return conversation_plan(spark, sf_dir).rates
