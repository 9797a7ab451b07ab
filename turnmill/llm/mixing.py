"""Mixing sources to target weights by Poisson replication, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, looked_up

#: Largest mean that one inversion handles; a larger one is a sum of independent equal parts, which is Poisson again.
PART = 8.0
#: Terms of the cumulative sum for a mean of at most ``PART``: what lies beyond has a chance under 1e-17.
TERMS = 48


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of the parts, the same in any engine."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson(u: Column, mean: Column) -> Column:
    """The Poisson quantile of ``u``: how many k have P(X <= k) <= u, for a mean of at most ``PART``."""
    # the state carries u: written into the step, its hash would be taken anew for each term
    zero = F.struct(F.lit(0).alias("k"), F.exp(-mean).alias("p"), F.exp(-mean).alias("cdf"), u.alias("u"))
    step = lambda a, k: F.when(a["cdf"] > a["u"], a).otherwise(
        F.struct(k.alias("k"), (a["p"] * mean / k).alias("p"), (a["cdf"] + a["p"] * mean / k).alias("cdf"), a["u"].alias("u"))
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), zero, step, lambda a: a["k"])


def rates(docs: DataFrame, weights: dict[str, float] | None, text: str, source: str) -> DataFrame:
    """Per source: its code points, and the mean number of copies that gives it its share of the whole's code points."""
    size = docs.groupBy(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("__source")).agg(F.sum(F.coalesce(F.length(text), F.lit(0)).cast("long")).alias("__size"))
    if weights is None:
        weight: Column = F.lit(1.0)
    else:
        table = F.create_map(*(x for k, v in sorted(weights.items()) for x in (F.lit(k), F.lit(float(v))))) if weights else F.create_map(F.lit(""), F.lit(0.0))
        weight = F.coalesce(table[F.col("__source")], F.lit(0.0))
    size = size.withColumn("__weight", F.when(F.col("__size") > 0, weight).otherwise(F.lit(0.0)))
    whole = size.agg(F.sum("__size").alias("__total"), F.sum(F.col("__weight").cast("decimal(38,12)")).cast("double").alias("__weights"))
    return size.join(F.broadcast(whole)).select(
        "__source", F.when(F.col("__size") > 0, F.col("__total") * F.col("__weight") / F.col("__weights") / F.col("__size")).otherwise(F.lit(0.0)).alias("__rate")
    )


def replicated(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = 1234, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """All columns of ``docs`` plus ``rate``, ``copy_no`` (from 0), ``n_copies`` and ``shuffle_key``; unsorted."""
    names = docs.columns
    out = docs.withColumn("__source", F.coalesce(F.col(source).cast("string"), F.lit("")))
    out = looked_up(out, checkpoint(rates(docs, weights, text, source)), "__source", key)
    m = F.greatest(F.ceil(F.col("__rate") / PART).cast("int"), F.lit(1))
    one = F.col("__rate") / m
    ident = (F.lit(str(seed)), F.col(key), F.col("__source"))
    copies = F.when(F.col("__rate") <= 0, F.lit(0)).otherwise(F.aggregate(F.sequence(F.lit(1), m), F.lit(0), lambda a, i: a + poisson(uniform(*ident, i), one)))
    # an empty array drops a row without copies; a filter would be pushed below the fold and take it twice
    out = out.withColumn("__copies", copies)
    out = out.select("*", F.posexplode(F.array_repeat(F.lit(True), F.col("__copies"))).alias("__copy", "__one"))
    order = F.md5(F.concat_ws(":", F.lit(f"order{seed}"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.col("__copy").cast("string")).cast("binary"))
    return out.select(*(F.col(f"`{n}`") for n in names), F.col("__rate").alias("rate"), F.col("__copy").alias("copy_no"), F.col("__copies").alias("n_copies"), order.alias("shuffle_key"))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = 1234, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """Each row as many times as a Poisson number, seeded by its key's hash, says, globally shuffled: in order of the
    copies' hashes, dealt to ``spark.sql.shuffle.partitions`` equal ranges of them.

    ``weights``: target share of each source in the mixture's code points (any positive scale; sources that it doesn't
    name get none); None: all sources alike. The mixture is expected to be as large as ``docs``. A null source is a
    source of its own, ''. Null and empty texts count no code points; a source without any code points gets no copies.
    A source with few code points is repeated often: its rate is its target size over its own, and a row's copies are made
    where the row is read, one row after another. Repeated rows with the same key and source get the same number. An empty table gives an empty result. Columns of
    ``docs`` that are named like the added ones are replaced by those.
    """
    docs = docs.drop("rate", "copy_no", "n_copies", "shuffle_key")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # equal ranges of a hash need no sample of the rows, which would make all copies twice
    place = F.shiftright(F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("long") * n, 32).cast("int")
    return replicated(docs, weights, seed, text, source, key).repartitionById(n, place).sortWithinPartitions("shuffle_key", key, "copy_no")


def oracle(table: str, seed: int = 1234, columns: tuple[str, ...] = ("doc_id", "source", "text", "lang", "n_chars")) -> str:
    """DuckDB SQL of ``mixed`` with equal weights."""
    steps = f"{PART!r}"
    return f"""
WITH RECURSIVE d AS (SELECT *, coalesce(source, '') AS s FROM {table}),
size AS (SELECT s, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS size FROM d GROUP BY s),
whole AS (SELECT CAST(sum(size) AS BIGINT) AS total, CAST(count(*) FILTER (size > 0) AS DOUBLE) AS weights FROM size),
rate AS (SELECT s, CASE WHEN size > 0 THEN CAST(total AS DOUBLE) / weights / size ELSE 0.0::DOUBLE END AS rate FROM size, whole),
parts AS (SELECT s, rate, greatest(CAST(ceil(rate / {steps}::DOUBLE) AS INT), 1) AS m FROM rate WHERE rate > 0),
terms AS (
  SELECT s, rate, m, 0 AS k, exp(-(rate / m)) AS p, exp(-(rate / m)) AS cdf FROM parts
  UNION ALL SELECT s, rate, m, k + 1, p * (rate / m) / (k + 1), cdf + p * (rate / m) / (k + 1) FROM terms WHERE k < {TERMS}),
draws AS (
  SELECT d.doc_id, d.s, i, CAST(('0x' || substr(md5(concat_ws(':', '{seed}', coalesce(CAST(d.doc_id AS VARCHAR), ''), d.s, CAST(i AS VARCHAR))), 1, 13)) AS BIGINT)::DOUBLE / {float(1 << 52)!r}::DOUBLE AS u
  FROM (SELECT DISTINCT doc_id, s FROM d) d JOIN parts USING (s), unnest(range(1, m + 1)) AS r(i)),
copies AS (
  SELECT doc_id, s, CAST(sum(k) AS INT) AS n_copies FROM (
    SELECT draws.doc_id, draws.s, i, count(*) FILTER (terms.cdf <= u AND terms.k < {TERMS}) AS k
    FROM draws JOIN terms USING (s) GROUP BY ALL) GROUP BY ALL)
SELECT {", ".join(f"d.{c}" for c in columns)}, rate.rate, CAST(c AS INT) AS copy_no, n_copies,
  md5(concat_ws(':', 'order{seed}', coalesce(CAST(d.doc_id AS VARCHAR), ''), CAST(c AS VARCHAR))) AS shuffle_key
FROM d JOIN rate USING (s) JOIN copies ON copies.s = d.s AND copies.doc_id IS NOT DISTINCT FROM d.doc_id, unnest(range(0, n_copies)) AS r(c)
"""
