"""URL filters: rules judge urls, and trust and distrust spread over the host link graph judge the rest."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, looked_up

#: (verdict, host, path) as the contract states them.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
ASCII_UP, ASCII_LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Targets of links in a page's markup: scheme or // first, host up to the first delimiter.
LINK = r"""<a\s[^>]*?href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """``host`` (ASCII lower case) and ``path`` of each url; both empty where it is null or has no ``://``."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(F.col(url)))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), ASCII_UP, ASCII_LOW)
    return pages.withColumn("host", host).withColumn("path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def matched(rules: tuple[tuple[str, str, str], ...], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, as ``host/path`` text, and its verdict; null without one. Rules are a configuration's list."""
    name = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """(src, dst, links): how many pages of one host link to another; pre-aggregated where the pages are read."""
    targets = F.regexp_extract_all(F.translate(F.coalesce(F.col(html), F.lit("")), ASCII_UP, ASCII_LOW), F.lit(LINK), 1)
    links = pages.where(F.col("host") != "").select(F.col("host").alias("src"), F.explode(F.array_distinct(targets)).alias("dst"))
    return links.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("links"))


#: Links of a host that one task may have to meet its rank; more are dealt to as many tasks as that takes.
FAN = 20_000


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, rounds: int = 400, between: int = 5) -> DataFrame:
    """Two personalised PageRanks at once, each beside an unseeded one: (host, trust, distrust, trust_share, distrust_share).

    ``seeds`` (host, trust, distrust): shares of a host's pages. A walk restarts with 1 - ``damping`` times the seeds; trust follows links,
    split over a host's out-links, distrust goes against them, split over its in-links. A share is what of the rank that came to
    a host over links comes from seeds: its flow divided by the flow of the same walk restarted from every host alike. So it lies
    between 0 and 1 and depends neither on the graph's size nor on how many hosts link to the same target; without links it is 0. Every
    few rounds the ranks go to the shared folder, and the walk ends when their summed change since the last time is under ``tolerance`` a host; ``rounds``
    without that are an error. Only that sum comes to the driver. A popular host's links are dealt to several tasks, its rank to each.
    """
    none = F.lit(0.0)
    if edges.isEmpty():
        scaled = ((1 - damping) * F.col(c) for c in ("trust", "distrust"))
        return seeds.select("host", *(x.alias(c) for x, c in zip(scaled, ("trust", "distrust"), strict=True)), none.alias("trust_share"), none.alias("distrust_share"))
    edges = checkpoint(edges)
    ways = edges.select(F.lit(0).alias("way"), F.col("src").alias("a"), F.col("dst").alias("b"), "links").unionByName(edges.select(F.lit(1).alias("way"), F.col("dst").alias("a"), F.col("src").alias("b"), "links"))
    sums = checkpoint(ways.groupBy("way", "a").agg(F.sum("links").alias("all"), F.ceil(F.count("*") / FAN).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part")
    steps = checkpoint(looked_up(ways.withColumn("__key", F.concat_ws(":", "way", "a")), sums.select(F.concat_ws(":", "way", "a").alias("__key"), "all", "parts"), "__key", "b").select("way", "a", "b", (F.col("links") / F.col("all")).alias("share"), part))
    nodes = seeds.select("host").union(edges.select("src")).union(edges.select("dst")).distinct().join(seeds, "host", "left").na.fill(0.0)
    start = nodes.select("host", F.explode(F.array(*(F.struct(F.lit(way).alias("way"), ((1 - damping) * F.col(c)).alias("seed")) for way, c in enumerate(("trust", "distrust"))))).alias("x")).select("host", "x.*")
    start = start.join(sums.select("way", F.col("a").alias("host"), "parts"), ["way", "host"], "left")
    fixed = checkpoint(start.select("way", "host", "seed", "parts"))
    rank = fixed.select("way", "host", "parts", F.col("seed").alias("rank"), F.lit(1 - damping).alias("any"), none.alias("flow"), none.alias("any_flow"))
    n, change, before = fixed.count(), math.inf, rank
    for k in range(1, rounds + 1):  # each round looks at the one before once, so plans grow by a join and an aggregate
        sent = rank.where("parts IS NOT NULL").select("way", F.col("host").alias("a"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "rank", "any")
        flow = steps.join(sent, ["way", "a", "part"]).groupBy("way", F.col("b").alias("host")).agg(F.sum(F.col("rank") * F.col("share")).alias("x"), F.sum(F.col("any") * F.col("share")).alias("y"))
        x, y = (damping * F.coalesce(c, none) for c in ("x", "y"))
        rank = fixed.join(flow, ["way", "host"], "left").select("way", "host", "parts", (F.col("seed") + x).alias("rank"), (F.lit(1 - damping) + y).alias("any"), x.alias("flow"), y.alias("any_flow"))
        if k % between:
            continue
        rank = checkpoint(rank)
        old = before.select("way", "host", F.col("rank").alias("old"), F.col("any").alias("old_any"))
        change = rank.join(old, ["way", "host"]).agg(F.sum(F.abs(F.col("rank") - F.col("old")) + F.abs(F.col("any") - F.col("old_any")))).first()[0] or 0.0
        before = rank
        if change < tolerance * max(n, 1):
            break
    else:
        raise RuntimeError(f"propagate: ranks still change by {change} after {rounds} rounds")
    pick = lambda way, value: F.max(F.when(F.col("way") == way, value))
    share = F.when(F.col("any_flow") > 0, F.col("flow") / F.col("any_flow")).otherwise(none)
    return rank.groupBy("host").agg(pick(0, F.col("rank")).alias("trust"), pick(1, F.col("rank")).alias("distrust"), pick(0, share).alias("trust_share"), pick(1, share).alias("distrust_share"))


def url_filter(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, threshold: float = 0.5, url: str = "url", html: str = "html", key: str = "page_id") -> DataFrame:
    """``key``, host, path, rule, verdict and the host's scores for every row.

    A rule judges the urls it fits. A host's seeds are the shares of its pages that rules allow and block. Its trust and distrust are
    these, and of the pages that no rule judges, what ``propagate`` says of its links: the shares of the walks' flow that come from
    seeds. Its other urls are blocked if its distrust is at least ``threshold`` and not below its trust, else allowed. Null urls and urls
    without ``://`` have empty host and path and are allowed: nothing speaks against them. Repeated rows are judged one by one;
    links come from the whole html (null: none). A hot host is one row of the graph, however many pages it has.
    """
    parts = with_parts(pages.select(F.col(key), F.col(url).alias("url"), F.col(html).alias("html")))
    rule, verdict = matched(rules, F.col("host"), F.col("path"))
    judged = parts.withColumn("rule", rule).withColumn("__said", verdict)
    seeds = judged.groupBy("host").agg(
        (F.count_if(F.col("__said") == "allow") / F.count("*")).alias("trust"), (F.count_if(F.col("__said") == "block") / F.count("*")).alias("distrust")
    )
    seeds = checkpoint(seeds)
    walked = propagate(host_edges(parts), seeds).select("host", "trust_share", "distrust_share")
    rest = 1 - F.col("trust") - F.col("distrust")
    scores = checkpoint(seeds.join(walked, "host").select("host", *((F.col(c) + rest * F.col(f"{c}_share")).alias(c) for c in ("trust", "distrust"))))
    own = F.when((F.col("distrust") >= threshold) & (F.col("distrust") >= F.col("trust")) & (F.col("host") != ""), "block").otherwise("allow")
    return looked_up(judged.drop("html"), scores, "host", key, "left").select(
        key, "host", "path", "rule", F.coalesce("__said", own).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")
    )


def oracle(table: str, rules: tuple[tuple[str, str, str], ...] = RULES, threshold: float = 0.5, damping: float = 0.85, steps: int = 120) -> str:
    """DuckDB SQL of ``url_filter``: the walk's terms one after another, as a recursive query."""
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, kind) for kind, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))]
    rule = " ".join(f"WHEN {f} THEN '{name}'" for f, name, _ in fits)
    said = " ".join(f"WHEN {f} THEN '{kind}'" for f, _, kind in fits)
    lower = f"translate(coalesce(html, ''), '{ASCII_UP}', '{ASCII_LOW}')"
    return f"""
WITH RECURSIVE cut AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM {table}),
parts AS (SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{ASCII_UP}', '{ASCII_LOW}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
judged AS (SELECT page_id, host, path, CASE {rule} END AS rule, CASE {said} END AS said FROM parts),
seeds AS (SELECT host, count(*) FILTER (said = 'allow') / count(*) AS trust, count(*) FILTER (said = 'block') / count(*) AS distrust FROM judged GROUP BY host),
links AS (SELECT host AS src, unnest(list_distinct(regexp_extract_all({lower}, '{LINK.replace("'", "''")}', 1))) AS dst FROM parts WHERE host <> ''),
edges AS (SELECT src, dst, count(*) AS n FROM links WHERE src <> dst GROUP BY ALL),
ways AS (
  SELECT 0 AS way, src AS a, dst AS b, n / sum(n) OVER (PARTITION BY src) AS share FROM edges
  UNION ALL SELECT 1, dst, src, n / sum(n) OVER (PARTITION BY dst) FROM edges),
nodes AS (SELECT host FROM seeds UNION SELECT src FROM edges UNION SELECT dst FROM edges),
walk AS (
  SELECT 0 AS k, way, host, coalesce(CASE way WHEN 0 THEN trust ELSE distrust END, 0)::DOUBLE AS x, 1::DOUBLE AS y FROM nodes LEFT JOIN seeds USING (host), (VALUES (0), (1)) AS v(way)
  UNION ALL SELECT k + 1, walk.way, b, {damping}::DOUBLE * sum(x * share), {damping}::DOUBLE * sum(y * share) FROM walk JOIN ways ON ways.way = walk.way AND a = host
  WHERE k < {steps} GROUP BY k, walk.way, b),
shares AS (SELECT host, sum(x) FILTER (way = 0 AND k > 0) / sum(y) FILTER (way = 0 AND k > 0) AS trusted, sum(x) FILTER (way = 1 AND k > 0) / sum(y) FILTER (way = 1 AND k > 0) AS distrusted FROM walk GROUP BY host),
scores AS (SELECT host, trust + (1 - trust - distrust) * coalesce(trusted, 0) AS trust, distrust + (1 - trust - distrust) * coalesce(distrusted, 0) AS distrust FROM seeds JOIN shares USING (host))
SELECT page_id, host, path, rule,
  coalesce(said, CASE WHEN distrust >= {threshold} AND distrust >= trust AND host <> '' THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(trust, 0.0)::DOUBLE AS trust, coalesce(distrust, 0.0)::DOUBLE AS distrust
FROM judged LEFT JOIN scores USING (host)
"""
