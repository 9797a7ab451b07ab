"""Queries on conversations: rendering, rejection, selection, packing and its checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.text import SPACE, strip
from ..functions.tokens import n_pieces, pieces
from ..operators import consume, pack, render, select, verify
from ..sources.tables import messages, prompts
from ..session import checkpoint, global_rank

CAP, SEED, HEAD = 1024, 1234, 64
CUTS = (256, 512, 1024, 2048, 4096, 8192, 16384, 131072)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function as the query of its name, with its SQL."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


MSG = f"""
msg AS (SELECT conv_id AS rec_id, turn AS msg_idx, role, text, trim(coalesce(text, ''), '{SPACE}') AS c FROM conversations),
tok AS (SELECT *, len(regexp_extract_all(c, '[A-Za-z0-9]+|[^A-Za-z0-9]')) AS own FROM msg),
why AS (SELECT *, CASE
  WHEN role = 'assistant' AND (contains(c, '<|im_start|>') OR contains(c, '<|im_end|>') OR contains(c, '<|endoftext|>')) THEN 'control_token_in_assistant_content'
  WHEN role IN ('system', 'tool') THEN 'unsupported_role_for_this_corpus:' || role
  WHEN role IS NULL OR role NOT IN ('user', 'assistant') THEN 'unexpected_role:' || coalesce(role, 'None') END AS r FROM tok),
reason AS (SELECT rec_id, CASE WHEN arg_min(role, msg_idx) = 'system' THEN 'unsupported_role_for_this_corpus:system'
  ELSE arg_min(r, msg_idx) FILTER (r IS NOT NULL) END AS reason FROM why GROUP BY rec_id),
lens AS (SELECT tok.*, own + CASE role WHEN 'user' THEN 5 ELSE 11 END AS n_tok, CASE role WHEN 'assistant' THEN own + 1 ELSE 0 END AS n_scored
  FROM tok JOIN reason USING (rec_id) WHERE reason IS NULL),
raw AS (SELECT rec_id, CAST(sum(n_tok) AS BIGINT) AS raw_tokens, CAST(sum(n_scored) AS BIGINT) AS scored_tokens, count(*) AS n_messages FROM lens GROUP BY rec_id)"""
IDX = """
idx AS (SELECT doc_id AS rec_id, substr(sha1(coalesce(text, '')), 1, 16) AS prompt_key FROM documents)"""


def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of conversations that are not rejected."""
    m = messages(spark, sf_dir)
    return m.join(render.reasons(m).where("reason IS NULL").select("rec_id"), "rec_id", "left_semi")


def raw_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.record_lengths(render.lengths(messages(spark, sf_dir)))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.per_record(render.lengths(messages(spark, sf_dir)))


# ---------------------------------------------------------------- rendering
@query(f"WITH {MSG} SELECT rec_id, raw_tokens, scored_tokens, n_messages FROM raw")
def conv_render_lengths(spark, sf_dir):
    return raw_lengths(spark, sf_dir)


@query(f"WITH {MSG} SELECT rec_id, msg_idx, md5(c) AS content_md5, len(c) AS n_chars FROM msg")
def trimmed_content(spark, sf_dir):
    c = strip(F.col("content"))
    return messages(spark, sf_dir).select("rec_id", "msg_idx", F.md5(c.cast("binary")).alias("content_md5"), F.length(c).cast("long").alias("n_chars"))


@query(f"""WITH {MSG} SELECT rec_id, msg_idx, md5(CASE role WHEN 'user' THEN '<|im_start|>user' || chr(10) || c || '<|im_end|>' || chr(10)
  ELSE '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) || c || '<|im_end|>' || chr(10) END) AS rendered_md5 FROM lens""")
def rendered_text(spark, sf_dir):
    s = render.segments(accepted(spark, sf_dir))
    return s.select("rec_id", "msg_idx", F.md5(F.array_join(F.transform("segments", lambda x: x["text"]), "").cast("binary")).alias("rendered_md5"))


@query(f"""WITH {MSG} SELECT rec_id, msg_idx, CAST(CASE WHEN role = 'user' THEN 1 WHEN c = '' THEN 3 ELSE 4 END AS BIGINT) AS n_segments,
  CAST(CASE WHEN role = 'user' THEN 0 WHEN c = '' THEN 1 ELSE 2 END AS BIGINT) AS n_scored_segments FROM lens""")
def segment_counts(spark, sf_dir):
    s = render.segments(accepted(spark, sf_dir))
    scored = F.size(F.filter("segments", lambda x: x["scored"])).cast("long")
    n = F.when(F.col("role") == "user", F.lit(1)).otherwise(scored + 2).cast("long")
    return s.select("rec_id", "msg_idx", n.alias("n_segments"), scored.alias("n_scored_segments"))


@query(f"WITH {MSG} SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM reason GROUP BY 1")
def skip_reasons(spark, sf_dir):
    return render.reasons(messages(spark, sf_dir)).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""WITH {MSG}, q AS (SELECT rec_id, coalesce(bool_or(role = 'user' AND NOT (starts_with(c, '<tool_response>') AND ends_with(c, '</tool_response>'))), false) AS has FROM msg GROUP BY rec_id)
  SELECT CASE WHEN NOT has THEN 'no_user_query' ELSE coalesce(reason, 'accepted') END AS reason, count(*) AS n FROM reason JOIN q USING (rec_id) GROUP BY 1""")
def strict_reasons(spark, sf_dir):
    return render.reasons(messages(spark, sf_dir), checked=True).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {MSG} SELECT rec_id, msg_idx, role, CAST(n_tok AS BIGINT) AS n_tok, CAST(n_scored AS BIGINT) AS n_scored FROM lens")
def mask_counts(spark, sf_dir):
    t = render.tokenized(accepted(spark, sf_dir))
    return t.select("rec_id", "msg_idx", "role", F.size("ids").cast("long").alias("n_tok"), pack.n_scored(F.col("labels")).alias("n_scored"))


PIECES = """list_concat(list_concat(CASE role WHEN 'user' THEN ['<|im_start|>', 'user', chr(10)] ELSE
  ['<|im_start|>', 'assistant', chr(10), '<think>', chr(10), chr(10), '</think>', chr(10), chr(10)] END,
  regexp_extract_all(c, '[A-Za-z0-9]+|[^A-Za-z0-9]')), ['<|im_end|>', chr(10)])"""
IDS = f"""
ids AS (SELECT rec_id, msg_idx, role, own, list_transform({PIECES}, lambda x: CAST('0x' || substr(md5(x), 1, 8) AS BIGINT)) AS ids FROM lens),
labelled AS (SELECT *, list_transform(ids, lambda x, i: CASE WHEN role = 'assistant' AND i > 9 AND i <= 9 + own + 1 THEN x ELSE -100 END) AS labels FROM ids)"""


@query(f"WITH {MSG}, {IDS} SELECT rec_id, msg_idx, md5(array_to_string(ids, ',')) AS ids_md5, md5(array_to_string(labels, ',')) AS labels_md5 FROM labelled")
def token_table(spark, sf_dir):
    t = render.tokenized(accepted(spark, sf_dir))
    return t.select("rec_id", "msg_idx", F.md5(F.array_join("ids", ",").cast("binary")).alias("ids_md5"), F.md5(F.array_join("labels", ",").cast("binary")).alias("labels_md5"))


@query(f"""WITH {MSG}, {IDS} SELECT rec_id, msg_idx, CAST(len(labels) - 1 AS BIGINT) AS n_targets,
  CAST(len(list_filter(labels[2:], lambda x: x <> -100)) AS BIGINT) AS n_scored_targets FROM labelled""")
def shifted_targets(spark, sf_dir):
    t = consume.shifted(F.col("labels"))
    return render.tokenized(accepted(spark, sf_dir)).select("rec_id", "msg_idx", F.size(t).cast("long").alias("n_targets"), pack.n_scored(t).alias("n_scored_targets"))


# ------------------------------------------------------------- distributions
QUANT = ", ".join(f"coalesce(max(CASE WHEN rn = least(n - 1, CAST(floor(n * {p}::DOUBLE) AS BIGINT)) THEN v END), 0) AS {name}" for name, p in stats.POINTS.items())


def dist_sql(values: str) -> str:
    return f"""q AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS rn, count(*) OVER () AS n FROM ({values}))
    SELECT count(*) AS n, CAST(coalesce(sum(v), 0) AS BIGINT) AS total_tokens, CAST(coalesce(floor(sum(v) / count(*)), 0) AS BIGINT) AS mean, {QUANT}, coalesce(max(v), 0) AS max FROM q"""


@query(f"WITH {MSG}, {dist_sql('SELECT raw_tokens AS v FROM raw')}")
def length_quantiles(spark, sf_dir):
    return stats.distribution(raw_lengths(spark, sf_dir), "raw_tokens")


@query("WITH " + dist_sql("SELECT length(text) AS v FROM documents WHERE text IS NOT NULL"))
def document_quantiles(spark, sf_dir):
    return stats.distribution(prompts(spark, sf_dir).where("content IS NOT NULL").select(F.length("content").alias("n")), "n")


@query(f"""WITH {MSG}, t AS (SELECT unnest({list(CUTS)!r}) AS threshold)
  SELECT CAST(threshold AS BIGINT) AS threshold, count(*) FILTER (raw_tokens > threshold) AS records_over, round(count(*) FILTER (raw_tokens > threshold)::DOUBLE / count(*), 6) AS frac_records_over,
  CAST(sum(least(raw_tokens, threshold)) AS BIGINT) AS tokens_if_capped, round(sum(least(raw_tokens, threshold))::DOUBLE / sum(raw_tokens)::DOUBLE, 6) AS frac_tokens_kept_if_capped
  FROM raw, t GROUP BY threshold""")
def length_thresholds(spark, sf_dir):
    return stats.thresholds(raw_lengths(spark, sf_dir), "raw_tokens", CUTS)


@query(f"WITH {MSG} SELECT CAST(CASE WHEN raw_tokens = 0 THEN 0 ELSE floor(log2(raw_tokens)) + 1 END AS BIGINT) AS bits, count(*) AS n FROM raw GROUP BY 1")
def length_histogram(spark, sf_dir):
    return raw_lengths(spark, sf_dir).groupBy(stats.bit_length(F.col("raw_tokens")).cast("long").alias("bits")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- selection
@query(f"WITH {IDX} SELECT prompt_key, count(*) AS n_records FROM idx GROUP BY 1")
def prompt_groups(spark, sf_dir):
    return select.groups(select.index(prompts(spark, sf_dir)))


@query("""SELECT conv_id AS rec_id, substr(sha1(coalesce(arg_min(coalesce(text, ''), turn) FILTER (role = 'user'), '')), 1, 16) AS prompt_key, CAST(count(*) AS INT) AS n_messages
  FROM conversations GROUP BY conv_id""")
def conversation_index(spark, sf_dir):
    return select.index(messages(spark, sf_dir))


@query(f"WITH {IDX} SELECT count(DISTINCT prompt_key) AS groups, count(*) AS records, CAST(max(n) AS BIGINT) AS largest FROM (SELECT *, count(*) OVER (PARTITION BY prompt_key) AS n FROM idx)")
def group_summary(spark, sf_dir):
    g = select.groups(select.index(prompts(spark, sf_dir)))
    return g.agg(F.count("*").alias("groups"), F.sum("n_records").alias("records"), F.max("n_records").alias("largest"))


@query(f"""WITH {IDX} SELECT rec_id, prompt_key FROM (SELECT *, row_number() OVER (PARTITION BY prompt_key ORDER BY md5('{SEED}:' || prompt_key || ':' || rec_id), rec_id) AS rn FROM idx) WHERE rn <= 2""")
def prompt_cap(spark, sf_dir):
    return select.capped(select.index(prompts(spark, sf_dir)), 2, SEED).select("rec_id", "prompt_key")


SPLIT = f"""{IDX},
g AS (SELECT prompt_key, count(*) AS n FROM idx GROUP BY 1),
prior AS (SELECT prompt_key, coalesce(sum(n) OVER (ORDER BY md5('{SEED}:' || prompt_key), prompt_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM g),
split AS (SELECT rec_id, prompt_key, CASE WHEN p >= {HEAD} THEN NULL ELSE CAST(p + row_number() OVER (PARTITION BY prompt_key ORDER BY rec_id) - 1 AS BIGINT) END AS h, p FROM idx JOIN prior USING (prompt_key)),
held AS (SELECT rec_id, prompt_key, CASE WHEN h IS NULL THEN 'tail' WHEN h < {HEAD} THEN 'head' ELSE 'dropped' END AS split, CASE WHEN h < {HEAD} THEN h END AS head_pos FROM split)"""


def held(spark, sf_dir):
    return select.holdout(select.index(prompts(spark, sf_dir)), HEAD, SEED)


@query(f"WITH {SPLIT} SELECT rec_id, prompt_key, split, coalesce(head_pos, -1) AS head_pos FROM held")
def holdout_split(spark, sf_dir):
    return held(spark, sf_dir).select("rec_id", "prompt_key", "split", F.coalesce("head_pos", F.lit(-1)).alias("head_pos"))


ORDER = f"""{SPLIT},
ordered AS (SELECT rec_id, prompt_key, split, row_number() OVER (ORDER BY coalesce(head_pos, 4611686018427387904), CASE split WHEN 'head' THEN '' ELSE md5('{SEED}:tail:' || rec_id) END, rec_id) - 1 AS pos
  FROM held WHERE split <> 'dropped')"""


@query(f"WITH {ORDER} SELECT rec_id, split, pos FROM ordered")
def selection_order(spark, sf_dir):
    return select.ordered(held(spark, sf_dir), SEED).select("rec_id", "split", "pos")


@query(f"WITH {ORDER} SELECT rec_id, pos FROM ordered WHERE pos < 100")
def selection_limit(spark, sf_dir):
    return select.ordered(held(spark, sf_dir), SEED, 100).select("rec_id", "pos")


@query(f"""WITH {SPLIT} SELECT count(DISTINCT prompt_key) FILTER (split = 'head') AS head_groups, count(*) FILTER (split = 'head') AS head_records, count(*) FILTER (split = 'tail') AS tail_records,
  count(*) FILTER (split = 'dropped') AS dropped_records, (SELECT count(*) FROM (SELECT prompt_key FROM held WHERE split = 'head' INTERSECT SELECT prompt_key FROM held WHERE split = 'tail')) AS overlap FROM held""")
def leak_check(spark, sf_dir):
    s = held(spark, sf_dir)
    n = s.agg(
        F.countDistinct(F.when(F.col("split") == "head", F.col("prompt_key"))).alias("head_groups"), F.count_if(F.col("split") == "head").alias("head_records"),
        F.count_if(F.col("split") == "tail").alias("tail_records"), F.count_if(F.col("split") == "dropped").alias("dropped_records"),
    )
    return n.join(F.broadcast(select.leaks(s).agg(F.count("*").alias("overlap"))))


@query(f"""WITH {ORDER} SELECT rec_id, pos, CAST(floor(pos / greatest(ceil(n / 64.0::DOUBLE), 1)) AS BIGINT) AS shard FROM (SELECT *, count(*) OVER ()::DOUBLE AS n FROM ordered)""")
def shard_plan(spark, sf_dir):
    return select.shards(select.ordered(held(spark, sf_dir), SEED), 64).select("rec_id", "pos", "shard")


@query(f"""WITH {ORDER} SELECT rec_id, pos FROM (SELECT *, greatest(1, count(*) OVER () // 48) AS s FROM ordered) WHERE pos % s = 0 AND pos // s < 48""")
def verify_sample(spark, sf_dir):
    return select.strided(select.ordered(held(spark, sf_dir), SEED), 48).select("rec_id", "pos")


# ------------------------------------------------------------------ packing
@query(f"WITH {MSG} SELECT CASE WHEN raw_tokens > {CAP} THEN 'overlength' WHEN scored_tokens = 0 THEN 'no_scored_tokens' ELSE 'kept' END AS outcome, count(*) AS n, CAST(sum(raw_tokens) AS BIGINT) AS tokens FROM raw GROUP BY 1")
def pack_fit_skip(spark, sf_dir):
    p = pack.packed(records(spark, sf_dir), CAP, "skip")
    return p.groupBy(F.coalesce("reason", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"), F.sum("raw").alias("tokens"))


WHOLE = f"""{MSG}, {IDS},
whole AS (SELECT rec_id, flatten(list(ids ORDER BY msg_idx)) AS ids, flatten(list(labels ORDER BY msg_idx)) AS labels FROM labelled GROUP BY rec_id)"""


@query(f"""WITH {WHOLE} SELECT rec_id, CAST(least(len(ids), {CAP}) AS BIGINT) AS n_tok, CAST(len(list_filter(labels[1:{CAP}], lambda x: x <> -100)) AS BIGINT) AS n_scored,
  md5(array_to_string(ids[1:{CAP}], ',')) AS ids_md5 FROM whole WHERE len(list_filter(labels[1:{CAP}], lambda x: x <> -100)) > 0""")
def pack_truncate(spark, sf_dir):
    p = pack.packed(records(spark, sf_dir), CAP, "truncate")
    a = pack.assembled(pack.samples(p), render.tokenized(pack.together(accepted(spark, sf_dir))), CAP)
    a = consume.truncated(a, CAP)
    return a.select("rec_id", F.size("input_ids").cast("long").alias("n_tok"), pack.n_scored(F.col("labels")).alias("n_scored"), F.md5(F.array_join("input_ids", ",").cast("binary")).alias("ids_md5"))


def split_sql(cap: int) -> str:
    return f"""RECURSIVE {MSG},
rec AS (SELECT rec_id, list(n_tok ORDER BY msg_idx) AS l, list(n_scored ORDER BY msg_idx) AS s, list(role ORDER BY msg_idx) AS r, list(msg_idx ORDER BY msg_idx) AS m, count(*) AS n, sum(n_tok) AS total FROM lens GROUP BY rec_id),
st AS (
  SELECT rec_id, 0 AS i, 0::BIGINT AS a, true AS first, 0::BIGINT AS pa, 0::BIGINT AS pk, false AS pfirst, false AS emit FROM rec WHERE total > {cap} AND l[1] <= {cap}
  UNION ALL
  SELECT rec_id, i + 1, CASE WHEN stop = a THEN a + CASE WHEN r[a + 1] = 'user' THEN 2 ELSE 1 END WHEN k < n AND r[k + 1] <> 'user' THEN k + 1 ELSE k END, false, a, k, first,
    stop > a AND list_sum(s[a + 1:k]) + CASE WHEN first THEN 0 ELSE s[1] END > 0
  FROM (SELECT *, CASE WHEN stop < n AND stop - 1 > a AND r[stop] = 'user' THEN stop - 1 ELSE stop END AS k FROM (
    SELECT st.*, rec.l, rec.s, rec.r, rec.n, a + len(list_filter(range(a, n), lambda j: list_sum(l[a + 1:j + 1]) + CASE WHEN first THEN 0 ELSE l[1] END <= {cap})) AS stop
    FROM st JOIN rec USING (rec_id) WHERE a < n))),
parts AS (
  SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY i) - 1 AS piece_no, CASE WHEN pfirst THEN range(pa, pk) ELSE list_concat([0], range(pa, pk)) END AS o FROM st WHERE emit
  UNION ALL SELECT rec_id, 0, range(0, n) FROM rec WHERE total <= {cap} AND list_sum(s) > 0),
plan AS (SELECT parts.rec_id, piece_no, list_transform(o, lambda j: m[j + 1]) AS o, o AS at, CAST(list_sum(list_transform(o, lambda j: l[j + 1])) AS BIGINT) AS n_tok,
  CAST(list_sum(list_transform(o, lambda j: s[j + 1])) AS BIGINT) AS n_scored, total FROM parts JOIN rec USING (rec_id))"""


@query(f"WITH {split_sql(CAP)} SELECT rec_id, CAST(piece_no AS INT) AS piece_no, array_to_string(o, ',') AS messages, n_tok, n_scored FROM plan")
def pack_split(spark, sf_dir):
    s = pack.samples(pack.packed(records(spark, sf_dir), CAP))
    return s.select("rec_id", "piece_no", F.array_join("order", ",").alias("messages"), "n_tok", "n_scored")


@query(f"WITH {split_sql(512)} SELECT rec_id, CAST(piece_no AS INT) AS piece_no, array_to_string(o, ',') AS messages, n_tok, n_scored FROM plan")
def pack_split_512(spark, sf_dir):
    s = pack.samples(pack.packed(records(spark, sf_dir), 512))
    return s.select("rec_id", "piece_no", F.array_join("order", ",").alias("messages"), "n_tok", "n_scored")


@query(f"""WITH {split_sql(CAP)}, used AS (SELECT DISTINCT rec_id, unnest(o) AS msg_idx FROM plan WHERE total > {CAP})
  SELECT lens.rec_id, count(*) FILTER (used.msg_idx IS NULL) AS dropped_messages, CAST(coalesce(sum(n_tok) FILTER (used.msg_idx IS NULL), 0) AS BIGINT) AS dropped_tokens
  FROM lens JOIN (SELECT DISTINCT rec_id FROM plan WHERE total > {CAP}) USING (rec_id) LEFT JOIN used USING (rec_id, msg_idx) GROUP BY 1""")
def split_dropped(spark, sf_dir):
    return pack.dropped(pack.packed(records(spark, sf_dir), CAP))


@query(f"""WITH {split_sql(CAP)}, x AS (SELECT rec.rec_id, rec.total, list_sum(rec.s) AS sc, p.rec_id IS NOT NULL AS kept FROM rec LEFT JOIN (SELECT DISTINCT rec_id FROM plan) p USING (rec_id)),
  y AS (SELECT count(*) AS samples, CAST(coalesce(sum(n_tok), 0) AS BIGINT) AS tokens, CAST(coalesce(sum(n_scored), 0) AS BIGINT) AS scored_tokens FROM plan)
  SELECT count(*) AS records_in, count(*) FILTER (kept) AS kept_records, count(*) FILTER (NOT kept) AS skipped, 0::BIGINT AS truncated, count(*) FILTER (NOT kept AND total > {CAP}) AS unsplittable,
  CAST(sum(total) AS BIGINT) AS raw_tokens, max(samples) AS samples, max(tokens) AS tokens, max(scored_tokens) AS scored_tokens, round(max(scored_tokens)::DOUBLE / max(tokens), 6) AS scored_fraction FROM x, y""")
def piece_counts(spark, sf_dir):
    p = pack.packed(records(spark, sf_dir), CAP)
    return pack.counters(p, pack.samples(p))


@query(f"""WITH {split_sql(CAP)}, {IDS}, flat AS (SELECT rec_id, piece_no, unnest(o) AS msg_idx, unnest(range(len(o))) AS k FROM plan)
  SELECT rec_id, CAST(piece_no AS INT) AS piece_no, md5(array_to_string(flatten(list(ids ORDER BY k)), ',')) AS ids_md5, md5(array_to_string(flatten(list(labels ORDER BY k)), ',')) AS labels_md5
  FROM flat JOIN labelled USING (rec_id, msg_idx) GROUP BY 1, 2""")
def packed_samples(spark, sf_dir):
    s = pack.samples(pack.packed(records(spark, sf_dir), CAP))
    a = pack.assembled(s, render.tokenized(pack.together(accepted(spark, sf_dir))))
    return a.select("rec_id", "piece_no", F.md5(F.array_join("input_ids", ",").cast("binary")).alias("ids_md5"), F.md5(F.array_join("labels", ",").cast("binary")).alias("labels_md5"))


@query(f"""WITH {split_sql(CAP)}, k AS (SELECT conv_id AS rec_id, substr(sha1(coalesce(arg_min(coalesce(text, ''), turn) FILTER (role = 'user'), '')), 1, 16) AS prompt_key FROM conversations GROUP BY 1),
  h AS (SELECT rec_id, prompt_key, row_number() OVER (ORDER BY md5('{SEED}:' || prompt_key), prompt_key, rec_id) <= 16 AS head FROM k),
  p AS (SELECT plan.rec_id, piece_no, prompt_key, head FROM plan JOIN h USING (rec_id))
  SELECT count(*) FILTER (head) AS head_pieces, count(*) FILTER (NOT head) AS tail_pieces, (SELECT count(*) FROM (SELECT prompt_key FROM p WHERE head INTERSECT SELECT prompt_key FROM p WHERE NOT head)) AS overlap FROM p""")
def piece_leaks(spark, sf_dir):
    split = select.holdout(select.index(messages(spark, sf_dir)), 16, SEED).where("split <> 'dropped'")
    p = pack.samples(pack.packed(records(spark, sf_dir), CAP)).join(split.select("rec_id", "prompt_key", "split"), "rec_id")
    n = p.agg(F.count_if(F.col("split") == "head").alias("head_pieces"), F.count_if(F.col("split") == "tail").alias("tail_pieces"))
    return n.join(F.broadcast(select.leaks(p).agg(F.count("*").alias("overlap"))))


# ------------------------------------------------------------- verification
@query(f"""WITH {MSG} SELECT count(*) AS messages, count(*) FILTER (role = 'assistant') AS turns, 0::BIGINT AS render_faults, 0::BIGINT AS token_faults, 0::BIGINT AS mask_faults,
  count(*) FILTER (role = 'assistant') AS prompt_ok, count(*) FILTER (role = 'assistant') AS contiguous, 0::BIGINT AS foreign_scored, count(*) FILTER (role = 'assistant') AS decoded FROM lens""")
def mask_verification(spark, sf_dir):
    m = checkpoint(accepted(spark, sf_dir))
    t = checkpoint(render.tokenized(m))  # checked five times
    n = m.agg(F.count("*").alias("messages"), F.count_if(F.col("role") == "assistant").alias("turns"))
    one = lambda df, name: F.broadcast(df.agg(F.count("*").alias(name)))
    s = verify.scored_spans(t).agg(F.count_if("prompt_ok").alias("prompt_ok"), F.count_if("contiguous").alias("contiguous"), F.count_if(~F.col("assistant")).alias("foreign_scored"), F.count_if("decoded").alias("decoded"))
    faults = n.join(one(verify.render_equal(render.segments(m)), "render_faults")).join(one(verify.tokens_equal(t), "token_faults")).join(one(verify.mask_faults(t), "mask_faults"))
    return faults.join(F.broadcast(s))


@query(f"WITH {split_sql(CAP)} SELECT count(*) AS samples, 0::BIGINT AS faults FROM plan")
def label_invariants(spark, sf_dir):
    s = pack.samples(pack.packed(records(spark, sf_dir), CAP))
    a = pack.assembled(s, render.tokenized(pack.together(accepted(spark, sf_dir))))
    return a.agg(F.count("*").alias("samples")).join(F.broadcast(verify.label_faults(a).agg(F.count("*").alias("faults"))))


@query(f"""WITH {MSG} SELECT rec_id, msg_idx, CAST(9 AS BIGINT) AS first_scored, CAST(own + 1 AS BIGINT) AS n_scored, true AS contiguous FROM lens WHERE role = 'assistant'""")
def contiguity(spark, sf_dir):
    t = render.tokenized(accepted(spark, sf_dir)).select("rec_id", "msg_idx", F.posexplode("labels").alias("i", "label")).where("label <> -100")
    n = t.groupBy("rec_id", "msg_idx").agg(F.min("i").cast("long").alias("first_scored"), F.count("*").alias("n_scored"), F.max("i").alias("last"))
    return n.select("rec_id", "msg_idx", "first_scored", "n_scored", (F.col("last") - F.col("first_scored") + 1 == F.col("n_scored")).alias("contiguous"))


@query(f"""WITH {MSG} SELECT rec_id, msg_idx, CAST(coalesce(sum(n_tok) OVER (PARTITION BY rec_id ORDER BY msg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS starts_at FROM lens""")
def message_offsets(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("rec_id").orderBy("msg_idx").rowsBetween(Window.unboundedPreceding, -1)
    return render.lengths(accepted(spark, sf_dir)).select("rec_id", "msg_idx", F.coalesce(F.sum("n_tok").over(w), F.lit(0)).alias("starts_at"))


@query(f"WITH {MSG} SELECT rec_id, true AS kept, -1::BIGINT AS first_bad FROM msg GROUP BY 1")
def roundtrip_filter(spark, sf_dir):
    text = strip(F.col("content"))
    whole = F.array_join(F.concat(pieces(text), F.array(F.lit(render.END))), "") == F.concat(text, F.lit(render.END))
    return verify.round_trip(messages(spark, sf_dir), whole).na.fill(-1, ["first_bad"])


@query(f"""WITH {MSG}, t AS (SELECT *, role = 'assistant' AND c <> '' AND regexp_matches(c, '[^\\x00-\\x7F]') AS bad FROM msg)
  SELECT rec_id, count(*) FILTER (bad) = 0 AS kept, coalesce(min(msg_idx) FILTER (bad), -1) AS first_bad FROM t GROUP BY 1""")
def roundtrip_ascii(spark, sf_dir):
    """The filter with a tokenizer of 128 characters, which gives back nothing else: conversations in other languages go."""
    text = strip(F.col("content"))
    return verify.round_trip(messages(spark, sf_dir), F.regexp_replace(text, r"[^\x00-\x7F]", "?") == text).na.fill(-1, ["first_bad"])


# -------------------------------------------------------------- consumption
NO = f"WITH {MSG}, s AS (SELECT row_number() OVER (ORDER BY rec_id) - 1 AS sample_no, raw_tokens AS n_tok FROM raw)"


def numbered(spark, sf_dir):
    return global_rank(raw_lengths(spark, sf_dir).select("rec_id", F.col("raw_tokens").alias("n_tok")), "rec_id", name="sample_no").select("sample_no", "n_tok")


@query(f"{NO} SELECT sample_no, CASE WHEN sample_no < (SELECT CASE WHEN count(*) > 4 THEN least(greatest(1, CAST(floor(count(*) * 0.15::DOUBLE) AS BIGINT)), 64) ELSE 0 END FROM s) THEN 'eval' ELSE 'train' END AS part FROM s")
def eval_prefix(spark, sf_dir):
    r = numbered(spark, sf_dir).withColumn("pos", F.col("sample_no"))
    return consume.eval_prefix(r).select("sample_no", "part")


BUCKETS = f"""{NO}, b AS (SELECT *, row_number() OVER (ORDER BY n_tok, sample_no) - 1 AS p, count(*) OVER () AS n FROM s),
  k AS (SELECT sample_no, n_tok, p // 4 AS block, p % 4 AS rank FROM b WHERE p // 4 < n // 4), o AS (SELECT block, row_number() OVER (ORDER BY md5('{SEED}:' || block), block) - 1 AS step FROM (SELECT DISTINCT block FROM k))"""


@query(f"{BUCKETS} SELECT sample_no, n_tok, block, rank, step FROM k JOIN o USING (block)")
def length_buckets(spark, sf_dir):
    return consume.length_buckets(numbered(spark, sf_dir), 4, SEED)


@query(f"{BUCKETS} SELECT rank, count(*) AS n, (SELECT count(*) FROM k) AS total, (SELECT count(*) // 4 * 4 FROM s) AS expected, true AS ok FROM k GROUP BY rank")
def rank_coverage(spark, sf_dir):
    s = numbered(spark, sf_dir)
    per = consume.coverage(consume.length_buckets(s, 4, SEED), s)
    return per.withColumn("expected", F.floor(F.col("expected") / 4) * 4).withColumn("ok", F.col("total") == F.col("expected"))


@query(f"{NO} SELECT sample_no, sample_no % 4 AS rank FROM s")
def strided_shards(spark, sf_dir):
    return consume.strided_shards(numbered(spark, sf_dir).withColumn("pos", F.col("sample_no")), 4).select("sample_no", "rank")


@query(f"{NO} SELECT sample_no, n_tok FROM s WHERE n_tok <= {CAP} ORDER BY n_tok DESC, sample_no LIMIT 1")
def longest_sample(spark, sf_dir):
    return consume.longest(numbered(spark, sf_dir), CAP)


@query(f"""WITH {WHOLE}, b AS (SELECT *, rec_id // 4 AS batch, max(len(ids)) OVER (PARTITION BY rec_id // 4) AS width FROM whole)
  SELECT rec_id, CAST(width AS BIGINT) AS width, CAST(len(ids) AS BIGINT) AS n_real, md5(array_to_string(list_concat(ids, list_transform(range(width - len(ids)), lambda x: 0)), ',')) AS ids_md5,
  md5(array_to_string(list_concat(labels, list_transform(range(width - len(ids)), lambda x: -100)), ',')) AS lab_md5 FROM b""")
def padded_batches(spark, sf_dir):
    every = render.tokenized(accepted(spark, sf_dir)).groupBy("rec_id").agg(F.sort_array(F.collect_list(F.struct("msg_idx", "ids", "labels"))).alias("m"))
    a = every.select("rec_id", F.flatten("m.ids").alias("input_ids"), F.flatten("m.labels").alias("labels"), F.floor(F.col("rec_id") / 4).alias("batch"))
    p = consume.padded(a)
    return p.select("rec_id", F.size("ids").cast("long").alias("width"), F.aggregate("att", F.lit(0).cast("long"), lambda x, y: x + y).alias("n_real"), F.md5(F.array_join("ids", ",").cast("binary")).alias("ids_md5"), F.md5(F.array_join("lab", ",").cast("binary")).alias("lab_md5"))


@query("SELECT conv_id AS rec_id, array_to_string(list_sort(list_distinct(list(least(length(coalesce(text, '')), 600)))), ',') AS lengths FROM conversations GROUP BY 1")
def sweep_lengths(spark, sf_dir):
    x = messages(spark, sf_dir).groupBy("rec_id").agg(F.collect_list(F.length(F.coalesce("content", F.lit("")))).alias("l"))
    return x.select("rec_id", F.array_join(consume.sweep(F.col("l"), F.lit(600)), ",").alias("lengths"))
