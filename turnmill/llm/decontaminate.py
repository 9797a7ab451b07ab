"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman alignment scores them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import PUNCT, U, Words, checkpoint, map_arrow, mix

#: Words of a seed; a seed is rare if at most this share of the documents (and this many, in a small corpus) have it.
SEED, RARE_SHARE, RARE_LEAST = 4, 1e-4, 20
#: Alignment: a word pair that agrees, one that doesn't, a word left out.
MATCH, MISMATCH, GAP = 2, -1, -1
#: Items are taken to the documents in blocks of about this many bytes of text.
BLOCK_BYTES = 4 << 20


def normal(col: pa.Array) -> Words:
    """Words in lower case without ASCII punctuation."""
    return Words(pc.utf8_lower(col.cast(pa.large_string()).fill_null("")), PUNCT)


class Items:
    """A block of test items: words, seeds (sorted hashes with their items and places) and lookups by seed."""

    def __init__(self, ids: list, texts: list[str], size: int = SEED) -> None:
        w = normal(pa.array(texts, pa.string()))
        self.ids, self.size = ids, size
        cut = np.searchsorted(w.doc, np.arange(len(ids) + 1))
        self.words = [w.hash[cut[i] : cut[i + 1]] for i in range(len(ids))]
        grams, at = w.grams(size)
        item, place = w.doc[at], at - cut[w.doc[at]]
        order = np.argsort(grams, kind="stable")
        self.grams, self.item, self.place = grams[order], item[order], place[order]
        self.seeds = np.unique(self.grams)
        self.known = np.unique(w.hash)
        self.short: dict[int, list[int]] = {}
        for i, x in enumerate(self.words):
            if 0 < len(x) < size:
                self.short.setdefault(len(x), []).append(i)


def member(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), bool)
    at = np.searchsorted(sorted_, x)
    at[at == len(sorted_)] = 0
    return sorted_[at] == x


def seed_hits(w: Words, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of the block found in the words: (index of the first word, seed hash). Words that no item has rule most out."""
    n = items.size
    if len(w.hash) < n or not len(items.seeds):
        return np.zeros(0, np.int64), np.zeros(0, U)
    bits = filter_bits(items)
    known = bits[(w.hash >> U(40)).astype(np.int64)]
    m = len(w.hash) - n + 1
    ok = known[:m].copy()
    for j in range(1, n):
        ok &= known[j : j + m]
    ok &= w.doc[:m] == w.doc[n - 1 :]
    at = np.flatnonzero(ok)
    g = np.zeros(len(at), U)
    for j in range(n):
        g = g * U(0xD6E8FEB86659FD93) + w.hash[at + j]
    g = mix(g)
    hit = member(items.seeds, g)
    return at[hit], g[hit]


def filter_bits(items: Items) -> np.ndarray:
    """Which leading 24 bits the hashes of the items' words have."""
    if not hasattr(items, "bits"):
        items.bits = np.zeros(1 << 24, bool)
        items.bits[(items.known >> U(40)).astype(np.int64)] = True
    return items.bits


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of item ``a`` in passage ``b``: (score, first and past-last word of ``b``).

    Row by row; a gap along the row is a running maximum. The begin of the best path is carried along.
    """
    m = len(b)
    steps = np.arange(m + 1) * GAP
    prev, begin = np.zeros(m + 1, np.int64), np.arange(m + 1)
    best = (0, 0, 0)
    for x in a:
        diag = np.where(b == x, MATCH, MISMATCH) + prev[:-1]
        up = prev[1:] + GAP
        cur = np.maximum(np.maximum(diag, up), 0)
        start = np.where(cur == 0, np.arange(1, m + 1), np.where(cur == diag, begin[:-1], begin[1:]))
        cur, start = np.append(0, cur), np.append(0, start)
        lifted = cur - steps
        run = np.maximum.accumulate(lifted)
        came = np.maximum.accumulate(np.where(lifted == run, np.arange(m + 1), 0))
        prev = run + steps
        begin = np.where(prev > cur, start[came], start)
        k = int(prev.argmax())
        if prev[k] > best[0]:
            best = (int(prev[k]), int(begin[k]), k)
    return best


def windows(at: np.ndarray, place: np.ndarray, length: int, n: int, doc_len: int) -> list[tuple[int, int]]:
    """Stretches of a document where an item of ``length`` words may lie, from seeds' places; touching ones are one."""
    slack = length // 2 + 4
    lo = np.maximum(0, at - place - slack)
    hi = np.minimum(doc_len, at - place + length + slack)
    out: list[list[int]] = []
    for a, b in sorted(zip(lo.tolist(), hi.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[Items]:
    """The test items in blocks of bounded bytes. Items are a stated query set; equal rows are one."""
    rows = benchmark.select(F.col(item).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t")).distinct().orderBy("i", "t").toLocalIterator()
    ids, texts, size = [], [], 0
    for r in rows:
        ids.append(r[0])
        texts.append(r[1])
        size += len(r[1])
        if size >= BLOCK_BYTES:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Items(ids, texts)


def seed_frequencies(docs: DataFrame, items: Items, text: str) -> DataFrame:
    """(seed, docs): in how many documents each seed of the block occurs, over all of them."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        w = normal(b.column(0))
        at, g = seed_hits(w, items)
        seed, n = np.unique(np.unique(np.stack([g, w.doc[at].astype(U)]), axis=1)[0], return_counts=True) if len(g) else (g, np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array(n.astype(np.int64))], ["seed", "docs"])

    return map_arrow(docs.select(text), run, "seed bigint, docs bigint", text).groupBy("seed").agg(F.sum("docs").alias("docs"))


def matches(docs: DataFrame, items: Items, rare: np.ndarray, threshold: float, text: str, key: str, kind_of_item: T.DataType) -> DataFrame:
    """(key, item, score, first word, past-last word) of every alignment that reaches the threshold, in one pass."""
    is_rare = member(rare, items.grams)

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        w = normal(b.column(1))
        at, g = seed_hits(w, items)
        rows: list[tuple] = []
        cut = np.searchsorted(w.doc, np.arange(b.num_rows + 1))
        if len(at):
            lo, hi = np.searchsorted(items.grams, g, "left"), np.searchsorted(items.grams, g, "right")
            reps = hi - lo
            idx = np.repeat(lo, reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
            pos, doc = np.repeat(at, reps), np.repeat(w.doc[at], reps)
            pair = doc * len(items.ids) + items.item[idx]
            order = np.argsort(pair, kind="stable")
            pair, pos, idx = pair[order], pos[order], idx[order]
            edges = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
            for s, e in zip(edges, [*edges[1:], len(pair)], strict=True):
                d, i = divmod(int(pair[s]), len(items.ids))
                a, words, common = items.words[i], w.hash[cut[d] : cut[d + 1]], not is_rare[idx[s:e]].any()
                best = (0.0, 0, 0)
                for x, y in windows(pos[s:e] - cut[d], items.place[idx[s:e]], len(a), items.size, len(words)):
                    # no rare seed: only if the window has words enough; a score is at most the share of the item's words there
                    if common and np.isin(a, words[x:y]).mean() < threshold:
                        continue
                    score, f, t = align(a, words[x:y])
                    best = max(best, (score / (MATCH * len(a)), x + f, x + t), key=lambda z: (z[0], -z[1]))
                if best[0] >= threshold:
                    rows.append((d, i, *best))
        for n, short in items.short.items():  # items under a seed's length: whole, exact
            grams, first = w.grams(n)
            for i in short:
                h = np.zeros(1, U)
                for x in items.words[i]:
                    h = h * U(0xD6E8FEB86659FD93) + x
                hit = first[grams == mix(h)[0]]
                _, k = np.unique(w.doc[hit], return_index=True)
                rows += [(int(w.doc[f]), i, 1.0, int(f - cut[w.doc[f]]), int(f - cut[w.doc[f]]) + n) for f in hit[k]]
        if not rows:
            return None
        d = [r[0] for r in rows]
        return pa.RecordBatch.from_arrays(
            [b.column(0).take(pa.array(d)), pa.array([items.ids[r[1]] for r in rows], item_type), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64())],
            [key, "item_id", "score", "first_word", "end_word"],
        )

    item_type, item_sql = to_arrow_type(kind_of_item), kind_of_item.simpleString()
    kind = docs.schema[key].dataType.simpleString()
    return map_arrow(docs.select(key, text), one, f"`{key}` {kind}, item_id {item_sql}, score double, first_word bigint, end_word bigint", text)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Every document and test item whose best alignment scores at least ``threshold`` of the item's perfect score.

    Two passes over ``docs`` for each block of items, no shuffle of texts: the first counts in how many documents each seed
    occurs, the second aligns documents that share a rare seed with an item, or a common one beside enough of its words to
    reach the threshold.
    Words are compared in lower case without ASCII punctuation. Null and empty texts have no words and match nothing;
    items under ``SEED`` words match exactly. Repeated documents each get their rows; repeated items with one id are one.
    A document may match several items; ``item_id`` has the benchmark's type. Empty tables give an empty result.
    """
    kind = docs.schema[key].dataType.simpleString()
    out = None
    n_docs = None
    for items in blocks(benchmark, item, item_text):
        if n_docs is None:
            n_docs = docs.count()
        # as many rows as the block has seeds, so bounded by BLOCK_BYTES
        common = seed_frequencies(docs, items, text).where(F.col("docs") > max(RARE_LEAST, RARE_SHARE * n_docs)).select("seed").toArrow().column(0).to_numpy()
        rare = np.setdiff1d(items.seeds, np.sort(common.astype(np.int64).view(U)))
        part = matches(docs, items, rare, threshold, text, key, benchmark.schema[item].dataType)
        out = part if out is None else out.unionByName(part)
    if out is None:
        item_sql = benchmark.schema[item].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"`{key}` {kind}, item_id {item_sql}, score double, first_word bigint, end_word bigint")
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents that no test item aligns with; the found keys are few next to the texts and go through a checkpoint."""
    bad = checkpoint(contaminated(docs, benchmark, threshold, text, key).select(F.col(key).alias("__bad")).distinct())
    return docs.join(bad, docs[key].eqNullSafe(bad["__bad"]), "left_anti")
