"""Passages that several documents share, by a sparse suffix array: suffixes at content-selected minimiser places."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOOKUP_ROWS, U, Words, apply, checkpoint, dealt, map_arrow, mix, signed, stash

#: Least words of a repeat; words of the gram that minimisers are chosen by; grams in a minimiser's window.
LEAST, GRAM = 50, 8
#: Contexts of a key (some 250 bytes each) that one task compares together; a key with more is split by longer and longer
#: surroundings. Rows that a task compares at a time, unless a key has more.
HOT = ROWS = 20_000
MULT = U(0xD6E8FEB86659FD93)


def widths(least: int) -> tuple[int, int]:
    """(window, stem): a stretch of ``least`` words has a minimiser at one of its first ``window`` words, so at least ``stem`` words follow it."""
    window = (least - GRAM + 1) // 2 + 4 if least >= 24 else max(1, least - GRAM + 1)
    return window, least - window + 1


def fold(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each place on."""
    g = np.zeros(len(at), U)
    for j in range(n):
        g = g * MULT + hashes[at + j]
    return mix(g)


def minimisers(w: Words, least: int) -> np.ndarray:
    """Places (word indexes) of the leftmost least gram of each window that begins a stretch of ``least`` words in one text."""
    n = len(w.hash)
    if n < least:
        return np.zeros(0, np.int64)
    window, _ = widths(least)
    g = fold(w.hash, np.arange(n - GRAM + 1), GRAM)
    begin = np.flatnonzero(w.doc[: n - least + 1] == w.doc[least - 1 :])
    view = np.lib.stride_tricks.sliding_window_view(g, window)
    return np.unique(begin + view[begin].argmin(1))


def in_row(head: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Stem and row as one number."""
    return head ^ mix(doc.astype(U) + U(77))


def suffixes(docs: DataFrame, least: int, text: str, key: str) -> DataFrame:
    """(stem, page, at, id): each sparse suffix by the hash of its first words, of equal ones in a text the first; and a row (null stem) for each document with its words."""
    _, stem = widths(least)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(b.column(1))
        n = np.bincount(w.doc, minlength=b.num_rows)
        at = minimisers(w, least)
        head = fold(w.hash, at, stem)
        _, once = np.unique(in_row(head, w.doc[at]), return_index=True)  # a text that goes round in circles has few stems
        at, head = at[once], head[once]
        doc = w.doc[at]
        begin = np.searchsorted(w.doc, np.arange(b.num_rows))
        none = pa.nulls(len(at), b.column(0).type)
        cols = [
            pa.concat_arrays([pa.array(signed(head)), pa.nulls(b.num_rows, pa.int64())]),
            pa.concat_arrays([b.column(2).take(pa.array(doc)), b.column(2)]),
            pa.array(np.concatenate([at - begin[doc], n]).astype(np.int32)),
            pa.concat_arrays([none, b.column(0)]),
        ]
        return pa.RecordBatch.from_arrays(cols, ["stem", "page", "at", "id"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("page", F.xxhash64("text"))
    return map_arrow(rows, run, f"stem bigint, page bigint, at int, id {kind}", "text")


def contexts(docs: DataFrame, places: DataFrame, least: int, text: str, key: str) -> DataFrame:
    """(stem, page, left, right, at array): the words around each surviving suffix, equal surroundings in a text once.

    Texts meet their places in a join on the text's hash and the least key that has it, so copies of a text are read once.
    """
    window, stem = widths(least)
    side = window - 1
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("page", F.xxhash64("text"))
    places = places.hint("shuffle_hash")
    joined = rows.join(places, (rows["page"] == places["page"]) & rows["id"].eqNullSafe(places["rep"])).select(rows["page"], "text", "places")

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        w = Words(b.column(1))
        per = b.column(2)
        flat = per.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(b.num_rows), np.diff(per.offsets.to_numpy()))
        begin, end = np.searchsorted(w.doc, np.arange(b.num_rows)), np.searchsorted(w.doc, np.arange(b.num_rows), "right")
        at = begin[doc] + flat
        ok = at + stem <= end[doc]
        wanted = np.unique(in_row(fold(w.hash, at[ok], stem), doc[ok]))
        at = minimisers(w, least)  # all places of a surviving stem, not only its first
        heads, doc = fold(w.hash, at, stem), w.doc[at]
        ok = np.isin(in_row(heads, doc), wanted)
        at, doc, heads = at[ok], doc[ok], heads[ok]
        if not len(at):
            return None
        flat = at - begin[doc]
        short = (w.hash >> U(32)).astype(np.uint32)
        # beyond a text's ends: marks that differ from text to text and from place to place
        odd = mix(np.arange(b.num_rows, dtype=U) + (b.column(0).to_numpy().view(U)))
        around = np.empty((len(at), 2 * side), np.uint32)
        for j in range(side):
            for col, x, good in ((j, at - 1 - j, at - 1 - j >= begin[doc]), (side + j, at + stem + j, at + stem + j < end[doc])):
                around[:, col] = np.where(good, short[np.clip(x, 0, len(short) - 1)], ((odd[doc] + U(col)) >> U(32)).astype(np.uint32))
        ident = np.zeros(len(at), U)
        for j in range(2 * side):
            ident = ident * MULT + around[:, j]
        ident = in_row(mix(ident ^ heads), doc)
        order = np.argsort(ident, kind="stable")
        first = np.flatnonzero(np.append(True, ident[order][1:] != ident[order][:-1]))
        pick = order[first]
        bounds = np.append(first, len(order)).astype(np.int32)
        raw = np.ascontiguousarray(around[pick]).view(np.uint8).reshape(len(pick), -1)
        binary = pa.FixedSizeBinaryArray.from_buffers(pa.binary(raw.shape[1]), len(pick), [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(signed(heads[pick])), b.column(0).take(pa.array(doc[pick])), binary, pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat[order].astype(np.int32)))],
            ["stem", "page", "around", "places"],
        )

    return map_arrow(joined, run, "stem bigint, page bigint, around binary, places array<int>", "text")


def halves(b: pa.RecordBatch, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each number of words and each context: the hashes of the stem with that many words to its left, and to its right."""
    side = widths(least)[0] - 1
    stem = b.column(b.schema.get_field_index("stem")).to_numpy().view(U)
    data = b.column(b.schema.get_field_index("around"))
    around = np.frombuffer(b"".join(data.to_pylist()), np.uint32).reshape(len(stem), 2 * side).astype(U)
    left, right = [mix(stem)], [mix(stem + U(1))]
    for j in range(side):
        left.append(mix(left[-1] * MULT + around[:, j]))
        right.append(mix(right[-1] * MULT + around[:, side + j]))
    return np.stack(left), np.stack(right)


#: Columns of contexts on their way through the comparison: those of one ``key`` agree on the stem, ``k0`` words to its left
#: and ``side - k1`` to its right, and are compared in the alignments that take ``k0`` to ``k1`` words from the left.
KEYED = "key bigint, k0 int, k1 int, stem bigint, page bigint, around binary, places array<int>"
NAMES = [x.split()[0] for x in KEYED.split(", ")]


def compare(rows: DataFrame, least: int, later: bool) -> DataFrame:
    """(page, lo, hi): neighbours in the order of each alignment that agree over ``least`` words and are of different texts.

    A key's rows are compared together, so a task holds those of whole keys, at most about ``ROWS`` rows more than a batch.
    """

    def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        left, right = halves(t, least)
        side = len(left) - 1
        k0, k1, page = (t.column(i).to_numpy() for i in (1, 2, 4))
        hits, ks = [], []
        for k in range(side + 1):
            some = np.flatnonzero((k0 <= k) & (k <= k1))
            if not len(some):
                continue
            h, p = left[k, some] ^ (right[side - k, some] * MULT), page[some]
            order = np.lexsort((p, h))
            hs, ps = h[order], p[order]
            first = np.flatnonzero(np.append(True, hs[1:] != hs[:-1]))
            size = np.diff(np.append(first, len(hs)))
            low, high = np.repeat(ps[first], size), np.repeat(ps[np.append(first[1:], len(hs)) - 1], size)
            hit = some[order[(ps > low) if later else (low != high)]]
            hits.append(hit)
            ks.append(np.full(len(hit), k, np.int32))
        row, k = np.concatenate(hits), np.concatenate(ks)
        if not len(row):
            return None
        places = t.column(6)
        off = places.offsets.to_numpy()
        flat = places.values.to_numpy()
        n = np.diff(off)[row]
        idx = np.repeat(off[row], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return runs(np.repeat(page[row], n), flat[idx] - np.repeat(k, n), least)

    def go(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            while b.num_rows:
                key = b.column(0).to_numpy()
                if held and key[0] != held[-1].column(0)[-1].as_py() and size >= ROWS:
                    out = flush(held)
                    held, size = [], 0
                    if out is not None:
                        yield out
                # as far as the batch's last key begins, if enough is held
                cut = int(np.searchsorted(key, key[-1])) if size + b.num_rows >= ROWS else b.num_rows
                cut = cut or b.num_rows
                held.append(b.slice(0, cut))
                size += cut
                b = b.slice(cut)
        if held:
            out = flush(held)
            if out is not None:
                yield out

    return apply(dealt(rows, "key").select(NAMES), go, "page bigint, lo int, hi int")


def runs(page: np.ndarray, begin: np.ndarray, least: int) -> pa.RecordBatch:
    """Stretches of ``least`` words from each begin on, as few intervals as they make for each text."""
    order = np.lexsort((begin, page))
    page, begin = page[order], begin[order]
    new = np.append(True, (page[1:] != page[:-1]) | (begin[1:] > begin[:-1] + least))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(page)) - 1
    return pa.RecordBatch.from_arrays([pa.array(page[first]), pa.array(begin[first].astype(np.int32)), pa.array((begin[last] + least).astype(np.int32))], ["page", "lo", "hi"])


def split_keys(rows: DataFrame, least: int) -> DataFrame:
    """Each context twice: a stretch takes half of the key's range of left words or more, and so they agree on those, or less, and so they agree on more right ones."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        left, right = halves(b, least)
        side, at = len(left) - 1, np.arange(b.num_rows)
        k0, k1 = b.column(1).to_numpy(), b.column(2).to_numpy()
        mid = (k0 + k1 + 1) // 2
        out = []
        for lo, hi in ((k0, mid - 1), (mid, k1)):
            key, full = (mix(left[x, at] ^ (right[side - y, at] * MULT) ^ mix((lo * (side + 1) + hi).astype(U))) for x, y in ((lo, hi), (hi, lo)))
            out.append(pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), *b.columns[3:7], pa.array(signed(full))], [*NAMES, "full"]))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0]

    return map_arrow(rows.select(*NAMES, "full"), run, f"{KEYED}, full bigint")


def shared_runs(around: DataFrame, least: int, later: bool, hot: int) -> DataFrame:
    """(page, lo, hi) of all contexts. A key of more than ``hot`` is split by halves of its alignments, again and again, each
    half under a key of more words. Before that an aggregate finds contexts that agree in all words the key's alignments take
    (``full``): those share one run, and only the first and last text's go on, so a passage that many texts have costs each
    of them a few rows.
    """
    side = widths(least)[0] - 1
    now = around.select(F.col("stem").alias("key"), F.lit(0).alias("k0"), F.lit(side).alias("k1"), "stem", "page", "around", "places", F.xxhash64("around").alias("full"))
    leaves, out = [], []
    while True:
        many = checkpoint(now.groupBy("key").count().where(F.col("count") > hot).select("key"))
        if many.isEmpty():
            leaves.append(now.select(NAMES))
            break
        if many.count() <= LOOKUP_ROWS:  # then the contexts needn't be shuffled for it
            many = F.broadcast(many)
        leaves.append(now.join(many, "key", "left_anti").select(NAMES))
        rest = now.join(many, "key", "left_semi")
        same = rest.groupBy("key", "full").agg(F.min("page").alias("low"), F.max("page").alias("high")).where("low <> high")
        rest = checkpoint(rest.join(same, ["key", "full"], "left").select(*NAMES, "full", "low", "high"))
        hit = rest.where("page > low" if later else "low IS NOT NULL")
        out.append(hit.select("page", F.explode("places").alias("at"), "k0", "k1").select("page", (F.col("at") - F.col("k1")).alias("lo"), (F.col("at") - F.col("k0") + least).alias("hi")))
        on = rest.where("k0 < k1").where("low IS NULL OR page = low" if later else "low IS NULL OR page = low OR page = high")
        now = checkpoint(split_keys(on, least))
    every = leaves[0]
    for x in leaves[1:]:
        every = every.unionByName(x)
    spans = compare(every, least, later)
    for x in out:
        spans = spans.unionByName(x)
    return spans


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def repeats(docs: DataFrame, least: int = LEAST, later: bool = False, hot: int = HOT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, first_word, end_word, n_words): the words of each document that lie in a stretch of ``least`` words or more
    which a document with another text has too, as maximal runs; texts that several keys have repeat as a whole.

    ``later``: only where the other text comes first in the order of text hashes (and of keys, for equal texts), so that
    removing the runs leaves each passage once. Words are runs of other characters than white space, compared as they are.
    Null and empty texts and texts under ``least`` words have no runs. Rows that repeat key and text are one document;
    repeats inside one text alone don't count. A key without runs has no row. Contexts beyond the stem are compared by 32
    bits a word, stems by 64. An empty table gives an empty result.
    """
    if least < GRAM:
        raise ValueError(f"least must be {GRAM} or more")
    found = stash(suffixes(docs, least, text, key))
    pages = found.where("stem IS NULL").select(F.col("id").alias(key), "page", F.col("at").alias("words")).distinct()
    sparse = found.where("stem IS NOT NULL").select("stem", "page", "at")
    shared = sparse.groupBy("stem").agg(F.min("page").alias("lo"), F.max("page").alias("hi")).where("lo <> hi").select("stem")
    places = sparse.join(shared, "stem", "left_semi").groupBy("page").agg(F.collect_set("at").alias("places"))
    places = places.join(pages.groupBy("page").agg(F.min(key).alias("rep")), "page")
    around = checkpoint(contexts(docs, places, least, text, key))
    spans = shared_runs(around, least, later, hot)
    copies = pages.groupBy("page").agg(F.min(key).alias("least"), F.max(key).alias("most"), F.max("words").alias("words")).where(F.col("words") >= least).where("least <> most")
    by_page = spans.groupBy("page").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans"))
    joined = by_page.join(copies, "page", "full").select("page", "spans", "least", "words")
    rows = pages.select(key, "page").join(joined, "page")
    whole = F.col("least").isNotNull() & (F.col(key).isNull() | (F.col(key) > F.col("least")) if later else F.lit(True))

    def join_up(b: pa.RecordBatch) -> pa.RecordBatch:
        at, lo, hi = [], [], []
        for i, (spans_, words) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
            for x, y in [(0, words)] if words is not None else merged([(s["lo"], s["hi"]) for s in spans_ or []]):
                at.append(i)
                lo.append(x)
                hi.append(y)
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array([y - x for x, y in zip(lo, hi, strict=True)], pa.int64())], [key, "first_word", "end_word", "n_words"])

    kind = docs.schema[key].dataType.simpleString()
    return map_arrow(rows.select(key, "spans", F.when(whole, F.col("words")).alias("words")), join_up, f"`{key}` {kind}, first_word bigint, end_word bigint, n_words bigint")


def without_repeats(docs: DataFrame, least: int = LEAST, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with each repeated passage cut from all documents but one; other words and the white space between stay."""
    import re

    spans = checkpoint(repeats(docs, least, later=True, text=text, key=key).groupBy(key).agg(F.collect_list(F.struct("first_word", "end_word")).alias("__spans")))
    names = docs.columns
    rows = docs.join(spans.withColumnRenamed(key, "__key"), docs[key].eqNullSafe(F.col("__key")), "left").select(*names, "__spans")
    at = names.index(text)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for t, spans_ in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
            if t and spans_:
                words = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
                keep, last = [], 0
                for s in sorted((x["first_word"], x["end_word"]) for x in spans_):
                    if s[1] <= len(words):
                        keep.append(t[last : words[s[0]][0]])
                        last = words[s[1] - 1][1]
                t = "".join([*keep, t[last:]])
            out.append(t)
        cols = list(b.columns[:-1])
        cols[at] = pa.array(out, b.schema.field(at).type)
        return pa.RecordBatch.from_arrays(cols, names)

    return map_arrow(rows, run, docs.schema, text)


def oracle(table: str, least: int = LEAST) -> str:
    """DuckDB SQL of ``repeats``: the text of every window of ``least`` words. For small tables."""
    return f"""
WITH d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS t FROM {table}),
t AS (SELECT t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, min(doc_id) <> max(doc_id) AS copies FROM d GROUP BY t),
win AS (SELECT t, k, array_to_string(w[k + 1:k + {least}], ' ') AS g FROM (SELECT t, w, unnest(range(0, len(w) - {least - 1})) AS k FROM t WHERE len(w) >= {least})),
hit AS (SELECT t, k FROM win JOIN (SELECT g FROM win GROUP BY g HAVING min(t) <> max(t)) USING (g)),
cut AS (SELECT t, k, sum(CASE WHEN k > before + {least} THEN 1 ELSE 0 END) OVER (PARTITION BY t ORDER BY k) AS run
  FROM (SELECT t, k, lag(k) OVER (PARTITION BY t ORDER BY k) AS before FROM hit)),
runs AS (SELECT t, min(k) AS lo, max(k) + {least} AS hi FROM cut GROUP BY t, run),
every AS (
  SELECT t, lo, hi FROM runs JOIN t USING (t) WHERE NOT coalesce(copies, false)
  UNION ALL SELECT t, 0, len(w) FROM t WHERE copies AND len(w) >= {least})
SELECT doc_id, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS end_word, CAST(hi - lo AS BIGINT) AS n_words FROM d JOIN every USING (t)
"""
