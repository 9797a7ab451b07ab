"""Two tokenizers' tokens of the same bytes: cut where both end a token, count which ids share a cut's bytes, corpus-wide."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOOKUP_ROWS, map_arrow, stash, text_bytes
from .tokens import MEMO, SETTLED, load

#: Links that are held at once; groups with more are taken apart by ranges of A's ids.
LINKS = 1 << 20
#: Bytes of text that a kernel call holds, unless a single row is longer: some twenty numbers a byte are held for it at once.
SLICE = 1 << 20
#: Unknown words that are encoded as one text.
JOINED = 200
#: Bits of B's ids in a pair, and of A's.
BITS = 20
SPECIAL = re.compile(r"<0x([0-9A-F]{2})>")


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies: themselves where printable, else from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Side:
    """A tokenizer, the bytes of each of its tokens, and ids for lists of texts, special strings taken as plain text."""

    def __init__(self, path: str) -> None:
        self.model = load(path)
        self.byte_level = hasattr(self.model, "to_str")
        if self.byte_level:
            self.model.encode_special_tokens = True
            code = byte_alphabet()
            vocab = self.model.get_vocab(with_added_tokens=True)
            self.tokens = [b""] * (max(vocab.values()) + 1)
            for piece, i in vocab.items():
                self.tokens[i] = bytes(code[c] for c in piece) if all(c in code for c in piece) else piece.encode()
        else:
            m = self.model
            pieces = [m.id_to_piece(i) for i in range(m.vocab_size())]
            self.tokens = [bytes([int(SPECIAL.fullmatch(x)[1], 16)]) if m.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(pieces)]
        if len(self.tokens) > 1 << BITS:
            raise ValueError(f"{path}: more than {1 << BITS} ids")
        self.size = np.array([len(x) for x in self.tokens], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)

    def encode(self, texts: list[str]) -> list[list[int]]:
        if not texts:
            return []
        if self.byte_level:
            return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        return self.model.encode(texts, num_threads=1)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        ends = np.cumsum(size)
        n = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.begin[ids] - (ends - size), size) + np.arange(n)]


class Pair:
    """Ids by both tokenizers for whole batches. Where neither can join anything across the start of white space, a text is taken
    word by word from a memo that the libraries themselves fill; other texts go to them whole.

    The first tokenizer gets a space before the text; the second one adds it itself. A word is white space and what follows up
    to the next. The first's pre-tokens never go on from other characters into white space; that the second's pieces don't is
    checked on its vocabulary.
    """

    def __init__(self, a: str, b: str) -> None:
        self.a, self.b = Side(a), Side(b)
        self.table = spellings(max(len(self.a.tokens), len(self.b.tokens)))
        self.words: dict[str, int] = {}
        self.fill()
        spec = json.loads(self.a.model.to_str()) if self.a.byte_level else {}
        pre = spec.get("pre_tokenizer") or {}
        plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        space = [c for c in map(chr, SETTLED) if c.isspace()]
        joins = re.compile("(?<=[^\\s▁])[\\s▁]")
        crossing = set() if self.b.byte_level else {c for i in range(self.b.model.vocab_size()) for c in joins.findall(self.b.model.id_to_piece(i))}
        self.space = [c for c in space if c not in crossing]
        alone = not self.b.byte_level and [self.b.model.id_to_piece(i) for i in self.b.model.encode("a\na")] == ["▁a", "<0x0A>", "a"]
        self.memo = plain and alone and "▁" not in crossing
        settled = [c for c in map(chr, SETTLED) if c not in space or c in self.space]
        added = [x.content for x in self.a.model.get_added_tokens_decoder().values() if not x.special] if self.a.byte_level else []
        self.odd = re.compile("[^" + "".join(map(re.escape, settled)) + "]" + "".join(f"|{re.escape(x)}" for x in added))
        blank = "".join(map(re.escape, self.space))
        self.cut = re.compile(f"[{blank}]+[^{blank}]*").findall

    def fill(self) -> None:
        self.words.clear()
        self.flat: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64)]  # ids of all known words, each side
        self.off: list[np.ndarray] = [np.zeros(1, np.int64), np.zeros(1, np.int64)]

    def learn(self, new: list[str]) -> None:
        """Both tokenizers' ids of words, ``JOINED`` at a time end to end: a word's start ends a token on either side. White space alone
        would run into the next word, so it comes last and by itself. The second tokenizer reads the words after a letter, which is
        then a token of its own."""
        blank = [x for x in new if x.isspace()]
        new = [x for x in new if not x.isspace()]
        chunks = ["".join(new[i : i + JOINED]) for i in range(0, len(new), JOINED)]
        whole = len(chunks)
        chunks += blank
        size = np.cumsum(np.fromiter((len(x.encode()) for x in new), np.int64, len(new)))
        for k, (side, lists) in enumerate(((self.a, self.a.encode(chunks)), (self.b, [x[1:] for x in self.b.encode(["a" + x for x in chunks])]))):
            ids = np.fromiter(chain.from_iterable(lists[:whole]), np.int64)
            ends = np.cumsum(side.size[ids])
            at = np.searchsorted(ends, size) + 1 if len(new) else size
            if len(new) and (ends[at - 1] != size).any():
                raise RuntimeError("a token runs over the start of a word")
            n = np.concatenate([np.diff(at, prepend=0), np.array([len(x) for x in lists[whole:]], np.int64)])
            self.flat[k] = np.concatenate([self.flat[k], ids, *(np.array(x, np.int64) for x in lists[whole:])])
            self.off[k] = np.concatenate([self.off[k], self.off[k][-1] + np.cumsum(n)])
        at = len(self.words)
        self.words.update(zip(new + blank, range(at, at + len(new) + len(blank)), strict=True))

    def ids(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each side: all ids end to end, and how many each text has."""
        rest = [i for i, x in enumerate(texts) if x and (not self.memo or self.odd.search(x))]
        skip = set(rest)
        parts = [[] if i in skip or not x else self.cut(" " + x) for i, x in enumerate(texts)]
        if len(self.words) > MEMO:
            self.fill()
        new = set().union(*parts) - self.words.keys()
        if new:
            self.learn(list(new))
        n = np.array([len(p) for p in parts], np.int64)
        at = np.fromiter(map(self.words.__getitem__, chain.from_iterable(parts)), np.int64, int(n.sum()))
        owner = np.repeat(np.arange(len(texts)), n)
        whole = (self.a.encode([" " + texts[i] for i in rest]), self.b.encode([texts[i] for i in rest]))
        out, counts = [], []
        for side in (0, 1):
            off, flat = self.off[side], self.flat[side]
            size = off[at + 1] - off[at]
            ends = np.cumsum(size)
            ids = flat[np.repeat(off[at] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
            count = np.bincount(owner, size, len(texts)).astype(np.int64)
            if rest:
                pieces = np.split(ids, np.cumsum(count)[:-1])
                for i, x in zip(rest, whole[side], strict=True):
                    pieces[i], count[i] = np.array(x, np.int64), len(x)
                ids = np.concatenate(pieces)
            out.append(ids)
            counts.append(count)
        return out, counts


def equal_rows(raw: np.ndarray, off: np.ndarray, made: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether each row's bytes are those made for it."""
    ok = np.diff(off) == size
    begin = np.cumsum(size) - size
    keep = np.flatnonzero(ok & (size > 0))
    if len(keep):
        n = size[keep]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        same = raw[np.repeat(off[keep], n) + step] == made[np.repeat(begin[keep], n) + step]
        ok[keep] = np.logical_and.reduceat(same, np.cumsum(n) - n)
    return ok


def spellings(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of the numbers below n, flush right in seven bytes before one for a sign, and how many each has."""
    ids = np.arange(n)
    width = np.ones(n, np.int64)
    cells = np.full((n, 8), 48, np.uint8)
    for k in range(7):
        width += ids >= 10 ** (k + 1)
        cells[:, 6 - k] += (ids // 10**k % 10).astype(np.uint8)
    return cells, width


def spelled(ids: np.ndarray, sign: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Decimal ids, each followed by its sign, as bytes, and how many bytes each takes."""
    cells, width = table[0][ids], table[1][ids]
    cells[:, 7] = sign
    return cells[np.arange(8) >= (7 - width)[:, None]], width + 1


def aligned(texts: pa.Array, pair: Pair) -> dict:
    """A batch's documents end to end: tokens of both sides, the group of each token, groups of each document.

    One bincount of each side's token ends over the batch's bytes; a group ends where both counts are above zero, and prefix
    sums of these places number the groups. A document that one side doesn't give back byte for byte has no tokens.
    """
    raw, off = text_bytes(texts)
    docs = len(texts)
    strings = [x or "" for x in texts.to_pylist()]
    (a, b), (na, nb) = pair.ids(strings)
    filled = np.diff(off) > 0
    led = np.insert(raw, off[:-1][filled], 0x20)  # the space before each text
    led_off = off + np.concatenate([[0], np.cumsum(filled)])
    ok = filled.copy()
    for side, ids, n in ((pair.a, a, na), (pair.b, b, nb)):
        size = np.bincount(np.repeat(np.arange(docs), n), side.size[ids], docs).astype(np.int64)
        ok &= equal_rows(led, led_off, side.bytes_of(ids), size)
    length = np.where(ok, np.diff(led_off), 0)
    base = np.concatenate([[0], np.cumsum(length)])
    sides = []
    for side, ids, n in ((pair.a, a, na), (pair.b, b, nb)):
        ids = ids[np.repeat(ok, n)]
        sides.append((ids, np.cumsum(side.size[ids]), np.where(ok, n, 0)))
    total = int(base[-1])
    both = (np.bincount(sides[0][1], minlength=total + 1) > 0) & (np.bincount(sides[1][1], minlength=total + 1) > 0)
    number = np.cumsum(both)  # groups that end at or before a byte
    groups = [number[ends - 1] for _, ends, _ in sides]
    return {"a": sides[0][0], "b": sides[1][0], "n_a": sides[0][2], "n_b": sides[1][2], "g_a": groups[0], "g_b": groups[1], "n_groups": np.diff(number[base]), "groups": int(number[-1]) if len(number) else 0}


def spelled_groups(x: dict, table: tuple[np.ndarray, np.ndarray]) -> list[str]:
    """Per document: SHA-256 of ``a1,a2|b1;a3|b2,b3``; empty without tokens."""
    ids = np.empty(len(x["a"]) + len(x["b"]), np.int64)
    sign = np.empty(len(ids), np.uint8)
    starts = [np.searchsorted(x[g], np.arange(x["groups"] + 1)) for g in ("g_a", "g_b")]
    for side, group, other, end in (("a", x["g_a"], starts[1][x["g_a"]], "|"), ("b", x["g_b"], starts[0][x["g_b"] + 1], ";")):
        place = np.arange(len(group)) + other  # behind the other side's tokens of the groups before
        ids[place] = x[side]
        sign[place] = np.where(np.append(group[1:] != group[:-1], True), ord(end), ord(",")) if len(group) else 0
    text, width = spelled(ids, sign, table)
    upto = np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], np.cumsum(x["n_a"] + x["n_b"])])]
    whole = text.tobytes()
    return [hashlib.sha256(whole[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]


def distinct(doc: np.ndarray, key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of weights by (document, key), in their order."""
    if not len(doc):
        return doc, key, weight
    if int(doc.max()) < 1 << 22:
        both = (doc << 2 * BITS) | key
        order = np.argsort(both)
        both = both[order]
        first = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
    else:
        order = np.lexsort((key, doc))
        d, k = doc[order], key[order]
        first = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (k[1:] != k[:-1])))
    at = order[first]
    return doc[at], key[at], np.add.reduceat(weight[order], first)


def links(x: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, id pair, occurrence pairs) of all links of a batch, at most about ``LINKS`` at a time.

    Equal ids of a group are counted first. Where there are more links they come by ranges of A's ids, so that each pair of a document is in
    one part; a single id's links are at most B's ids times the groups that have it.
    """
    doc_of = np.repeat(np.arange(len(x["n_groups"])), x["n_groups"])
    ga, a, wa = distinct(x["g_a"], x["a"], np.ones(len(x["a"]), np.int64))
    gb, b, wb = distinct(x["g_b"], x["b"], np.ones(len(x["b"]), np.int64))
    begin = np.searchsorted(gb, np.arange(x["groups"] + 1))
    fan = begin[ga + 1] - begin[ga]
    parts = [np.arange(len(a))]
    if fan.sum() > LINKS:
        order = np.argsort(a, kind="stable")
        ids, at = np.unique(a[order], return_index=True)
        room = np.add.reduceat(fan[order], at)
        part = np.cumsum(room) // LINKS
        cuts = at[np.flatnonzero(np.append(True, part[1:] != part[:-1]))]
        parts = np.split(order, cuts[1:])
    for rows in parts:
        n = fan[rows]
        ends = np.cumsum(n)
        left = np.repeat(rows, n)
        right = np.repeat(begin[ga[rows]] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
        yield distinct(doc_of[ga[left]], (a[left] << BITS) | b[right], wa[left] * wb[right])


def encoded(docs: DataFrame, a: str, b: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row a document (``__row`` its number): counts and digest; and its distinct pairs with their links, in one row or, of huge
    groups, several more of the same number without counts."""
    x = docs.select(F.monotonically_increasing_id().alias("__row"), F.col(key), F.col(text))
    names = ["__row", key, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def run(batch: pa.RecordBatch, pair: Pair) -> pa.RecordBatch:
        x = aligned(batch.column(2), pair)
        n = batch.num_rows
        digests = spelled_groups(x, pair.table)
        parts = list(links(x))
        total = np.zeros(n, np.int64)
        for doc, _, times in parts:
            np.add.at(total, doc, times)
        out = []
        for i, (doc, pairs, times) in enumerate(parts):
            count = np.bincount(doc, minlength=n)
            rows = np.arange(n) if not i else np.flatnonzero(count)
            offsets = pa.array(np.concatenate([[0], np.cumsum(count[rows])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (pairs, times)]
            if not i:
                own = [*(pa.array(v.astype(np.int64)) for v in (x["n_a"], x["n_b"], x["n_groups"], total)), pa.array(digests)]
            else:
                own = [*(pa.nulls(len(rows), pa.int64()) for _ in range(4)), pa.nulls(len(rows), pa.string())]
            take = pa.array(rows)
            out.append(pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *own, *lists], names))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0]

    kind = docs.schema[key].dataType.simpleString()
    return map_arrow(x, run, f"__row bigint, `{key}` {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<bigint>", text, lambda: Pair(a, b), SLICE)


def cross_alignment(docs: DataFrame, a: str, b: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: ``n_a``, ``n_b`` tokens, ``n_groups``, ``n_links``, ``n_best`` (links whose pair's count is the highest of its A id),
    ``count_sum`` (counts over links) and ``groups_sha256``.

    Null and empty texts, and texts that either tokenizer doesn't give back byte for byte, have zeros and an empty digest.
    Repeated rows are documents of their own; other columns aren't read. Texts are encoded once and never shuffled: a document's
    distinct pairs go to the shared folder. A pair's count comes from a map-side aggregate. Pairs that more than their share of
    rows have (total / ``LOOKUP_ROWS``, so at most that many pairs) are broadcast with their counts, so a pair of every document is never a
    key of a shuffle; the others meet their counts in a join whose keys have at most that share each.
    """
    held = stash(encoded(docs, a, b, text, key))
    seen = held.select("__row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("__row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    counts = stash(seen.groupBy("pair").agg(F.count("*").alias("n")))
    size = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    top = counts.groupBy(F.shiftright("pair", BITS).alias("a")).agg(F.max("n").alias("most"))
    # ``top`` has a row an id of A, at most 2^BITS
    ranked = stash(counts.withColumn("a", F.shiftright("pair", BITS)).join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))
    share = F.greatest(F.lit(size) / LOOKUP_ROWS, F.lit(1.0))
    common = F.broadcast(ranked.where(F.col("n") > share))
    known = seen.join(common, "pair", "left")
    sums = (F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    first = known.where("n IS NOT NULL").groupBy("__row").agg(*sums)
    second = known.where("n IS NULL").drop("n", "best").join(ranked.where(F.col("n") <= share), "pair").groupBy("__row").agg(*sums)
    zero = F.lit(0).cast("long")
    own = held.where("n_a IS NOT NULL").select("__row", key, "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    per = first.unionByName(second).groupBy("__row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return own.join(per, "__row", "left").select(F.col(key), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
