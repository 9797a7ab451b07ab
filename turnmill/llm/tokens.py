"""Token counts of whole texts; huge ones in overlapping chunks that are spliced where both sides provably agree."""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow

#: Code points of a chunk and of the overlap that is tried first.
CHUNK, OVERLAP = 65_536, 512
#: Code points that must follow a boundary inside a chunk before it counts as settled: more than any lookahead of the
#: pre-tokeniser (one code point after white space, three in a contraction) and than any added token's string.
MARGIN = 64


def load(path: str):
    """A tokenizers (``.json``) or sentencepiece (``.model``) model; one thread, so that tasks keep to their cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        return t
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def spliceable(tokenizer) -> bool:
    """Whether what follows a pre-token boundary depends on the text after it alone: byte-level, no normaliser."""
    import json

    if not hasattr(tokenizer, "to_str"):
        return False
    spec = json.loads(tokenizer.to_str())
    pre = spec.get("pre_tokenizer") or {}
    return spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and spec.get("post_processor") is None


def boundaries(encoding, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Where pre-tokens begin (code points of the whole text) and the index of each one's first token.

    Offsets of a byte-level token that holds part of a code point span the whole of it, but words begin at code points.
    """
    off = encoding.offsets
    words = encoding.word_ids
    n = len(off)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids = np.fromiter((-1 if x is None else x for x in words), np.int64, n)
    begin = np.fromiter((o[0] for o in off), np.int64, n)
    end = np.fromiter((o[1] for o in off), np.int64, n)
    first = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (begin[1:] >= end[:-1]) & (begin[1:] > begin[:-1]) & (ids[1:] != ids[:-1])))
    # an added token has no word of its own: where it stands, no boundary is claimed
    first = first[ids[first] >= 0]
    return begin[first] + base, first


def count_long(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[int, int]:
    """Tokens of one text, and how often an overlap had to be widened.

    Each chunk but the first begins ``overlap`` code points before the last one's end. A place where a pre-token begins
    in both, at least ``MARGIN`` before the left chunk's end, is a true boundary: the left chunk began at one, so its
    settled boundaries are true, and from a true boundary on the right chunk's tokens are those of the whole text.
    Where there is none, the overlap doubles, at most back to the left chunk's start, and then the left chunk grows.
    """
    total, widened, at, size, n = 0, 0, 0, chunk, len(text)
    while True:  # ``at`` is a true boundary
        end = min(n, at + size)
        left = tokenizer.encode(text[at:end], add_special_tokens=False)
        if end == n:
            return total + len(left.ids), widened
        places, firsts = boundaries(left, at)
        room = min(overlap, end - at)
        while True:
            lo = max(at, end - room)
            right, _ = boundaries(tokenizer.encode(text[lo : min(n, lo + 2 * room)], add_special_tokens=False), lo)
            settled = min(end, lo + 2 * room if lo + 2 * room < n else n + MARGIN) - MARGIN
            common = np.intersect1d(places[(places > max(at, lo)) & (places <= settled)], right, assume_unique=False)
            if len(common) or lo == at:
                break
            room, widened = room * 2, widened + 1
        if len(common):
            cut = int(common[-1])
            total += int(firsts[np.searchsorted(places, cut)])
            at, size = cut, chunk
        else:
            size, widened = size * 2, widened + 1


#: Code points on which every Unicode version agrees about letters, numbers and white space; other texts take no short cut.
SETTLED = [9, 10, 13, *range(0x20, 0x7F), *range(0xA0, 0x250), *range(0x2010, 0x2028)]
#: Entries of a worker's memo of pre-tokens.
MEMO = 400_000


def char_class(kind: str) -> str:
    """The settled code points of a general category, as the inside of a character class."""
    return "".join(re.escape(chr(c)) for c in SETTLED if unicodedata.category(chr(c)).startswith(kind))


def pre_tokens() -> re.Pattern:
    """The byte-level pre-tokeniser's rule, for settled code points."""
    letter, number, space = char_class("L"), char_class("N"), "\\t\\n\\r\\x20\\xa0"
    return re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


class Memo(dict):
    """Tokens of each pre-token; what is missing is encoded by the library itself."""

    def __init__(self, tokenizer) -> None:
        self.tokenizer = tokenizer

    def learn(self, parts: set[str]) -> None:
        new = list(parts)
        for x, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self[x] = len(e)

    def count(self, parts: list[str]) -> int:
        try:
            return sum(map(self.__getitem__, parts))
        except KeyError:
            if len(self) > MEMO:
                self.clear()
            self.learn({x for x in parts if x not in self})
            return sum(map(self.__getitem__, parts))


def counter(path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Callable[[list[str]], list[int]]:
    """Counts for a list of texts as the library itself gives them.

    Byte-level tokenizers without normaliser encode each pre-token by itself, so a memo of pre-tokens gives the same
    count; texts with other code points than ``SETTLED`` or with an added token's string are left to the library.
    """
    t = load(path)
    if not hasattr(t, "encode_batch"):
        return lambda texts: [len(x) for x in t.encode(texts, num_threads=1)] if texts else []
    if not spliceable(t):
        return lambda texts: [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    added = [x.content for x in t.get_added_tokens_decoder().values()]
    odd = re.compile("[^" + "".join(re.escape(chr(c)) for c in SETTLED) + "]" + "".join(f"|{re.escape(x)}" for x in added))
    find, memo = pre_tokens().findall, Memo(t)

    def run(texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        rest = []
        for i, x in enumerate(texts):
            if len(x) > chunk:
                out[i] = count_long(t, x, chunk, overlap)[0]
            elif odd.search(x):
                rest.append(i)
            else:
                out[i] = memo.count(find(x))
        for i, e in zip(rest, t.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = len(e)
        return out

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 1024, text: str = "text", key: str = "doc_id", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``key``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` of every row's whole text, without a shuffle.

    Null and empty texts have no bytes and no tokens. Repeated rows are counted one by one; other columns are not read.
    A tokenizer that normalises first, or has no byte-level pre-tokeniser, gets each text in one piece.
    """

    def run(b: pa.RecordBatch, count) -> pa.RecordBatch:
        texts = [x or "" for x in b.column(1).to_pylist()]
        tokens = count(texts)
        size = [len(x.encode("utf-8", "surrogatepass")) for x in texts]
        return pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array([x > limit for x in tokens], pa.bool_())],
            [key, "n_bytes", "n_tokens", "over_limit"],
        )

    kind = docs.schema[key].dataType.simpleString()
    return map_arrow(docs.select(key, text), run, f"`{key}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean", text, lambda: counter(path, chunk, overlap))
