"""A lossless regular-expression tokenizer in native functions, and the protocol for others."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = "(?s)[A-Za-z0-9]+|[^A-Za-z0-9]"
IGNORE = -100


class Tokenizer(Protocol):
    def encode_batch(self, texts: list[str]) -> list[list[int]]: ...

    def decode(self, ids: list[int]) -> str: ...


def pieces(text: Column) -> Column:
    """The tokens of a text as strings; joined they are the text."""
    return F.when(F.length(text) > 0, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def n_pieces(text: Column) -> Column:
    return F.regexp_count(text, F.lit(PATTERN))


def token_id(piece: Column) -> Column:
    """First 32 bits of the token's MD5. Collisions are possible, so decoding goes by the strings."""
    return F.conv(F.substring(F.md5(piece.cast("binary")), 1, 8), 16, 10).cast("bigint")


def encoder(load: Callable[[], Tokenizer]) -> Callable[[Column], Column]:
    """An Arrow-batched encoder column function for another tokenizer; ``load`` runs once in each worker."""
    held: list[Tokenizer] = []

    @F.pandas_udf("array<bigint>")
    def encode(texts: pd.Series) -> pd.Series:
        if not held:
            held.append(load())
        return pd.Series(held[0].encode_batch(texts.fillna("").tolist()))

    return encode


def round_trips(load: Callable[[], Tokenizer], end: str) -> Callable[[Column], Column]:
    """Whether decoding the encoded text with the end marker gives it back."""
    held: list[Tokenizer] = []

    @F.pandas_udf("boolean")
    def check(texts: pd.Series) -> pd.Series:
        if not held:
            held.append(load())
        want = [(t or "") + end for t in texts]
        return pd.Series([held[0].decode(ids) == w for ids, w in zip(held[0].encode_batch(want), want, strict=True)])

    return check


def from_file(path: str) -> Callable[[], Tokenizer]:
    """A loader of a tokenizer file, ``.json`` or ``.model``, without begin, end or added special tokens. It travels by value."""

    def load() -> Tokenizer:
        class File:
            def __init__(self) -> None:
                if path.endswith(".model"):
                    import sentencepiece

                    t = sentencepiece.SentencePieceProcessor(model_file=path)
                    self.encode_batch, self.decode, self.offsets = lambda texts: t.encode(texts), lambda ids: t.decode(ids), None
                else:
                    import tokenizers

                    t = tokenizers.Tokenizer.from_file(path)
                    t.no_truncation()
                    t.no_padding()
                    self.encode_batch = lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
                    self.decode = lambda ids: t.decode(ids, skip_special_tokens=False)
                    self.offsets = lambda text: [o[0] for o in t.encode(text, add_special_tokens=False).offsets]

        return File()

    return load


ENCODED = "ids array<int>, labels array<int>, whole boolean, prompt boolean, decoded boolean"


def segment_encoder(load: Callable[[], Tokenizer], prompt: str) -> Callable[[Column, Column], Column]:
    """Ids and labels of a message from its segments' texts and which of them are scored, and three checks: the joined text
    has the same ids (no token crosses a cut), what is masked before the scored ids is the encoded ``prompt``, and the
    scored ids decode to the scored text."""
    held: list[Tokenizer] = []
    ignore = IGNORE

    @F.pandas_udf(ENCODED)
    def encode(texts: pd.Series, scored: pd.Series) -> pd.DataFrame:
        if not held:
            held.append(load())
        t = held[0]
        flat = [x for row in texts for x in row]
        each = iter(t.encode_batch(flat))
        wholes = t.encode_batch(["".join(row) for row in texts])
        prefix = t.encode_batch([prompt])[0]
        rows = []
        for row, marks, whole in zip(texts, scored, wholes, strict=True):
            ids, labels = [], []
            for _, mark in zip(row, marks, strict=True):
                part = next(each)
                ids += part
                labels += part if mark else [ignore] * len(part)
            kept = [x for x in labels if x != ignore]
            before = next((i for i, x in enumerate(labels) if x != ignore), 0)
            want = "".join(x for x, mark in zip(row, marks, strict=True) if mark)
            rows.append((ids, labels, ids == whole, not kept or ids[:before] == prefix, t.decode(kept) == want if kept else True))
        return pd.DataFrame(rows, columns=["ids", "labels", "whole", "prompt", "decoded"])

    return encode


def conversation_checker(load: Callable[[], Tokenizer], marks: tuple[str, str, str]) -> Callable[..., Column]:
    """Whole conversations (roles, texts, ids and labels of their messages) against one encoding of the rendered text: ``whole`` (the
    same ids), ``prompts`` (what precedes each reply's scored ids is its own prompt, encoded by itself) and ``mask`` (labels set anew from
    the tokens' offsets are the same, place by place)."""
    held: list[Tokenizer] = []
    start, end, prefix = marks
    ignore = IGNORE

    @F.pandas_udf("whole boolean, prompts boolean, mask boolean")
    def check(roles: pd.Series, texts: pd.Series, ids: pd.Series, labels: pd.Series) -> pd.DataFrame:
        if not held:
            held.append(load())
        t, out = held[0], []
        for role, text, own, lab in zip(roles, texts, ids, labels, strict=True):
            flat, marks = [int(i) for x in own for i in x], [int(i) for x in lab for i in x]
            rendered, replies, prompts, done = "", [], [], 0
            for r, c, part, y in zip(role, text, own, lab, strict=True):
                if r == "user":
                    rendered += f"{start}user\n{c}{end}\n"
                else:
                    first = next((k for k, v in enumerate(y) if v != ignore), len(y))
                    prompts.append((rendered + prefix, flat[: done + first]))
                    replies.append((len(rendered) + len(prefix), len(rendered) + len(prefix) + len(c) + len(end)))
                    rendered += f"{prefix}{c}{end}\n"
                done += len(part)
            whole = t.encode_batch([rendered])[0]
            same = list(whole) == flat
            asked = t.encode_batch([p for p, _ in prompts]) if prompts else []
            mask = True
            if same and getattr(t, "offsets", None):
                anew = [i if any(s <= o < e for s, e in replies) else ignore for i, o in zip(whole, t.offsets(rendered), strict=True)]
                mask = anew == marks
            out.append((same, all(list(a) == b for a, (_, b) in zip(asked, prompts, strict=True)), mask))
        return pd.DataFrame(out, columns=["whole", "prompts", "mask"])

    return check
