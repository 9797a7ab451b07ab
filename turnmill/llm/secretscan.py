"""Secrets in texts: three fixed patterns, and a linear-chain conditional random field that tags tokens as a secret's begin, inside or
outside by shape, neighbours and the file around them."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, checkpoint, map_arrow, text_bytes

KINDS = ("assign", "access", "hex")
#: All kinds; the field adds the last.
ALL_KINDS = (*KINDS, "secret")
#: Fixed patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16}[0-9a-f]*+")
#: What a corpus' labelled secrets look like to Spark's own expressions, before Python reads a text.
HINT = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{14}|(?<![0-9a-f])(?=[0-9a-f]{16})[0-9]*[a-f]"""
#: Fixed values, lower case: parts of names that announce a secret, of words that announce a digest, of values that stand for one in manuals.
NAMES = tuple(map(str.encode, "token secret passw passphr pwd apikey api_key api-key accesskey access_key access-key privatekey private_key private-key signing credential auth bearer".split()))
DIGESTS = (*map(str.encode, "sha1 sha2 sha3 sha5 sha- sha: sha= md5 checksum digest commit uuid revision etag fingerprint integrity".split()), b"sha ")
STANDINS = tuple(map(str.encode, "example changeme change_me your_ your- placeholder redacted dummy xxxx sample test123".split()))
#: Beginnings of known keys.
STARTS = tuple(map(str.encode, "AKIA ghp_ gho_ ghu_ ghs_ ghr_ xoxa xoxb xoxp xoxr xoxs sk- eyJ AIza glpat-".split()))
#: States, and windows of training: code points around a span, tokens of a sequence.
B, I, O = 0, 1, 2  # noqa: E741
AROUND, STEPS = 120, 96
#: Labelled windows of each class that the field is fitted on, at most.
ROWS = 1_000

WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *map(ord, "_+/-.~"), *range(0x80, 0x100)]] = True
LOWER, UPPER, DIGIT, HEXED, WIDE = (np.zeros(256, bool) for _ in range(5))
WIDE[0x80:] = LOWER[0x61:0x7B] = UPPER[0x41:0x5B] = DIGIT[0x30:0x3A] = True
HEXED[[*range(0x30, 0x3A), *range(0x61, 0x67), *range(0x41, 0x47)]] = True
#: The character class of a byte, for counting changes inside a token.
CLASS = LOWER * np.int8(1) + UPPER * np.int8(2) + DIGIT * np.int8(3)
#: Counts of three classes in one sum: a field of 21 bits each.
FIELD = 21
FIRST, SECOND = (sum(m.astype(np.int64) << FIELD * i for i, m in enumerate(ms)) for ms in ((LOWER, UPPER, DIGIT), (HEXED, WIDE)))
LENGTHS = np.array([2, 3, 5, 8, 12, 16, 24, 40, 64])
#: A token as its neighbours see it.
NAME, DIGEST, STANDIN, EQUALS, COLON, QUOTE, SIGN, PLAIN, NUMBER, MIXED, OTHER, EDGE = range(12)
#: How many values each feature takes, in the order of ``Tokens.features``.
SIZES = (10, 32, 6, 3, 12, 2, 2, 12, 12, 12, 12, 16, 2)
OFFSETS = np.concatenate([[0], np.cumsum(SIZES)])
N_FEATURES = int(OFFSETS[-1])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's rank, end) of the fixed patterns, leftmost and without overlap in a kind, sorted."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def holds(text: str, parts: tuple[bytes, ...]) -> bool:
    low = text.lower().encode()
    return any(p in low for p in parts)


def silver(text: str) -> list[tuple[int, int]]:
    """Spans that the field learns as secrets: values after a name, access keys, hexadecimal strings with letters and digits that no word
    calls a digest."""
    out = [m.span(2) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12 and not holds(m[2], STANDINS)]
    if "AKIA" in text:
        out += [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    for m in HEX.finditer(text):
        if not m[0].isdigit() and not m[0].isalpha() and not holds(text[max(0, m.start() - 40) : m.start()], DIGESTS):
            out.append(m.span())
    spans, done = [], 0
    for s, e in sorted(out):
        if s >= done:
            spans.append((s, e))
            done = e
    return spans


class Tokens:
    """Tokens of a text column: runs of word characters and single other ones, end to end, with their features."""

    def __init__(self, texts: pa.Array, file: np.ndarray | None = None) -> None:
        self.raw, self.off = text_bytes(texts)
        raw, off = self.raw, self.off
        word, blank = WORD[raw], SPACE[raw]
        first = ~blank
        if len(raw):
            glued = word[1:] & word[:-1]
            edge = off[(off > 0) & (off < len(raw))]
            glued[edge - 1] = False
            first[1:] &= ~glued
        self.start = np.flatnonzero(first)
        n = len(self.start)
        limit = np.append(self.start[1:], len(raw))
        room = np.concatenate([[0], np.cumsum(blank)])
        self.end = limit - (room[limit] - room[self.start])  # blanks stand behind a token only
        self.doc = np.searchsorted(off, self.start, "right") - 1
        width = self.end - self.start
        is_word = word[self.start] if n else np.zeros(0, bool)
        self.width, self.is_word = width, is_word
        sort = CLASS[raw]
        turn = np.zeros(len(raw), bool)
        if len(raw):
            turn[1:] = (sort[1:] != sort[:-1]) & (sort[1:] > 0) & (sort[:-1] > 0)
            turn[self.start] = False
        add = lambda x: np.add.reduceat(x, self.start) if n else np.zeros(0, np.int64)
        if n and int(width.max()) < 1 << FIELD:
            one, two = add(FIRST[raw]), add(SECOND[raw] + (turn.astype(np.int64) << 2 * FIELD))
            lower, upper, digit, hexed, wide, turns = (x >> FIELD * i & (1 << FIELD) - 1 for x in (one, two) for i in range(3))
        else:
            lower, upper, digit, hexed, wide = (add(m.astype(np.int64)[raw]) for m in (LOWER, UPPER, DIGIT, HEXED, WIDE))
            turns = add(turn.astype(np.int64))
        signs = width - lower - upper - digit - wide
        mask = (lower > 0) * 1 + (upper > 0) * 2 + (digit > 0) * 4 + (signs > 0) * 8 + (wide > 0) * 16
        hexes = np.where((hexed == width) & (width >= 8), np.where((lower + upper > 0) & (digit > 0), 2, 1), 0)
        low = raw.tobytes().lower()
        marks = {k: self.hits(low, p) for k, p in ((NAME, NAMES), (DIGEST, DIGESTS), (STANDIN, STANDINS))}
        lead = raw[self.start] if n else np.zeros(0, np.uint8)
        seen = np.full(n, OTHER)
        seen[is_word & (digit == 0)] = PLAIN
        seen[is_word & (digit + signs == width)] = NUMBER
        mixed = is_word & (width >= 8) & (digit > 0) & (lower + upper > 0)
        seen[mixed] = MIXED
        seen[~is_word] = SIGN
        seen[lead == ord("=")] = EQUALS
        seen[lead == ord(":")] = COLON
        seen[np.isin(lead, [ord("'"), ord('"'), ord("`")])] = QUOTE
        for k in (DIGEST, NAME, STANDIN):
            seen[marks[k] & is_word] = k
        self.seen = seen
        close = np.append(False, self.end[:-1] == self.start[1:]) if n else np.zeros(0, bool)
        if file is None:
            size = np.bincount(self.doc, minlength=len(texts))
            dense = lambda m, *steps: np.searchsorted(steps, np.bincount(self.doc, m, len(texts)) / np.maximum(size, 1), "right")
            file = dense((seen == EQUALS) | (seen == COLON), 0.005, 0.02, 0.08) * 2 + dense(seen == SIGN, 0.15)
        self.file = file
        self.columns = [np.searchsorted(LENGTHS, width, "right"), mask, np.minimum(turns, 20) // 4, hexes, seen, self.hits(raw.tobytes(), STARTS, True).astype(np.int64), close.astype(np.int64)]

    def hits(self, data: bytes, parts: tuple[bytes, ...], lead: bool = False) -> np.ndarray:
        """Which tokens hold the beginning of a part; with ``lead``: begin with one, or with a sign and it."""
        at = []
        for p in parts:
            i = data.find(p)
            while i >= 0:
                if not (lead and i and data[i - 1 : i].isalnum()):
                    at.append(i)
                i = data.find(p, i + 1)
        out = np.zeros(len(self.start), bool)
        out[np.searchsorted(self.start, np.array(at, np.int64), "right") - 1] = True
        return out

    def features(self) -> Iterator[np.ndarray]:
        """One column at a time, ids below ``N_FEATURES``: own shape, own kind, known beginning, no blank before, what stands three to one
        before and one after, and the file's density of assignments and signs beside a mixed shape; a constant for words."""
        n = len(self.start)
        for k, c in enumerate(self.columns):
            yield c + OFFSETS[k]
        for k, shift in enumerate((3, 2, 1, -1), len(self.columns)):
            near = np.full(n, EDGE)
            if shift > 0 and n > shift:
                near[shift:] = np.where(self.doc[shift:] == self.doc[:-shift], self.seen[:-shift], EDGE)
            elif shift < 0 and n > 1:
                near[:-1] = np.where(self.doc[1:] == self.doc[:-1], self.seen[1:], EDGE)
            yield near + OFFSETS[k]
        yield self.file[self.doc] * 2 + ((self.width >= 8) & (self.columns[1] & 4 > 0) & (self.columns[1] & 3 > 0)) + OFFSETS[11]
        yield self.is_word + OFFSETS[12]

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.start), 3), np.float32)
        for c in self.features():
            out += weights[c]
        return out

    def labels(self, spans: list[list[tuple[int, int]]], places: np.ndarray) -> np.ndarray:
        """States of the tokens by spans (code points) of each text; ``places``: code point of each byte in its text."""
        out = np.full(len(self.start), O)
        at = np.searchsorted(self.doc, np.arange(len(spans) + 1))
        for d, own in enumerate(spans):
            for s, e in own:
                inside = np.flatnonzero((places[self.start[at[d] : at[d + 1]]] < e) & (places[self.end[at[d] : at[d + 1]] - 1] >= s) & self.is_word[at[d] : at[d + 1]]) + at[d]
                out[inside] = I
                out[inside[:1]] = B
        return out

    def places(self) -> np.ndarray:
        """The code point that each byte belongs to, counted in its text."""
        lead = (self.raw & 0xC0) != 0x80
        run = np.cumsum(lead) - 1
        before = np.concatenate([[0], np.cumsum(lead)])[self.off[:-1]]
        return run - np.repeat(before, np.diff(self.off))


def viterbi(score: np.ndarray, lengths: np.ndarray, step: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Best states of sequences that lie end to end; ``begin`` and ``end`` are each sequence's scores of its first and last state.

    All sequences move on together, the long ones alone at last.
    """
    first = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    first, size = first[order], lengths[order]
    back = np.zeros((len(score), 3), np.int8)
    best = score[first] + begin[order]
    final = np.zeros((len(size), 3), np.float32)
    for t in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -t, "left"))  # sequences longer than t
        if t:
            way = best[:live, :, None] + step
            back[first[:live] + t] = way.argmax(1)
            best = way.max(1) + score[first[:live] + t]
        done = int(np.searchsorted(-size, -(t + 1), "left"))
        final[done:live] = best[done:live]
    out = np.zeros(len(score), np.int64)
    state = (final + end[order]).argmax(1)
    for t in range(int(size[0]) - 1 if len(size) else -1, -1, -1):
        live = int(np.searchsorted(-size, -t, "left"))
        at = first[:live] + t
        out[at] = state[:live]
        state[:live] = np.where(t > 0, back[at, state[:live]], state[:live])
    return out


def decode(tokens: Tokens, model: dict) -> np.ndarray:
    """The states of the best path through each text.

    A token whose outside score leads by more than all that its two transitions can change is outside in every best path
    (swapping it there gains, whatever its neighbours are), so paths are searched only between such tokens: the same result.
    """
    score, step = tokens.emissions(model["weights"]), model["step"]
    n = len(score)
    out = np.full(n, O)
    if not n:
        return out
    gain = step[:, :, None] + step[None, :, :]  # from, here, to
    edge = max(0.0, float(np.abs(model["begin"]).max()) * 2)
    margin = float((gain - gain[:, O : O + 1, :]).max()) + edge
    open_ = score[:, O] - score[:, :O].max(1) <= margin
    at = np.flatnonzero(open_)
    if not len(at):
        return out
    cut = np.append(True, (at[1:] != at[:-1] + 1) | (tokens.doc[at[1:]] != tokens.doc[at[:-1]]))
    lengths = np.diff(np.append(np.flatnonzero(cut), len(at)))
    firsts, lasts = at[np.flatnonzero(cut)], at[np.cumsum(lengths) - 1]
    inner = (firsts > 0) & (tokens.doc[firsts] == tokens.doc[firsts - 1])
    after = np.append(tokens.doc[1:] == tokens.doc[:-1], False)[lasts]
    begin = np.where(inner[:, None], step[O][None, :], model["begin"][None, :])
    end = np.where(after[:, None], step[:, O][None, :], 0.0)
    out[at] = viterbi(score[at], lengths, step, begin.astype(np.float32), end.astype(np.float32))
    return out


def fit(columns: np.ndarray, labels: np.ndarray, lengths: np.ndarray, rounds: int = 100, rate: float = 0.15, decay: float = 1e-5) -> dict:
    """Weights by gradient ascent (Adam) on the conditional log-likelihood of labelled sequences, by forward and backward sums
    over all of them at once. ``columns``: feature ids (token, feature); sequences lie end to end."""
    n, k = columns.shape
    order = np.argsort(-lengths, kind="stable")
    first, size = (np.cumsum(lengths) - lengths)[order], lengths[order]
    live = [int(np.searchsorted(-size, -t, "left")) for t in range(int(size[0]) + 1)]
    weights, step, begin = np.zeros((N_FEATURES, 3)), np.zeros((3, 3)), np.zeros(3)
    gold = np.eye(3)[labels]
    is_first = np.zeros(n, bool)
    is_first[first] = True
    moves = np.zeros((3, 3))
    follow = np.flatnonzero(~is_first)
    np.add.at(moves, (labels[follow - 1], labels[follow]), 1)
    m = [np.zeros_like(x) for x in (weights, step, begin)]
    v = [np.zeros_like(x) for x in (weights, step, begin)]
    flat = columns.ravel()
    for it in range(1, rounds + 1):
        score = weights[columns].sum(1)
        alpha, scale = np.zeros((n, 3)), np.zeros(n)
        top = score.max(1, keepdims=True)
        e = np.exp(score - top)
        hop = np.exp(step)
        for t in range(len(live) - 1):
            at = first[: live[t]] + t
            a = e[at] * (np.exp(begin) if not t else alpha[at - 1] @ hop)
            scale[at] = a.sum(1)
            alpha[at] = a / scale[at][:, None]
        beta = np.ones((n, 3))
        pair = np.zeros((3, 3))
        for t in range(len(live) - 2, 0, -1):
            at = first[: live[t]] + t
            right = e[at] * beta[at] / scale[at][:, None]
            pair += (alpha[at - 1].T @ right) * hop
            beta[at - 1] = right @ hop.T
        post = alpha * beta
        error = gold - post
        g = np.stack([np.bincount(flat, np.repeat(error[:, s], k), N_FEATURES) for s in range(3)], 1)
        grads = (g / len(size) - decay * weights, (moves - pair) / len(size) - decay * step, error[is_first].sum(0) / len(size) - decay * begin)
        for x, d, a, b in zip((weights, step, begin), grads, m, v, strict=True):
            a += 0.1 * (d - a)
            b += 0.01 * (d * d - b)
            x += rate * (a / (1 - 0.9**it)) / (np.sqrt(b / (1 - 0.99**it)) + 1e-8)
    return {"weights": weights.astype(np.float32), "step": step.astype(np.float32), "begin": begin.astype(np.float32)}


#: What the windows of labelled secrets are also taught with: other names, signs and alphabets, and values that are no secrets.
OTHER_NAMES = ("client_secret", "auth_token", "passphrase", "DB_PASSWORD", "private-key", "signing_key", "Authorization: Bearer", "credentials", "accessKey", "pwd")
OTHER_SIGNS = (" = ", ": ", "=", ' = "', ": '", "\": \"", " => ", " ")
ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
STANDIN_VALUES = ("changeme", "your-token-here", "<token>", "${TOKEN}", "example-value", "xxxxxxxxxxxxxxxx", "None", "true", "required", "1234")
DIGEST_NAMES = ("commit", "sha256", "md5 checksum", "etag", "revision", "fingerprint", "uuid")
PREFIXES = ("", "", "", "ghp_", "sk-", "xoxb-", "AKIA", "eyJ")


def variants(text: str, span: tuple[int, int], seed: str) -> list[tuple[str, list[tuple[int, int]]]]:
    """A labelled window as it is, and rewritten: two with another name, sign and value, one whose value is a digest by name and one whose
    value is a placeholder or a word of the window, both without a secret. Seeded by the window itself."""
    rng = random.Random(seed)
    s, e = span
    head = re.sub(r"[\w-]+[\"']?\s*[:=]\s*[\"']?$", "", text[:s], flags=re.ASCII)
    tail = text[e:]
    close = tail[:1] if tail[:1] in "\"'" else ""
    out = [(text, [span])]
    for _ in range(2):
        value = rng.choice(PREFIXES) + "".join(rng.choices(rng.choice(ALPHABETS), k=rng.randint(16, 48)))
        lead = head + (rng.choice(OTHER_NAMES) + rng.choice(OTHER_SIGNS) if rng.random() < 0.8 else rng.choice(["", '"']))
        out.append((lead + value + tail, [(len(lead), len(lead) + len(value))]))
    digest = "".join(rng.choices(rng.choice(ALPHABETS[:2]), k=rng.choice([16, 32, 40, 64])))
    out.append((head + rng.choice(DIGEST_NAMES) + rng.choice([" ", ": ", " = ", "="]) + digest + tail[len(close) :], []))
    words = re.findall(r"\w{5,}", head) or ["value"]
    plain = rng.choice([rng.choice(STANDIN_VALUES), rng.choice(words)])
    out.append((head + rng.choice(("password", "token", "secret", *OTHER_NAMES)) + rng.choice(OTHER_SIGNS) + plain + tail, []))
    return out


def windows(docs: DataFrame, text: str, key: str, rows: int) -> list[tuple]:
    """At most ``rows`` windows with a labelled secret and as many without: (text, start, end, file, seed).

    They are of the ``rows`` documents of the least hashes that look like holding one, and of as many of all; the windows of the least
    hashes are taken. The one without a secret stands around a document's longest token that has a digit and is none, or at a place
    by hash. Documents without an id aren't asked.
    """
    keyed = docs.where(F.col(key).isNotNull() & (F.length(text) > 0)).select(F.col(key), F.col(text))
    order = F.xxhash64(F.col(key).cast("string"))
    pick = lambda x: x.select(key).orderBy(order, key).limit(rows)
    asked = pick(keyed.where(F.col(text).rlike(HINT))).unionByName(pick(keyed)).distinct()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        tokens = Tokens(b.column(1))
        file, place = tokens.file.tolist(), tokens.places()
        odd = tokens.is_word & (tokens.columns[1] & 4 > 0)
        at = np.searchsorted(tokens.doc, np.arange(b.num_rows + 1))
        for d, (k, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            spans = silver(t)
            for s, e in spans:
                lo = max(0, s - AROUND)
                out.append((t[lo : e + AROUND], s - lo, min(e, s + 256) - lo, file[d], f"{k}:{s}"))
            own = np.flatnonzero(odd[at[d] : at[d + 1]]) + at[d]
            starts = place[tokens.start[own]]
            if spans:
                i = np.searchsorted([s for s, _ in spans], starts, "right") - 1
                free = (i < 0) | (np.array([e for _, e in spans])[i] <= starts)
                own, starts = own[free], starts[free]
            h = int.from_bytes(hashlib.sha256(f"{k}".encode()).digest()[:8], "big")
            mid = int(starts[tokens.width[own].argmax()]) if len(own) else h % len(t)
            lo = max([0, mid - AROUND, *(e for _, e in spans if e <= mid)])
            hi = min([mid + AROUND, *(s for s, _ in spans if s > mid)])
            if not any(s < hi and e > lo for s, e in spans):
                out.append((t[lo:hi], -1, -1, file[d], f"{k}:-"))
        seeds = [hashlib.sha256(x[4].encode()).hexdigest() for x in out]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([*(pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)), pa.array(seeds)], ["window", "s", "e", "file", "seed"])

    found = checkpoint(map_arrow(keyed.join(F.broadcast(asked), key, "left_semi"), run, "window string, s bigint, e bigint, file bigint, seed string", text))
    return [tuple(r) for side in (F.col("s") >= 0, F.col("s") < 0) for r in found.where(side).orderBy("seed", "window", "s").limit(rows).collect()]


def train(docs: DataFrame, text: str = "text", key: str = "doc_id", rows: int = ROWS) -> dict | None:
    """The field, fitted on at most ``rows`` labelled windows of each class; none where the corpus has no labelled secret."""
    taught, file = [], []
    for window, s, e, f, seed in windows(docs, text, key, rows):
        more = variants(window, (s, e), seed) if s >= 0 else [(window, [])]
        taught += more
        file += [f, *((f + int(seed[i], 16)) % 8 for i in range(1, len(more)))]  # rewritten ones stand in files of all kinds
    if not any(spans for _, spans in taught):
        return None
    tokens = Tokens(pa.array([t for t, _ in taught]), np.array(file))
    labels = tokens.labels([s for _, s in taught], tokens.places())
    columns = np.stack(list(tokens.features()), 1)
    lengths = np.bincount(tokens.doc, minlength=len(taught))
    at = np.arange(len(labels)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    keep = at < STEPS  # a window of signs alone may have more
    size = np.minimum(lengths, STEPS)
    return fit(columns[keep], labels[keep], size[size > 0])


def tagged(texts: pa.Array, model: dict | None) -> list[list[tuple[int, int]]]:
    """Spans (code points) of each text that the field tags; end signs of a sentence and padding are set right."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(texts))]
    if model is None:
        return out
    tokens = Tokens(texts)
    state = decode(tokens, model)
    on = state != O
    if not on.any():
        return out
    places = tokens.places()
    cut = on & ((state == B) | np.append(True, ~on[:-1] | (tokens.doc[1:] != tokens.doc[:-1])))
    firsts = np.flatnonzero(cut)
    stop = np.append(np.where(~on[1:] | cut[1:] | (tokens.doc[1:] != tokens.doc[:-1]), True, False), True) & on
    raw = tokens.raw
    for i, j in zip(firsts.tolist(), np.flatnonzero(stop).tolist(), strict=True):
        d, s, e = int(tokens.doc[i]), int(tokens.start[i]), int(tokens.end[j])
        limit = int(tokens.off[d + 1])
        while e < limit and e - s < 4096 and raw[e] == ord("=") and e < int(tokens.end[j]) + 2:
            e += 1
        while e > s and raw[e - 1] in b".,-":
            e -= 1
        if e > s:
            out[d].append((int(places[s]), int(places[e - 1]) + 1))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{ALL_KINDS[k]}:{s}:{e}" for s, k, e in spans)


def secrets(docs: DataFrame, text: str = "text", key: str = "doc_id", rows: int = ROWS) -> DataFrame:
    """Per row: ``n_assign``, ``n_access``, ``n_hex`` and ``base_sha256`` of the fixed patterns, ``spans`` (those and the field's, of kind
    ``secret``) and ``n_secret``.

    Whole texts are tagged, in passes without a shuffle; the driver sees the labelled windows alone. Base spans always stay, the
    field's are added where they touch none of them; spans that start together are in the order of ``ALL_KINDS``. Null and empty
    texts have no spans, repeated rows are searched one by one, other columns aren't read. Offsets are code points, ends exclusive.
    """
    model = train(docs, text, key, rows)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(6)]
        for t, more in zip(b.column(1).to_pylist(), tagged(b.column(1), model), strict=True):
            base = base_spans(t or "")
            reach = [(s, e) for s, _, e in base]
            added, i, far = [], 0, 0
            for s, e in more:
                while i < len(reach) and reach[i][0] < e:
                    far = max(far, reach[i][1])
                    i += 1
                if far <= s:
                    added.append((s, 3, e))
            for k in range(3):
                cols[k].append(sum(x[1] == k for x in base))
            cols[3].append(hashlib.sha256(joined(base).encode()).hexdigest())
            cols[4].append(joined(sorted(base + added)))
            cols[5].append(len(added))
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, t) for x, t in zip(cols, kinds, strict=True))], [key, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_secret"])

    kind = docs.schema[key].dataType.simpleString()
    return map_arrow(docs.select(key, text), run, f"`{key}` {kind}, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string, n_secret bigint", text)
