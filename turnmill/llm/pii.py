"""Personal data: regex, gazetteer and context labelers vote on candidate spans; expectation-maximisation weighs them."""

from __future__ import annotations

import hashlib
import ipaddress
import math
import re
import warnings
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, map_arrow

KINDS = ("email", "ip", "card", "phone")
#: Kinds of spans that the method adds: wider spellings of those, and secrets, which have no base pattern.
ALL_KINDS = (*KINDS, "secret")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Spellings that the base patterns don't know. Each run is bounded, so a search stays linear.
LOOSE = {
    "email": re.compile(r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}|<at>| at |@) ?[a-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\{dot\}|<dot>| dot |\.) ?[a-z0-9-]{1,63}){1,4}"),
    "ip": re.compile(r"(?i)(?<![0-9a-z:.])(?:[0-9a-f]{0,4}:){2,7}[0-9a-f]{0,4}(?![0-9a-z:.])"),
    "phone": re.compile(r"(?<![0-9.+-])(?:\+[0-9]{1,3}[ .-])?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{4}(?![0-9.-])"),
}
#: Secrets: what is assigned to a name that says so, what begins as the keys of known services do, and long hexadecimal strings.
ASSIGN = re.compile(r"[=:]")
SECRET_NAME = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|passphrase|pwd|api[ _-]?key|access[ _-]?key|private[ _-]?key|credentials?|authorization)[\"']?\s{0,8}$")
SECRET_VALUE = re.compile(r"[=>]?\s{0,8}(?:(?:[Bb]earer|[Bb]asic)\s)?[\"'`]?([^\s\"'`,;<>]{8}[^\s\"'`,;<>]*+)")
KEY_FORMS = {
    "AKIA": re.compile(r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"),
    "gh": re.compile(r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{20}[A-Za-z0-9]*+"),
    "xox": re.compile(r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10}[A-Za-z0-9-]*+"),
    "sk-": re.compile(r"(?<![A-Za-z0-9])sk-[A-Za-z0-9-]{20}[A-Za-z0-9-]*+"),
    "eyJ": re.compile(r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{10}[A-Za-z0-9_-]*+\.[A-Za-z0-9_-]{10}[A-Za-z0-9_.-]*+"),
}
HEX = re.compile(r"[0-9a-fA-F]{32}[0-9a-fA-F]*+")
#: Candidates that only their surroundings can tell: numbers grouped or as long as a card's, whatever their check digit, bare numbers as
#: long as a national phone number, and long words of letters and digits.
CARDLIKE = re.compile(r"[0-9](?<![0-9.,-].)(?:[0-9]{12,18}|[0-9]{3}([ ./_-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{3}([ ./_-])[0-9]{6}\2[0-9]{5})(?![0-9])")
BARE_PHONE = re.compile(r"[0-9](?<![0-9A-Za-z.,+_/:=-].)[0-9]{8,10}(?![0-9A-Za-z_/-]|[.,:][0-9])")
DIGIT, WORD = re.compile(r"[0-9]"), re.compile(r"[A-Za-z0-9_-]*+")
WORD_CHARS = LOCAL - frozenset(".%+")
PATH_GOES_ON = re.compile(r"[/+.][A-Za-z0-9]")
BARE_HEX = re.compile(r"[0-9a-fA-F]+")
#: Values that stand for a secret in manuals.
PLACEHOLDER = re.compile(r"(?i)example|changeme|your[_-]|placeholder|redacted|dummy|xxxx|\*\*\*|\$\{|<")
#: Common top-level domains, telephone country codes and first digits of payment cards.
TLDS = frozenset("com net org edu gov mil int info biz io co de fr es it nl be ch at uk eu us ca au jp cn ru br in pl se no dk fi pt ie cz gr mx ar cl".split())
COUNTRY = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
CARD_STARTS = frozenset("3456")
CONTEXT = {
    "email": re.compile(r"(?i)mail|contact|write|reach|correo|courriel|kontakt"),
    "ip": re.compile(r"(?i)\bip\b|host|server|addr|login|dirección|adresse"),
    "card": re.compile(r"(?i)card|visa|master|credit|debit|tarjeta|carte|karte"),
    "phone": re.compile(r"(?i)phone|tel|call|fax|mobile|whatsapp|contact|anruf|llam|appel"),
    "secret": re.compile(r"(?i)token|secret|passw|pwd|key|credential|authorization|bearer|login"),
}
AGAINST = re.compile(r"(?i)version|chapter|section|isbn|issn|order no|page|score|ratio")
AGAINST_SECRET = re.compile(r"(?i)sha-?[0-9]|md5|checksum|digest|commit|uuid|hash|revision|etag|fingerprint")
NEAR = 40


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each ``@`` outwards: linear in the text even where a run before it is long."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's rank, end) of the four fixed patterns, sorted."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = digits_of(m.group())
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(digits_of(m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def secrets(text: str) -> Iterator[tuple[int, int]]:
    """Candidates for secrets; each pattern reads a character a bounded number of times."""
    done = 0
    for m in ASSIGN.finditer(text):
        at = m.start()
        if at >= done and SECRET_NAME.search(text, max(0, at - 32), at):
            v = SECRET_VALUE.match(text, at + 1)
            if v:
                done = v.end()
                yield v.span(1)
    for begin, form in KEY_FORMS.items():
        if begin in text:
            yield from (m.span() for m in form.finditer(text))
    yield from (m.span() for m in HEX.finditer(text))
    yield from bare_keys(text)


def bare_keys(text: str) -> Iterator[tuple[int, int]]:
    """Words that may be keys, found from their first digit outwards; parts of paths and addresses are none."""
    done = 0
    for m in DIGIT.finditer(text):
        start = m.start()
        if start < done:
            continue
        done = WORD.match(text, start).end()
        while start and text[start - 1] in WORD_CHARS:
            start -= 1
        if done - start >= 16 and text[max(0, start - 1) : start] not in ("/", "+", ".") and not PATH_GOES_ON.match(text, done) and bare_key(text[start:done]):
            yield start, done


def bare_key(s: str) -> bool:
    """A hexadecimal word of 16 characters or more, or one of 20 or more with letters of both cases; with letters and digits."""
    letters, digits = any(c.isalpha() for c in s), any(c.isdigit() for c in s)
    return letters and digits and (bool(BARE_HEX.fullmatch(s)) or len(s) >= 20 and s.lower() != s and s.upper() != s)


def is_ipv6(s: str) -> bool:
    try:
        return len(s) > 3 and bool(ipaddress.IPv6Address(s))
    except ValueError:
        return False


def loose_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, int]]:
    """Candidates of the wider patterns that touch no base span, and secrets, which may hold one; of secrets that overlap, the one that begins first, the longer of those.

    Numbers grouped like a card's are candidates for cards, not for phones.
    """
    found = []
    low = text.lower() if re.search(r"[aA][tT]", text) else ""
    if re.search(r"[(\[{< ](?:at|dot)[)\]}> ]", low) and ("dot" in low or "(at)" in low or "[at]" in low or "{at}" in low or "<at>" in low):
        found += [(m.start(), 0, m.end()) for m in LOOSE["email"].finditer(text) if re.search(r"(?i)[(\[{<]at[)\]}>]|[(\[{< ]dot[)\]}> ]", m.group())]
    if "::" in text or text.count(":") >= 7:
        found += [(m.start(), 1, m.end()) for m in LOOSE["ip"].finditer(text) if is_ipv6(m.group())]
    cards = [m.span() for m in CARDLIKE.finditer(text)]
    found += [(s, 2, e) for s, e in cards]
    begins = [s for s, _ in cards]
    for p in (LOOSE["phone"], BARE_PHONE):
        for m in p.finditer(text):
            i = bisect_left(begins, m.end())
            if not i or cards[i - 1][1] <= m.start():
                found.append((m.start(), 3, m.end()))
    done = 0
    for s, e in sorted(secrets(text), key=lambda x: (x[0], -x[1])):
        if s >= done:
            found.append((s, 4, e))
            done = e
    if not base:
        return sorted(found)
    starts, ends = [x[0] for x in base], list(accumulate((x[2] for x in base), max))

    def free(s: int, e: int) -> bool:
        i = bisect_left(starts, e)  # base spans that begin before the candidate's end
        return not i or ends[i - 1] <= s

    return sorted(x for x in found if x[1] == 4 or free(x[0], x[2]))


def vote(text: str, start: int, kind: int, end: int, strict: bool) -> str:
    """Kind and the labelers' votes: ``+`` personal, ``-`` not, ``0`` abstains."""
    span, name = text[start:end], ALL_KINDS[kind]
    before, after = text[max(0, start - NEAR) : start], text[end : end + 8]
    d = digits_of(span)
    if kind == 0:
        tail = re.split(r"[^A-Za-z0-9]+", span.lower().rstrip(")]}>"))[-1]
        gaz = "+" if tail in TLDS else "-"
        shape = "+" if strict or re.search(r"(?i)[(\[{<](?:at|dot)[)\]}>]", span) else "0"
    elif kind == 1:
        parts = span.split(".")
        gaz = "-" if len(parts) == 4 and (parts[0] == "0" or any(len(p) > 1 and p[0] == "0" for p in parts)) else "0"
        shape = "+" if len(parts) == 4 or len(set(span)) > 3 else "-"
    elif kind == 2:
        gaz = "+" if d[0] in CARD_STARTS else "0"
        shape = "-" if len(set(d)) < 3 or not luhn(d) else "+"
    elif kind == 4:
        letters = sum(c.isalpha() for c in span)
        gaz = "-" if PLACEHOLDER.search(span) else "+" if any(f.fullmatch(span) for f in KEY_FORMS.values()) else "0"
        mixed = gaz != "-" and len(set(span)) >= 8 and 0 < letters < len(span)
        shape = "-" if not mixed else "0" if BARE_HEX.fullmatch(span) else "+"  # a hexadecimal string may be a digest as well
        strict = gaz == "+" or gaz != "-" and bool(SECRET_NAME.search(text[max(0, start - 40) : start].rstrip("\"'`=:> \t")))
    else:
        gaz = "+" if strict and any(d[:k] in COUNTRY for k in (1, 2)) else "0" if strict else "-" if d[0] in "01" and len(d) == 10 and d[:2] != "01" else "0"
        shape = "-" if not 9 <= len(d) <= 15 else "0" if len(d) == len(span) else "+"  # a bare number may count anything
    against = (AGAINST_SECRET if kind == 4 else AGAINST).search(before)
    context = "+" if CONTEXT[name].search(before) and not (kind == 4 and against) else "-" if against else "0"
    glued = (start > 0 and text[start - 1].isalnum()) or (after[:1].isalnum())
    return f"{name}{'=' if strict and kind < 4 else '~'}{'+' if strict else '0'}{shape}{gaz}{context}{'-' if glued else '0'}"


def fit(patterns: list[tuple[str, int]], rounds: int = 10_000, still: float = 1e-7) -> dict[str, float]:
    """Reliabilities by expectation-maximisation over the labelers' patterns, then a logistic span classifier on them.

    The rounds end when no posterior moves by more than ``still``; a warning tells if ``rounds`` of them don't reach that.

    All kinds share the labelers; the classifier's inputs are the votes, the kind and the candidate's source, its
    targets the posteriors, its weights the cube roots of the counts over the whole corpus, so that the commonest pattern
    doesn't fit the others'.
    """
    if not patterns:
        return {}
    names = sorted(patterns)
    votes = np.array([["-0+".index(c) for c in p.split("=" if "=" in p else "~")[1]] for p, _ in names])
    n = np.array([c for _, c in names], float)
    _, group = np.unique([re.split("[=~]", p)[0] + "=~"["~" in p] for p, _ in names], return_inverse=True)
    post = np.clip(0.5 + 0.2 * (votes - 1).sum(1), 0.05, 0.95)
    for _ in range(rounds):
        score = []
        for w, prior in ((n * post, (4.0, 1.0)), (n * (1 - post), (1.0, 3.0))):  # a labeler is taken to be better than chance
            said = np.stack([(w[:, None] * (votes == k)).sum(0) + 5 * prior[k == 0] for k in (0, 2)])
            chance = np.zeros((3, votes.shape[1]))
            chance[[0, 2]] = np.log(said / said.sum(0))
            # base spans and others of each kind have a share of each class of their own, and neither is taken to be rarer than one in
            # ten, so that a corpus of plain cases leaves objections their weight, and many poor candidates of a kind don't speak against
            # another's
            share = (np.bincount(group, w) + 1) / (np.bincount(group, n) + 2)
            score.append(np.log(np.clip(share, 0.1, 0.9))[group] + chance[votes, np.arange(votes.shape[1])].sum(1))
        old, post = post, 1 / (1 + np.exp(np.clip(score[1] - score[0], -40, 40)))
        if np.abs(post - old).max() <= still:
            break
    else:
        warnings.warn(f"the labelers' reliabilities still move after {rounds} rounds", stacklevel=2)
    x = np.concatenate([votes == 2, votes == 0, [[p.startswith(k) for k in ALL_KINDS] + ["~" in p, True] for p, _ in names]], axis=1).astype(float)
    theta, weight = np.zeros(x.shape[1]), np.cbrt(n) / np.cbrt(n).sum()
    for _ in range(1500):
        p = 1 / (1 + np.exp(-x @ theta))
        theta += 4.0 * (x.T @ (weight * (post - p)) - 1e-4 * theta)
    return {p: float(q) for (p, _), q in zip(names, 1 / (1 + np.exp(-x @ theta)), strict=True)}


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{ALL_KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: base spans, loose candidates (with votes) and the vote pattern of each."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for t in b.column(1).to_pylist():
            t = t or ""
            base = base_spans(t)
            loose = loose_spans(t, base)
            rows.append(([f"{s}:{k}:{e}" for s, k, e in base], [f"{s}:{k}:{e}:{vote(t, s, k, e, False)}" for s, k, e in loose], [vote(t, s, k, e, True) for s, k, e in base]))
        kind = pa.list_(pa.string())
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], kind) for i in range(3))], [key, "base", "loose", "patterns"])

    kind = docs.schema[key].dataType.simpleString()
    return map_arrow(docs.select(key, text), run, f"`{key}` {kind}, base array<string>, loose array<string>, patterns array<string>", text)


def learn(found: DataFrame) -> dict[str, float]:
    """Probability of each vote pattern; the driver sees the distinct patterns (at most 9 x 3^5) and their counts."""
    every = F.concat("patterns", F.transform("loose", lambda x: F.element_at(F.split(x, ":", 4), 4)))
    return fit([(r[0], r[1]) for r in found.select(F.explode(every).alias("pattern")).groupBy("pattern").count().collect()])


def chosen(base: list[str], loose: list[str], model: dict[str, float], threshold: float) -> tuple[list, list]:
    spans = [tuple(map(int, x.split(":"))) for x in base]
    more = []
    for x in loose:
        s, k, e, pattern = x.split(":", 3)
        if model.get(pattern, 0.0) >= threshold:
            more.append((int(s), int(k), int(e)))
    return spans, sorted(spans + more)


def pii(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.9) -> DataFrame:
    """Per row: base counts by kind, ``base_sha256`` of the base spans, ``spans``, base and added ones, and the number of all
    spans, of secrets and of candidates that the classifier turned down.

    Null and empty texts have no spans. Repeated rows are searched one by one; spans are joined by start, those that start together in the
    order of ``ALL_KINDS``. Offsets are code points, ends exclusive. Base spans always stay; the classifier decides about others.
    An added span touches no base span, but for a ``secret``, which may hold one and stands beside it.
    """
    found = checkpoint(find(docs, text, key))
    model = learn(found)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(9)]
        for base, loose in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            first, spans = chosen(base, loose, model, threshold)
            for k in range(4):
                out[k].append(sum(x[1] == k for x in first))
            out[4].append(hashlib.sha256(joined(first).encode()).hexdigest())
            out[5].append(joined(spans))
            out[6].append(len(spans))
            out[7].append(sum(x[1] == 4 for x in spans))
            out[8].append(len(base) + len(loose) - len(spans))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 3
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))], [key, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans", "n_secret", "n_rejected"])

    kind = docs.schema[key].dataType.simpleString()
    return map_arrow(found.select(key, "base", "loose"), run, f"`{key}` {kind}, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string, n_spans bigint, n_secret bigint, n_rejected bigint")


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Spans replaced by their kind in brackets; where spans overlap, the first covers what it reaches."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{ALL_KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.9, length: str | None = None) -> DataFrame:
    """All rows and columns of ``docs``, found spans in ``text`` replaced; ``length``, if named, gets the new code points.

    The vote patterns are counted over all rows first. A null text stays null.
    """
    model = learn(find(docs, text, key))
    at = docs.columns.index(text)
    to = docs.columns.index(length) if length else None

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        new = []
        for t in b.column(at).to_pylist():
            if t:
                base = base_spans(t)
                loose = [f"{s}:{k}:{e}:{vote(t, s, k, e, False)}" for s, k, e in loose_spans(t, base)]
                t = mask(t, chosen([f"{s}:{k}:{e}" for s, k, e in base], loose, model, threshold)[1])
            new.append(t)
        cols = list(b.columns)
        cols[at] = pa.array(new, b.schema.field(at).type)
        if to is not None:
            cols[to] = pa.array([None if t is None else len(t) for t in new], b.schema.field(to).type)
        return pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return map_arrow(docs, run, docs.schema, text)
