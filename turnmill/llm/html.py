"""Main text of web pages: markup tells article from page furniture, a host's repeated token runs tell the rest."""

from __future__ import annotations

import html as htmllib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, checkpoint, map_arrow, signed
from .urls import with_parts

#: Tokens that a repeated run has at least; it is boilerplate if it is on this share of its host's pages, or on so many.
RUN, SHARE, PAGES = 10, 0.2, 20
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|iframe|textarea)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attr>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<close2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attr2>[^>]*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)",
    re.S | re.I,
)
#: One attribute after another, values and all, so that nothing inside a quoted value is taken for an attribute.
ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Fixed values of HTML: elements that begin and end a block, that hold no content, and that are page furniture.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav footer aside form button menu dialog head title label fieldset input option datalist noscript template svg select".split())
#: Elements of these that stand inside a line without ending it.
INLINE = frozenset("template svg noscript select".split())
#: Names that say furniture of a page, but a part of the text inside an article: its own heading or lead picture.
OUTSIDE = frozenset("header masthead banner topbar".split())
#: Elements that are text inside an article, whatever their names.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar alert alertdialog dialog form".split())
NAMES = frozenset("ad ads adv advert adverts advertisement advertisements advertising banner sponsor sponsored promo sidebar menu nav navbar navigation footer header masthead topbar cookie cookies consent gdpr notice notices popup modal overlay comment comments disqus replies share sharing social related breadcrumb breadcrumbs newsletter subscribe subscription widget toolbar pagination pager skip".split())
#: Words that may stand beside a name in a class without changing what it says; with any other word it is something else.
BESIDE = frozenset("site page main top bottom left right primary secondary global box block bar container wrapper wrap list item items link links section area slot unit inner outer user reader buttons button bottom sticky fixed mobile desktop level form reply thread posts stories bar1 1 2 3 4".split())
ARTICLE = frozenset(("article", "main"))
#: Elements whose end tag may be left out, and what ends them then: any block, or the next element of the kind.
IMPLIED = frozenset("li dt dd option tr td th".split())


def names_furniture(value: str, inside: bool = False) -> bool:
    """Whether one of the class names, taken whole, is a known name, alone or beside words that don't change it; inside an article
    names of ``OUTSIDE`` are none, and a lone "comment" isn't either: it may be a critic's."""
    for name in value.lower().split():
        parts = [x for x in re.split(r"[-_]+", name) if x]
        known = NAMES.intersection(parts) - (OUTSIDE if inside else frozenset())
        if known and not (inside and parts == ["comment"]) and all(x in NAMES or x in BESIDE for x in parts):
            return True
    return False


def is_furniture(tag: str, attr: str, inside: bool) -> bool:
    """Menus, headers, footers, sidebars, notices, adverts, forms and reader comments, by element, role, class or id."""
    if tag in FURNITURE or (tag == "header" and not inside):
        return True
    if tag in ARTICLE or tag in ("body", "html") or not attr or "=" not in attr and "hidden" not in attr.lower():
        return False
    for m in ATTR.finditer(attr):
        name, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
        if name == "role":
            if value.strip().lower() in ROLES:
                return True
        elif name == "hidden":
            return True
        elif name == "aria-hidden":
            if value.strip().lower() == "true":
                return True
        elif name in ("class", "id") and not (inside and tag in HEADINGS) and names_furniture(value, inside):
            return True
    return False


def tags(source: str) -> tuple[list[tuple[int, int, str, bool, str]], list[int]]:
    """(start, end, element, closing, attributes) of each piece of markup, and for each start tag the place of its end tag (-1: none).

    An end tag closes the last open start tag of its element, so one that is never closed takes no other's end.
    """
    found, ends = [], []
    waiting: dict[str, list[int]] = {}
    for i, m in enumerate(TOKEN.finditer(source)):
        tag = (m.group("tag") or m.group("tag2") or "").lower()
        closing = bool(m.group("close") or m.group("close2"))
        found.append((m.start(), m.end(), tag, closing, m.group("attr") or m.group("attr2") or ""))
        ends.append(-1)
        if tag and not closing:
            waiting.setdefault(tag, []).append(i)
        elif tag and waiting.get(tag):
            ends[waiting[tag].pop()] = i
    return found, ends


def past(i: int, found: list, ends: list[int], limit: int) -> int:
    """The piece of markup at which the skipped element that piece ``i`` begins is over; ``limit``: its parent's end."""
    tag = found[i][2]
    if 0 <= ends[i] < limit:
        return ends[i] + 1
    for j in range(i + 1, limit):
        other, closing = found[j][2], found[j][3]
        if (tag == "p" and other in BLOCKS) or (tag in IMPLIED and other == tag) or (other in ARTICLE and not closing) or (closing and other in ("body", "html")):
            return j
    return limit


def blocks(source: str) -> list[tuple[str, bool]]:
    """Text blocks in page order, and whether each is inside an article or main element; markup decides nothing about the others.

    Furniture is skipped to its end tag. One that has none within its parent ends with the parent, or where an article begins.
    """
    out: list[tuple[str, bool]] = []
    parts: list[str] = []
    found, ends = tags(source)
    parents: list[int] = []  # where the elements that we are in end
    inside = 0  # depth of article and main elements
    at = i = 0

    def flush() -> None:
        if parts:
            text = " ".join(htmllib.unescape("".join(parts)).split())
            if text:
                out.append((text, inside > 0))
            parts.clear()

    while i < len(found):
        start, end, tag, closing, attr = found[i]
        if start > at:
            parts.append(source[at:start])
        at = end
        while parents and parents[-1] <= i:
            parents.pop()
        i += 1
        if not tag:
            continue
        if closing:
            if tag in BLOCKS:
                flush()
            elif tag in ("td", "th"):
                parts.append(" ")
            if tag in ARTICLE and inside:
                inside -= 1
            continue
        limit, skipped = parents[-1] if parents else len(found), i - 1
        if is_furniture(tag, attr, inside > 0):
            if tag in BLOCKS or (tag in FURNITURE and tag not in INLINE):
                flush()
            if tag not in VOID and not attr.endswith("/"):
                i = past(i - 1, found, ends, limit)
                at = found[i][0] if i < len(found) else len(source)
                if found[i - 1][3] and ends[skipped] == i - 1:
                    at = found[i - 1][1]
            continue
        if tag in BLOCKS:
            flush()
        elif tag in ("br", "td", "th"):
            parts.append(" ")
        if tag in ARTICLE:
            inside += 1
        if i - 1 < ends[i - 1] < limit:
            parents.append(ends[i - 1])
    if at < len(source):
        parts.append(source[at:])
    flush()
    return out


def suffixes(pages: DataFrame, run: int = RUN) -> DataFrame:
    """(host, page, prefix, at): each suffix of the token streams that markup leaves undecided, cut to its first ``run`` tokens.

    Suffixes with the same prefix stand together in the host's suffix array; how they go on doesn't matter for which
    tokens a repeat of ``run`` or more covers, so the array is sorted to that depth and no further. A page has one suffix at
    least (null prefix), so that a host's pages can be counted.
    """

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        streams, some = [], []
        for source in b.column(2).to_pylist():
            open_ = [text for text, sure in blocks(source or "") if not sure]
            streams.append(" ".join(open_))
            some.append(bool(open_))
        w = Words(pa.array(streams, pa.string()))
        grams, first = w.grams(run)
        doc = w.doc[first]
        begin = np.searchsorted(w.doc, np.arange(b.num_rows))
        once = np.flatnonzero(some)
        rows = pa.array(np.concatenate([doc, once]))
        prefix = pa.concat_arrays([pa.array(signed(grams)), pa.nulls(len(once), pa.int64())])
        return pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), prefix, pa.array(np.concatenate([first - begin[doc], np.zeros(len(once), int)]).astype(np.int32))], ["host", "page", "prefix", "at"])

    return map_arrow(pages.select("host", "page", "html"), work, "host string, page bigint, prefix bigint, at int", "html")


def covered(pages: DataFrame, run: int = RUN) -> DataFrame:
    """(page, at array): where a run of tokens begins that two or more pages of the host have, at
    least ``SHARE`` of the host's undecided pages or ``PAGES`` of them do.

    Pages are counted by a partial aggregate, a run and page once, so a run that every page of a hot host has is spread over
    the tasks first; a page's own runs come back together, as many as the page has tokens.
    """
    found = checkpoint(suffixes(pages, run))
    each = found.select("host", "prefix", "page").distinct().groupBy("host", "prefix").agg(F.count("*").alias("n"))
    size = each.where("prefix IS NULL").select("host", F.greatest(F.lit(2.0), F.least(F.lit(float(PAGES)), F.col("n") * SHARE)).alias("needed"))
    again = each.where("prefix IS NOT NULL AND n > 1").join(size, "host").where("n >= needed").select("host", "prefix")
    return found.join(again, ["host", "prefix"], "left_semi").groupBy("page").agg(F.collect_set("at").alias("at"))


def unique_runs(texts: list[tuple[str, bool]], starts: list[int] | None, run: int) -> list[str]:
    """The blocks, those that markup leaves undecided without the tokens that repeats cover."""
    if not starts:
        return [text for text, _ in texts]
    drop = {s + j for s in starts for j in range(run)}
    out, at = [], 0
    for text, sure in texts:
        if sure:
            out.append(text)
            continue
        tokens = re.findall(r"[^\x20\x09-\x0D]+", text)
        kept = [t for i, t in enumerate(tokens, at) if i not in drop]
        at += len(tokens)
        if kept:
            out.append(" ".join(kept))
    return out


def main_text(pages: DataFrame, run: int = RUN, url: str = "url", html: str = "html", key: str = "page_id") -> DataFrame:
    """``key``, ``url``, ``text`` and ``n_chars`` of every row.

    Blocks inside an article or main element, without furniture, are text, whole: an article that two pages of a host show is no
    boilerplate. Blocks that no markup decides about, on the same page or on one without such an element, lose the runs of ``run``
    tokens or more that other pages of the host have too, and keep the rest, in page order. Null html is empty; a null url has the empty
    host. Rows that repeat one page (key, url and html) are one page to the search and each get its text.
    """
    rows = pages.select(F.col(key), F.col(url).alias("url"), F.col(html).alias("html"))
    seen = with_parts(rows.withColumn("page", F.xxhash64(key, "url", "html")))
    where = checkpoint(covered(seen, run))
    kind = pages.schema[key].dataType.simpleString()
    rows = rows.withColumn("at", F.lit(None).cast("array<int>")) if where.isEmpty() else rows.withColumn("page", F.xxhash64(key, "url", "html")).join(where, "page", "left").select(key, "url", "html", "at")

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for source, starts in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            out.append("\n".join(unique_runs(blocks(source or ""), starts, run)))
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], [key, "url", "text", "n_chars"])

    return map_arrow(rows, work, f"`{key}` {kind}, url string, text string, n_chars bigint", "html")
