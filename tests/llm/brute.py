"""Plain single-process versions of what the operators compute."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def joined(intervals):
    out = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def quality_counts(text):
    w = words(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {i + j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cover)


def repeats(rows, least):
    docs = {(i, t or ""): words(t) for i, t in rows}
    where, ids = defaultdict(set), defaultdict(set)
    for (i, t), w in docs.items():
        ids[t].add(i)
        for k in range(len(w) - least + 1):
            where[tuple(w[k : k + least])].add(t)
    out = set()
    for (i, t), w in docs.items():
        if len(ids[t]) > 1 and len(w) >= least:
            out.add((i, 0, len(w)))
        else:
            out |= {(i, a, b) for a, b in joined((k, k + least) for k in range(len(w) - least + 1) if len(where[tuple(w[k : k + least])]) > 1)}
    return out


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near(rows, similar=0.8):
    sets = [shingles(t) for _, t in rows]
    where = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            where[x].append(k)
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = Counter()
    for k, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in where[x] if j > k).items():
            if n >= similar * (len(s) + len(sets[j]) - n) - 1e-9:
                links[k] += 1
                links[j] += 1
                a, b = root(k), root(j)
                up[max(a, b)] = min(a, b)
    classes = defaultdict(list)
    for k in range(len(rows)):
        classes[root(k)].append(rows[k][0])
    return sorted((rows[k][0], min(classes[root(k)]), links[k]) for k in range(len(rows)))


PII = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def pii(text):
    out = []
    for k, p in enumerate(PII):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            good = (True, k == 1 and all(int(x) <= 255 for x in m.group().split(".")), 12 <= len(d) <= 19 and luhn(d), 9 <= len(d) <= 15)[k]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def local_alignment(a, b, match=2, mismatch=-1, gap=-1):
    best, prev = 0, [0] * (len(b) + 1)
    for x in a:
        cur = [0]
        for j, y in enumerate(b, 1):
            cur.append(max(0, prev[j - 1] + (match if x == y else mismatch), prev[j] + gap, cur[-1] + gap))
        best, prev = max(best, *cur), cur
    return best


def pagerank(edges, seeds, damping=0.85, rounds=200):
    out = Counter()
    for (a, _), n in edges.items():
        out[a] += n
    rank = dict(seeds)
    for _ in range(rounds):
        new = dict(seeds)
        for (a, b), n in edges.items():
            new[b] = new.get(b, 0.0) + damping * rank.get(a, 0.0) * n / out[a]
        rank = new
    return rank
