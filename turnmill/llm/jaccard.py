"""Near-duplicate documents by a chosen-path join: sets meet on sampled shared tokens, recursively, and are checked exactly."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, Words, apply, brief_shuffles, checkpoint, dealt, lists, map_arrow, mix, signed
from .components import components

SHINGLE, SIMILAR = 5, 0.8
#: Tokens that a set samples in expectation; each is the first step of a path, so this is the number of repeated runs.
RUNS = 24
#: Tokens by which a set in a large bucket goes on, in expectation and at least one; a pair at the threshold shares at least 0.8
#: of them, so its shared paths grow from step to step. Steps after which a bucket is taken as one family.
BRANCH, DEPTH = 1.5, 5
#: Sets of a bucket that are compared by brute force; sets of a block in the exact check.
SMALL, BLOCK = 64, 2048
#: Sets that no centre of a large bucket reached and that are compared with all of the bucket by brute force, in parts of about
#: as many of its other sets; more go on.
REST = 512
#: Estimated similarities: two sets of a bucket from ``NEAR`` on belong to one family. In a large bucket a set joins the family
#: of a centre from ``REACH`` on and leaves the bucket from ``CLOSE`` on: what is near a set that left is within reach of the
#: same centre, since estimated distances obey the triangle inequality too (1 - REACH >= (1 - NEAR) + (1 - CLOSE)).
NEAR, REACH, CLOSE = 0.5, 0.4, 0.9
#: Sets that reached two centres or more, by the bits of the centres: the families of those centres are one.
KINDS = (7, 3, 5, 6)
SALT = U(0x5851F42D4C957F2D)


# --------------------------------------------------------------------------- sets
def shingle_sets(w: Words, n: int, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, token): the distinct shingles of each of ``n`` rows, by row; a shorter text is one shingle of all its words."""
    grams, at = w.grams(size)
    doc = w.doc[at]
    count = np.bincount(w.doc, minlength=n)
    begin = np.searchsorted(w.doc, np.arange(n))
    parts, docs = [grams], [doc]
    for k in range(1, size):
        rows = np.flatnonzero(count == k)
        g = np.full(len(rows), U(k))
        for j in range(k):
            g = g * U(0xD6E8FEB86659FD93) + w.hash[begin[rows] + j]
        parts.append(mix(g))
        docs.append(rows)
    g, d = np.concatenate(parts), np.concatenate(docs)
    if len(docs[1:]) and sum(map(len, docs[1:])):
        order = np.argsort(d, kind="stable")
        g, d = g[order], d[order]
    keep = first_of_each(g ^ mix(np.arange(n, dtype=U) + U(11))[d])
    return d[keep], g[keep]


def first_of_each(keys: np.ndarray) -> np.ndarray:
    """Which keys occur for the first time. Few repeat, so all are sorted plainly and only the repeated ones with their places."""
    s = np.sort(keys)
    again = np.unique(s[1:][s[1:] == s[:-1]]) if len(s) else s
    keep = np.ones(len(keys), bool)
    if len(again):
        bits = np.zeros(1 << 20, bool)
        bits[(again >> U(44)).astype(np.int64)] = True
        at = np.flatnonzero(bits[(keys >> U(44)).astype(np.int64)])
        order = at[np.argsort(keys[at], kind="stable")]
        k = keys[order]
        keep[order[1:][k[1:] == k[:-1]]] = False
    return keep


def prints(doc: np.ndarray, token: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and fingerprint of each row's set; 0 for an empty one."""
    size = np.bincount(doc, minlength=n)
    total = np.concatenate([np.zeros(1, U), np.cumsum(mix(token + U(3)), dtype=U)])
    end = np.cumsum(size)
    return size, np.where(size > 0, mix(total[end] - total[end - size] + size.astype(U)), U(0))


def limit(size: np.ndarray, runs: int) -> np.ndarray:
    """Tokens whose rank hash is below this are sampled: ``runs`` of a set in expectation, all of a small one."""
    return np.where(size <= runs, np.iinfo(np.uint64).max, (runs / np.maximum(size, 1) * 2.0**64).clip(0, 2.0**63.9).astype(U))


def signatures(docs: DataFrame, runs: int, text: str, key: str) -> DataFrame:
    """(id, set, size, sketch): fingerprint, size and sampled tokens' rank hashes, sorted, of each row."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n = b.num_rows
        doc, token = shingle_sets(Words(b.column(1)), n)
        size, fp = prints(doc, token, n)
        u = mix(token ^ SALT)
        hit = u < limit(size, runs)[doc]
        d, u = doc[hit], u[hit]
        order = np.lexsort((u, d))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(signed(fp)), pa.array(size.astype(np.int32)), lists(signed(u[order]), np.bincount(d, minlength=n), pa.int64())], ["id", "set", "size", "sketch"])

    kind = docs.schema[key].dataType.simpleString()
    return map_arrow(docs.select(key, text), run, f"id {kind}, set bigint, size int, sketch array<bigint>", text)


def estimate(a: np.ndarray, na: int, b: np.ndarray, nb: int, runs: int) -> float:
    """Similarity by the sampled tokens below both limits (sorted unsigned rank hashes)."""
    if na < nb:
        a, na, b, nb = b, nb, a, na
    common = len(np.intersect1d(a, b, assume_unique=True))
    if na <= runs:
        return common / max(1, len(a) + len(b) - common)
    low = int(np.searchsorted(b, limit(np.array([na]), runs)[0]))
    return common / max(1, len(a) + low - common)


# ------------------------------------------------------------------------- groups
def stream(key: list[str], fn: Callable[[pa.Table], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function over rows sorted by ``key``: calls ``fn`` with the rows of one key after another."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            cols = [b.column(b.schema.get_field_index(k)).to_numpy() for k in key]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            for x, y in zip([0, *change], [*change, b.num_rows], strict=True):
                this = tuple(c[x] for c in cols)
                if held and this != last:
                    out = fn(pa.Table.from_batches(held))
                    held = []
                    if out is not None and out.num_rows:
                        yield out
                held.append(b.slice(x, y - x))
                last = this
        if held:
            out = fn(pa.Table.from_batches(held))
            if out is not None and out.num_rows:
                yield out

    return go


def ragged(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column."""
    arr = col.combine_chunks()
    arr = arr.combine_chunks() if isinstance(arr, pa.ChunkedArray) else arr
    off = arr.offsets.to_numpy()
    return arr.values.to_numpy()[off[0] : off[-1]].view(U), off - off[0]


def forest(n: int, rows: np.ndarray, cols: np.ndarray) -> tuple[list[tuple[int, int]], list[int]]:
    """Spanning edges of a graph on ``n`` nodes and each node's root (its component's first node)."""
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kept = []
    for a, b in zip(rows.tolist(), cols.tolist(), strict=True):
        x, y = root(a), root(b)
        if x != y:
            up[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept, [root(x) for x in range(n)]


def estimates(values: np.ndarray, off: np.ndarray, size: np.ndarray, runs: int) -> np.ndarray:
    """Estimated similarities of all pairs of a bucket; right where the row's set is at least as large as the column's."""
    inter = intersections(values, off)
    high = limit(size, runs)
    low = np.stack([np.searchsorted(values[off[j] : off[j + 1]], high) for j in range(len(size))], axis=1)
    return inter / np.maximum(1, np.diff(off)[:, None] + low - inter)


def bucket_edges(runs: int, near: float) -> Callable[[pa.Table], pa.RecordBatch | None]:
    def fn(t: pa.Table) -> pa.RecordBatch | None:
        ids, size = t.column("set").to_numpy(), t.column("size").to_numpy()
        values, off = ragged(t.column("sketch"))
        if len(ids) == 2:
            if estimate(values[: off[1]], size[0], values[off[1] :], size[1], runs) < near:
                return None
            return pa.RecordBatch.from_arrays([pa.array(ids[:1]), pa.array(ids[1:])], ["a", "b"])
        linked = (estimates(values, off, size, runs) >= near) & (size[:, None] >= size[None, :])
        np.fill_diagonal(linked, False)
        kept, _ = forest(len(ids), *np.nonzero(linked))
        if not kept:
            return None
        a, b = np.array(kept).T
        return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

    return fn


def to_centres(values: np.ndarray, off: np.ndarray, size: np.ndarray, cval: np.ndarray, coff: np.ndarray, csize: np.ndarray, runs: int) -> np.ndarray:
    """Estimated similarity of each row's set with the centre beside it, for all rows at once."""
    n = len(size)
    row, crow = np.repeat(np.arange(n), np.diff(off)), np.repeat(np.arange(n), np.diff(coff))
    tag = mix(np.arange(n, dtype=U) + U(5))
    common = np.bincount(row[np.isin(values ^ tag[row], cval ^ tag[crow])], minlength=n)
    bound = limit(np.maximum(size, csize), runs)
    mine = np.bincount(row[values < bound[row]], minlength=n) if len(row) else np.zeros(n)
    its = np.bincount(crow[cval < bound[crow]], minlength=n) if len(crow) else np.zeros(n)
    small = np.maximum(size, csize) <= runs  # then the sketches are the sets
    mine, its = np.where(small, np.diff(off), mine), np.where(small, np.diff(coff), its)
    return common / np.maximum(1, mine + its - common)


def intersections(values: np.ndarray, off: np.ndarray, cut: int | None = None, step: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets with all, or of those before ``cut`` with those from it on.

    Products of 0/1 blocks over the tokens that two sets or more have.
    """
    n = len(off) - 1
    if n == 2 and cut is None:
        c = len(np.intersect1d(values[: off[1]], values[off[1] :], assume_unique=True))
        return np.array([[off[1], c], [c, off[2] - off[1]]])
    row = np.repeat(np.arange(n), np.diff(off))
    _, col, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count > 1
    name = np.cumsum(shared) - 1
    keep = shared[col]
    row, col = row[keep], name[col[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((n, n) if cut is None else (cut, n - cut), np.float32)
    m = np.zeros((n, step), np.float32)
    for lo in range(0, int(shared.sum()), step):
        x, y = np.searchsorted(col, [lo, lo + step])
        m[:] = 0
        m[row[x:y], col[x:y] - lo] = 1
        out += m @ m.T if cut is None else m[:cut] @ m[cut:].T
    out = np.rint(out).astype(np.int32)
    if cut is None:
        np.fill_diagonal(out, np.diff(off))
    return out


def checked(similar: float) -> Callable[[pa.Table], pa.RecordBatch | None]:
    """Exact links inside a block, or between two: per set the linked documents, spanning edges, and the class if there's one block."""

    def fn(t: pa.Table) -> pa.RecordBatch | None:
        blocks, lo, hi = t.column("blocks")[0].as_py(), t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
        t = t.take(pa.array(np.argsort(t.column("own").to_numpy(), kind="stable"))) if lo != hi else t
        ids, copies, own = (t.column(c).to_numpy() for c in ("set", "copies", "own"))
        values, off = ragged(t.column("tokens"))
        size = np.diff(off).astype(np.int32)
        cut = int((own == lo).sum()) if lo != hi else None
        if cut is not None and cut in (0, len(ids)):
            return None
        inter = intersections(values, off, cut)
        a, b = (size, size) if cut is None else (size[:cut], size[cut:])
        linked = inter >= similar * (a[:, None] + b[None, :] - inter) - 1e-9
        if cut is None:
            np.fill_diagonal(linked, False)
            links = linked @ copies
            rows, cols = np.nonzero(np.triu(linked))
        else:
            links = np.concatenate([linked @ copies[cut:], copies[:cut] @ linked])
            rows, cols = np.nonzero(linked)
            cols = cols + cut
        kept, root = forest(len(ids), rows, cols)
        to: list[list[int]] = [[] for _ in ids]
        if blocks > 1:
            for x, y in kept:
                to[x].append(int(ids[y]))
            name = [None] * len(ids)
        else:
            least: dict[int, int] = {}
            for i, r in enumerate(root):
                least[r] = min(least.get(r, int(ids[i])), int(ids[i]))
            name = [least[r] for r in root]
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links.astype(np.int64)), pa.array(name, pa.int64()), pa.array(to, pa.list_(pa.int64()))], ["set", "links", "class", "to"])

    return fn


# --------------------------------------------------------------------------- join
def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (path, set, ...) of buckets with two sets or more, as (small, large) ones.

    Buckets with the same sets are one; a large one has their number as ``runs``, so that their sets go on as often.
    """
    mark = [F.bit_xor(F.xxhash64("set", F.lit(k))).alias(f"m{k}") for k in (1, 2)]
    buckets = rows.groupBy("path").agg(F.count("*").alias("n"), *mark).where("n > 1")
    once = buckets.groupBy("n", "m1", "m2").agg(F.min("path").alias("path"), F.count("*").cast("int").alias("runs")).select("path", "runs", "n")
    both = checkpoint(rows.join(once, "path"))
    return both.where(F.col("n") <= SMALL).select("path", "set"), both.where(F.col("n") > SMALL).drop("n")


def candidate_edges(sets: DataFrame, runs: int) -> DataFrame:
    """(a, b): enough edges to hold every family of sets together, by the recursion over buckets; an edge may repeat.

    A small bucket is compared by brute force on the sketches. In a large one every set is compared with three centres: it
    is joined to those within reach, leaves the bucket if it is close to one, and else goes on along tokens sampled by the
    path, the first of them at least. Where the centres hold all sets but a few together as one family, those few are compared
    with each set of the bucket and the bucket is done. The set with the shortest sketch is a centre, so one without tokens left to go on by
    is compared with the whole bucket. A bucket that is still large after ``DEPTH`` steps becomes one family: the exact
    check sorts it out.
    """
    small, large = split(sets.select(F.explode("sketch").alias("path"), "set"))
    lists_ = [small]
    found: list[DataFrame] = []
    sketches = sets.select("set", "size", "sketch")
    large = large.withColumn("used", F.array("path"))
    kind = pa.list_(pa.int64())
    for depth in range(1, DEPTH + 1):
        if not large.select("path").take(1):  # isEmpty would shuffle
            break
        large = large.join(sketches, "set")
        one = F.struct("set", "size", "sketch")
        centres = large.groupBy("path").agg(F.min_by(one, "set").alias("c0"), F.min_by(one, F.xxhash64("set")).alias("c1"), F.min_by(one, F.struct(F.size("sketch"), "set")).alias("c2"))
        last = depth == DEPTH

        def step(b: pa.RecordBatch, last: bool = last) -> pa.RecordBatch:
            t = pa.Table.from_batches([b])
            path, ids, size, times = (t.column(c).to_numpy() for c in ("path", "set", "size", "runs"))
            values, off = ragged(t.column("sketch"))
            best, near, mask = np.zeros(len(ids)), [], np.zeros(len(ids), np.int32)
            for bit, c in enumerate(("c0", "c1", "c2")):
                centre = t.column(c).combine_chunks()
                cid = centre.field(0).to_numpy()
                x = np.where(cid == ids, 1.0, to_centres(values, off, size, *ragged(pa.chunked_array([centre.field(2)])), centre.field(1).to_numpy(), runs))
                best = np.maximum(best, x)
                mask |= ((x >= REACH) | last).astype(np.int32) << bit
                near.append(np.where((cid != ids) & ((x >= REACH) | last), cid, 0))
            stay = np.flatnonzero(best < CLOSE) if not last else np.zeros(0, np.int64)
            paths: list[list[int]] = [[] for _ in ids]
            uses: list[list[list[int]]] = [[] for _ in ids]
            used = t.column("used").take(pa.array(stay)).to_pylist()
            for i, u in zip(stay.tolist(), used, strict=True):
                mine = values[off[i] : off[i + 1]]
                rest = mine[~np.isin(mine, np.array(u).view(U))]
                if not len(rest):
                    continue
                h = mix(rest ^ path[i : i + 1].view(U))
                pick = h < limit(np.array([len(rest)]), BRANCH * times[i])[0]
                pick[h.argmin()] = True
                paths[i] = signed(h[pick]).tolist()
                uses[i] = [[*u, v] for v in rest[pick].view(np.int64).tolist()]
            return pa.RecordBatch.from_arrays([pa.array(path), pa.array(ids), pa.array(mask), pa.array(np.stack(near, 1).tolist(), kind), pa.array(paths, kind), pa.array(uses, pa.list_(kind))], ["bucket", "set", "mask", "near", "paths", "uses"])

        rows = large.join(centres, "path").select("path", "set", "size", "sketch", "used", "runs", "c0", "c1", "c2")
        out = checkpoint(map_arrow(rows, step, "bucket bigint, set bigint, mask int, near array<bigint>, paths array<bigint>, uses array<array<bigint>>"))
        # a set is joined to its first centre, one set of each kind to the others too; it meets the same centres on many paths
        first = F.when(F.col("mask") % 2 == 1, F.get("near", F.lit(0))).when(F.col("mask") % 4 == 2, F.get("near", F.lit(1))).when(F.col("mask") == 4, F.get("near", F.lit(2)))
        found.append(out.select(F.col("set").alias("a"), first.alias("b")).where("b <> 0"))
        # one aggregate a bucket: a set of each kind, the centres, the sets that no centre reached
        kinds = [F.min(F.when(F.col("mask") == k, F.col("set"))).alias(f"x{k}") for k in KINDS]
        centre = [F.max(F.nullif(F.get("near", F.lit(j)), F.lit(0).cast("long"))).alias(f"c{j}") for j in range(3)]
        state = checkpoint(out.groupBy("bucket").agg(*kinds, *centre, F.count_if(F.col("mask") == 0).alias("rest"), F.count("*").alias("n")))
        pairs = [F.struct(F.col(f"x{k}").alias("a"), F.col(f"c{j}").alias("b")) for k in KINDS for j in range(3) if k >> j & 1]
        found.append(state.select(F.explode(F.array(*pairs)).alias("e")).select("e.a", "e.b").where("a <> b"))
        # all sets that a centre reached are one family if the centres are joined to each other too; then only the others are left,
        # and a few of those are compared with every set of the bucket, in buckets of a part of the family each
        has = [F.col(f"x{k}").isNotNull().cast("int") for k in KINDS]
        held = (has[0] == 1) | (has[1] + has[2] + has[3] >= 2)
        done = state.where(held & (F.col("rest") <= REST)).select("bucket", "rest", F.ceil((F.col("n") - F.col("rest")) / F.greatest(F.lit(SMALL), "rest")).cast("int").alias("parts"))
        few = out.join(done.where("rest > 0"), "bucket").select("bucket", "set", "mask", "parts")
        part = F.when(F.col("mask") == 0, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("set"), F.col("parts").cast("long")).cast("int")))
        lists_.append(few.select("bucket", "set", F.explode(part).alias("part")).select(F.xxhash64("bucket", "part", F.lit(depth)).alias("path"), "set"))
        onward = out.where(F.size("paths") > 0).join(done.select("bucket"), "bucket", "left_anti").select("set", F.explode(F.arrays_zip("paths", "uses")).alias("x"))
        small, large = split(onward.select("set", F.col("x.paths").alias("path"), F.col("x.uses").alias("used")))
        lists_.append(small)
    members = lists_[0]
    for x in lists_[1:]:
        members = members.unionByName(x)
    # the same sets meet in many buckets; each company is compared once
    company = members.groupBy("path").agg(F.sort_array(F.collect_set("set")).alias("members")).select("members").distinct().withColumn("company", F.xxhash64("members"))
    rows = dealt(company.select("company", F.explode("members").alias("set")).join(sketches, "set"), "company")
    edges = apply(rows.select("company", "set", "size", "sketch"), stream(["company"], bucket_edges(runs, NEAR)), "a bigint, b bigint")
    for x in found:
        edges = edges.unionByName(x)
    return edges


def token_sets(docs: DataFrame, needed: DataFrame, text: str, key: str) -> DataFrame:
    """(family, blocks, set, copies, tokens) of the needed sets, from the whole text of one document each."""
    needed = needed.hint("shuffle_hash")
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    joined = rows.join(needed, rows["id"].eqNullSafe(needed["rep"])).select("text", "set", "family", "blocks", "copies")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n = b.num_rows
        doc, token = shingle_sets(Words(b.column(0)), n)
        size, fp = prints(doc, token, n)
        same = signed(fp) == b.column(1).to_numpy()  # a key may have other texts too
        keep = np.flatnonzero(same)
        sel = same[doc]
        at = pa.array(keep)
        return pa.RecordBatch.from_arrays([b.column(2).take(at), b.column(3).take(at), b.column(1).take(at), b.column(4).take(at), lists(signed(token[sel]), size[keep], pa.int64())], ["family", "blocks", "set", "copies", "tokens"])

    return map_arrow(joined, run, "family bigint, blocks int, set bigint, copies bigint, tokens array<bigint>", "text").dropDuplicates(["set"])


def named_sets(docs: DataFrame, similar: float, runs: int, text: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(id, set, size, sketch) of each row and (set, copies, rep, links, class) of each set, both checkpointed."""
    sig = checkpoint(signatures(docs, runs, text, key))
    some = sig.where("size > 0")
    sets = checkpoint(some.groupBy("set").agg(F.count("*").alias("copies"), F.min("id").alias("rep"), F.first("size").alias("size"), F.first("sketch").alias("sketch")))
    families = components(candidate_edges(sets, runs)).select(F.col("node").alias("set"), F.col("component").alias("family"))
    blocks = families.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    needed = checkpoint(families.join(blocks, "family").join(sets.select("set", "copies", "rep"), "set"))
    own = F.pmod(F.xxhash64("set"), F.col("blocks").cast("long")).cast("int")
    tokens = token_sets(docs, needed, text, key).withColumn("own", own)
    spread = tokens.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    grouped = dealt(spread, "family", "lo", "hi").select("family", "lo", "hi", "blocks", "own", "set", "copies", "tokens")
    exact = checkpoint(apply(grouped, stream(["family", "lo", "hi"], checked(similar)), "set bigint, links bigint, class bigint, to array<bigint>"))
    linked = exact.groupBy("set").agg(F.sum("links").alias("links"), F.min("class").alias("class"))
    edges = exact.where(F.size("to") > 0).select(F.col("set").alias("a"), F.explode("to").alias("b"))
    if edges.take(1):
        big = components(edges)
        linked = linked.join(big.withColumnRenamed("node", "set"), "set", "left").select("set", "links", F.coalesce("component", "class").alias("class"))
    named = sets.select("set", "copies", "rep").join(linked, "set", "left").select("set", "copies", "rep", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("class", "set").alias("class"))
    return sig, checkpoint(named)


def near_duplicates(docs: DataFrame, similar: float = SIMILAR, runs: int = RUNS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, class_id, n_links) of every row: Jaccard similarity of five-word shingle sets of at least ``similar`` links.

    Sets are joined by chosen paths over sampled tokens, then all pairs inside a family of candidates are checked exactly in
    blocks, so links are exact there; a pair is missed only if no run brings it together or its sketches' estimate is under ``NEAR``
    (by a binomial model about 3 in 10^4 at the threshold). A class is a connected component of links, named by its least key; ``n_links`` counts the other rows
    that a row links to. A text under five words is one shingle of all its words. Null and empty texts have no shingles:
    each such row is a class of its own without links. Equal texts are linked, repeated rows too. Copies share one set, so
    they cost one row. An empty table gives an empty result.
    """
    with brief_shuffles(docs.sparkSession):
        sig, named = named_sets(docs, similar, runs, text, key)
    some = sig.where("size > 0")
    least = named.groupBy("class").agg(F.min("rep").alias("class_id"))
    out = some.select(F.col("id"), "set").join(named.join(least, "class").select("set", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links")), "set")
    empty = sig.where("size = 0").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.select(F.col("id").alias(key), "class_id", "n_links").unionByName(empty.withColumnRenamed("id", key))


def one_of_each(docs: DataFrame, similar: float = SIMILAR, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each class: that of the least key; of rows that repeat it, one.

    Rows without shingles stay. A null key is kept only if its class has no other key.
    """
    classes = checkpoint(near_duplicates(docs, similar, text=text, key=key))
    keep = classes.where(F.col(key).eqNullSafe(F.col("class_id"))).groupBy(key).agg(F.count("*").alias("__rows")).withColumnRenamed(key, "__key")
    keep = checkpoint(keep)
    names = docs.columns
    out = docs.join(keep, docs[key].eqNullSafe(keep["__key"])).select(*names, "__rows")
    if keep.where("__rows > 1").isEmpty():
        return out.select(*names)
    # keys with several rows: equal texts once
    twice = out.where("__rows > 1").dropDuplicates([key, text])
    return out.where("__rows = 1").unionByName(twice).select(*names)


def oracle(table: str, similar: float = SIMILAR, size: int = SHINGLE) -> str:
    """DuckDB SQL of ``near_duplicates``: all pairs that share a shingle. For small tables."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM {table}),
s AS (
  SELECT DISTINCT r, unnest(CASE WHEN len(w) >= {size} THEN list_transform(range(1, len(w) - {size - 2}), lambda i: array_to_string(w[i:i + {size - 1}], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
one AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE c >= {similar} * (x.n + y.n - c) - 1e-9),
links AS (SELECT a, b FROM one UNION ALL SELECT b, a FROM one),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
class AS (SELECT reach.a AS r, min(doc_id) AS class_id FROM reach JOIN d ON d.r = reach.b GROUP BY 1),
degree AS (SELECT a AS r, count(*) AS n_links FROM links GROUP BY 1)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links FROM d JOIN class USING (r) LEFT JOIN degree USING (r)
"""
