"""The prefix trie of conversations: chained digests name every prefix, nodes are groups of equal prefixes, subtrees add up
along the ancestors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOOKUP_ROWS, apply, stash

#: Bytes of a prefix's SHA-256 that name its node: two different ones of 10^12 share them with a chance below 10^-14.
NAME = 16
#: The root's digest, from which every conversation's chain begins.
ROOT = hashlib.sha256(b"").digest()
#: Children of a parent that one task may look up by a shuffle on the parent.
CHILDREN = 1_000


def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256 of a turn; the role's length in front, so that no other pair of role and text gives the same bytes."""
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


def numbered(turns: DataFrame) -> DataFrame:
    """(conv, p, digest, len) of a conversation table: turns in order from 0, texts left where they were read.

    Null turns come first, turns of the same number in the order of their digests; a null role or text is empty; rows without
    a conversation belong to none.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    thin = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), "turn", turn_digest(role, text).alias("digest"), F.length(text).alias("len"))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return thin.select("conv", (F.row_number().over(order) - 1).alias("p"), "digest", "len")


def rebuilt(turns: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """(conv, part, p, digest, len) of the contract's conversations: the first h turns of the block's first conversation, then
    the own ones after the first h, h being crc32(conv) modulo ``most``; one row of part -1 for each conversation.

    A head goes to at most ``block`` conversations, so no key of the join is hot.
    """
    turns = stash(turns)
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(most))
    convs = turns.where("p = 0").select("conv", (F.col("conv") - F.col("conv") % block).alias("base"), h.alias("h"))
    none = F.lit(None).cast("binary"), F.lit(0)
    starts = convs.select("conv", F.lit(-1).alias("part"), F.lit(0).alias("p"), none[0].alias("digest"), none[1].alias("len"))
    own = turns.where(F.col("p") >= h).select("conv", F.lit(1).alias("part"), "p", "digest", "len")
    heads = turns.where((F.col("conv") % block == 0) & (F.col("p") < most)).select(F.col("conv").alias("base"), "p", "digest", "len")
    given = convs.join(heads, "base").where(F.col("p") < F.col("h")).select("conv", F.lit(0).alias("part"), "p", "digest", "len")
    return starts.unionByName(own).unionByName(given)


def chained(rows: DataFrame) -> DataFrame:
    """(conv, depth, node, parent, len, last) of (conv, part, p, digest, len): one row a prefix, the root's first.

    A conversation's thin rows stand in order in one partition and are read as a stream, whose state is one digest, so a
    conversation of any length takes the same memory. ``last`` marks the whole conversation.
    """
    names = ["conv", "depth", "node", "parent", "len", "last"]
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, depth, state, held = None, 0, ROOT, None
        for b in batches:
            if not b.num_rows:
                continue
            ids = np.asarray(b.column(0))
            nodes, parents, depths = [], [], []
            for c, d in zip(ids.tolist(), b.column(1).to_pylist(), strict=True):
                if c != conv or d is None:
                    conv, depth, before, state = c, 0, None, ROOT
                else:
                    depth, before, state = depth + 1, state[:NAME], hashlib.sha256(state + d).digest()
                nodes.append(state[:NAME])
                parents.append(before)
                depths.append(depth)
            if held is not None:  # the row before is its conversation's last if this batch begins with another one
                yield pa.RecordBatch.from_arrays([*held.columns, pa.array([held.column(0)[0].as_py() != int(ids[0])])], names)
            ends = pa.array(np.append(ids[1:] != ids[:-1], False))
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(depths, kinds[1]), pa.array(nodes, kinds[2]), pa.array(parents, kinds[3]), b.column(2), ends], names)
            n = out.num_rows - 1
            held = pa.RecordBatch.from_arrays([c.slice(n) for c in out.columns[:5]], names[:5])
            if n:
                yield out.slice(0, n)
        if held is not None:
            yield pa.RecordBatch.from_arrays([*held.columns, pa.array([True])], names)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(n, F.xxhash64("conv", F.lit(1))).sortWithinPartitions("conv", "part", "p").select("conv", "digest", "len")
    return apply(ordered, run, "conv bigint, depth int, node binary, parent binary, len int, last boolean")


def end_digests(ends: DataFrame, chunk: str = "conv") -> DataFrame:
    """(node, ends_sha256) of (node, conv): SHA-256 of the ids in ascending order, joined by commas.

    Rows are dealt by range of (node, id), so the members of one node, however many, are joined to strings by many tasks; the
    hash itself has to read them in order: a stream of these strings, a batch at a time.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            nodes, ids = b.column(0).to_pylist(), b.column(1).to_pylist()
            cuts = [0, *(i for i in range(1, len(nodes)) if nodes[i] != nodes[i - 1]), len(nodes)]
            texts = [",".join(map(str, ids[i:j])) for i, j in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in cuts[:-1]], pa.binary()), pa.array([ids[i] for i in cuts[:-1]], pa.int64()), pa.array(texts)], ["node", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for b in batches:
            done: list[tuple[bytes, str]] = []
            for x, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if x == node:
                    state.update(b"," + ids.encode())
                    continue
                if node is not None:
                    done.append((node, state.hexdigest()))
                node, state = x, hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done])], ["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], ["node", "ends_sha256"])

    parts = apply(ends.select("node", chunk).repartitionByRange("node", chunk).sortWithinPartitions("node", chunk), join, "node binary, first bigint, ids string")
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return apply(parts.repartition(n, F.xxhash64("node", F.lit(1))).sortWithinPartitions("node", "first").select("node", "ids"), digest, "node binary, ends_sha256 string")


def trie(prefixes: DataFrame) -> DataFrame:
    """One row a node of the prefixes that ``chained`` gives; see the module for the columns of ``op13``.

    A node's smallest member stands for it. Members of a node are members of its parent, so the nodes that a conversation stands
    for are the lower end of its path: their weights add up along that end, and each conversation hands the sum, and its leaf,
    to the rest of its path at once. That is every node exploded to all its ancestors, added up before the shuffle; it has at
    most as many rows as the conversations have turns, where single nodes would have the square of a long conversation's.
    Nodes are groups with a map-side aggregate, so the root and common first turns stay small. Parents with more children than
    one task should look up are broadcast; there are at most ``LOOKUP_ROWS`` of them by the bound that sets them apart.
    """
    prefixes = stash(prefixes)
    nodes = stash(
        prefixes.groupBy("node", "depth").agg(
            F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.min("parent").alias("parent"), F.max("len").cast("long").alias("len"),
            F.count_if("last").alias("n_ends"), F.min(F.when(F.col("last"), F.col("conv"))).alias("end"),
        )
    )
    weight, leaf = (F.col("n_convs") - 1) * F.col("len"), (F.col("n_ends") == F.col("n_convs")).cast("long")
    path = Window.partitionBy("conv_id").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = nodes.select("node", F.sum(leaf).over(path).alias("n_leaves"), F.sum(weight).over(path).alias("saved_tokens"))
    handed = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.sum(leaf).alias("n_leaves"), F.sum(weight).alias("saved_tokens")).where("top > 0")
    above = prefixes.join(handed.withColumnRenamed("conv_id", "conv"), "conv").where(F.col("depth") < F.col("top")).select("node", "n_leaves", "saved_tokens")
    zero = F.lit(0).cast("long")
    children = nodes.where("parent IS NOT NULL").select(F.col("parent").alias("node"), zero.alias("n_leaves"), zero.alias("saved_tokens"), F.lit(1).cast("long").alias("n_children"))
    sums = stash(
        own.unionByName(above).withColumn("n_children", zero).unionByName(children)
        .groupBy("node").agg(*(F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")))
    )
    many = F.greatest(F.floor(nodes.agg(F.count("*")).first()[0] / F.lit(LOOKUP_ROWS)), F.lit(CHILDREN))
    owners = nodes.select("node", "conv_id").join(sums, "node")
    hot = owners.where(F.col("n_children") > many).select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    rest = owners.where((F.col("n_children") <= many) & (F.col("n_children") > 0)).select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    hot = F.broadcast(stash(hot))
    looked = nodes.join(hot, "parent", "left")
    single = F.col("parent").isNull() | F.col("parent_conv_id").isNotNull()
    placed = looked.where(single).unionByName(looked.where(~single).drop("parent_conv_id").join(rest, "parent"))
    ends = prefixes.where("last").select("node", "conv").join(nodes.where("n_ends > 1").select("node"), "node", "left_semi")
    out = placed.join(sums, "node").join(end_digests(ends), "node", "left")
    digest = F.when(F.col("n_ends") == 0, F.sha2(F.lit(""), 256)).when(F.col("n_ends") == 1, F.sha2(F.col("end").cast("string"), 256)).otherwise(F.col("ends_sha256"))
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", digest.alias("ends_sha256"))


def conversation_trie(turns: DataFrame) -> DataFrame:
    """Nodes of the rebuilt conversations of a table (conv_id, turn, role, text).

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (root: null), ``n_convs``, ``n_children``, ``n_leaves`` and
    ``saved_tokens`` (summed over the subtree), ``ends_sha256`` (of the members that end there). Turns in order, nulls first,
    equal ones by digest; null roles and texts are empty, rows of no conversation (null) are left out, repeated rows are
    turns of their own, other columns aren't read. An empty table has no conversation and so no root.
    """
    return trie(chained(rebuilt(numbered(turns))))


def oracle(table: str) -> str:
    """DuckDB SQL: prefixes as lists of digests, nodes joined to all nodes below them by one digest a prefix."""
    return f"""
    WITH RECURSIVE t AS (SELECT conv_id::BIGINT conv, turn, coalesce(text, '') txt, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) d FROM {table} WHERE conv_id IS NOT NULL),
    n AS (SELECT conv, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, d) - 1 p, d, length(txt) len FROM t),
    bits AS (SELECT conv, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv::VARCHAR, ''), lambda c: list_concat([1000 + ascii(c)], [0, 0, 0, 0, 0, 0, 0, 0])))),
        lambda a, x: CASE WHEN x >= 1000 THEN xor(a, x - 1000) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) crc FROM (SELECT DISTINCT conv FROM n)),
    c AS (SELECT conv, conv - conv % 100 base, xor(crc, 4294967295) % 6 h FROM bits),
    r AS (SELECT c.conv, 0 part, n.p, n.d, n.len FROM c JOIN n ON n.conv = c.base AND n.p < c.h UNION ALL SELECT c.conv, 1, n.p, n.d, n.len FROM c JOIN n ON n.conv = c.conv AND n.p >= c.h),
    s AS (SELECT conv, row_number() OVER (PARTITION BY conv ORDER BY part, p) depth, d, len FROM r),
    q AS (SELECT conv, 0 depth, '' node, NULL::VARCHAR parent, 0 len FROM c UNION ALL SELECT q.conv, s.depth, sha256(q.node || s.d), q.node, s.len FROM q JOIN s ON s.conv = q.conv AND s.depth = q.depth + 1),
    m AS (SELECT q.*, q.depth = max(q.depth) OVER (PARTITION BY q.conv) fin FROM q),
    g AS (SELECT node, depth, min(conv) conv_id, count(*) n_convs, any_value(parent) parent, any_value(len) len, coalesce(string_agg(conv::VARCHAR, ',' ORDER BY conv) FILTER (WHERE fin), '') ends FROM m GROUP BY node, depth),
    k AS (SELECT parent node, count(*) n FROM g WHERE parent IS NOT NULL GROUP BY 1),
    w AS (SELECT g.node, g.node up FROM g UNION ALL SELECT w.node, g.parent FROM w JOIN g ON g.node = w.up WHERE g.parent IS NOT NULL),
    sub AS (SELECT w.up node, sum((k.n IS NULL)::INT) leaves, sum((g.n_convs - 1) * g.len) saved FROM w JOIN g ON g.node = w.node LEFT JOIN k ON k.node = w.node GROUP BY 1)
    SELECT g.conv_id, g.depth::BIGINT depth, b.conv_id parent_conv_id, g.n_convs, coalesce(k.n, 0)::BIGINT n_children, sub.leaves::BIGINT n_leaves, sub.saved::BIGINT saved_tokens, sha256(g.ends) ends_sha256
    FROM g JOIN sub ON sub.node = g.node LEFT JOIN k ON k.node = g.node LEFT JOIN g b ON b.node = g.parent"""
