"""Prefix trie of conversations by Euler tour: list-ranked arcs, subtree figures from prefix sums at arc positions.

A node is a distinct sequence of first turns (role, text).  Its name is a running exclusive-or of two 64-bit hashes of (depth, turn) along the
conversation, so a node's parent is named by taking its last turn out again, and equal beginnings meet by name in one aggregation.
Each node has an enter and an exit arc; an arc's successor is the first child's enter arc or the own exit arc, then the next sibling's enter arc or the
parent's exit arc, siblings by their smallest member.  ``list_ranks`` numbers the arcs, running sums over these numbers of leaves and
savings, taken at a node's two arcs, give its subtree.  Depth costs no rounds, and no key is gathered: turns, siblings and arcs are numbered by
``running`` over ranges of rows, so a conversation, a node's children or the members that end in one node may be any share of the rows.

Turns of a conversation are ordered by turn, null first, then by role and text; all ties and repeated rows are turns.  A null role or text is
empty; texts may be of any length; rows without conv_id belong to no conversation.  An empty table has no node, not even a root.  Columns besides
conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.llm.common import partitions, stage, table
from tokenledger.llm.list_ranking import SMALL, list_ranks
from tokenledger.operators.scan import running


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, h1, h2, n_bytes): depth from 1, hashes of role and text, and the text's UTF-8 bytes."""
    empty = F.lit("")
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    rows = rows.withColumns({"h1": F.xxhash64(F.lit(1), "role", "text"), "h2": F.xxhash64(F.lit(2), "role", "text"), "n_bytes": F.octet_length("text").cast("long"), "_at": F.monotonically_increasing_id()})
    return running(rows, ["conv_id"], ["turn", "role", "text", "_at"], sums={"depth": F.lit(1)}, keep=["conv_id", "h1", "h2", "n_bytes"])


def _named(turns: DataFrame) -> DataFrame:
    """turns (conv_id, depth, h1, h2, n_bytes) with the node that each ends (n1, n2) and that node's parent (p1, p2)."""
    v = turns.withColumns({"v1": F.xxhash64(F.lit(3), "depth", "h1", "h2"), "v2": F.xxhash64(F.lit(4), "depth", "h1", "h2")})
    named = running(v, ["conv_id"], ["depth"], xors={"n1": "v1", "n2": "v2"}, keep=["conv_id", "depth", "n_bytes", "v1", "v2"])
    return named.select("conv_id", "depth", "n_bytes", "n1", "n2", F.col("n1").bitwiseXOR(F.col("v1")).alias("p1"), F.col("n2").bitwiseXOR(F.col("v2")).alias("p2"))


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by node and member: the members of each node in a batch, as text."""
    for b in batches:
        if not len(b):
            continue
        n1, n2, ids = np.asarray(b["n1"]), np.asarray(b["n2"]), b["conv_id"].to_pylist()
        cut = np.r_[0, np.flatnonzero((n1[1:] != n1[:-1]) | (n2[1:] != n2[:-1])) + 1, len(b)].tolist()
        text = [",".join(map(str, ids[x:y])) for x, y in zip(cut[:-1], cut[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b["n1"].take(pa.array(cut[:-1])), b["n2"].take(pa.array(cut[:-1])), pa.array([ids[x] for x in cut[:-1]], pa.int64()), pa.array(text)], names=["n1", "n2", "first", "text"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of lists sorted by node and first member: each node's digest; one state is kept, however long a list is."""
    node, state, out = None, None, []

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[0][0] for o in out], pa.int64()), pa.array([o[0][1] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string())], names=["n1", "n2", "ends_sha256"])

    for b in batches:
        for n1, n2, text in zip(b["n1"].to_pylist(), b["n2"].to_pylist(), b["text"].to_pylist(), strict=True):
            if (n1, n2) != node:
                if node is not None:
                    out.append((node, state.hexdigest()))
                node, state = (n1, n2), hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        yield told()
        out = []
    if node is not None:
        out.append((node, state.hexdigest()))
        yield told()


def _ends(named: DataFrame, convs: DataFrame) -> DataFrame:
    """(n1, n2, ends_sha256) of the nodes where conversations end."""
    n, zero = partitions(named.sparkSession), F.lit(0).cast("long")
    last = named.groupBy("conv_id").agg(F.max(F.struct("depth", "n1", "n2")).alias("e")).select("conv_id", "e.n1", "e.n2")
    ends = stage(convs.join(last, "conv_id", "left").select("conv_id", F.coalesce("n1", zero).alias("n1"), F.coalesce("n2", zero).alias("n2")), "ends")
    order = ["n1", "n2", "conv_id"]
    lists = ends.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_lists, "n1 long, n2 long, first long, text string")
    return lists.repartition(n, "n1", "n2").sortWithinPartitions("n1", "n2", "first").mapInArrow(_digests, "n1 long, n2 long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame, small: int = SMALL) -> DataFrame:
    """The nodes of turns (conv_id, depth, h1, h2, n_bytes) and of the conversations convs (conv_id, distinct), with or without turns.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)"""
    named = _named(turns)
    none = F.lit(None).cast("long")
    inner = named.groupBy("n1", "n2").agg(F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("n_bytes").alias("n_bytes"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0").select(zero.alias("n1"), zero.alias("n2"), zero.alias("depth"), "conv_id", "n_convs", zero.alias("n_bytes"), none.alias("p1"), none.alias("p2"))
    nodes = stage(inner.unionByName(root).withColumn("id", F.monotonically_increasing_id()), "nodes")
    above = nodes.select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("id").alias("pid"), F.col("conv_id").alias("parent_conv_id"))
    linked = stage(nodes.join(above, ["p1", "p2"], "left").drop("p1", "p2"), "linked")

    ranked = running(linked.where("pid is not null").select("pid", "conv_id", "id"), ["pid"], ["conv_id"], sums={"rank": F.lit(1)}, keep=["pid", "id"])
    kids = ranked.groupBy("pid").agg(F.max("rank").alias("n_children"), F.max(F.when(F.col("rank") == 1, F.col("id"))).alias("first")).withColumnRenamed("pid", "id")
    linked = stage(linked.join(kids, "id", "left").withColumn("n_children", F.coalesce("n_children", zero)), "linked")
    beside = ranked.join(ranked.select("pid", (F.col("rank") - 1).alias("rank"), F.col("id").alias("next")), ["pid", "rank"], "left")
    enter = linked.select((F.col("id") * 2).alias("id"), F.coalesce(F.col("first") * 2, F.col("id") * 2 + 1).alias("next"))
    exit_ = beside.select((F.col("id") * 2 + 1).alias("id"), F.coalesce(F.col("next") * 2, F.col("pid") * 2 + 1).alias("next"))
    end = linked.where("pid is null").select((F.col("id") * 2 + 1).alias("id"), none.alias("next"))
    tour = list_ranks(enter.unionByName(exit_).unionByName(end), small)

    own = linked.select((F.col("id") * 2).alias("id"), (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saving"))
    sums = running(tour.join(own, "id", "left"), [], ["pos"], sums={"leaves": "leaf", "saved": "saving"}, keep=["id", "leaf", "saving"])
    at_exit = F.col("id") % 2 == 1

    def within(total: str, weight: str) -> Column:
        return (F.max(F.when(at_exit, F.col(total))) - F.max(F.when(~at_exit, F.col(total) - F.col(weight)))).alias(total)

    below = sums.groupBy(F.floor(F.col("id") / 2).alias("id")).agg(within("leaves", "leaf").alias("n_leaves"), within("saved", "saving").alias("saved_tokens"))
    found = linked.join(below, "id").join(_ends(named, convs), ["n1", "n2"], "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, small: int = SMALL) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, turn, role, text)."""
    turns = numbered_turns(conversations)
    return trie(turns, stage(turns.select("conv_id").distinct(), "convs"), small)


def rebuilt(turns: DataFrame, convs: DataFrame, of: int = 5, most: int = 9) -> DataFrame:
    """The contract's conversations: the first h turns of the conversation conv_id - conv_id % of, then the own turns after the first h."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    base = F.col("conv_id") - F.col("conv_id") % of
    firsts = turns.where(F.col("depth") < most)
    began = convs.select("conv_id", base.alias("base")).join(firsts.withColumnRenamed("conv_id", "base"), "base").where(F.col("depth") <= h)
    sizes = firsts.groupBy(F.col("conv_id").alias("base")).agg(F.count("*").alias("n"))  # as far as h may reach
    own = turns.where(F.col("depth") > h).withColumn("base", base).join(sizes, "base", "left")
    own = own.withColumn("depth", F.col("depth") - h + F.least(h, F.coalesce("n", F.lit(0))))
    columns = ["conv_id", "depth", "h1", "h2", "n_bytes"]
    return began.select(columns).unionByName(own.select(columns))


def query(spark: SparkSession, sf_dir: str, small: int = SMALL) -> DataFrame:
    turns = numbered_turns(table(spark, sf_dir, "conversations"))
    convs = stage(turns.select("conv_id").distinct(), "convs")
    return trie(rebuilt(turns, convs), convs, small)


SQL = r"""
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
           FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
ids AS (SELECT DISTINCT conv_id FROM t),
c AS (SELECT conv_id, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [unicode(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
             lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1)))) % 9 AS h FROM ids),
r AS (SELECT c.conv_id, 0 AS part, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 WHERE t.pos <= c.h
      UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id WHERE t.pos > c.h),
q AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth, text, {'role': role, 'text': text} AS said FROM r),
p AS (SELECT conv_id, depth, strlen(text) AS bytes, list(said) OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM q),
e AS (SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS members
      FROM (SELECT ids.conv_id, coalesce(l.path, []) AS path FROM ids LEFT JOIN (SELECT conv_id, arg_max(path, depth) AS path FROM p GROUP BY conv_id) l USING (conv_id)) GROUP BY path),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saving FROM p GROUP BY path, depth
      UNION ALL SELECT [], 0, min(conv_id), count(*), 0 FROM ids HAVING count(*) > 0),
k AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
s AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
b AS (SELECT path[1:d] AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum(saving)::BIGINT AS saved_tokens
      FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM s) GROUP BY 1)
SELECT s.conv_id, s.depth::BIGINT AS depth, o.conv_id AS parent_conv_id, s.n_convs, s.n_children, b.n_leaves, b.saved_tokens, sha256(coalesce(e.members, '')) AS ends_sha256
FROM s JOIN b USING (path) LEFT JOIN e USING (path) LEFT JOIN n o ON s.depth > 0 AND o.path = s.path[1:s.depth - 1]
"""
