"""Embedding near-dedup with NN-descent.

Equal vectors are one node from the start, weighted by their copies.  A first neighbour graph comes from random-hyperplane
buckets (large buckets dealt out by hash).  Each round joins every node's neighbours, in both directions,
with one another, so that neighbours of neighbours meet, and keeps the best ``k`` of each node; rounds end when
few lists change.  Nodes whose whole list is above the threshold are saturated: their links may go on, so their lists are enlarged to ``wide``
and a round follows in which they may find more.  In a crowd of more than ``wide`` near vectors no list of bounded length holds them all.  What two
nodes that are saturated then still have to find lies between different components: those nodes are
compared in blocks, but for blocks whose balls are too far apart to hold a link.

Link counts are exact inside each component, by blocks with a centre and a radius: blocks whose balls lie so close that all pairs link add
up their sizes, those too far apart add nothing, and only the others are compared vector by vector.

Recall is audited by brute force over the vectors whose id is divisible by ``audit``, copies of others included, in blocks, as counts:
each has its own, and both their mean and the mean over components must reach ``recall``, so that a crowd
can't outvote the pairs elsewhere.  If none of them has a link, nodes for which links were found are audited instead.  Below ``recall`` all lists
are doubled, new buckets drawn, and the descent goes on; links the audit saw are kept.  The figure is logged and returned by ``near_vectors_and_recall``, and stands in the query's column recall, nan
where neither the graph nor the audit knows a link; under ``FLOOR``, with lists as long as there are nodes, it is an error.

Null vectors, zero vectors and vectors with null or non-finite parts link with nothing; vectors of different lengths have no cosine, so each
length is searched by itself, one after the other.  Repeated rows of one vec_id are one vector (the smallest); null ids are left out of the result; extra columns, labels
among them, play no part, whatever their names; an empty table gives no rows.  Cosines are computed in double precision, and those within rounding of the
threshold once more by an exact sum, so that every step says the same of a pair.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.llm.common import partitions, stage, table, unstage
from tokenledger.llm.components import components

THRESHOLD, K, WIDE, TABLES, BUCKET, ROUNDS, BLOCK, AUDIT, RECALL, FLOOR = 0.9, 10, 20, 10, 256, 4, 256, 50, 0.98, 0.9
LOG = logging.getLogger(__name__)
#: One in so many list entries may change in a last round.
CALM = 0.01


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.float64)


def nodes_of(vectors: DataFrame, audit: int = AUDIT) -> DataFrame:
    """(id, vec, copies, asked): distinct unit vectors that may link, with the smallest vec_id as id; asked: any copy's id is divisible by audit."""
    usable = vectors.where("vec_id is not null and embedding is not null").where(F.size("embedding") > 0)
    usable = usable.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0))
    one = usable.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return one.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.bool_or(F.col("vec_id") % audit == 0).alias("asked")).select("id", F.col("embedding").alias("vec"), "copies", "asked")


def units(m: np.ndarray) -> np.ndarray:
    """Rows over their largest part, then their length: no overflow however large the parts."""
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Cosines of the rows of a with those of b, all unit vectors; near the threshold by an exact sum, which does not hang on how rows are grouped."""
    s = a @ b.T
    for r, c in zip(*np.nonzero(np.abs(s - threshold) < 1e-12), strict=True):
        s[r, c] = math.fsum(a[r] * b[c])
    return s


def _pairs_in(ids: np.ndarray, vecs: np.ndarray, k: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, sim): each member's k best among the others."""
    s = cosines(vecs, vecs, threshold)
    np.fill_diagonal(s, -2)
    k = min(k, len(ids) - 1)
    best = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return np.repeat(ids, k), ids[best].ravel(), np.take_along_axis(s, best, 1).ravel()


def _grouped(df: DataFrame, keys: list[str], k: int, threshold: float) -> DataFrame:
    """Joins the members (id, vec) of each group of keys: (u, v, sim) of each member's k best.  Groups are bounded by how keys are made."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = pd.concat([rest, b], ignore_index=True) if rest is not None and len(rest) else b
            if not len(b):
                continue
            code = b[keys].to_numpy()
            cuts = np.flatnonzero((code[1:] != code[:-1]).any(1)) + 1
            last = cuts[-1] if len(cuts) else 0
            rest = b.iloc[last:]
            if last:
                yield join(b.iloc[:last], cuts[:-1])
        if rest is not None and len(rest):
            yield join(rest, np.array([], int))

    def join(b: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
        ids, vecs = b.id.to_numpy(), units(matrix(b.vec))
        out = [_pairs_in(ids[p], vecs[p], k, threshold) for p in np.split(np.arange(len(b)), cuts) if len(p) > 1]
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pd.DataFrame(dict(zip(("u", "v", "sim"), cols, strict=True)))

    n = partitions(df.sparkSession)
    return df.repartition(n, *keys).sortWithinPartitions(*keys).select(*keys, "id", "vec").mapInPandas(run, "u long, v long, sim double")


def best_lists(edges: DataFrame, k: int, wide: DataFrame | None = None) -> DataFrame:
    """The k best distinct neighbours of each u, or as many as wide (u, size) says.  Partial lists of bounded length come together, so no list grows beyond its tasks times that."""
    one = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    if wide is None:
        one = one.withColumn("size", F.lit(k))
    else:
        one = one.join(wide, "u", "left").withColumn("size", F.coalesce("size", F.lit(k)))
    top = lambda c: F.slice(F.sort_array(c, asc=False), F.lit(1), F.col("size"))
    part = one.groupBy("u", "size", F.pmod(F.xxhash64("v"), F.lit(16)).alias("p")).agg(F.collect_list(F.struct("sim", "v")).alias("some")).withColumn("some", top(F.col("some")))
    whole = part.groupBy("u", "size").agg(F.flatten(F.collect_list("some")).alias("some")).withColumn("best", top(F.col("some")))
    return whole.select("u", F.explode("best").alias("x")).select("u", F.col("x.v").alias("v"), F.col("x.sim").alias("sim"))


def first_graph(nodes: DataFrame, n: int, dim: int, k: int, threshold: float, tables: int = TABLES, bucket: int = BUCKET, seed: int = 3) -> DataFrame:
    bits = max(1, int(np.ceil(np.log2(max(2, n / (bucket / 4))))))
    planes = np.random.default_rng(seed).standard_normal((tables * bits, dim))

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 2000):
                part = b.iloc[at : at + 2000]
                signs = (units(matrix(part.vec)) @ planes.T > 0).reshape(len(part), tables, bits)
                key = (signs @ (1 << np.arange(bits))).astype(np.int64)
                for t in range(tables):
                    yield pd.DataFrame({"t": t, "key": key[:, t], "id": part.id.values, "vec": part.vec.values})

    placed = nodes.select("id", "vec").mapInPandas(keys, "t int, key long, id long, vec array<float>")
    sizes = placed.groupBy("t", "key").agg(F.count("*").alias("n")).select("t", "key", F.ceil(F.col("n") / bucket).alias("parts"))
    dealt = placed.join(sizes, ["t", "key"]).withColumn("part", F.pmod(F.xxhash64("id", "t", F.lit(seed)), F.col("parts")))
    return best_lists(_grouped(dealt, ["t", "key", "part"], max(2, k // 3), threshold), k)


def descend(nodes: DataFrame, graph: DataFrame, k: int, n: int, threshold: float, rounds: int = ROUNDS, wide: DataFrame | None = None) -> DataFrame:
    """Refine a staged graph (u, v, sim) through neighbours of neighbours; lists of the nodes in wide (u, size) are longer."""
    for _ in range(rounds):
        both = graph.select(F.col("u").alias("hub"), F.col("v").alias("id")).unionByName(graph.select(F.col("v").alias("hub"), F.col("u").alias("id")))
        itself = graph.select(F.col("u").alias("hub"), F.col("u").alias("id"))
        # A hub of many lists is dealt out by hash in parts; each part holds some bounded number of members.
        degree = both.groupBy("hub").agg(F.ceil(F.count("*") / 64).alias("parts"))
        members = both.unionByName(itself).distinct().join(degree, "hub").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
        met = _grouped(members.join(nodes.select("id", "vec"), "id"), ["hub", "part"], max(3, k // 2), threshold)
        new = stage(best_lists(graph.unionByName(met), k, wide), "graph")
        changed = new.join(graph, ["u", "v"], "left_anti").count()
        unstage(graph)
        graph = new
        if changed <= CALM * n * k:
            break
    return graph


def _balls(crowd: DataFrame) -> DataFrame:
    """(component, block, centre, radius): the mean direction of each block of crowd, and the largest angle with it."""

    def ball(pdf: pd.DataFrame) -> pd.DataFrame:
        x = units(matrix(pdf.vec))
        m = x.mean(0)
        m = m / np.linalg.norm(m) if np.linalg.norm(m) > 1e-9 else x[0]
        return pd.DataFrame({"component": pdf.component.iloc[:1], "block": pdf.block.iloc[:1], "centre": [m], "radius": [float(np.arccos(np.clip(x @ m, -1, 1)).max())]})

    return crowd.groupBy("component", "block").applyInPandas(ball, "component long, block int, centre array<double>, radius double")


def saturated(graph: DataFrame, k: int, threshold: float, wide: DataFrame | None = None) -> DataFrame:
    """(u) of the nodes whose lists are full and wholly above the threshold."""
    lists = graph.groupBy("u").agg(F.count("*").alias("n"), F.min("sim").alias("sim"))
    size = F.lit(k)
    if wide is not None:
        lists, size = lists.join(wide, "u", "left"), F.coalesce("size", F.lit(k))
    return lists.where((F.col("n") >= size) & (F.col("sim") >= threshold)).select("u")


def _dealt(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """members (component, id) with the block of their component, sizes (component, blocks), that a hash of the id gives them."""
    return members.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")


def _meetings(balls: DataFrame, threshold: float, within: bool, chunk: int = 2048) -> DataFrame:
    """(component, block, c2, b2, sure) of the blocks whose balls may hold a link, of one component each (within) or of two; sure: all pairs link.

    A chunk of balls at a time goes to all tasks."""
    reach = math.acos(threshold)
    schema = "component long, block int, c2 long, b2 int, sure boolean"
    n_chunks, out = -(-balls.count() // chunk), balls.sparkSession.createDataFrame([], schema)
    for i in range(n_chunks):
        some = balls.where(F.pmod(F.xxhash64("component", "block"), F.lit(n_chunks)) == i).toPandas()
        sent = balls.sparkSession.sparkContext.broadcast((some.component.to_numpy(), some.block.to_numpy(), np.array(some.centre.to_list()).reshape(len(some), -1), some.radius.to_numpy()))

        def near(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            component, block, centre, radius = sent.value
            for b in batches:
                for at in range(0, len(b), 1024):
                    part = b.iloc[at : at + 1024]
                    angle = np.arccos(np.clip(np.stack(part.centre.to_list()) @ centre.T, -1, 1))
                    radii = part.radius.to_numpy()[:, None] + radius
                    mine = part.component.to_numpy()[:, None]
                    r, c = np.nonzero((angle - radii <= reach + 1e-6) & (mine == component if within else mine < component))
                    yield pd.DataFrame({"component": part.component.to_numpy()[r], "block": part.block.to_numpy()[r], "c2": component[c], "b2": block[c], "sure": (angle + radii)[r, c] <= reach - 1e-6})

        one = stage(balls.mapInPandas(near, schema), "meetings")
        out = out.unionByName(one) if i else one
    return out


def _side_by_side(meet: DataFrame, blocks: DataFrame) -> DataFrame:
    """The members of both blocks of each meeting, with asks for those of the first."""
    left = meet.join(blocks, ["component", "block"]).withColumn("asks", F.lit(True))
    right = meet.join(blocks.withColumnsRenamed({"component": "c2", "block": "b2"}), ["c2", "b2"]).withColumn("asks", F.lit(False))
    return left.unionByName(right)


def bridges(nodes: DataFrame, full: DataFrame, labels: DataFrame, threshold: float) -> DataFrame | None:
    """(a, b): a link for each two blocks of saturated nodes (u) of different components that have one; None if there are none to compare."""
    placed = full.select(F.col("u").alias("id")).join(labels, "id")
    sizes = stage(placed.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "crowds")
    if len(sizes.limit(2).collect()) < 2:
        return None
    crowd = stage(_dealt(placed, sizes).join(nodes, "id").select("component", "block", "id", "vec"), "crowd")
    meet = _meetings(stage(_balls(crowd), "balls"), threshold, False).drop("sure")

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf.asks], pdf[~pdf.asks]
        s = cosines(units(matrix(a.vec)), units(matrix(b.vec)), threshold)
        r, c = np.unravel_index(s.argmax(), s.shape)
        return pd.DataFrame({"a": a.id.iloc[[r]].to_numpy(), "b": b.id.iloc[[c]].to_numpy()})[: int(s[r, c] >= threshold)]

    # Both blocks lie within one component each, so one link joins all there is to join.
    return stage(_side_by_side(meet, crowd).groupBy("component", "block", "c2", "b2").applyInPandas(best, "a long, b long"), "bridges")


def _link_counts(nodes: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """(id, n_links) within components, copies of others counted, own ones not."""
    sizes = labels.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    blocks = stage(_dealt(labels, sizes).join(nodes, "id").select("component", "block", "id", "vec", "copies"), "blocks")
    balls, several = stage(_balls(blocks), "balls"), sizes.where("blocks > 1").select("component")
    alone = balls.join(several, "component", "left_anti").select("component", "block", F.col("component").alias("c2"), F.col("block").alias("b2"), (2 * F.col("radius") <= math.acos(threshold) - 1e-6).alias("sure"))
    meet = alone.unionByName(_meetings(stage(balls.join(several, "component", "left_semi"), "balls"), threshold, True))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf.asks], pdf[~pdf.asks]
        near = cosines(units(matrix(a.vec)), units(matrix(b.vec)), threshold) >= threshold
        near &= a.id.to_numpy()[:, None] != b.id.to_numpy()[None, :]
        return pd.DataFrame({"id": a.id.to_numpy(), "n": near @ b.copies.to_numpy()})

    compared = _side_by_side(meet.where("not sure").drop("sure"), blocks).groupBy("component", "block", "c2", "b2").applyInPandas(count, "id long, n long")
    weight = blocks.groupBy(F.col("component").alias("c2"), F.col("block").alias("b2")).agg(F.sum("copies").alias("copies"))
    whole = meet.where("sure").join(weight, ["c2", "b2"]).groupBy("component", "block").agg(F.sum("copies").alias("all"), F.count_if(F.col("block") == F.col("b2")).alias("own"))
    counted = blocks.join(whole, ["component", "block"]).select("id", (F.col("all") - F.col("own") * F.col("copies")).alias("n"))
    return compared.unionByName(counted).groupBy("id").agg(F.sum("n").alias("n_links"))


def audited(nodes: DataFrame, labels: DataFrame, asked: DataFrame, threshold: float, block: int = 2048) -> tuple[float, DataFrame | None]:
    """(recall, missing (a, b)): the asked nodes' own recall, as the lesser of its mean over them and over components, and links that join them with other components.

    A block of asked nodes at a time meets all nodes; tasks return counts, and one link for each other component."""
    side = labels.select("id", "component")
    placed = stage(nodes.join(side, "id", "left").select("id", "vec", F.coalesce("component", "id").alias("component")), "placed")
    queries = placed.join(asked, "id", "left_semi")
    n_blocks, told = max(1, -(-asked.count() // block)), None
    for i in range(n_blocks):
        some = queries.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == i).toPandas()  # about block rows
        if not len(some):
            continue
        sent = nodes.sparkSession.sparkContext.broadcast((some.id.to_numpy(), units(matrix(some.vec)), some.component.to_numpy()))

        def meet(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ids, q, component = sent.value
            for b in batches:
                for at in range(0, len(b), 4096):
                    part = b.iloc[at : at + 4096]
                    near = cosines(units(matrix(part.vec)), q, threshold) >= threshold
                    other, theirs = part.id.to_numpy(), part.component.to_numpy()
                    near &= other[:, None] != ids
                    same = theirs[:, None] == component
                    total, seen = near.sum(0), (near & same).sum(0)
                    at_ = np.flatnonzero(total)
                    yield pd.DataFrame({"id": ids[at_], "component": component[at_], "total": total[at_], "seen": seen[at_], "other": -1, "c2": -1})
                    r, c = np.nonzero(near & ~same)
                    lost = pd.DataFrame({"id": ids[c], "component": component[c], "total": 0, "seen": 0, "other": other[r], "c2": theirs[r]}).drop_duplicates(["id", "c2"])
                    yield lost

        one = stage(placed.mapInPandas(meet, "id long, component long, total long, seen long, other long, c2 long"), "audit")
        told = one if told is None else told.unionByName(one)
    if told is None:
        return float("nan"), None
    own = told.where("total > 0").groupBy("id", "component").agg((F.sum("seen") / F.sum("total")).alias("own"))
    means = own.groupBy("component").agg(F.sum("own").alias("own"), F.count("*").alias("n")).agg(F.sum("own") / F.sum("n"), F.avg(F.col("own") / F.col("n"))).first()
    missing = told.where("total = 0").groupBy("id", "c2").agg(F.min("other").alias("other")).select(F.col("id").alias("a"), F.col("other").alias("b"))
    return float("nan") if means[0] is None else min(means), missing


def _linked(nodes: DataFrame, n: int, dim: int, threshold: float, k: int, recall: float) -> tuple[DataFrame, DataFrame, float]:
    """(labels, link counts, audited recall) of n staged nodes of dim parts each."""
    graph = stage(first_graph(nodes, n, dim, k, threshold), "graph")
    seed = 3
    while True:
        graph = descend(nodes, graph, k, n, threshold)
        wide = stage(saturated(graph, k, threshold).withColumn("size", F.lit(WIDE * k // K)), "wide")
        if not wide.isEmpty():
            graph = descend(nodes, graph, k, n, threshold, 1, wide)
        links = graph.where(F.col("sim") >= threshold).select(F.col("u").alias("a"), F.col("v").alias("b"))
        labels = components(links)
        more = bridges(nodes, stage(saturated(graph, k, threshold, wide), "full"), labels, threshold)
        if more is not None and not more.isEmpty():
            links = links.unionByName(more)
            labels = components(links)
        seen, missing = audited(nodes, labels, nodes.where("asked").select("id"), threshold)
        if seen != seen:  # no asked node has a link: ask some for which there are
            some = links.select(F.col("a").alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(2048)
            seen, missing = audited(nodes, labels, stage(some, "asked"), threshold)
        if seen != seen or seen >= recall or k >= n:
            if missing is not None and not missing.isEmpty():
                labels = components(links.unionByName(missing))
            LOG.info("vectors of %d parts: %d nodes, audited recall %.4f with lists of %d", dim, n, seen, k)
            if seen < FLOOR:
                raise RuntimeError(f"the audit finds a recall of {seen:.3f}")
            return labels, _link_counts(nodes, labels, threshold), seen
        k, seed = 2 * k, seed + 1
        graph = stage(best_lists(graph.unionByName(first_graph(nodes, n, dim, k, threshold, seed=seed)), k), "graph")


def near_vectors_and_recall(vectors: DataFrame, threshold: float = THRESHOLD, k: int = K, audit: int = AUDIT, recall: float = RECALL) -> tuple[DataFrame, float]:
    """((vec_id, n_links, component_id, kept) a distinct vec_id, the audited recall, of several vector lengths the least)."""
    vectors = vectors.select("vec_id", "embedding")
    nodes = stage(nodes_of(vectors, audit), "nodes")
    lengths = nodes.groupBy(F.size("vec").alias("d")).count().orderBy("d").collect()  # a row a vector length
    labels, counts = nodes.limit(0).select("id", F.col("id").alias("component")), nodes.limit(0).select("id", F.lit(0).cast("long").alias("n_links"))
    found = []
    for dim, n in lengths:
        if n < 2:
            continue
        own = nodes if len(lengths) == 1 else stage(nodes.where(F.size("vec") == dim), "nodes")
        label, count, seen = _linked(own, n, dim, threshold, k, recall)
        labels, counts = (label, count) if not found else (labels.unionByName(label), counts.unionByName(count))
        found.append(seen)
    seen = min((x for x in found if x == x), default=float("nan"))
    near = nodes.join(labels, "id", "left").join(counts, "id", "left").select(
        F.col("vec").alias("embedding"), F.coalesce("component", "id").alias("component_id"), (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    one = vectors.where("vec_id is not null").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    out = one.join(near, "embedding", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id")), seen


def near_vectors(vectors: DataFrame, **how) -> DataFrame:
    """(vec_id, n_links, component_id, kept) a distinct vec_id."""
    return near_vectors_and_recall(vectors, **how)[0]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_vectors with recall, the audited one, null where neither graph nor audit knows a link."""
    found, recall = near_vectors_and_recall(table(spark, sf_dir, "embeddings"))
    return found.withColumn("recall", F.lit(None if math.isnan(recall) else recall).cast("double"))

