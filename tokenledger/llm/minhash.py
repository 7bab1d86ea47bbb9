"""MinHash near-dedup by an inverted join on signature coordinates.

A document's set holds its distinct 5-word shingles (words: runs without blanks, A-Z in lower case;
fewer words: the whole sequence is the one shingle; no words: empty, linked with nothing).  Equal
sets are one class from the start.  Of each class's signature the first ``posted`` coordinates go
into posting lists, one for each coordinate and value.

* prefix: a pair that agrees on at least ``least`` of the posted coordinates meets in one of the first
  ``posted - least + 1`` of them, so only those are posted;
* merging: in each list every class first meets the list's pivot only, the member whose coordinates are
  most popular, so the text that the others were copied from; the pair's collisions are counted over the whole
  signature, and pairs above the match threshold are confirmed on full sets.  Lists whose members are then in one
  component are done;
* skip: lists with several components give all pairs between different components if they have up to ``short``
  members.  The members of longer ones, and of no others, meet through a prefix of their shingles: in one order of all shingles, those
  that many hold last, two sets at the wanted similarity share one of their first few, and places further on are skipped if what is
  left of either set can't reach the overlap, and pivots come first here as well.  That is exact, and a passage that many documents share
  costs no pair for each two of them; in a crowd of loose copies, those near the wanted similarity to one another still meet in pairs.

Links are exact above the confirmation; a pair at similarity 0.85 goes unseen only if under 6 of 16
coordinates or under 88 of 128 agree, with odds of about one in a million.  Null texts have empty
sets; repeated rows of one doc_id are one document whose smallest set (by size, then hash) counts; rows without doc_id, which no
result could name, are left out; an empty table gives no rows; texts may be of any length; ties between pivots go to the smallest doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.llm.common import narrowed, small_batches, stage, table, unstage
from tokenledger.llm.components import components

WIDTH, POSTED, LEAST, SIGNATURE, MATCHES, SHORT = 5, 16, 6, 128, 88, 24
#: Words whose hashes a task holds before it forgets them: in real text most words are seen once, and two million took hundreds of MB a task.
KNOWN = 50_000
#: Common shingles that may be broadcast.
MOST_COMMON = 1_000_000
_SEEDS = np.random.default_rng(7)
_MUL = _SEEDS.integers(1, 2**32, SIGNATURE, dtype=np.uint32) | np.uint32(1)
_XOR = _SEEDS.integers(0, 2**32, SIGNATURE, dtype=np.uint32)
_ODD = _SEEDS.integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z in lower case.  Of bytes, ``lower`` changes A-Z only and ``split`` knows no other blanks than the contract's."""
    return (text or "").encode().lower().split()


def shingles(text: str | None, width: int = WIDTH, known: dict[bytes, int] | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    known = {} if known is None else known
    for w in set(words):
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(width, len(words))
    n = len(words) - k + 1
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = mix(out * _ODD[j] + h[j : j + n])
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    """Minimum of each of SIGNATURE hash functions, 32 bits each."""
    low = (s >> np.uint64(32)).astype(np.uint32)
    best = np.full(SIGNATURE, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(s), 4096):
        best = np.minimum(best, ((low[None, at : at + 4096] ^ _XOR[:, None]) * _MUL[:, None]).min(axis=1))
    return best.view(np.int32)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """(rows, the set of each) of up to 512 rows at a time."""
    known: dict[bytes, int] = {}
    for b in batches:
        for at in range(0, len(b), 512):
            part = b.slice(at, 512)
            if len(known) > KNOWN:
                known.clear()
            yield part, [shingles(t, known=known) for t in part["text"].to_pylist()]


def sets(docs: DataFrame, full: bool) -> DataFrame:
    """(doc_id, n, s1, s2, sig) a row, or (doc_id, members) if full.  s1 and s2 identify the set."""
    kind = "doc_id long, members array<long>" if full else "doc_id long, n long, s1 long, s2 long, sig array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _hashed(batches):
            if full:
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))], names=["doc_id", "members"])
                continue
            keys = [xxhash.xxh3_128_digest(f.tobytes()) for f in found]
            two = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array([len(f) for f in found], pa.int64()), pa.array(two[:, 0]), pa.array(two[:, 1]), pa.array([signature(f) if len(f) else None for f in found], pa.list_(pa.int32()))],
                names=["doc_id", "n", "s1", "s2", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, kind)


def _ends(pairs: DataFrame) -> DataFrame:
    one = lambda c: pairs.select(F.col(c).alias("doc_id")).distinct()
    return one("a").unionByName(one("b")).distinct()


def confirm(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of a staged table whose full sets S, T have 100 * |S and T| >= percent * |S or T|.

    Smaller-id sides are shared by many pairs, so each set is made once and travels to its pairs."""
    wanted = _ends(pairs)
    members = sets(narrowed(docs, wanted, "doc_id").join(wanted, "doc_id", "left_semi"), full=True)
    left = members.select(F.col("doc_id").alias("a"), F.col("members").alias("m_a"))
    right = members.select(F.col("doc_id").alias("b"), F.col("members").alias("m_b"))
    both = F.size(F.array_intersect("m_a", "m_b"))
    return stage(pairs.join(right, "b").join(left, "a").where(100 * both >= percent * (F.size("m_a") + F.size("m_b") - both)).select("a", "b"), "confirmed")


def _collisions(pairs: DataFrame, sigs: DataFrame, matches: int) -> DataFrame:
    """Pairs (a, b) whose signatures agree on enough of all coordinates, staged."""

    @F.pandas_udf("int")
    def agree(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="int32")
        return pd.Series((np.stack(x.to_list()) == np.stack(y.to_list())).sum(1))

    pairs = stage(pairs, "pairs")
    sigs = narrowed(sigs, _ends(pairs), "doc_id")
    left = sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a"))
    right = sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b"))
    out = stage(pairs.join(right, "b").join(left, "a").where(agree("sig_a", "sig_b") >= matches).select("a", "b"), "collided")
    unstage(pairs)
    return out


def _labelled(lists: DataFrame, comp: DataFrame) -> DataFrame:
    return lists.join(comp.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))


def _common(docs: DataFrame, over: int) -> DataFrame:
    """(token) of the shingles that more than ``over`` of docs hold."""
    return sets(docs, full=True).select(F.explode("members").alias("token")).groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") > over).select("token")


def _prefixes(docs: DataFrame, percent: int, common: DataFrame, most: int = MOST_COMMON) -> DataFrame:
    """(doc_id, n, at, token): the first n - ceil(n * percent / 100) + 1 shingles of each set, those that are not common first, then by value."""
    how_many = lambda n: n - -(-n * percent // 100) + 1
    schema = "doc_id long, n long, at int, token long"
    if common.count() > most:  # the list is too long to broadcast: it is joined
        tokens = sets(docs, full=True).select("doc_id", F.size("members").cast("long").alias("n"), F.explode("members").alias("token"))
        told = tokens.join(common.withColumn("often", F.lit(1)), "token", "left")
        first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
        in_order = told.groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "token"))).alias("ts"))  # bounded by the document
        return in_order.select("doc_id", "n", F.posexplode(F.slice("ts", F.lit(1), first.cast("int"))).alias("at", "t")).select("doc_id", "n", "at", "t.token")
    often = docs.sparkSession.sparkContext.broadcast(np.sort(common.toArrow()["token"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _hashed(batches):
            out = [[], [], [], []]
            for doc, f in zip(part["doc_id"].to_pylist(), found, strict=True):
                s = f.view(np.int64)
                n, k = len(s), how_many(len(s))
                at = np.minimum(np.searchsorted(often.value, s), max(0, len(often.value) - 1))
                first = s[np.lexsort((s, often.value[at] == s))[:k]] if len(often.value) else np.sort(s)[:k]
                for column, x in zip(out, (np.full(k, doc), np.full(k, n), np.arange(k, dtype=np.int32), first), strict=True):
                    column.append(x)
            kinds = (np.int64, np.int64, np.int32, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.empty(0), from_pandas=False).cast(pa.from_numpy_dtype(k)) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "n", "at", "token"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)  # not behind sets: a task would hold a second Python worker, and an executor keeps it


def _met(posts: DataFrame, others: DataFrame, percent: int, order: Column) -> DataFrame:
    """Distinct pairs (a, b) of posts and others that share a token, lie in different components and may reach the similarity; order: which of (a, b) and (b, a) count.

    A set of n with n * percent / 100 <= m <= n * 100 / percent members in the other needs an overlap of
    percent * (n + m) / (100 + percent); in one order of all shingles, both have their first common one where at least that much is left."""
    other = others.select("token", F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"), F.col("component").alias("component_b"))
    mine = posts.select("token", F.col("doc_id").alias("a"), "n", "at", "component")
    left = F.least(F.col("n") - F.col("at"), F.col("n_b") - F.col("at_b"))
    reach = left * (100 + percent) >= percent * (F.col("n") + F.col("n_b"))
    met = mine.join(other, "token").where(order & (F.col("component") != F.col("component_b")) & reach)
    return stage(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")


def _by_prefix(docs: DataFrame, found: DataFrame, comp: DataFrame, percent: int, short: int, rounds: int = 1) -> DataFrame:
    """found and the links (a, b) of docs, staged, between its components: all that are needed, by a prefix of their shingles.

    Members of lists of over ``short`` meet a pivot of their list first, in each round another; those whom no pivot links meet all others that share a token."""
    common = stage(_common(docs, short), "common")
    every = stage(_prefixes(docs, percent, common), "prefixes")
    shared = every.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    posts = stage(every.join(shared, "token"), "posts")
    unstage(common)
    unstage(every)
    popular = posts.groupBy("doc_id").agg(F.sum(F.log2("df")).alias("popular"))
    for k in range(rounds):
        marked = _labelled(posts, comp)
        mixed = marked.where(F.col("df") > short).groupBy("token").agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c <> d").select("token")
        some = stage(marked.join(mixed, "token"), "mixed")
        if some.isEmpty():
            break
        first = F.col("popular") if not k else F.xxhash64("doc_id", F.lit(k)).cast("double")
        heads = some.join(popular, "doc_id").groupBy("token").agg(F.max(F.struct(first.alias("first"), "doc_id", "n", "at", "component")).alias("x")).select("token", "x.doc_id", "x.n", "x.at", "x.component")
        found = found.unionByName(confirm(docs, _met(some, heads, percent, F.col("a") != F.col("b")), percent))
        comp = components(found)
        unstage(some)
    return found.unionByName(confirm(docs, _met(_labelled(posts, comp), _labelled(posts, comp), percent, F.col("a") < F.col("b")), percent))


def links(docs: DataFrame, reps: DataFrame, percent: int = 85, posted: int = POSTED, least: int = LEAST, matches: int = MATCHES, short: int = SHORT) -> DataFrame:
    """Confirmed links (a, b) between class representatives that join all components there are.

    docs: (doc_id, text) of the representatives; reps: (doc_id, sig)."""
    prefix = posted - least + 1
    coordinate = F.transform(F.sequence(F.lit(1), F.lit(prefix)), lambda c: F.xxhash64(c, F.element_at(F.col("sig"), c)))
    lists = reps.select("doc_id", F.explode(coordinate).alias("key"))
    sizes = lists.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    lists = stage(lists.join(sizes, "key"), "lists")  # a list of one links nothing
    popular = lists.groupBy("doc_id").agg(F.sum(F.log2("n")).alias("popular"))
    heads = lists.join(popular, "doc_id").groupBy("key").agg(F.max(F.struct("popular", (-F.col("doc_id")).alias("i"))).alias("x")).select("key", (-F.col("x.i")).alias("a"))
    pairs = lists.select("key", F.col("doc_id").alias("b")).join(heads, "key").where("a <> b").select("a", "b").distinct()
    found = confirm(docs, _collisions(pairs, reps, matches), percent)
    comp = components(found)
    marked = _labelled(lists, comp)
    mixed = marked.groupBy("key").agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c <> d").select("key")
    still = stage(marked.join(mixed, "key"), "mixed")
    unstage(lists)
    close = still.where(F.col("n") <= short).select("key", "doc_id", "component")
    other = close.select("key", F.col("doc_id").alias("b"), F.col("component").alias("component_b"))
    near = close.withColumnRenamed("doc_id", "a").join(other, "key").where("a < b and component <> component_b").select("a", "b").distinct()
    found = found.unionByName(confirm(docs, _collisions(near, reps, matches), percent))
    crowd = stage(still.where(F.col("n") > short).select("doc_id").distinct(), "crowd")
    crowded = stage(narrowed(docs, crowd, "doc_id").join(crowd, "doc_id", "left_semi"), "crowded")
    return _by_prefix(crowded, found, components(found), percent, short)


def near_duplicates(docs: DataFrame, percent: int = 85, **how) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) a distinct doc_id; docs: doc_id, text, other columns are ignored."""
    with small_batches(docs.sparkSession):  # all that runs Python is staged in here
        return _near_duplicates(docs.select("doc_id", "text"), percent, **how)


def _near_duplicates(docs: DataFrame, percent: int, **how) -> DataFrame:
    signed = stage(sets(docs.where("doc_id is not null"), full=False), "sets")
    one = stage(signed.groupBy("doc_id").agg(F.min(F.struct("n", "s1", "s2")).alias("x")).select("doc_id", "x.*"), "one")
    classes = one.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    # A class's representative by set, then its signature
    reps = stage(signed.join(classes.select(F.col("rep").alias("doc_id"), "s1", "s2"), ["doc_id", "s1", "s2"]).groupBy("doc_id").agg(F.first("sig").alias("sig")), "signatures")
    unstage(signed)
    found = links(docs, reps, percent, **how)
    comp = components(found).select(F.col("id").alias("rep"), "component")
    of_class = classes.join(comp, "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("component"))
    known = one.join(of_class, ["s1", "s2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return known.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
