"""Periodic run detection over words, by string synchronising sets.

A run is a stretch of words with smallest period q, at least ``least`` and 2q long, that no neighbouring word extends.  Per scale tau
(4, 8, 16, ...) it is looked for where 4*tau <= q < 8*tau:

* A position is *synchronising* if the least hash of the tau-word factors that start at it and up to tau words later belongs to the first or
  to the last of them.  That depends on the 2*tau words from there on alone, so equal contexts are selected alike.  Factors whose
  own period is at most tau/3 are left out.
* Synchronising positions with equal contexts at a distance within the scale propose their distance as a period; the proposal is extended
  word by word, so no hash decides about a result.  A selected context has no small period, so it has few partners at such a distance.
* A run without a synchronising position within its first period is highly periodic there: that period lies in a run A of a small period r
  and the next one in a run B of the same r, which meet within r words.  These runs come from smaller scales (below 16 from comparing words at
  that distance directly), and each such pair gives all periods of its phase.

Documents are independent and stay in their partition; a batch's documents are searched together, longest first, and a scale sees only
those long enough for it.

Null and empty texts have no words and no runs; texts may be of any length.  Repeated ids and rows are judged one by one, a null id too.
An empty table gives no rows.  Columns named runs or collapsed are replaced, others are kept, except the text.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenledger.llm.common import table
from tokenledger.llm.pieces import blocks

LEAST = 12
#: The first scale; periods below four times it are found by comparing words directly.
TAU = 4
#: Characters of a batch that are searched together; a longer text is a batch of its own.
BLOCK_CHARS = 4_000_000
RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")]), False)
#: Odd constants of the mixing function (fixed values, any odd numbers do).
MIX_1, MIX_2, MIX_3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_2
    x = (x ^ (x >> np.uint64(27))) * MIX_3
    return x ^ (x >> np.uint64(31))


def doubled(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of factors of 2*width words from those of width words."""
    return mix(h[:-width] * MIX_1 + h[width:])


def stretched(x: np.ndarray, i: int, q: int) -> tuple[int, int]:
    """(start, end) of the longest stretch of period q around the words i and i + q, which are equal."""
    n, step, end = len(x), 64, i + q
    while end < n:
        stop = min(n, end + step)
        odd = np.flatnonzero(x[end:stop] != x[end - q : stop - q])
        if len(odd):
            end += int(odd[0])
            break
        end, step = stop, step * 2
    start, step = i, 64
    while start > 0:
        stop = max(0, start - step)
        odd = np.flatnonzero(x[stop:start] != x[stop + q : start + q])
        if len(odd):
            start = stop + int(odd[-1]) + 1
            break
        start, step = stop, step * 2
    return start, end


def smallest(runs: np.ndarray) -> np.ndarray:
    """Rows (start, length, period), sorted; of one stretch that with the smallest period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.r_[True, (runs[1:, :2] != runs[:-1, :2]).any(1)] if len(runs) else np.zeros(0, bool)
    return runs[first]


def by_distance(x: np.ndarray, below: int) -> np.ndarray:
    """Stretches of 4 words and two periods or more, of periods under ``below``."""
    found = [np.zeros((0, 3), np.int64)]
    for q in range(1, min(below, len(x))):
        same = np.flatnonzero(x[q:] == x[:-q])
        if len(same):
            cut = np.flatnonzero(np.diff(same) != 1)
            starts, ends = same[np.r_[0, cut + 1]], same[np.r_[cut, len(same) - 1]] + 1
            ok = ends - starts >= max(q, 4 - q)
            found.append(np.c_[starts[ok], ends[ok] - starts[ok] + q, np.full(ok.sum(), q)])
    return smallest(np.concatenate(found).astype(np.int64))


def phase(before: np.ndarray, after: np.ndarray) -> int | None:
    """Where after stands in before."""
    a, b, size = before.tobytes(), after.tobytes(), before.itemsize
    at = a.find(b)
    while at >= 0 and at % size:
        at = a.find(b, at + 1)
    return at // size if at >= 0 else None


def from_pairs(x: np.ndarray, runs: np.ndarray, tau: int) -> list[tuple[int, int, int]]:
    """Runs of periods within the scale whose periods are themselves stretches of a small period."""
    out = []
    small = runs[(3 * runs[:, 2] <= tau) & (runs[:, 1] >= 4 * tau)]
    small = small[np.lexsort((small[:, 0], small[:, 2]))]
    for a, b in zip(small[:-1], small[1:], strict=True):
        (a_start, a_len, r), (b_start, b_len, other) = a.tolist(), b.tolist()
        a_end, b_end = a_start + a_len, b_start + b_len
        if r != other or b_start > a_end:
            continue
        at = phase(x[a_end - 2 * r : a_end], x[a_end : a_end + r])
        if at is None:
            continue
        first = 2 * r - at
        first += -(-max(0, 4 * tau - first) // r) * r
        for p in range(first, min(8 * tau - 1, a_len, b_len) + 1, r):
            start, end = max(a_start, b_start - p), min(a_end + p, b_end)
            if a_start == b_start - p or a_end + p == b_end:  # both break off here, perhaps alike
                start, end = stretched(x, a_end - p, p)
            if end - start >= 2 * p:
                out.append((start, end - start, p))
    return out


def proposals(h: np.ndarray, context: np.ndarray, runs: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, distances) of equal contexts at synchronising positions within the scale."""
    value = h.copy()
    for start, length, _ in runs[(3 * runs[:, 2] <= tau) & (runs[:, 1] >= tau)].tolist():
        value[start : start + length - tau + 1] = NONE
    least, width = value, 1
    while width < tau:
        least, width = np.minimum(least[:-width], least[width:]), width * 2
    first, last = value[: len(context)], value[tau : tau + len(context)]
    least = np.minimum(least[: len(context)], last)
    chosen = np.flatnonzero(((least == first) | (least == last)) & (least != NONE))
    order = np.argsort(context[chosen], kind="stable")
    at, of = chosen[order], context[chosen][order]
    found_at, found_by, left, step = [], [], np.arange(len(at) - 1), 1
    while len(left):
        gap = at[left + step] - at[left]
        near = (of[left + step] == of[left]) & (gap < 8 * tau)
        hit = near & (gap >= 4 * tau)
        found_at.append(at[left[hit]])
        found_by.append(gap[hit])
        step += 1
        left = left[near]
        left = left[left + step < len(at)]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_at]), np.concatenate([none, *found_by])


def find_runs(x: np.ndarray, lengths: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period), by start and period, of all runs in x: documents of the given lengths, longest first, each
    followed by a number that occurs nowhere else."""
    runs = by_distance(x, 4 * TAU)
    ends = np.cumsum(lengths + 1)
    h, tau = mix(x.astype(np.uint64) * MIX_1 + MIX_3), 1
    while True:
        n = int(ends[: np.searchsorted(-lengths, -8 * max(tau, TAU), "right")][-1:].sum())  # documents of 8 tau words or more
        h = h[:n]
        if len(h) <= tau:
            break
        if tau >= TAU:
            context = doubled(h, tau)
            found = from_pairs(x, runs, tau)
            at, by = proposals(h, context, runs, tau)
            start = end = period = -1
            for i, q in zip(*(v[np.lexsort((at, by))].tolist() for v in (at, by)), strict=True):
                if q == period and start <= i < end - q:
                    continue
                period = q
                start, end = stretched(x, i, q)
                if end - start >= 2 * q:
                    found.append((start, end - start, q))
            if found:
                runs = smallest(np.concatenate([runs, np.array(found, np.int64)]))
            h = context
        else:
            h = doubled(h, tau)
        tau *= 2
    runs = runs[runs[:, 1] >= np.maximum(least, 2 * runs[:, 2])]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words, number of words of each text)."""
    lists = pc.ascii_split_whitespace(texts.fill_null("").cast(pa.large_string()))
    flat, offsets = lists.flatten(), np.asarray(lists.offsets) - lists.offsets[0].as_py()
    some = np.asarray(pc.not_equal(pc.binary_length(flat), 0))
    before = np.r_[0, np.cumsum(some)]
    return flat.filter(pa.array(some)), np.diff(before[offsets])


def joined(flat: pa.Array, counts: np.ndarray) -> pa.Array:
    """The words of each text with one blank between two."""
    lists = pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int64()), flat)
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string()))


def search(flat: pa.Array, counts: np.ndarray, least: int) -> tuple[list[list[tuple[int, int, int]]], np.ndarray]:
    """(runs of each text, whether each word is dropped)."""
    order = np.argsort(-counts, kind="stable")
    lengths = counts[order]
    codes = np.asarray(flat.dictionary_encode().indices).astype(np.int64)
    begin = np.cumsum(counts) - counts
    place = np.cumsum(lengths + 1) - (lengths + 1)  # of each text, in the order of search
    x = np.arange(len(codes), len(codes) + int(lengths.sum()) + len(lengths))  # numbers of their own
    where = np.arange(len(codes)) + np.repeat(_inverse(place, order) - begin, counts)
    x[where] = codes
    runs = find_runs(x, lengths, least)
    of = np.searchsorted(place, runs[:, 0], "right") - 1
    per: list[list[tuple[int, int, int]]] = [[] for _ in counts]
    edges = np.zeros(len(x) + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    for doc, start, (s, length, q) in zip(order[of].tolist(), place[of].tolist(), runs.tolist(), strict=True):
        per[doc].append((s - start, length, q))
    return per, (np.cumsum(edges) > 0)[where]


def _inverse(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    out = np.empty_like(values)
    out[order] = values
    return out


def periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST, rewrite: Callable[[object, int], np.ndarray] | None = None, key: str = "doc_id") -> DataFrame:
    """docs without the text, with runs (start, length, period as word numbers; by start, then period) and collapsed: the words
    outside the repeats of runs, which keep their first period, joined by one blank.

    rewrite: from a row's key and its number of words, for each word the number of that which takes its place."""
    docs = docs.drop("runs", "collapsed")
    kept = [c for c in docs.columns if c != text]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, text, BLOCK_CHARS):
            flat, counts = words(b[text])
            if rewrite is not None:
                begin = np.cumsum(counts) - counts
                moved = [rewrite(k, int(n)) + at for k, n, at in zip(b[key].to_pylist(), counts, begin, strict=True)]
                flat = flat.take(pa.array(np.concatenate(moved).astype(np.int64)))
            runs, gone = search(flat, counts, least)
            owner = np.repeat(np.arange(len(counts)), counts)
            stay = np.bincount(owner[~gone], minlength=len(counts))
            collapsed = joined(flat.filter(pa.array(~gone)), stay).cast(pa.string())
            found = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in runs], pa.list_(pa.struct([pa.field(c, pa.int64(), False) for c in ("start", "length", "period")])))
            yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), found, collapsed], names=[*kept, "runs", "collapsed"])

    return docs.select(*kept, text).mapInArrow(run, schema)


def planted(doc_id: int | None, n: int) -> np.ndarray:
    """The contract's periodic texts: of some ids, the words from a place on repeat those that stand there.  Rows without id stay as they are."""
    at = np.arange(n)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return at
    g = h // 10
    a = g % n
    at[a:] = a + (at[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return at


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), rewrite=planted)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    found = found.withColumn("best", best)
    b = F.col("best")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-b["start"]).alias("start"), b["length"].alias("length"), (-b["period"]).alias("period"),
        F.floor(1000 * b["length"] / -b["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
