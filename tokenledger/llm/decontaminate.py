"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits in lower case.  The 5-word grams of the test items (an item of fewer words: all of
it) are the seeds.  One scan of the documents finds every place where seeds of an item stand; a window
reaches from there as far as an alignment of ``threshold`` can, (1 - threshold) / edit words an item word beyond the item's two ends, and
windows of an item that overlap are one.  Windows are aligned with the item
word by word (match 1, each substituted, missing or added word -0.1); score is the best local sum over the item's words.  A
document is contaminated if an item scores ``threshold`` or more.  However common a seed is, its windows count; only
those that hold too few of the item's words, in any order, to reach the threshold are not aligned, as most places of a mere phrase.

An item of fewer than 5 words stands in any prose, so it counts only in a document of which its words are half or more.

The seed table is broadcast; items come in blocks of about ``block_items`` items and ``block_chars`` characters at most, which
bounds it to some 100 MB a task (a longer item is a block's bulk by itself: items are never cut).  Null or empty texts and items match nothing, an
empty table of either gives no rows; texts may be of any length; of equal scores the smallest item_id is reported; repeated
rows, and rows without doc_id, are judged each by itself, told apart by a hash of the text; extra columns are ignored, clashing ones replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.llm.common import stage, table, text_mark, without
from tokenledger.llm.minhash import mix

WORDS = re.compile(r"[^\W_]+")
WIDTH, THRESHOLD, EDIT = 5, 0.8, 0.1
BLOCK_ITEMS, BLOCK_CHARS = 50_000, 4_000_000
#: Stands for a doc_id that is null.
NO_ID = -(2**63)
#: Cells of one row of spans aligned at a time.
GRID = 200_000
_ODD = np.random.default_rng(11).integers(1, 2**63, 8, dtype=np.uint64) | np.uint64(1)


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def grams(ids: np.ndarray, width: int) -> np.ndarray:
    """Hash of each width consecutive word numbers."""
    n = len(ids) - width + 1
    h = np.full(max(0, n), width, np.uint64)
    for j in range(width if n > 0 else 0):
        h = mix(h * _ODD[j] + ids[j : j + n].astype(np.uint64))
    return h


class Seeds:
    """The items of a block: word numbers, and the sorted seeds with item, first and last position."""

    def __init__(self, items: list[tuple[int, str]], width: int = WIDTH):
        self.vocab: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        found: dict[int, list[np.ndarray]] = {}
        for item, text in items:
            ws = words_of(text)
            if not ws:
                continue
            ids = np.array([self.vocab.setdefault(w, len(self.vocab)) for w in ws], np.int64)
            k = min(width, len(ids))
            h = grams(ids, k)
            seed, first = np.unique(h, return_index=True)
            last = len(h) - 1 - np.unique(h[::-1], return_index=True)[1]
            found.setdefault(k, []).append(np.stack([seed.view(np.int64), np.full(len(seed), len(self.items)), first, last], 1))
            self.items.append((item, ids))
        self.bags = [np.unique(ids, return_counts=True) for _, ids in self.items]
        self.by_width = {}
        for k, rows in found.items():
            r = np.concatenate(rows)
            self.by_width[k] = r[np.argsort(r[:, 0].view(np.uint64), kind="stable")]

    def hits(self, ids: np.ndarray) -> np.ndarray:
        """(seed hash, item number, first and last place in item, place in ids) of each seed in a document; unknown words are -1."""
        out = []
        for k, seeds in self.by_width.items():
            if len(ids) < k:
                continue
            known = np.convolve(ids >= 0, np.ones(k, int), "valid") == k
            at = np.flatnonzero(known)
            if not len(at):
                continue
            h = grams(ids, k)[at]
            keys = seeds[:, 0].view(np.uint64)
            lo, hi = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
            n = hi - lo
            if n.any():
                rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
                out.append(np.column_stack([seeds[rows], np.repeat(at, n)]))
        return np.concatenate(out) if out else np.empty((0, 5), np.int64)

    def most(self, i: int, span: np.ndarray) -> float:
        """What item i can score in a span at most: the share of its words that are there."""
        words, n = self.bags[i]
        there, m = np.unique(span, return_counts=True)
        at = np.minimum(np.searchsorted(there, words), len(there) - 1)
        return np.minimum(n, np.where(there[at] == words, m[at], 0)).sum() / len(self.items[i][1])


def windows(seeds: Seeds, ids: np.ndarray, threshold: float = THRESHOLD) -> Iterator[tuple[int, list[int]]]:
    """(item number, word numbers of the window), one for each place where an item may reach the threshold."""
    hits = seeds.hits(ids)
    if not len(hits):
        return
    item, first, last, at = hits[:, 1:].T
    n = np.array([len(seeds.items[i][1]) for i in item])
    reach = np.maximum(0, (1 - threshold) * n / EDIT + 1e-6).astype(np.int64)  # so many added words cost all the score there is to lose
    lo, hi = np.maximum(0, at - last - reach), np.minimum(len(ids), at - first + n + reach)
    order = np.lexsort((lo, item))
    item, lo, hi = item[order], lo[order], hi[order]
    apart = item * (len(ids) + 1)  # items one after another, so that one running maximum serves all
    far = np.maximum.accumulate(hi + apart)
    starts = np.r_[0, np.flatnonzero((lo + apart)[1:] > far[:-1]) + 1]
    ends = np.r_[starts[1:], len(item)] - 1
    for i, a, b in zip(item[starts].tolist(), lo[starts].tolist(), (far - apart)[ends].tolist(), strict=True):
        short = len(seeds.items[i][1]) < WIDTH and 2 * len(seeds.items[i][1]) < len(ids)
        if not short and seeds.most(i, ids[a:b]) >= threshold - 1e-9:
            yield i, ids[a:b].tolist()


def align(item: np.ndarray, spans: list[np.ndarray], edit: float = EDIT) -> np.ndarray:
    """Best local alignment score of each span with the item, over the item's length."""
    width = max(map(len, spans))
    grid = np.full((len(spans), width), -1, np.int64)
    for r, s in enumerate(spans):
        grid[r, : len(s)] = s
    ramp = np.arange(width + 1) * edit
    row, best = np.zeros((len(spans), width + 1)), np.zeros(len(spans))
    for w in item:
        new = np.maximum(0, row - edit)
        new[:, 1:] = np.maximum(new[:, 1:], row[:, :-1] + np.where(grid == w, 1.0, -edit))
        row = np.maximum.accumulate(new + ramp, axis=1) - ramp  # words added in the span
        best = np.maximum(best, row.max(1))
    return best / len(item)


def _block(docs: DataFrame, items: list[tuple[int, str]], threshold: float) -> DataFrame:
    """(doc_id, mark, item_id, score) of every window of these items."""
    shared = docs.sparkSession.sparkContext.broadcast(Seeds(items))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = shared.value
        find = seeds.vocab.get
        for b in batches:
            rows = []
            for doc, mark, text in zip(b["doc_id"].to_pylist(), b["mark"].to_pylist(), b["text"].to_pylist(), strict=True):
                ids = np.array([find(w, -1) for w in words_of(text)], np.int64)
                rows += [(doc, mark, *w) for w in windows(seeds, ids, threshold)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "mark", "item", "span"])

    found = stage(docs.select("doc_id", text_mark().alias("mark"), "text").mapInArrow(scan, "doc_id long, mark long, item int, span array<int>"), "windows")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds = shared.value
        for b in batches:
            for i, part in b.groupby("item"):
                item, ids = seeds.items[i]
                part = part.iloc[np.argsort(part.span.map(len), kind="stable")]  # spans of about one length share a grid
                width = part.span.map(len).to_numpy()
                at = 0
                while at < len(part):
                    end = at + 1
                    while end < min(len(part), at + 500) and (end + 1 - at) * width[end] <= GRID:
                        end += 1
                    some, at = part.iloc[at:end], end
                    yield pd.DataFrame({"doc_id": some.doc_id, "mark": some.mark, "item_id": item, "score": align(ids, some.span.tolist())})

    scored = found.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))).mapInPandas(score, "doc_id long, mark long, item_id long, score double")
    return scored.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def alignments(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, block_items: int = BLOCK_ITEMS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, mark, item_id, score) of all places aligned, those that may reach the threshold; docs: doc_id, text; items: item_id, text."""
    items = items.where("text is not null and item_id is not null").select("item_id", "text")
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    n_blocks = max(1, -(-size["n"] // block_items), -(-size["chars"] // block_chars))
    out = None
    for k in range(n_blocks):  # the items of a block are bounded, however many there are
        mine = sorted(map(tuple, items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).collect()))
        one = _block(docs, mine, threshold)
        out = one if out is None else out.unionByName(one)
    return out


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, **how) -> DataFrame:
    """(doc_id, mark, item_id, score, n_items) of each contaminated doc_id and text: its best item and how many reach the threshold."""
    best = alignments(docs, items, threshold, **how).where(F.col("score") >= threshold - 1e-9).groupBy("doc_id", "mark", "item_id").agg(F.max("score").alias("score"))
    return best.groupBy("doc_id", "mark").agg(F.max(F.struct("score", (-F.col("item_id")).alias("i"))).alias("x"), F.count("*").alias("n_items")).select(
        "doc_id", "mark", (-F.col("x.i")).alias("item_id"), F.col("x.score").alias("score"), "n_items")


def clean(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The rows of docs that are not contaminated."""
    gone = stage(contaminated(docs, items, **how).select("doc_id", F.col("mark").alias("_mark")), "contaminated")
    return without(docs.withColumn("_mark", text_mark()), gone, "doc_id", "_mark").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, contaminated, n_items, item_id and score of the best item (else null)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = contaminated(docs, table(spark, sf_dir, "benchmark")).withColumnRenamed("doc_id", "_doc").withColumnRenamed("mark", "_mark")
    marked = docs.select("doc_id", text_mark().alias("mark"))
    return marked.join(hits, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark")), "left").select(
        "doc_id", F.col("score").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), "item_id", "score")
