"""Removal of repeated byte strings by induction from sampled suffixes.

A text is its UTF-8 bytes.  Every byte inside a string of ``length`` bytes that also starts anywhere else is removed.

Suffixes of all positions would need some 16 bytes for each byte of text, four times the disk there is.  So, as in
induced sorting, a sample of suffixes is named first and the others follow from their names: of the ``length`` bytes
from any position on, the sample suffix is the one whose first ``core`` bytes hash lowest (leftmost of equal ones).
Equal strings have equal samples at equal places, so

1. the strings that share a sample form a run; sample name and run name (hashes of its core and of all bytes of
   the run) are counted, and runs with a name seen twice are removed as a whole;
2. sample names with several run names go on: one run of each name gives the names of its single strings, and
   strings seen in two of them are removed from runs that are not removed already.

Both steps are counts by name, so a name that a third of all rows hold is summed before it meets; sorting
and spilling are those of Spark's shuffles.  Matches never cross documents.  Equal means that two names are equal, that of the string or run and
that of the sample in it.  A name has 64 bits, a polynomial over mixed 8-byte words of the bytes, so that no pattern in a text makes terms cancel.
Strings with different samples are so told apart by 128 bits; those that share a sample, and with it its bytes, by 64, but only
these meet, so the odds of an error grow with the square of the strings of one sample, not of the corpus.

A null text is empty; an empty table gives no rows; texts may be of any length, and are read in blocks of whole texts.  A document is a
(doc_id, text); repeated rows are copies of one another, rows without doc_id are documents like others.  There are no ties: every
repeated string goes, the first one too.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.llm.common import narrowed, stage, table
from tokenledger.llm.minhash import mix

LENGTH, CORE, BLOCK = 400, 250, 1 << 20
#: Bytes that are mixed into one term of a name.
WORD = 8
_BASE = np.uint64(int(np.random.default_rng(23).integers(1, 2**61)) * 8 + 5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_PLACE = np.uint64((1 << 24) - 1)


class Names:
    """Names of any substrings of a block of bytes: prefix sums of a polynomial, made independent of the place."""

    powers = np.ones(1, np.uint64)
    back = np.ones(1, np.uint64)

    @classmethod
    def grow(cls, n: int) -> None:
        if len(cls.powers) < n:
            with np.errstate(over="ignore"):
                cls.powers = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE)])
                cls.back = np.cumprod(np.r_[np.uint64(1), np.full(n, _INVERSE)])

    def __init__(self, data: np.ndarray, word: int = WORD):
        """Of strings of ``word`` bytes or more."""
        self.word, n = word, max(0, len(data) - word + 1)
        self.grow(len(data) + 1)
        words = np.zeros(n, np.uint64)
        for j in range(word if n else 0):
            words |= data[j : j + n].astype(np.uint64) << np.uint64(8 * j)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(words) * self.powers[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop - self.word + 1] - self.sums[start]) * self.back[start] + (stop - start).astype(np.uint64))

    def all_of(self, n: int) -> np.ndarray:
        """Names of the n bytes from each place on."""
        m = n - self.word + 1
        k = len(self.sums) - m
        return mix((self.sums[m:] - self.sums[:-m]) * self.back[:k] + np.uint64(n))


def runs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int, core: int):
    """(names, document number, first place, strings, sample name, run name) of each run in a block of documents."""
    names = Names(data, min(WORD, core))
    if len(data) < length:
        return names, *(np.empty(0, np.int64),) * 3, *(np.empty(0, np.uint64),) * 2
    low = (names.all_of(core) & ~_PLACE) | (np.arange(len(data) - core + 1, dtype=np.uint64) & _PLACE)
    width, span = length - core + 1, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        rest = width - span
        low = np.minimum(low[:-rest], low[rest:])
    low &= _PLACE
    here = np.arange(len(low), dtype=np.uint64)
    sample = (here + ((low - here) & _PLACE)).astype(np.int64)
    inside = np.zeros(len(low), bool)
    edge = np.zeros(len(low), bool)
    for a, n in zip(starts.tolist(), sizes.tolist(), strict=True):
        if n >= length:
            inside[a : a + n - length + 1] = True
            edge[a] = True
    first = np.flatnonzero(inside & (edge | np.r_[True, sample[1:] != sample[:-1]]))
    valid_to = np.cumsum(inside)
    nth = valid_to[first]
    count = np.diff(np.r_[nth, valid_to[-1] + 1])
    doc = np.searchsorted(starts, first, "right") - 1
    at = sample[first]
    run = names.of(first, first + count - 1 + length) + (at - first).astype(np.uint64)
    return names, doc, first, count, names.of(at, at + core), run


def _blocks(texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers, bytes, starts, sizes) of some texts with about BLOCK bytes in all."""
    some, raw, size = [], [], 0
    for i, t in enumerate(texts):
        b = (t or "").encode()
        some.append(i)
        raw.append(b)
        size += len(b)
        if size >= BLOCK or i == len(texts) - 1:
            sizes = np.array([len(r) for r in raw])
            yield some, np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes) - sizes, sizes
            some, raw, size = [], [], 0


#: Stands for a doc_id that is null.
NO_ID = -(2**63)


def marked(docs: DataFrame) -> DataFrame:
    """(id, mark, doc_id, text): id and mark, a hash of the text, tell a document from others of the same doc_id."""
    return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), "doc_id", "text")


def named_runs(docs: DataFrame, length: int = LENGTH, core: int = CORE, combine: bool = False) -> DataFrame:
    """(sample, run, id, mark, at, n, seen): each run of n strings from byte at on; docs: as marked gives them.

    With combine, runs of one name in a batch are one row, seen says how many, and one of their places stands for all."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, marks, texts = b["id"].to_numpy(), b["mark"].to_numpy(), b["text"].to_pylist()
            for some, data, starts, sizes in _blocks(texts):
                _, doc, first, count, sample, run = runs(data, starts, sizes, length, core)
                seen = np.ones(len(doc), np.int64)
                if combine and len(doc):
                    order = np.lexsort((run, sample))
                    new = np.flatnonzero(np.r_[True, (np.diff(sample[order]) != 0) | (np.diff(run[order]) != 0)])
                    seen, order = np.diff(np.r_[new, len(order)]), order[new]
                    doc, first, count, sample, run = (x[order] for x in (doc, first, count, sample, run))
                which = np.array(some)[doc]
                cols = (sample.view(np.int64), run.view(np.int64), ids[which], marks[which], (first - starts[doc]).astype(np.int32), count.astype(np.int32), seen)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["sample", "run", "id", "mark", "at", "n", "seen"])

    return docs.select("id", "mark", "text").mapInArrow(scan, "sample long, run long, id long, mark long, at int, n int, seen long")


def _strings(docs: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """(sample, name, id, mark, at, own) of each single string of the asked runs (sample, id, mark, at, n, own)."""
    lists = stage(asked.groupBy("id", "mark").agg(F.collect_set(F.struct("at", "n", "own", "sample")).alias("runs")), "asked")  # bounded by the document
    some = narrowed(docs.select("id", "mark", "text"), lists, "id", "mark").join(lists, ["id", "mark"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                names = Names(np.frombuffer((b["text"][i].as_py() or "").encode(), np.uint8), min(WORD, length))
                flat = b["runs"][i].values.flatten()
                start, n = flat[0].to_numpy().astype(np.int64), flat[1].to_numpy().astype(np.int64)
                at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
                own, sample = np.repeat(flat[2].to_numpy(zero_copy_only=False), n), np.repeat(flat[3].to_numpy(), n)
                name, k = names.of(at, at + length).view(np.int64), len(at)
                yield pa.RecordBatch.from_arrays([pa.array(sample), pa.array(name), pa.array(np.full(k, b["id"][i].as_py())), pa.array(np.full(k, b["mark"][i].as_py())), pa.array(at.astype(np.int32)), pa.array(own)], names=["sample", "name", "id", "mark", "at", "own"])

    return some.dropDuplicates(["id", "mark"]).mapInArrow(scan, "sample long, name long, id long, mark long, at int, own boolean")


def repeated_spans(docs: DataFrame, length: int = LENGTH, core: int = CORE) -> DataFrame:
    """(id, mark, at, n): starts of repeated strings, n from byte at on; docs: as marked gives them."""
    every = named_runs(docs, length, core, combine=True)
    samples = every.groupBy("sample").agg(F.sum("seen").alias("all_seen"), F.min("run").alias("lo"), F.max("run").alias("hi"))
    # A sample that occurs once alone needs nothing more, and most are such.
    several = stage(samples.where("all_seen > 1").select("sample", (F.col("lo") != F.col("hi")).alias("mixed")), "samples")
    by_name = every.join(several, "sample").groupBy("sample", "run", "mixed").agg(F.sum("seen").alias("seen"), F.min(F.struct("id", "mark", "at", "n")).alias("x"))
    left = stage(by_name.select("sample", "run", "mixed", "seen", "x.*"), "runs")
    repeated = left.where("seen > 1").select("sample", "run")
    whole = narrowed(named_runs(docs, length, core), repeated, "sample", "run").join(repeated, ["sample", "run"]).select("id", "mark", "at", "n")
    asked = left.where("mixed").select("sample", "id", "mark", "at", "n", (F.col("seen") == 1).alias("own"))
    strings = stage(_strings(docs, asked, length), "strings")
    twice = strings.groupBy("sample", "name").agg(F.count("*").alias("seen"), F.max("own").alias("own")).where("seen > 1 and own").select("sample", "name")
    single = strings.where("own").join(twice, ["sample", "name"]).select("id", "mark", "at", F.lit(1).alias("n"))
    return whole.unionByName(single)


def merged(starts: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """Maximal removed stretches (from, to) for starts of repeated strings."""
    order = np.argsort(starts, kind="stable")
    a, b = starts[order], (starts + counts - 1 + length)[order]
    reach = np.maximum.accumulate(b)
    new = np.flatnonzero(np.r_[True, a[1:] > reach[:-1]])
    return np.stack([a[new], np.r_[reach[new[1:] - 1], reach[-1]]], 1)


def query(spark: SparkSession, sf_dir: str, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and repeats, whether anything is removed, for every document."""
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"), length).withColumn("repeats", F.col("n_removed") > 0)


def digests(docs: DataFrame, length: int = LENGTH, core: int = CORE) -> DataFrame:
    docs = marked(docs)
    spans = stage(repeated_spans(docs, length, core).groupBy("id", "mark").agg(F.collect_set(F.struct("at", "n")).alias("runs")), "spans")  # bounded by the document
    some = narrowed(docs, spans, "id", "mark").join(spans, ["id", "mark"], "left").select("doc_id", "text", "runs")
    untouched = narrowed(docs, spans, "id", "mark", anti=True).select("doc_id", "text", F.lit(None).cast(spans.schema["runs"].dataType).alias("runs"))
    both = some.unionByName(untouched)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, found in zip(b["text"].to_pylist(), b["runs"], strict=True):
                data = (text or "").encode()
                if not found.is_valid:
                    out.append((len(data), 0, 0, hashlib.sha256(data).hexdigest()))
                    continue
                flat = found.values.flatten()
                cut = merged(flat[0].to_numpy().astype(np.int64), flat[1].to_numpy().astype(np.int64), length)
                kept = b"".join(data[x:y] for x, y in zip([0, *cut[:, 1].tolist()], [*cut[:, 0].tolist(), len(data)], strict=True))
                out.append((len(data), len(data) - len(kept), len(cut), hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return both.mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
