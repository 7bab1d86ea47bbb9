"""Line dedup: range-partitioned hashes, secondary sort by document and position, keep bitmaps.

Keys (a line stripped of blanks, A-Z in lower case) of at least ``min_chars`` code points that occur
in at least ``min_docs`` documents lose all their lines except those in the largest doc_id that
holds the key.  The lines are range-partitioned by (hash, document), so one hot key spreads over as many
tasks as its documents need; each task streams its sorted rows once.  A key that reaches the first or
last row of a task may go on in another, so those keys (two a task at most) are settled from
per-task counts.  What comes back is one compressed bitmap of kept lines per document, no text.

A null or empty text is one empty line.  Rows without doc_id lose nothing and count for nothing.
Repeated rows of one doc_id are one document, each row with its own bitmap, so of a key in the largest doc_id all lines stay in all its rows.
An empty table gives no rows; texts and lines may be of any length, as lines are hashed in the JVM and only texts that lose lines are rebuilt.
Columns besides doc_id and text are ignored; n_drops and keep replace columns of these names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenledger.llm.common import BLANKS, lower_ascii, partitions, stage, table

MIN_CHARS, MIN_DOCS = 20, 3


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc_id, row, pos) of each line whose key is long enough; row tells repeated ids apart."""
    lines = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("row"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    key = lower_ascii(F.btrim("line", F.lit(BLANKS)))
    return lines.withColumn("key", key).where(F.length("key") >= min_chars).select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(17), "key").alias("h2"), "doc_id", "row", "pos")


def _stream(min_docs: int):
    """Over rows sorted by hash and falling document: decided drops, and the rows of keys at the ends.

    Only the first and last key of a batch may go on elsewhere and are carried along; those between are judged in one go."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        columns = ["doc_id", "row", "pos", "h1", "h2", "part", "open"]
        key, first, held, n_docs, top, last = None, True, [], 0, None, None

        def told(rows: pd.DataFrame, is_open: bool) -> pd.DataFrame:
            return rows.assign(part=part, open=is_open)[columns]

        for rows in batches:
            if not len(rows):
                continue
            h1, h2, docs = rows.h1.values, rows.h2.values, rows.doc_id.values
            new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
            starts = np.flatnonzero(new)
            other = new | np.r_[True, docs[1:] != docs[:-1]]  # another document of the same key, or another key
            if len(starts) > 2:
                a, b = starts[1], starts[-1]
                of = np.cumsum(new[a:b]) - 1
                many = np.bincount(of[other[a:b]]) >= min_docs
                drop = many[of] & (docs[a:b] != docs[starts[1:-1]][of])
                if drop.any():
                    yield told(rows.iloc[a:b][drop], False)
            for a, b in [(starts[0], starts[1] if len(starts) > 1 else len(rows)), *([(starts[-1], len(rows))] if len(starts) > 1 else [])]:
                if (h1[a], h2[a]) != key:
                    if n_docs >= min_docs:
                        yield from (told(h[h.doc_id != top], False) for h in held)
                    first, key, held, n_docs, top, last = key is None, (h1[a], h2[a]), [], 0, docs[a], None
                n_docs += int(other[a + 1 : b].sum()) + (last != docs[a])
                last = docs[b - 1]
                if first:
                    yield told(rows.iloc[a:b], True)
                else:
                    held.append(rows.iloc[a:b])
        yield from (told(h, True) for h in held)

    return run


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, row, pos) of each line to drop."""
    spark = docs.sparkSession
    n = partitions(spark)
    lines = stage(line_hashes(docs, min_chars), "hashes")  # read twice: range partitioning samples its input first
    order = ["h1", "h2", F.desc("doc_id")]
    ordered = lines.repartitionByRange(n, *order).sortWithinPartitions(*order, "row", "pos")
    told = stage(ordered.mapInPandas(_stream(min_docs), "doc_id long, row long, pos int, h1 long, h2 long, part int, open boolean"), "lines")
    at_ends = told.where("open")
    # A document's rows of one key are in one task, so the tasks' counts add up. Two keys a task at most.
    keys = (
        at_ends.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("top"))
        .where(F.col("n_docs") >= min_docs)
    )
    late = at_ends.join(F.broadcast(keys), ["h1", "h2"]).where(F.col("doc_id") != F.col("top"))
    return told.where("not open").select("doc_id", "row", "pos").unionByName(late.select("doc_id", "row", "pos"))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, row, drops, keep) for documents that lose lines.  keep: zlib of numpy.packbits over
    the lines up to the last dropped one; lines after it stay.  A document's list is bounded by its lines."""

    @F.pandas_udf("binary")
    def bitmap(drops: pd.Series) -> pd.Series:
        def one(at) -> bytes:
            bits = np.ones(-(-(int(max(at)) + 1) // 8) * 8, bool)  # whole bytes, lines past the end stay
            bits[np.asarray(at)] = False
            return zlib.compress(np.packbits(bits).tobytes())

        return drops.map(one)

    return (
        dropped_lines(docs, min_chars, min_docs).groupBy("doc_id", "row").agg(F.collect_set("pos").alias("drops"))
        .select("doc_id", "row", F.size("drops").alias("n_drops"), bitmap("drops").alias("keep"))
    )


def unpack(keep: bytes, n_drops: int, n_lines: int) -> np.ndarray:
    """The keep flag of each of a document's lines."""
    bits = np.ones(n_lines, bool)
    if keep is not None:
        packed = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8)).astype(bool)[:n_lines]
        bits[: len(packed)] = packed
    return bits


def with_bitmaps(docs: DataFrame, **how) -> DataFrame:
    """All columns and rows of docs with n_drops and keep (null where nothing is dropped)."""
    marks = keep_bitmaps(docs, **how).select(F.col("doc_id").alias("_doc"), F.col("row").alias("_row"), "n_drops", "keep")
    docs = docs.drop("n_drops", "keep")
    return docs.join(marks, (docs.doc_id == marks._doc) & (F.xxhash64(docs.text) == marks._row), "left").drop("_doc", "_row")


def kept_text(text: str | None, keep: bytes | None) -> tuple[int, int, str]:
    """(lines, dropped lines, remaining text)."""
    lines = (text or "").split("\n")
    if keep is None:
        return len(lines), 0, text or ""
    bits = unpack(keep, 0, len(lines))
    return len(lines), int((~bits).sum()), "\n".join(x for x, stays in zip(lines, bits, strict=True) if stays)


@F.pandas_udf(T.StringType())
def _kept(text: pd.Series, keep: pd.Series) -> pd.Series:
    return pd.Series([None if k is None else kept_text(t, k)[2] for t, k in zip(text, keep, strict=True)], dtype=object)


def remaining() -> Column:
    """Text without its dropped lines, of rows with text and keep; only texts that lose lines go to Python."""
    return F.when(F.col("keep").isNotNull(), _kept(F.when(F.col("keep").isNotNull(), F.col("text")), F.col("keep"))).otherwise(F.col("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_bitmaps(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    n_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return docs.select("doc_id", n_lines.cast("long").alias("n_lines"), F.coalesce("n_drops", F.lit(0)).cast("long").alias("n_dropped"), F.sha2(F.coalesce(remaining(), F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
d AS (SELECT k.*, s.top IS NOT NULL AND doc_id <> s.top AS dropped FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""
