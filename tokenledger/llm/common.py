"""Helpers shared by the corpus operators: table access and shared-folder staging."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.sources.staging import shared_dir, stage, unstage

__all__ = ["BLANKS", "LOWER", "SLOTS", "UPPER", "lower_ascii", "narrowed", "partitions", "shared_dir", "small_batches", "stage", "table", "text_mark", "unstage", "without"]
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The white space of the contracts: blank and the control characters 0x09 to 0x0D.
BLANKS = " \t\n\x0b\x0c\r"
#: Hash slots of ids that may be broadcast.
SLOTS = 1 << 20
#: Rows, and bytes, that go to Python at a time under small_batches.
BATCH_ROWS, BATCH_BYTES = 1024, "8m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs meanwhile hands rows to Python in small batches: Spark's 10,000 whole texts are held by the executor and by the worker at once, and more of them
    while a buffer grows.  The session's settings are as before afterwards; a smaller number of rows stays."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    was = {k: spark.conf.get(k) for k in (rows, size)}
    if not 0 < int(was[rows]) < BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)
    spark.conf.set(size, BATCH_BYTES)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def lower_ascii(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def narrowed(rows: DataFrame, ids: DataFrame, *keys: str, anti: bool = False) -> DataFrame:
    """The rows whose keys may be among those of ids, or with anti those whose keys are surely not.

    At most SLOTS hash slots of ids are broadcast, so that texts nobody asks for stay out of the shuffle of the exact join that follows."""
    slot = F.pmod(F.xxhash64(*keys), F.lit(SLOTS)).alias("_slot")
    return rows.withColumn("_slot", slot).join(F.broadcast(ids.select(slot).distinct()), "_slot", "left_anti" if anti else "left_semi").drop("_slot")


def text_mark() -> Column:
    """A hash of the text, which tells rows of one doc_id, or of none, apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def without(rows: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """The rows whose keys, nulls among them, are not in the staged table gone; only rows that may be are shuffled."""
    some = narrowed(rows, gone, *keys)
    on = [some[k].eqNullSafe(gone[k]) for k in keys]
    return narrowed(rows, gone, *keys, anti=True).unionByName(some.join(gone, on, "left_anti"))
