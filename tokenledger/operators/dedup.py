"""Window filter and keep-last deduplication."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_window(df: DataFrame, since: datetime | None, until: datetime | None, ts: str = "ts") -> DataFrame:
    """Half-open [since, until); with any bound, undated rows go."""
    if since is not None:
        df = df.where(F.col(ts) >= F.lit(since))
    if until is not None:
        df = df.where(F.col(ts) < F.lit(until))
    return df


def has_key() -> Column:
    filled = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    return filled("message_id") & filled("request_id")


def load_order(df: DataFrame) -> list[Column]:
    """Retired records first, then file by file: by when it was modified, if df has it, then by source; of a file its records, then its
    uncommitted tail.  So a record of a later file comes after the tail of an earlier one."""
    first = F.when(F.col("origin") == "retired", 0).otherwise(1)
    return [first, *([F.col("modified")] if "modified" in df.columns else []), F.col("source"), F.col("origin") == "tail", F.col("load_seq")]


#: Of stored records: their key as one value, by which they are clustered; those without a key have values of their own.
STORED_KEY = "dedup_key"


def stored_key() -> Column:
    ids = F.concat(F.lit("k"), F.length("message_id").cast("string"), F.lit(":"), F.col("message_id"), F.col("request_id"))
    return F.when(has_key(), ids).otherwise(F.concat(F.lit("r"), F.coalesce("source", F.lit("")), F.lit(":"), F.coalesce(F.col("load_seq").cast("string"), F.lit(""))))


def keep_last(df: DataFrame, *within: str) -> DataFrame:
    """The last row by load order for each (message_id, request_id), and every row that lacks an id.

    df is made once.  Rows without ids need no comparison: they are dealt out by where they come from, so they cannot pile up on a null key.
    Records that are stored by STORED_KEY (``logs.write_clustered``) are in place already and not shuffled at all.
    """
    if STORED_KEY in df.columns:
        last = Window.partitionBy(STORED_KEY, *within).orderBy(*[c.desc() for c in load_order(df)])
        return df.withColumn("_k", F.row_number().over(last)).where((F.col("_k") == 1) | ~has_key()).drop("_k", STORED_KEY)
    dealt = df.withColumn("_dealt", F.when(~has_key(), F.xxhash64("source", "load_seq")))
    last = Window.partitionBy("message_id", "request_id", "_dealt", *within).orderBy(*[c.desc() for c in load_order(df)])
    return dealt.withColumn("_k", F.row_number().over(last)).where((F.col("_k") == 1) | ~has_key()).drop("_k", "_dealt")


def diagnostics(df: DataFrame) -> DataFrame:
    """(records, duplicates_dropped, missing_ids)"""
    keys = df.groupBy(F.when(has_key(), F.col("message_id")).alias("m"), F.when(has_key(), F.col("request_id")).alias("r"), has_key().alias("keyed")).agg(F.count("*").alias("n"))
    return keys.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("records"),
        F.coalesce(F.sum(F.when(F.col("keyed"), F.col("n") - 1)), F.lit(0)).alias("duplicates_dropped"),
        F.coalesce(F.sum(F.when(~F.col("keyed"), F.col("n"))), F.lit(0)).alias("missing_ids"),
    )
