"""Equal-window trends, drivers of change and comparisons."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenledger.functions.scalars import ratio
from tokenledger.operators.dedup import keep_last

#: Fixed value: what a snapshot may be called.
SNAPSHOT_NAME = r"[a-z0-9][a-z0-9._-]{0,63}"


def periods(df: DataFrame, as_of: datetime, days: int) -> DataFrame:
    """Rows of the last days complete UTC days (current), those before (previous) and today so far (today).

    Duplicates are dropped inside each period."""
    end = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    start, before = end - timedelta(days=days), end - timedelta(days=2 * days)
    ts, at = F.col("ts"), F.lit
    within = lambda a, b: (ts >= at(a)) & (ts < at(b))
    period = F.when(within(start, end), "current").when(within(before, start), "previous").when(within(end, as_of), "today")
    return keep_last(df.withColumn("period", period).where("period is not null"), "period")


def _sum(which: str, column: str = "usd") -> Column:
    return F.coalesce(F.sum(F.when(F.col("period") == which, F.col(column))), F.lit(0))


def totals(priced: DataFrame, days: int) -> DataFrame:
    row = priced.agg(_sum("current").alias("current_usd"), _sum("previous").alias("previous_usd"))
    delta = F.col("current_usd") - F.col("previous_usd")
    return row.withColumns({"days": F.lit(days), "delta_usd": delta, "delta_pct": ratio(delta, F.col("previous_usd"))})


def today(priced: DataFrame) -> DataFrame:
    return priced.where("period = 'today'").agg(F.count("*").alias("requests"), F.coalesce(F.sum("usd"), F.lit(0)).alias("usd"))


def drivers(priced: DataFrame, key: str, limit: int, top: int | None = None) -> DataFrame:
    """(key, delta_usd): largest changes first.  top keeps what ranks so high in either period."""
    sums = priced.where("period <> 'today'").groupBy(key, "period").agg(F.sum("usd").alias("usd"), F.sum("total").alias("total"))
    if top:
        rank = Window.partitionBy("period").orderBy(F.col("usd").desc(), F.col("total").desc(), key)
        sums = sums.withColumn("k", F.row_number().over(rank)).where(F.col("k") <= top)
    delta = sums.groupBy(key).agg((_sum("current") - _sum("previous")).alias("delta_usd"))
    return delta.where("delta_usd <> 0").orderBy(F.abs("delta_usd").desc(), key).limit(limit)


def half_window(days: DataFrame, keep: int = 60) -> DataFrame:
    """(days, recent_usd, prior_usd, change) over the last dated days; change is null without four days or prior spend."""
    last = days.where("day <> '<unknown-date>'").orderBy(F.col("day").desc()).limit(keep)
    numbered = last.withColumn("k", F.row_number().over(Window.orderBy(F.col("day").desc())))  # at most keep rows
    half = F.floor(F.col("n") / 2)
    n = last.agg(F.count("*").alias("n"))
    row = numbered.crossJoin(n).agg(
        F.max("n").alias("days"), F.coalesce(F.sum(F.when(F.col("k") <= half, F.col("usd"))), F.lit(0)).alias("recent_usd"),
        F.coalesce(F.sum(F.when((F.col("k") > half) & (F.col("k") <= 2 * half), F.col("usd"))), F.lit(0)).alias("prior_usd"))
    grew = ratio(F.col("recent_usd") - F.col("prior_usd"), F.col("prior_usd"))
    return row.withColumn("change", F.when((F.col("days") >= 4) & (F.col("prior_usd") > 0), grew))


def compare(left: DataFrame, right: DataFrame, key: str = "model") -> DataFrame:
    """Key-wise comparison of two aggregates (key, usd), largest change first."""
    both = left.select(key, F.col("usd").alias("left_usd")).join(right.select(key, F.col("usd").alias("right_usd")), key, "full_outer")
    both = both.withColumns({"left_usd": F.coalesce("left_usd", F.lit(0)), "right_usd": F.coalesce("right_usd", F.lit(0))})
    return both.withColumn("delta_usd", F.col("right_usd") - F.col("left_usd")).orderBy(F.abs(F.col("delta_usd")).desc(), key)


def compare_totals(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row for two snapshots (pricing, usd by model): their totals, the change, its share of the left one, and whether they were priced alike."""
    side = lambda df, name: df.agg(F.coalesce(F.sum("usd"), F.lit(0)).alias(f"{name}_usd"), F.max("pricing").alias(f"{name}_pricing"))
    row = side(left, "left").crossJoin(side(right, "right"))  # of one row each
    delta = F.col("right_usd") - F.col("left_usd")
    return row.select("left_usd", "right_usd", delta.alias("delta_usd"), ratio(delta, F.col("left_usd")).alias("delta_pct"), (~F.col("left_pricing").eqNullSafe(F.col("right_pricing"))).alias("pricing_mismatch"))


def snapshot(by_model: DataFrame, name: str, pricing_version: int) -> DataFrame:
    """Rows of one snapshot for the append-only table: name, pricing, model, usd, total, requests."""
    if not re.fullmatch(SNAPSHOT_NAME, name, re.I):
        raise ValueError(f"bad snapshot name {name!r}")
    return by_model.select(F.lit(name).alias("name"), F.lit(pricing_version).alias("pricing"), "model", "usd", "total", "requests")
