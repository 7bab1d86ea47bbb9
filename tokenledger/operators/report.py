"""Aggregates of priced, deduplicated turns: totals by key, shares, distributions and run rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenledger.functions.scalars import UNKNOWN_DATE, day_key, half_up, model_key, project_key, ratio
from tokenledger.sources.staging import stage

TOKENS = ("input", "cache_create", "cache_create_1h", "cache_create_5m", "cache_read", "output")
DOLLARS = ("usd", "usd_input", "usd_write", "usd_write_1h", "usd_write_5m", "usd_read", "usd_output")


def bucket() -> list[Column]:
    zero = lambda c: F.coalesce(c, F.lit(0))
    return [
        F.count("*").alias("requests"),
        *[zero(F.sum(F.col("usage")[c])).alias(c) for c in TOKENS],
        zero(F.sum("total")).alias("total"),
        *[zero(F.sum(c)).alias(c) for c in DOLLARS],
        zero(F.sum(F.when(~F.col("priced"), F.col("total")))).alias("unpriced_tokens"),
    ]


def keyed(priced: DataFrame) -> DataFrame:
    return priced.withColumns({"model_key": model_key(F.col("model")), "project_key": project_key(F.col("project")), "day": day_key(F.col("ts"))})


def total(priced: DataFrame) -> DataFrame:
    return priced.agg(*bucket())


def by_model(priced: DataFrame) -> DataFrame:
    return keyed(priced).groupBy(F.col("model_key").alias("model")).agg(*bucket())


def avg_prompt_tokens() -> Column:
    return half_up((F.col("input") + F.col("cache_create") + F.col("cache_read")) / F.col("requests"))


def by_session(priced: DataFrame) -> DataFrame:
    """Adds the project first seen by load order and the rounded mean prompt."""
    rows = priced.groupBy("source").agg(*bucket(), F.min_by("project", "load_seq").alias("project"))
    return rows.withColumn("avg_prompt_tokens", avg_prompt_tokens())


def by_project(priced: DataFrame) -> DataFrame:
    return keyed(priced).groupBy(F.col("project_key").alias("project")).agg(*bucket())


def by_day(priced: DataFrame) -> DataFrame:
    return keyed(priced).groupBy("day").agg(*bucket())


def cube(priced: DataFrame) -> DataFrame:
    """All five groupings in one pass over the turns."""
    k = keyed(priced)
    sets = [[], [F.col("model_key")], [F.col("source")], [F.col("project_key")], [F.col("day")]]
    g = k.groupingSets(sets, F.col("model_key"), F.col("source"), F.col("project_key"), F.col("day")).agg(F.grouping_id().alias("g"), *bucket())
    level = F.when(F.col("g") == 15, "total").when(F.col("g") == 7, "model").when(F.col("g") == 11, "session").when(F.col("g") == 13, "project").otherwise("day")
    return g.select(level.alias("level"), F.coalesce("model_key", "source", "project_key", "day", F.lit("")).alias("key"), *[c for c in g.columns if c not in ("g", "model_key", "source", "project_key", "day")])


def top(rows: DataFrame, key: str, limit: int) -> DataFrame:
    return rows.orderBy(F.col("usd").desc(), F.col("total").desc(), F.col(key)).limit(limit)


def shares(total_row: DataFrame) -> DataFrame:
    c = F.col
    return total_row.select(
        ratio(c("cache_read"), c("input") + c("cache_create") + c("cache_read")).alias("cache_read_share"),
        ratio(c("usd_output"), c("usd")).alias("output_cost_share"),
        ratio(c("usd_input"), c("usd")).alias("input_share"),
        ratio(c("usd_write"), c("usd")).alias("cache_write_share"),
        ratio(c("usd_read"), c("usd")).alias("cache_read_cost_share"),
        ratio(c("usd_output"), c("usd")).alias("output_share"),
        ratio(c("usd_write_1h"), c("usd_write")).alias("cache_write_1h_share"),
    )


def turn_distribution(priced: DataFrame) -> DataFrame:
    """Mean, and nearest-rank p50 and p90, of priced turns.

    Costs are counted, dealt out by range and numbered from the sums of the ranges before, so no task sees them all."""
    counts = priced.where("priced").groupBy(F.col("usd").cast("double").alias("usd")).agg(F.count("*").alias("n"))
    ranged = stage(counts.repartitionByRange("usd").withColumn("part", F.spark_partition_id()), "costs")
    parts = ranged.groupBy("part").agg(F.sum("n").alias("size"))  # a row for each range
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("part", before.alias("before"), F.sum("size").over(Window.partitionBy(F.lit(0))).alias("turns"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("usd"))
    ranked = ranged.join(offsets, "part").withColumn("upto", upto)
    rank = lambda tenths: F.min(F.when(F.col("upto") * 10 >= F.col("turns") * tenths, F.col("usd")))
    return ranked.agg(F.coalesce(F.max("turns"), F.lit(0)).alias("turns"), (F.sum(F.col("usd") * F.col("n")) / F.sum("n")).alias("mean"), rank(5).alias("p50"), rank(9).alias("p90"))


def run_rate(days: DataFrame, projection_days: int, anomaly_ratio: float) -> DataFrame:
    """Over by_day rows (one a calendar day, so small whatever the turns)."""
    dated = F.col("day") != UNKNOWN_DATE
    row = days.agg(
        F.count_if(dated).alias("days"),
        F.min(F.when(dated, F.col("day"))).alias("first_day"),
        F.max(F.when(dated, F.col("day"))).alias("last_day"),
        F.sum("usd").cast("double").alias("all_usd"),
        F.expr("percentile_disc(0.5) within group (order by case when day <> '<unknown-date>' then cast(usd as double) end)").alias("median_day_usd"),
        F.max(F.when(dated, F.col("usd"))).cast("double").alias("peak_usd"),
        F.max_by(F.when(dated, F.col("day")), F.when(dated, F.struct("usd", (-F.unix_date(F.to_date(F.when(dated, F.col("day"))))).alias("early")))).alias("peak_day"),
    )
    per_day = ratio(F.col("all_usd"), F.col("days"))
    out = row.where("days > 0").withColumns({"usd_per_day": per_day, "projected_usd": per_day * projection_days, "peak_ratio": F.when(F.col("median_day_usd") > 0, F.col("peak_usd") / F.col("median_day_usd"))})
    return out.withColumn("anomaly", F.coalesce(F.col("peak_ratio") >= anomaly_ratio, F.lit(False))).drop("all_usd")
