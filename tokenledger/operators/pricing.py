"""Rate card, effective-dated lookup, class pricing and counterfactuals."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.functions.scalars import canonical_model

RATE = "decimal(18,12)"
USD = "decimal(38,12)"
#: Multiples of the input rate: 5-minute write, 1-hour write, read.  Fixed values.
WRITE_5M, WRITE_1H, READ = Decimal("1.25"), Decimal("2"), Decimal("0.1")
CLASSES = ("input", "write", "write_1h", "write_5m", "read", "output")


def rate_card(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """rows: (model, input, output, valid_from, valid_to, is_list), USD per token; null bounds are open.

    Rates of all classes are stored per token, so pricing multiplies and never divides decimals."""
    schema = f"model string, input_rate {RATE}, output_rate {RATE}, valid_from timestamp, valid_to timestamp, is_list boolean"
    return with_class_rates(spark.createDataFrame([(m, Decimal(str(i)), Decimal(str(o)), a, b, is_list) for m, i, o, a, b, is_list in rows], schema))


def with_class_rates(card: DataFrame) -> DataFrame:
    times = lambda x: (F.col("input_rate") * F.lit(x)).cast(RATE)
    return card.withColumns({"write_1h_rate": times(WRITE_1H), "write_5m_rate": times(WRITE_5M), "read_rate": times(READ)})


def aliases(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "alias string, target string")


def scaled(card: DataFrame, factor: int) -> DataFrame:
    return card.withColumns({c: (F.col(c) * factor).cast(RATE) for c in card.columns if c.endswith("_rate")})


def with_rates(df: DataFrame, card: DataFrame, alias: DataFrame, model: str = "model", ts: str | None = "ts") -> DataFrame:
    """Left join of the rate in effect.  Both dimensions are tables of a few rows a model; the
    optimiser broadcasts them by their size.  Without a time the list price counts."""
    a = alias.select(F.col("alias").alias("_alias"), F.col("target").alias("_target"))
    named = df.withColumn("_id", canonical_model(F.col(model)))
    named = named.join(a, named["_id"] == a["_alias"], "left").withColumn("_model", F.coalesce("_target", "_id"))
    r = card.withColumnRenamed("model", "_rated")
    on = F.col("_model") == F.col("_rated")
    if ts is None:
        on = on & F.col("is_list")
    else:
        at = F.col(ts)
        inside = (F.col("valid_from").isNull() | (at >= F.col("valid_from"))) & (F.col("valid_to").isNull() | (at < F.col("valid_to")))
        on = on & F.when(at.isNull(), F.col("is_list")).otherwise(inside)
    return named.join(r, on, "left").drop("_id", "_alias", "_target", "_rated", "valid_from", "valid_to", "is_list").withColumnRenamed("_model", "rated_model")


def unclassified(usage: Column) -> Column:
    return F.greatest(F.lit(0), usage["cache_create"] - usage["cache_create_1h"] - usage["cache_create_5m"])


def class_dollars(usage: Column) -> dict[str, Column]:
    """USD columns by class from usage and the joined rates; the 1h and 5m parts break the write down."""
    n = lambda c: c.cast("decimal(18,0)")
    five = usage["cache_create_5m"] + unclassified(usage)
    rate = F.col
    zero = F.lit(0).cast(USD)
    cost = {
        "input": n(usage["input"]) * rate("input_rate"),
        "write": n(usage["cache_create_1h"]) * rate("write_1h_rate") + n(five) * rate("write_5m_rate"),
        "write_1h": n(usage["cache_create_1h"]) * rate("write_1h_rate"),
        "write_5m": n(usage["cache_create_5m"]) * rate("write_5m_rate"),
        "read": n(usage["cache_read"]) * rate("read_rate"),
        "output": n(usage["output"]) * rate("output_rate"),
    }
    return {f"usd_{k}": F.coalesce(v.cast(USD), zero) for k, v in cost.items()}


def price(turns: DataFrame, card: DataFrame, alias: DataFrame, ts: str | None = "ts") -> DataFrame:
    """turns with priced, total, usd and the class dollars; an unpriced turn costs 0 and says so."""
    t = with_rates(turns, card, alias, ts=ts)
    u = F.col("usage")
    t = t.withColumns(class_dollars(u)).withColumn("priced", F.col("input_rate").isNotNull())
    t = t.withColumn("usd", F.col("usd_input") + F.col("usd_write") + F.col("usd_read") + F.col("usd_output"))
    t = t.withColumn("total", u["input"] + u["cache_create"] + u["cache_read"] + u["output"])
    return t.drop("input_rate", "output_rate", "write_1h_rate", "write_5m_rate", "read_rate")


def cheaper_sibling(card: DataFrame, ladder: DataFrame, classes: str) -> DataFrame:
    """(model, sibling, input_rate, sibling_rate): the ladder's next model of a model's class, if its list input rate is lower."""
    listed = card.where("is_list").select("model", "input_rate")
    classed = listed.withColumn("class", F.regexp_extract("model", f"({classes})", 1))
    target = listed.select(F.col("model").alias("sibling"), F.col("input_rate").alias("sibling_rate"))
    return classed.join(ladder, "class").join(target, "sibling").where("sibling_rate < input_rate").select("model", "sibling", "input_rate", "sibling_rate")


def model_what_if(by_model: DataFrame, siblings: DataFrame, card: DataFrame, alias: DataFrame) -> DataFrame:
    """(model, sibling, usd, repriced_usd, saved_usd): a model's summed usage at its sibling's list price, where that saves."""
    rows = by_model.join(siblings.select("model", "sibling"), "model")
    usage = F.struct(*[F.col(c) for c in ("input", "cache_create", "cache_create_1h", "cache_create_5m", "cache_read", "output")])
    again = price(rows.select("model", "sibling", F.col("usd").alias("was"), usage.alias("usage")).withColumnRenamed("model", "from_model").withColumn("model", F.col("sibling")), card, alias, ts=None)
    return again.where("priced").select(F.col("from_model").alias("model"), "sibling", F.col("was").alias("usd"), F.col("usd").alias("repriced_usd"), (F.col("was") - F.col("usd")).alias("saved_usd")).where("saved_usd > 0")
