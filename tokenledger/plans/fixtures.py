"""Usage lines, turns and dimensions derived from the given tables, for the registered queries."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tokenledger.operators.attribution import billed_turns
from tokenledger.operators.pricing import aliases, rate_card, scaled

CHANGE = datetime(2024, 1, 16, tzinfo=UTC)
RATES = [
    ("fx-large-1", "0.000005", "0.000025", None, None, True),
    ("fx-medium-1", "0.000002", "0.000010", None, CHANGE, False),
    ("fx-medium-1", "0.000003", "0.000015", CHANGE, None, True),
    ("fx-small-1", "0.000001", "0.000005", None, None, True),
]
CLASSES = "large|medium|small"
MODELS = ("us.anthropic.fx-large-1-20250101-v1:0", "fx-large-1[1m]", "fx-medium-1", "fx-small-1", "fx-preview")
SECRET = "fixture-secret"


def card(spark: SparkSession, factor: int = 1) -> DataFrame:
    c = rate_card(spark, RATES)
    return scaled(c, factor) if factor != 1 else c


def alias(spark: SparkSession) -> DataFrame:
    return aliases(spark, [("large", "fx-large-1"), ("medium", "fx-medium-1"), ("small", "fx-small-1")])


def ladder(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("large", "fx-medium-1"), ("medium", "fx-small-1")], "class string, sibling string")


def _id(prefix: str, *parts):
    return F.substring(F.sha2(F.concat(F.lit(f"fixture:{prefix}:"), *parts), 256), 1, 12)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One usage line an event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    week = F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd")
    user = F.col("user_id").cast("string")
    e = e.withColumns({"k": F.get_json_object("props", "$.k").cast("bigint"), "source": _id("s", user, F.lit(":"), week), "project": _id("p", (F.col("user_id") % 12).cast("string"))})
    e = e.withColumn("line_no", F.row_number().over(Window.partitionBy("source").orderBy("ts", "event_id")).cast("bigint"))
    k, kind = F.col("k"), F.col("event_type")
    half = F.floor(F.col("line_no") / 2).cast("string")
    names = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    count = lambda x: x.cast("bigint")
    return e.select(
        "event_id", "source", "project", "line_no", F.col("line_no").alias("load_seq"), F.lit("live").alias("origin"), "ts",
        F.when(kind == "signup", "H").when(kind == "error", "R").when((kind == "purchase") & (k % 4 == 0), "T").otherwise("B").alias("kind"),
        F.when(k != 0, F.concat("source", F.lit("-m"), half)).alias("message_id"),
        F.when(k != 0, F.concat("source", F.lit("-r"), half)).alias("request_id"),
        F.when((kind == "click") & (k % 3 == 0), names("Bash", "Read")).when(kind == "click", names("Bash")).when(kind == "purchase", names("mcp__issues__search")).otherwise(names()).alias("tools"),
        F.element_at(F.array(*map(F.lit, MODELS)), (F.col("event_id") % 5 + 1).cast("int")).alias("model"),
        F.struct(count(F.floor(F.col("value") * 100)).alias("input"), (k * 500).alias("cache_create"), (k * 300).alias("cache_create_1h"), (k * 100).alias("cache_create_5m"),
                 (k * 4000).alias("cache_read"), count(F.floor(F.col("value") * 60)).alias("output")).alias("usage"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return billed_turns(lines(spark, sf_dir))


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON log lines (source, project, line_no, value) of the usage lines; every 97th event's line is broken off."""
    x = lines(spark, sf_dir)
    u = lambda c: F.col("usage")[c].cast("string")
    quote = lambda c: F.coalesce(F.concat(F.lit('"'), c, F.lit('"')), F.lit("null"))
    block = F.transform("tools", lambda t: F.concat(F.lit('{"type":"tool_use","id":"t","name":"'), t, F.lit(f'","input":{{"q":"{SECRET}"}}}}')))
    content = F.concat(F.lit(f'[{{"type":"text","text":"{SECRET}"}}'), F.when(F.size("tools") > 0, F.concat(F.lit(","), F.array_join(block, ","))).otherwise(""), F.lit("]"))
    usage = F.concat(
        F.lit(',"usage":{"input_tokens":'), u("input"), F.lit(',"cache_creation_input_tokens":'), u("cache_create"), F.lit(',"cache_read_input_tokens":'), u("cache_read"),
        F.lit(',"output_tokens":'), u("output"), F.lit(',"cache_creation":{"ephemeral_1h_input_tokens":'), u("cache_create_1h"), F.lit(',"ephemeral_5m_input_tokens":'), u("cache_create_5m"), F.lit("}}"))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    said = F.concat(F.lit('{"type":"assistant","requestId":'), quote(F.col("request_id")), F.lit(',"timestamp":"'), stamp, F.lit('","message":{"id":'), quote(F.col("message_id")), F.lit(',"model":'), quote(F.col("model")), F.lit(',"content":'), content,
                    F.when(F.col("kind") == "B", usage).otherwise(""), F.lit("}}"))
    user = lambda inner: F.concat(F.lit('{"toolUseResult":{"type":"assistant","usage":{"input_tokens":9}},"type":"user","message":{"role":"user","content":'), F.lit(inner), F.lit("}}"))
    value = (
        F.when(F.col("event_id") % 97 == 0, F.substring(said, 1, 40)).when(F.col("kind").isin("B", "T"), said)
        .when(F.col("kind") == "R", user(f'[{{"type":"tool_result","content":"{SECRET}"}}]')).otherwise(user(f'"{SECRET}"')))
    return x.select("source", "project", "line_no", value.alias("value"))


def labels(spark: SparkSession) -> DataFrame:
    ids = spark.range(5).select(F.when(F.col("id") < 4, _id("p", F.col("id").cast("string"))).otherwise(F.lit("0123456789ab")).alias("id"), F.concat(F.lit(" team "), F.col("id").cast("string"), F.lit(" ")).alias("label"))
    bad = spark.createDataFrame([("not-an-id", "x"), ("aaaaaaaaaaaa", "   ")], "id string, label string")
    return ids.unionByName(bad).withColumn("updated", F.lit(CHANGE))


def manifest(x: DataFrame) -> DataFrame:
    return x.groupBy("source").agg(F.max("ts").alias("modified"), F.count("*").alias("size"))
