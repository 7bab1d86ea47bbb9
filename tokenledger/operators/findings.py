"""Savings findings: rules over the aggregates, each a DataFrame of at most one row, ranked by savings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenledger.functions.scalars import half_up, ratio
from tokenledger.operators.pricing import WRITE_1H, WRITE_5M
from tokenledger.params import Params

ORDER = {"model-concentration": 1, "output-cost": 2, "cache-ttl": 3, "cache-efficiency": 3, "session-outlier": 4, "context-bloat": 5, "mcp-follow-on-cost": 6, "bash-output-filter": 7, "spend-acceleration": 8}


def _row(df: DataFrame, kind: str, severity: Column, savings: Column | None, subject: Column) -> DataFrame:
    saved = F.lit(None).cast("double") if savings is None else savings.cast("double")
    return df.select(F.lit(kind).alias("kind"), severity.alias("severity"), saved.alias("savings_usd"), subject.cast("string").alias("subject"))


def _first(df: DataFrame, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(1)


def model_concentration(models: DataFrame, total: DataFrame, what_if: DataFrame, p: Params) -> DataFrame:
    top = _first(models, F.col("usd").desc(), F.col("total").desc(), "model").select("model", F.col("usd").alias("top_usd"))
    row = top.crossJoin(total.select(F.col("usd").alias("all_usd"))).join(what_if.select("model", "saved_usd"), "model", "left")
    hit = row.where((F.col("all_usd") > 0) & (ratio(F.col("top_usd"), F.col("all_usd")) >= p.model_share))
    return _row(hit, "model-concentration", F.lit("high"), F.col("saved_usd"), F.col("model"))


def output_cost(total: DataFrame, p: Params) -> DataFrame:
    return _row(total.where(ratio(F.col("usd_output"), F.col("usd")) >= p.output_share), "output-cost", F.lit("medium"), None, F.lit(None))


def cache(total: DataFrame, p: Params) -> DataFrame:
    """cache-ttl where the 1-hour premium is real money, else cache-efficiency where it may be said."""
    c = F.col
    ttl = (c("usd_write_1h") >= p.cache_1h_usd) & (c("usd_write") > 0) & (c("usd_write_1h").cast("double") / c("usd_write").cast("double") >= p.cache_1h_share)
    spend = ratio(c("usd_write"), c("usd"))
    read = ratio(c("cache_read"), c("input") + c("cache_create") + c("cache_read"))
    t = total.withColumns({"ttl": F.coalesce(ttl, F.lit(False)), "spend": spend, "read": read})
    first = _row(t.where("ttl"), "cache-ttl", F.when(c("spend") > p.cache_write_share, "medium").otherwise("info"), c("usd_write_1h").cast("double") * float(1 - WRITE_5M / WRITE_1H), F.lit(None))
    quiet = t.where(~c("ttl") & c("read").isNotNull() & (c("spend").isNull() | (c("spend") >= p.cache_write_share)))
    return first.unionByName(_row(quiet, "cache-efficiency", F.when(c("read") >= p.cache_read_share, "info").otherwise("medium"), None, F.lit(None)))


def bloated(top_sessions: DataFrame, p: Params) -> DataFrame:
    return _first(top_sessions.where((F.col("avg_prompt_tokens") >= p.context_tokens) & (F.col("usd") >= p.context_usd)), F.col("usd").desc(), F.col("total").desc(), "source")


def context_bloat(top_sessions: DataFrame, total: DataFrame, p: Params) -> DataFrame:
    row = bloated(top_sessions, p).crossJoin(total.select(F.col("usd").alias("all_usd")))
    share = F.coalesce(ratio(F.col("usd"), F.col("all_usd")), F.lit(0.0))
    saved = F.greatest(F.lit(0.0), F.col("usd_read").cast("double") * (1 - p.context_tokens / F.col("avg_prompt_tokens")))
    return _row(row, "context-bloat", F.when(share >= p.context_high_share, "high").otherwise("medium"), saved, F.col("source"))


def session_outlier(top_sessions: DataFrame, p: Params) -> DataFrame:
    first = _first(top_sessions, F.col("usd").desc(), F.col("total").desc(), "source").where(F.col("usd") >= p.session_usd)
    return _row(first.join(bloated(top_sessions, p).select("source"), "source", "left_anti"), "session-outlier", F.lit("medium"), None, F.col("source"))


def _tools_order():
    return F.round("usd", 6).desc(), F.round("total", 6).desc(), F.col("calls").desc(), "tool"


def mcp_cost(top_tools: DataFrame, total: DataFrame, p: Params) -> DataFrame:
    first = _first(top_tools.where(F.col("tool").startswith("mcp__")), *_tools_order()).where(F.col("usd") >= p.mcp_usd)
    row = first.crossJoin(total.select(F.col("usd").cast("double").alias("all_usd")))
    return _row(row, "mcp-follow-on-cost", F.when(F.col("usd") / F.col("all_usd") >= p.mcp_high_share, "high").otherwise("medium"), None, F.col("tool"))


def bash_filter(top_tools: DataFrame, models: DataFrame, ledger_totals: DataFrame, card: DataFrame, p: Params) -> DataFrame:
    """Saved tokens of the reduction ledger at the dominant model's cache-write list rate."""
    hit = top_tools.where((F.col("tool") == "Bash") & (F.col("usd") >= p.bash_usd))
    top = _first(models, F.col("usd").desc(), F.col("total").desc(), "model").select("model")
    rate = top.join(card.where("is_list").select("model", "write_5m_rate"), "model", "left").select("write_5m_rate")
    row = hit.crossJoin(rate).join(ledger_totals.where("saved_chars > 0 and saved_tokens > 0").select("saved_tokens"), how="left")
    return _row(row, "bash-output-filter", F.lit("medium"), F.col("saved_tokens") * F.col("write_5m_rate"), F.col("tool"))


def acceleration(trend: DataFrame, p: Params) -> DataFrame:
    return _row(trend.where((F.col("delta_pct") >= p.acceleration_pct) & (F.col("current_usd") >= p.acceleration_usd)), "spend-acceleration", F.lit("medium"), None, F.lit(None))


def ledger_totals(ledger: DataFrame, since=None) -> DataFrame:
    """(events, raw_chars, sent_chars, saved_chars, saved_tokens); only the lower bound counts, and with it undated rows go."""
    if since is not None:
        ledger = ledger.where(F.col("ts") >= F.lit(since))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = ledger.agg(F.count("*").alias("events"), zero("raw_chars").alias("raw_chars"), zero("sent_chars").alias("sent_chars"))
    saved = F.greatest(F.lit(0), F.col("raw_chars") - F.col("sent_chars"))
    return out.withColumn("saved_chars", saved).withColumn("saved_tokens", half_up(F.col("saved_chars") / 4))


def ranked(parts: list[DataFrame]) -> DataFrame:
    """All findings with rank and the total of what is quantified.  A handful of rows by construction."""
    rows = reduce(DataFrame.unionByName, parts)
    order = F.create_map(*[F.lit(x) for kv in ORDER.items() for x in kv])[F.col("kind")]
    severity = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    w = Window.orderBy(F.col("savings_usd").desc_nulls_last(), severity, order)
    everything = Window.partitionBy(F.lit(0))
    return rows.withColumns({"rank": F.row_number().over(w), "total_savings_usd": F.coalesce(F.sum("savings_usd").over(everything), F.lit(0.0))})
