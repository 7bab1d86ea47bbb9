"""Tool cohorts: which tools were called just before each billed turn, and what the turn then cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenledger.functions.scalars import ratio
from tokenledger.operators.report import TOKENS

BY_LINE = lambda *keys: Window.partitionBy(*keys).orderBy("line_no")


def cohort_segments(lines: DataFrame) -> DataFrame:
    """B and T lines with seg (ended by each H line) and grp (message groups within it).  All from one sort of the source's lines: groups are
    numbered through the source, and the number of a segment's first is taken off."""
    by_line = BY_LINE("source")
    seg = lines.withColumn("seg", F.sum(F.when(F.col("kind") == "H", 1).otherwise(0)).over(by_line))
    bt = seg.where(F.col("kind").isin("B", "T"))
    starts = ~F.lag("seg").over(by_line).eqNullSafe(F.col("seg"))
    new = starts | F.col("message_id").isNull() | ~F.lag("message_id").over(by_line).eqNullSafe(F.col("message_id"))
    told = bt.withColumns({"_starts": starts, "_new": F.when(new, 1).otherwise(0)}).withColumn("_all", F.sum("_new").over(by_line))
    first = F.max(F.when(F.col("_starts"), F.col("_all"))).over(by_line)
    return told.withColumn("grp", F.col("_all") - first + 1).drop("_starts", "_new", "_all")


def message_tools(grouped: DataFrame) -> DataFrame:
    """Adds running_tools: those of the message up to and with the line."""
    so_far = F.collect_list("tools").over(BY_LINE("source", "seg", "grp").rowsBetween(Window.unboundedPreceding, 0))
    return grouped.withColumn("running_tools", F.array_distinct(F.flatten(so_far)))


def prior_tools(grouped: DataFrame) -> DataFrame:
    """Adds prior_tools: all tools of the message group before, in the same segment.  One window over
    the message's groups would need nested frames, so each group's tools are carried by its first line."""
    whole = F.collect_list("tools").over(Window.partitionBy("source", "seg", "grp"))
    with_all = grouped.withColumn("_all", F.array_distinct(F.flatten(whole)))
    first = Window.partitionBy("source", "seg").orderBy("grp").rangeBetween(-1, -1)
    return with_all.withColumn("prior_tools", F.coalesce(F.max("_all").over(first), F.array().cast("array<string>"))).drop("_all")


def billed_turns(lines: DataFrame) -> DataFrame:
    """The usage records of lines: B lines with tools and prior_tools."""
    g = prior_tools(message_tools(cohort_segments(lines)))
    return g.where("kind = 'B'").withColumn("tools", F.col("running_tools")).drop("running_tools", "seg", "grp", "kind")


def tool_costs(priced: DataFrame) -> DataFrame:
    """One row a tool: calls, and the split cost of the turns that followed it."""
    calls = priced.select(F.explode(F.array_distinct("tools")).alias("tool")).groupBy("tool").agg(F.count("*").alias("calls"))
    n = F.size(F.array_distinct("prior_tools"))
    each = priced.where(F.size("prior_tools") > 0).withColumn("_n", n).withColumn("tool", F.explode(F.array_distinct("prior_tools")))
    share = lambda c: (c.cast("double") / F.col("_n"))
    u = F.col("usage")
    solo = (F.col("_n") == 1) & F.col("priced")
    after = each.groupBy("tool").agg(
        F.count("*").alias("follow_on_requests"),
        F.sum(share(F.col("total"))).alias("total"),
        F.sum(share(F.col("usd"))).alias("usd"),
        F.sum(share(F.col("usd_output"))).alias("output_usd"),
        F.sum(share(F.when(~F.col("priced"), F.col("total")).otherwise(0))).alias("unpriced_tokens"),
        *[F.sum(share(u[c])).alias(c) for c in TOKENS],
        F.sum(F.when(solo, F.col("usd")).otherwise(0)).cast("double").alias("solo_usd"),
        F.sum(F.when(solo, 1).otherwise(0)).alias("solo_follow_on_requests"),
    )
    joined = calls.join(after, "tool", "full_outer")
    return joined.na.fill(0)


def tool_economics(tools: DataFrame) -> DataFrame:
    return tools.withColumns({"usd_per_call": ratio(F.col("usd"), F.col("calls")), "solo_share": ratio(F.col("solo_usd"), F.col("usd"))})


def top_tools(tools: DataFrame, limit: int, prefix: str | None = None) -> DataFrame:
    if prefix:
        tools = tools.where(F.col("tool").startswith(prefix))
    return tools.orderBy(F.round("usd", 6).desc(), F.round("total", 6).desc(), F.col("calls").desc(), "tool").limit(limit)

