"""Serving tables of the dashboard: bounded lists made from the report operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenledger.operators.lifecycle import LABEL_ID

DAYS, TOP, DRIVERS = 60, 12, 3


def daily(days: DataFrame) -> DataFrame:
    """The last dated days, ascending."""
    return days.where("day <> '<unknown-date>'").orderBy(F.col("day").desc()).limit(DAYS).orderBy("day")


def savings(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count("*").alias("findings"), F.count("savings_usd").alias("quantified"), F.coalesce(F.sum("savings_usd"), F.lit(0.0)).alias("savings_usd"))


def top_lists(models: DataFrame, tools: DataFrame, sessions: DataFrame, projects: DataFrame, labels: DataFrame) -> DataFrame:
    """(list, name, label, usd, total): the dearest TOP of each kind; a session carries its project's label, a project its own."""
    none = F.lit(None).cast("string")
    money = lambda c: F.col(c).cast("double").alias(c)
    named = labels.select(F.col("id").alias("project"), "label")

    def part(df: DataFrame, kind: str, key: str, label) -> DataFrame:
        return df.orderBy(F.round("usd", 6).desc(), F.round("total", 6).desc(), key).limit(TOP).select(F.lit(kind).alias("list"), F.col(key).alias("name"), label.alias("label"), money("usd"), money("total"))

    return (
        part(models, "models", "model", none).unionByName(part(tools, "tools", "tool", none))
        .unionByName(part(sessions.join(named, "project", "left"), "sessions", "source", F.col("label")))
        .unionByName(part(projects.join(named, "project", "left"), "projects", "project", F.col("label")))
    )


def changed(models: DataFrame, projects: DataFrame, labels: DataFrame) -> DataFrame:
    """(list, name, delta_usd): the DRIVERS of each kind whose dollars moved most; projects by label or the first 6 characters of the id."""
    first = lambda df, key: df.orderBy(F.abs("delta_usd").desc(), key).limit(DRIVERS)
    named = first(projects, "project").join(labels.select(F.col("id").alias("project"), "label"), "project", "left")
    short = F.when(F.col("project").rlike(LABEL_ID), F.substring("project", 1, 6)).otherwise(F.col("project"))
    return first(models, "model").select(F.lit("models").alias("list"), F.col("model").alias("name"), "delta_usd").unionByName(
        named.select(F.lit("projects").alias("list"), F.coalesce("label", short).alias("name"), "delta_usd"))


def write(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
