"""Manifests, retirement, retention and labels."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the shape of a project id.
LABEL_ID = "^[a-fA-F0-9]{12}$"


def all_records(retired: DataFrame, live: DataFrame, tail: DataFrame) -> DataFrame:
    mark = lambda df, name: df.withColumn("origin", F.lit(name))
    return mark(retired, "retired").unionByName(mark(live, "live")).unionByName(mark(tail, "tail"))


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(source, status): reused, appended, parsed or retired; manifests hold source, modified, size."""
    o = old.select("source", F.col("modified").alias("old_modified"), F.col("size").alias("old_size"))
    both = o.join(new.select("source", "modified", "size"), "source", "full_outer")
    same = (F.col("old_size") == F.col("size")) & F.col("old_modified").eqNullSafe(F.col("modified"))
    status = F.when(F.col("size").isNull(), "retired").when(F.col("old_size").isNull(), "parsed").when(same, "reused").when(F.col("size") > F.col("old_size"), "appended").otherwise("parsed")
    return both.select("source", status.alias("status"))


def ingest_stats(diff: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    return diff.agg((F.count("*") - n("retired")).alias("seen"), n("parsed").alias("parsed"), n("appended").alias("appended"), n("reused").alias("reused"), n("retired").alias("retired"))


def retire_sources(live: DataFrame, retired: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(live, retired) after records of vanished sources moved; a source that came back loses its retired copy."""
    here = manifest.select("source")
    gone = live.join(here, "source", "left_anti")
    return live.join(here, "source", "left_semi"), retired.join(here, "source", "left_anti").unionByName(gone)


def prune(retired: DataFrame, as_of: datetime, older_than: timedelta) -> DataFrame:
    """Retired rows young enough to stay; undated ones go."""
    if older_than <= timedelta(0):
        raise ValueError("older_than must be positive")
    return retired.where(F.col("ts") >= F.lit(as_of - older_than))


def prune_counts(retired: DataFrame, as_of: datetime, older_than: timedelta) -> DataFrame:
    old = F.coalesce(F.col("ts") < F.lit(as_of - older_than), F.lit(True))
    by_source = retired.groupBy("source").agg(F.count_if(old).alias("records"), F.count_if(~old).alias("kept"))
    return by_source.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.count_if(F.col("kept") == 0).alias("sources"), F.coalesce(F.sum("kept"), F.lit(0)).alias("kept"))


def rebuild(stored_version: int, version: int, live: DataFrame, retired: DataFrame, snapshots: DataFrame, reparse: Callable[[], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(live, retired, snapshots) for this schema version.

    Stored live rows of another version are computed anew from the logs; retired rows, whose logs are gone, and snapshots, which were
    taken on purpose, stay with the pricing they had.  A source that the new live rows hold loses its retired copy."""
    if stored_version == version:
        return live, retired, snapshots
    fresh = reparse()
    return fresh, retired.join(fresh.select("source").distinct(), "source", "left_anti"), snapshots


def is_stale(manifest: DataFrame, as_of: datetime, after: timedelta = timedelta(hours=1)) -> DataFrame:
    """One row: whether the last ingest is older than after; without a time it is."""
    return manifest.agg(F.coalesce(F.max("ingested_at") < F.lit(as_of - after), F.lit(True)).alias("stale"))


def valid_labels(labels: DataFrame) -> DataFrame:
    """(id, label) of well-formed rows: 12 hex digits, 1 to 80 characters on one line; the latest of an id wins."""
    return labels.where(well_formed()).groupBy("id").agg(F.max_by(trimmed(), F.struct("updated", "label")).alias("label"))


def trimmed() -> Column:
    return F.btrim("label", F.lit(" \t\n\x0b\x0c\r"))


def well_formed() -> Column:
    return F.coalesce(F.col("id").rlike(LABEL_ID) & F.length(trimmed()).between(1, 80) & ~trimmed().rlike("[\r\n]"), F.lit(False))


def labelled_projects(projects: DataFrame, labels: DataFrame, live_names: DataFrame) -> DataFrame:
    """projects (project, ...) with name: the label, else the live folder's name, else the id."""
    named = projects.join(labels.select(F.col("id").alias("project"), "label"), "project", "left").join(live_names.select("project", "folder"), "project", "left")
    return named.withColumn("name", F.coalesce("label", "folder", "project")).drop("label", "folder")


def stale_labels(labels: DataFrame, projects: DataFrame) -> DataFrame:
    return labels.join(projects.select(F.col("project").alias("id")), "id", "left_anti")

