"""Connected components of a link table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenledger.llm.common import stage, unstage


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in links (a, b): the smallest id reachable.

    Each round gives an id the least label among itself and its neighbours, then the label of that
    label; labels live in staged tables, nothing comes to the driver but one boolean a round.  Null
    ends and self-links are ignored, repeated links count once, no links give no rows.
    """
    links = links.where("a is not null and b is not null and a <> b").select("a", "b")
    both = stage(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stage(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "id"), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("label"))
            .select(F.col("a").alias("id"), "label").unionByName(labels)
            .groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("was"))
        )
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("far"))
        new = stage(near.join(jump, "label", "left").select("id", F.least("label", F.coalesce("far", "label")).alias("label"), "was"), "labels")
        settled = new.where("label <> was").isEmpty()
        unstage(labels)
        labels = new.select("id", "label")
        labels._staged_at = new._staged_at
        if settled:
            unstage(both)
            return labels.select("id", F.col("label").alias("component"))
