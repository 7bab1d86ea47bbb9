"""List ranking over a table of links, by contraction with random mates.

In a round each element draws a coin from a hash of its id and the round's number; one of tails whose successor drew heads takes it in.  A
quarter of the elements goes in a round, so all rounds together move about four times the list, twice.  What is left, at most ``small``
elements whatever the input, is walked in one task; then the rounds are undone, the last first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenledger.llm.common import stage, unstage

#: Elements that one task walks.
SMALL = 1 << 15
ROUNDS = 400


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = [b for b in batches if len(b)]
    if not rows:
        return
    all_ = pd.concat(rows)
    follow = {i: (None if pd.isna(n) else int(n), int(w)) for i, n, w in zip(all_.id.tolist(), all_.next.tolist(), all_.w.tolist(), strict=True)}
    inner = {n for n, _ in follow.values()}
    ids, at = [], []
    for head in follow:
        if head not in inner:
            here, place = head, 0
            while here is not None:
                ids.append(here)
                at.append(place)
                here, weight = follow[here]
                place += weight
    yield pd.DataFrame({"id": ids, "pos": at})


def list_ranks(links: DataFrame, small: int = SMALL) -> DataFrame:
    """(id, pos) of each element of links (id, next): how many stand before it in its list.

    ids are distinct and not null, next is null at an end and else the id of another element, which no other names; otherwise it is an
    error or elements are left out.  An empty table gives no rows."""
    none = F.lit(None).cast("long")
    now = stage(links.select(F.col("id").cast("long"), F.col("next").cast("long"), F.lit(1).cast("long").alias("w"), none.alias("gone"), F.lit(0).cast("long").alias("off")), "links")
    levels, number = [], 0

    def heads(c: str, number: int) -> Column:
        return F.xxhash64(c, F.lit(number)).bitwiseAND(F.lit(1)) == 1

    while now.count() > small:
        number += 1
        if number > ROUNDS:
            raise ValueError("the links are no lists")
        taken, into = heads("id", number), F.col("next").isNotNull() & heads("next", number)
        takers = now.where(~taken & into).select(F.col("next").alias("id"), F.col("id").alias("p"), F.col("w").alias("p_w"))
        met = now.where(taken).select("id", "next", "w").join(takers, "id", "left")
        merged = met.select(F.coalesce("p", "id").alias("id"), "next", (F.col("w") + F.coalesce("p_w", F.lit(0))).alias("w"), F.when(F.col("p").isNotNull(), F.col("id")).alias("gone"), F.coalesce("p_w", F.lit(0).cast("long")).alias("off"))
        rest = now.where(~taken & ~into).select("id", "next", "w", none.alias("gone"), F.lit(0).cast("long").alias("off"))
        after = stage(rest.unionByName(merged), "links")
        if not levels:
            unstage(now)
        levels.append(after)
        now = after
    found = stage(now.select("id", "next", "w").coalesce(1).mapInPandas(_walk, "id long, pos long"), "ranks")
    for level in reversed(levels):
        back = level.where("gone is not null").select("id", "gone", "off").join(found, "id").select(F.col("gone").alias("id"), (F.col("pos") + F.col("off")).alias("pos"))
        more = stage(found.unionByName(back), "ranks")
        unstage(found)
        unstage(level)
        found = more
    return found
