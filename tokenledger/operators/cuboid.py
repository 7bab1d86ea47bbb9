"""Reports from a base cuboid: additive daily cells, and the few keys that no cell can hold.

Keep-last runs inside a report's window, so what counts of a key hangs on the window, unless all its rows are of one day.  Such keys, and rows
without one, are deduplicated once and summed by (day, model, project, source).  Of the others, ``crossing`` holds the last row of each day.
A window is then the sum of the cells of its whole days, and keep-last over the crossing rows of those days and the turns of the
days that a bound cuts, two at most: windows between midnights read no turns at all.  Many windows are asked at once: a row carries
the windows that hold it as bits, and counts in those that hold no later row of its key, so it is shuffled and sorted once and not once a window.

Undated rows have a day of their own, ``<unknown-date>``, which only windows without bounds hold.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenledger.functions.scalars import UNKNOWN_DATE
from tokenledger.operators.dedup import has_key, load_order
from tokenledger.operators.report import DOLLARS, TOKENS, bucket, keyed

CELL = ("day", "model_key", "project_key", "source")
SUMS = ("requests", *TOKENS, "total", *DOLLARS, "unpriced_tokens")
#: What of a turn a cell or the choice of the last row hangs on.
TURN = ("message_id", "request_id", "origin", "modified", "load_seq", "ts", "priced", "usage", "total", *DOLLARS, *CELL)
#: Accuracy of the stored sketches: their size, and the share of ranks by which a quantile may be off (in 99 of 100 cases).
SKETCH_K, RANK_ERROR = 400, 0.0133
#: Windows whose bits one number holds.
BITS = 62


def _turns(priced: DataFrame) -> DataFrame:
    rows = keyed(priced)
    return rows.select(*[c for c in TURN if c in rows.columns])


def cells_of(turns: DataFrame, *more: str, keys: Sequence[str] = CELL) -> DataFrame:
    """Cells of turns that are deduplicated already; costs holds a mergeable sketch of the priced turns' dollars."""
    cost = F.when(F.col("priced"), F.col("usd").cast("double"))
    return turns.groupBy(*more, *keys).agg(*bucket(), F.kll_sketch_agg_double(cost, SKETCH_K).alias("costs"))


def build(priced: DataFrame, hold: Callable[[str, DataFrame], DataFrame] = lambda name, rows: rows) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, crossing, turns) of priced turns that are not deduplicated.  One shuffle by key; store turns partitioned by day.

    hold: stores what is read more than once and reads it again: turns, and last, the last rows of each key and day."""
    turns = hold("turns", _turns(priced))
    key = Window.partitionBy("message_id", "request_id")
    last = key.partitionBy("message_id", "request_id", "day").orderBy(*[c.desc() for c in load_order(turns)])
    one = turns.where(has_key()).withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    one = hold("last", one.withColumn("_crosses", F.min("day").over(key) != F.max("day").over(key)))
    kept = one.where("not _crosses").drop("_crosses").unionByName(turns.where(~has_key()))
    return cells_of(kept), one.where("_crosses").drop("_crosses"), turns


def _whole(day: Column, since: Column, until: Column) -> Column:
    """Whether a window holds a day from its first to its last moment; a null bound is none."""
    start = F.try_to_timestamp(day)
    bounded = (since.isNull() | (start >= since)) & (until.isNull() | (start + F.expr("interval 1 day") <= until))
    return F.when(since.isNull() & until.isNull(), True).otherwise(F.coalesce((day != UNKNOWN_DATE) & bounded, F.lit(False)))


def _numbered(windows: DataFrame) -> DataFrame:
    """windows with the part and the bit that stand for each."""
    n = F.row_number().over(Window.orderBy("w", "since", "until")) - 1
    return windows.select("w", "since", "until", F.floor(n / BITS).cast("int").alias("part"), (n % BITS).cast("int").alias("bit"))


def _won(rows: DataFrame) -> DataFrame:
    """Keyed rows (held: bits of windows) with won, the windows in which they are the last of their key; rows that are it in none go."""
    later = Window.partitionBy("message_id", "request_id", "part").orderBy(*[c.desc() for c in load_order(rows)]).rowsBetween(Window.unboundedPreceding, -1)
    taken = F.coalesce(F.bit_or("held").over(later), F.lit(0).cast("long"))
    return rows.withColumn("won", F.col("held").bitwiseAND(F.bitwise_not(taken))).where("won <> 0")


def windows_of(cells: DataFrame, crossing: DataFrame, turns: DataFrame, windows: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """The cells (w, *keys, sums, costs) of each of some windows (w, since, until: half-open, a null bound is none), as if the turns of each were deduplicated by themselves.

    A cell may stand in several rows, which ``rolled`` adds.  keys: those of CELL that are wanted; the fewer, the sooner rows are summed."""
    since, until, ts = F.col("since"), F.col("until"), F.col("ts")
    few = F.broadcast(_numbered(windows))  # given by the caller, a row a report
    whole = _whole(F.col("day"), since, until)
    columns = ("w", *keys, *SUMS, "costs")
    by_day = cells if set(keys) == set(CELL) else rolled(cells, *dict.fromkeys(("day", *keys)))
    inside = by_day.join(few, whole).select(*columns)
    # Days that a bound cuts; a list of their names lets the scan leave out all others.
    cut = windows.select(F.explode(F.array("since", "until")).alias("at")).where("at is not null and date_trunc('day', at) <> at")
    days = [r["day"] for r in cut.select(F.date_format("at", "yyyy-MM-dd").alias("day")).distinct().collect()]
    held = (since.isNull() | (ts >= since)) & (until.isNull() | (ts < until))
    bit = F.expr("shiftleft(1L, bit)")
    by_day = crossing.select("day").distinct().join(few, whole).groupBy("day", "part").agg(F.bit_or(bit).alias("held"))  # a row a calendar day
    edges = turns.where(F.col("day").isin(days)).join(few, held & ~whole).withColumn("held", bit).drop("w", "since", "until", "bit")
    keyed = crossing.join(F.broadcast(by_day), "day").unionByName(edges.where(has_key()), allowMissingColumns=True)
    again = _won(keyed).drop("held").unionByName(edges.where(~has_key()).withColumnRenamed("held", "won"), allowMissingColumns=True)
    summed = cells_of(again, "part", "won", keys=keys).join(few, "part").where(F.col("won").bitwiseAND(bit) != 0)
    return inside.unionByName(summed.select(*columns))


def rolled(cells: DataFrame, *keys: str) -> DataFrame:
    """Cells summed by keys, with costs merged."""
    return cells.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS], F.kll_merge_agg_double("costs").alias("costs"))


def cost_quantiles(rows: DataFrame) -> DataFrame:
    """rows of merged costs with turns, p50 and p90, whose ranks are within RANK_ERROR of those."""
    n = F.kll_sketch_get_n_double("costs")
    at = lambda p: F.when(n > 0, F.kll_sketch_get_quantile_double("costs", F.lit(p)))
    return rows.withColumns({"turns": n, "p50": at(0.5), "p90": at(0.9)})
