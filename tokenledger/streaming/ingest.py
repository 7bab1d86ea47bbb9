"""Incremental ingest with Structured Streaming: new log chunks only, cohort state carried along.

Chunks are immutable JSON-lines files of (source, project, line_no, value).  A run takes what is new
(``availableNow``), and a checkpoint remembers what was taken, so increments add up to one pass.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tokenledger.functions.scalars import day_key
from tokenledger.operators.dedup import has_key, keep_last
from tokenledger.operators.ingest import parse
from tokenledger.sources.staging import stage, unstage
from tokenledger.sources.versioned import Change, Version, VersionedTable

CHUNK = "source string, project string, line_no bigint, value string"
STATE = "cohort array<string>, current array<string>, message string, has_message boolean"
TURN = "source string, line_no bigint, tools array<string>, prior_tools array<string>"
#: What a record's price and day hang on, and what tells it apart.
SPENT = ("source", "load_seq", "message_id", "request_id", "model", "ts", "usage")
DOLLARS = "decimal(38,12)"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(CHUNK).json(path)


class Cohorts(StatefulProcessor):
    """Per source: tools of the message before, tools of the open message, and its id."""

    def __init__(self, idle: timedelta | None = None):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("cohort", STATE, int(self.idle.total_seconds() * 1000) if self.idle else None)

    def handleInputRows(self, key, rows: Iterator[Row], timer_values) -> Iterator[Row]:
        """Rows, not frames: most sessions bring a few lines, and a frame each would cost far more than they do."""
        was = self.state.get() or ([], [], None, False)
        cohort, current, message, open_ = list(was[0] or []), list(was[1] or []), was[2], was[3]
        for line in sorted(rows, key=lambda r: r.line_no):
            if line.kind == "H":
                cohort, current, message, open_ = [], [], None, False
            elif line.kind in ("B", "T"):
                if not (open_ and line.message_id is not None and line.message_id == message):
                    cohort, current, message, open_ = current if open_ else [], [], line.message_id, True
                current = list(dict.fromkeys([*current, *line.tools]))
                if line.kind == "B":
                    yield Row(source=key[0], line_no=line.line_no, tools=current, prior_tools=cohort)
        self.state.update((cohort, current, message, open_))

    def close(self) -> None:
        pass


def stream_cohorts(chunks: DataFrame, idle: timedelta | None = None) -> DataFrame:
    """(source, line_no, tools, prior_tools) of billed lines; state lives in the state store.

    idle: a session of which nothing has come for so long leaves the store with the next batch; if it returns, its first message has no tools before it, as
    after a new prompt.  The time is that of arrival: times in the lines themselves, which may come late or not at all, end no state and lose no line.
    Run it with one_batch.  Without idle, state stays for good."""
    lines = parse(chunks).where(F.col("kind").isin("B", "T", "H")).select("source", "line_no", "kind", "message_id", "tools")
    return lines.groupBy("source").transformWithState(statefulProcessor=Cohorts(idle), outputStructType=TURN, outputMode="Append", timeMode="ProcessingTime" if idle else "None")


def states(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The sessions whose state the store holds, with it."""
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "cohort").load()


def run_once(df: DataFrame, out: str, checkpoint: str, mode: str = "append", one_batch: bool = False) -> None:
    """Take what is new and stop; Parquet at out.

    one_batch: all of it in one batch.  Streams whose state ends with time need that: they always ask for another batch, so ``availableNow`` never ends."""
    new = {"once": True} if one_batch else {"availableNow": True}
    df.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(**new).start().awaitTermination()


def upsert(path: str):
    """A foreachBatch function that takes usage records (with modified, that of their source's file) into a table; ``current`` reads it.

    Settled records are added as they are.  Provisional ones (origin tail) lie beside them in a layer of their own, where each increment of a source
    replaces what the source had, with nothing if its last line is settled now.  They meet other sources' records only when the table is read,
    so a record that a tail of another source outranked is back as soon as that tail leaves.  A batch is one version: readers see all of it or
    nothing, and a batch that runs again changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        table = VersionedTable(batch.sparkSession, path)
        if table.latest().batches.get("upsert", -1) >= number:
            return
        new = stage(batch, "increment")
        sources = new.groupBy("source").agg(F.max("modified").alias("modified"))
        tail = F.col("origin") == "tail"
        table.commit([Change("settled", new.where(~tail)), Change("tail", new.where(tail), sources)], ("upsert", number))
        unstage(new)

    return write


def _loaded(table: VersionedTable, version: Version) -> DataFrame | None:
    """All records of a version, each with when its file was last modified then; None before there are any."""
    settled, tail = table.read("settled", version), table.read("tail", version)
    if settled is None or tail is None:
        return None
    return settled.unionByName(tail).drop("modified").join(table.owners("tail", version).drop("_last"), "source")


def current(spark: SparkSession, path: str) -> DataFrame:
    """The records of an upserted table: of each key the last by load order, files ordered by when each was last modified."""
    table = VersionedTable(spark, path)
    return keep_last(_loaded(table, table.latest()))


def changes(spark: SparkSession, path: str, number: int, columns: Sequence[str]) -> DataFrame:
    """(sign, *columns): what batch number has taken from the current records (-1) and brought to them (1).

    A batch can change its sources' records and, as these files are now modified later, which source has the last word on a key; so only the keys of
    its sources are looked at, in the versions before and after it, and what is the same in both is taken off by counting rows with their sign once.
    A row that stays as it is, settled now or not, is no change."""
    table = VersionedTable(spark, path)
    before, after = table.around("upsert", number)
    now = _loaded(table, after)
    was = _loaded(table, before)
    if was is None:  # all there is came with this batch
        return keep_last(now).select(F.lit(1).alias("sign"), *columns)
    touched = table.owners("tail", after).where(F.col("_last") == after.number).select("source")
    key = ["message_id", "request_id"]
    records = [table.read(layer, version) for layer, version in (("settled", after), ("tail", after), ("tail", before))]  # what was settled before is so after
    owned = functools.reduce(DataFrame.unionByName, [x.where(has_key()).select("source", *key) for x in records])
    keys = stage(owned.join(touched, "source", "left_semi").select(key).distinct(), "keys")

    def resolved(rows: DataFrame, sign: int) -> DataFrame:
        keyless = rows.where(~has_key()).join(touched, "source", "left_semi")
        return keep_last(rows.where(has_key()).join(keys, key, "left_semi")).unionByName(keyless).select(F.lit(sign).alias("sign"), *columns)

    net = resolved(was, -1).unionByName(resolved(now, 1)).groupBy(*columns).agg(F.sum("sign").alias("n")).where("n <> 0")
    return net.select(F.explode(F.array_repeat(F.signum("n").cast("int"), F.abs("n").cast("int"))).alias("sign"), *columns)


def upsert_with_spend(path: str, price: Callable[[DataFrame], DataFrame]):
    """A foreachBatch function like upsert that also keeps running sums by day; ``spend_by_day`` reads them.

    price: from usage records to rows with usd.  What a batch changes is added to the sums with its sign, so a record that is corrected, moves to another day or
    loses to another source's leaves its old day; a batch that runs again, or broke off between the two versions, counts once."""
    take = upsert(path)

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        take(batch, number)
        sums = VersionedTable(spark, f"{path}/spend", owner="day")
        if sums.latest().batches.get("spend", -1) >= number:
            return
        changed = changes(spark, path, number, SPENT)
        n = F.col("sign").cast("long")
        rows = price(changed).withColumn("day", day_key(F.col("ts"))).groupBy("day").agg(F.sum(n).alias("requests"), F.sum(F.col("usd") * n).cast(DOLLARS).alias("usd"))
        sums.commit([Change("spend", rows)], ("spend", number))

    return write


def spend_by_day(spark: SparkSession, path: str) -> DataFrame:
    """(day, requests, usd) of the current records."""
    return _by_day(VersionedTable(spark, f"{path}/spend", owner="day").read("spend"))


def _by_day(rows: DataFrame) -> DataFrame:
    return rows.groupBy("day").agg(F.sum("requests").alias("requests"), F.sum("usd").cast(DOLLARS).alias("usd")).where("requests <> 0 or usd <> 0")


def compact(spark: SparkSession, path: str) -> None:
    """Settled records as one segment, of each source and key the last only.  Sources are not compared: which of them is the last may change."""
    table = VersionedTable(spark, path)
    table.compact("settled", lambda rows: keep_last(rows, "source"))
    table.compact("tail")
    VersionedTable(spark, f"{path}/spend", owner="day").compact("spend", _by_day)


def daily_spend(priced: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Live spend by UTC day over a stream of priced turns (ts, usd)."""
    windows = priced.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("requests"), F.sum("usd").alias("usd"))
    return windows.select(day_key(F.col("w.start")).alias("day"), "requests", "usd")
