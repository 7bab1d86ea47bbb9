"""The tool-cohort machine as a prefix scan: sessions of any size use all tasks.

Lines are dealt by ranges of (source, line_no), so a session may lie in many tasks.  A task runs the machine from the empty state and sums up what
its lines do to whatever state comes before them; that summary holds the tools of three messages at most, however many lines
it stands for.  One row a task is folded in order, and what came before a task's first session corrects the rows of that
session's first two messages there, the only ones that can depend on it.  The rows are those of ``attribution.billed_turns``, which
takes one window over each session instead.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenledger.sources.staging import stage

NAMES = T.ArrayType(T.StringType())


def _distinct(*lists: list[str]) -> list[str]:
    return list(dict.fromkeys(x for some in lists for x in some))


class Stretch:
    """The machine over a stretch of one session's lines, from the empty state, and what it must know to go on from another state."""

    def __init__(self) -> None:
        self.reset, self.groups, self.first_id, self.first = False, 0, None, []
        self.cohort, self.current, self.message, self.open = [], [], None, False

    def take(self, kind: str, message: str | None, tools: list[str]) -> None:
        if kind == "H":
            self.reset, self.cohort, self.current, self.message, self.open = True, [], [], None, False
            return
        if not (self.open and message is not None and message == self.message):
            self.cohort, self.current, self.message, self.open = self.current if self.open else [], [], message, True
            if not self.reset:
                self.groups += 1
                if self.groups == 1:
                    self.first_id = message
        self.current = _distinct(self.current, tools)
        if not self.reset and self.groups == 1:
            self.first = self.current

    def place(self) -> int:
        """1 or 2 in the first two messages of a stretch without a reset so far, else 0."""
        return self.groups if not self.reset and self.groups <= 2 else 0

    def joins(self, before: Stretch) -> bool:
        return bool(before.open and self.first_id is not None and self.first_id == before.message)

    def after(self, before: Stretch) -> Stretch:
        """The stretch before and this one as one."""
        if self.reset:
            return self._with(before, True)
        if not self.groups:
            return before
        out = self._with(before, before.reset)
        carried = before.current if self.joins(before) else []
        if self.groups == 1:
            out.current = _distinct(carried, self.first)
            out.cohort = before.cohort if self.joins(before) else before.current
        elif self.groups == 2:
            out.cohort = _distinct(carried, self.first)
        return out

    def _with(self, before: Stretch, reset: bool) -> Stretch:
        out = Stretch()
        out.__dict__ |= self.__dict__ | {"reset": reset}
        return out


def _local(columns: list[str], schema: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, head, source, now, seen, first_id, groups = TaskContext.get().partitionId(), None, None, Stretch(), False, None, 0
        for b in batches:
            kinds, sources, ids, tools = (b[c].to_pylist() for c in ("kind", "source", "message_id", "tools"))
            at, running, prior, place = [], [], [], []
            for i, (kind, owner, message, names) in enumerate(zip(kinds, sources, ids, tools, strict=True)):
                if not seen or owner != source:
                    if seen and source == head:
                        first_id, groups = now.first_id, now.groups
                    head, source, now, seen = (owner if not seen else head), owner, Stretch(), True
                now.take(kind, message, names or [])
                if kind == "B":
                    at.append(i)
                    running.append(now.current)
                    prior.append(now.cohort)
                    place.append(now.place() if source == head else 0)
            if at:
                rows = b.take(pa.array(at))
                n = len(at)
                yield pa.RecordBatch.from_arrays([*(rows[c] for c in columns), pa.array(running, pa.list_(pa.string())), pa.array(prior, pa.list_(pa.string())), pa.array(np.full(n, part), pa.int32()), pa.array(place, pa.int32()), pa.nulls(n, pa.string())], names=[f.name for f in schema])
        if seen:
            if source == head:
                first_id, groups = now.first_id, now.groups
            edge = json.dumps({"head": head, "head_id": first_id, "source": source, "state": now.__dict__})
            empty = [pa.nulls(1, f.type) for f in b.select(columns).schema] + [pa.nulls(1, pa.list_(pa.string()))] * 2
            yield pa.RecordBatch.from_arrays([*empty, pa.array([part], pa.int32()), pa.array([0], pa.int32()), pa.array([edge])], names=[f.name for f in schema])

    return run


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each task's edge: whether its first message goes on from the tasks before, and the tools of the two messages that these end with."""
    rows = pd.concat([pd.DataFrame({"_part": [], "_edge": []}), *batches]).sort_values("_part")
    source, before, out = None, Stretch(), []
    for part, edge in zip(rows["_part"], rows["_edge"], strict=True):
        e: dict[str, Any] = json.loads(edge)
        own = Stretch()
        own.__dict__ |= e["state"]
        known = before if out and source == e["head"] else Stretch()
        joins = known.open and e["head_id"] is not None and e["head_id"] == known.message
        out.append((part, bool(joins), known.cohort, known.current))
        before = own.after(known) if e["head"] == e["source"] else own
        source = e["source"]
    yield pd.DataFrame(out, columns=["_part", "_joins", "_cohort", "_current"])


def cohort_turns(lines: DataFrame) -> DataFrame:
    """The usage records of lines (source, line_no, kind, message_id, tools, ...): B lines with tools, those of the message so far, and
    prior_tools, those of the message before.  line_no is distinct within a source."""
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [c for c in lines.columns if c not in ("kind", "tools")]
    schema = T.StructType([*(T.StructField(c, lines.schema[c].dataType) for c in columns), T.StructField("tools", NAMES), T.StructField("prior_tools", NAMES), T.StructField("_part", T.IntegerType()), T.StructField("_place", T.IntegerType()), T.StructField("_edge", T.StringType())])
    rows = lines.where(F.col("kind").isin("B", "T", "H")).repartitionByRange(n, "source", "line_no").sortWithinPartitions("source", "line_no")
    made = stage(rows.mapInArrow(_local(columns, schema), schema), "cohorts")
    edges = made.where("_edge is not null").select("_part", "_edge").coalesce(1)  # a row a task
    before = edges.mapInPandas(_fold, "_part int, _joins boolean, _cohort array<string>, _current array<string>")
    carried = F.when(F.col("_joins"), F.col("_current")).otherwise(F.array().cast(NAMES))
    first, second = F.col("_place") == 1, F.col("_place") == 2
    tools = F.when(first, F.array_distinct(F.concat(carried, "tools"))).otherwise(F.col("tools"))
    prior = F.when(first, F.when(F.col("_joins"), F.col("_cohort")).otherwise(F.col("_current"))).when(second, F.array_distinct(F.concat(carried, "prior_tools"))).otherwise(F.col("prior_tools"))
    fixed = made.where("_edge is null").join(F.broadcast(before), "_part").withColumns({"tools": tools, "prior_tools": prior})
    return fixed.drop("_part", "_place", "_edge", "_joins", "_cohort", "_current")
