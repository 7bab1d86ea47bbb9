"""Running sums within keys of any size: rows are dealt by ranges, so one key may lie in many tasks.

A task sums what it has; what the tasks before hold of its first key comes from one row each, which is added afterwards.
No key is gathered in one task, as a window over it would be.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenledger.sources.staging import stage

Values = Mapping[str, Column | str]


def _columns(values: Values) -> dict[str, Column]:
    return {k: (F.col(v) if isinstance(v, str) else v).cast("long") for k, v in values.items()}


def same_key(keys: Sequence[str]) -> Column:
    """One number for a row's keys, nulls among them."""
    return F.xxhash64(*[c for k in keys for c in (F.col(k).isNull(), F.col(k))]) if keys else F.lit(0).cast("long")


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], sums: Values | None = None, xors: Values | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """df (its columns ``keep``, by default all) with inclusive running sums, and exclusive-ors, of whole numbers within keys by order.

    order must tell the rows of a key apart, or their order among each other is any.  Null values count as 0, null keys are a key."""
    spark = df.sparkSession
    sums, xors = _columns(sums or {}), _columns(xors or {})
    kept = [c for c in (keep or df.columns) if c not in {*sums, *xors}]
    values = {f"_{k}": F.coalesce(v, F.lit(0).cast("long")) for k, v in {**sums, **xors}.items()}
    by = [*map(F.col, keys), *(F.col(c) if isinstance(c, str) else c for c in order)]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumns({**values, "_key": same_key(keys)}).repartitionByRange(n, *by).sortWithinPartitions(*by).select(*kept, *values, "_key")
    added = ["_key", "_part", "_head", "_first", "_tail"]
    types = [T.LongType(), T.IntegerType(), T.BooleanType(), T.BooleanType(), T.BooleanType()]
    schema = T.StructType([*(rows.schema[c] for c in kept), *(T.StructField(c, T.LongType()) for c in [*sums, *xors]), *map(T.StructField, added, types)])
    ops = [np.add] * len(sums) + [np.bitwise_xor] * len(xors)
    undo = [np.subtract] * len(sums) + [np.bitwise_xor] * len(xors)
    names = [*sums, *xors]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, head, carry, held = TaskContext.get().partitionId(), None, True, [0] * len(names), None
        for b in batches:
            if not len(b):
                continue
            key = np.asarray(b["_key"])
            new = np.r_[last is not None and key[0] != last, key[1:] != key[:-1]]
            first = np.zeros(len(b), bool)
            first[0] = last is None
            in_head = head & (np.cumsum(new) == 0)
            start = np.maximum.accumulate(np.where(new, np.arange(len(b)), -1))  # of the row's key in this batch; -1: before it
            out = []
            for i, name in enumerate(names):
                value = np.asarray(b[f"_{name}"])
                total = ops[i].accumulate(value)
                before = np.where(start > 0, total[np.maximum(start - 1, 0)], 0)
                got = np.where(start >= 0, undo[i](total, before), ops[i](total, carry[i]))
                out.append(pa.array(got, pa.int64()))
                carry[i] = got[-1]
            last, head = key[-1], bool(in_head[-1])
            if held is not None:
                yield held
            held = pa.RecordBatch.from_arrays([*(b[c] for c in kept), *out, b["_key"], pa.array(np.full(len(b), part), pa.int32()), pa.array(in_head), pa.array(first), pa.array(np.zeros(len(b), bool))], names=[f.name for f in schema])
        if held is not None:
            tail = pa.array(np.arange(len(held)) == len(held) - 1)
            yield held.set_column(held.schema.get_field_index("_tail"), "_tail", pc.and_(tail, pa.scalar(True)))

    made = stage(rows.mapInArrow(local, schema), "scan")
    # At most two rows a task: what it begins with, and what it holds of its last key.
    edges = made.where("_first").select("_key", "_part", F.lit(0).alias("_kind"), *(F.lit(0).cast("long").alias(c) for c in names)).unionByName(
        made.where("_tail").select("_key", "_part", F.lit(1).alias("_kind"), *names))
    before = Window.partitionBy("_key").orderBy("_part", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    so_far = [F.sum(c).over(before).alias(f"_{c}") for c in sums] + [F.bit_xor(c).over(before).alias(f"_{c}") for c in xors]
    offsets = edges.select("_part", "_kind", *so_far).where("_kind = 0").drop("_kind")
    whole = {c: F.when(F.col("_head"), F.col(c) + F.col(f"_{c}")).otherwise(F.col(c)) for c in sums}
    whole |= {c: F.when(F.col("_head"), F.col(c).bitwiseXOR(F.col(f"_{c}"))).otherwise(F.col(c)) for c in xors}
    out = made.join(F.broadcast(offsets), "_part").withColumns(whole).select(*kept, *names)
    out._staged_at = made._staged_at
    return out
