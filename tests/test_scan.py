"""Scans over ranges of rows against windows and plain Python: running sums, tool cohorts, line numbers."""

import itertools
import operator
import random

import pytest
from pyspark.sql import functions as F

from tokenledger.operators.attribution import billed_turns
from tokenledger.operators.cohorts import Stretch, cohort_turns
from tokenledger.operators.scan import running
from tokenledger.sources import logs


def test_running_sums_within_keys(spark):
    rng = random.Random(1)
    rows = [("hot", i, rng.randrange(-50, 50), rng.randrange(2**40)) for i in range(5000)]
    rows += [(rng.choice("abcdefg"), 10_000 + i, rng.randrange(9), rng.randrange(2**40)) for i in range(300)] + [(None, 1, 5, 6), (None, 2, None, 6)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, at long, v long, x long")
    want = {}
    for k, own in itertools.groupby(sorted(rows, key=lambda r: (r[0] or "", r[1])), key=lambda r: r[0]):
        own = list(own)
        sums, xors = itertools.accumulate(r[2] or 0 for r in own), itertools.accumulate((r[3] for r in own), operator.xor)
        want |= {(k, r[1]): (s, x) for r, s, x in zip(own, sums, xors, strict=True)}
    got = running(df, ["k"], ["at"], sums={"s": "v"}, xors={"h": "x"}).collect()
    assert {(r.k, r.at): (r.s, r.h) for r in got} == want and len(got) == len(rows)
    assert got[0].asDict().keys() == {"k", "at", "v", "x", "s", "h"}
    one = running(df, [], ["at", "k"], sums={"n": F.lit(1)}, keep=["at"])
    assert sorted(r.n for r in one.collect()) == list(range(1, len(rows) + 1))
    assert running(df.limit(0), ["k"], ["at"], sums={"s": "v"}).count() == 0
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")  # a key over many batches of one row
    try:
        assert {(r.k, r.at): (r.s, r.h) for r in running(df, ["k"], ["at"], sums={"s": "v"}, xors={"h": "x"}).collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def lines_of(rng, sessions):
    out = []
    for source, n in sessions:
        for i in range(n):
            kind = rng.choices(["B", "T", "R", "H", None], [5, 4, 1, rng.choice([0, 0.05, 1]), 0.3])[0]
            tools = rng.sample(["Bash", "Read", "Edit", "mcp__x__y"], rng.randrange(3)) if kind in ("B", "T") else []
            out.append((source, i, kind, rng.choice(["m1", "m2", None, "m1"]) if rng.random() < 0.5 else f"m{i // 3}", tools, i * 10))
    return out


LINE = "source string, line_no long, kind string, message_id string, tools array<string>, extra int"


@pytest.mark.parametrize("seed", range(3))
def test_cohorts_equal_the_windows(spark, seed):
    rng = random.Random(seed)
    rows = lines_of(rng, [("long", 700), *((f"s{i}", rng.choice([0, 1, 2, 3, 9, 40])) for i in range(25)), ("zz", 200)])
    df = spark.createDataFrame(rows, LINE)
    columns = ["source", "line_no", "message_id", "tools", "prior_tools", "extra"]
    text = lambda d: sorted(str(tuple(r)) for r in d.select(columns).collect())
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for tasks in ("3", "60"):  # few and many lines a task, down to sessions of which each task has some lines only
            spark.conf.set("spark.sql.shuffle.partitions", tasks)
            assert text(cohort_turns(df)) == text(billed_turns(df))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_one_session_uses_all_tasks(spark):
    df = spark.range(40_000).select(F.lit("one").alias("source"), F.col("id").alias("line_no"), F.lit("B").alias("kind"), (F.col("id") / 2).cast("long").cast("string").alias("message_id"), F.array(F.lit("Bash")).alias("tools"))
    got = cohort_turns(df)
    assert got.where("line_no > 1 and prior_tools[0] = 'Bash'").count() == 39_998
    by_task = df.repartitionByRange(4, "source", "line_no").groupBy(F.spark_partition_id()).count().collect()
    assert len(by_task) == 4 and max(r["count"] for r in by_task) < 15_000
    assert cohort_turns(df.limit(0)).count() == 0


def test_stretches_compose():
    """Cutting a session's lines anywhere changes nothing."""
    rng = random.Random(4)
    for _ in range(300):
        rows = [r for r in lines_of(rng, [("s", rng.randrange(1, 14))]) if r[2] in ("B", "T", "H")]
        whole = Stretch()
        for r in rows:
            whole.take(r[2], r[3], r[4])
        cuts = sorted(rng.sample(range(len(rows) + 1), min(len(rows), 2)))
        state = Stretch()
        for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
            part = Stretch()
            for r in rows[a:b]:
                part.take(r[2], r[3], r[4])
            state = part.after(state)
        assert [state.cohort, state.current, state.message, state.open] == [whole.cohort, whole.current, whole.message, whole.open]


def test_line_numbers_of_a_file_in_many_splits(spark, tmp_path):
    rng, root = random.Random(2), tmp_path / "p"
    root.mkdir()
    texts = {"a": [rng.choice(["", "x" * rng.randrange(90), "é" * 9, "  ", "y\r"]) for _ in range(3000)], "b": ["one"], "c": [], "d": ["", "x", ""]}
    for name, lines in texts.items():
        (root / f"{name}.jsonl").write_bytes(("\n".join(lines) + ("\n" if name in "ad" else "")).encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("4k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = logs.ordered_lines(logs.read_lines(spark, str(tmp_path)))
            found = {n: [(r.line_no, r.value, r.complete) for r in sorted(got.where(F.col("file_path").endswith(f"{n}.jsonl")).collect(), key=lambda r: r.line_no)] for n in texts}
            for n, lines in texts.items():
                some = [x.removesuffix("\r") for x in lines if x.removesuffix("\r").strip(" ")]
                assert found[n] == [(i + 1, x, not (n == "b" and i == len(some) - 1)) for i, x in enumerate(some)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
