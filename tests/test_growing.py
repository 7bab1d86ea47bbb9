"""The source of growing files: what is planned, what is read, and a stream over several runs."""

import os
import random

import pyarrow as pa

from tokenledger.streaming.growing import GrowingLogs, GrowingReader, lines_between


def reader(tmp_path, **options):
    return GrowingReader({"path": str(tmp_path / "logs"), "state": str(tmp_path / "state"), **options})


def write(tmp_path, name, text, mode="a"):
    (tmp_path / "logs/p").mkdir(parents=True, exist_ok=True)
    with open(tmp_path / "logs/p" / name, mode) as f:
        f.write(text)


def step(r, before):
    """(offset, planned ranges, rows read) of one batch."""
    after = r.latestOffset()
    parts = r.partitions(before, after)
    rows = [tuple(x.values()) for p in parts for b in r.read(p) for x in b.to_pylist()]
    return after, [(os.path.basename(x.path), x.start, x.end) for p in parts for x in p.ranges], [(os.path.basename(x[0]), *x[1:]) for x in rows]


def test_only_new_bytes_are_read(tmp_path):
    r = reader(tmp_path)
    at, parts, rows = step(r, r.initialOffset())
    assert (parts, rows) == ([], [])
    write(tmp_path, "a.jsonl", "one\ntwo\nhal")
    write(tmp_path, "skip.txt", "other\n")
    at, parts, rows = step(r, at)
    assert parts == [("a.jsonl", 0, 8)] and [x[2:4] for x in rows] == [(0, "one"), (4, "two")]
    assert step(r, at)[1:] == ([], [])
    write(tmp_path, "a.jsonl", "f")  # still no line break
    at, parts, rows = step(r, at)
    assert (parts, rows) == ([], [])
    write(tmp_path, "a.jsonl", " line\n\nend\n")
    write(tmp_path, "b.jsonl", "b\n")
    r = reader(tmp_path)  # a restart
    at, parts, rows = step(r, at)
    assert parts == [("a.jsonl", 8, 23), ("b.jsonl", 0, 2)] and [x[3] for x in rows] == ["half line", "", "end", "b"]
    write(tmp_path, "a.jsonl", "anew\n", "w")  # shorter: written anew
    os.remove(tmp_path / "logs/p/b.jsonl")
    at, parts, rows = step(r, at)
    assert rows == [("a.jsonl", 1, 0, "anew", True)] and len(r.load(at)) == 1
    r.commit(at)
    assert len(os.listdir(tmp_path / "state")) == 2


def test_tails_are_told_until_they_are_whole(tmp_path):
    r = reader(tmp_path, tails="true")
    write(tmp_path, "a.jsonl", "one\nhal")
    at, _, rows = step(r, r.initialOffset())
    assert [x[2:] for x in rows] == [(0, "one", True), (4, "hal", False)]
    write(tmp_path, "a.jsonl", "f\n")
    assert [x[2:] for x in step(r, at)[2]] == [(4, "half", True)]


def test_ranges_cut_nowhere(tmp_path):
    rng = random.Random(3)
    lines = ["x" * rng.choice([0, 1, 5, 40, 300]) + rng.choice(["", "é"]) for _ in range(60)] + ["y" * 200_000, "z"]
    raw = "".join(x + "\n" for x in lines).encode()
    for size in (1, 3, 17, 1000, 70_000, 10**6):
        step_ = range(0, len(raw), size) if size > 3 else range(0, 900, size)
        end = len(raw) if size > 3 else raw[:900].rfind(b"\n") + 1
        got = [x for a in step_ if a < end for x in lines_between(pa.BufferReader(raw), a, min(a + size, end), 0)]
        want, at = [], 0
        for x in raw[:end].split(b"\n")[:-1]:
            want.append((at, x))
            at += len(x) + 1
        assert got == want, size


def test_a_stream_over_three_runs(spark, tmp_path):
    spark.dataSource.register(GrowingLogs)
    (tmp_path / "logs").mkdir()

    def run():
        df = spark.readStream.format("growing_logs").option("path", f"file://{tmp_path}/logs").option("state", f"file://{tmp_path}/state").option("range_bytes", "7").load()
        df.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
        return [(r.line_no, r.value) for r in spark.read.parquet(f"{tmp_path}/out").orderBy("line_no").collect()]

    write(tmp_path, "a.jsonl", "first line\nsecond li")
    assert run() == [(0, "first line")]
    write(tmp_path, "a.jsonl", "ne\nthird")
    assert run() == run() == [(0, "first line"), (11, "second line")]


def test_lines_of_many_small_files_are_told_together(tmp_path):
    for i in range(40):
        write(tmp_path, f"{i:02}.jsonl", f"{i}\nx\n")
    r = reader(tmp_path)
    parts = r.partitions(r.initialOffset(), r.latestOffset())
    batches = [b for p in parts for b in r.read(p)]
    assert len(parts) == len(batches) == 1 and batches[0].num_rows == 80
    r = reader(tmp_path, range_bytes=str(10 << 16))  # opening counts: not all files in one task
    assert len(r.partitions(r.initialOffset(), r.latestOffset())) == 5
