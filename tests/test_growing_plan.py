"""Plans of the source of growing files: what the driver holds of them, and that they tell every line once."""

import json
import os
import pickle
import random
import tracemalloc

from tokenledger.streaming.growing import GrowingReader, merged


def reader(tmp_path, **options):
    return GrowingReader({"path": str(tmp_path / "logs"), "state": str(tmp_path / "state"), **options})


def step(r, before):
    after = r.latestOffset()
    return after, [tuple(x.values()) for p in r.partitions(before, after) for b in r.read(p) for x in b.to_pylist()]


def test_planning_holds_one_folder_and_no_file_in_a_partition(tmp_path):
    for d in range(40):
        (tmp_path / f"logs/p{d}").mkdir(parents=True)
        for i in range(400):
            (tmp_path / f"logs/p{d}/session-{i}.jsonl").write_text("a\nb")
    at = reader(tmp_path).initialOffset()
    reader(tmp_path).partitions(at, at)
    for _ in range(2):  # all are new, then all grew
        r = reader(tmp_path)
        tracemalloc.start()
        after = r.latestOffset()
        parts = r.partitions(at, after)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 4 << 20, peak  # 24,000 files took 10 and 16 MB as rows, 8,000 3.2 and 5.1 MB
        assert len(parts) == 16 and max(len(pickle.dumps(p)) for p in parts) < 1000
        at, rows = after, [x for p in parts for b in r.read(p) for x in b.to_pylist()]
        assert len({(x["file_path"], x["line_no"]) for x in rows}) == len(rows) == 16_000
        for d in range(40):
            for i in range(400):
                with open(tmp_path / f"logs/p{d}/session-{i}.jsonl", "a") as f:
                    f.write("\nc")


def test_every_line_is_told_once_however_files_grow(tmp_path):
    rng = random.Random(7)
    names = ["a.jsonl", "a/x.jsonl", "a/b/x.jsonl", "a.b/x.jsonl", "a-b.jsonl", "é.jsonl", "z.jsonl"]
    for options in ({}, {"range_bytes": "7"}, {"range_bytes": "7", "tails": "true"}, {"range_bytes": "100000"}):
        root = tmp_path / "-".join(["t", *options.values()])
        content, generation, seen = {}, {}, {}
        at = reader(root).initialOffset()
        for turn in range(12):
            for name in rng.sample(names, 4):
                path = root / "logs" / name
                path.parent.mkdir(parents=True, exist_ok=True)
                more = "".join(rng.choice(["", "x", "longer than a range", "é"]) + rng.choice(["\n", ""]) for _ in range(rng.randint(0, 5)))
                was = content.get(name)
                anew = was and rng.random() < 0.2
                content[name] = was[: rng.randrange(len(was))].replace("x", "y") if anew else (was or "") + more
                path.write_text(content[name])
                os.utime(path, (turn, turn))
                # shorter, or a new time with the old size: written anew
                generation[name] = 0 if was is None else generation[name] + (len(content[name]) <= len(was))
            r = reader(root, **options)
            before = r.load(at)
            at, rows = step(r, at)
            now = r.load(at)
            assert list(now) == sorted(now) and len(now) == len(content)
            assert {os.path.relpath(k, root / "logs"): v.generation for k, v in now.items()} == generation
            want = []
            for path, x in now.items():
                whole, was = content[os.path.relpath(path, root / "logs")].encode(), before.get(path)
                if was == x:
                    continue
                same = was and was.generation == x.generation
                done = seen[path] if same else 0
                end = whole.rfind(b"\n") + 1
                while done < end:
                    line = whole[done : whole.index(b"\n", done)]
                    want.append((path, x.generation, done, line.decode(), True))
                    done += len(line) + 1
                if "tails" in options and end < len(whole):
                    want.append((path, x.generation, end, whole[end:].decode(), False))
            assert sorted(rows) == sorted(want)
            seen = {p: content[os.path.relpath(p, root / "logs")].encode().rfind(b"\n") + 1 for p in now}
            r.commit(at)
            assert len(os.listdir(root / "state")) <= 2


def test_a_plan_ends_where_a_file_ended_when_it_was_made(tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/a.jsonl").write_text("one\ntw")
    r = reader(tmp_path)
    start, end = r.initialOffset(), r.latestOffset()
    parts = r.partitions(start, end)
    (tmp_path / "logs/a.jsonl").write_text("one\ntwo\nthree\n")
    told = lambda parts: [x["value"] for p in parts for b in r.read(p) for x in b.to_pylist()]
    assert told(parts) == told(reader(tmp_path).partitions(start, end)) == ["one"]
    assert [x[3] for x in step(r, end)[1]] == ["two", "three"]


def test_states_of_before_and_those_cut_off(tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "state").mkdir()
    was = {}
    for name in "abcd":
        path = tmp_path / f"logs/{name}.jsonl"
        path.write_text("one\ntw")
        was[str(path)] = [4, 6, path.stat().st_mtime_ns, 2]
    (tmp_path / "state/000000000001-x.json").write_text(json.dumps(was))
    (tmp_path / "state/000000000002-y.json.part").write_text('[["cut')
    (tmp_path / "logs/b.jsonl").write_text("one\ntwo\n")
    r = reader(tmp_path)
    assert r.newest() == {"n": 1, "id": "x"}
    at, rows = step(r, r.newest())
    assert [(os.path.basename(x[0]), *x[1:]) for x in rows] == [("b.jsonl", 2, 4, "two", True)]
    r.commit(at)
    assert sorted(x.partition("-")[0] for x in os.listdir(tmp_path / "state")) == ["000000000001", "000000000002"]


def test_merged():
    from collections import namedtuple

    row = namedtuple("row", "path")
    rows = lambda s: iter([row(c) for c in s])
    assert [(x and x.path, y and y.path) for x, y in merged(rows("bcd"), rows("abe"))] == [(None, "a"), ("b", "b"), ("c", None), ("d", None), (None, "e")]
