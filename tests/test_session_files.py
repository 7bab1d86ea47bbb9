"""Session files: tasks write and list them, many share a task, and each line knows its number."""

import os

from pyspark.sql import functions as F

from tokenledger.sources import logs

RAW = "source string, project string, line_no long, value string"


def raw(spark, sessions):
    return spark.createDataFrame([(f"s{i}", f"p{i % 3}", n, f"{i}-{n}") for i in range(sessions) for n in (2, 3, 1, 4)], RAW)


def content(root):
    return {f: open(f"{at}/{f}").read() for at, _, names in os.walk(root) for f in names}


def test_a_file_a_session_whole_or_cut(spark, tmp_path):
    for how, want in (({}, "7-1\n7-2\n7-3\n7-4\n"), ({"half": 2}, "7-1\n7-2\n7-3\n7-"), ({"lines": 2}, "7-1\n7-2\n7"), ({"lines": 9}, "7-1\n7-2\n7-3\n7-4\n")):
        root = str(tmp_path / "-".join(["t", *how]) / str(len(want)))
        assert logs.write_sessions(raw(spark, 30), root, **how) == root
        found = content(root)
        assert len(found) == 30 and found["s7.jsonl"] == want and os.path.exists(f"{root}/p1/s7.jsonl")


def test_many_small_files_share_a_task(spark, tmp_path):
    root = logs.write_sessions(raw(spark, 300), str(tmp_path / "logs"))
    (tmp_path / "logs/_hidden.jsonl").write_text("x\n")
    (tmp_path / "logs/top.jsonl").write_text("\n \r\nlast")
    lines = logs.read_lines(spark, root)
    assert lines.rdd.getNumPartitions() == 4
    got = logs.ordered_lines(lines)
    assert got.where(F.concat(F.regexp_extract("file_path", "s([0-9]+)[.]jsonl$", 1), F.lit("-"), "line_no") == F.col("value")).count() == 1200
    assert [(r.line_no, r.value, r.complete) for r in got.where("file_path like '%top.jsonl'").collect()] == [(1, "last", False)]
    scan = {r.file_path.rpartition("/")[2]: r for r in logs.log_scan(lines, root, "salt").collect()}
    assert len(scan) == 301 and scan["top.jsonl"]["lines"] == 3 and scan["s7.jsonl"].file_size == 16
    assert scan["s7.jsonl"].project == scan["s1.jsonl"].project != scan["s2.jsonl"].project


def test_cohorts_take_rows():
    from pyspark.sql import Row

    from tokenledger.streaming.ingest import Cohorts

    class State:
        held = None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

    machine, line = Cohorts(), lambda n, kind, message, *tools: Row(line_no=n, kind=kind, message_id=message, tools=list(tools))
    machine.state = State()
    run = lambda *rows: [tuple(r) for r in machine.handleInputRows(("s",), iter(rows), None)]
    assert run(line(2, "B", "b", "Read"), line(1, "B", "a", "Bash")) == [("s", 1, ["Bash"], []), ("s", 2, ["Read"], ["Bash"])]
    assert run(line(3, "B", "b", "Read", "Grep"), line(4, "B", None)) == [("s", 3, ["Read", "Grep"], ["Bash"]), ("s", 4, [], ["Read", "Grep"])]
    assert run(line(5, "H", None), line(6, "B", "c")) == [("s", 6, [], [])]


def test_words_of_bytes_are_those_of_the_contract():
    import re

    from tokenledger.llm import minhash

    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    text = "".join(map(chr, [*range(0x300), 0x130, 0x212A, 0x2028, 0x3000, 0xFEFF, 0x1F600])) + " Ab\x0bC\x1cD\x85E\xa0F\r\nÄß İ "
    for t in (text, text[::-1], "", None, " \t\n"):
        assert [w.decode() for w in minhash.words_of(t)] == re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
    assert minhash.KNOWN <= 200_000  # words a task remembers
