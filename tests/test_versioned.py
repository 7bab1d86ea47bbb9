"""The versioned table, the record sink on it, and the two-layer upsert."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tests.test_rules import TURN, T, turn
from tokenledger.operators import dedup, ingest, pricing, report
from tokenledger.plans import fixtures as fx
from tokenledger.sources import logs
from tokenledger.sources.versioned import Change, Conflict, VersionedTable
from tokenledger.streaming.ingest import CHUNK, ROCKSDB, compact, current, run_once, spend_by_day, states, stream_cohorts, upsert, upsert_with_spend


def rec(spark, *rows):
    return spark.createDataFrame(rows, "source string, n bigint") if rows else spark.createDataFrame([], "source string, n bigint")


def held(df):
    return sorted((r.source, r.n) for r in df.collect())


def test_a_source_is_replaced_and_others_stay(spark, tmp_path):
    path = str(tmp_path / "t")
    assert logs.read_records(spark, path) is None
    logs.write_records(rec(spark, ("a", 1), ("b", 1), (None, 1)), path)
    logs.write_records(rec(spark, ("a", 2), ("a", 2)), path)
    assert held(logs.read_records(spark, path).na.fill("-")) == [("-", 1), ("a", 2), ("a", 2), ("b", 1)]
    logs.write_records(rec(spark, (None, 3)), path)
    logs.write_records(rec(spark), path, rec(spark, ("b", 0)))
    assert held(logs.read_records(spark, path).na.fill("-")) == [("-", 3), ("a", 2), ("a", 2)]


def test_a_broken_write_shows_the_old_state(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    table = VersionedTable(spark, path)
    logs.write_records(rec(spark, ("a", 1)), path)
    monkeypatch.setattr(VersionedTable, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        logs.write_records(rec(spark, ("a", 2)), path)
    monkeypatch.undo()
    assert held(table.read("records")) == [("a", 1)] and len(table._names("segments")) == 2
    assert table.vacuum(timedelta(days=1)) == 0 and table.vacuum(timedelta(0)) == 1
    assert held(table.read("records")) == [("a", 1)]


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    one, two = VersionedTable(spark, path), VersionedTable(spark, path)
    put, met = VersionedTable._put_new, []

    def late(self, name, text):  # the other writer takes the number first
        if self is one and not met:
            met.append(name)
            two.commit([Change("records", rec(spark, ("b", 1)), rec(spark, ("b", 0)).select("source"))])
        return put(self, name, text)

    monkeypatch.setattr(VersionedTable, "_put_new", late)
    assert one.commit([Change("records", rec(spark, ("a", 1)), rec(spark, ("a", 0)).select("source"))]).number == 2 and met == ["000000000001.json"]
    assert held(one.read("records")) == [("a", 1), ("b", 1)]


def test_compaction_keeps_what_comes_meanwhile(spark, tmp_path):
    path = str(tmp_path / "t")
    table = VersionedTable(spark, path)
    for n in range(3):
        logs.write_records(rec(spark, ("a", n), (f"b{n}", n)), path)

    def fold(rows):
        logs.write_records(rec(spark, ("a", 9)), path)  # another writer, while this one is at work
        return rows

    table.compact("records", fold)
    want = [("a", 9), ("b0", 0), ("b1", 1), ("b2", 2)]
    assert held(table.read("records")) == want and len(table.latest().segments) == 2
    logs.write_records(rec(spark), path, rec(spark, ("b1", 0)))
    assert held(table.read("records")) == [w for w in want if w[0] != "b1"]
    with pytest.raises(Conflict):
        table.compact("records", lambda rows: (table.compact("records"), rows)[1])
    assert table.vacuum(timedelta(0)) > 0 and held(table.read("records")) == [w for w in want if w[0] != "b1"]


def test_snapshots_are_saved_anew_as_a_whole(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "name string, model string, usd double")
    logs.append_snapshot(rows(("one", "a", 1.0), ("one", "b", 2.0), ("two", "a", 3.0)), str(tmp_path / "s"))
    got = logs.append_snapshot(rows(("one", "c", 4.0)), str(tmp_path / "s"))
    assert sorted(map(tuple, got.collect())) == [("one", "c", 4.0), ("two", "a", 3.0)]


def records(spark, *rows):
    return spark.createDataFrame([(*r, m) for r, m in rows], f"{TURN}, modified bigint")


def winners(spark, path):
    return sorted(((r.message_id, r.source, r.load_seq) for r in current(spark, path).collect()), key=str)


def test_a_tail_that_leaves_gives_back_another_sources_tail(spark, tmp_path):
    """Two sources hold a provisional line of one key; the later file's counts until its next increment has another line there."""
    path = str(tmp_path / "t")
    write = upsert(path)
    write(records(spark, (turn(1, mid="k", source="a", origin="tail"), 1), (turn(5, mid="k", source="b", origin="tail"), 2), (turn(4, mid="x", source="b"), 2)), 0)
    assert winners(spark, path) == [("k", "b", 5), ("x", "b", 4)]
    write(records(spark, (turn(5, mid="other", source="b"), 3)), 1)
    assert winners(spark, path) == [("k", "a", 1), ("other", "b", 5), ("x", "b", 4)]
    write(records(spark, (turn(5, mid="other", source="b"), 3)), 1)  # run again
    assert winners(spark, path) == [("k", "a", 1), ("other", "b", 5), ("x", "b", 4)]
    write(records(spark, (turn(1, mid="k", source="a"), 4), (turn(2, mid="x", source="a", origin="tail"), 4)), 2)
    compact(spark, path)
    assert winners(spark, path) == [("k", "a", 1), ("other", "b", 5), ("x", "a", 2)]  # a is now the file modified last


def test_a_later_files_record_outranks_an_earlier_files_tail(spark, tmp_path):
    rows = [(turn(9, mid="k", source="a", origin="tail"), 1), (turn(1, mid="k", source="b"), 2), (turn(7, mid="k", source="z", origin="retired"), 3)]
    assert [r.source for r in dedup.keep_last(records(spark, *rows)).collect()] == ["b"]
    own = [(turn(9, mid="k", source="a"), 1), (turn(1, mid="k", source="a", origin="tail"), 1)]
    assert [r.origin for r in dedup.keep_last(records(spark, *own)).collect()] == ["tail"]
    upsert(str(tmp_path / "t"))(records(spark, *rows), 0)
    assert winners(spark, str(tmp_path / "t")) == [("k", "b", 1)]


def test_compaction_of_an_upsert_compares_no_sources(spark, tmp_path):
    path = str(tmp_path / "t")
    write = upsert(path)
    write(records(spark, *[(turn(i, mid="k", source="a"), 1) for i in range(5)], (turn(1, mid="k", source="b"), 2), (turn(3, mid=None, source="b"), 2)), 0)
    compact(spark, path)
    table = VersionedTable(spark, path)
    assert table.read("settled").count() == 3
    write(records(spark, (turn(6, mid="new", source="a"), 3)), 1)
    assert set(winners(spark, path)) == {("k", "a", 4), ("new", "a", 6), (None, "b", 3)}


def test_upsert_of_an_empty_batch(spark, tmp_path):
    path = str(tmp_path / "t")
    upsert(path)(records(spark, (turn(1, source="a"), 1)).where(F.lit(False)), 0)
    assert current(spark, path).count() == 0


def batch_days(spark, path):
    days = report.by_day(pricing.price(current(spark, path), fx.card(spark), fx.alias(spark)))
    return sorted((r.day, r.requests, round(float(r.usd), 6)) for r in days.collect())


def test_running_spend_equals_the_batch_after_each_increment(spark, tmp_path):
    path = str(tmp_path / "t")
    write = upsert_with_spend(path, lambda rows: pricing.price(rows, fx.card(spark), fx.alias(spark)))
    day = lambda d: T(2024, 1, d)
    batches = [
        [(turn(1, mid="k", source="a", ts=day(1)), 1), (turn(2, mid="t", source="a", origin="tail", ts=day(2)), 1), (turn(3, mid=None, source="b", ts=day(2)), 1)],
        [(turn(2, mid="t", source="a", ts=day(5), usage=(7, 0, 0, 0, 0, 9)), 2), (turn(3, mid=None, source="b", origin="tail", ts=day(3)), 2)],  # corrected, on another day
        [(turn(1, mid="k", source="c", ts=day(9)), 3), (turn(1, mid="same", source="c", ts=day(9)), 3)],  # a later file has the last word
        [(turn(9, mid="new", source="a", ts=None), 4)],  # and now a is the later file again
        [(turn(8, mid="x", source="b", ts=day(4)), 5)],  # b's tail is gone
    ]
    for number, rows in enumerate(batches):
        for _ in range(2 if number == 1 else 1):  # a batch may run again
            write(records(spark, *rows), number)
        assert sorted((r.day, r.requests, round(float(r.usd), 6)) for r in spend_by_day(spark, path).collect()) == batch_days(spark, path), number
    assert ("2024-01-01", 1, 5.0) in batch_days(spark, path)
    compact(spark, path)
    assert sorted((r.day, r.requests, round(float(r.usd), 6)) for r in spend_by_day(spark, path).collect()) == batch_days(spark, path)


def test_spend_goes_on_after_a_break_between_its_two_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    write = upsert_with_spend(path, lambda rows: pricing.price(rows, fx.card(spark), fx.alias(spark)))
    write(records(spark, (turn(1, mid="a", source="a"), 1)), 0)
    second = records(spark, (turn(2, mid="b", source="a"), 2))
    upsert(path)(second, 1)  # the run ends here
    write(second, 1)
    assert [r.requests for r in spend_by_day(spark, path).collect()] == [2]


def test_idle_sessions_leave_the_state(spark, tmp_path):
    import json
    import time

    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        said = lambda tool: json.dumps({"type": "assistant", "message": {"id": None, "content": [{"type": "tool_use", "name": tool}] if tool else [], "usage": {"input_tokens": 1}}})
        out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

        def run(*rows):
            spark.createDataFrame([(s, "p", n, said(t)) for s, n, t in rows], CHUNK).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
            run_once(stream_cohorts(spark.readStream.schema(CHUNK).json(str(tmp_path / "in")), timedelta(seconds=4)), out, checkpoint, one_batch=True)
            return {(r.source, r.line_no): r.prior_tools for r in spark.read.parquet(out).collect()}, {r["key"]["source"] for r in states(spark, checkpoint).collect()}

        got, there = run(("a", 1, "Bash"))
        assert got == {("a", 1): []} and there == {"a"}
        time.sleep(5)
        got, there = run(("b", 1, "Read"))
        assert there == {"b"}  # nothing came from a
        time.sleep(5)
        got, there = run(("a", 2, None))
        assert got[("a", 2)] == [] and there == {"a"}
    finally:
        spark.conf.set(key, old)


def test_counters_come_from_one_pass(spark, tmp_path):
    lines = spark.createDataFrame([('{"type":"user"}', True), ("{broken", True), ("{half", False)], "value string, complete boolean")
    parsed, came, read = ingest.parse_counted(lines)
    parsed.write.parquet(str(tmp_path / "p"))
    assert came.get == {"lines": 3, "bytes": 27, "tails": 1} and read.get == {"parsed": 3, "billed": 0, "parse_errors": 1}
    (tmp_path / "l").mkdir()
    (tmp_path / "l/a.txt").write_text("x\n")
    counted = ingest.parse_counted(spark.read.text(str(tmp_path / "l")))[0]
    assert counted._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
