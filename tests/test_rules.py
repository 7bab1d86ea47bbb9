"""Rules on small hand-made rows: pricing, windows, dedup, cohorts, findings, lifecycle, reduction."""

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tokenledger.functions.scalars import canonical_model, fingerprint, iso_timestamp
from tokenledger.operators import dedup, findings, ingest, lifecycle, pricing, reduce, report, trend
from tokenledger.operators.attribution import billed_turns
from tokenledger.params import Params
from tokenledger.plans import fixtures as fx

T = lambda *a: datetime(*a, tzinfo=UTC)
TURN = "source string, project string, message_id string, request_id string, model string, ts timestamp, tools array<string>, prior_tools array<string>, usage struct<input:bigint,cache_create:bigint,cache_create_1h:bigint,cache_create_5m:bigint,cache_read:bigint,output:bigint>, origin string, load_seq bigint"


def turn(n=1, model="fx-large-1", ts=T(2024, 1, 20), usage=(1_000_000, 0, 0, 0, 0, 0), source="s", mid="m", rid="r", origin="live", prior=()):
    return (source, "p", mid, rid, model, ts, [], list(prior), usage, origin, n)


def priced(spark, rows):
    return pricing.price(spark.createDataFrame(rows, TURN), fx.card(spark), fx.alias(spark))


def test_canonical_ids(spark):
    ids = ["US.Anthropic.fx-large-1-20250101-v1:0", "fx-large-1[1m]", "eu.fx-small-1", None, "apac.anthropic.us.x"]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "m string").select(canonical_model(F.col("m"))).collect()]
    assert got == ["fx-large-1", "fx-large-1", "fx-small-1", "", "us.x"]


def test_class_prices_and_promotion(spark):
    rows = [
        turn(1, usage=(0, 3_000_000, 1_000_000, 1_000_000, 0, 0)),  # a million unclassified at the 5m rate
        turn(2, model="fx-medium-1", ts=T(2024, 1, 15, 23, 59)), turn(3, model="fx-medium-1", ts=T(2024, 1, 16)), turn(4, model="fx-medium-1", ts=None),
        turn(5, model="nobody"), turn(6, model="small", usage=(0, 0, 0, 0, 1_000_000, 1_000_000)),
    ]
    got = {r.load_seq: r for r in priced(spark, rows).collect()}
    assert float(got[1].usd) == 5 * 2 + 5 * 1.25 * 2 and float(got[1].usd_write_1h) == 10
    assert [float(got[i].usd) for i in (2, 3, 4)] == [2, 3, 3]
    assert not got[5].priced and got[5].usd == 0 and got[5].total == 1_000_000
    assert float(got[6].usd) == pytest.approx(0.1 + 5)


def test_classes_sum_to_total(spark):
    r = report.total(priced(spark, [turn(i, usage=(i, i * 7, i, i * 2, i * 11, i * 3)) for i in range(1, 40)])).first()
    assert r.usd == r.usd_input + r.usd_write + r.usd_read + r.usd_output


def test_keep_last_after_window(spark):
    rows = [turn(1, ts=T(2024, 1, 1)), turn(2, ts=T(2024, 1, 3)), turn(3, mid=None), turn(4, mid=None), turn(9, origin="retired"), turn(0, origin="tail", mid="x"), turn(7, mid="x")]
    df = spark.createDataFrame(rows, TURN)
    assert sorted(r.load_seq for r in dedup.keep_last(df).collect()) == [0, 2, 3, 4]
    early = dedup.keep_last(dedup.in_window(df, None, T(2024, 1, 2)))
    assert [r.load_seq for r in early.collect()] == [1]
    d = dedup.diagnostics(df).first()
    assert (d.records, d.duplicates_dropped, d.missing_ids) == (7, 3, 2)


def test_adjacent_windows_partition(spark):
    df = spark.createDataFrame([turn(i, ts=T(2024, 1, 1) + timedelta(hours=i), mid=str(i)) for i in range(48)], TURN)
    cut = T(2024, 1, 2)
    assert dedup.in_window(df, None, cut).count() + dedup.in_window(df, cut, None).count() == 48


def test_cohorts(spark):
    kinds = [("B", "a", ["Bash"]), ("B", "a", ["Read"]), ("R", None, []), ("B", "b", ["Grep"]), ("H", None, []), ("B", "b", []), ("T", "c", ["Edit"]), ("B", None, []), ("B", None, [])]
    rows = [("s", i, k, m, t) for i, (k, m, t) in enumerate(kinds)]
    got = {r.line_no: (r.tools, r.prior_tools) for r in billed_turns(spark.createDataFrame(rows, "source string, line_no bigint, kind string, message_id string, tools array<string>")).collect()}
    assert got == {0: (["Bash"], []), 1: (["Bash", "Read"], []), 3: (["Grep"], ["Bash", "Read"]), 5: ([], []), 7: ([], ["Edit"]), 8: ([], [])}


def test_tool_rows_sum_to_turn(spark):
    from tokenledger.operators.attribution import tool_costs

    p = priced(spark, [turn(1, prior=("A", "B", "C")), turn(2, mid="n", prior=("A",))])
    rows = {r.tool: r for r in tool_costs(p).collect()}
    assert sum(r.usd for r in rows.values()) == pytest.approx(10) and rows["A"].solo_follow_on_requests == 1 and rows["A"].follow_on_requests == 2


def test_distribution_is_nearest_rank(spark):
    r = report.turn_distribution(priced(spark, [turn(i, mid=str(i), usage=(200_000 * i, 0, 0, 0, 0, 0)) for i in range(1, 11)])).first()
    assert (r.turns, r.p50, r.p90) == (10, 5.0, 9.0) and r.mean == pytest.approx(5.5)


def test_empty_report(spark):
    p = pricing.price(spark.createDataFrame([], TURN), fx.card(spark), fx.alias(spark))
    t = report.total(p)
    assert t.first().requests == 0 and report.shares(t).first().cache_read_share is None
    assert report.run_rate(report.by_day(p), 30, 2.0).count() == 0


def test_trend_windows(spark):
    days = [(T(2024, 1, 22), 1), (T(2024, 1, 28, 23, 59), 2), (T(2024, 1, 21, 23), 3), (T(2024, 1, 29, 1), 4), (T(2024, 1, 14), 5), (T(2024, 1, 29, 15), 6)]
    df = spark.createDataFrame([turn(n, ts=t, mid=str(n)) for t, n in days], TURN)
    got = {r.load_seq: r.period for r in trend.periods(df, Params().as_of, 7).collect()}
    assert got == {1: "current", 2: "current", 3: "previous", 4: "today"}


def test_bounds_are_checked():
    with pytest.raises(ValueError):
        Params(trend_days=91)
    with pytest.raises(ValueError):
        Params(since=T(2024, 1, 2), until=T(2024, 1, 1))


def test_parser_keeps_no_content(spark):
    lines = [
        '{"type":"user","toolUseResult":{"type":"assistant","message":{"usage":{"input_tokens":5}}},"message":{"role":"user","content":"SECRET"}}',
        '{"type":"assistant","requestId":"r1","timestamp":"2024-01-01T00:00:00Z","message":{"id":"m1","model":"fx-small-1","content":[{"type":"text","text":"SECRET"},{"type":"tool_use","name":"Ba\\u0073h"},{"type":"tool_use","name":"bad name"}],"usage":{"input_tokens":3,"output_tokens":-2}}}',
        '{"type":"message","message":{"role":"assistant","content":"SECRET","usage":{"input_tokens":1}}}', '{"type":"assist', "", '{"type":"user","message":{"role":"user","content":[{"type":"tool_result","content":"SECRET"}]}}',
    ]
    p = ingest.assert_redacted(ingest.parse(spark.createDataFrame([("s", i, v) for i, v in enumerate(lines)], "source string, line_no bigint, value string")))
    rows = {r.line_no: r for r in p.collect()}
    assert [rows[i].kind for i in range(6)] == ["H", "B", "B", None, None, "R"]
    assert rows[1].tools == ["Bash"] and rows[1].usage.output == 0 and rows[3].parse_error and not rows[4].parse_error
    assert "SECRET" not in str(rows)


def test_scalars(spark):
    df = spark.createDataFrame([("now",), ("2026",), ("2024-01-01T00:00:00Z",), (None,)], "t string")
    assert [r[0] is not None for r in df.select(iso_timestamp(F.col("t"))).collect()] == [False, False, True, False]
    a, b = spark.range(1).select(fingerprint(F.lit("x"), "s1"), fingerprint(F.lit("x"), "s2")).first()
    assert len(a) == 12 and a != b


def test_labels_and_manifest(spark):
    labels = spark.createDataFrame([("aaaaaaaaaaaa", " one ", T(2024, 1, 1)), ("aaaaaaaaaaaa", "two", T(2024, 1, 2)), ("bad", "x", T(2024, 1, 1)), ("bbbbbbbbbbbb", "a\nb", T(2024, 1, 1)), ("cccccccccccc", " ", T(2024, 1, 1))], "id string, label string, updated timestamp")
    assert [tuple(r) for r in lifecycle.valid_labels(labels).collect()] == [("aaaaaaaaaaaa", "two")]
    m = "source string, modified bigint, size bigint"
    old, new = spark.createDataFrame([("a", 1, 1), ("b", 1, 5), ("c", 1, 5), ("d", 1, 1)], m), spark.createDataFrame([("a", 1, 1), ("b", 2, 9), ("c", 2, 3), ("e", 1, 1)], m)
    assert dict(map(tuple, lifecycle.manifest_diff(old, new).collect())) == {"a": "reused", "b": "appended", "c": "parsed", "d": "retired", "e": "parsed"}
    with pytest.raises(ValueError):
        lifecycle.prune(new, T(2024, 1, 1), timedelta(0))


def test_reduction(spark):
    text = "\n".join(["same"] * 50 + [f"line {i}" + (" error here" if i == 300 else "") + "x" * 30 for i in range(700)])
    r = reduce.reduce_text(spark.createDataFrame([(text,), ("short",), (None,)], "text string")).collect()
    assert r[0].changed and r[0].sent_chars <= 12_000 and "error here" in r[0].reduced and r[0].reduced.endswith("x" * 30)
    assert not r[1].changed and r[2].reduced == "" and not r[2].changed


def test_findings_rank(spark):
    schema = "kind string, severity string, savings_usd double, subject string"
    parts = [spark.createDataFrame([r], schema) for r in [("output-cost", "medium", None, None), ("cache-ttl", "info", 5.0, None), ("model-concentration", "high", 5.0, "m"), ("spend-acceleration", "medium", None, None)]]
    got = findings.ranked(parts).orderBy("rank").collect()
    assert [r.kind for r in got] == ["model-concentration", "cache-ttl", "output-cost", "spend-acceleration"] and got[0].total_savings_usd == 10


def test_load_order_is_by_mtime_then_source(spark):
    rows = [(*turn(1, source="b"), 5), (*turn(9, source="c"), 4), (*turn(2, source="a"), 5)]
    got = dedup.keep_last(spark.createDataFrame(rows, f"{TURN}, modified bigint")).collect()
    assert [r.source for r in got] == ["b"]


def test_rebuild_keeps_what_cannot_be_read_again(spark):
    live, retired, fresh = (spark.createDataFrame([(x, v)], "source string, version bigint") for x, v in (("a", 1), ("gone", 1), ("a", 2)))
    snapshots = spark.createDataFrame([("tag",)], "name string")
    same = lifecycle.rebuild(2, 2, live, retired, snapshots, lambda: fresh)
    new = lifecycle.rebuild(1, 2, live, retired, snapshots, lambda: fresh)
    assert same[0].first().version == 1 and new[0].first().version == 2 and new[1].first().source == "gone" and new[2].count() == 1
    back = lifecycle.rebuild(1, 2, live, live, snapshots, lambda: fresh)
    assert back[1].count() == 0


def test_compare_totals(spark):
    side = lambda usd, pricing: spark.createDataFrame([(u, pricing) for u in usd], "usd double, pricing bigint")
    r = trend.compare_totals(side([1.0, 3.0], 1), side([5.0], 2)).first()
    assert (r.delta_usd, r.delta_pct, r.pricing_mismatch) == (1.0, 0.25, True)
    r = trend.compare_totals(side([], 1), side([5.0], None)).first()
    assert (r.delta_usd, r.delta_pct, r.pricing_mismatch) == (5.0, None, False) and not trend.compare_totals(side([1.0], 2), side([1.0], 2)).first().pricing_mismatch


def test_sources_and_sinks(spark, tmp_path):
    from tokenledger.plans import marts
    from tokenledger.sources import logs

    path = str(tmp_path / "records")
    rec = lambda rows: spark.createDataFrame(rows, "source string, n bigint")
    logs.write_records(rec([("a", 1), ("b", 1)]), path)
    logs.write_records(rec([("a", 2)]), path)
    assert {(r.source, r.n) for r in logs.read_records(spark, path).collect()} == {("a", 2), ("b", 1)}
    logs.write_report({"total": rec([("x", 1)])}, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report/total")).first().n == 1
    with pytest.raises(ValueError):
        logs.write_report({"bad": rec([("x", 1)]).withColumnRenamed("n", "message_id")}, str(tmp_path / "report"))
    (tmp_path / "card.csv").write_text("model,input_rate,output_rate,valid_from,valid_to,is_list\nfx-large-1,0.000005,0.000025,,2024-01-16T00:00:00Z,true\n")
    card = logs.read_rate_card(spark, str(tmp_path / "card.csv")).first()
    assert float(card.write_1h_rate) == 0.00001 and card.valid_from is None and card.is_list
    labels = str(tmp_path / "labels")
    lab = lambda i, t, day: spark.createDataFrame([(i, t, T(2024, 1, day))], "id string, label string, updated timestamp")
    logs.upsert_labels(lab("aaaaaaaaaaaa", " one\n", 1), labels)
    logs.upsert_labels(lab("aaaaaaaaaaaa", "two", 2), labels)
    assert lifecycle.valid_labels(logs.read_labels(spark, labels)).first().label == "two"
    for bad in (("short", "x"), ("aaaaaaaaaaaa", " "), ("aaaaaaaaaaaa", "x" * 81), ("aaaaaaaaaaaa", "a\nb"), (None, "x")):
        with pytest.raises(ValueError):
            logs.upsert_labels(lab(*bad, 3), labels)
    (tmp_path / "ledger").mkdir()
    (tmp_path / "ledger/a.json").write_text('{"timestamp":"2024-01-01T00:00:00Z","rawChars":10,"sentChars":2}\n{"timestamp":"never","rawChars":5,"sentChars":9}\n{"timestamp":"2024-01-0')
    got = logs.read_ledger(spark, str(tmp_path / "ledger"))
    assert findings.ledger_totals(got).first()[:4] == (2, 15, 11, 4) and findings.ledger_totals(got, T(2023, 1, 1)).first()[:4] == (1, 10, 2, 8)
    marts.write({"one": rec([("x", 1)])}, str(tmp_path / "marts"))
    assert spark.read.parquet(str(tmp_path / "marts/one")).count() == 1


def test_unterminated_last_line_is_no_error(spark, tmp_path):
    from tokenledger.sources import logs

    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.jsonl").write_text('{"type":"user","message":{}}\r\n{"broken\n\n{"half')
    (tmp_path / "p/b.jsonl").write_text('{"type":"user","message":{}}\n{"broken\n')
    lines = logs.ordered_lines(logs.read_lines(spark, str(tmp_path)))
    got = ingest.parse(lines).groupBy("file_path").agg(F.count("*").alias("n"), F.count_if("parse_error").alias("bad")).collect()
    assert {r.file_path[-7]: (r.n, r.bad) for r in got} == {"a": (3, 1), "b": (2, 1)}


def test_no_local_folder_on_a_cluster(monkeypatch):
    from tokenledger.sources import staging

    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(RuntimeError):
        staging.shared_dir(Session)


def test_ids_and_names_are_json_strings(spark):
    def one(line):
        return ingest.parse(spark.createDataFrame([(1, line)], "line_no long, value string")).first()

    head = '{"type":"assistant","message":{"id":%s,"content":[{"type":"tool_use","name":%s}],"usage":{"input_tokens":%s}},"requestId":%s}'
    for bad in ("123", "true", "null", '{"a":1}', '["m"]', '"has space"', '""', '"-dash"', f'"{"x" * 500}"'):
        r = one(head % (bad, bad, "1", bad))
        assert (r.message_id, r.request_id, r.tools, r.kind, r.parse_error) == (None, None, [], "B", False), bad
    r = one(head % ('"msg_01AbCdEf-2.0:x"', '"Bash"', "7.9", '"r"'))
    assert (r.message_id, r.request_id, r.tools, r.usage.input) == ("msg_01AbCdEf-2.0:x", "r", ["Bash"], 7)
    for bad in ("-3", '"5"', "true", "null", "[5]", "{}", "1e400", "1e30"):  # no counters, and no errors
        r = one(head % ('"a"', '"Bash"', bad, '"r"'))
        assert (r.usage.input, r.usage.output, r.kind, r.parse_error) == (0, 0, "B", False), bad
    assert one(head % ('"a"', '"Bash"', "1.5e3", '"r"')).usage.input == 1500
    for bad in ("5", '"x"', "[]", "true", "null"):
        r = one('{"type":"assistant","message":{"id":"a","usage":%s}}' % bad)
        assert (r.usage.input, r.kind, r.parse_error) == (0, "H", False), bad
    r = one('{"type":"assistant","message":{"usage":{"cache_creation":{"ephemeral_1h_input_tokens":3,"ephemeral_5m_input_tokens":"4"},"cache_creation_input_tokens":9}}}')
    assert (r.usage.cache_create, r.usage.cache_create_1h, r.usage.cache_create_5m) == (9, 3, 0)
    r = one('{"type":"assistant","message":{"id":{"a":1,"a":2},"content":[{"type":"tool_use","name":"Bash","input":{"k":1,"k":2}}]}}')
    assert (r.message_id, r.tools, r.kind, r.parse_error) == (None, ["Bash"], "T", False)  # repeated keys
    r = one('{"type":"assistant","message":{"content":"[{\\"type\\":\\"tool_use\\",\\"name\\":\\"Bash\\"}]","model":5}}')
    assert (r.tools, r.model, r.kind, r.parse_error) == ([], "<unknown>", "H", False)  # a text that looks like blocks
    assert one('{"type":"assistant","message":{"content":"x"').parse_error and one("[1]").parse_error
