"""The registered queries: (spark, sf_dir) -> DataFrame, each with SQL of the same name in oracle.py."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenledger.functions.scalars import bind, fingerprint, model_key, usd
from tokenledger.operators import attribution, cohorts, cuboid, dedup, findings, ingest, lifecycle, pricing, reduce, report, trend
from tokenledger.operators.scan import running
from tokenledger.params import Params
from tokenledger.plans import fixtures as fx
from tokenledger.sources import logs
from tokenledger.sources.staging import scratch, stage, unstage
from tokenledger.sources.versioned import VersionedTable

P = Params()
CHANGE = fx.CHANGE
SINCE, UNTIL = datetime(2024, 1, 8, tzinfo=UTC), datetime(2024, 1, 22, 12, tzinfo=UTC)
LATE, EARLY = datetime(2024, 1, 20, tzinfo=UTC), datetime(2024, 1, 8, tzinfo=UTC)
SMALL = reduce.Reduction(max_chars=500, head=3, tail=3, important=2, signal="(the|und|les|las)")
BUCKET = ("requests", *report.TOKENS, "total", *report.DOLLARS, "unpriced_tokens")
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def money(df: DataFrame, digits: int = 6) -> DataFrame:
    """Dollars and other fractions as rounded doubles, arrays as sorted joined text."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind.startswith("decimal") or kind == "double":
            c = usd(c, digits)
        elif kind.startswith("array"):
            c = F.array_join(F.array_sort(c), ",")
        elif kind == "int" or kind == "bigint":
            c = c.cast("bigint")
        out.append(c.alias(name))
    return df.select(*out)


def priced(s: SparkSession, d: str, factor: int = 1) -> DataFrame:
    return pricing.price(dedup.keep_last(fx.turns(s, d)), fx.card(s, factor), fx.alias(s))


# pricing


@query
def canonical_models(s, d):
    return fx.turns(s, d).groupBy("model").agg(F.count("*").alias("turns")).withColumn("canonical", model_key(F.col("model")))


@query
def rate_card_effective(s, d):
    t = pricing.with_rates(fx.turns(s, d).withColumn("day", F.date_format("ts", "yyyy-MM-dd")), fx.card(s), fx.alias(s))
    return t.groupBy("rated_model", "day").agg((F.max("input_rate") * 1_000_000).cast("double").alias("input_rate"), (F.max("output_rate") * 1_000_000).cast("double").alias("output_rate"), F.count("*").alias("turns"))


@query
def priced_turns(s, d):
    p = priced(s, d)
    return money(p.select("source", "line_no", "priced", "total", *report.DOLLARS, pricing.unclassified(F.col("usage")).alias("unclassified")))


@query
def unpriced_tokens(s, d):
    return report.by_model(priced(s, d)).where("unpriced_tokens > 0").select("model", "requests", "unpriced_tokens")


@query
def cheaper_sibling(s, d):
    used = fx.turns(s, d).groupBy(model_key(F.col("model")).alias("model")).agg(F.count("*").alias("turns"))
    return used.join(pricing.cheaper_sibling(fx.card(s), fx.ladder(s), fx.CLASSES).select("model", "sibling"), "model", "left")


def what_if(s, models: DataFrame, factor: int = 1) -> DataFrame:
    c = fx.card(s, factor)
    return pricing.model_what_if(models, pricing.cheaper_sibling(c, fx.ladder(s), fx.CLASSES), c, fx.alias(s))


@query
def model_what_if(s, d):
    return money(what_if(s, report.by_model(priced(s, d))))


# dedup and window


@query
def keep_last(s, d):
    return dedup.keep_last(fx.turns(s, d)).select("source", "line_no", "message_id")


def shared_keys(s, d) -> DataFrame:
    """Turns whose keys stand in several sources, as those of resumed sessions do."""
    n = (F.col("event_id") % 997).cast("string")
    return fx.turns(s, d).withColumns({"message_id": F.when(F.col("message_id").isNotNull(), F.concat(F.lit("x"), n)), "request_id": F.when(F.col("request_id").isNotNull(), F.concat(F.lit("y"), n))})


def modified_turns(s, d) -> DataFrame:
    """Those, with when their source was last modified."""
    return shared_keys(s, d).join(fx.lines(s, d).groupBy("source").agg(F.max("ts").alias("modified")), "source")


@query
def keep_last_by_mtime(s, d):
    return dedup.keep_last(modified_turns(s, d)).select("source", "line_no", "message_id")


@query
def clustered_window(s, d):
    """A window over records stored in buckets of their key within days; they are neither all read nor shuffled."""
    import uuid

    stored = logs.write_clustered(fx.turns(s, d), f"usage_records_{uuid.uuid4().hex}", scratch(s, "records") + "/table", 8)
    return dedup.keep_last(logs.clustered_window(stored, SINCE, UNTIL)).select("source", "line_no")


@query
def dedup_diagnostics(s, d):
    return dedup.diagnostics(fx.turns(s, d))


@query
def window_filter(s, d):
    return dedup.keep_last(dedup.in_window(fx.turns(s, d), SINCE, UNTIL)).select("source", "line_no")


# report


@query
def report_total(s, d):
    return money(report.total(priced(s, d)).select(*BUCKET))


@query
def report_by_model(s, d):
    return money(report.by_model(priced(s, d)).orderBy(F.col("usd").desc(), F.col("total").desc(), "model").select("model", *BUCKET))


@query
def report_by_session(s, d):
    return money(report.by_session(priced(s, d)).select("source", "project", "avg_prompt_tokens", *BUCKET))


@query
def report_by_project(s, d):
    return money(report.by_project(priced(s, d)).select("project", *BUCKET))


@query
def report_by_day(s, d):
    return money(report.by_day(priced(s, d)).orderBy("day").select("day", *BUCKET))


@query
def report_cube(s, d):
    return money(report.cube(priced(s, d)).select("level", "key", *BUCKET))


@query
def report_scope(s, d):
    inside = F.coalesce((F.col("ts") >= F.lit(SINCE)) & (F.col("ts") < F.lit(UNTIL)), F.lit(False))
    return fx.turns(s, d).agg(F.count("*").alias("records_read"), F.count_if(inside).alias("records_in_window"))


@query
def insight_shares(s, d):
    return money(report.shares(report.total(priced(s, d))))


@query
def turn_cost_dist(s, d):
    return money(report.turn_distribution(priced(s, d)))


@query
def run_rate(s, d):
    return money(report.run_rate(report.by_day(priced(s, d)), P.projection_days, P.anomaly_ratio))


@query
def top_sessions(s, d):
    return money(report.top(report.by_session(priced(s, d)), "source", P.session_limit).select("source", "project", "avg_prompt_tokens", *BUCKET))


@query
def top_projects(s, d):
    return money(report.top(report.by_project(priced(s, d)), "project", P.project_limit).select("project", *BUCKET))


def one_source(s, d, rank: int) -> DataFrame:
    """The source with the rank-th most lines; one row."""
    n = fx.lines(s, d).groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(rank)
    return n.orderBy("n", F.desc("source")).limit(1).select("source")


@query
def session_report(s, d):
    mine = fx.turns(s, d).join(one_source(s, d, 1), "source", "left_semi")
    return money(report.by_model(pricing.price(dedup.keep_last(mine), fx.card(s), fx.alias(s))).select("model", *BUCKET))


@query
def project_report(s, d):
    mine = fx.turns(s, d).where(F.col("project") == fx._id("p", F.lit("3")))
    return money(report.by_model(pricing.price(dedup.keep_last(mine), fx.card(s), fx.alias(s))).select("model", *BUCKET))


# attribution


@query
def cohort_segments(s, d):
    return attribution.cohort_segments(fx.lines(s, d)).select("source", "line_no", "kind", F.col("seg").cast("bigint"), F.col("grp").cast("bigint"))


@query
def message_tools(s, d):
    g = attribution.message_tools(attribution.cohort_segments(fx.lines(s, d)))
    return money(g.select("source", "line_no", F.col("running_tools").alias("tools")))


@query
def prior_tools(s, d):
    g = attribution.prior_tools(attribution.cohort_segments(fx.lines(s, d)))
    return money(g.select("source", "line_no", "prior_tools"))


@query
def cohort_turns(s, d):
    """The same machine as a prefix scan over ranges of lines, for sessions of any size."""
    return money(cohorts.cohort_turns(fx.lines(s, d)).select("source", "line_no", "tools", "prior_tools"))


TOOL = ("calls", "follow_on_requests", "solo_follow_on_requests", "total", "usd", "output_usd", "solo_usd", "unpriced_tokens")


def tools(s, d, factor: int = 1) -> DataFrame:
    return attribution.tool_costs(priced(s, d, factor))


@query
def tool_costs(s, d):
    return money(tools(s, d).select("tool", *TOOL), 4)


@query
def tool_economics(s, d):
    return money(attribution.tool_economics(tools(s, d)).select("tool", "usd_per_call", "solo_share"))


@query
def top_tools(s, d):
    return money(attribution.top_tools(tools(s, d), 2).select("tool", *TOOL), 4)


@query
def mcp_tools(s, d):
    return money(attribution.top_tools(tools(s, d), P.tool_limit, "mcp__").select("tool", *TOOL), 4)


# trend and compare


def period_turns(s, d, factor: int = 1, turns: DataFrame | None = None) -> DataFrame:
    return pricing.price(trend.periods(fx.turns(s, d) if turns is None else turns, P.as_of, P.trend_days), fx.card(s, factor), fx.alias(s))


@query
def trend_totals(s, d):
    return money(trend.totals(period_turns(s, d), P.trend_days))


@query
def trend_today(s, d):
    return money(trend.today(period_turns(s, d)))


def model_drivers(s, d, factor: int = 1) -> DataFrame:
    return trend.drivers(report.keyed(period_turns(s, d, factor)).drop("model").withColumnRenamed("model_key", "model"), "model", P.driver_limit)


def project_drivers(s, d) -> DataFrame:
    return trend.drivers(report.keyed(period_turns(s, d)).drop("project").withColumnRenamed("project_key", "project"), "project", P.driver_limit, P.project_limit)


@query
def trend_drivers_model(s, d):
    return money(model_drivers(s, d))


@query
def trend_drivers_project(s, d):
    return money(project_drivers(s, d))


@query
def half_window_trend(s, d):
    return money(trend.half_window(report.by_day(priced(s, d)).select("day", "usd")))


def window_models(s, d, since, until) -> DataFrame:
    t = dedup.keep_last(dedup.in_window(fx.turns(s, d), since, until))
    return report.by_model(pricing.price(t, fx.card(s), fx.alias(s)))


@query
def compare_windows(s, d):
    left = trend.snapshot(window_models(s, d, None, SINCE), "before", P.pricing_version)
    right = trend.snapshot(window_models(s, d, SINCE, UNTIL), "after", P.pricing_version)
    return money(trend.compare(left, right))


@query
def compare_sessions(s, d):
    side = lambda k: report.by_model(pricing.price(dedup.keep_last(fx.turns(s, d).join(one_source(s, d, k), "source", "left_semi")), fx.card(s), fx.alias(s)))
    return money(trend.compare(side(1), side(2)))


@query
def snapshot_save(s, d):
    path = scratch(s, "snapshots") + "/table"
    rows = trend.snapshot(window_models(s, d, SINCE, UNTIL), "week-2", P.pricing_version)
    saved = logs.append_snapshot(rows, path)
    return money(saved.select("name", "pricing", "model", "usd", "total", "requests"))


@query
def compare_snapshots(s, d):
    """Two saved snapshots of different pricing versions: totals, change and mismatch."""
    path = scratch(s, "snapshots") + "/table"
    logs.append_snapshot(trend.snapshot(window_models(s, d, None, SINCE), "week-1", P.pricing_version - 1), path)
    saved = logs.append_snapshot(trend.snapshot(window_models(s, d, SINCE, UNTIL), "week-2", P.pricing_version), path)
    return money(trend.compare_totals(saved.where("name = 'week-1'"), saved.where("name = 'week-2'")))


# findings, at 20 times the rates so that thresholds are reached


@query
def finding_model(s, d):
    m = report.by_model(priced(s, d, 20))
    return money(findings.model_concentration(m, report.total(priced(s, d, 20)), what_if(s, m, 20), P.but(model_share=0.4)))


@query
def finding_output(s, d):
    return money(findings.output_cost(report.total(priced(s, d, 20)), P))


@query
def finding_cache(s, d):
    t = report.total(priced(s, d, 20))
    return money(findings.cache(t, P).unionByName(findings.cache(t, P.but(cache_1h_usd=1e12, cache_write_share=0.05))))


@query
def finding_context(s, d):
    p = P.but(context_usd=1.0)
    return money(findings.context_bloat(sessions(s, d), report.total(priced(s, d, 20)), p))


def sessions(s, d) -> DataFrame:
    return report.top(report.by_session(priced(s, d, 20)), "source", P.session_limit)


@query
def finding_session(s, d):
    return money(findings.session_outlier(sessions(s, d), P.but(context_tokens=100_000_000)))


@query
def finding_mcp(s, d):
    return money(findings.mcp_cost(attribution.top_tools(tools(s, d, 20), P.tool_limit), report.total(priced(s, d, 20)), P))


def ledger(s, d) -> DataFrame:
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source")
    reduced = reduce.reduce_text(docs, r=SMALL)
    return reduce.ledger_rows(reduced, F.col("doc_id").cast("string"), F.col("source"), F.lit(fx.CHANGE))


@query
def finding_bash(s, d):
    return money(findings.bash_filter(attribution.top_tools(tools(s, d, 20), P.tool_limit), report.by_model(priced(s, d, 20)), findings.ledger_totals(ledger(s, d)), fx.card(s, 20), P))


@query
def finding_accel(s, d):
    return money(findings.acceleration(trend.totals(period_turns(s, d, 20), P.trend_days), P.but(acceleration_pct=-0.9)))


def all_findings(s, d) -> DataFrame:
    """The rules read a handful of staged rows: totals, models, first sessions and tools, trend and ledger of one pass each."""
    p = P.but(model_share=0.4, context_usd=1.0, acceleration_pct=-0.9)
    turns = stage(fx.turns(s, d), "turns")
    paid = stage(pricing.price(dedup.keep_last(turns), fx.card(s, 20), fx.alias(s)), "paid")
    cube = stage(report.cube(paid), "cube")
    level = lambda name, key: cube.where(F.col("level") == name).withColumnRenamed("key", key)
    total, models = stage(level("total", "key"), "total"), stage(level("model", "model"), "models")
    top_s = stage(report.top(level("session", "source").withColumn("avg_prompt_tokens", report.avg_prompt_tokens()), "source", p.session_limit), "sessions")
    top_t = stage(attribution.top_tools(attribution.tool_costs(paid), p.tool_limit), "tools")
    trend_row = stage(trend.totals(period_turns(s, d, turns=turns), p.trend_days), "trend")
    saved = stage(findings.ledger_totals(ledger(s, d)), "ledger")
    for big in (turns, paid, cube):
        unstage(big)
    rate = stage(fx.card(s, 20), "card")
    return findings.ranked([
        findings.model_concentration(models, total, what_if(s, models, 20), p), findings.output_cost(total, p), findings.cache(total, p), findings.session_outlier(top_s, p),
        findings.context_bloat(top_s, total, p), findings.mcp_cost(top_t, total, p), findings.bash_filter(top_t, models, saved, rate, p), findings.acceleration(trend_row, p)])


@query
def findings_ranked(s, d):
    return money(all_findings(s, d))


# ingest


def parsed(s, d) -> DataFrame:
    return ingest.assert_redacted(ingest.parse(fx.raw_lines(s, d)))


@query
def line_kinds(s, d):
    return parsed(s, d).select("source", "line_no", "kind")


@query
def usage_extract(s, d):
    u = F.col("usage")
    return parsed(s, d).where("kind = 'B'").groupBy("source").agg(*[F.sum(u[c]).alias(c) for c in report.TOKENS], F.max("ts").cast("string").alias("last_ts"))


@query
def parse_errors(s, d):
    return ingest.parse_errors(parsed(s, d))


@query
def tool_names(s, d):
    return parsed(s, d).select(F.explode("tools").alias("tool")).groupBy("tool").agg(F.count("*").alias("n"))


@query
def message_ids(s, d):
    return parsed(s, d).where("message_id is not null").select("source", "line_no", "message_id", "request_id")


@query
def typed_ids(s, d):
    """Lines whose ids, models and tool names are numbers, booleans or objects, or whose content only looks like blocks."""
    e = F.col("event_id")
    text = e.cast("string")
    pick = lambda n, *x: F.element_at(F.array(*x), (e % n + 1).cast("int"))
    said = lambda *x: F.concat(F.lit('"'), *x, F.lit('"'))
    ids = pick(6, said(F.lit("m"), text), text, F.lit("true"), F.concat(F.lit('{"a":'), text, F.lit("}")), F.lit('{"a":1,"a":2}'), F.lit("null"))
    models = pick(4, said(F.lit("fx-"), text), text, F.lit("false"), F.lit('["fx"]'))
    names = pick(5, said(F.lit("Bash")), F.lit("true"), said(F.lit("Read")), F.lit("7"), said(F.lit("no name")))
    block = F.concat(F.lit('[{"type":"tool_use","name":'), names, F.lit(',"input":{"k":1,"k":2}}]'))
    content = F.when(e % 7 == 0, said(F.replace(block, F.lit('"'), F.lit('\\"')))).otherwise(block)
    value = F.concat(F.lit('{"type":"assistant","message":{"id":'), ids, F.lit(',"model":'), models, F.lit(',"content":'), content, F.lit(',"usage":{"input_tokens":'), text, F.lit('.5}}}'))
    lines = s.read.parquet(f"{d}/events.parquet").select(e.alias("line_no"), value.alias("value"))
    p = ingest.parse(lines)
    return p.select("line_no", "kind", "message_id", "model", F.array_join("tools", ",").alias("tools"), p.usage.input.alias("input"), "parse_error")


@query
def typed_counters(s, d):
    """Lines whose counters are fractions, strings, booleans, negative or beyond all measure, or whose usage is no object."""
    e = F.col("event_id")
    text = e.cast("string")
    pick = lambda n, *x: F.element_at(F.array(*x), (e % n + 1).cast("int"))
    made = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    count = pick(6, made(text, ".75"), made('"', text, '"'), made("-", text), F.lit("1e400"), F.lit("true"), made(text, "e1"))
    hour = pick(4, text, made('"', text, '"'), F.lit("{}"), F.lit("null"))
    usage = pick(5, *[made('{"output_tokens":', count, ',"cache_creation":{"ephemeral_1h_input_tokens":', hour, "}}")] * 3, text, F.lit('"none"'))
    lines = s.read.parquet(f"{d}/events.parquet").select(e.alias("line_no"), made('{"type":"assistant","message":{"usage":', usage, "}}").alias("value"))
    p = ingest.parse(lines)
    return p.select("line_no", "kind", p.usage.output.alias("output"), p.usage.cache_create_1h.alias("cache_create_1h"), "parse_error")


@query
def redacted_lines(s, d):
    p = parsed(s, d)
    whole = F.to_json(F.struct(*p.columns))
    return p.groupBy("project").agg(F.count("*").alias("lines"), F.count_if(whole.contains(fx.SECRET)).alias("leaks"))


@query
def fingerprints(s, d):
    return fx.lines(s, d).groupBy("source").agg(F.count("*").alias("n")).withColumn("source", fingerprint(F.col("source"), P.salt))


@query
def normalize_records(s, d):
    x = fx.lines(s, d)
    odd = F.col("event_id") % 10
    u = F.col("usage")
    loose = x.select(
        "source", F.when(odd == 1, F.lit("a project")).otherwise(F.col("project")).alias("project"), F.when(odd == 2, F.lit("bad id!")).otherwise(F.col("message_id")).alias("message_id"), "request_id",
        F.when(odd == 3, F.lit("a model with blanks")).otherwise(F.col("model")).alias("model"), F.when(odd == 4, F.lit("now")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("timestamp"),
        F.when(odd == 5, F.array(F.lit("bad tool"), F.lit("Ok"), F.lit("Ok"))).otherwise(F.col("tools")).alias("tools"),
        F.when(odd == 6, F.lit("-5")).when(odd == 7, F.lit("many")).otherwise(u["input"].cast("string")).alias("input"), *[u[c].cast("string").alias(c) for c in report.TOKENS[1:]])
    return money(ingest.normalize(loose).withColumn("ts", F.col("ts").cast("string")))


def log_files(s, d) -> tuple[DataFrame, str]:
    """The raw lines as one file a session below a project folder, in the shared folder; the files read back."""
    root = logs.write_sessions(fx.raw_lines(s, d), f"{scratch(s, 'sessions')}/logs")
    return logs.read_lines(s, root), root


#: A session's name from the path of its file.
SESSION = ("file_path", "([^/]+)[.]jsonl$", 1)


@query
def log_scan(s, d):
    files, root = log_files(s, d)
    scan = logs.log_scan(files, root, P.salt)
    return scan.select(F.regexp_extract(*SESSION).alias("source"), "lines", (F.col("file_size") > F.col("lines")).alias("sized"))


@query
def ordered_lines(s, d):
    files, _ = log_files(s, d)
    got = logs.ordered_lines(files).withColumn("source", F.regexp_extract(*SESSION))
    return ingest.parse(got).select("source", F.col("line_no").cast("bigint"), "kind", "message_id")


@query
def tail_lines(s, d):
    """Files whose last line is half written: it is no error, the broken lines before it are."""
    root = logs.write_sessions(fx.raw_lines(s, d), f"{scratch(s, 'logs')}/table", half=30)
    got = logs.ordered_lines(logs.read_lines(s, root)).withColumn("source", F.regexp_extract(*SESSION))
    return ingest.parse(got).groupBy("source").agg(F.count("*").alias("lines"), F.count_if("parse_error").alias("parse_errors"))


@query
def ledger_read(s, d):
    """A ledger written, with one line cut off and some times missing, and read back from a day on."""
    path = scratch(s, "ledger") + "/table"
    docs = s.read.parquet(f"{d}/documents.parquet").where("length(text) > 500")
    ts = F.when(F.col("doc_id") % 10 != 0, F.lit(CHANGE) + F.make_dt_interval((F.col("doc_id") % 7 - 3).cast("int")))
    text = F.lit(None).cast("string")
    logs.append_ledger(docs.select(ts.alias("ts"), F.col("source").alias("session"), text.alias("project"), F.col("doc_id").cast("string").alias("artifact_id"), F.length("text").alias("raw_chars"), F.lit(500).alias("sent_chars"), F.lit(1).alias("elided_lines")), path)
    s.createDataFrame([('{"timestamp":"2024-01-20T00:00:00Z","rawChars":9',)], "value string").coalesce(1).write.mode("append").text(path)
    return findings.ledger_totals(logs.read_ledger(s, path), CHANGE).select(*[F.col(c).cast("bigint").alias(c) for c in ("events", "raw_chars", "sent_chars", "saved_chars", "saved_tokens")])


# text reduction


def documents(s, d) -> DataFrame:
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")


@query
def collapse_lines(s, d):
    x = reduce.collapsed(F.split(F.coalesce("text", F.lit("")), "\n"))
    told = bind(x, lambda ls: F.struct(F.size(ls).cast("bigint").alias("n_lines"), F.sha2(F.array_join(ls, "\n"), 256).alias("digest")))
    return documents(s, d).select("doc_id", F.inline(F.array(told)))


@query
def reduce_lines(s, d):
    x = reduce.reduced_lines(reduce.collapsed(F.split(F.coalesce("text", F.lit("")), "\n")), SMALL)
    return documents(s, d).select("doc_id", F.inline(F.array(bind(x, lambda k: F.struct(F.sha2(F.array_join(k["kept"], "\n"), 256).alias("digest"), k["elided"].cast("bigint").alias("elided"))))))


@query
def fit_ends(s, d):
    x = bind(reduce.fit_ends(F.col("text"), SMALL.max_chars, SMALL), lambda t: F.struct(F.sha2(t, 256).alias("digest"), F.length(t).cast("bigint").alias("n")))
    return documents(s, d).select("doc_id", F.inline(F.array(x)))


@query
def reduce_text(s, d):
    r = reduce.reduce_text(documents(s, d), r=SMALL)
    big = lambda c: F.col(c).cast("bigint").alias(c)
    return r.select("doc_id", F.sha2("reduced", 256).alias("digest"), big("raw_chars"), big("sent_chars"), big("elided_lines"), "changed")


@query
def reduction_ledger(s, d):
    return findings.ledger_totals(ledger(s, d)).select(*[F.col(c).cast("bigint").alias(c) for c in ("events", "raw_chars", "sent_chars", "saved_chars", "saved_tokens")])


# lifecycle


def manifests(s, d) -> tuple[DataFrame, DataFrame]:
    x = fx.lines(s, d)
    return fx.manifest(x.where(F.col("ts") < F.lit(LATE))), fx.manifest(x.where(F.col("ts") >= F.lit(EARLY)))


@query
def all_records(s, d):
    t = fx.turns(s, d).drop("origin")
    parts = t.where(F.col("ts") < F.lit(EARLY)), t.where((F.col("ts") >= F.lit(EARLY)) & (F.col("ts") < F.lit(LATE))), t.where(F.col("ts") >= F.lit(LATE))
    return lifecycle.all_records(*parts).groupBy("origin").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))


@query
def manifest_diff(s, d):
    return lifecycle.manifest_diff(*manifests(s, d))


@query
def ingest_stats(s, d):
    return lifecycle.ingest_stats(lifecycle.manifest_diff(*manifests(s, d)))


@query
def retire_sources(s, d):
    _, new = manifests(s, d)
    t = fx.turns(s, d).select("source", "line_no", "ts")
    live, retired = lifecycle.retire_sources(t.where(F.col("ts") < F.lit(LATE)), t.where(F.col("ts") >= F.lit(LATE)), new)
    return live.withColumn("section", F.lit("live")).unionByName(retired.withColumn("section", F.lit("retired"))).groupBy("section", "source").agg(F.count("*").alias("n"))


@query
def prune_retired(s, d):
    return lifecycle.prune_counts(fx.turns(s, d), P.as_of, timedelta(days=10)).select(*[F.col(c).cast("bigint").alias(c) for c in ("records", "sources", "kept")])


@query
def schema_rebuild(s, d):
    """Live rows of an older schema version computed anew from the logs; retired rows and snapshots stay."""
    t = fx.turns(s, d).select("source", "line_no", "ts")
    fresh = lambda: parsed(s, d).where((F.col("kind") == "B") & (F.col("ts") >= F.lit(EARLY))).select("source", "line_no", "ts")
    snapshots = trend.snapshot(window_models(s, d, SINCE, UNTIL), "week-2", P.pricing_version)
    live, retired, kept = lifecycle.rebuild(1, 2, t.limit(0), t.where(F.col("ts") < F.lit(LATE)), snapshots, fresh)
    count = lambda df, name: df.agg(F.lit(name).alias("section"), F.count("*").alias("n"))
    return count(live, "live").unionByName(count(retired, "retired")).unionByName(count(kept, "snapshots"))


@query
def index_stale(s, d):
    m = fx.manifest(fx.lines(s, d)).withColumnRenamed("modified", "ingested_at")
    case = lambda name, rows, at: lifecycle.is_stale(rows, at).select(F.lit(name).alias("state"), "stale")
    return case("later", m, datetime(2024, 2, 1, tzinfo=UTC)).unionByName(case("then", m, EARLY)).unionByName(case("never", m.limit(0), EARLY))


@query
def labels_upsert(s, d):
    """Labels written, two of them renamed later, and read back."""
    path = scratch(s, "labels") + "/table"
    first = fx.labels(s).where(lifecycle.well_formed())
    logs.upsert_labels(first, path)
    again = s.range(2).select(fx._id("p", F.col("id").cast("string")).alias("id"), F.concat(F.lit("renamed "), F.col("id").cast("string")).alias("label"), F.lit(LATE).alias("updated"))
    logs.upsert_labels(again, path)
    n = fx.lines(s, d).groupBy(F.col("project").alias("id")).agg(F.count("*").alias("lines"))
    return lifecycle.valid_labels(logs.read_labels(s, path)).join(n, "id", "left").withColumn("lines", F.coalesce("lines", F.lit(0)))


@query
def label_validate(s, d):
    ok = lifecycle.valid_labels(fx.labels(s))
    return ok.join(fx.lines(s, d).groupBy(F.col("project").alias("id")).agg(F.count("*").alias("lines")), "id", "left").withColumn("lines", F.coalesce("lines", F.lit(0)))


@query
def projects_labeled(s, d):
    x = fx.lines(s, d)
    folders = x.where(F.col("ts") >= F.lit(LATE)).select("project").distinct().withColumn("folder", F.concat(F.lit("folder-"), F.substring("project", 1, 4)))
    return lifecycle.labelled_projects(x.groupBy("project").agg(F.count("*").alias("lines")), lifecycle.valid_labels(fx.labels(s)), folders)


@query
def stale_labels(s, d):
    return lifecycle.stale_labels(lifecycle.valid_labels(fx.labels(s)), fx.lines(s, d).select("project").distinct())


# marts


@query
def mart_daily(s, d):
    from tokenledger.plans.marts import daily

    return money(daily(report.by_day(priced(s, d))).select("day", "usd", "total", "requests"))


@query
def mart_savings(s, d):
    from tokenledger.plans.marts import savings

    return money(savings(all_findings(s, d)))


@query
def mart_top(s, d):
    from tokenledger.plans.marts import top_lists

    paid = stage(priced(s, d), "paid")
    lists = top_lists(report.by_model(paid), attribution.tool_costs(paid), report.by_session(paid), report.by_project(paid), lifecycle.valid_labels(fx.labels(s)))
    return money(lists, 4)


@query
def mart_changed(s, d):
    from tokenledger.plans.marts import changed

    return money(changed(model_drivers(s, d), project_drivers(s, d), lifecycle.valid_labels(fx.labels(s))))


# streaming: the raw lines as two increments of immutable chunks


def chunks(s, d) -> str:
    root = scratch(s, "chunks") + "/table"
    raw = fx.raw_lines(s, d).select("source", "project", "line_no", "value")
    raw.withColumn("part", F.when(F.col("line_no") <= 3, "1").otherwise("2")).write.partitionBy("part").json(root)
    return root


def increments(s, d, make, name: str) -> str:
    """Run make(stream) over the first and then the second increment with one checkpoint; the folder written."""
    from tokenledger.streaming.ingest import read_chunks, run_once

    root = chunks(s, d)
    out = f"{root}-{name}"
    inbox = f"{root}-inbox"
    for part in ("1", "2"):
        s.read.json(f"{root}/part={part}", schema="source string, project string, line_no bigint, value string").write.mode("append").json(inbox)
        run_once(make(read_chunks(s, inbox)), out, f"{out}-checkpoint")
    return out


@query
def stream_tool_cohorts(s, d):
    """Cohorts carried across two increments; the same rows as one batch pass."""
    from tokenledger.streaming.ingest import ROCKSDB, stream_cohorts

    key = "spark.sql.streaming.stateStore.providerClass"
    before = s.conf.get(key)
    s.conf.set(key, ROCKSDB)
    try:
        return money(s.read.parquet(increments(s, d, stream_cohorts, "cohorts")))
    finally:
        s.conf.set(key, before)


@query
def stream_growing_files(s, d):
    """Session files that grow between two runs, the first of which ends within a line; only what is new is read."""
    from tokenledger.streaming.growing import GrowingLogs, latest_generation
    from tokenledger.streaming.ingest import run_once

    s.dataSource.register(GrowingLogs)
    raw, root = fx.raw_lines(s, d), scratch(s, "growing")
    for lines in (3, None):
        logs.write_sessions(raw, f"{root}/logs", lines)
        stream = s.readStream.format("growing_logs").option("path", f"{root}/logs").option("state", f"{root}/state").load()
        run_once(stream, f"{root}/lines", f"{root}/checkpoint")
    got = latest_generation(s.read.parquet(f"{root}/lines")).withColumn("source", F.regexp_extract(*SESSION))
    numbered = running(got, ["source"], ["line_no"], sums={"place": F.lit(1)}).drop("line_no").withColumnRenamed("place", "line_no")
    return ingest.parse(numbered).select("source", "line_no", "kind", "message_id")


def two_increments(s, d) -> list[DataFrame]:
    """Turns as two increments, the first with a provisional last line a source, which the second has settled where the source goes on.  Turns are made once."""
    t = shared_keys(s, d)
    by_source = Window.partitionBy("source")
    early = F.col("line_no") <= 3
    t = t.withColumns({"goes_on": F.max("line_no").over(by_source) > 3, "cut": F.max(F.when(early, F.col("line_no"))).over(by_source)})
    last = early & (F.col("line_no") == F.col("cut"))
    inside = early, ~early | (last & F.col("goes_on"))
    t = t.withColumns({"first": inside[0], "second": inside[1], "last": last})
    times = {f"{part}_modified": F.max(F.when(F.col(part), F.col("ts"))).over(by_source) for part in ("first", "second")}
    held = stage(t.withColumns(times).drop("goes_on", "cut"), "turns")
    first, second = (held.where(F.col(part)).withColumn("modified", F.col(f"{part}_modified")) for part in ("first", "second"))
    extra = "first", "second", "last", *times
    return [first.withColumn("origin", F.when(F.col("last"), "tail").otherwise("live")).drop(*extra), second.drop(*extra)]


@query
def stream_upsert(s, d):
    """Turns in two increments, the first with a provisional last line a source; the second is run twice, as after a crash."""
    from tokenledger.streaming.ingest import current, upsert

    parts, root = two_increments(s, d), scratch(s, "turns")
    for x in parts:
        x.write.mode("append").parquet(f"{root}/inbox")
        stream = s.readStream.schema(x.schema).parquet(f"{root}/inbox")
        stream.writeStream.foreachBatch(upsert(f"{root}/table")).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    upsert(f"{root}/table")(parts[1], 1)
    return current(s, f"{root}/table").select("source", "line_no", "origin")


@query
def stream_spend_corrected(s, d):
    """Spend by day kept up to date by what each increment takes back and brings: provisional lines that change, keys that another source takes over."""
    from tokenledger.streaming.ingest import spend_by_day, upsert_with_spend

    root = scratch(s, "turns")
    write = upsert_with_spend(f"{root}/table", lambda rows: pricing.price(rows, fx.card(s), fx.alias(s)))
    for number, part in enumerate(two_increments(s, d)):
        write(part, number)
    write(part, number)  # as after a crash
    return money(spend_by_day(s, f"{root}/table"))


@query
def report_sink(s, d):
    """The report's sections as JSON, read again."""
    root = scratch(s, "report") + "/json"
    paid = stage(priced(s, d), "paid")
    logs.write_report({"total": report.total(paid), "by_model": report.by_model(paid), "by_day": report.by_day(paid)}, root)
    read = lambda section, key: s.read.json(f"{root}/{section}").select(F.lit(section).alias("section"), (F.col(key) if key else F.lit(None).cast("string")).alias("name"), "requests", "total")
    return read("total", None).unionByName(read("by_model", "model")).unionByName(read("by_day", "day"))


@query
def ingest_counters(s, d):
    """Counters of one pass over the lines that writes them parsed."""
    parsed_, came, read = ingest.parse_counted(fx.raw_lines(s, d))
    parsed_.write.parquet(scratch(s, "parsed") + "/table")
    counts = {**came.get, **read.get}
    names = ("lines", "tails", "parsed", "billed", "parse_errors")
    return s.createDataFrame([tuple(counts[n] for n in names)], ", ".join(f"{n} bigint" for n in names))


def stored_cuboid(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    root = scratch(s, "cuboid")
    paid = pricing.price(fx.turns(s, d), fx.card(s), fx.alias(s))

    def store(name: str, df: DataFrame) -> DataFrame:
        (df.write.partitionBy("day") if name == "turns" else df.write).parquet(f"{root}/{name}")
        return s.read.schema(df.schema).parquet(f"{root}/{name}")

    cells, crossing, turns = cuboid.build(paid, store)
    return store("cells", cells), store("crossing", crossing), turns


def fifty_windows(s) -> DataFrame:
    """Windows of 1 to 17 days; some begin or end within a day."""
    i = F.col("id")
    hours = lambda n: F.make_interval(hours=n.cast("int"))
    since = F.lit(datetime(2024, 1, 1, tzinfo=UTC)) + hours(i % 13 * 24 + F.when(i % 3 == 1, 7).otherwise(0))
    return s.range(50).select(i.alias("w"), since.alias("since"), (since + hours((1 + i % 17) * 24 + F.when(i % 4 == 2, 5).otherwise(0))).alias("until"))


@query
def cuboid_windows(s, d):
    """Cost by model in fifty windows, each deduplicated by itself, from daily cells and the keys that cross days."""
    cells = cuboid.windows_of(*stored_cuboid(s, d), fifty_windows(s), ["model_key"])
    return money(cuboid.rolled(cells, "w", "model_key").select("w", F.col("model_key").alias("model"), "requests", "total", "usd", "unpriced_tokens"))


@query
def cost_sketches(s, d):
    """Whether p50 and p90 of a window's turns, from merged daily sketches, have ranks as near as promised; exact ranks beside."""
    window = s.createDataFrame([(0, SINCE, UNTIL)], "w bigint, since timestamp, until timestamp")
    found = cuboid.cost_quantiles(cuboid.rolled(cuboid.windows_of(*stored_cuboid(s, d), window, []), "w"))
    turns = pricing.price(dedup.keep_last(dedup.in_window(fx.turns(s, d), SINCE, UNTIL)), fx.card(s), fx.alias(s)).where("priced")
    usd_ = F.col("usd").cast("double")
    ranks = turns.crossJoin(F.broadcast(found.select("turns", "p50", "p90"))).agg(F.max("turns").alias("turns"), *[(F.count_if(usd_ < F.col(p)) / F.count("*")).alias(f"{p}_below") for p in ("p50", "p90")], *[(F.count_if(usd_ <= F.col(p)) / F.count("*")).alias(f"{p}_upto") for p in ("p50", "p90")])
    near = lambda p, q: (F.col(f"{p}_below") <= q + cuboid.RANK_ERROR) & (F.col(f"{p}_upto") >= q - cuboid.RANK_ERROR)
    return ranks.select("turns", near("p50", 0.5).alias("p50_near"), near("p90", 0.9).alias("p90_near"))


@query
def replace_sources(s, d):
    """Records of all sources, then some sources replaced by their later lines and some by nothing; an unfinished write counts for nothing."""
    path = scratch(s, "records") + "/table"
    t = fx.turns(s, d)
    logs.write_records(t, path)
    VersionedTable(s, path)._write(t.limit(10), t.select("source").distinct())  # as a run leaves it that broke off before its commit
    digit = F.substring("source", 1, 1)
    logs.write_records(t.where((digit < "8") & (F.col("line_no") > 3)), path, t.where(digit < "8"))
    logs.write_records(t.limit(0), path, t.where(digit == "f"))
    return logs.read_records(s, path).select("source", "line_no", "model")


@query
def stream_daily_spend(s, d):
    """Spend by day over a stream of turns, with a watermark; every update is written and the last of a day counts."""
    from tokenledger.streaming.ingest import daily_spend

    path = scratch(s, "turns") + "/table"
    priced(s, d).select("ts", F.col("usd").cast("decimal(38,12)").alias("usd")).write.parquet(path)
    live = daily_spend(s.readStream.schema("ts timestamp, usd decimal(38,12)").parquet(path))
    out = f"{path}-days"
    live.writeStream.outputMode("update").foreachBatch(lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("append").parquet(out)).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    last = s.read.parquet(out).groupBy("day").agg(F.max_by(F.struct("requests", "usd"), "batch").alias("x"))
    return money(last.select("day", "x.requests", "x.usd"))
