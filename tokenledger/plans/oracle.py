"""DuckDB SQL of each registered query, put together from common table expressions."""

from __future__ import annotations

LINES = """
ev AS (SELECT event_id, ts, user_id, event_type, value, json_extract_string(props, '$.k')::BIGINT AS k,
         substr(sha256('fixture:s:' || user_id || ':' || strftime(date_trunc('week', ts)::DATE, '%Y-%m-%d')), 1, 12) AS source,
         substr(sha256('fixture:p:' || (user_id % 12)), 1, 12) AS project FROM events),
nu AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts, event_id) AS line_no FROM ev),
lines AS (SELECT event_id, source, project, line_no, ts,
    CASE WHEN event_type = 'signup' THEN 'H' WHEN event_type = 'error' THEN 'R' WHEN event_type = 'purchase' AND k % 4 = 0 THEN 'T' ELSE 'B' END AS kind,
    CASE WHEN k <> 0 THEN source || '-m' || (line_no // 2) END AS message_id, CASE WHEN k <> 0 THEN source || '-r' || (line_no // 2) END AS request_id,
    CASE WHEN event_type = 'click' AND k % 3 = 0 THEN ['Bash', 'Read'] WHEN event_type = 'click' THEN ['Bash'] WHEN event_type = 'purchase' THEN ['mcp__issues__search'] ELSE []::VARCHAR[] END AS tools,
    CASE event_id % 5 WHEN 0 THEN 'us.anthropic.fx-large-1-20250101-v1:0' WHEN 1 THEN 'fx-large-1[1m]' WHEN 2 THEN 'fx-medium-1' WHEN 3 THEN 'fx-small-1' ELSE 'fx-preview' END AS model,
    floor(value * 100)::BIGINT AS input, k * 500 AS cache_create, k * 300 AS cache_create_1h, k * 100 AS cache_create_5m, k * 4000 AS cache_read, floor(value * 60)::BIGINT AS output FROM nu),
"""
TURNS = LINES + """
sg AS (SELECT *, sum(CASE WHEN kind = 'H' THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY line_no) AS seg FROM lines),
st AS (SELECT *, CASE WHEN message_id IS NULL OR lag(message_id) OVER (PARTITION BY source, seg ORDER BY line_no) IS DISTINCT FROM message_id THEN 1 ELSE 0 END AS fresh FROM sg WHERE kind IN ('B', 'T')),
gr AS (SELECT *, sum(fresh) OVER (PARTITION BY source, seg ORDER BY line_no) AS grp FROM st),
rt AS (SELECT *, list_distinct(flatten(list(tools) OVER (PARTITION BY source, seg, grp ORDER BY line_no))) AS running FROM gr),
al AS (SELECT source, seg, grp, list_distinct(flatten(list(tools))) AS whole FROM gr GROUP BY ALL),
pt AS (SELECT rt.*, coalesce(al.whole, []::VARCHAR[]) AS prior FROM rt LEFT JOIN al ON rt.source = al.source AND rt.seg = al.seg AND rt.grp = al.grp + 1),
turns AS (SELECT *, CASE WHEN model LIKE '%fx-large-1%' THEN 'fx-large-1' ELSE model END AS m FROM pt WHERE kind = 'B'),
"""
LAST = "QUALIFY message_id IS NULL OR request_id IS NULL OR row_number() OVER (PARTITION BY message_id, request_id{within} ORDER BY source DESC, line_no DESC) = 1"
RATE = """
card(m, lo, hi, ri, ro) AS (VALUES ('fx-large-1', TIMESTAMP '1900-01-01', TIMESTAMP '9999-01-01', 0.000005::DECIMAL(18,12), 0.000025::DECIMAL(18,12)),
  ('fx-medium-1', TIMESTAMP '1900-01-01', TIMESTAMP '2024-01-16', 0.000002::DECIMAL(18,12), 0.000010::DECIMAL(18,12)),
  ('fx-medium-1', TIMESTAMP '2024-01-16', TIMESTAMP '9999-01-01', 0.000003::DECIMAL(18,12), 0.000015::DECIMAL(18,12)),
  ('fx-small-1', TIMESTAMP '1900-01-01', TIMESTAMP '9999-01-01', 0.000001::DECIMAL(18,12), 0.000005::DECIMAL(18,12))),
"""


def priced(kept: str = "turns", where: str = "true", within: str = "", factor: int = 1, extra: str = "") -> str:
    """CTEs up to priced, over the given turns."""
    in_rate = f"(c.ri * {factor})"
    n = lambda c: f"{c}::DECIMAL(18,0)"
    rate = lambda x: f"({in_rate} * {x})::DECIMAL(18,12)"
    five = "(cache_create_5m + greatest(0, cache_create - cache_create_1h - cache_create_5m))"
    return TURNS + f"""
kept AS (SELECT *{extra} FROM {kept} WHERE {where} {LAST.format(within=within)}),{RATE}
pr AS (SELECT k.*, c.m IS NOT NULL AS priced, input + cache_create + cache_read + output AS total,
  coalesce({n('input')} * {rate('1')}, 0)::DECIMAL(38,12) AS usd_input,
  coalesce({n('cache_create_1h')} * {rate('2')} + {n(five)} * {rate('1.25')}, 0)::DECIMAL(38,12) AS usd_write,
  coalesce({n('cache_create_1h')} * {rate('2')}, 0)::DECIMAL(38,12) AS usd_write_1h, coalesce({n('cache_create_5m')} * {rate('1.25')}, 0)::DECIMAL(38,12) AS usd_write_5m,
  coalesce({n('cache_read')} * {rate('0.1')}, 0)::DECIMAL(38,12) AS usd_read,
  coalesce({n('output')} * (c.ro * {factor})::DECIMAL(18,12), 0)::DECIMAL(38,12) AS usd_output
  FROM kept k LEFT JOIN card c ON k.m = c.m AND k.ts >= c.lo AND k.ts < c.hi),
priced AS (SELECT *, usd_input + usd_write + usd_read + usd_output AS usd, strftime(ts, '%Y-%m-%d') AS day FROM pr)
"""


def r6(c: str) -> str:
    return f"round({c}, 6)::DOUBLE"


TOKENS = ("input", "cache_create", "cache_create_1h", "cache_create_5m", "cache_read", "output")
DOLLARS = ("usd", "usd_input", "usd_write", "usd_write_1h", "usd_write_5m", "usd_read", "usd_output")
SUMS = ", ".join(["count(*) AS requests", *[f"coalesce(sum({c}), 0)::BIGINT AS {c}" for c in (*TOKENS, "total")], *[f"coalesce(sum({c}), 0) AS {c}" for c in DOLLARS], "coalesce(sum(total) FILTER (WHERE NOT priced), 0)::BIGINT AS unpriced_tokens"])
OUT = ", ".join(["requests", *TOKENS, "total", *[f"{r6(c)} AS {c}" for c in DOLLARS], "unpriced_tokens"])
AVG = "floor((input + cache_create + cache_read) / requests + 0.5)::BIGINT AS avg_prompt_tokens"
ORDER = "usd DESC, total DESC"


def grouped(key: str, name: str, base: str | None = None) -> str:
    return f"{base or priced()}, g AS (SELECT {key} AS {name}, {SUMS} FROM priced GROUP BY 1)"


def with_(body: str, select: str) -> str:
    return "WITH " + body.strip().rstrip(",") + "\n" + select


TOOLS = """
, ex AS (SELECT *, len(prior) AS n, unnest(prior) AS tool FROM priced WHERE len(prior) > 0),
fo AS (SELECT tool, count(*) AS follow_on_requests, sum(total / n) AS total, sum(usd::DOUBLE / n) AS usd, sum(usd_output::DOUBLE / n) AS output_usd,
  sum(CASE WHEN n = 1 AND priced THEN usd ELSE 0 END)::DOUBLE AS solo_usd, count(*) FILTER (WHERE n = 1 AND priced) AS solo_follow_on_requests,
  sum(CASE WHEN priced THEN 0 ELSE total / n END) AS unpriced_tokens FROM ex GROUP BY tool),
ca AS (SELECT tool, count(*) AS calls FROM (SELECT unnest(running) AS tool FROM priced) GROUP BY tool),
tools AS (SELECT tool, coalesce(calls, 0) AS calls, coalesce(follow_on_requests, 0) AS follow_on_requests, coalesce(solo_follow_on_requests, 0) AS solo_follow_on_requests,
  coalesce(total, 0) AS total, coalesce(usd, 0) AS usd, coalesce(output_usd, 0) AS output_usd, coalesce(solo_usd, 0) AS solo_usd, coalesce(unpriced_tokens, 0) AS unpriced_tokens FROM ca FULL JOIN fo USING (tool))
"""
TOOL_OUT = "tool, calls, follow_on_requests, solo_follow_on_requests, " + ", ".join(f"round({c}, 4)::DOUBLE AS {c}" for c in ("total", "usd", "output_usd", "solo_usd", "unpriced_tokens"))
WINDOW = "ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-22 12:00:00'"
PERIOD = ", CASE WHEN ts >= TIMESTAMP '2024-01-22' AND ts < TIMESTAMP '2024-01-29' THEN 'current' WHEN ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-22' THEN 'previous' WHEN ts >= TIMESTAMP '2024-01-29' AND ts < TIMESTAMP '2024-01-29 14:00:00' THEN 'today' END AS period"


def periods(factor: int = 1) -> str:
    return priced(where="ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-29 14:00:00'", within=", period", factor=factor, extra=PERIOD)


SIDES = "coalesce(sum(usd) FILTER (WHERE period = 'current'), 0) AS cur, coalesce(sum(usd) FILTER (WHERE period = 'previous'), 0) AS prev"
RANKED_SOURCE = "(SELECT source FROM (SELECT source, row_number() OVER (ORDER BY count(*) DESC, source) AS k FROM lines GROUP BY source) WHERE k = {})"
MAN = LINES + """
o AS (SELECT source, max(ts) AS om, count(*) AS os FROM lines WHERE ts < TIMESTAMP '2024-01-20' GROUP BY source),
w AS (SELECT source, max(ts) AS nm, count(*) AS ns FROM lines WHERE ts >= TIMESTAMP '2024-01-08' GROUP BY source),
diff AS (SELECT source, CASE WHEN ns IS NULL THEN 'retired' WHEN os IS NULL THEN 'parsed' WHEN om = nm AND os = ns THEN 'reused' WHEN ns > os THEN 'appended' ELSE 'parsed' END AS status FROM o FULL JOIN w USING (source))
"""
# text reduction with max 500 characters, head 3, tail 3, diagnostics 2
COLLAPSE = """
s AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
c AS (SELECT *, list_filter(ls, lambda x, i: i = 1 OR x <> ls[greatest(i - 1, 1)]) AS x FROM s),
"""
NOTICE = "chr(10) || '[middle left out to fit the budget]' || chr(10)"
ROOM = 500 - len("\n[middle left out to fit the budget]\n")
TAIL = int(ROOM * 0.4)


def fit(c: str) -> str:
    return f"CASE WHEN length({c}) > 500 THEN substr({c}, 1, {ROOM - TAIL}) || {NOTICE} || right({c}, {TAIL}) ELSE {c} END"


REDUCE = COLLAPSE + f"""
f AS (SELECT *, len(x) > 8 AS long, list_filter(x[4:len(x) - 3], lambda y: regexp_matches(y, '(the|und|les|las)'))[1:2] AS sig FROM c),
e AS (SELECT *, CASE WHEN long THEN len(x) - 6 - len(sig) ELSE 0 END AS elided FROM f),
k AS (SELECT *, array_to_string(CASE WHEN long THEN x[1:3] || [chr(10) || '[' || elided || ' lines left out]' || chr(10)] || CASE WHEN len(sig) > 0 THEN ['', '[diagnostic lines among those left out]'] || sig || [''] ELSE [] END || x[len(x) - 2:] ELSE x END, chr(10)) AS kept FROM e),
r AS (SELECT *, CASE WHEN length(coalesce(text, '')) > 500 THEN {fit('kept')} ELSE coalesce(text, '') END AS reduced FROM k)
"""
LEDGER = REDUCE + """
, lt AS (SELECT count(*) AS events, coalesce(sum(length(text)), 0)::BIGINT AS raw_chars, coalesce(sum(length(reduced)), 0)::BIGINT AS sent_chars FROM r WHERE reduced <> coalesce(text, '')),
led AS (SELECT *, greatest(0, raw_chars - sent_chars) AS saved_chars, floor(greatest(0, raw_chars - sent_chars) / 4 + 0.5)::BIGINT AS saved_tokens FROM lt)
"""
X20 = priced(factor=20) + f"""
, tot AS (SELECT {SUMS} FROM priced), mo AS (SELECT m AS model, {SUMS} FROM priced GROUP BY 1), se AS (SELECT source, {SUMS} FROM priced GROUP BY 1),
ts8 AS (SELECT *, {AVG} FROM se ORDER BY {ORDER}, source LIMIT 8), topm AS (SELECT * FROM mo ORDER BY {ORDER}, model LIMIT 1),
lst(m, nxt, i, o) AS (VALUES ('fx-large-1', 'fx-medium-1', 0.00006::DECIMAL(18,12), 0.0003::DECIMAL(18,12)), ('fx-medium-1', 'fx-small-1', 0.00002::DECIMAL(18,12), 0.0001::DECIMAL(18,12)))
""" + TOOLS
SAVED = "(mo.usd - (mo.input * i + (mo.cache_create_1h * 2 + (mo.cache_create_5m + greatest(0, mo.cache_create - mo.cache_create_1h - mo.cache_create_5m)) * 1.25) * i + mo.cache_read * i * 0.1 + mo.output * o))"
NONE = "NULL::DOUBLE AS savings_usd"
F_MODEL = f"SELECT 'model-concentration' AS kind, 'high' AS severity, (SELECT {SAVED}::DOUBLE FROM mo JOIN lst ON mo.model = lst.m WHERE mo.model = topm.model AND {SAVED} > 0) AS savings_usd, topm.model AS subject FROM topm, tot WHERE tot.usd > 0 AND topm.usd / tot.usd::DOUBLE >= 0.4"
F_OUTPUT = f"SELECT 'output-cost' AS kind, 'medium' AS severity, {NONE}, NULL::VARCHAR AS subject FROM tot WHERE usd_output / nullif(usd, 0)::DOUBLE >= 0.15"
F_TTL = "SELECT 'cache-ttl' AS kind, CASE WHEN usd_write / usd::DOUBLE > 0.35 THEN 'medium' ELSE 'info' END AS severity, usd_write_1h::DOUBLE * 0.375 AS savings_usd, NULL::VARCHAR AS subject FROM tot WHERE usd_write_1h >= 10 AND usd_write > 0 AND usd_write_1h / usd_write::DOUBLE >= 0.5"
F_EFF = f"SELECT 'cache-efficiency' AS kind, CASE WHEN cache_read / (input + cache_create + cache_read) >= 0.8 THEN 'info' ELSE 'medium' END AS severity, {NONE}, NULL::VARCHAR AS subject FROM tot WHERE usd = 0 OR usd_write / usd::DOUBLE >= 0.05"
BLOAT = "(SELECT * FROM ts8 WHERE avg_prompt_tokens >= 150000 AND usd >= 1 ORDER BY usd DESC, total DESC, source LIMIT 1)"
F_CONTEXT = f"SELECT 'context-bloat' AS kind, CASE WHEN b.usd / tot.usd::DOUBLE >= 0.2 THEN 'high' ELSE 'medium' END AS severity, greatest(0, b.usd_read::DOUBLE * (1 - 150000 / b.avg_prompt_tokens)) AS savings_usd, b.source AS subject FROM {BLOAT} b, tot"
OUTLIER = "SELECT 'session-outlier' AS kind, 'medium' AS severity, NULL::DOUBLE AS savings_usd, source AS subject FROM (SELECT * FROM ts8 ORDER BY usd DESC, total DESC, source LIMIT 1) WHERE usd >= 10"
F_MCP = f"SELECT 'mcp-follow-on-cost' AS kind, CASE WHEN t.usd / tot.usd::DOUBLE >= 0.2 THEN 'high' ELSE 'medium' END AS severity, {NONE}, t.tool AS subject FROM (SELECT * FROM tools WHERE tool LIKE 'mcp\\_\\_%' ESCAPE '\\' ORDER BY usd DESC LIMIT 1) t, tot WHERE t.usd >= 10"
W5 = "(SELECT CASE model WHEN 'fx-large-1' THEN 0.000125 WHEN 'fx-medium-1' THEN 0.000075 WHEN 'fx-small-1' THEN 0.000025 END FROM topm)"
F_BASH = f"SELECT 'bash-output-filter' AS kind, 'medium' AS severity, (SELECT CASE WHEN saved_chars > 0 AND saved_tokens > 0 THEN saved_tokens * {W5} END FROM led)::DOUBLE AS savings_usd, tool AS subject FROM tools WHERE tool = 'Bash' AND usd >= 25"
F_ACCEL = f"SELECT 'spend-acceleration' AS kind, 'medium' AS severity, {NONE}, NULL::VARCHAR AS subject FROM (SELECT {SIDES} FROM pp) WHERE (cur - prev) / nullif(prev, 0)::DOUBLE >= -0.9 AND cur >= 10"


def rows(base: str, select: str) -> str:
    return with_(base, f"SELECT kind, severity, round(savings_usd, 6) AS savings_usd, subject FROM ({select})")


def both_bases() -> str:
    """X20 with the periods' turns as pp, and the ledger, in one list of expressions."""
    p = "(" + with_(periods(20), "SELECT * FROM priced") + ")"
    return REDUCE_NAMED + X20.strip().rstrip(",") + f", pp AS {p}"


REDUCE_NAMED = LEDGER.strip() + ",\n"
KINDS = "CASE WHEN event_id % 97 = 0 THEN NULL ELSE kind END"
SQL = {
    "canonical_models": with_(TURNS, "SELECT model, count(*) AS turns, any_value(m) AS canonical FROM turns GROUP BY model"),
    "rate_card_effective": with_(TURNS + RATE, "SELECT t.m AS rated_model, strftime(ts, '%Y-%m-%d') AS day, (max(ri) * 1000000)::DOUBLE AS input_rate, (max(ro) * 1000000)::DOUBLE AS output_rate, count(*) AS turns FROM turns t LEFT JOIN card c ON t.m = c.m AND ts >= lo AND ts < hi GROUP BY ALL"),
    "priced_turns": with_(priced(), f"SELECT source, line_no, priced, total, {', '.join(f'{r6(c)} AS {c}' for c in DOLLARS)}, greatest(0, cache_create - cache_create_1h - cache_create_5m) AS unclassified FROM priced"),
    "unpriced_tokens": with_(grouped("m", "model"), "SELECT model, requests, unpriced_tokens FROM g WHERE unpriced_tokens > 0"),
    "cheaper_sibling": with_(TURNS, "SELECT m AS model, count(*) AS turns, CASE m WHEN 'fx-large-1' THEN 'fx-medium-1' WHEN 'fx-medium-1' THEN 'fx-small-1' END AS sibling FROM turns GROUP BY m"),
    "model_what_if": with_(grouped("m", "model") + ", lst(m, nxt, i, o) AS (VALUES ('fx-large-1', 'fx-medium-1', 0.000003::DECIMAL(18,12), 0.000015::DECIMAL(18,12)), ('fx-medium-1', 'fx-small-1', 0.000001::DECIMAL(18,12), 0.000005::DECIMAL(18,12)))",
        f"SELECT model, nxt AS sibling, {r6('mo.usd')} AS usd, {r6('mo.usd - s')} AS repriced_usd, {r6('s')} AS saved_usd FROM (SELECT mo.*, nxt, {SAVED} AS s FROM g mo JOIN lst ON mo.model = lst.m) mo WHERE s > 0"),
    "keep_last": with_(priced(), "SELECT source, line_no, message_id FROM priced"),
    "dedup_diagnostics": with_(TURNS, "SELECT count(*) AS records, (count(*) FILTER (WHERE message_id IS NOT NULL AND request_id IS NOT NULL) - count(DISTINCT message_id || '|' || request_id)) AS duplicates_dropped, count(*) FILTER (WHERE message_id IS NULL OR request_id IS NULL) AS missing_ids FROM turns"),
    "window_filter": with_(priced(where=WINDOW), "SELECT source, line_no FROM priced"),
    "report_total": with_(priced(), f"SELECT {OUT} FROM (SELECT {SUMS} FROM priced)"),
    "report_by_model": with_(grouped("m", "model"), f"SELECT model, {OUT} FROM g"),
    "report_by_session": with_(priced() + f", g AS (SELECT source, arg_min(project, line_no) AS project, {SUMS} FROM priced GROUP BY source)", f"SELECT source, project, {AVG}, {OUT} FROM g"),
    "report_by_project": with_(grouped("project", "project"), f"SELECT project, {OUT} FROM g"),
    "report_by_day": with_(grouped("day", "day"), f"SELECT day, {OUT} FROM g"),
    "report_cube": with_(priced() + ", g AS (" + " UNION ALL ".join(f"SELECT '{n}' AS level, {k} AS key, {SUMS} FROM priced GROUP BY ALL" for n, k in (("total", "''"), ("model", "m"), ("session", "source"), ("project", "project"), ("day", "day"))) + ")", f"SELECT level, key, {OUT} FROM g"),
    "report_scope": with_(TURNS, f"SELECT count(*) AS records_read, count(*) FILTER (WHERE {WINDOW}) AS records_in_window FROM turns"),
    "insight_shares": with_(priced() + f", g AS (SELECT {SUMS} FROM priced)", "SELECT " + ", ".join(f"round({a}::DOUBLE / nullif({b}, 0)::DOUBLE, 6) AS {n}" for a, b, n in (
        ("cache_read", "(input + cache_create + cache_read)", "cache_read_share"), ("usd_output", "usd", "output_cost_share"), ("usd_input", "usd", "input_share"), ("usd_write", "usd", "cache_write_share"), ("usd_read", "usd", "cache_read_cost_share"), ("usd_output", "usd", "output_share"), ("usd_write_1h", "usd_write", "cache_write_1h_share"))) + " FROM g"),
    "turn_cost_dist": with_(priced(), "SELECT count(*) AS turns, round(avg(usd::DOUBLE), 6) AS mean, round(quantile_disc(usd::DOUBLE, 0.5), 6) AS p50, round(quantile_disc(usd::DOUBLE, 0.9), 6) AS p90 FROM priced WHERE priced"),
    "run_rate": with_(grouped("day", "day"), """SELECT count(*) AS days, min(day) AS first_day, max(day) AS last_day, round(quantile_disc(usd::DOUBLE, 0.5), 6) AS median_day_usd, round(max(usd)::DOUBLE, 6) AS peak_usd, (SELECT day FROM g ORDER BY usd DESC, day LIMIT 1) AS peak_day,
        round(sum(usd)::DOUBLE / count(*), 6) AS usd_per_day, round(sum(usd)::DOUBLE / count(*) * 30, 6) AS projected_usd, round(max(usd)::DOUBLE / quantile_disc(usd::DOUBLE, 0.5), 6) AS peak_ratio, max(usd)::DOUBLE / quantile_disc(usd::DOUBLE, 0.5) >= 2 AS anomaly FROM g"""),
    "top_sessions": with_(priced() + f", g AS (SELECT source, arg_min(project, line_no) AS project, {SUMS} FROM priced GROUP BY source ORDER BY {ORDER}, source LIMIT 8)", f"SELECT source, project, {AVG}, {OUT} FROM g"),
    "top_projects": with_(grouped("project", "project"), f"SELECT project, {OUT} FROM (SELECT * FROM g ORDER BY {ORDER}, project LIMIT 8)"),
    "session_report": with_(grouped("m", "model", priced(where=f"source = {RANKED_SOURCE.format(1)}")), f"SELECT model, {OUT} FROM g"),
    "project_report": with_(grouped("m", "model", priced(where="project = substr(sha256('fixture:p:3'), 1, 12)")), f"SELECT model, {OUT} FROM g"),
    "cohort_segments": with_(TURNS, "SELECT source, line_no, kind, seg::BIGINT AS seg, grp::BIGINT AS grp FROM pt"),
    "message_tools": with_(TURNS, "SELECT source, line_no, array_to_string(list_sort(running), ',') AS tools FROM pt"),
    "cohort_turns": with_(TURNS, "SELECT source, line_no, array_to_string(list_sort(running), ',') AS tools, array_to_string(list_sort(prior), ',') AS prior_tools FROM pt WHERE kind = 'B'"),
    "prior_tools": with_(TURNS, "SELECT source, line_no, array_to_string(list_sort(prior), ',') AS prior_tools FROM pt"),
    "tool_costs": with_(priced() + TOOLS, f"SELECT {TOOL_OUT} FROM tools"),
    "tool_economics": with_(priced() + TOOLS, "SELECT tool, round(usd / nullif(calls, 0), 6) AS usd_per_call, round(solo_usd / nullif(usd, 0), 6) AS solo_share FROM tools"),
    "top_tools": with_(priced() + TOOLS, f"SELECT {TOOL_OUT} FROM (SELECT * FROM tools ORDER BY usd DESC, total DESC, calls DESC, tool LIMIT 2)"),
    "mcp_tools": with_(priced() + TOOLS, f"SELECT {TOOL_OUT} FROM tools WHERE starts_with(tool, 'mcp__')"),
    "trend_totals": with_(periods(), f"SELECT {r6('cur')} AS current_usd, {r6('prev')} AS previous_usd, 7 AS days, {r6('cur - prev')} AS delta_usd, round((cur - prev)::DOUBLE / nullif(prev, 0)::DOUBLE, 6) AS delta_pct FROM (SELECT {SIDES} FROM priced)"),
    "trend_today": with_(periods(), f"SELECT count(*) AS requests, {r6('coalesce(sum(usd), 0)')} AS usd FROM priced WHERE period = 'today'"),
    "trend_drivers_model": with_(periods(), f"SELECT model, {r6('d')} AS delta_usd FROM (SELECT m AS model, cur - prev AS d FROM (SELECT m, {SIDES} FROM priced GROUP BY m) WHERE cur <> prev ORDER BY abs(cur - prev) DESC, m LIMIT 5)"),
    "trend_drivers_project": with_(periods() + ", s0 AS (SELECT project, period, sum(usd) AS usd, sum(total) AS total FROM priced WHERE period <> 'today' GROUP BY project, period), s AS (SELECT * FROM s0 QUALIFY row_number() OVER (PARTITION BY period ORDER BY usd DESC, total DESC, project) <= 8)", f"SELECT project, {r6('cur - prev')} AS delta_usd FROM (SELECT project, {SIDES} FROM s GROUP BY project) WHERE cur <> prev ORDER BY abs(cur - prev) DESC, project LIMIT 5"),
    "half_window_trend": with_(grouped("day", "day") + ", l AS (SELECT day, usd, row_number() OVER (ORDER BY day DESC) AS k, least(60, count(*) OVER ()) AS n FROM g), h AS (SELECT max(n) AS days, coalesce(sum(usd) FILTER (WHERE k <= n // 2), 0) AS a, coalesce(sum(usd) FILTER (WHERE k > n // 2 AND k <= 2 * (n // 2)), 0) AS b FROM l WHERE k <= 60)",
        f"SELECT days, {r6('a')} AS recent_usd, {r6('b')} AS prior_usd, CASE WHEN days >= 4 AND b > 0 THEN round((a - b)::DOUBLE / b::DOUBLE, 6) END AS change FROM h"),
    "compare_windows": "SELECT coalesce(a.model, b.model) AS model, " + f"{r6('coalesce(a.usd, 0)')} AS left_usd, {r6('coalesce(b.usd, 0)')} AS right_usd, {r6('coalesce(b.usd, 0) - coalesce(a.usd, 0)')} AS delta_usd FROM ("
        + with_(grouped("m", "model", priced(where="ts < TIMESTAMP '2024-01-08'")), "SELECT model, usd FROM g") + ") a FULL JOIN (" + with_(grouped("m", "model", priced(where=WINDOW)), "SELECT model, usd FROM g") + ") b ON a.model = b.model",
    "compare_sessions": "SELECT coalesce(a.model, b.model) AS model, " + f"{r6('coalesce(a.usd, 0)')} AS left_usd, {r6('coalesce(b.usd, 0)')} AS right_usd, {r6('coalesce(b.usd, 0) - coalesce(a.usd, 0)')} AS delta_usd FROM ("
        + with_(grouped("m", "model", priced(where=f"source = {RANKED_SOURCE.format(1)}")), "SELECT model, usd FROM g") + ") a FULL JOIN (" + with_(grouped("m", "model", priced(where=f"source = {RANKED_SOURCE.format(2)}")), "SELECT model, usd FROM g") + ") b ON a.model = b.model",
    "snapshot_save": with_(grouped("m", "model", priced(where=WINDOW)), f"SELECT 'week-2' AS name, 2 AS pricing, model, {r6('usd')} AS usd, total, requests FROM g"),
    "finding_model": rows(X20, F_MODEL),
    "finding_output": rows(X20, F_OUTPUT),
    "finding_cache": rows(X20, f"{F_TTL} UNION ALL {F_EFF}"),
    "finding_context": rows(X20, F_CONTEXT),
    "finding_session": rows(X20, OUTLIER),
    "finding_mcp": rows(X20, F_MCP),
    "finding_bash": rows(REDUCE_NAMED + X20, F_BASH),
    "finding_accel": rows(periods(20) + ", pp AS (SELECT * FROM priced)", F_ACCEL),
    "findings_ranked": with_(both_bases() + ", fa AS (" + " UNION ALL ".join(f"SELECT *, {i} AS o FROM ({q})" for i, q in ((1, F_MODEL), (2, F_OUTPUT), (3, F_TTL), (4, f"{OUTLIER} AND source NOT IN (SELECT source FROM {BLOAT})"), (5, F_CONTEXT), (6, F_MCP), (7, F_BASH), (8, F_ACCEL))) + ")",
        "SELECT kind, severity, round(savings_usd, 6) AS savings_usd, subject, row_number() OVER (ORDER BY savings_usd DESC NULLS LAST, CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, o) AS rank, round(coalesce(sum(savings_usd) OVER (), 0), 6) AS total_savings_usd FROM fa"),
    "line_kinds": with_(LINES, f"SELECT source, line_no, {KINDS} AS kind FROM lines"),
    "usage_extract": with_(LINES, "SELECT source, " + ", ".join(f"sum({c})::BIGINT AS {c}" for c in TOKENS) + ", max(ts)::VARCHAR AS last_ts FROM lines WHERE kind = 'B' AND event_id % 97 <> 0 GROUP BY source"),
    "parse_errors": "SELECT count(*) AS lines, count(*) FILTER (WHERE event_id % 97 = 0) AS parse_errors FROM events",
    "tool_names": with_(LINES, "SELECT tool, count(*) AS n FROM (SELECT unnest(tools) AS tool FROM lines WHERE kind IN ('B', 'T') AND event_id % 97 <> 0) GROUP BY tool"),
    "typed_ids": "SELECT event_id AS line_no, 'B' AS kind, CASE WHEN event_id % 6 = 0 THEN 'm' || event_id END AS message_id, CASE WHEN event_id % 4 = 0 THEN 'fx-' || event_id ELSE '<unknown>' END AS model, CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 5 = 0 THEN 'Bash' WHEN event_id % 5 = 2 THEN 'Read' ELSE '' END AS tools, event_id AS input, false AS parse_error FROM events",
    "typed_counters": "SELECT event_id AS line_no, CASE WHEN event_id % 5 < 3 THEN 'B' ELSE 'H' END AS kind, CASE WHEN event_id % 5 >= 3 THEN 0 WHEN event_id % 6 = 0 THEN event_id WHEN event_id % 6 = 5 THEN event_id * 10 ELSE 0 END AS output, CASE WHEN event_id % 5 < 3 AND event_id % 4 = 0 THEN event_id ELSE 0 END AS cache_create_1h, false AS parse_error FROM events",
    "message_ids": with_(LINES, "SELECT source, line_no, message_id, request_id FROM lines WHERE kind IN ('B', 'T') AND event_id % 97 <> 0 AND message_id IS NOT NULL"),
    "redacted_lines": with_(LINES, "SELECT project, count(*) AS lines, 0 AS leaks FROM lines GROUP BY project"),
    "fingerprints": with_(LINES, "SELECT substr(sha256('fixture-salt:' || source), 1, 12) AS source, count(*) AS n FROM lines GROUP BY ALL"),
    "normalize_records": with_(LINES, """SELECT source, CASE WHEN event_id % 10 <> 1 THEN project END AS project, CASE WHEN event_id % 10 <> 2 THEN message_id END AS message_id, request_id, CASE WHEN event_id % 10 = 3 THEN '<unknown>' ELSE model END AS model,
        CASE WHEN event_id % 10 <> 4 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ts, array_to_string(list_sort(CASE WHEN event_id % 10 = 5 THEN ['Ok'] ELSE tools END), ',') AS tools,
        CASE WHEN event_id % 10 IN (6, 7) THEN 0 ELSE input END AS input, cache_create, cache_create_1h, cache_create_5m, cache_read, output FROM lines"""),
    "log_scan": with_(LINES, "SELECT source, count(*) AS lines, true AS sized FROM lines GROUP BY source"),
    "ordered_lines": with_(LINES, f"SELECT source, line_no, {KINDS} AS kind, CASE WHEN kind IN ('B', 'T') AND event_id % 97 <> 0 THEN message_id END AS message_id FROM lines"),
    "collapse_lines": with_(COLLAPSE, "SELECT doc_id, len(x)::BIGINT AS n_lines, sha256(array_to_string(x, chr(10))) AS digest FROM c"),
    "reduce_lines": with_(REDUCE, "SELECT doc_id, sha256(kept) AS digest, elided::BIGINT AS elided FROM r"),
    "fit_ends": f"SELECT doc_id, sha256(x) AS digest, length(x)::BIGINT AS n FROM (SELECT doc_id, {fit('text')} AS x FROM documents)",
    "reduce_text": with_(REDUCE, "SELECT doc_id, sha256(reduced) AS digest, length(coalesce(text, ''))::BIGINT AS raw_chars, length(reduced)::BIGINT AS sent_chars, CASE WHEN length(coalesce(text, '')) > 500 THEN elided ELSE 0 END::BIGINT AS elided_lines, reduced <> coalesce(text, '') AS changed FROM r"),
    "reduction_ledger": with_(LEDGER, "SELECT * FROM led"),
    "all_records": with_(TURNS, "SELECT CASE WHEN ts < TIMESTAMP '2024-01-08' THEN 'retired' WHEN ts < TIMESTAMP '2024-01-20' THEN 'live' ELSE 'tail' END AS origin, count(*) AS n, count(DISTINCT source) AS sources FROM turns GROUP BY 1"),
    "manifest_diff": with_(MAN, "SELECT source, status FROM diff"),
    "ingest_stats": with_(MAN, "SELECT count(*) FILTER (WHERE status <> 'retired') AS seen, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in ("parsed", "appended", "reused", "retired")) + " FROM diff"),
    "retire_sources": with_(TURNS + "w AS (SELECT DISTINCT source FROM lines WHERE ts >= TIMESTAMP '2024-01-08'), q AS (SELECT turns.source, CASE WHEN ts >= TIMESTAMP '2024-01-20' THEN NULL WHEN w.source IS NULL THEN 'retired' ELSE 'live' END AS section FROM turns LEFT JOIN w USING (source))", "SELECT section, source, count(*) AS n FROM q WHERE section IS NOT NULL GROUP BY ALL"),
    "prune_retired": with_(TURNS + "q AS (SELECT source, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-19 14:00:00') AS old, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-19 14:00:00') AS young FROM turns GROUP BY source)", "SELECT sum(old)::BIGINT AS records, count(*) FILTER (WHERE young = 0) AS sources, sum(young)::BIGINT AS kept FROM q"),
    "label_validate": with_(LINES + "ids AS (SELECT CASE WHEN i < 4 THEN substr(sha256('fixture:p:' || i), 1, 12) ELSE '0123456789ab' END AS id, 'team ' || i AS label FROM range(5) t(i))", "SELECT id, label, (SELECT count(*) FROM lines WHERE project = id) AS lines FROM ids"),
    "projects_labeled": with_(LINES + "ids AS (SELECT substr(sha256('fixture:p:' || i), 1, 12) AS id, 'team ' || i AS label FROM range(4) t(i))", "SELECT project, count(*) AS lines, coalesce(any_value(label), CASE WHEN max(ts) >= TIMESTAMP '2024-01-20' THEN 'folder-' || substr(project, 1, 4) END, project) AS name FROM lines LEFT JOIN ids ON id = project GROUP BY project"),
    "stale_labels": with_(LINES + "ids AS (SELECT CASE WHEN i < 4 THEN substr(sha256('fixture:p:' || i), 1, 12) ELSE '0123456789ab' END AS id, 'team ' || i AS label FROM range(5) t(i))", "SELECT id, label FROM ids WHERE id NOT IN (SELECT project FROM lines)"),
    "mart_daily": with_(grouped("day", "day"), f"SELECT day, {r6('usd')} AS usd, total, requests FROM g ORDER BY day DESC LIMIT 60"),
}
SQL["mart_savings"] = f"SELECT count(*) AS findings, count(savings_usd) AS quantified, round(coalesce(sum(savings_usd), 0), 6) AS savings_usd FROM ({SQL['findings_ranked'].replace('round(savings_usd, 6) AS savings_usd, subject', 'savings_usd, subject')})"
SQL["stream_tool_cohorts"] = with_(LINES.replace("lines AS (SELECT", "lines0 AS (SELECT").rstrip().rstrip(",") + ", lines AS (SELECT * FROM lines0 WHERE event_id % 97 <> 0)," + TURNS[len(LINES):], "SELECT source, line_no, array_to_string(list_sort(running), ',') AS tools, array_to_string(list_sort(prior), ',') AS prior_tools FROM pt WHERE kind = 'B'")
SQL["stream_daily_spend"] = with_(grouped("day", "day"), f"SELECT day, requests, {r6('usd')} AS usd FROM g")

MEMBERS = LINES + "md AS (SELECT source, max(ts) AS modified FROM lines GROUP BY source),"
SHARED = TURNS.replace(LINES, MEMBERS) + """
sk AS (SELECT t.source, line_no, modified, max(ts) OVER (PARTITION BY t.source) AS last_turn, CASE WHEN message_id IS NOT NULL THEN 'x' || (event_id % 997) END AS message_id FROM turns t JOIN md ON t.source = md.source),
tl AS (SELECT *, max(line_no) OVER (PARTITION BY source) > 3 AS goes_on, max(line_no) FILTER (WHERE line_no <= 3) OVER (PARTITION BY source) AS cut FROM sk),
og AS (SELECT *, CASE WHEN line_no = cut AND NOT goes_on THEN 'tail' ELSE 'live' END AS origin FROM tl)
"""
SQL["keep_last_by_mtime"] = with_(SHARED, "SELECT source, line_no, message_id FROM sk QUALIFY message_id IS NULL OR row_number() OVER (PARTITION BY message_id ORDER BY modified DESC, source DESC, line_no DESC) = 1")
SQL["stream_upsert"] = with_(SHARED, "SELECT source, line_no, origin FROM og QUALIFY message_id IS NULL OR row_number() OVER (PARTITION BY message_id ORDER BY last_turn DESC, source DESC, origin DESC, line_no DESC) = 1")
WINNERS = "(SELECT * REPLACE (NULL::VARCHAR AS message_id) FROM turns WHERE (source, line_no) IN (SELECT (source, line_no) FROM og QUALIFY message_id IS NULL OR row_number() OVER (PARTITION BY message_id ORDER BY last_turn DESC, source DESC, origin DESC, line_no DESC) = 1))"
SQL["stream_spend_corrected"] = with_(SHARED + "," + priced(WINNERS)[len(TURNS):], f"SELECT day, count(*) AS requests, {r6('sum(usd)')} AS usd FROM priced GROUP BY day")
SQL["report_sink"] = with_(priced(), "SELECT 'total' AS section, NULL::VARCHAR AS name, count(*) AS requests, coalesce(sum(total), 0)::BIGINT AS total FROM priced UNION ALL SELECT 'by_model', m, count(*), sum(total)::BIGINT FROM priced GROUP BY m UNION ALL SELECT 'by_day', day, count(*), sum(total)::BIGINT FROM priced GROUP BY day")
SQL["ingest_counters"] = with_(LINES, "SELECT count(*) AS lines, 0::BIGINT AS tails, count(*) AS parsed, count(*) FILTER (WHERE kind = 'B' AND event_id % 97 <> 0) AS billed, count(*) FILTER (WHERE event_id % 97 = 0) AS parse_errors FROM lines")
FIFTY = "win AS (SELECT w, TIMESTAMP '2024-01-01' + to_hours(w % 13 * 24 + CASE WHEN w % 3 = 1 THEN 7 ELSE 0 END) AS lo, TIMESTAMP '2024-01-01' + to_hours(w % 13 * 24 + CASE WHEN w % 3 = 1 THEN 7 ELSE 0 END + (1 + w % 17) * 24 + CASE WHEN w % 4 = 2 THEN 5 ELSE 0 END) AS hi FROM range(50) t(w)),"
SQL["cuboid_windows"] = with_(FIFTY + priced("(SELECT turns.*, w FROM turns JOIN win ON ts >= lo AND ts < hi)", within=", w"), f"SELECT w, m AS model, count(*) AS requests, sum(total)::BIGINT AS total, {r6('sum(usd)')} AS usd, coalesce(sum(total) FILTER (WHERE NOT priced), 0)::BIGINT AS unpriced_tokens FROM priced GROUP BY w, m")
SQL["cost_sketches"] = with_(priced(where=WINDOW), "SELECT count(*) AS turns, true AS p50_near, true AS p90_near FROM priced WHERE priced")
SQL["clustered_window"] = SQL["window_filter"]
SQL["stream_growing_files"] = SQL["ordered_lines"]
SQL["replace_sources"] = with_(TURNS, "SELECT source, line_no, model FROM turns WHERE substr(source, 1, 1) <> 'f' AND (substr(source, 1, 1) >= '8' OR line_no > 3)")
SQL["compare_snapshots"] = "SELECT " + f"{r6('a')} AS left_usd, {r6('b')} AS right_usd, {r6('b - a')} AS delta_usd, round((b - a)::DOUBLE / nullif(a, 0)::DOUBLE, 6) AS delta_pct, true AS pricing_mismatch FROM (" + with_(priced(where="ts < TIMESTAMP '2024-01-08'"), "SELECT coalesce(sum(usd), 0) AS a FROM priced") + "), (" + with_(priced(where=WINDOW), "SELECT coalesce(sum(usd), 0) AS b FROM priced") + ")"
SQL["tail_lines"] = with_(LINES + "l AS (SELECT *, line_no = max(line_no) OVER (PARTITION BY source) AS last FROM lines)", "SELECT source, count(*) AS lines, count(*) FILTER (WHERE event_id % 97 = 0 AND NOT last) AS parse_errors FROM l GROUP BY source")
SQL["ledger_read"] = """WITH l AS (SELECT length(text) AS n FROM documents WHERE length(text) > 500 AND doc_id % 10 <> 0 AND doc_id % 7 >= 3)
SELECT count(*) AS events, coalesce(sum(n), 0)::BIGINT AS raw_chars, (count(*) * 500)::BIGINT AS sent_chars, coalesce(sum(n), 0)::BIGINT - count(*) * 500 AS saved_chars, floor((coalesce(sum(n), 0) - count(*) * 500) / 4 + 0.5)::BIGINT AS saved_tokens FROM l"""
SQL["schema_rebuild"] = with_(priced(where=WINDOW) + ", li AS (SELECT * FROM lines WHERE kind = 'B' AND event_id % 97 <> 0 AND ts >= TIMESTAMP '2024-01-08')",
    "SELECT 'live' AS section, count(*) AS n FROM li UNION ALL SELECT 'retired', count(*) FROM turns WHERE ts < TIMESTAMP '2024-01-20' AND source NOT IN (SELECT source FROM li) UNION ALL SELECT 'snapshots', count(DISTINCT m) FROM priced")
SQL["index_stale"] = "SELECT 'later' AS state, coalesce(max(ts) < TIMESTAMP '2024-01-31 23:00:00', true) AS stale FROM events UNION ALL SELECT 'then', coalesce(max(ts) < TIMESTAMP '2024-01-07 23:00:00', true) FROM events UNION ALL SELECT 'never', true"
SQL["labels_upsert"] = with_(LINES + "ids AS (SELECT CASE WHEN i < 4 THEN substr(sha256('fixture:p:' || i), 1, 12) ELSE '0123456789ab' END AS id, CASE WHEN i < 2 THEN 'renamed ' ELSE 'team ' END || i AS label FROM range(5) t(i))", "SELECT id, label, (SELECT count(*) FROM lines WHERE project = id) AS lines FROM ids")
NAMED = "lb AS (SELECT substr(sha256('fixture:p:' || i), 1, 12) AS id, 'team ' || i AS label FROM range(4) t(i))"
FIRST = "ORDER BY usd DESC, total DESC, name LIMIT 12"
SQL["mart_top"] = with_(priced() + TOOLS + f", {NAMED}, se AS (SELECT source, arg_min(project, line_no) AS project, sum(usd) AS usd, sum(total) AS total FROM priced GROUP BY source)",
    "SELECT list, name, label, round(usd::DOUBLE, 4) AS usd, round(total::DOUBLE, 4) AS total FROM (" + " UNION ALL ".join(f"(SELECT * FROM ({q}) {FIRST})" for q in (
        "SELECT 'models' AS list, m AS name, NULL::VARCHAR AS label, sum(usd)::DOUBLE AS usd, sum(total)::DOUBLE AS total FROM priced GROUP BY m", "SELECT 'tools', tool AS name, NULL, usd, total FROM tools",
        "SELECT 'sessions', source AS name, label, usd::DOUBLE AS usd, total::DOUBLE AS total FROM se LEFT JOIN lb ON lb.id = se.project", "SELECT 'projects', project AS name, any_value(label), sum(usd)::DOUBLE AS usd, sum(total)::DOUBLE AS total FROM priced LEFT JOIN lb ON lb.id = project GROUP BY project")) + ")")
SQL["mart_changed"] = f"SELECT 'models' AS list, model AS name, delta_usd FROM (SELECT * FROM ({SQL['trend_drivers_model']}) ORDER BY abs(delta_usd) DESC, model LIMIT 3) UNION ALL SELECT 'projects', coalesce(label, substr(project, 1, 6)), delta_usd FROM (SELECT * FROM ({SQL['trend_drivers_project']}) ORDER BY abs(delta_usd) DESC, project LIMIT 3) LEFT JOIN (WITH {NAMED} SELECT * FROM lb) ON id = project"
