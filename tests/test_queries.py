"""Every registered query against its SQL on the smallest tables."""

from collections import Counter

import pytest

from tokenledger.plans.oracle import SQL
from tokenledger.plans.queries import QUERIES

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
# A cross-section in reach of a short run; the driver compares all of them at a larger scale.
FEW = ["report_by_model", "priced_turns", "report_cube", "keep_last", "prior_tools", "tool_costs", "trend_drivers_project", "findings_ranked", "line_kinds", "ordered_lines", "reduce_text", "collapse_lines", "reduce_lines", "fit_ends", "reduction_ledger", "manifest_diff", "stream_tool_cohorts", "stream_growing_files", "ingest_counters", "report_sink", "run_rate",
       "compare_snapshots", "tail_lines", "ledger_read", "schema_rebuild", "index_stale", "labels_upsert", "mart_top", "mart_changed", "mart_savings", "turn_cost_dist"]
# Stateful and keyed ones, at a scale where keys repeat.
KEYED = ["stream_upsert", "keep_last_by_mtime", "replace_sources", "cohort_turns", "typed_ids", "typed_counters", "stream_spend_corrected", "cuboid_windows", "cost_sketches"]


def test_each_query_has_sql():
    assert set(QUERIES) == set(SQL)


def same(spark, duck, name, folder):
    df = QUERIES[name](spark, folder)
    cur = duck.execute(SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    plain = lambda r: tuple(float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r)
    assert Counter(plain([r[c] for c in cols]) for r in df.collect()) == Counter(map(plain, cur.fetchall()))


@pytest.mark.parametrize("name", FEW)
def test_against_sql(spark, duck, name):
    same(spark, duck, name, SF)


@pytest.mark.parametrize("name", KEYED)
def test_against_sql_where_keys_repeat(spark, duck_larger, name):
    same(spark, duck_larger, name, LARGER)
