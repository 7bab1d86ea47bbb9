"""Windows from the base cuboid against keep-last over the turns of each."""

import random
from collections import Counter
from datetime import timedelta

from pyspark.sql import functions as F

from tests.test_rules import TURN, T, turn
from tokenledger.operators import cuboid, dedup, pricing, report
from tokenledger.plans import fixtures as fx
from tokenledger.sources import logs

MODELS = ["fx-large-1", "fx-medium-1", "fx-small-1", "unpriced-1"]


def rows_of(rng, n=400):
    out = []
    for i in range(n):
        at = None if rng.random() < 0.05 else T(2024, 1, 1) + timedelta(hours=rng.randrange(24 * 12), minutes=rng.choice([0, 0, 30]))
        mid = rng.choice([None, "", *[f"k{rng.randrange(60)}"] * 6])
        origin = rng.choice(["live", "live", "live", "retired", "tail"])
        out.append((*turn(i, rng.choice(MODELS), at, tuple(rng.randrange(10**6) for _ in range(6)), rng.choice("abc"), mid, "r", origin), rng.randrange(3)))
    return out


def summed(rows):
    return Counter((r.model_key, r.requests, r.total, round(float(r.usd), 6), r.unpriced_tokens) for r in rows)


def test_windows_equal_keep_last_inside_each(spark):
    rng = random.Random(8)
    paid = pricing.price(spark.createDataFrame(rows_of(rng), f"{TURN}, modified bigint"), fx.card(spark), fx.alias(spark)).cache()
    parts = [x.cache() for x in cuboid.build(paid)]
    bounds = [(None, None), (T(2024, 1, 3), None), (None, T(2024, 1, 5, 13)), (T(2024, 1, 3), T(2024, 1, 6)), (T(2024, 1, 3, 4), T(2024, 1, 3, 9)), (T(2024, 1, 2, 4), T(2024, 1, 3, 9)), (T(2024, 1, 4), T(2024, 1, 4, 0, 30)), (T(2023, 1, 1), T(2025, 1, 1)), (T(2024, 1, 9), T(2024, 1, 9))]
    windows = spark.createDataFrame([(i, *b) for i, b in enumerate(bounds)], "w long, since timestamp, until timestamp")
    got = cuboid.cost_quantiles(cuboid.rolled(cuboid.windows_of(*parts, windows), "w", "model_key")).collect()
    for i, (since, until) in enumerate(bounds):
        kept = dedup.keep_last(dedup.in_window(paid, since, until))
        want = report.by_model(kept).withColumnRenamed("model", "model_key").collect()
        assert summed(r for r in got if r.w == i) == summed(want), bounds[i]
    for r in got:
        assert (r.turns == r.requests and r.p50 <= r.p90) if r.model_key != "unpriced-1" else (r.turns == 0 and r.p50 is None)
    assert parts[1].count() > 50 and cuboid.rolled(cuboid.windows_of(*parts, windows.limit(0)), "w").count() == 0
    nothing = [x.limit(0) for x in parts]
    assert cuboid.windows_of(*nothing, windows).count() == 0


def test_whole_days_read_no_turns(spark, tmp_path):
    paid = pricing.price(spark.createDataFrame(rows_of(random.Random(3)), f"{TURN}, modified bigint"), fx.card(spark), fx.alias(spark))
    cells, crossing, turns = cuboid.build(paid)
    turns.write.partitionBy("day").parquet(str(tmp_path / "turns"))
    stored = spark.read.parquet(str(tmp_path / "turns")).withColumn("day", F.col("day").cast("string"))
    plan = lambda *w: cuboid.windows_of(cells, crossing, stored, spark.createDataFrame([w], "w long, since timestamp, until timestamp"))._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan(0, T(2024, 1, 2), T(2024, 1, 5))
    cut = plan(0, T(2024, 1, 2, 5), T(2024, 1, 5))
    assert "FileScan" in cut and "2024-01-02" in cut.split("PartitionFilters")[1][:200]


def test_stored_records_are_deduplicated_in_place(spark, tmp_path):
    rows = spark.createDataFrame(rows_of(random.Random(5)), f"{TURN}, modified bigint")
    stored = logs.write_clustered(rows, "clustered_records_test", str(tmp_path / "t"), 4)
    try:
        window = (T(2024, 1, 3, 4), T(2024, 1, 6))
        for since, until in (window, (None, None), (None, window[1])):
            got = dedup.keep_last(logs.clustered_window(stored, since, until))
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "Bucketed: true" in plan
            want = dedup.keep_last(dedup.in_window(rows, since, until))
            text = lambda df: Counter(str(tuple(r)) for r in df.select(rows.columns).collect())
            assert text(got) == text(want)
        assert "day" in dedup.keep_last(logs.clustered_window(stored, *window))._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:200]
    finally:
        spark.sql("drop table clustered_records_test")
