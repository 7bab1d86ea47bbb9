"""Steps that many queries share: how often their input is made and sorted, and results against plain code."""

import random
import re
from datetime import timedelta

from pyspark.sql import functions as F

from tests.test_cuboid import rows_of
from tests.test_rules import TURN, T, turn
from tokenledger.llm import common, minhash
from tokenledger.operators import attribution, cuboid, dedup, pricing, report
from tokenledger.plans import fixtures as fx
from tokenledger.streaming.ingest import spend_by_day, upsert_with_spend

LINE = "source string, line_no long, kind string, message_id string, tools array<string>"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keep_last_makes_its_input_once(spark, tmp_path):
    """F8, F9: the rows without ids were a second branch, which made all turns again."""
    rows = [turn(i, "m", T(2024, 1, 1), (0,) * 6, "ab"[i % 2], mid, "r") for i, mid in enumerate(["k", "k", None, "", None, "l"])]
    spark.createDataFrame(rows, TURN).write.parquet(str(tmp_path / "t"))
    kept = dedup.keep_last(spark.read.parquet(str(tmp_path / "t")))
    assert plan_of(kept).split("+- == Initial")[0].count("FileScan") == 1
    assert sorted(r.load_seq for r in kept.collect()) == [1, 2, 3, 4, 5]


def test_billed_turns_sort_their_lines_twice(spark):
    """F8, F9: a task held a sort for the segments, one for the groups and one for the tools at once."""
    plan = plan_of(attribution.billed_turns(spark.createDataFrame([], LINE)))
    assert len(re.findall(r"\bSort \[", plan.split("+- == Initial")[0])) == 2


def test_groups_are_numbered_within_segments(spark):
    rng = random.Random(4)
    rows = [(s, i, rng.choice("BBBTRRH"), rng.choice([None, "x", "x", "y"]), []) for s in "abc" for i in range(200)]
    want = {}
    for s in "abc":
        seg, grp, last, open_ = 0, 0, None, False
        for _, i, kind, message, _ in (r for r in rows if r[0] == s):
            if kind == "H":
                seg, grp, open_ = seg + 1, 0, False
            elif kind in "BT":
                if not (open_ and message is not None and message == last):
                    grp += 1
                last, open_ = message, True
                want[s, i] = (seg, grp)
    got = attribution.cohort_segments(spark.createDataFrame(rows, LINE)).select("source", "line_no", "seg", F.col("grp").cast("long")).collect()
    assert {(r.source, r.line_no): (r.seg, r.grp) for r in got} == want


def test_many_windows_shuffle_a_row_once(spark):
    """a row went through the shuffle and the sort by key once for each window that holds it."""
    rows = rows_of(random.Random(6))
    paid = pricing.price(spark.createDataFrame(rows, f"{TURN}, modified bigint"), fx.card(spark), fx.alias(spark)).cache()
    parts = [x.cache() for x in cuboid.build(paid)]
    bounds = [(i, T(2024, 1, 1) + timedelta(hours=7 * (i % 30)), T(2024, 1, 2) + timedelta(hours=11 * (i % 23))) for i in range(cuboid.BITS + 10)]
    windows = spark.createDataFrame([b for b in bounds if b[1] < b[2]], "w long, since timestamp, until timestamp")
    cells = cuboid.windows_of(*parts, windows)
    assert not re.search(r"hashpartitioning\([^)]*\bw#", plan_of(cells))
    sums = lambda df: {(r.w, r.model_key): (r.requests, r.total, r.usd) for r in cuboid.rolled(df, "w", "model_key").collect()}
    got = sums(cells)
    assert sums(cuboid.windows_of(*parts, windows, ["model_key"])) == got
    held = paid.join(windows, (paid.ts >= windows.since) & (paid.ts < windows.until))
    want = report.keyed(dedup.keep_last(held, "w")).groupBy("w", "model_key").agg(F.count("*").alias("n"), F.sum("total").alias("total"), F.sum("usd").alias("usd"))
    assert got == {(r.w, r.model_key): (r.n, r.total, r.usd) for r in want.collect()}


def test_a_batch_taken_in_is_not_made_again(spark, tmp_path):
    """a batch that ran again was written out before it was found to be known."""
    rows = [(*turn(i, "fx-small-1", T(2024, 1, 1), (1,) * 6, "a", "k", "r"), T(2024, 1, 2)) for i in range(3)]
    batch = spark.createDataFrame(rows, f"{TURN}, modified timestamp")
    write = upsert_with_spend(str(tmp_path / "t"), lambda x: pricing.price(x, fx.card(spark), fx.alias(spark)))
    write(batch, 0)
    write(batch.withColumn("source", F.raise_error(F.lit("made again")).cast("string")), 0)
    assert [r.requests for r in spend_by_day(spark, str(tmp_path / "t")).collect()] == [1]


def test_near_dedup_hands_texts_over_in_small_batches(spark, monkeypatch, tmp_path):
    """pipeline, near_dedup: batches of 10,000 whole texts were held by executor and worker."""
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", str(tmp_path / "seen")
    plain = minhash.sets

    def counted(docs, full):
        def run(batches):
            for b in batches:
                with open(seen, "a") as f:
                    f.write(f"{len(b)}\n")
                yield b

        return plain(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text string"), full)

    monkeypatch.setattr(minhash, "sets", counted)
    before = spark.conf.get(key)
    docs = spark.range(6000).coalesce(1).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of a text "), (F.col("id") % 3000).cast("string")).alias("text"))
    found = minhash.near_duplicates(docs)
    assert found.where("kept").count() == 3000
    with open(seen) as f:
        sizes = [int(x) for x in f]
    assert sum(sizes) >= 6000 and max(sizes) <= common.BATCH_ROWS
    assert spark.conf.get(key) == before


def test_prefixes_take_one_python_worker_a_task(spark):
    """pipeline, near_dedup: sets and their prefixes were two Python nodes of one stage, so each task took two workers, which an executor then kept."""
    draw = random.Random(4)
    texts = {i: " ".join(draw.choices("abcdef", k=draw.randint(1, 60))) for i in range(40)}
    whole = {i: minhash.shingles(t).view("int64").tolist() for i, t in texts.items()}
    often = sorted({s for x in whole.values() for s in x})[::3]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = minhash._prefixes(docs, 85, spark.createDataFrame([(s,) for s in often], "token long"))
    assert plan_of(found).split("+- == Initial")[0].count("MapInArrow") == 1
    expected = {(i, len(x), at, s) for i, x in whole.items() for at, s in enumerate(sorted(x, key=lambda s: (s in often, s))[: len(x) - -(-len(x) * 85 // 100) + 1])}
    assert {tuple(r) for r in found.collect()} == expected
