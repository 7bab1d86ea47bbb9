"""The pipeline's stages against brute force."""

import random

import sentencepiece

import corpus_pipeline
from tokenledger.llm import decontaminate, minhash
from tokenledger.llm.common import stage

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "x", len(t)) for d, t in rows], DOC)


def near_copies(seed=4):
    """Texts of 200 words, each with copies of 3 to 6 changed words: similarities of 0.73 to 0.86."""
    rng = random.Random(seed)
    rows = []
    for g in range(12):
        base = [f"g{g}w{rng.randrange(10**6)}" for _ in range(200)]
        rows.append((100 * g, " ".join(base)))
        for k in (3, 4, 5, 6):
            rows.append((100 * g + k, " ".join(f"new{k}x{i}" if i % 30 == 10 + k and i < 30 * k else w for i, w in enumerate(base))))
    return rows


def similarity(a, b):
    a, b = set(minhash.shingles(a).tolist()), set(minhash.shingles(b).tolist())
    return len(a & b) / len(a | b) if a | b else 0.0


def kept_by_brute_force(rows):
    comp = {d: d for d, _ in rows}
    for d, t in rows:
        for e, u in rows:
            if d < e and comp[d] != comp[e] and similarity(t, u) >= 0.8:
                a, b = sorted((comp[d], comp[e]))
                comp = {x: a if c == b else c for x, c in comp.items()}
    return {d for d, c in comp.items() if d == c}


def test_near_dedup_takes_copies_from_080_on(spark):
    rows = near_copies()
    between = [s for d, t in rows for e, u in rows if d < e for s in [similarity(t, u)] if 0.8 <= s < 0.85]
    assert len(between) >= 12
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, frame(spark, rows), "").collect()}
    assert got == kept_by_brute_force(rows) and len(got) < len(rows)


ITEM = "the gardener carried seven heavy baskets across the old stone bridge before the morning rain began to fall on the quiet village houses while children watched from every open window and laughed about it"
SHARED = "This line of the footer stands in several of the documents"


def corpus():
    """English prose in a few words, with shared lines, near copies and an edited passage of the benchmark."""
    rng = random.Random(7)
    words = "the of and house garden water morning street children old green small river walked found between people never small would their mountain letter window because after story city light friend winter summer bread table".split()
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, f"{text(120)}\n{SHARED if i % 3 == 0 else text(8)}\n{text(60)}") for i in range(40)]
    for i in range(6):  # copies with 4 changed words of 188
        copy = rows[i][1].split(" ")
        for at in (10, 50, 90, 150):
            copy[at] = "window" if copy[at] != "window" else "river"
        rows.append((100 + i, " ".join(copy)))
    edited = " ".join("some" if i % 8 == 7 else w for i, w in enumerate(ITEM.split()))
    rows += [(200, f"{text(60)} {ITEM} {text(60)}"), (201, f"{text(60)} {edited} {text(60)}"), (202, f"{text(60)} {' '.join(ITEM.split()[:12])} {text(60)}"), (203, f"{text(40)} {ITEM[:100]} {text(30)} {ITEM[100:]}")]
    return [*rows, (300, ""), (301, None), (302, "0 1 2 3 4 5 6 7 8 9")]


def without_repeated_lines(rows):
    """Keys of 20 characters or more in 3 documents or more stay in the largest doc_id alone, as op10's SQL has it."""
    rows, holders = list(rows), {}
    key = lambda line: line.strip(" ").lower()
    for d, t in rows:
        for line in t.split("\n"):
            holders.setdefault(key(line), set()).add(d)
    goes = lambda d, k: len(k) >= 20 and len(holders[k]) >= 3 and d != max(holders[k])
    return {d: "\n".join(x for x in t.split("\n") if not goes(d, key(x))) for d, t in rows}


def best_score(text):
    """Local alignment of ITEM with all of text, cell by cell."""
    item, span = ITEM.split(), decontaminate.words_of(text)
    row, best = [0.0] * (len(span) + 1), 0.0
    for w in item:
        new = [0.0]
        for j, v in enumerate(span, 1):
            new.append(max(0.0, row[j - 1] + (1 if w == v else -0.1), row[j] - 0.1, new[-1] - 0.1))
        row, best = new, max(best, *new)
    return best / len(item)


def test_run_and_stages_equal_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame([(d, t, "en", "x", len(t or "")) for d, t in rows], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got, docs = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, str(tmp_path)), name)
        got[name] = {r.doc_id: r for r in docs.collect()}
    want = {d: t for d, t in rows if d < 300}
    assert {d: r.text for d, r in got["language_id"].items()} == want
    want = without_repeated_lines(want.items())
    assert {d: (r.text, r.n_chars) for d, r in got["line_dedup"].items()} == {d: (t, len(t)) for d, t in want.items()}
    assert sum(SHARED in t for t in want.values()) == 1
    kept = kept_by_brute_force(list(want.items()))
    assert set(got["near_dedup"]) == kept
    clean = {d for d in kept if best_score(want[d]) < 0.8}
    assert set(got["decontamination"]) == clean and kept - clean == {200, 201, 203}
    sp = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    last = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert last == got["sentencepiece"] and set(last) == clean
    assert {d: r.n_tokens for d, r in last.items()} == {d: len(sp.encode(want[d], add_eos=True)) for d in clean}


def test_odd_rows_and_empty_tables(spark, tmp_path):
    rng = random.Random(3)
    words = "the of and house garden water morning street children old green small river walked found between people never would their".split()
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    twice = text(90)
    rows = [(1, twice), (1, twice), (2, twice), (None, f"{text(70)} {ITEM} {text(50)}"), (None, text(90)), (None, None), (3, None), (4, ""), (5, text(40_000)), (6, "the"), (7, f"{text(9)}\n\n")]
    frame_ = spark.createDataFrame([(d, t, None if i % 2 else "en", None, None, "extra", i) for i, (d, t) in enumerate(rows)], DOC + ", kept string, mark int")
    frame_.write.parquet(f"{tmp_path}/odd/documents.parquet")
    frame_.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/odd/benchmark.parquet")
    items.limit(0).write.parquet(f"{tmp_path}/none/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    columns = list(corpus_pipeline.COLUMNS)
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, f"{tmp_path}/odd"), name)
        assert docs.columns == columns or name == "sentencepiece"
    # copies of one id are one document and stay together; of the rows without an id the contaminated one goes
    assert sorted(r.doc_id or 0 for r in docs.collect()) == [0, 1, 1, 5, 6, 7]
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
