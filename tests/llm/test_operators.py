"""The corpus operators on small inputs against brute force, and on odd rows: nulls, empty and long texts, ties, repeats, no rows."""

import collections
import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenledger.llm import crf_language, decontaminate, line_dedup, minhash, nn_descent, pieces, suffix_dedup, url_filter, weak_quality
from tokenledger.llm.components import components

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DOC = "doc_id long, text string, lang string, score string, n string"


def docs(spark, rows):
    """Documents with extra columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, "en", "x", "y") for i, t in rows], DOC)


ODD = [(1, None), (2, ""), (3, "one"), (4, "same words again and again here"), (4, "same words again and again here"), (None, "no id at all"), (5, "x" * 300_000), (6, "\n\n"), (7, "same words again and again here")]


def test_url_rules(spark):
    rows = [(1, "http://a.b.org/x"), (2, "https://Example.ORG/es/a?q"), (3, "https://w.example.org/en/17#t"), (4, "http://x.com/de/"), (5, "http://x.com/fr/de/"), (6, "nothing"), (7, None), (8, "http://org"), (9, "http://borg/"), (10, "http://x.net/a"), (1, "http://a.b.org/x")]
    pages = spark.createDataFrame([(i, u, "old") for i, u in rows], "page_id long, url string, verdict string")
    want = {1: ("org/", "allow"), 2: ("example.org/es/", "block"), 3: ("example.org/en/1", "block"), 4: ("com/de/", "block"), 5: ("com/fr/", "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: (None, "allow"), 9: (None, "allow"), 10: (None, "allow")}
    for limit in (100, 1):  # by trie, and by join
        got = url_filter.filter_urls(pages, max_trie_rules=limit).collect()
        assert len(got) == 11 and {r.page_id: (r.rule, r.verdict) for r in got} == want
    assert url_filter.filter_urls(pages.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "http://x.com/de/" + "y" * 300_000), (2, "http://" + "a." * 5000 + "com/fr/")], "page_id long, url string")
    assert [r.verdict for r in url_filter.filter_urls(long).orderBy("page_id").collect()] == ["block", "allow"]
    many = [("block", "x.com", f"/p{i}") for i in range(3000)] + [("allow", "x.com", "/p1234/in")]
    some = spark.createDataFrame([(1, "http://x.com/p1234/in"), (2, "http://x.com/p1234/out"), (3, "http://x.com/q")], "page_id long, url string")
    for limit in (10_000, 1):
        assert [(r.rule, r.verdict) for r in url_filter.filter_urls(some, many, max_trie_rules=limit).orderBy("page_id").collect()] == [("x.com/p1234/in", "allow"), ("x.com/p1234", "block"), (None, "allow")]


def test_line_dedup(spark):
    line = "A line of more than twenty characters"
    rows = [(1, f"{line}\nkeep"), (2, f"  {line.upper()} \nshort"), (3, f"{line}\n{line}"), (4, "short\nshort"), *ODD]
    got = {(r.doc_id, r.text): line_dedup.kept_text(r.text, r.keep) for r in line_dedup.with_bitmaps(docs(spark, rows)).collect()}
    assert got[(1, rows[0][1])] == (2, 1, "keep") and got[(2, rows[1][1])] == (2, 1, "short") and got[(3, rows[2][1])] == (2, 0, rows[2][1])
    assert got[(1, None)] == (1, 0, "") and got[(None, "no id at all")][1] == 0
    assert line_dedup.with_bitmaps(docs(spark, rows)).count() == len(rows) and line_dedup.with_bitmaps(docs(spark, []).select("doc_id", "text")).count() == 0


def test_long_texts_and_ties_of_lines(spark):
    many = "\n".join(f"line number {i % 1000} of a very long text" for i in range(60_000))
    rows = [(1, many), (2, many), (3, many), (3, many), (4, "a line of its own, and " + "x" * 300_000)]
    got = [line_dedup.kept_text(r.text, r.keep) for r in line_dedup.with_bitmaps(docs(spark, rows).withColumn("keep", F.lit(1))).orderBy("doc_id").collect()]
    assert [g[:2] for g in got] == [(60_000, 60_000), (60_000, 60_000), (60_000, 0), (60_000, 0), (1, 0)] and got[2][2] == many


def test_hot_line_over_many_tasks(spark):
    hot = "the very same line in every one of the documents"
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit(hot + "\nown line number "), F.col("id").cast("string"), F.lit(" is long")).alias("text"))
    drops = line_dedup.dropped_lines(df)
    assert drops.count() == 1999 and drops.agg(F.max("doc_id")).first()[0] == 1998


def test_pieces_equal_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab  \t\n▁éß漢🙂<s>\x00") for _ in range(rng.randint(0, 90))) for _ in range(500)]
    texts += ["ab" * 900, "a" * 3000, " " * 99, "", None, "  two", "<s></s><unk><0x0A>", "aaab" * 300]
    v = pieces.Vocabulary(MODEL)
    for t, ids in zip(texts, v.encode(texts), strict=True):
        assert ids.tolist() == sp.encode(t or "", add_eos=True) and v.decode(ids) == sp.decode(ids.tolist())
    out = pieces.encode_decode(docs(spark, ODD), model=MODEL).collect()
    assert pieces.digests(docs(spark, []), MODEL).count() == 0 and pieces.encode_decode(docs(spark, []), model=MODEL).count() == 0
    assert len(out) == len(ODD) and all(r.ids == sp.encode(r.text or "", add_eos=True) and r.decoded == (r.text or "") for r in out)


def test_minhash_equals_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    base = [rng.choice(words) for _ in range(200)]
    rows = [(i, passage + " " + " ".join(rng.choice(words) for _ in range(20))) for i in range(100, 180)]
    for i in range(60):
        x = list(base)
        for _ in range(rng.randint(1, 6)):
            x[rng.randrange(200)] = f"new{i}-{rng.random()}"
        rows.append((200 + i, " ".join(x)))
    rows += [(9, " ".join(base)), (8, " ".join(base)), (1, None), (2, ""), (3, "one"), (4, "ONE"), (5, "x" * 99_999)]
    sets = {d: set(minhash.shingles(t).tolist()) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    prefixes = minhash._prefixes
    for most in (1000, 0):  # common shingles by broadcast, and by join
        monkeypatch.setattr(minhash, "_prefixes", lambda d, p, c, most=most: prefixes(d, p, c, most))
        got = minhash.near_duplicates(docs(spark, [*rows, rows[0], (None, "no id")]), short=6).collect()
        assert {r.doc_id: r.component_id for r in got} == {d: find(d) for d in sets} and len(got) == len(sets)
        assert {r.doc_id: r.n_shingles for r in got} == {d: len(s) for d, s in sets.items()}
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (9, 1), (7, 8), (8, 8), (None, 1), (5, 4)], "a long, b long")
    assert {r.id: r.component for r in components(links).collect()} == {1: 1, 3: 1, 4: 1, 5: 1, 9: 1, 7: 7, 8: 7}
    assert components(links.limit(0)).count() == 0


def test_crf_posteriors_and_rows(spark):
    rng = np.random.default_rng(0)
    model = crf_language.Crf(["a", "b", "c"], np.zeros((crf_language.TABLE, 3), np.float32), rng.normal(size=(3, 3)))
    lengths = np.array([1, 64, 65, 300, 2])
    scores = rng.normal(size=(lengths.sum(), 3)) * 3
    q, at = model.posteriors(scores, lengths), 0
    a = np.exp(model.transitions)
    for n in lengths:
        e = np.exp(scores[at : at + n])
        f, b = [np.ones(3) @ a * e[0]], [np.ones(3)]
        for t in range(1, n):
            f.append((f[-1] / f[-1].sum()) @ a * e[t])
        for t in range(n - 1, 0, -1):
            x = a @ (e[t] * b[-1])
            b.append(x / x.sum())
        p = np.array(f) * np.array(b[::-1])
        assert np.allclose(q[at : at + n], p / p.sum(1, keepdims=True))
        at += n
    rows = [(i, ("the house and the garden " if i % 2 else "das haus und der garten ") * 9, "en" if i % 2 else "de", None) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    crf = crf_language.train(df)
    got = crf_language.identify(df, crf).collect()
    assert all(r.lang_pred == r.lang and 0.9 < r.score <= 1 for r in got)
    odd = crf_language.identify(docs(spark, [(1, None), (2, "12 !?"), (3, ""), (4, "x" * 50_000), (None, "the")]), crf).collect()
    assert [r.lang_pred for r in odd[:3]] == ["und"] * 3 and odd[0].score == 0 and odd[3].lang_pred in ("en", "de")
    mixed = crf.posteriors(crf.emissions("the house das haus".split()), np.array([4]))
    assert mixed.argmax(1).tolist() == [1, 1, 0, 0] or mixed[0, 1] > mixed[3, 1]
    assert crf_language.train(df.limit(0)) is None and crf_language.identify(df, None).where("lang_pred <> 'und'").count() == 0


def test_crf_sees_whole_words_and_letters_only(spark):
    assert crf_language.words_of("a½b ²x Ⅷ c3d é_ö 漢字") == ["a", "b", "x", "c", "d", "é", "ö", "漢字"] and crf_language.words_of("½ ² Ⅷ 3 _") == []
    one, two = "x" * 30 + "middle" + "y" * 30, "x" * 30 + "muddle" + "y" * 30
    slots = lambda w: set(crf_language.features([w])[1].tolist())
    assert slots(one) != slots(two) and slots(one) == set(crf_language.features(["a", one, "b" * 3000])[1][crf_language.features(["a", one, "b" * 3000])[0] == 1].tolist())
    for w in ("a", "ab", "abcd"):
        word, slot = crf_language.features([w])
        n = len(w)
        assert len(slot) == n + (n + 1) + n + 2 * sum(n + 2 > k + 1 for k in (1, 2, 3)) + 1  # 1-, 2-, 3-grams with ends, affixes, word
    rows = [(i, ("the house and the garden " if i % 2 else "das haus und der garten ") * 9, "en" if i % 2 else "de") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    crf = crf_language.train(df)
    odd = spark.createDataFrame([(1, "the house and the garden das haus und der garten", "x"), (2, None, "x"), (3, "½ 12", "x")], "doc_id long, text string, stretches string")
    got = {r.doc_id: [(s.lang, s.words) for s in r.stretches] for r in crf_language.switches(odd, crf).collect()}
    assert got == {1: [("en", "the house and the garden"), ("de", "das haus und der garten")], 2: [], 3: []}
    assert {r.lang_pred for r in crf_language.identify(odd, crf).where("doc_id > 1").collect()} == {"und"}


def test_all_of_a_sample_text_teaches(spark):
    late = " ".join(["filler"] * 5000 + ["zebra"] * 50)
    rows = [(i, late if i % 2 else "filler " * 5050 + "quagga " * 50, "en" if i % 2 else "de") for i in range(40)]
    crf = crf_language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = crf.posteriors(crf.emissions(["zebra", "quagga"]), np.array([1, 1]))
    assert crf.labels == ["de", "en"] and got[0, 1] > 0.5 > got[1, 1]


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = crf_language.identify(df, crf_language.train(df)).where(crf_language.held_out(F.col("doc_id")))
    assert out.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.98


def test_decontamination(spark):
    rng = random.Random(5)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    items = [(1, text(40)), (2, text(30)), (3, "only three words"), (4, None), (5, ""), (6, text(900))]
    edited = items[1][1].split()
    edited[7], edited[20] = "other", "changed"
    rows = [(1, text(50) + " " + items[0][1].upper() + " " + text(50)), (2, text(20) + " " + " ".join(edited)), (3, text(300)), (4, "with only three words in it"), (5, " ".join(items[0][1].split()[:15])), (6, None), (7, ""), (8, items[5][1]), (None, items[0][1])]
    got = {r.doc_id: r.item_id for r in decontaminate.contaminated(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 4: 3, 8: 6, None: 1}
    assert decontaminate.align(np.array([1, 2, 3, 4]), [np.array([9, 1, 2, 7, 3, 4]), np.array([4, 3, 2, 1])]).round(3).tolist() == [0.975, 0.25]
    assert decontaminate.contaminated(docs(spark, rows), spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert decontaminate.contaminated(docs(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_short_items_count_only_where_they_are_the_text(spark):
    items = spark.createDataFrame([(1, "the"), (2, "four words of text")], "item_id long, text string")
    rows = [(i, f"the {i} other words of the text") for i in range(50)] + [(90, "The!"), (91, "four words of text"), (92, "so four words of text, and so on"), (93, "so long before four words of text come")]
    got = {r.doc_id: r.item_id for r in decontaminate.contaminated(docs(spark, rows), items).collect()}
    assert got == {90: 1, 91: 2, 92: 2, 93: 2}


def plain_score(item, span):
    """Smith-Waterman cell by cell."""
    row, best = [0.0] * (len(span) + 1), 0.0
    for w in item:
        new = [0.0]
        for j, v in enumerate(span, 1):
            new.append(max(0.0, row[j - 1] + (1 if w == v else -0.1), row[j] - 0.1, new[-1] - 0.1))
        row, best = new, max(best, *new)
    return best / len(item)


def test_decontamination_equals_brute_force(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
    given, items = read("documents").select("doc_id", "text"), read("benchmark").select("item_id", "text")
    tests = [(r.item_id, decontaminate.words_of(r.text)) for r in items.collect()]
    bags = [collections.Counter(w) for _, w in tests]
    want = {}
    for r in given.collect():
        ws = decontaminate.words_of(r.text)
        bag, seen = collections.Counter(ws), {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}
        for (item, w), b in zip(tests, bags, strict=True):
            # only such pairs can reach the threshold, or have a seed
            if sum((b & bag).values()) >= 0.8 * len(w) - 1e-9 and any(tuple(w[i : i + 5]) in seen for i in range(len(w) - 4)):
                score = plain_score(w, ws)
                if score >= 0.8 - 1e-9:
                    want.setdefault(r.doc_id, {})[item] = score
    got = {r.doc_id: (r.item_id, round(r.score, 6), r.n_items) for r in decontaminate.contaminated(given, items).collect()}
    best = {d: max(x.items(), key=lambda kv: (round(kv[1], 9), -kv[0])) for d, x in want.items()}
    assert got == {d: (i, round(s, 6), len(want[d])) for d, (i, s) in best.items()} and len(got) >= 3


def test_rows_of_one_id_or_none_are_judged_apart(spark):
    item = " ".join(f"unusual{i}" for i in range(30))
    df = docs(spark, [(1, item), (1, "all clean"), (None, item), (None, "clean too"), (2, None)])
    left = decontaminate.clean(df, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(r.text or "" for r in left.collect()) == ["", "all clean", "clean too"] and left.columns == df.columns


def test_hot_item_is_not_called_common(spark):
    item = " ".join(f"unusual{i}" for i in range(30))
    rows = [(i, f"own{i} {item} end") for i in range(400)]
    assert decontaminate.contaminated(docs(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string")).count() == 400


def test_edited_copies_in_many_documents(spark):
    item = [f"unusual{i}" for i in range(39)]
    edited = " ".join("other" if i % 7 == 6 else w for i, w in enumerate(item))  # 0.859; a third of the seeds stay
    rows = [(i, f"own{i} {edited} end") for i in range(300)] + [(i, " ".join(item)) for i in range(300, 320)] + [(999, "a " + " ".join(item[:20]))]
    got = decontaminate.contaminated(docs(spark, rows), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert {r.doc_id: round(r.score, 3) for r in got} == {i: 0.859 if i < 300 else 1.0 for i in range(320)}


def test_copies_with_long_insertions(spark):
    item = [f"w{i}" for i in range(39)]
    rows, want = [], {}
    for d, (at, n) in enumerate([(20, 20), (20, 30), (19, 77), (20, 79), (8, 60), (33, 40)]):
        copy = [*item[:at], *(f"x{i}" for i in range(n)), *item[at:]]
        full = decontaminate.align(np.arange(39), [np.array([int(w[1:]) if w[0] == "w" else -1 for w in copy])])[0]
        rows += [(d, "so " * 300 + " ".join(copy) + " end" * 300), (100 + d, " ".join(copy))]
        want |= {d: round(full, 3), 100 + d: round(full, 3)} if full >= 0.8 else {}
    got = decontaminate.contaminated(docs(spark, rows), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert {r.doc_id: round(r.score, 3) for r in got} == want and len(want) == 10 and want[1] == 0.923


def test_long_items_are_whole(spark):
    rng = random.Random(8)
    text = lambda n: [f"w{rng.randrange(9999)}" for _ in range(n)]
    one, two = [*text(400), "the"], text(2000)
    near = [w for i, w in enumerate(two) if i % 9]  # (1777 - 22.3) / 2000
    rows = [(1, "all the others"), (2, " ".join(one)), (3, " ".join(two[400:800])), (4, " ".join(near)), (5, " ".join(two[:1500])), (6, " ".join(["some", *one[:390]]))]
    items = spark.createDataFrame([(1, " ".join(one)), (2, " ".join(two))], "item_id long, text string")
    want = {2: (1, 1.0), 4: (2, 0.877), 6: (1, 0.973)}
    for chars in (decontaminate.BLOCK_CHARS, 3000):
        got = decontaminate.contaminated(docs(spark, rows), items, block_chars=chars).collect()
        assert {r.doc_id: (r.item_id, round(r.score, 3)) for r in got} == want


def test_quality(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    labels = df.select("doc_id", "quality").distinct()
    got = weak_quality.classify(df).join(labels, "doc_id")
    kept = {r[0]: r[1] for r in got.groupBy("quality").agg(F.avg(F.col("keep").cast("int"))).collect()}
    assert kept[1] > 0.98 and kept[0] < 0.15
    odd = weak_quality.classify(docs(spark, ODD)).collect()
    assert len(odd) == len(ODD) and weak_quality.classify(docs(spark, [])).count() == 0


def plain_em(votes, doubt):
    """The weak-label model document by document."""
    n, m = len(votes), len(votes[0])
    post = [0.1 if min(v) < 0 else 0.9 for v in votes]
    rate = [sum(v[k] < 0 for v in votes) / max(1, sum(v[k] != 0 for v in votes)) for k in range(m)]
    for _ in range(300):
        good = (sum(post) + 1) / (n + 2)
        accuse = []
        for k in range(m):
            q = []
            for weight in ([1 - p for p in post], post):
                bad_votes = sum(w for w, v in zip(weight, votes, strict=True) if v[k] < 0) + 0.5
                good_votes = sum(w for w, v in zip(weight, votes, strict=True) if v[k] > 0) + 0.5
                q.append(bad_votes / (bad_votes + good_votes))
            accuse.append((q[0], min(q[1], doubt * rate[k] + 1e-9)))
        new = []
        for v in votes:
            odds = [1 - good, good]
            for k, x in enumerate(v):
                for y in (0, 1):
                    odds[y] *= 1 if not x else accuse[k][y] if x < 0 else 1 - accuse[k][y]
            new.append(odds[1] / (odds[0] + odds[1]))
        done = max(abs(a - b) for a, b in zip(new, post, strict=True)) < 1e-7
        post = new
        if done:
            break
    return post, good


def test_em_equals_plain_em():
    rng = random.Random(2)
    bad = [rng.random() < 0.2 for _ in range(400)]
    votes = [tuple(rng.choice([0, -1, -1, 1]) if b and rng.random() < 0.7 else (-1 if rng.random() < 0.01 else rng.choice([1, 1, 0])) for _ in range(4)) for b in bad]
    counts = collections.Counter(votes)
    post, good, _ = weak_quality.expectation_maximisation(np.array(list(counts)), np.array(list(counts.values()), float))
    of, (want, share) = dict(zip(counts, post, strict=True)), plain_em(votes, weak_quality.DOUBT)
    assert np.allclose([of[v] for v in votes], want, atol=1e-6) and good == pytest.approx(share) and 0.7 < good < 0.9
    assert np.mean([(of[v] < 0.5) == b for v, b in zip(votes, bad, strict=True)]) > 0.9


def test_copies_teach_once_and_odd_rows_have_scores(spark):
    texts = [f"the house number {i} stands in the old garden near the river and the bridge" if i % 3 else "BUY NOW!!! BUY NOW!!! $$$ ### |||" + str(i) for i in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)]
    one, many = (docs(spark, rows + [rows[1]] * k).select("doc_id", "text", F.lit("x").alias("score"), F.lit(1).alias("keep")) for k in (0, 300))
    fitted = [weak_quality.fit(df, 10_000) for df in (one, one.repartition(7))]
    assert np.array_equal(fitted[0][0], fitted[1][0]) and fitted[0][1] == fitted[1][1]
    score = {r.doc_id: r.score for r in weak_quality.classify(many).collect()}
    assert all((score[i] >= 0.5) == (i % 3 > 0) for i in range(300))
    lone = {r.text_: r.score for r in weak_quality.classify(docs(spark, [(None, "some words here")])).withColumn("text_", F.lit("t")).collect()}
    assert lone == {"t": 0.5}
    odd = {r.doc_id: (r.score, r.keep) for r in weak_quality.classify(docs(spark, ODD)).collect()}
    assert odd[1] == odd[2] == odd[6] == (0.0, False)


def brute_removal(rows, n):
    seen = collections.Counter(b[i : i + n] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - n + 1))
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        hit = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                hit[i : i + n] = True
        out[d] = (len(b), int(hit.sum()), int((np.diff(np.r_[0, hit.astype(int)]) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~hit])).hexdigest())
    return out


@pytest.mark.parametrize("n, core", [(400, 250), (60, 30), (20, 20)])
def test_suffix_dedup(spark, n, core):
    rng = random.Random(2)
    base = "".join(rng.choice("abcdé ") for _ in range(3000))
    rows = [(1, base[:900]), (2, base[300:1500] + "x" + base[700:1300]), (3, "a" * 1200), (4, "ab" * 700), (5, ""), (6, None), (7, base[100:499] + "q"), (8, base[:400]), (9, "z" * 399), (10, "y" * 400), (11, "w" * 401), (12, base[1000:1800] * 2), (13, "aaab" * 300 + "c" + "aaab" * 150)]
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.digests(docs(spark, rows), n, core).collect()}
    assert got == brute_removal(rows, n)
    base = base.replace("é", "e")
    twice = suffix_dedup.digests(docs(spark, [(1, base[:500]), (1, base[:500]), (None, base[:500])]), 400).collect()
    assert [r.n_removed for r in twice] == [500] * 3
    far = suffix_dedup.digests(docs(spark, [(None, base[:500]), (5, base[:500]), (None, "x" + base[600:1000]), (None, "y" + base[600:1000])]), 400).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in far) == [(0, 400), (0, 400), (0, 500), (5, 500)]
    long = suffix_dedup.digests(docs(spark, [(1, base * 200), (2, "z" + base[100:700])]), 400).collect()
    assert {r.doc_id: (r.n_removed, r.n_spans) for r in long} == {1: (len((base * 200).encode()), 1), 2: (len(base[100:700].encode()), 1)}
    assert suffix_dedup.digests(docs(spark, []), n, core).count() == 0


def test_nn_descent(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(700, 16))
    m[100:400] = m[0] + rng.normal(size=(300, 16)) * 0.05
    m[500:503] = m[499] + rng.normal(size=(3, 16)) * 0.15
    m[600] = m[601]
    rows = [(i, [float(x) for x in np.float32(v)], 1) for i, v in enumerate(m)]
    bad = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [], 1), (904, [None] * 16, 1), (905, [1.0, 2.0], 1), rows[3], (None, rows[0][1], 1)]
    df = spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in nn_descent.near_vectors(df).collect()}
    x = np.float32(m).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.9
    comp = list(range(700))
    for i in range(700):
        for j in np.flatnonzero(near[i]):
            a, b = sorted((comp[i], comp[j]))
            if a != b:
                comp = [a if c == b else c for c in comp]
    want = {i: (int(near[i].sum()) - 1, comp[i]) for i in range(700)}
    assert {i: got[i] for i in range(700)} == want
    assert all(got[i] == (0, i) for i in range(900, 906)) and len(got) == 706
    assert nn_descent.near_vectors(df.limit(0)).count() == 0


def crowd_around(rng, degrees, n):
    """n vectors within some 2 degrees of the direction at degrees in the first plane."""
    a = np.radians(degrees)
    x = rng.normal(size=(n, 16)) * 0.006
    x[:, :2] += np.cos(a), np.sin(a)
    return x


def test_two_crowds_and_one_bridge(spark):
    rng = np.random.default_rng(6)
    at = lambda d: crowd_around(rng, d, 1) * 1.0
    m = np.concatenate([crowd_around(rng, 0, 700), at(6), crowd_around(rng, 36, 700), at(30), crowd_around(rng, 150, 60), rng.normal(size=(100, 16))])
    x = np.float32(m).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.9
    assert near[:701, 701:1402].sum() == near[700, 1401] == 1  # one link joins the first crowd with the second
    ids = 7 + 50 * np.arange(len(m))  # none is audited, so the audit can't tell
    df = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, np.float32(m), strict=True)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in nn_descent.near_vectors(df).collect()}
    assert {got[int(i)].component_id for i in ids[:1402]} == {7} and {got[int(i)].component_id for i in ids[1402:1462]} == {int(ids[1402])}
    assert [got[int(i)].n_links for i in ids] == (near.sum(1) - 1).tolist()


def test_audit_sees_pairs_beside_a_crowd(spark, monkeypatch):
    rng = np.random.default_rng(9)
    lone = rng.normal(size=(20, 16)) * 5
    m = np.concatenate([crowd_around(rng, 40, 400), np.repeat(lone, 2, 0) + rng.normal(size=(40, 16)) * 0.01])
    x = np.float32(m).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    sims = x @ x.T
    ids = np.r_[50 * np.arange(1000, 1400), 7 + np.arange(40)]
    again = np.r_[ids, 50 * np.arange(1, 41)]  # each of the pairs' vectors has a copy with an id that is audited
    asked = []

    def descend(nodes, graph, k, n, threshold, rounds=4, wide=None):  # loses all lone pairs until lists are longer
        if wide is None:
            asked.append(k)
        some = [(int(ids[i]), int(ids[j]), float(sims[i, j])) for i, j in zip(*np.nonzero(sims >= 0.9), strict=True) if i != j and (i < 400 or k > 10)]
        return nn_descent.stage(spark.createDataFrame(some, "u long, v long, sim double"), "fake")

    monkeypatch.setattr(nn_descent, "descend", descend)
    df = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(again, np.float32(np.r_[m, m[400:]]), strict=True)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in nn_descent.near_vectors(df).collect()}
    assert asked == [10, 20]
    assert all(got[7 + i].component_id == 7 + i // 2 * 2 and got[7 + i].n_links == 3 for i in range(40))


def test_recall_is_measured_or_an_error(spark, monkeypatch):
    rng = np.random.default_rng(12)
    lone = np.repeat(rng.normal(size=(30, 16)), 2, 0) + rng.normal(size=(60, 16)) * 0.001
    some = lambda first: spark.createDataFrame([(first + i, [float(v) for v in np.float32(r)], "x", True) for i, r in enumerate(lone)], "vec_id long, embedding array<float>, n_links string, kept boolean")
    out, recall = nn_descent.near_vectors_and_recall(some(301).where("vec_id % 50 <> 0"))  # no id is asked: those with links are
    assert recall == 1.0 and {r.n_links for r in out.where("vec_id <> 349").collect()} == {1}
    far = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(np.eye(16))], "vec_id long, embedding array<float>")
    out, recall = nn_descent.near_vectors_and_recall(far)
    assert recall != recall and out.where("n_links > 0 or not kept").count() == 0  # nothing to measure
    monkeypatch.setattr(nn_descent, "descend", lambda nodes, graph, *a, **k: nn_descent.stage(graph.limit(0), "none"))
    with pytest.raises(RuntimeError):
        nn_descent.near_vectors_and_recall(some(300))


def test_pairs_at_the_threshold_are_judged_alike():
    rng = np.random.default_rng(3)
    a = nn_descent.units(rng.normal(size=(50, 16)))
    cut = float(a[3] @ a[7])
    whole, part = nn_descent.cosines(a, a, cut), nn_descent.cosines(a[:5], a[6:9], cut)
    assert whole[3, 7] == part[3, 1] == whole[7, 3]


def test_link_counts_by_balls(spark):
    rng = np.random.default_rng(8)
    m = np.concatenate([crowd_around(rng, 0, 900), crowd_around(rng, 24, 300), rng.normal(size=(50, 16))])  # links within surely, between crowds in part
    x = np.float32(m).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.9
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(np.float32(m))], "vec_id long, embedding array<float>")
    out, recall = nn_descent.near_vectors_and_recall(df)
    assert {r.vec_id: r.n_links for r in out.collect()} == dict(enumerate((near.sum(1) - 1).tolist())) and recall >= 0.98


def test_whole_module_registers():
    from tokenledger.llm import queries

    assert sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))[0].startswith("op1_") and len(queries.QUERIES) == 13
    assert os.path.exists(MODEL)
