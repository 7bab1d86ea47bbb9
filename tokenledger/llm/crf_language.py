"""Language ID with a linear-chain conditional random field over words.

Words (runs of letters, in lower case) get labels from affix, character n-gram and lexicon
features, all hashed into one weight table, and learned transitions between labels; forward-backward
gives each word's posterior, so code-switched texts show where they switch.  A document's language is that with the
largest mean posterior over all its words, its score that mean.

Training takes a bounded sample: about ``docs_per_lang`` documents a language, chosen by a hash of doc_id among
those that may be learned from; their whole texts teach, cut into windows of ``span`` words.  A fifth of the
windows are spliced with one of another language, from which the transitions learn to switch.
Prediction reads the whole text; long texts are cut into segments whose transfer matrices chain exactly.  Words count with
all their letters, however long.  ``identify`` judges documents, ``switches`` returns the stretches of words in one language.

Null texts and texts without a letter are ``und`` with score 0.  Rows without lang or with a null doc_id
teach nothing; without any row to learn from, everything is ``und``.  Equal posteriors go to the first label
by name; repeated rows are predicted alike; extra columns stay, and clashing ones are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenledger.llm.common import table
from tokenledger.llm.pieces import blocks

#: Runs of characters of Unicode category L.
LETTERS = regex.compile(r"\p{L}+")
DOCS_PER_LANG, SPAN = 250, 32
TABLE, SEGMENT, EPOCHS = 1 << 17, 64, 20
#: Characters of words looked at at once.
CELLS = 1_000_000
#: Words whose emissions a task keeps.
KNOWN = 200_000
UNKNOWN = "und"
_PLACES = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def _alike(words: list[str]) -> Iterator[list[int]]:
    """Numbers of words of about one length, not many more than CELLS characters at a time with their padding."""
    by_size: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_size.setdefault((len(w) + 1).bit_length(), []).append(i)
    for bits, some in by_size.items():
        step = max(1, CELLS >> bits)
        yield from (some[at : at + step] for at in range(0, len(some), step))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, slot of the weight table) of each feature of each word, however long: n-grams, affixes and the word itself."""
    out_word, out_slot = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for some in _alike(words):
        width = max(len(words[i]) for i in some) + 2
        m = np.array([f"^{words[i]}$" for i in some], f"U{width}").view(np.uint32).reshape(len(some), width).astype(np.uint64)
        length = (m > 0).sum(1)
        number, rows = np.array(some), np.arange(len(some))

        def put(kind: int, columns: list[np.ndarray], there: np.ndarray, number=number) -> None:
            h = np.full(columns[0].shape, kind * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
            for c in columns:
                h = (h ^ c) * np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(29)
            r = np.nonzero(there)
            out_word.append(number[r[0]])
            out_slot.append((h[r] % np.uint64(TABLE)).astype(np.int64))

        for n in (1, 2, 3):
            at = np.arange(width - n + 1)
            put(n, [m[:, k : width - n + 1 + k] for k in range(n)], (at + n <= (length - (n == 1))[:, None]) & (at >= (n == 1)))
            put(10 + n, [m[:, min(k, width - 1)] for k in range(1, n + 1)], length > n + 1)  # prefix
            put(20 + n, [m[rows, np.maximum(length - 1 - k, 0)] for k in range(1, n + 1)], length > n + 1)  # suffix
        whole = (m * np.cumprod(np.full(width, _PLACES))).sum(1, dtype=np.uint64)
        put(30, [whole], length > 0)  # lexicon
    return np.concatenate(out_word), np.concatenate(out_slot)


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray  # (TABLE, labels)
    transitions: np.ndarray  # log scores, from row to column

    def emissions(self, words: list[str]) -> np.ndarray:
        word, slot = features(words)
        return np.stack([np.bincount(word, self.weights[slot, lab], len(words)) for lab in range(len(self.labels))], 1).astype(np.float32)

    def posteriors(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Word posteriors; scores: emissions of all documents' words in line; lengths: words of each (none 0)."""
        k = len(self.labels)
        e = np.exp(scores - scores.max(1, keepdims=True)).astype(np.float64)
        a = np.exp(self.transitions - self.transitions.max())
        # Segment s of a document holds its words s * SEGMENT and on; place puts longer segments first,
        # so that those with a word at step t are the first active[t].
        n_seg = -(-lengths // SEGMENT)
        first = np.cumsum(n_seg) - n_seg
        total = int(n_seg.sum())
        within = np.arange(len(scores)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        seg, step = np.repeat(first, lengths) + within // SEGMENT, within % SEGMENT
        size = np.bincount(seg, minlength=total)
        order = np.argsort(-size, kind="stable")
        place = np.empty(total, np.int64)
        place[order] = np.arange(total)
        active = np.searchsorted(-size[order], -np.arange(SEGMENT), "left")
        grid = np.ones((SEGMENT, total, k))
        seg = place[seg]
        grid[step, seg] = e
        # Transfer matrices of the segments of documents that have several
        p = np.broadcast_to(np.eye(k), (total, k, k)).copy()
        if int(n_seg.max()) > 1:
            for t in range(SEGMENT):
                n = active[t]
                x = (p[:n].reshape(-1, k) @ a).reshape(n, k, k) * grid[t, :n, None, :]
                p[:n] = x / x.max((1, 2), keepdims=True) if t % 4 == 3 else x
            p /= p.max((1, 2), keepdims=True)
        # Messages at the segments' ends, all documents at once
        alpha, beta = np.ones((total, k)), np.ones((total, k))
        for s in range(1, int(n_seg.max())):
            d = np.flatnonzero(n_seg > s)
            was = place[first[d] + s - 1]
            x = np.einsum("nk,nkl->nl", alpha[was], p[was])
            alpha[place[first[d] + s]] = x / x.max(1, keepdims=True)
        for s in range(int(n_seg.max()) - 2, -1, -1):
            d = np.flatnonzero(n_seg > s + 1)
            nxt = place[first[d] + s + 1]
            x = np.einsum("nkl,nl->nk", p[nxt], beta[nxt])
            beta[place[first[d] + s]] = x / x.max(1, keepdims=True)
        ahead = np.empty_like(grid)
        for t in range(SEGMENT):
            n = active[t]
            x = (alpha[:n] @ a) * grid[t, :n]
            alpha[:n] = x / x.max(1, keepdims=True) if t % 4 == 3 else x
            ahead[t, :n] = alpha[:n]
        for t in range(SEGMENT - 1, -1, -1):
            n = active[t]
            ahead[t, :n] *= beta[:n]
            x = (grid[t, :n] * beta[:n]) @ a.T
            beta[:n] = x / x.max(1, keepdims=True) if t % 4 == 3 else x
        q = ahead[step, seg]
        return q / q.sum(1, keepdims=True)


def fit(windows: list[tuple[str, list[str]]], epochs: int = EPOCHS, seed: int = 5) -> Crf | None:
    """A model from (label, words) windows: maximum likelihood with adaptive gradient steps and weight decay."""
    windows = sorted((lab, ws) for lab, ws in windows if ws)
    labels = sorted({lab for lab, _ in windows})
    if not labels:
        return None
    k, rng = len(labels), np.random.default_rng(seed)
    number = {lab: i for i, lab in enumerate(labels)}
    other = rng.permutation(len(windows))
    spliced = []
    for i, (lab, ws) in enumerate(windows):
        lab2, ws2 = windows[other[i]]
        h = len(ws) // 2
        spliced.append((ws[:h] + ws2[: len(ws) - h], [number[lab]] * h + [number[lab2]] * len(ws2[: len(ws) - h])) if rng.random() < 0.2 else (ws, [number[lab]] * len(ws)))
    index: dict[str, int] = {}
    span, n = max(len(ws) for ws, _ in spliced), len(spliced)
    tok, gold, real = np.zeros((span, n), np.int64), np.zeros((span, n), np.int64), np.zeros((span, n), bool)
    for i, (ws, ys) in enumerate(spliced):
        m = len(ws)
        tok[:m, i], gold[:m, i], real[:m, i] = [index.setdefault(w, len(index)) for w in ws], ys, True
    word, slot = features(list(index))
    model = Crf(labels, np.zeros((TABLE, k), np.float32), np.zeros((k, k)))
    sum_w, sum_t, onehot = np.full((TABLE, k), 1e-6), np.full((k, k), 1e-6), np.eye(k)
    for _ in range(epochs):
        by_word = np.zeros((len(index), k))
        for lab in range(k):
            by_word[:, lab] = np.bincount(word, model.weights[slot, lab], len(index))
        s = by_word[tok]
        e = np.exp(s - s.max(2, keepdims=True))
        a = np.exp(model.transitions)
        alpha = np.empty_like(e)
        x = e[0] / e[0].sum(1, keepdims=True)
        alpha[0] = x
        for t in range(1, span):
            y = (x @ a) * e[t]
            x = np.where(real[t][:, None], y / y.sum(1, keepdims=True), x)
            alpha[t] = x
        beta, g, g_t = np.ones((n, k)), np.zeros((len(index), k)), np.zeros((k, k))
        for t in range(span - 1, -1, -1):
            q = alpha[t] * beta
            q /= q.sum(1, keepdims=True)
            live = real[t]
            d = (q - onehot[gold[t]])[live]
            for lab in range(k):
                g[:, lab] += np.bincount(tok[t][live], d[:, lab], len(index))
            if t:
                right = e[t] * beta
                pair = alpha[t - 1][:, :, None] * a[None] * right[:, None, :]
                pair /= pair.sum((1, 2), keepdims=True)
                g_t += pair[live].sum(0)
                np.add.at(g_t, (gold[t - 1][live], gold[t][live]), -1.0)
                y = right @ a.T
                beta = np.where(live[:, None], y / y.sum(1, keepdims=True), beta)
        for lab in range(k):
            grad = np.bincount(slot, g[word, lab], TABLE) + 0.01 * model.weights[:, lab]
            sum_w[:, lab] += grad**2
            model.weights[:, lab] -= 0.3 * grad / np.sqrt(sum_w[:, lab])
        g_t += 0.01 * model.transitions
        sum_t += g_t**2
        model.transitions -= 0.3 * g_t / np.sqrt(sum_t)
    return model


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, span: int = SPAN) -> Crf | None:
    """Fit on the whole texts of a bounded sample of docs (doc_id, text, lang) that may be learned from."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, docs_per_lang / n))])
    drawn = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < 1_000_003 * share[F.col("lang")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, texts = [], []
            for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist(), strict=True):
                ws = words_of(text)
                for at in range(0, len(ws), span):
                    langs.append(lang)
                    texts.append(" ".join(ws[at : at + span]))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(texts, pa.string())], names=["lang", "words"])

    found = drawn.select("lang", "text").mapInArrow(cut, "lang string, words string").collect()
    return fit([(r["lang"], r["words"].split(" ")) for r in found])


def _posteriors(crf: Crf | None, batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[list[str]], list[np.ndarray]]]:
    """(block of rows, words of each, word posteriors of each)."""
    known: dict[str, int] = {}
    table_ = np.zeros((0, len(crf.labels) if crf else 1), np.float32)
    for b in blocks(batches, text):
        split = [words_of(t) for t in b[text].to_pylist()] if crf else [[]] * len(b)
        lengths = np.array([len(s) for s in split], np.int64)
        found = np.zeros((0, table_.shape[1]))
        if lengths.any():
            if len(known) > KNOWN:
                known.clear()
                table_ = table_[:0]
            new = list(dict.fromkeys(w for s in split for w in s if w not in known))
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            if new:
                table_ = np.concatenate([table_, crf.emissions(new)])
            found = crf.posteriors(table_[np.array([known[w] for s in split for w in s], np.int64)], lengths[lengths > 0])
        yield b, split, np.split(found, np.cumsum(lengths)[:-1]) if len(lengths) else []


def _with(docs: DataFrame, fields: list[T.StructField]) -> tuple[DataFrame, T.StructType]:
    docs = docs.drop(*[f.name for f in fields])
    return docs, T.StructType([*docs.schema.fields, *fields])


def identify(docs: DataFrame, model: Crf | None, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and word_langs, which holds the posterior mean of each label."""
    docs, schema = _with(docs, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("word_langs", T.MapType(T.StringType(), T.DoubleType()))])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for b, _, found in _posteriors(crf, batches, text):
            preds, scores, means = [UNKNOWN] * len(b), [0.0] * len(b), [None] * len(b)
            for d, q in enumerate(found):
                if len(q):
                    row = q.mean(0)
                    best = int(row.argmax())
                    preds[d], scores[d], means[d] = crf.labels[best], min(1.0, float(row[best])), list(zip(crf.labels, row.tolist(), strict=True))
            kinds = (pa.string(), pa.float64(), pa.map_(pa.string(), pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, k) for c, k in zip((preds, scores, means), kinds, strict=True))], names=[*b.schema.names, "lang_pred", "score", "word_langs"])

    return docs.mapInArrow(run, schema)


def switches(docs: DataFrame, model: Crf | None, text: str = "text") -> DataFrame:
    """docs with stretches: the maximal runs of words whose likeliest label is one, as (lang, words, score), score being the mean posterior."""
    stretch = T.StructType([T.StructField("lang", T.StringType()), T.StructField("words", T.StringType()), T.StructField("score", T.DoubleType())])
    docs, schema = _with(docs, [T.StructField("stretches", T.ArrayType(stretch))])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for b, split, found in _posteriors(crf, batches, text):
            out: list[list[dict]] = [[] for _ in range(len(b))]
            for d, q in enumerate(found):
                best = q.argmax(1)
                cuts = np.r_[0, np.flatnonzero(best[1:] != best[:-1]) + 1, len(best)] if len(best) else np.zeros(1, int)
                for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    out[d].append({"lang": crf.labels[best[x]], "words": " ".join(split[d][x:y]), "score": min(1.0, float(q[x:y, best[x]].mean()))})
            kind = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.string()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, kind)], names=[*b.schema.names, "stretches"])

    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.select("doc_id", "text", "lang"))
    marked = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return identify(marked, model).select("doc_id", "held_out", "lang_pred", "score")
