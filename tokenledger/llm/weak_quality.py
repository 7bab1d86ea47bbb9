"""Quality classifier from weak labels.

Heuristic labellers vote good (1), bad (-1) or nothing (0) on each document.  Expectation-maximisation over
the counts of vote patterns, which sum up all documents and number 3 to the power of the labellers at most,
estimates the share of good documents and each labeller's votes given the truth; not voting says nothing, and a labeller is taken to
accuse a good document with at most ``DOUBT`` of the odds with which it accuses any.  The patterns' posteriors are the labels of a hashed linear
scorer, trained by logistic regression on about ``sample`` different documents (chosen by a hash of id and text), which
then scores every document.

Null or empty texts get a score of 0 and the bad votes of an empty text; null ids are scored and teach nothing, and if no row has
an id all that have words score 0.5; a document is kept from 0.5 on, so a tie is kept; texts are read whole, however long;
repeated rows are scored alike and teach once; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.llm.common import table

LABELLERS = ("symbols", "tables", "shouting", "stutter", "repeated_lines", "exclamations", "digits", "top_word")
WORDS = re.compile(r"[^\W\d_]+")
SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()|\-]")
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+")
SAMPLE, TABLE, ROUNDS = 4000, 1 << 16, 150
#: A labeller accuses a good document with at most this share of the odds with which it accuses any.
DOUBT = 0.03


def votes(text: str | None) -> tuple[int, ...]:
    """The labellers' votes on a whole text, in the order of LABELLERS."""
    text = text or ""
    words = WORDS.findall(text)
    n, chars = len(words), max(1, len(text))
    if not n:
        return (-1, 0, 0, 0, 0, 0, -1, -1)
    lines = [x for x in text.split("\n") if x.strip()]
    symbols = len(SYMBOL.findall(text)) / chars
    bars = text.count("|") / n
    upper = sum(w.isupper() and len(w) > 1 for w in words) / n
    stutter = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    repeated = 1 - len(set(lines)) / len(lines)
    top = max(Counter(w.lower() for w in words).values()) / n
    digits = sum(c.isdigit() for c in text) / chars
    shouts = text.count("!") / n
    return (
        -1 if symbols > 0.03 else 1 if symbols < 0.01 else 0,
        -1 if bars > 0.2 else 1 if bars < 0.02 else 0,
        -1 if upper > 0.3 else 1 if upper < 0.05 else 0,
        -1 if stutter > 0.1 else 1 if stutter < 0.03 else 0,
        -1 if len(lines) > 3 and repeated > 0.3 else 1 if repeated < 0.05 else 0,
        -1 if shouts > 0.2 else 1 if shouts < 0.02 else 0,
        0 if n < 20 else -1 if digits > 0.15 else 1 if digits < 0.05 else 0,
        -1 if n >= 20 and top > 0.25 else 1 if n >= 20 and top < 0.15 else 0,
    )


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 300, doubt: float = DOUBT) -> tuple[np.ndarray, float, np.ndarray]:
    """(posterior of good for each pattern, share of good documents, P(vote | truth, a vote) as labeller x truth (bad, good) x vote (bad, good))."""
    accusing = (patterns < 0).any(1)
    post = np.where(accusing, 0.1, 0.9)
    onehot = np.stack([patterns == v for v in (-1, 1)], 2).astype(float)  # no vote, no evidence
    accused = onehot[:, :, 0].T @ counts / np.maximum(1, onehot.sum(2).T @ counts)
    for _ in range(rounds):
        w = np.stack([(1 - post) * counts, post * counts])
        good = (w[1].sum() + 1) / (counts.sum() + 2)
        table_ = np.einsum("yp,pmv->myv", w, onehot) + 0.5
        table_ /= table_.sum(2, keepdims=True)
        # Labellers are made to accuse few good documents, or those of rarer faults would count as noise
        table_[:, 1, 0] = np.minimum(table_[:, 1, 0], doubt * accused + 1e-9)
        table_[:, 1, 1] = 1 - table_[:, 1, 0]
        log = np.einsum("pmv,myv->py", onehot, np.log(table_)) + np.log([1 - good, good])
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        done = np.abs(new - post).max() < 1e-7
        post = new
        if done:
            break
    return post, good, table_


def hashed(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and weights (unit length) of a text's tokens."""
    tokens = TOKEN.findall(text or "")
    low = [t.lower() for t in tokens]
    c = Counter(low)
    # What a bag of words does not show: capitals, and words said twice
    shape = {" upper": sum(len(t) > 1 and t.isupper() for t in tokens), " twice": sum(a == b for a, b in zip(low, low[1:], strict=False))}
    c.update({k: n for k, n in shape.items() if n})
    slots = np.fromiter((xxhash.xxh32_intdigest(t) % TABLE for t in c), np.int64, len(c))
    w = np.sqrt(np.fromiter(c.values(), float, len(c)))
    return slots, w / max(1e-9, np.sqrt((w**2).sum()))


def fit_scorer(texts: list[str], target: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic scorer for soft targets."""
    rows = [hashed(t) for t in texts]
    doc = np.repeat(np.arange(len(rows)), [len(s) for s, _ in rows])
    slot, w = (np.concatenate([r[k] for r in rows]) for k in (0, 1))
    weights, bias, speed, speed_b = np.zeros(TABLE), 0.0, np.full(TABLE, 1e-8), 1e-8
    each = np.where(target > 0.5, 0.5 / max(1e-9, target.sum()), 0.5 / max(1e-9, (1 - target).sum()))  # both classes count alike
    for _ in range(rounds):
        z = np.bincount(doc, weights[slot] * w, len(rows)) + bias
        d = (1 / (1 + np.exp(-z)) - target) * each
        g = np.bincount(slot, d[doc] * w, TABLE) + 1e-6 * weights
        speed += g**2
        speed_b += d.sum() ** 2
        weights -= 0.5 * g / np.sqrt(speed)
        bias -= 0.5 * d.sum() / np.sqrt(speed_b)
    return weights, bias


def with_votes(docs: DataFrame) -> DataFrame:
    """(doc_id, votes) a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([votes(t) for t in b["text"].to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "votes"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, votes array<int>")


def posteriors(docs: DataFrame) -> dict[tuple[int, ...], float]:
    """The posterior of good for each vote pattern of docs: at most 3 ** len(LABELLERS) of them, counted over all rows."""
    found = with_votes(docs).groupBy("votes").count().collect()
    if not found:
        return {}
    patterns, counts = np.array([r["votes"] for r in found]), np.array([r["count"] for r in found], float)
    post, _, _ = expectation_maximisation(patterns, counts)
    return {tuple(p): float(x) for p, x in zip(patterns.tolist(), post, strict=True)}


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Weights and bias of the scorer, learned from the posteriors of some of docs (doc_id, text)."""
    of, n = posteriors(docs), docs.count()
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) < 1_000_003 * min(1.0, sample / max(1, n))
    # Copies of one row are all drawn or none is, so they count once
    texts = sorted(r["text"] or "" for r in docs.where("doc_id is not null").where(drawn).select("doc_id", "text").distinct().collect())
    return fit_scorer(texts, np.array([of[votes(t)] for t in texts])) if texts else (np.zeros(TABLE), 0.0)


def classify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score, keep) a row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    weights, bias = fit(docs, sample)
    shared = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights_, bias_ = shared.value
        for b in batches:
            scores = []
            for t in b["text"].to_pylist():
                slots, w = hashed(t)
                scores.append(float(1 / (1 + np.exp(-(weights_[slots] @ w + bias_)))) if len(slots) else 0.0)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.mapInArrow(run, "doc_id long, score double").withColumn("keep", F.col("score") >= 0.5)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents").select("doc_id", "text"))
