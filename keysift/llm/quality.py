"""Quality classifier: supervised subword embeddings.

Every word and every character n-gram of it has a hashed, learned vector; a word is the mean of
its vectors, a document the mean of its words, and a softmax layer gives the classes.  The
vectors are trained by stochastic gradient descent in numpy, in one task, on a bounded
sample of labelled rows.  As averaging and the output layer are linear, a trained model
reduces to one score per hash bucket; scoring adds those up, each distinct word once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.llm.common import WordCache, held_out, table, text_of

BUCKETS = 1 << 17
DIMENSIONS = 12
#: Character n-grams of these lengths, within a word marked by < and >.
GRAMS = (3, 4, 5)
#: Training takes at most so many labelled rows of either class (those with the smallest id hash), whole texts, and of
#: these as many as have so many characters together: a row that would exceed that is left out whole.
SAMPLE_ROWS = 1000
SAMPLE_CHARS = 8 << 20
#: Words of more bytes are hashed a part at a time.
LONG_WORD = 4096
EPOCHS = 4
RATE = 0.5
SEED = 7


def word_buckets(word: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """Hash buckets of a word and its n-grams."""
    from xxhash import xxh32_intdigest

    marked = b"<" + word + b">"
    parts = [word] + [marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)]
    return np.array([xxh32_intdigest(p) % buckets for p in parts], dtype=np.int64)


def word_mean(word: bytes, values: np.ndarray) -> float:
    """Mean value of the buckets of a word and its n-grams, of which a long one never has all in memory."""
    if len(word) <= LONG_WORD:
        return float(values[word_buckets(word, len(values))].mean())
    from xxhash import xxh32_intdigest

    marked = b"<" + word + b">"
    total, n = float(values[xxh32_intdigest(word) % len(values)]), 1
    for at in range(0, len(marked), LONG_WORD):
        codes = [xxh32_intdigest(marked[i : i + k]) % len(values) for k in GRAMS for i in range(at, min(at + LONG_WORD, len(marked) - k + 1))]
        total, n = total + float(values[codes].sum()), n + len(codes)
    return total / n


def train(texts: list[str], labels: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, float]:
    """Score per bucket and bias: the log odds of class 1 of a document are bias + mean of its words' scores."""
    if len(set(labels.tolist())) < 2:
        only = float(labels[0]) if len(labels) else 0.5
        return np.zeros(buckets, np.float32), (only - 0.5) * 8
    rng = np.random.default_rng(SEED)
    known = WordCache(lambda word: word_buckets(word, buckets))
    documents = []
    for text in texts:
        ids: dict[int, float] = {}
        words = text.lower().encode().split()
        for word in words:
            own = known[word]
            for i in own.tolist():
                ids[i] = ids.get(i, 0.0) + 1 / (len(own) * len(words))
        documents.append((np.fromiter(ids, np.int32, len(ids)), np.fromiter(ids.values(), np.float32, len(ids))))
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (buckets, DIMENSIONS)).astype(np.float32)
    output, bias = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
    weight = len(labels) / (2 * np.bincount(labels, minlength=2))
    steps = EPOCHS * len(documents)
    for step, k in enumerate(np.concatenate([rng.permutation(len(documents)) for _ in range(EPOCHS)])):
        ids, shares = documents[k]
        hidden = shares @ vectors[ids] if len(ids) else np.zeros(DIMENSIONS, np.float32)
        raw = hidden @ output + bias
        p = np.exp(raw - raw.max())
        p /= p.sum()
        p[labels[k]] -= 1
        slope = (RATE * (1 - step / steps) * weight[labels[k]] * p).astype(np.float32)
        back = output @ slope
        output -= np.outer(hidden, slope)
        bias -= 0.1 * slope
        if len(ids):
            # A step by a document's shares alone would be tiny: they add up to one over thousands of buckets.
            vectors[ids] -= np.outer(shares * min(len(ids), 50), back)
    return (vectors @ (output[:, 1] - output[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Bounded labelled sample: ``rows`` ids of each class outside the held-out fold, with their whole texts.

    Labels without an id or a quality are left out; where a document has several, the mean decides.
    """
    votes = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("_id"))
        .agg((F.avg("quality") >= 0.5).cast("int").alias("_label"))
        .filter(~held_out("_id"))
    )
    order = [F.xxhash64("_id"), F.col("_id")]
    classes = [votes.filter(F.col("_label") == k).orderBy(*order).limit(rows) for k in (0, 1)]
    chosen = classes[0].unionByName(classes[1])  # at most 2 * rows rows
    plain = docs.select(F.col("doc_id").cast("long").alias("_id"), text_of().alias("text"))
    return plain.join(F.broadcast(chosen), "_id").select("_id", "_label", "text")


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float]:
    """Train in one task on the bounded sample; only the model comes to the driver."""

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts: list[str] = []
        marks: list[int] = []
        last, room = None, {0: SAMPLE_CHARS, 1: SAMPLE_CHARS}
        for batch in batches:
            for doc_id, label, text in zip(batch["_id"].tolist(), batch["_label"].tolist(), batch["text"]):
                # Repeated rows add nothing; a text that doesn't fit is left out whole.
                if doc_id != last and len(text) <= room[label]:
                    texts.append(text)
                    marks.append(label)
                    room[label] -= len(text)
                last = doc_id
        scores, bias = train(texts, np.array(marks, np.int64))
        yield pd.DataFrame({"scores": [scores.tobytes()], "bias": [bias]})

    # The order decides the result, so it is fixed.
    chosen = sample(docs, labels, rows).repartition(1).sortWithinPartitions(F.xxhash64("_id"), "_id", "text")
    model = chosen.mapInPandas(learn, "scores binary, bias double").first()
    return (np.frombuffer(model["scores"], np.float32), model["bias"]) if model else (np.zeros(BUCKETS, np.float32), 0.0)


@lru_cache(maxsize=1)  # a worker keeps the words of one model
def _word_scores(scores: bytes) -> WordCache:
    values = np.frombuffer(scores, np.float32)
    return WordCache(lambda word: word_mean(word, values))


def score_texts(texts: list[str], scores: bytes, bias: float) -> list[float]:
    known = _word_scores(scores)
    out = []
    for text in texts:
        words = text.lower().encode().split()
        odds = bias + (math.fsum(map(known.__getitem__, words)) / len(words) if words else 0.0)
        out.append(1 / (1 + math.exp(-max(-60.0, min(60.0, odds)))))
    return out


def scored(docs: DataFrame, model: tuple[np.ndarray, float], column: str = "score") -> DataFrame:
    """``docs`` with a score column: 0 to 1, higher for better quality.

    The whole text counts, and nothing but the text.  Null text counts as empty; an empty
    text has the score of the bias alone.  Equal texts have equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model[0].tobytes(), model[1]))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scores, bias = shared.value
        for texts in batches:
            yield pd.Series(score_texts(texts.tolist(), scores, bias), dtype="float64")

    return docs.withColumn(column, score(text_of()))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Trained on labelled rows outside the held-out fold (see ``sample``); without such rows every
    score is 0.5.  A null doc_id stays null, is never trained on and counts as the empty text in the
    fold; repeated rows are scored alike; an empty table gives no rows; other columns are ignored.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scored(plain, fit(docs, labels)).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with a score of at least 0.5, columns unchanged, whatever they are called."""
    packed = docs.select(F.col("doc_id"), F.col("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return scored(packed, fit(docs, labels)).filter("score >= 0.5").select("_row.*")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
