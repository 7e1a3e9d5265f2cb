"""Language identification: a convolutional network over bytes.

Bytes have learned vectors; filters of several widths slide over windows of fixed length, the
largest value of each filter in a window goes into a softmax layer.  Training is
numpy gradient descent in one task on a bounded sample; a text is cut into windows without
gaps, all of them are scored in batches, and the window probabilities are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.llm.common import held_out, table, text_of

WINDOW = 256
VECTOR = 8
FILTERS = 12
WIDTHS = (2, 3, 4)
#: Training takes about so many rows of a language, and of many languages about so many in all, though never fewer than
#: LEAST_ROWS of each; whole texts, as long as a language's have at most so many windows (a row that would exceed that is left out whole).
SAMPLE_PER_LANGUAGE = 250
SAMPLE_ROWS = 4000
LEAST_ROWS = 20
SAMPLE_WINDOWS = 4000
#: Of many languages together they have about so many.
ALL_WINDOWS = 200_000
EPOCHS = 6
BATCH = 64
SEED = 11


def windows_of(text: bytes) -> np.ndarray:
    """The text as rows of WINDOW bytes, the last one filled with blanks."""
    padded = text + b" " * (-len(text) % WINDOW)
    return np.frombuffer(padded, np.uint8).reshape(-1, WINDOW)


class ByteNetwork:
    def __init__(self, classes: int, rng: np.random.Generator | None = None) -> None:
        rng = rng or np.random.default_rng(SEED)
        self.weights = {"bytes": rng.normal(0, 0.5, (256, VECTOR)), "out": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), classes)), "bias": np.zeros(classes)}
        for w in WIDTHS:
            self.weights[f"conv{w}"] = rng.normal(0, (2 / (w * VECTOR)) ** 0.5, (w * VECTOR, FILTERS))
            self.weights[f"bias{w}"] = np.zeros(FILTERS)
        self.weights = {k: v.astype(np.float32) for k, v in self.weights.items()}

    def step(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross entropy."""
        p, n = self.weights, len(x)
        vectors = p["bytes"][x]
        hidden, kept = [], []
        for w in WIDTHS:
            columns = np.concatenate([vectors[:, i : WINDOW - w + 1 + i] for i in range(w)], axis=2)
            values = columns @ p[f"conv{w}"] + p[f"bias{w}"]
            at = values.argmax(1)
            best = np.take_along_axis(values, at[:, None], 1)[:, 0]
            hidden.append(np.maximum(best, 0))
            kept.append((at, best))
        hidden = np.concatenate(hidden, 1)
        raw = hidden @ p["out"] + p["bias"]
        soft = np.exp(raw - raw.max(1, keepdims=True))
        soft /= soft.sum(1, keepdims=True)
        soft[np.arange(n), y] -= 1
        soft /= n
        slopes = {"out": hidden.T @ soft, "bias": soft.sum(0), "bytes": np.zeros_like(p["bytes"])}
        back = soft @ p["out"].T
        row = np.arange(n)
        for k, w in enumerate(WIDTHS):
            at, best = kept[k]
            slope = back[:, k * FILTERS : (k + 1) * FILTERS] * (best > 0)
            slopes[f"bias{w}"] = slope.sum(0)
            conv = np.zeros_like(p[f"conv{w}"])
            for i in range(w):
                seen = x[row[:, None], at + i]  # the byte under each filter's place i, for its largest value
                conv[i * VECTOR : (i + 1) * VECTOR] = np.einsum("nfv,nf->vf", p["bytes"][seen], slope)
                np.add.at(slopes["bytes"], seen, slope[:, :, None] * p[f"conv{w}"][i * VECTOR : (i + 1) * VECTOR].T[None])
            slopes[f"conv{w}"] = conv
        return slopes

    def train(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> None:
        """Gradient descent with Adam's step sizes."""
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        t = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                t += 1
                chosen = order[at : at + BATCH]
                for k, slope in self.step(x[chosen], y[chosen]).items():
                    first[k] += 0.1 * (slope - first[k])
                    second[k] += 0.001 * (slope * slope - second[k])
                    self.weights[k] -= (0.01 * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    def tables(self) -> None:
        """What each byte pair adds to each filter: scoring then is look-up and addition."""
        p, v = self.weights, VECTOR
        part = {(w, i): p["bytes"] @ p[f"conv{w}"][i * v : (i + 1) * v] for w in WIDTHS for i in range(w)}
        pair = lambda w, i: (part[w, i][:, None] + part[w, i + 1][None]).reshape(65536, FILTERS)
        self.pairs = np.ascontiguousarray(np.concatenate([pair(2, 0), pair(3, 0), pair(4, 0), pair(4, 2)], 1))
        self.third = np.ascontiguousarray(part[3, 2])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Softmax outputs of windows, a row each."""
        out = []
        f, p = FILTERS, self.weights
        for at in range(0, len(x), 32):
            w = x[at : at + 32]
            rows = self.pairs[w[:, :-1].astype(np.int32) << 8 | w[:, 1:]]
            hidden = [
                rows[:, :, :f].max(1) + p["bias2"],
                (rows[:, :-1, f : 2 * f] + self.third[w[:, 2:]]).max(1) + p["bias3"],
                (rows[:, :-2, 2 * f : 3 * f] + rows[:, 2:, 3 * f :]).max(1) + p["bias4"],
            ]
            raw = np.maximum(np.concatenate(hidden, 1), 0) @ p["out"] + p["bias"]
            soft = np.exp(raw - raw.max(1, keepdims=True))
            out.append(soft / soft.sum(1, keepdims=True))
        return np.concatenate(out)


def fit(docs: DataFrame) -> tuple[list[str], dict[str, bytes]] | None:
    """Languages and weights learned from text and lang outside the held-out fold; None if there are no such rows."""
    known = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("lang").alias("_lang"), text_of().alias("text")).filter(
        F.col("_lang").isNotNull() & F.col("_id").isNotNull() & ~held_out("_id") & F.col("text").rlike("\\p{L}")
    )
    # Every language is learned; their list is part of the model.
    counts = known.groupBy("_lang").count().collect()
    if not counts:
        return None
    names = sorted(r["_lang"] for r in counts)
    quota = max(LEAST_ROWS, min(SAMPLE_PER_LANGUAGE, SAMPLE_ROWS // len(names)))
    share = docs.sparkSession.createDataFrame([(r["_lang"], min(1.0, quota / r["count"])) for r in counts], "_lang string, _share double")
    # A fixed share of each language by id hash: no sorting, and no language crowds another out.
    sampled = known.join(F.broadcast(share), "_lang").filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < F.col("_share") * (1 << 30))

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = {name: i for i, name in enumerate(names)}
        x, y = [], []
        room, last = dict.fromkeys(names, max(LEAST_ROWS, min(SAMPLE_WINDOWS, ALL_WINDOWS // len(names)))), None
        for batch in batches:
            for doc_id, lang, text in zip(batch["_id"].tolist(), batch["_lang"], batch["text"]):
                own = windows_of(text.encode())
                if (doc_id, lang) != last and len(own) <= room[lang]:
                    x.append(own)
                    y.append(np.full(len(own), at[lang]))
                    room[lang] -= len(own)
                last = (doc_id, lang)
        if not x:
            return
        rng = np.random.default_rng(SEED)
        network = ByteNetwork(len(names), rng)
        network.train(np.concatenate(x), np.concatenate(y), rng)
        yield pd.DataFrame([{k: v.tobytes() for k, v in network.weights.items()}])

    empty = ByteNetwork(len(names)).weights
    schema = ", ".join(f"`{k}` binary" for k in empty)
    # The order decides the result, so it is fixed.
    dealt = sampled.select("_id", "_lang", "text").repartition(1).sortWithinPartitions(F.xxhash64("_id"), "_id", "_lang", "text")
    model = dealt.mapInPandas(learn, schema).first()
    return (names, model.asDict()) if model else None


def predicted(docs: DataFrame, model: tuple[list[str], dict] | None, column: str = "_language") -> DataFrame:
    """``docs`` with a struct column (lang, score)."""
    if model is None:
        return docs.withColumn(column, F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score")))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, weights = shared.value
        network = ByteNetwork(len(names))
        network.weights = {k: np.frombuffer(weights[k], np.float32).reshape(v.shape) for k, v in network.weights.items()}
        network.tables()
        for texts in batches:
            means, group, held = [], [], 0
            for text in texts:
                group.append(windows_of((text or " ").encode()))
                held += len(group[-1])
                if held >= 4096:
                    means += text_means(network, group)
                    group, held = [], 0
            if group:
                means += text_means(network, group)
            table_ = np.array(means).reshape(len(texts), len(names))
            best = table_.argmax(1)
            yield pd.DataFrame({"lang": [names[i] for i in best], "score": np.clip(table_[np.arange(len(texts)), best], 0, 1).astype("float64")})

    # One column at a time is added, so the caller's own names stay.
    letters = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    return docs.withColumn(column, F.when(letters, predict(text_of())).otherwise(F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"))))


def text_means(network: ByteNetwork, group: list[np.ndarray]) -> list[np.ndarray]:
    """Mean window probabilities of each text."""
    values = network.probabilities(np.concatenate(group))
    starts = np.cumsum([0] + [len(g) for g in group[:-1]])
    return list(np.add.reduceat(values, starts, axis=0) / np.array([[len(g)] for g in group]))


def languages(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Learned from rows outside the held-out fold with an id, a language and a letter in the text.  ``und`` with score 0
    where the text is null or has no letter, or if nothing could be learned.  A null doc_id stays
    null and is never learned from; rows that repeat get equal results; an empty table gives no rows; other columns are ignored.
    """
    model = fit(docs)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return predicted(plain, model).select(
        "doc_id", held_out().alias("held_out"), F.col("_language.lang").alias("lang_pred"), F.col("_language.score").alias("score")
    )


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
