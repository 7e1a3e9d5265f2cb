"""Toxicity: a linear-chain conditional random field over the words of a text.

Each word is toxic or clean.  A weight vector of hashed features (the word, its beginnings and ends, its shape, the words
beside it) gives the score of either tag, a transition matrix those of neighbours.  Token labels come from labelled
documents: the words and word beginnings that are far more frequent among toxic documents mark the toxic words there.
The field is trained by numpy gradient descent on exact forward-backward marginals, in one task on a
bounded sample of labelled rows.  Scoring runs forward-backward over whole documents, a batch of them as one chain that starts
anew at each document; marginals add up to a document score, and runs of likely words are the offending spans.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.llm.common import table, text_of

BUCKETS = 1 << 18
#: A word's beginnings and ends of these lengths are features.
HEADS, TAILS = (3, 4, 5, 6), (3, 4)
FEATURES = 2 + len(HEADS) + len(TAILS)
#: Training takes at most so many labelled rows of each class (those with the smallest id hash), whole texts, and
#: stops at so many characters of either class; a row that would exceed that is left out whole.
SAMPLE_ROWS = {1: 1500, 0: 3000}
SAMPLE_CHARS = 16 << 20
#: A word or a beginning marks toxic words if documents of the sample have it so many times as often among toxic ones, and with
#: such a likelihood ratio (G statistic), and so many toxic ones have it.
LIFT, EVIDENCE, LEAST_DOCUMENTS = 4.0, 20.0, 4
MARK_HEADS = (4, 5, 6)
#: A step sees about BATCH words, fewer where the sample is small.
EPOCHS, BATCH, RATE, DECAY = 4, 6000, 0.3, 1e-5
SEED = 13
THRESHOLD = 0.3
#: Marginals below this are left out of a document's score; from SPAN on a word is part of a span.
FLOOR, SPAN = 0.02, 0.5
WORD = re.compile(r"[^\W_]+")

RESULT = "score double, spans array<struct<start:long,end:long,score:double>>"


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4: remainder 2 is held out from training."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


# ------------------------------------------------------------------ words


def word_features(word: str, buckets: int = BUCKETS) -> list[int]:
    """FEATURES buckets of a word; the first is the word itself."""
    from xxhash import xxh32_intdigest

    low = word.lower()
    parts = [f"w {low}"]
    parts += [f"h{k} {low[:k]}" if len(low) > k else "short" for k in HEADS]
    parts += [f"t{k} {low[-k:]}" if len(low) > k else "short" for k in TAILS]
    shape = "digit" if any(c.isdigit() for c in word) else "upper" if word.isupper() else "title" if word[0].isupper() else "lower"
    return [xxh32_intdigest(p) % buckets for p in (*parts, f"s {shape}")]


class Words:
    """Numbers for words; ``make`` is called once for each new one, with the word."""

    def __init__(self, make: Callable[[str], object]) -> None:
        self.make = make
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.made: list = []
        self.packed: list[np.ndarray] = []
        self.held = 0

    def of(self, words: list[str]) -> np.ndarray:
        """Their numbers; ``held`` adds up some bytes for each word kept."""
        get, out = self.numbers.get, [0] * len(words)
        for i, word in enumerate(words):
            n = get(word)
            if n is None:
                n = self.numbers[word] = len(self.numbers)
                self.made.append(self.make(word))
                self.held += len(word) + 250
                if len(self.made) >= 20_000:
                    self.pack()
            out[i] = n
        return np.array(out, np.int32)

    def pack(self) -> None:
        """What was made, as arrays, which are smaller."""
        if self.made:
            self.packed.append(np.array(self.made, np.int32))
            self.made = []

    def taken(self) -> np.ndarray:
        """All that was made since the last time, in the order of the numbers."""
        self.pack()
        out, self.packed = self.packed, []
        return np.concatenate(out) if out else np.zeros((0, FEATURES), np.int32)


# ------------------------------------------------------------------ the chain


def marginals(odds: np.ndarray, first: np.ndarray, start: np.ndarray, move: np.ndarray, lane: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Exact forward-backward of a chain of words that starts anew wherever ``first`` is set.

    ``odds`` is the score of the toxic tag over the clean one; ``start`` (2) and ``move`` (2 x 2) are scores.  Returns the
    toxic marginals, and the expected number of each transition (``move``'s shape).  The chain is cut into lanes that are
    walked side by side, for either tag before them; then the lanes' own messages follow each other.
    """
    n = len(odds)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    lane = max(1, min(lane, n))
    lanes = -(-n // lane)

    # step[i][j]: the factor from tag i before a word to its tag j, its own score included; a row per place
    # in the lanes.  Padding passes messages on.
    top = np.maximum(odds, 0)
    emit = (np.exp(-top), np.exp(odds - top))
    begin, onward = np.exp(start - start.max()), np.exp(move - move.max())

    def places(i: int, j: int) -> np.ndarray:
        out = np.full(lanes * lane, float(i == j))
        out[:n] = np.where(first, begin[j], onward[i, j]) * emit[j]
        return np.ascontiguousarray(out.reshape(lanes, lane).T)

    s00, s01, s10, s11 = (places(i, j) for i in (0, 1) for j in (0, 1))
    # Products over each lane.
    p00, p01, p10, p11 = np.ones(lanes), np.zeros(lanes), np.zeros(lanes), np.ones(lanes)
    for k in range(lane):
        a, b, c, d = s00[k], s01[k], s10[k], s11[k]
        p00, p01 = p00 * a + p01 * c, p00 * b + p01 * d
        p10, p11 = p10 * a + p11 * c, p10 * b + p11 * d
        if k % 4 == 3:
            total = p00 + p01 + p10 + p11
            p00, p01, p10, p11 = p00 / total, p01 / total, p10 / total, p11 / total
    # Messages into each lane, from before and from behind, as shares of the toxic tag.
    product = list(zip(p00.tolist(), p01.tolist(), p10.tolist(), p11.tolist()))
    into, back = np.empty(lanes), np.empty(lanes)
    m = 0.5
    for i, (a, b, c, d) in enumerate(product):
        into[i] = m
        clean, toxic = (1 - m) * a + m * c, (1 - m) * b + m * d
        m = toxic / (clean + toxic)
    m = 0.5
    for i in range(lanes - 1, -1, -1):
        back[i] = m
        a, b, c, d = product[i]
        clean, toxic = a * (1 - m) + b * m, c * (1 - m) + d * m
        m = toxic / (clean + toxic)
    ahead, after = np.empty((lane, lanes)), np.empty((lane, lanes))
    for k in range(lane):
        rest = 1 - into
        clean, toxic = rest * s00[k] + into * s10[k], rest * s01[k] + into * s11[k]
        into = ahead[k] = toxic / (clean + toxic)
    for k in range(lane - 1, -1, -1):
        after[k] = back
        rest = 1 - back
        clean, toxic = s00[k] * rest + s01[k] * back, s10[k] * rest + s11[k] * back
        back = toxic / (clean + toxic)
    flat = lambda x: x.T.reshape(-1)[:n]
    ahead, after = flat(ahead), flat(after)
    both = ahead * after
    toxic = both / (both + (1 - ahead) * (1 - after))
    inner = np.flatnonzero(~first[1:]) + 1
    before = (1 - ahead[inner - 1], ahead[inner - 1])
    behind = (1 - after[inner], after[inner])
    pair = np.array([before[i] * onward[i, j] * emit[j][inner] * behind[j] for i in (0, 1) for j in (0, 1)])
    return toxic, (pair / np.maximum(pair.sum(0), 1e-300)).sum(1).reshape(2, 2)


@dataclass
class Field:
    """Weights: ``own`` of a word's features, ``left`` and ``right`` of the words beside it, and of the tags."""

    own: np.ndarray
    left: np.ndarray
    right: np.ndarray
    bias: float
    start: np.ndarray
    move: np.ndarray
    #: From a document's sums of marginals to its log odds.
    summing: np.ndarray

    @classmethod
    def zero(cls) -> Field:
        empty = lambda: np.zeros(BUCKETS, np.float32)
        return cls(empty(), empty(), empty(), -4.0, np.zeros(2), np.zeros((2, 2)), np.array([-4.0, 0.0, 0.0, 0.0]))

    def values(self, features: np.ndarray) -> np.ndarray:
        """What each word (a row of features) adds to its own score, to that of the next word, and to that of the one before."""
        return np.stack([self.own[features].sum(1), self.left[features[:, 0]], self.right[features[:, 0]]]).astype(np.float64)

    def odds(self, values: np.ndarray, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Score of the toxic tag of each word; ``values`` has a column per number in ``words``."""
        out = self.bias + values[0][words]
        before, own = words[:-1], words[1:]
        out[1:] += np.where(first[1:], 0.0, values[1][before])
        out[:-1] += np.where(first[1:], 0.0, values[2][own])
        return out


# ------------------------------------------------------------------ training


def word_parts(word: str) -> list[str]:
    """A word and its beginnings, written ``abcd*``; as many of each word, a short one repeats itself."""
    low = word.lower()
    return [low, *(f"{low[:k]}*" if len(low) > k else low for k in MARK_HEADS)]


def marked_words(documents: list[np.ndarray], names: list[str], labels: np.ndarray) -> np.ndarray:
    """Which words mark toxic ones, from documents (as word numbers) and their labels; ``names`` are the words.

    Documents that share their least run of three words count once: a group of near copies is no evidence.
    """
    parts_of = Words(lambda part: 0)
    parts = np.array([parts_of.of(word_parts(name)) for name in names], np.int32).reshape(-1, 1 + len(MARK_HEADS))
    codes = np.array([hash_of(name) for name in names], np.uint64)
    groups: dict[tuple[int, int], list[int]] = {}
    for i, (own, label) in enumerate(zip(documents, labels.tolist())):
        if len(own):
            runs = codes[own]
            runs = (runs[:-2] * np.uint64(3) + runs[1:-1] * np.uint64(5) + runs[2:]) * np.uint64(0x9E3779B97F4A7C15) if len(own) > 2 else runs
            groups.setdefault((label, int(runs.min())), []).append(i)
    counts = np.zeros((2, len(parts_of.numbers)))
    totals = [0, 0]
    for (label, _), members in groups.items():
        counts[label][np.unique(parts[np.unique(np.concatenate([documents[i] for i in members]))])] += 1
        totals[label] += 1
    if not totals[1] or not totals[0]:
        return np.zeros(len(names), bool)
    b, a = counts
    share = np.maximum(a + b, 1) / sum(totals)
    ratio = 2 * (a * np.log(np.maximum(a, 1) / (totals[1] * share)) + b * np.log(np.maximum(b, 1) / (totals[0] * share)))
    lifted = a * (totals[0] + 1) >= LIFT * (b + 0.5) * totals[1]
    marks = (a >= LEAST_DOCUMENTS) & lifted & (ratio >= EVIDENCE)
    return marks[parts].any(1)


def hash_of(word: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(word.lower())


def sums_of(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What the marginals of each document (of ``sizes`` words) add up to: 1, largest, log of the sum, share of words."""
    kept = np.where(p >= FLOOR, p, 0.0)
    out = np.zeros((len(sizes), 4))
    out[:, 0] = 1
    full = np.flatnonzero(sizes)
    if len(full):
        at = (np.cumsum(sizes) - sizes)[full]
        total = np.add.reduceat(kept, at)
        out[full, 1] = np.maximum.reduceat(kept, at)
        out[full, 2] = np.log1p(total)
        out[full, 3] = np.sqrt(total / sizes[full])
    return out


def fit_summing(sums: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's steps, with a little decay; weights of the sums are never negative."""
    w = np.array([-3.0, 1.0, 1.0, 1.0])
    decay = np.array([1e-3, 0.05, 0.05, 0.05]) * len(labels) * 0.01
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(sums @ w, -30, 30)))
        slope = sums.T @ (weight * (p - labels)) + decay * w
        curve = (sums * (weight * p * (1 - p))[:, None]).T @ sums + np.diag(decay + 1e-6)
        w = w - np.clip(np.linalg.solve(curve, slope), -2, 2)
        w[1:] = np.maximum(w[1:], 0)
    return w


def grouped(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``most`` words together."""
    at, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        held += size
        if held >= most:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(sizes):
        yield at, len(sizes)


def begins(sizes: np.ndarray) -> np.ndarray:
    """Marks the first word of each of some documents in a row."""
    out = np.zeros(int(sizes.sum()), bool)
    out[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    return out


def train(texts: list[str], labels: np.ndarray, prior: float | None = None) -> Field:
    """Fit a field to labelled documents; ``prior`` is the share of toxic documents where the sample has another one."""
    field = Field.zero()
    if not len(labels) or not labels.any():
        return field
    known = Words(word_features)
    documents = [known.of(WORD.findall(t)) for t in texts]
    features = known.taken()
    marked = marked_words(documents, list(known.numbers), labels)
    del known
    # Pieces of at most ``batch`` words: whole documents, or parts of a long one. Each is a chain of its own in training.
    batch = min(BATCH, max(500, sum(map(len, documents)) // 60))
    pieces = [(i, at) for i, own in enumerate(documents) for at in range(0, len(own), batch)]
    rng = np.random.default_rng(SEED)
    squares = {k: np.full(BUCKETS, 0.1, np.float32) for k in ("own", "left", "right")}
    few = {k: 0.1 for k in ("bias", "start", "move")}
    for epoch in range(EPOCHS):
        order = rng.permutation(len(pieces))
        sizes = np.array([min(batch, len(documents[pieces[k][0]]) - pieces[k][1]) for k in order], np.int64)
        for a, b in grouped(sizes, batch):
            chosen = [pieces[k] for k in order[a:b]]
            own = np.concatenate([documents[i][at : at + batch] for i, at in chosen])
            toxic = np.repeat([bool(labels[i]) for i, _ in chosen], sizes[a:b])
            _step(field, features, own, begins(sizes[a:b]), (marked[own] & toxic).astype(np.float64), RATE * (1 - epoch / EPOCHS), squares, few)
    values = field.values(features)
    sizes = np.array([len(x) for x in documents], np.int64)
    sums = []
    for a, b in grouped(sizes, 200_000):
        own, first = np.concatenate(documents[a:b]), begins(sizes[a:b])
        p, _ = marginals(field.odds(values, own, first), first, field.start, field.move)
        sums.append(sums_of(p, sizes[a:b]))
    weight = np.ones(len(labels))
    if prior is not None and 0 < prior < 1 and not labels.all():
        share = labels.mean()
        weight = np.where(labels == 1, prior / share, (1 - prior) / (1 - share))
    field.summing = fit_summing(np.concatenate(sums), labels.astype(np.float64), weight)
    return field


def _step(field: Field, features: np.ndarray, own: np.ndarray, begin: np.ndarray, y: np.ndarray, rate: float, squares: dict, few: dict) -> None:
    """One step of adaptive gradient descent on the log likelihood of a batch's tags."""
    used, local = np.unique(own, return_inverse=True)
    odds = field.odds(field.values(features[used]), local, begin)
    p, pairs = marginals(odds, begin, field.start, field.move, lane=96)
    slope = p - y
    per_word = np.bincount(local, slope, len(used))
    inner = np.flatnonzero(~begin[1:]) + 1
    beside = features[used, 0]
    left = np.bincount(local[inner - 1], slope[inner], len(used))
    right = np.bincount(local[inner], slope[inner - 1], len(used))
    for name, ids, values in (("own", features[used].ravel(), np.repeat(per_word, FEATURES)), ("left", beside, left), ("right", beside, right)):
        at, back = np.unique(ids, return_inverse=True)
        weights, seen = getattr(field, name), squares[name]
        g = np.bincount(back, values, len(at)) + DECAY * len(own) * weights[at]
        seen[at] += g * g
        weights[at] -= rate * g / np.sqrt(seen[at])
    tag = y.astype(np.int64)
    real = np.zeros((2, 2))
    np.add.at(real, (tag[inner - 1], tag[inner]), 1)
    heads = np.flatnonzero(begin)
    at_start = np.array([(1 - p[heads]).sum() - (1 - y[heads]).sum(), p[heads].sum() - y[heads].sum()])
    for name, g in (("bias", slope.sum()), ("start", at_start), ("move", pairs - real)):
        few[name] = few[name] + g * g
        setattr(field, name, getattr(field, name) - rate * g / np.sqrt(few[name]))


# ------------------------------------------------------------------ scoring


class Scorer:
    """Scores and spans of texts under a field; remembers words up to ``room`` bytes."""

    def __init__(self, field: Field, group: int = 200_000, room: int = 64 << 20) -> None:
        self.field, self.most, self.room = field, group, room
        self.known = Words(word_features)
        self.values = np.zeros((3, 0))

    def __call__(self, texts: list[str]) -> Iterator[tuple[float, list[tuple[int, int, float]]]]:
        """One result per text; texts are taken in groups of about ``most`` words, a long one by itself."""
        group: list[tuple[str, np.ndarray]] = []
        size = 0
        for text in texts:
            group.append((text, self.known.of(WORD.findall(text))))
            size += len(group[-1][1])
            if size >= self.most:
                yield from self.group(group)
                group, size = [], 0
        if group:
            yield from self.group(group)

    def group(self, group: list[tuple[str, np.ndarray]]) -> Iterator[tuple[float, list[tuple[int, int, float]]]]:
        new = self.known.taken()  # of new words, only the values stay
        if len(new):
            self.values = np.concatenate([self.values, self.field.values(new)], axis=1)
        sizes = np.array([len(own) for _, own in group], np.int64)
        words, first = np.concatenate([own for _, own in group]), begins(sizes)
        p, _ = marginals(self.field.odds(self.values, words, first), first, self.field.start, self.field.move)
        odds = np.clip(sums_of(p, sizes) @ self.field.summing, -30, 30)
        if self.known.held > self.room:
            self.known.clear()
            self.values = np.zeros((3, 0))
        at = 0
        for (text, own), x in zip(group, odds.tolist()):
            mine = p[at : at + len(own)]
            at += len(own)
            yield 1 / (1 + math.exp(-x)), spans_of(text, mine) if len(own) and mine.max() >= SPAN else []


def spans_of(text: str, p: np.ndarray) -> list[tuple[int, int, float]]:
    """Runs of toxic words as (start, end, largest marginal), in code points, end exclusive."""
    out: list[tuple[int, int, float]] = []
    likely = p >= SPAN
    for i, found in enumerate(WORD.finditer(text)):
        if likely[i]:
            if out and i and likely[i - 1]:
                out[-1] = (out[-1][0], found.end(), max(out[-1][2], float(p[i])))
            else:
                out.append((found.start(), found.end(), float(p[i])))
    return out


# ------------------------------------------------------------------ Spark


def labelled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float | None]:
    """The bounded sample (_id, _label, _order, text), and the share of toxic ones among all labels outside the held-out fold.

    Labels without an id or a mark are left out; where a document has several, the mean decides.
    """
    votes = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("_id"))
        .agg((F.avg("toxic") >= 0.5).cast("int").alias("_label"))
        .filter(~held_out("_id"))
    )
    order = F.xxhash64("_id")
    classes = [votes.filter(F.col("_label") == k).orderBy(order, "_id").limit(n) for k, n in SAMPLE_ROWS.items()]
    chosen = classes[0].unionByName(classes[1])
    prior = votes.agg(F.avg("_label").alias("p")).first()["p"]
    plain = docs.select(F.col("doc_id").cast("long").alias("_id"), text_of().alias("text"))
    return plain.join(F.broadcast(chosen), "_id").select("_id", "_label", order.alias("_order"), "text"), prior


WEIGHTS = "own binary, left binary, right binary, bias double, start array<double>, move array<double>, summing array<double>"


def fit(docs: DataFrame, labels: DataFrame) -> Field:
    """Train in one task on the bounded sample; only the weights come to the driver."""
    sample, prior = labelled(docs, labels)

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
        field = train(texts, np.array(marks, np.int64), prior)
        row = {k: getattr(field, k).astype(np.float32).tobytes() for k in ("own", "left", "right")}
        yield pd.DataFrame([{**row, "bias": float(field.bias), "start": field.start, "move": field.move.ravel(), "summing": field.summing}])

    dealt = sample.repartition(1).sortWithinPartitions("_order", "_id", "text").select("_id", "_label", "text")
    model = dealt.mapInPandas(learn, WEIGHTS).first()
    if model is None:
        return Field.zero()
    big = [np.frombuffer(model[k], np.float32) for k in ("own", "left", "right")]
    return Field(*big, model["bias"], np.array(model["start"]), np.array(model["move"]).reshape(2, 2), np.array(model["summing"]))


@lru_cache(maxsize=1)
def _scorer(raw: tuple) -> Scorer:
    own, left, right, bias, start, move, summing = raw
    return Scorer(Field(*(np.frombuffer(x, np.float32) for x in (own, left, right)), bias, np.array(start), np.array(move).reshape(2, 2), np.array(summing)))


def tagged(docs: DataFrame, field: Field, column: str = "toxicity") -> DataFrame:
    """``docs`` with a struct column (score, spans): 0 to 1, and the runs of toxic words as start, end (code points) and marginal.

    The whole text counts, and nothing but the text.  Null text counts as empty; a text without words has the
    score of the bias alone.
    """
    raw = (field.own.astype(np.float32).tobytes(), field.left.astype(np.float32).tobytes(), field.right.astype(np.float32).tobytes(), float(field.bias), tuple(field.start.tolist()), tuple(field.move.ravel().tolist()), tuple(field.summing.tolist()))
    shared = docs.sparkSession.sparkContext.broadcast(raw)

    @F.pandas_udf(RESULT)
    def tag(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = _scorer(shared.value)
        for texts in batches:
            rows = [(score, [{"start": a, "end": b, "score": p} for a, b, p in spans]) for score, spans in scorer(texts.tolist())]
            yield pd.DataFrame(rows, columns=["score", "spans"])

    return docs.withColumn(column, tag(text_of()))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, spans (``start:end``, by start, comma-joined).

    Trained on labelled rows outside the held-out fold; without toxic ones among them every score is low.  A null doc_id
    stays null, is never trained on and counts as the empty text in the fold; repeated rows are scored alike;
    an empty table gives no rows; other columns are ignored.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = tagged(plain, fit(docs, labels))
    written = F.array_join(F.transform("toxicity.spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= threshold).cast("int").alias("predicted"),
        written.alias("spans"),
    )


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
