import itertools
import math
import random
import zlib

import numpy as np
import pytest

from keysift.llm import toxicity as T
from tests.llm import samples


def brute_marginals(odds, first, start, move):
    """Sum over all tag sequences."""
    n = len(odds)
    total, toxic, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
    for tags in itertools.product((0, 1), repeat=n):
        score = sum(odds[i] * t for i, t in enumerate(tags))
        score += sum(start[tags[i]] if first[i] else move[tags[i - 1], tags[i]] for i in range(n))
        weight = math.exp(score)
        total += weight
        toxic += weight * np.array(tags)
        for i in range(1, n):
            if not first[i]:
                pairs[tags[i - 1], tags[i]] += weight
    return toxic / total, pairs / total


@pytest.mark.parametrize("lane", [1, 2, 3, 5, 256])
def test_marginals_against_all_sequences(lane):
    rng = np.random.default_rng(lane)
    for n in (1, 2, 7, 11):
        odds, start, move = rng.normal(0, 2, n), rng.normal(0, 1, 2), rng.normal(0, 1, (2, 2))
        first = rng.random(n) < 0.3
        first[0] = True
        p, pairs = T.marginals(odds, first, start, move, lane)
        q, expected = brute_marginals(odds, first, start, move)
        assert np.allclose(p, q) and np.allclose(pairs, expected)


def test_marginals_of_long_and_extreme_chains():
    odds = np.tile([800.0, -800.0, 0.0], 40_000)
    first = np.zeros(len(odds), bool)
    first[0] = True
    p, _ = T.marginals(odds, first, np.zeros(2), np.array([[3.0, -3.0], [-3.0, 3.0]]))
    assert np.isfinite(p).all() and p[0] > 0.99 and p[1] < 0.01 and T.marginals(odds[:0], first[:0], np.zeros(2), np.zeros((2, 2)))[0].size == 0


def test_gradient_is_that_of_the_likelihood():
    """Marginals less tags, and expected less real transitions, are the slopes of the negative log likelihood."""
    rng = np.random.default_rng(3)
    n = 8
    odds, start, move = rng.normal(0, 1, n), rng.normal(0, 1, 2), rng.normal(0, 1, (2, 2))
    first = np.zeros(n, bool)
    first[[0, 5]] = True
    tags = rng.integers(0, 2, n)

    def loss(odds, move):
        every = []
        for own in itertools.product((0, 1), repeat=n):
            every.append(sum(odds[i] * t for i, t in enumerate(own)) + sum(start[own[i]] if first[i] else move[own[i - 1], own[i]] for i in range(n)))
        real = sum(odds[i] * t for i, t in enumerate(tags)) + sum(start[tags[i]] if first[i] else move[tags[i - 1], tags[i]] for i in range(n))
        return math.log(sum(map(math.exp, every))) - real

    p, pairs = T.marginals(odds, first, start, move)
    for i in range(n):
        step = np.eye(n)[i] * 1e-5
        assert abs((loss(odds + step, move) - loss(odds - step, move)) / 2e-5 - (p - tags)[i]) < 1e-6
    real = np.zeros((2, 2))
    for i in range(1, n):
        real[tags[i - 1], tags[i]] += not first[i]
    for i, j in itertools.product((0, 1), repeat=2):
        step = np.zeros((2, 2))
        step[i, j] = 1e-5
        assert abs((loss(odds, move + step) - loss(odds, move - step)) / 2e-5 - (pairs - real)[i, j]) < 1e-6


BAD = ["grobian", "schurke", "nincompoop"]


def made_documents(seed: int, n: int = 400):
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        words = samples.prose(rng, rng.randrange(5, 120), 400).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(BAD[:2]) + rng.choice(["", "en", "haft", "X"]) if rng.random() < 0.8 else BAD[2])
        texts.append(" ".join(words))
        labels.append(int(toxic))
    return texts, np.array(labels)


@pytest.fixture(scope="module")
def field():
    return T.train(*made_documents(1))


def test_learns_words_and_their_forms(field):
    scorer = T.Scorer(field)
    texts, labels = made_documents(2)
    found = list(scorer(texts))
    assert all((score >= T.THRESHOLD) == bool(label) for (score, _), label in zip(found, labels))
    for text, (_, spans) in zip(texts, found):
        inside = [text[a:b] for a, b, _ in spans]
        assert all(any(w.startswith(b) for b in BAD) for run in inside for w in run.split())
    unseen = "w1 w2 grobianesk w3 \U0001f600 schurkerei."
    score, spans = next(iter(scorer([unseen])))
    assert score >= T.THRESHOLD and [unseen[a:b] for a, b, _ in spans] == ["grobianesk", "schurkerei"]


def test_scorer_against_a_plain_loop(field):
    """Emissions feature by feature, forward-backward word by word."""
    texts, _ = made_documents(5, 30)
    for (score, _), text in zip(T.Scorer(field, group=100, room=2000)(texts), texts):
        words = T.WORD.findall(text)
        codes = [T.word_features(w) for w in words]
        odds = []
        for i, own in enumerate(codes):
            x = field.bias + sum(float(field.own[f]) for f in own)
            x += float(field.left[codes[i - 1][0]]) if i else 0.0
            x += float(field.right[codes[i + 1][0]]) if i + 1 < len(codes) else 0.0
            odds.append(x)
        ahead = [[math.exp(field.start[0]), math.exp(field.start[1] + odds[0])]]
        for x in odds[1:]:
            now = [sum(ahead[-1][i] * math.exp(field.move[i, j]) for i in (0, 1)) * math.exp(j * x) for j in (0, 1)]
            ahead.append([v / sum(now) for v in now])
        after = [[1.0, 1.0]]
        for x in odds[:0:-1]:
            now = [sum(math.exp(field.move[i, j] + j * x) * after[0][j] for j in (0, 1)) for i in (0, 1)]
            after.insert(0, [v / sum(now) for v in now])
        p = [a[1] * b[1] / (a[0] * b[0] + a[1] * b[1]) for a, b in zip(ahead, after)]
        kept = [x for x in p if x >= T.FLOOR]
        sums = [1, max(kept, default=0), math.log1p(sum(kept)), math.sqrt(sum(kept) / len(words))]
        assert abs(score - 1 / (1 + math.exp(-float(np.dot(sums, field.summing))))) < 1e-6


def test_near_copies_are_no_evidence():
    rng = random.Random(4)
    texts, labels = made_documents(3)
    copied = samples.prose(rng, 60, 300) + " einzigartig"
    marked = T.train(texts + [copied + f" w{i}" for i in range(30)], np.append(labels, [1] * 30))
    assert next(iter(T.Scorer(marked)(["w5 einzigartig w7"])))[0] < T.THRESHOLD


def test_awkward_rows(spark, awkward, nothing, wide):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 10)] + [(1, 1, None), (None, 1, 1), (2, 0, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    out = samples.rows(T.toxicity(awkward, labels))
    assert len(out) == len(samples.AWKWARD) and all(0 <= r[2] <= 1 and r[3] == int(r[2] >= 0.3) for r in out)
    assert samples.rows(T.toxicity(wide, labels)) == out
    assert T.toxicity(nothing, labels).count() == 0
    for none in (labels.limit(0), labels.filter("toxic = 0")):
        assert all(r[2] < 0.3 and r[3] == 0 and r[4] == "" for r in samples.rows(T.toxicity(awkward, none)))


def test_rows_of_the_held_out_fold_teach_nothing(spark):
    texts, marks = made_documents(7, 200)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(m)) for i, m in enumerate(marks)], "doc_id long, toxic int")
    fold = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 4 == 2]
    flipped = spark.createDataFrame([(i, int(m) if i not in fold else 1 - int(m)) for i, m in enumerate(marks)], "doc_id long, toxic int")
    assert samples.rows(T.toxicity(docs, labels)) == samples.rows(T.toxicity(docs, flipped))


def test_a_text_over_the_budget_is_left_out_whole(spark, monkeypatch):
    texts, marks = made_documents(8, 200)
    texts[4] = "w1 " * 100_000
    monkeypatch.setattr(T, "SAMPLE_CHARS", 200_000)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(m)) for i, m in enumerate(marks)], "doc_id long, toxic int")
    found = {r[0]: r[3] for r in samples.rows(T.toxicity(docs, labels))}
    assert sum(found[i] == m for i, m in enumerate(marks.tolist()) if i != 4) >= 195 and found[4] == 0


def test_query_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = [r for r in T.op11_toxicity(spark, sf).collect()]
    assert len(out) == 10_000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    judged = [(r.score, truth[r.doc_id], r.predicted) for r in out if r.held_out and r.doc_id in truth]
    toxic = [s for s, t, _ in judged if t]
    clean = [s for s, t, _ in judged if not t]
    area = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert area > 0.96 and sum(p for _, t, p in judged if t) > 0.9 * len(toxic) and sum(p for _, t, p in judged if not t) < 0.02 * len(clean)
