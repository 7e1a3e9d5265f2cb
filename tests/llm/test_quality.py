import random

import numpy as np

from keysift.llm import quality as Q
from tests.llm import samples

SF = "/root/testdata/sf0.001"


def labelled(spark, n=200):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        words = samples.prose(rng, 40).split()
        rows.append((i, " ".join(words if good else [w + "$$$" for w in words])))
        labels.append((i, int(good), 0))
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], samples.DOCUMENTS)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learns_and_holds_out(spark):
    docs, labels = labelled(spark)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    found = Q.quality(docs, labels).collect()
    unseen = [r for r in found if r.held_out]
    assert len(unseen) > 40 and all(r.predicted == truth[r.doc_id] for r in unseen)
    assert {r["_id"] for r in Q.sample(docs, labels).collect()}.isdisjoint(r.doc_id for r in unseen)


def test_awkward_rows(spark, awkward, nothing, wide):
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, 1, 0), (2, 0, 0), (3, 1, None), (None, 1, 0), (4, None, 0), (7, 0, 1), (9, 1, 1), (9, 0, 1)],
        "doc_id long, quality int, toxic int",
    )
    found = samples.rows(Q.quality(awkward, labels))
    assert len(found) == len(samples.AWKWARD) and all(0 <= r[2] <= 1 and r[3] == int(r[2] >= 0.5) for r in found)
    assert samples.rows(Q.quality(wide, labels)) == found
    assert Q.quality(nothing, labels).count() == 0
    no_labels = labels.limit(0)
    assert {r.score for r in Q.quality(awkward, no_labels).collect()} == {0.5}
    assert Q.drop_low_quality(wide, labels).columns == wide.columns
    assert samples.rows(Q.drop_low_quality(awkward, no_labels)) == samples.rows(awkward)


def test_scores_are_the_softmax_of_the_mean_vector():
    scores = np.random.default_rng(1).normal(size=Q.BUCKETS).astype(np.float32)
    words = b"some words here".split()
    odds = 0.3 + np.mean([scores[Q.word_buckets(w)].mean() for w in words])
    assert abs(Q.score_texts(["Some words  here"], scores.tobytes(), 0.3)[0] - 1 / (1 + np.exp(-odds))) < 1e-6
    assert abs(Q.score_texts([""], scores.tobytes(), 0.0)[0] - 0.5) < 1e-9


def test_held_out_accuracy(spark):
    found = Q.op4_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    unseen = found.filter("held_out")
    assert unseen.filter("predicted = quality").count() / unseen.count() > 0.97


def test_query_against_a_plain_loop(spark, small):
    """Vectors averaged word by word, n-gram by n-gram."""
    from xxhash import xxh32_intdigest

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores, bias = Q.fit(small, labels)
    texts = {r.doc_id: r.text or "" for r in small.collect()}
    for row in Q.op4_quality(spark, SF).collect():
        words = texts[row.doc_id].lower().encode().split()
        means = []
        for word in words:
            marked = b"<" + word + b">"
            grams = [word] + [marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)]
            means.append(np.mean([scores[xxh32_intdigest(g) % Q.BUCKETS] for g in grams], dtype=np.float64))
        odds = bias + (np.mean(means) if means else 0.0)
        assert abs(row.score - 1 / (1 + np.exp(-odds))) < 1e-5


def test_long_words_count_whole(monkeypatch):
    values = np.random.default_rng(2).normal(size=Q.BUCKETS).astype(np.float32)
    word = bytes(random.Random(1).randrange(97, 123) for _ in range(9000))
    assert abs(Q.word_mean(word, values) - values[Q.word_buckets(word)].mean(dtype=np.float64)) < 1e-6
    assert abs(Q.word_mean(word[:4095], values) - Q.word_mean(word[:4096], values)) < 0.01
    changed = word[:8000] + b"#" * 1000
    assert abs(Q.word_mean(changed, values) - values[Q.word_buckets(changed)].mean(dtype=np.float64)) < 1e-6 and Q.word_mean(changed, values) != Q.word_mean(word, values)


def test_a_text_over_the_budget_is_left_out_whole(spark, monkeypatch):
    monkeypatch.setattr(Q, "SAMPLE_CHARS", 60_000)
    docs, labels = labelled(spark)
    longest = spark.createDataFrame([(3, "w1$$$ " * 20_000, "en", "s", 1)], samples.DOCUMENTS)
    found = Q.quality(docs.filter("doc_id != 3").unionByName(longest), labels).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert sum(r.predicted == truth[r.doc_id] for r in found) > 0.98 * len(found)


def test_columns_of_the_caller_stay(spark, awkward):
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    kept = Q.drop_low_quality(awkward.withColumns({"score": F.lit("mine"), "_quality_score": F.lit("mine too"), "_row": F.lit(1)}), labels)
    assert kept.columns[-3:] == ["score", "_quality_score", "_row"] and all(r.score == "mine" and r["_quality_score"] == "mine too" for r in kept.collect())
