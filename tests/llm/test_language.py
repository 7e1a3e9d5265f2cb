import numpy as np

from keysift.llm import language as L
from tests.llm import samples


def test_gradients():
    rng = np.random.default_rng(2)
    network = L.ByteNetwork(3, rng)
    network.weights = {k: v.astype(np.float64) for k, v in network.weights.items()}
    x, y = rng.integers(32, 127, (5, L.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1, 0])

    def loss():
        network.tables()
        return -np.log(network.probabilities(x)[np.arange(5), y]).mean()

    slopes = network.step(x, y)
    for name in ("out", "bias", "conv2", "conv3", "conv4", "bias3", "bytes"):
        flat = network.weights[name].reshape(-1)
        for k in np.argsort(-np.abs(slopes[name].reshape(-1)))[:4]:
            kept = flat[k]
            flat[k] = kept + 1e-6
            above = loss()
            flat[k] = kept - 1e-6
            below = loss()
            flat[k] = kept
            assert abs((above - below) / 2e-6 - slopes[name].reshape(-1)[k]) < 1e-3 * max(1, abs(slopes[name].reshape(-1)[k]))


def test_every_byte_is_in_a_window():
    text = "ab" * 1000
    assert L.windows_of(text.encode()).tobytes().rstrip(b" ") == text.encode()
    assert L.windows_of(b"").shape == (0, L.WINDOW)


def test_awkward_rows(awkward, nothing, wide):
    found = samples.rows(L.languages(awkward))
    assert len(found) == len(samples.AWKWARD) and all(0 <= r[3] <= 1 for r in found)
    known = {r[2] for r in samples.AWKWARD if r[2]}
    for row in L.languages(awkward).collect():
        texts = [t for d, t, *_ in samples.AWKWARD if d == row.doc_id]
        if any(c.isalpha() for c in texts[0] or ""):
            assert row.lang_pred in known
        else:
            assert (row.lang_pred, row.score) == ("und", 0.0)
    assert samples.rows(L.languages(wide)) == found
    assert L.languages(nothing).count() == 0


def test_nothing_to_learn_from(spark, awkward):
    from pyspark.sql import functions as F

    blank = awkward.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in L.languages(blank).collect()} == {"und"}


def test_held_out_accuracy(spark):
    found = L.op5_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id")
    unseen = found.filter("held_out")
    assert unseen.filter("lang_pred = lang").count() / unseen.count() > 0.97


def test_query_against_the_convolution_written_out(spark, small):
    """Filters over byte vectors, maximum, softmax, mean over windows: from the weights alone."""
    sf = "/root/testdata/sf0.001"
    names, raw = L.fit(small)
    shapes = {k: v.shape for k, v in L.ByteNetwork(len(names)).weights.items()}
    p = {k: np.frombuffer(raw[k], np.float32).reshape(shapes[k]).astype(np.float64) for k in shapes}
    texts = {r.doc_id: r.text for r in small.collect()}
    for row in L.op5_language(spark, sf).collect():
        text = texts[row.doc_id]
        if not text or not any(c.isalpha() for c in text):
            assert (row.lang_pred, row.score) == ("und", 0.0)
            continue
        x = text.encode()
        x += b" " * (-len(x) % L.WINDOW)
        total = np.zeros(len(names))
        for at in range(0, len(x), L.WINDOW):
            vectors = p["bytes"][list(x[at : at + L.WINDOW])]
            hidden = [max(0.0, max(float((vectors[i : i + w].reshape(-1) * p[f"conv{w}"][:, f]).sum()) for i in range(0, L.WINDOW - w + 1)) + p[f"bias{w}"][f]) for w in L.WIDTHS for f in range(L.FILTERS)] if len(x) < 600 else None
            if hidden is None:
                hidden = np.concatenate([np.maximum((np.stack([vectors[i : i + w].reshape(-1) for i in range(L.WINDOW - w + 1)]) @ p[f"conv{w}"]).max(0) + p[f"bias{w}"], 0) for w in L.WIDTHS])
            raw_out = np.asarray(hidden) @ p["out"] + p["bias"]
            soft = np.exp(raw_out - raw_out.max())
            total += soft / soft.sum()
        mean = total / (len(x) // L.WINDOW)
        assert row.lang_pred == names[int(mean.argmax())] and abs(row.score - mean.max()) < 1e-4


def test_every_language_is_learned(spark):
    """Rare languages beside a frequent one, more of them than any list of the most frequent."""
    rows = [(i, f"lang{i % 30} " + chr(0x4E00 + i % 30) * 200, f"l{i % 30:02d}") for i in range(30 * 8)] + [(1000 + i, "common words of a frequent language " * 5, "zz") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, _ = L.fit(docs)
    assert len(names) == 31
    found = L.languages(docs).join(docs, "doc_id")
    assert found.filter("lang_pred = lang").count() > 0.9 * found.count()
    assert found.filter("lang != 'zz' and lang_pred = lang").count() > 0.5 * 240
