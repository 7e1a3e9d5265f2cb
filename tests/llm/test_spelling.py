import random
import re
import zlib
from collections import Counter

import pytest

from keysift.llm import spelling as V
from tests.compare import connect
from tests.llm import samples

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def vocabulary(rows) -> dict[str, int]:
    counts = Counter()
    for doc_id, text in rows:
        for run in RUN.findall((text or "").translate(samples.LOWER)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def is_near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def expected(words: dict[str, int]) -> list[tuple]:
    by_length: dict[int, list[str]] = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    forms, counts = {}, {}
    for w, n in words.items():
        near = [o for k in (len(w) - 1, len(w), len(w) + 1) for o in by_length.get(k, ()) if o != w and is_near(w, o)]
        counts[w] = len(near)
        best = min(near, key=lambda o: (-words[o], o), default=None)
        forms[w] = best if best and words[best] >= 10 * n else None

    def root(w: str) -> str:
        while forms[w]:
            w = forms[w]
        return w

    return sorted(((w, f, root(w), words[w], counts[w], words[f] if f else None) for w, f in forms.items()), key=repr)


def found(df) -> list[tuple]:
    return samples.rows(df, "word", "form", "root", "n", "n_near", "form_n")


def mutants(rng: random.Random, base: list[str], n: int, letters: str) -> list[str]:
    out = []
    for _ in range(n):
        w = rng.choice(base)
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(w) + 1)
            w = rng.choice((w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :], w[:i] + w[i + 1 :]))
        out.append(w)
    return out


def random_words(seed: int, n: int, letters: str) -> dict[str, int]:
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(7, 14))) for _ in range(n // 20)]
    return {w: int(2 * 10 ** rng.uniform(0, 4)) for w in mutants(rng, base, n, letters) if len(w) >= 7}


@pytest.mark.parametrize("seed, letters", [(1, "ab"), (2, "abcdefgé"), (3, "aaaaaaab")])
def test_random_vocabularies_against_all_pairs(spark, seed, letters):
    words = random_words(seed, 3000, letters)
    table = V.stage(spark.createDataFrame(list(words.items()), "word string, n long"), "words")
    rows = found(V.variants(table))
    assert rows == expected(words)
    assert any(r[1] for r in rows) and any(r[2] not in (r[0], r[1]) for r in rows)


def test_large_buckets_are_tiled(spark, monkeypatch):
    words = random_words(4, 1500, "ab")
    table = V.stage(spark.createDataFrame(list(words.items()), "word string, n long"), "words")
    monkeypatch.setattr(V, "TILE", 8)
    assert max(r["count"] for r in V.tiled(V.bucketed(table, 7)).groupBy("unit", "role").count().collect()) < 40
    assert found(V.variants(table)) == expected(words)


def test_bucket_split_over_batches():
    import pandas as pd

    rows = [("u", 7, 1, 3, w, n) for w, n in (("abcdefg", 50), ("abcdefh", 5), ("abcdefgh", 7), ("abcdeff", 2))]
    frame = pd.DataFrame(rows, columns=["unit", "length", "kind", "role", "word", "n"])
    whole = pd.concat(V.bucket_rows(iter([frame])))
    parts = pd.concat(V.bucket_rows(iter([frame.iloc[:1], frame.iloc[1:3], frame.iloc[3:]])))
    assert whole.values.tolist() == parts.values.tolist() and whole["n_near"].sum() == 10


def awkward_rows() -> list[tuple]:
    rng = random.Random(6)
    word = "ünïcodé wörds strasse STRASSE ÀÉÎÕÜÿ×÷ letters lettters letter5s lettrs Kelvinn".split()
    texts = [" ".join(rng.choice(word) for _ in range(40)) for _ in range(60)]
    long = "x" * 200_000
    return [r[:2] for r in samples.AWKWARD] + list(enumerate(texts, 100)) + [(None, texts[0]), (900, long + " " + long), (901, long), (902, "abcdefg" * 3)]


def test_awkward_rows(spark, nothing, wide, awkward):
    rows = awkward_rows()
    assert found(V.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"))) == expected(vocabulary(rows))
    assert found(V.spelling_variants(wide)) == found(V.spelling_variants(awkward))
    assert V.spelling_variants(nothing).count() == 0


def test_query_against_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert found(V.op13_spelling_variants(spark, sf)) == expected(vocabulary(rows))


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    theirs = connect(sf).execute(f"SELECT word, form, root, n, n_near, form_n FROM ({V.ORACLE})").fetchall()
    assert found(V.op13_spelling_variants(spark, sf)) == sorted(theirs, key=repr) and len(theirs) > 1000
