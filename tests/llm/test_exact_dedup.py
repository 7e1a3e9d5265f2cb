import hashlib
import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keysift.llm import exact_dedup as X
from tests.compare import connect, difference
from tests.llm import samples


def brute(documents: list[tuple]) -> list[tuple]:
    norm = [samples.SPACE.sub("", t or "") for _, t in documents]
    out = []
    for (doc_id, text), own in zip(documents, norm):
        group = [(-len(t or ""), d is None, d) for (d, t), n in zip(documents, norm) if n == own]
        best = min(group, key=lambda g: (g[0], g[1], g[2] or 0))
        kept = (doc_id, -len(text or "")) == (best[2], best[0])
        out.append((doc_id, best[2], len(group), kept, hashlib.sha256(own.encode()).hexdigest(), group.count(best)))
    return sorted(out, key=repr)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", max_size=6).map(str.encode), max_size=40))
def test_trie_counts_every_string(keys):
    trie = X.RadixTrie()
    for i, key in enumerate(keys):
        trie.insert(key, (0, i, 1, 1))
    found = dict(trie.items())
    assert {k: (t[1], t[3]) for k, t in found.items()} == {k: (keys.index(k), keys.count(k)) for k in keys}
    assert sum(1 for _ in trie.items()) == len(found)


def test_spilled_subtrees_merge_again():
    rng = random.Random(1)
    keys = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 9))) for _ in range(500)]
    batch = pd.DataFrame({"content": keys, "chars": 1, "id": pd.array(range(500), "Int64")})
    small = pd.concat(X.local_tries(iter([batch]), budget=40))
    assert len(small) > len(set(keys))
    merged = pd.concat(X.owner_tries(iter([small.sort_values(["length", "hash"], kind="stable")])))
    assert len(merged) == len(set(keys)) and merged["n"].sum() == 500
    assert set(merged["id"]) == {keys.index(k) for k in keys}


def test_awkward_rows(awkward, nothing, wide):
    expected = brute([r[:2] for r in samples.AWKWARD])
    assert samples.rows(X.exact_groups(awkward)) == expected
    assert samples.rows(X.exact_groups(wide)) == expected
    assert X.exact_groups(nothing).count() == 0 and X.drop_exact(nothing).count() == 0


def test_drop_keeps_one_row_of_each_text(awkward, wide):
    for docs in (awkward, wide):
        kept = X.drop_exact(docs)
        assert kept.columns == docs.columns
        texts = [samples.SPACE.sub("", r["text"] or "") for r in kept.collect()]
        assert sorted(texts) == sorted({samples.SPACE.sub("", r[1] or "") for r in samples.AWKWARD})
        assert 2 in [r["doc_id"] for r in kept.collect()] and 1 not in [r["doc_id"] for r in kept.collect()]


def test_heavy_groups(spark):
    rows = [(i, f"copied  {'x' * (i % 3)}text" if i % 2 else f"text {i}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in X.exact_groups(docs).collect()}
    assert len(found) == 6000 and found[1].group_size == 1000 and found[1].keep_id == 1 and found[4].kept
    assert X.drop_exact(docs).count() == 3003


def test_oracle(spark):
    sf = "/root/testdata/sf0.001"
    assert difference(X.op3_exact_dedup(spark, sf), connect(sf), X.ORACLE) == (200, "")


def test_needs_text(spark):
    with pytest.raises(ValueError):
        X.drop_exact(spark.createDataFrame([(1,)], "doc_id long"))


@pytest.mark.parametrize("budget", [1, 3000, 1 << 30])
def test_owners_merge_within_any_budget(budget):
    rng = random.Random(2)
    keys = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 9))) for _ in range(800)]
    batch = pd.DataFrame({"content": keys, "chars": 1, "id": pd.array(range(800), "Int64")})
    records = pd.concat(X.local_tries(iter([batch]), budget=2000)).sort_values(["length", "hash"], kind="stable")
    cuts = [records.iloc[:100], records.iloc[100:350], records.iloc[350:]]
    merged = pd.concat(X.owner_tries(iter(cuts), budget))
    assert len(merged) == len(set(keys)) and merged["n"].sum() == 800 and set(merged["id"]) == {keys.index(k) for k in keys}


def test_memory_of_tries():
    """A million short texts and a thousand of a megabyte: a trie, with its nodes, stays near its budget of 16 MB."""
    import tracemalloc

    def batches():
        for at in range(0, 1_000_000, 5000):
            yield pd.DataFrame({"content": [b"k%015d" % (i * 7919 % 10**9) for i in range(at, at + 5000)], "chars": 16, "id": pd.array(range(at, at + 5000), "Int64")})
        for i in range(1000):
            yield pd.DataFrame({"content": [b"%07d" % i * 150_000], "chars": 1_050_000, "id": pd.array([i], "Int64")})

    tracemalloc.start()
    n = sum(len(frame) for frame in X.local_tries(batches(), budget=16 << 20))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    # Besides the trie: a subtree on its way out and frames of some 4 MB.
    assert n == 1_001_000 and peak < 80 << 20
