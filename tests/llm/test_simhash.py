import random

import numpy as np
import pandas as pd
import pytest
from xxhash import xxh64_intdigest

from keysift.llm import simhash as S
from keysift.llm.components import components
from tests.llm import samples


def fingerprint(text, words=3) -> int:
    own = samples.PLAIN_WORDS.findall((text or "").translate(samples.LOWER))
    shingles = [" ".join(own[i : i + words]) for i in range(len(own) - words + 1)] or [" ".join(own)] * bool(own)
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes: list[int], linked) -> list[int]:
    """Component root (place) of each node."""
    root = list(range(len(nodes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(nodes)):
        for j in range(i):
            if linked(nodes[i], nodes[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(nodes))]


def brute(rows, bits=3) -> list[tuple]:
    codes = [fingerprint(t) for _, t in rows]
    roots = groups(codes, lambda a, b: (a ^ b).bit_count() <= bits)
    least = {}
    for (doc_id, _), r in zip(rows, roots):
        if doc_id is not None:
            least[r] = min(least.get(r, doc_id), doc_id)
    return sorted(((d, f"{c:016x}", least.get(r)) for (d, _), c, r in zip(rows, codes, roots)), key=repr)


def test_awkward_rows(awkward, nothing, wide):
    expected = brute([r[:2] for r in samples.AWKWARD])
    assert samples.rows(S.near_duplicates(awkward)) == expected
    assert samples.rows(S.near_duplicates(wide)) == expected
    assert S.near_duplicates(nothing).count() == 0 and S.drop_near(nothing).count() == 0


def test_query(spark, small):
    assert samples.rows(S.op8_simhash(spark, "/root/testdata/sf0.001")) == brute([(r.doc_id, r.text) for r in small.collect()])


def test_near_copies(spark):
    rng = random.Random(4)
    rows = []
    for base in range(12):
        words = samples.prose(rng, 400).split()
        for copy in range(6):
            own = list(words)
            for _ in range(copy):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            rows.append((base * 10 + copy, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert samples.rows(S.near_duplicates(docs)) == brute(rows)
    kept = S.drop_near(docs)
    assert kept.columns == docs.columns and samples.rows(kept, "doc_id") == [(b * 10,) for b in sorted(range(12), key=lambda b: repr((b * 10,)))]


@pytest.mark.parametrize(("bits", "tile"), [(3, 4096), (3, 3), (7, 5), (10, 4096)])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, bits, tile):
    monkeypatch.setattr(S, "TILE", tile)
    rng = random.Random(bits)
    codes = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(12):
            code = centre
            for b in rng.sample(range(64), rng.randrange(bits + 2)):
                code ^= 1 << b
            codes.add(code)
    codes = sorted(codes)
    nodes = S.stage(spark.createDataFrame([(S._signed(c), S._signed(c)) for c in codes], "id long, fp long"), "test-nodes")
    found = {r.node: r.root for r in components(S.links(nodes, bits)).collect()}
    roots = groups(codes, lambda a, b: (a ^ b).bit_count() <= bits)
    ours = [found.get(S._signed(c), S._signed(c)) for c in codes]
    assert [ours.index(x) for x in ours] == [roots.index(x) for x in roots]


def test_thresholds_follow_the_generalised_pigeonhole():
    total, chosen = S.allocate([[0, 5, 9, 20], [0, 1, 2, 50], [0, 4, 30, 99]], 1)
    assert sum(chosen) == 1
    best = min(
        (a + b + c)
        for i, a in enumerate([0, 5, 9, 20])
        for j, b in enumerate([0, 1, 2, 50])
        for k, c in enumerate([0, 4, 30, 99])
        if i + j + k - 3 == 1
    )
    assert total == best


def test_correlated_bits_share_a_group():
    rng = np.random.default_rng(1)
    free = rng.integers(0, 2, (2000, 32))
    bits = np.concatenate([free, free], 1)  # bit b equals bit b + 32
    found = S.bit_groups(np.nan_to_num(np.corrcoef(bits.T)), 4)
    assert sorted(sum(found, [])) == list(range(64))
    assert all((b + 32) % 64 in g for g in found for b in g)


def test_plan_covers_the_radius(spark):
    rng = random.Random(9)
    nodes = spark.createDataFrame([(S._signed(rng.getrandbits(64)),) for _ in range(500)], "fp long")
    for bits in (0, 1, 3, 8):
        assert sum(t + 1 for _, _, t in S.plan(nodes, bits)) == bits + 1


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 61)}, 101: 100}


def test_forest_of_a_bucket():
    frame = pd.DataFrame({"unit": [1] * 5, "key": [1] * 5, "own": [True, True, True, False, True], "fp": [0, 1, 3, 7, 3 << 60]})
    columns = {c: frame[c].to_numpy() for c in frame}
    assert S.bucket_links(columns, 1, 0).tolist() == [[1, 0], [2, 0], [3, 0]]


def edited(rng: random.Random, words: list[str], similarity: float) -> list[str]:
    """A copy with words replaced until the five-word shingles are no more similar than that."""
    own = list(words)
    while jaccard(words, own) > similarity:
        own[rng.randrange(len(own))] = f"e{rng.randrange(10**9)}"
    return own


def jaccard(a: list[str], b: list[str]) -> float:
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a, b))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("length", [60, 200, 600])
def test_stage_recall_near_the_threshold(spark, length):
    rng = random.Random(length)
    rows, truth = [], []
    for i in range(400):
        words = samples.prose(rng, length, 50_000).split()
        copy = edited(rng, words, 0.8 + 0.05 * rng.random() + 1.5 / length)
        truth.append(jaccard(words, copy))
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
    kept = {r.doc_id for r in S.drop_near(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()}
    wanted = [2 * i + 1 for i, t in enumerate(truth) if t >= 0.8]
    assert len(wanted) > 250 and sum(t < 0.86 for t in truth) > 250
    assert all(2 * i in kept for i in range(400))
    assert sum(i not in kept for i in wanted) >= 0.95 * len(wanted)


def test_stage_keeps_what_is_not_similar(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        words = samples.prose(rng, 200, 50_000).split()
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(edited(rng, words, 0.65)))]
    assert S.drop_near(spark.createDataFrame(rows, "doc_id long, text string")).count() >= 597


@pytest.mark.parametrize("tile", [4096, 5])
def test_band_links_connect_similar_sketches(spark, monkeypatch, tile):
    """Chains of near copies in one bucket, whole and in tiles, against all pairs of sketches."""
    monkeypatch.setattr(S, "TILE", tile)
    rng = np.random.default_rng(5)
    least = S.bytes_alike(0.8)
    sketches = []
    for _ in range(6):
        one = rng.integers(0, 256, S.HASHES).astype(np.uint8)
        for _ in range(8):
            sketches.append(one)
            one = one.copy()
            one[rng.choice(S.HASHES, 40, replace=False)] += 1
    nodes = S.stage(spark.createDataFrame([(i, [7, i], bytearray(x.tobytes())) for i, x in enumerate(sketches)], "id long, bands array<long>, bytes binary"), "nodes")
    found = {r.node: r.root for r in components(S.band_links(nodes, 0.8)).collect()}
    roots = groups(range(len(sketches)), lambda a, b: (sketches[a] == sketches[b]).sum() >= least)
    ours = [found.get(i, i) for i in range(len(sketches))]
    assert [ours.index(x) for x in ours] == [roots.index(x) for x in roots] and len(set(ours)) == 6
