import random

import numpy as np
import pytest

from keysift.llm import decontaminate as D
from tests.llm import samples


def smith_waterman(a, b) -> int:
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            same = D.MATCH if a[i - 1] == b[j - 1] else D.MISMATCH
            h[i, j] = max(0, h[i - 1, j - 1] + same, h[i - 1, j] + D.GAP, h[i, j - 1] + D.GAP)
    return int(h.max())


@pytest.mark.parametrize("seed", range(30))
def test_alignment_score(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 4, rng.integers(1, 25)).astype(np.uint64), rng.integers(0, 4, rng.integers(1, 60)).astype(np.uint64)
    score, first, last = D.align(a, b)
    assert score == smith_waterman(a, b)
    if score:
        assert smith_waterman(a, b[first : last + 1]) == score


def test_word_codes():
    one = D.word_codes("The cat; the CAT -- thecat " + "z" * 100_000 + " cat")
    assert one[0] == one[2] and one[1] == one[3] == one[-1] and len(set(one.tolist())) == 4
    assert len(D.word_codes("... --")) == 0 and len(D.word_codes("")) == 0


def planted(spark):
    rng = random.Random(8)
    items = [(i, samples.prose(rng, 40)) for i in range(5)] + [(None, None), (6, ""), (7, "two words"), (8, "...")]
    rows, truth = [], set()
    for d in range(40):
        text = samples.prose(rng, 300).split()
        if d % 4 == 0:
            own = items[d % 5][1].split()
            if d % 8 == 0:  # an edited copy: words changed, put in and left out
                for _ in range(3):
                    own[rng.randrange(len(own))] = "changed"
                own.insert(rng.randrange(len(own)), "added")
                del own[rng.randrange(len(own))]
            at = rng.randrange(300)
            text[at:at] = own
            truth.add((d, items[d % 5][0]))
        rows.append((d, " ".join(text).capitalize()))
    rows += [(50, None), (51, ""), (None, items[0][1]), (52, "Two, words!"), (52, "Two, words!")]
    truth |= {(None, 0), (52, 7)}
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), truth


def test_planted_copies(spark, nothing):
    docs, items, truth = planted(spark)
    found = D.find_copies(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == truth and len(found) == len(truth) + 1
    kept = D.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len(found)
    assert D.find_copies(nothing, items).count() == 0
    assert D.find_copies(docs, items.limit(0)).count() == 0 and D.drop_contaminated(docs, items.limit(0)).count() == docs.count()


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    docs, items, _ = planted(spark)
    whole, kept = samples.rows(D.find_copies(docs, items)), samples.rows(D.drop_contaminated(docs, items))
    monkeypatch.setattr(D, "BLOCK_WORDS", 45)
    assert len(list(D._blocks(items))) == 3
    assert samples.rows(D.find_copies(docs, items)) == whole
    assert samples.rows(D.drop_contaminated(docs, items)) == kept


def edited(rng: random.Random, words: list[str], edits: int) -> list[str]:
    own = list(words)
    for _ in range(edits):
        i = rng.randrange(len(own))
        kind = rng.randrange(3)
        own[i : i + (kind != 0)] = [] if kind == 2 and len(own) > 1 else [f"e{rng.randrange(10**6)}"]
    return own


@pytest.mark.parametrize(("length", "least"), [(2, 1.0), (3, 1.0), (5, 1.0), (8, 1.0), (11, 1.0), (12, 0.97), (20, 0.97), (50, 0.99)])
def test_recall_of_seeds_by_length(spark, length, least):
    """Edited copies that alignment alone takes for such, down to the threshold: the share that seeds lead to."""
    rng = random.Random(length)
    items, docs, wanted = [], [], set()
    for i in range(250):
        own = samples.prose(rng, length, 400).split()
        copy = edited(rng, own, rng.randrange(1, max(2, length * 2 // 5)))
        text = samples.prose(rng, 30, 400).split()
        text[15:15] = copy
        items.append((i, " ".join(own)))
        docs.append((i, " ".join(text)))
        a, b = D.word_codes(items[i][1]), D.word_codes(docs[i][1])
        if D.align(a, b)[0] >= D.THRESHOLD * D.MATCH * length:
            wanted.add(i)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.doc_id for r in D.find_copies(table, spark.createDataFrame(items, "item_id long, text string")).collect() if r.doc_id == r.item_id}
    assert found <= wanted and len(found) >= least * len(wanted) and len(wanted) > 30


def test_query_against_every_item_in_every_window(spark):
    """Without seeds: any item whose words are mostly in a document is aligned with the whole of it."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = [(r.item_id, D.word_codes(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    expected = set()
    for r in docs:
        words = D.word_codes(r.text)
        have = set(words.tolist())
        for item_id, own in items:
            if len(own) and sum(w in have for w in own.tolist()) >= D.THRESHOLD * len(own):
                if D.align(own, words)[0] >= D.THRESHOLD * D.MATCH * len(own):
                    expected.add((r.doc_id, item_id))
    found = D.op10_decontamination(spark, sf).collect()
    assert {(r.doc_id, r.item_id) for r in found} == expected and len(expected) > 10


def test_awkward_rows(spark, awkward, wide):
    items = spark.createDataFrame([(1, samples.AWKWARD[0][1], 1)], "item_id long, text string, score long")
    found = samples.rows(D.find_copies(awkward, items), "doc_id")
    assert found == [(1,), (2,), (2,), (None,)]
    assert samples.rows(D.find_copies(wide, items)) == samples.rows(D.find_copies(awkward, items))
    assert D.drop_contaminated(wide, items).columns == wide.columns
