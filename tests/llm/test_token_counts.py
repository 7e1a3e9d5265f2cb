import random

import pytest
from pyspark.sql import functions as F

from keysift.llm import token_counts as T
from keysift.llm.packing import vocabulary_path
from tests.llm import samples

PATH = vocabulary_path(T.VOCABULARY)


def full(text: str) -> int:
    pattern, count = T._tools(PATH)
    return sum(count[p] for p in pattern.findall(text))


def whole_encoding(text: str) -> int:
    import base64

    import public_tokenizers
    import tiktoken

    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return len(tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text))


@pytest.mark.parametrize("seed", range(8))
def test_edits_equal_a_full_count(seed):
    rng = random.Random(seed)
    alphabet = "ab  \n'sl1 2.,\t!日x é"
    for _ in range(80):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 400)))
        tree = T.SegmentTree(text, PATH)
        for _ in range(rng.randrange(1, 6)):
            a = rng.randrange(0, len(text) + 1)
            b = min(len(text), a + rng.choice([0, 1, 2, 5, 60, 300]))
            new = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 3, 10, 100])))
            text = text[:a] + new + text[b:]
            tree.edit(a, b, new)
            assert (tree.text(), tree.total, tree.chars[1]) == (text, full(text), len(text))


def test_a_small_edit_encodes_little():
    tree = T.SegmentTree("some words of a text " * 5000, PATH)
    tree.edit(50_000, 50_004, "other")
    assert tree.encoded < 200 and tree.total == full(tree.text())


def test_counts_are_those_of_the_encoder():
    for text in (t for _, t, *_ in samples.AWKWARD if t):
        assert T.SegmentTree(text, PATH).total == whole_encoding(text)


def test_awkward_rows(spark, awkward, nothing, wide):
    edits = F.array(F.struct(F.lit(4).cast("long").alias("start"), F.lit(7).cast("long").alias("end"), F.lit("2").alias("new")))
    found = samples.rows(T.count_edited(awkward, edits))
    assert len(found) == len(samples.AWKWARD)
    expected = []
    for doc_id, text, *_ in samples.AWKWARD:
        text = text or ""
        after = text[:4] + "2" + text[7:]
        expected.append((doc_id, 1, full(text), full(after), len(after)))
    assert sorted(expected, key=repr) == sorted((f[:5] for f in found), key=repr)
    assert samples.rows(T.count_edited(wide, edits)) == found
    assert T.count_edited(nothing, edits).count() == 0
    none = T.count_edited(awkward, F.lit(None).cast("array<struct<start:bigint,end:bigint,new:string>>"))
    assert all(r.tokens_before == r.tokens_after and r.chars_encoded == 0 for r in none.collect())


def test_query_against_a_full_count(spark, small):
    texts = {r.doc_id: r.text for r in small.collect()}
    import re

    for r in T.op1_token_counts(spark, "/root/testdata/sf0.001").collect():
        masked, n = re.subn(T.MASKED, T.MARK, texts[r.doc_id])
        assert (r.n_edits, r.tokens_before, r.tokens_after, r.chars_after) == (n, full(texts[r.doc_id]), full(masked), len(masked))
