import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from keysift.llm import packing as P
from tests.llm import samples

TOKENIZER = Tokenizer.from_file(P.vocabulary_path())


def ids(text: str) -> list[int]:
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


def check(found, texts: list[tuple]) -> None:
    by: dict = {}
    for r in found:
        assert r["length"] & (r["length"] - 1) == 0 and r["length"] <= P.LONGEST and r["offset"] == 0
        by.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    assert len({r["sequence_id"] for r in found}) == len(found)
    whole: dict = {}
    for doc_id, text in texts:
        whole.setdefault((doc_id, len(ids(text))), []).append(ids(text))
    assert set(by) == set(whole)
    for key, own in whole.items():
        assert len(by[key]) == sum(len(P.cut(len(x))) for x in own)
        for tokens in own:
            for start, length in zip(np.cumsum([0, *P.cut(len(tokens))]), P.cut(len(tokens))):
                crc = zlib.crc32(np.array(tokens[start : start + length], "<u4").tobytes())
                assert any((r["start"], r["length"], r["ids_crc32"]) == (start, length, crc) for r in by[key])


def test_cut():
    assert P.cut(1) == [1] and P.cut(2048) == [2048] and P.cut(5000) == [2048, 2048, 512, 256, 128, 8]
    for n in range(1, 9000, 37):
        assert sum(P.cut(n)) == n


def test_awkward_rows(awkward, nothing, wide):
    check(P.digest(P.pack(awkward)).collect(), [r[:2] for r in samples.AWKWARD])
    assert samples.rows(P.pack(wide).drop("sequence_id")) == samples.rows(P.pack(awkward).drop("sequence_id"))
    assert P.pack(nothing).count() == 0
    with pytest.raises(ValueError):
        P.pack(awkward, longest=1000)


def test_words_equal_the_tokenizer():
    known = P.word_ids(P.vocabulary_path())
    for text in ("<|ENDOFTEXT|> a<|endoftext|>b. É́a É. don't I'LL x.y,z! ...a, 12. Σας ΣΑΣ. \x1c\xa0b", "ǅ ﬁ ß. ẞ İi, K. naïve? ñ: ﾊ! º ª."):
        found = np.frombuffer(b"".join(map(known.__getitem__, text.encode().split())), "<u4").tolist()
        assert [*found, 1] == ids(text)


def of_words(known, text: str) -> list[int]:
    return np.frombuffer(b"".join(map(known.__getitem__, text.encode().split())), "<u4").tolist()


def test_every_letter_before_every_mark():
    """All letters of Unicode, at the end of a word and as the whole of it."""
    known = P.word_ids(P.vocabulary_path())
    letters = [chr(c) for c in range(0x110000) if chr(c).isalpha()]
    for mark in P.MARKS:
        words = [x + mark for x in letters] + ["a" + x + mark for x in letters]
        for word, encoded in zip(words, TOKENIZER.encode_batch(words, add_special_tokens=False)):
            assert np.frombuffer(known[word.encode()], "<u4").tolist() == encoded.ids, word


def test_random_texts_equal_the_tokenizer():
    rng = random.Random(9)
    known = P.word_ids(P.vocabulary_path())
    odd = "İıſKÅẞßǅﬁéÉ\u0301\u0307\u0958\u09dc\u0a33ñÑüÜαΑςΣдДאب中文字\u1100\u1161ｱﾊﾟ²½0129"
    pieces = [*odd, *P.MARKS, *"abcxyzABCXYZ'-_/()%", "'s", "'LL", "...", " ", " ", " ", "\n", "\u00a0", "the", "TARİHİ", "ALİ"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14))) for _ in range(50_000)]
    for text, encoded in zip(texts, TOKENIZER.encode_batch(texts, add_special_tokens=False)):
        assert of_words(known, text) == encoded.ids, text


def test_query(spark, small):
    check(P.op2_packing(spark, "/root/testdata/sf0.001").collect(), [(r.doc_id, r.text) for r in small.collect()])


def test_bucket_files(spark, awkward, tmp_path):
    P.write_buckets(P.pack(awkward), str(tmp_path / "buckets"))
    back = spark.read.parquet(str(tmp_path / "buckets"))
    assert back.filter("bucket != length").count() == 0 and back.count() == P.pack(awkward).count()
