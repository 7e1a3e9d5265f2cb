"""Packing by power-of-two decomposition.

A document of n tokens (its ids and the end id) is cut into pieces whose lengths
are powers of two: as many of ``longest`` as fit, then the binary digits of the rest,
largest first.  Each piece is a sequence of its own, so no sequence crosses documents
and none needs padding; sequences of equal length form a bucket, and a training batch is
drawn from one bucket.  Everything is local to a document: no shuffle, no counting pass.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cache
from unicodedata import is_normalized, normalize

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.llm.common import WordCache, table, text_of

LONGEST = 2048
END_ID = 1
VOCABULARY = "word_bpe_49k.json"

MARKS = ".,;:!?"
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def byte_letters() -> dict[int, int]:
    """The letter that byte-level vocabularies write for a byte: itself if visible, else one from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in visible)
    return {b: 256 + i for i, b in enumerate(rest)}


def ends_in_letter(letter: str) -> bool:
    """Whether a letter's normal form in lower case ends in a letter."""
    return letter.isascii() or (normalize("NFC", letter.lower())[-1].isalpha() and normalize("NFC", letter).lower()[-1].isalpha())


@cache
def word_ids(path: str) -> WordCache:
    """Ids of a word as little-endian unsigned 32-bit bytes.

    The vocabulary drops white space and none of its rules looks across it, so the ids
    of a text are those of its words (cut at ASCII white space) in a row.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model, letters = tokenizer.model, byte_letters()

    def ids(word: bytes) -> bytes:
        if b"<|" in word:  # it may hold a special token, which is not lower-cased
            return packed(tokenizer.encode(word.decode(), add_special_tokens=False).ids)
        # Lower case is the vocabulary's own first step, and a mark behind letters is a
        # token of its own: such words are made of what is known already.  (Some letters, once normalised, end in
        # a combining mark, which goes with what follows.)
        plain = word.lower()
        if plain != word:
            return known[plain]
        text = plain.decode()
        if text[-1] in MARKS and text[:-1].isalpha() and ends_in_letter(text[-2]):
            return known[plain[:-1]] + known[plain[-1:]]
        # Lower-case Latin letters are one piece and stay as they are: the merges alone are left to do.
        if text.isalpha() and (text.isascii() or (max(text) < "\u0250" and text == text.lower() and is_normalized("NFC", text))):
            return packed([t.id for t in model.tokenize(text if text.isascii() else plain.decode("latin-1").translate(letters))])
        return packed(tokenizer.encode(text, add_special_tokens=False).ids)

    known = WordCache(ids, room=56 << 20)
    return known


def cut(n: int, longest: int = LONGEST) -> list[int]:
    """Lengths of the pieces of n tokens: whole ``longest`` ones, then the binary digits of the rest."""
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, longest: int = LONGEST, path: str | None = None) -> DataFrame:
    """One row per sequence: doc_id, start, length, doc_tokens, ids, bucket, sequence_id, offset.

    ``ids`` holds unsigned 32-bit little-endian token ids, the end id last in a document.
    ``bucket`` is the sequence length; sequence_id is unique, offset is 0 throughout.

    Null text counts as empty: one piece with the end id alone.  A null doc_id is
    kept as null; repeated rows are packed once each; an empty table gives no rows;
    columns other than doc_id and text are ignored, whatever they are called.
    ``longest`` must be a power of two.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    path = path or vocabulary_path()
    end = np.array([END_ID], dtype="<u4").tobytes()

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = word_ids(path)
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for doc_id, text in zip(batch["doc_id"].astype(object), batch["text"]):
                ids = b"".join(map(known.__getitem__, text.encode().split())) + end
                n, at = len(ids) // 4, 0
                for length in cut(n, longest):
                    rows.append((doc_id, at, length, n, ids[4 * at : 4 * (at + length)]))
                    at += length
                held += len(ids)
                if held > 8 << 20:
                    yield frame(rows)
                    rows, held = [], 0
            if rows:
                yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "doc_tokens", "ids"])
        return out.assign(doc_id=out["doc_id"].astype("Int64"))

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return plain.mapInPandas(pieces, PIECES).select(
        "*",
        F.col("length").alias("bucket"),
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )


def write_buckets(packed: DataFrame, folder: str) -> None:
    """The sequences as files, a sub-folder for each length."""
    packed.write.partitionBy("bucket").parquet(folder)


def digest(packed: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket"
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents")))
