"""Small awkward tables for the corpus operators, and brute-force helpers."""

from __future__ import annotations

import random
import re

SPACE = re.compile(r"[\x20\x09-\x0D]+")
PLAIN_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}

AWKWARD = [
    (1, "one two three four five six seven", "en", "a", 3),
    (2, "one two  three\tfour five six seven", "en", "a", None),
    (2, "one two  three\tfour five six seven", "en", "a", None),
    (3, None, None, None, None),
    (4, "", "fr", "b", 0),
    (5, " \n\t", "fr", "b", 0),
    (None, "a row without an id, of some words in all", "de", None, 1),
    (None, "one two three four five six seven", None, None, 1),
    (7, "Der lange Text " * 4000, "de", "c", 1),
    (8, "é日本語 <|endoftext|> don't I'LL  x.y,z! token = \"0123456789abcdef0123456789abcdef\"", "xx", "c", 1),
    (9, "cc by CC-BY all rights reserved; General Public\nLicense", "en", "c", 1),
]
#: Extra columns whose names the operators use inside or return.
CLASHING = "score double, label int, fp long, length long, id long, kept boolean, n long, `_row` string, `_id` long, hash long, words string"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(spark):
    return spark.createDataFrame(AWKWARD, DOCUMENTS)


def clashing(spark):
    """The awkward table with columns that clash."""
    wide = [(*row, 0.5, 1, 2, 3, 4, True, 5, "r", 6, 7, "w") for row in AWKWARD]
    return spark.createDataFrame(wide, f"{DOCUMENTS}, {CLASHING}")


def rows(df, *columns) -> list[tuple]:
    found = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in found.collect()), key=repr)


def prose(rng: random.Random, n: int, vocabulary: int = 3000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))
