"""Package facts from badging text, without a shuffle: each text is one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysift.functions.text import colon_segment, quoted_runs, token
from keysift.model import PACKAGE_LISTS, PACKAGE_STRINGS

# Line keywords of the badging format.
PACKAGE_LINE = "package"
SEGMENT_LINES = {"SdkVersion": "sdkVersion", "TargetSdk": "targetSdkVersion"}
LIST_LINES = {"SupportScreens": "supports-screens", "Densities": "densities", "NativeCode": "native-code"}


def _last_value(lines: Column, word: str, value) -> Column:
    """The value of the last line that contains ``word`` and has one."""
    values = F.transform(F.filter(lines, lambda x: F.contains(x, F.lit(word))), value)
    return F.try_element_at(F.filter(values, lambda v: v.isNotNull()), F.lit(-1))


def _token_value(n: int):
    return lambda line: F.get(quoted_runs(token(line, n)), F.lit(0))


def package_facts(badging: DataFrame) -> DataFrame:
    """``badging(app_key, text)`` to one typed row per app.

    A field without a usable line is an empty string or an empty array.
    """
    lines = F.col("lines")
    columns = {}
    for n, name in enumerate(PACKAGE_STRINGS[:4], 1):
        columns[name] = _last_value(lines, PACKAGE_LINE, _token_value(n))
    for name, word in SEGMENT_LINES.items():
        columns[name] = _last_value(lines, word, lambda x: F.get(quoted_runs(colon_segment(x)), F.lit(0)))
    for name, word in LIST_LINES.items():
        columns[name] = _last_value(
            lines,
            word,
            lambda x: F.split(F.try_element_at(quoted_runs(colon_segment(x)), F.lit(-1)), " ", -1),
        )
    split = badging.select("app_key", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))
    empty = F.array().cast("array<string>")
    return split.select(
        "app_key",
        *(F.coalesce(columns[c], F.lit("")).alias(c) for c in PACKAGE_STRINGS),
        *(F.coalesce(columns[c], empty).alias(c) for c in PACKAGE_LISTS),
    )
