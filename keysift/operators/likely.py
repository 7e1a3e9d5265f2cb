"""Splitting a table by a list of keys without moving it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of a filter over keys: 16 MiB on every executor, whatever the number of keys.
FILTER_BITS = 1 << 27


def mark_likely(rows: DataFrame, keys: DataFrame, key: str, column: str, bits: int = FILTER_BITS) -> DataFrame:
    """``rows`` with a boolean ``column``: false only where ``key`` is not among ``keys``, true also for a few others.

    A bitmap over key hashes, broadcast: one row per 32,768 bits, so its size is fixed for any number of keys.
    """
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    spots = keys.select(F.bitmap_bucket_number(place).alias("_bucket"), F.bitmap_bit_position(place).alias("_bit"))
    bitmap = spots.groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    placed = rows.withColumns({"_bucket": F.bitmap_bucket_number(place), "_at": F.bitmap_bit_position(place)})
    joined = placed.join(F.broadcast(bitmap), "_bucket", "left")
    byte = F.conv(F.hex(F.substring("_bits", (F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.expr("shiftright(_byte, cast(_at % 8 as int)) & 1") == 1
    return joined.withColumn("_byte", byte).select(*rows.columns, F.coalesce(is_set, F.lit(False)).alias(column))


def without_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` is not among ``keys``; only those that a bitmap takes for such are shuffled."""
    marked = mark_likely(rows, keys, key, "_likely")
    rest = marked.where("_likely").join(keys.select(key).distinct(), key, "left_anti")
    return marked.where("NOT _likely").select(*rows.columns).unionByName(rest.select(*rows.columns))


def any_of(column: str, values: Iterable[str]) -> Column:
    """Whether a column has one of some values, as equalities joined pairwise.

    Unlike a list, which a file scan takes by its bounds alone, they are held against the statistics of every page.
    """
    terms = [F.col(column) == F.lit(v) for v in values] or [F.lit(False)]
    while len(terms) > 1:
        terms = [a | b for a, b in zip(terms[::2], terms[1::2])] + terms[len(terms) // 2 * 2 :]
    return terms[0]
