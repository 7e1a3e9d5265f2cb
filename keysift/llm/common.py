"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.session import scratch_path

#: A list of heavy keys never has more rows than this, whatever the input (see ``attach``).
HEAVY_KEYS = 20_000
#: Bits of a filter over keys: 8 MiB on every executor.
FILTER_BITS = 1 << 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    """A text column, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3: fold 1 is held out from every training."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3


def held_out(doc_id: str = "doc_id") -> Column:
    return fold(doc_id) == 1


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, columns: list[str], own: Column) -> DataFrame:
    """``rows`` left-joined with ``groups`` on ``key``, without a task per heavy key.

    ``groups`` (staged; one row per key) says in ``size`` how many rows each key
    has.  A key with more than ``max(1000, total / HEAVY_KEYS)`` rows is heavy: there are
    at most HEAVY_KEYS of those, so they are broadcast and their rows stay
    where they are.  The rest is joined by shuffle; rows already served take the
    key ``own`` (spread, unique; a number of the row where it is null) there, so that they meet nothing.
    ``key`` is a non-null string, binary or long column.
    """
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    bound = max(1000, total // HEAVY_KEYS)
    named = [F.col(c).alias(f"_heavy_{c}") for c in columns]
    heavy = groups.filter(F.col(size) > bound).select(F.col(key).alias("_heavy_key"), *named)
    light = groups.filter(F.col(size) <= bound).select(F.col(key).alias("_light_key"), *[F.col(c).alias(f"_light_{c}") for c in columns])
    served = F.col("_heavy_key").isNotNull()
    kind = dict(rows.dtypes)[key]
    apart = F.coalesce(own.cast(kind), F.monotonically_increasing_id().cast("string" if kind == "binary" else kind).cast(kind))
    out = (
        rows.join(F.broadcast(heavy), F.col(key) == F.col("_heavy_key"), "left")
        .withColumn("_at", F.when(served, apart).otherwise(F.col(key)))
        .join(light, F.col("_at") == F.col("_light_key"), "left")
    )
    return out.select(
        *[F.col(c) for c in rows.columns],
        *[F.when(served, F.col(f"_heavy_{c}")).otherwise(F.col(f"_light_{c}")).alias(c) for c in columns],
    )


def suspected(rows: DataFrame, keys: DataFrame, key: str, column: str, bits: int = FILTER_BITS) -> DataFrame:
    """``rows`` with a boolean ``column``: false only where ``key`` is not among ``keys``.

    A bitmap over key hashes, broadcast: one row per 32,768 bits, so its size is fixed for any
    number of keys.  Most rows without a partner are told apart by it and need no shuffle.
    """
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    spots = keys.select(F.bitmap_bucket_number(place).alias("_bucket"), F.bitmap_bit_position(place).alias("_spot"))
    bitmap = spots.groupBy("_bucket").agg(F.bitmap_construct_agg("_spot").alias("_bits"))
    joined = rows.withColumns({"_bucket": F.bitmap_bucket_number(place), "_spot": F.bitmap_bit_position(place)}).join(F.broadcast(bitmap), "_bucket", "left")
    byte = F.conv(F.hex(F.substring("_bits", (F.col("_spot") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.expr("shiftright(_byte, cast(_spot % 8 as int)) & 1") == 1
    return joined.withColumn("_byte", byte).select(*rows.columns, F.coalesce(is_set, F.lit(False)).alias(column))


class WordCache(dict):
    """What ``make`` returns for a word, remembered up to about ``2 * room`` bytes.

    Two generations: when the younger is full it becomes the older one, so memory is
    bounded for any vocabulary and frequent words stay.  Words, and results, above LONG bytes are never kept.
    """

    LONG = 512
    #: Bytes of an entry besides its word and result: slots, object heads.
    ENTRY = 180

    def __init__(self, make: Callable[[bytes], object], room: int = 40 << 20) -> None:
        super().__init__()
        self.make, self.room, self.held, self.older = make, room, 0, {}

    def __missing__(self, word: bytes) -> object:
        found = self.older.get(word)
        if found is None:
            found = self.make(word)
        size = getattr(found, "nbytes", None) or (len(found) if isinstance(found, bytes) else 8)
        if len(word) > self.LONG or size > 4 * self.LONG:
            return found
        if self.held >= self.room:
            self.older, self.held = dict(self), 0
            self.clear()
        self[word] = found
        self.held += len(word) + size + self.ENTRY
        return found
