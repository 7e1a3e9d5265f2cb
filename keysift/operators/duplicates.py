"""Known content: fingerprints against a batch and against the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_COPIES = 1_000_000


def skew_join(left: DataFrame, right: DataFrame, key: str, spread_by: str, hot: int = HOT_COPIES) -> DataFrame:
    """Inner join where some keys fill ``left`` and have few rows in ``right``.

    Keys with more than ``hot`` rows are split into pieces of about that size and
    their right rows are repeated per piece.  There are at most ``rows / hot``
    such keys, so their list is broadcast: no row moves by a bare hot key.
    """
    heavy = (
        left.groupBy(key)
        .agg(F.count(F.lit(1)).alias("copies"))
        .where(F.col("copies") > hot)
        .select(key, F.ceil(F.col("copies") / hot).cast("int").alias("pieces"))
    )
    heavy = F.broadcast(heavy)
    pieces = F.coalesce("pieces", F.lit(1))
    salted = left.join(heavy, key, "left").withColumn("salt", F.pmod(F.xxhash64(spread_by), pieces).cast("int"))
    repeated = right.join(heavy, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), pieces - 1)))
    return salted.drop("pieces").join(repeated.drop("pieces"), [key, "salt"]).drop("salt")


def first_of_batch(submissions: DataFrame) -> DataFrame:
    """``(APKHash, app_key, copies)``: the first submission of each content."""
    return submissions.groupBy("APKHash").agg(
        F.min("app_key").alias("app_key"), F.count(F.lit(1)).alias("copies")
    )


def first_stored(store: DataFrame) -> DataFrame:
    """The first stored report of each content: ``(APKHash, batch_id, app_key)``."""
    first = F.min(F.struct("batch_id", "app_key")).alias("first")
    return store.groupBy("APKHash").agg(first).select("APKHash", "first.batch_id", "first.app_key")


def stored_matches(submissions: DataFrame, store: DataFrame) -> DataFrame:
    """The stored rows whose content is in the batch.

    A store outgrows its batches: against a small batch it is filtered in place, and
    only what is left is shuffled.
    """
    return store.join(submissions.select("APKHash").distinct(), "APKHash", "left_semi")


def new_content(submissions: DataFrame, store: DataFrame) -> DataFrame:
    """Submissions to scan: first of their content in the batch and not in the store.

    Copies are reduced before the join, which then has one row per content.
    """
    known = stored_matches(submissions, store.select("APKHash"))
    return first_of_batch(submissions).join(known, "APKHash", "left_anti")


def known_content(submissions: DataFrame, store: DataFrame, hot: int = HOT_COPIES) -> DataFrame:
    """Submissions whose content is stored, with the report that answers them."""
    found = stored_matches(submissions, store.select("APKHash", "batch_id", "app_key"))
    stored = first_stored(found).select(
        "APKHash", F.col("batch_id").alias("reply_batch"), F.col("app_key").alias("reply_app")
    )
    return skew_join(submissions.select("app_key", "APKHash"), stored, "APKHash", "app_key", hot)
