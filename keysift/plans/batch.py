"""One batch: reject known content, scan the rest, store and answer."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysift.model import require
from keysift.operators.dedupe import distinct_secrets
from keysift.operators.duplicates import (
    first_of_batch,
    first_stored,
    known_content,
    new_content,
    stored_matches,
)
from keysift.operators.metadata import parse_metadata
from keysift.operators.package import package_facts
from keysift.operators.reports import PART_SIZE, build_reports
from keysift.operators.scan import scan
from keysift.session import delete_paths, stage
from keysift.sources.rules import Rule
from keysift.sources.store import append_store, batch_index, load_index, load_store

# Bits of the filter over app keys: 16 MiB on every executor, whatever the number of keys.
FILTER_BITS = 1 << 27


@dataclass(frozen=True)
class BatchResult:
    reports: DataFrame  # stored reports of this batch
    replies: DataFrame  # (app_key, APKHash, reply_batch, reply_app) for content that was not scanned
    staged: tuple[str, ...]

    def release(self) -> None:
        """Delete the staged tables of the batch, once ``replies`` is no longer needed."""
        delete_paths(self.reports.sparkSession, self.staged)


def likely_files(files: DataFrame, apps: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The ``files`` of the ``apps(app_key)``, and a few others, by a bitmap over key hashes.

    The bitmap has a fixed size: one row per 32,768 bits, so it is broadcast for any number of apps.
    """
    place = F.pmod(F.xxhash64("app_key"), F.lit(bits))
    rows = apps.select(F.bitmap_bucket_number(place).alias("_bucket"), F.bitmap_bit_position(place).alias("_bit"))
    bitmap = rows.groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.expr("shiftright(_byte, cast(_at % 8 as int)) & 1") == 1
    joined = files.withColumn("_bucket", F.bitmap_bucket_number(place)).join(F.broadcast(bitmap), "_bucket")
    return joined.withColumns({"_byte": byte, "_at": bit}).where(is_set).select(*files.columns)


def scan_apps(files: DataFrame, apps: DataFrame, rules: DataFrame | Iterable[Rule]) -> DataFrame:
    """Distinct secrets of the ``apps(app_key)`` among ``files``; the text is never shuffled.

    A bitmap of the keys keeps most other files from being scanned; the findings, far
    fewer than the lines, are then joined exactly.
    """
    apps = apps.select("app_key")
    found = distinct_secrets(scan(likely_files(files, apps), rules, first_rule_only=True))
    return found.join(apps, "app_key", "left_semi")


def scan_batch(
    submissions: DataFrame,
    files: DataFrame,
    badging: DataFrame,
    documents: DataFrame,
    rules: DataFrame | Iterable[Rule],
    store_path: str,
    batch_id: int,
    *,
    rescan_duplicates: bool = False,
    part_size: int = PART_SIZE,
) -> BatchResult:
    """Process ``submissions(app_key, FileName, APKHash)`` of one batch.

    ``files(app_key, file_path, text)``, ``badging(app_key, text)`` and
    ``documents(app_key, json)`` hold what the apps contain.  Content stored by an
    earlier batch, or submitted before in this one, is answered and not scanned.
    Repeating a batch id repeats its result.
    """
    require(submissions, "app_key", "FileName", "APKHash")
    if not store_path:
        raise ValueError("a store path is required")
    spark = submissions.sparkSession
    # Fingerprints cost a pass over all content; the steps below read them from here.
    staged: list[str] = []
    submissions = stage(submissions.select("app_key", "FileName", "APKHash"), "submissions", staged)
    earlier = load_index(spark, store_path, submissions, before=batch_id)
    fresh = first_of_batch(submissions) if rescan_duplicates else new_content(submissions, earlier)
    fresh = stage(fresh.select("app_key"), "fresh", staged)
    found = stage(scan_apps(files, fresh, rules), "findings", staged)
    apps = submissions.join(fresh, "app_key", "left_semi")
    reports = build_reports(apps, package_facts(badging), parse_metadata(documents), found, part_size)
    append_store(reports, store_path, batch_id)
    known = known_content(submissions, earlier.unionByName(batch_index(spark, store_path, batch_id)))
    replies = known.where((F.col("reply_app") != F.col("app_key")) | (F.col("reply_batch") != batch_id))
    return BatchResult(load_store(spark, store_path).where(F.col("batch_id") == batch_id), replies, tuple(staged))


def duplicate_replies(submissions: DataFrame, store_path: str) -> tuple[DataFrame, DataFrame]:
    """What answers submissions whose content is known.

    ``(app_key, APKHash, reply_batch, reply_app)`` for every copy, from the index alone, and the
    stored reports they name, all parts, each once: a wide report is not repeated per copy.
    """
    spark = submissions.sparkSession
    index = load_index(spark, store_path, submissions)
    first = first_stored(stored_matches(submissions, index))
    reports = load_store(spark, store_path).join(first, ["APKHash", "batch_id", "app_key"], "left_semi")
    return known_content(submissions, index), reports
