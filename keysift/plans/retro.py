"""New rules against stored content: only files that may match are read again."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.operators.dedupe import distinct_secrets
from keysift.operators.reports import explode_findings
from keysift.operators.scan import scan
from keysift.session import stage
from keysift.sources.files import list_files, read_files
from keysift.sources.pieces import candidate_files, file_code, likely_files_of
from keysift.sources.rules import Rule


def rescan(files: DataFrame, rules: DataFrame | Iterable[Rule], index_path: str, **options) -> DataFrame:
    """Findings of ``rules`` in ``files(app_key, file_path, text)``, all of which are in the index at ``index_path``.

    Equal to a scan of all files, which only the rules without any literal of three letters need.
    """
    candidates, closed, open_rules = candidate_files(files.sparkSession, rules, index_path)
    parts = []
    if closed:
        parts.append(scan(likely_files_of(files, stage(candidates, "candidates")), closed, **options))
    if open_rules:
        parts.append(scan(files, open_rules, **options))
    return _union(parts)


def rescan_folder(
    spark: SparkSession, path: str, rules: DataFrame | Iterable[Rule], index_path: str, app_depth: int = 1, **options
) -> DataFrame:
    """As :func:`rescan`, for the files of a folder: those that can't match are not opened."""
    listing = list_files(spark, path, app_depth)
    candidates, closed, open_rules = candidate_files(spark, rules, index_path)
    parts = []
    if closed:
        # Names and codes alone are joined.
        named = listing.withColumn("file", file_code()).join(stage(candidates, "candidates"), "file", "left_semi")
        parts.append(scan(read_files(named, path), closed, **options))
    if open_rules:
        parts.append(scan(read_files(listing, path), open_rules, **options))
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    if not parts:
        raise ValueError("no valid rule to scan with")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def new_secrets(found: DataFrame, reports: DataFrame) -> DataFrame:
    """Distinct secrets of a rescan that no stored report of their app holds."""
    stored = explode_findings(reports).select("app_key", "SecretString").distinct()
    return distinct_secrets(found).join(stored, ["app_key", "SecretString"], "left_anti").select(*found.columns)
