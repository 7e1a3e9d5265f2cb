"""One flat row per app, for models."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysift.model import LIST, METADATA_BLOCKS, METADATA_TOP, PACKAGE_LISTS, PACKAGE_STRINGS
from keysift.sources.rules import Rule


def type_columns(rules: Iterable[Rule]) -> dict[str, str]:
    """Finding types of the rules, in their order, to column names; the number keeps names apart."""
    types = list(dict.fromkeys(r.name for r in rules))
    return {t: f"n{i}_{re.sub(r'[^a-z0-9]+', '_', t.lower()).strip('_')}" for i, t in enumerate(types)}


def feature_table(reports: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """Package facts, metadata (``meta_``) and findings per type of every report, by batch and app.

    The types come from the rules, not from the data.  All parts of a report count together.
    """
    names = type_columns(rules)
    keys = [c for c in ("batch_id", "app_key") if c in reports.columns]
    first = reports.where(F.col("part") == 0)
    paths = {n: (f"Metadata.{n}", kind) for n, kind in METADATA_TOP}
    paths |= {f"{b}_{n}": (f"Metadata.{b}.{n}", kind) for b, fields in METADATA_BLOCKS.items() for n, kind in fields}
    slim = first.select(
        *keys,
        F.col("FileName").alias("file_name"),
        "APKHash",
        "APKVersion",
        *(F.col(f"PackageDataModel.{c}").alias(c) for c in PACKAGE_STRINGS),
        *(F.size(f"PackageDataModel.{c}").alias(f"n_{c}") for c in PACKAGE_LISTS),
        *(F.size(p).alias(f"meta_n_{c}") if kind == LIST else F.col(p).alias(f"meta_{c}") for c, (p, kind) in paths.items()),
        "n_findings",
    )
    column = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    found = reports.select(*keys, F.inline("Findings")).select(*keys, column[F.col("Type")].alias("_type"))
    # Findings of a large app are counted before they meet.
    counts = found.groupBy(*keys, "_type").count().groupBy(*keys).pivot("_type", list(names.values())).agg(F.sum("count"))
    joined = slim.join(counts, keys, "left")
    return joined.select(*slim.columns, *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in names.values()))
