"""Distinct secrets and counts of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysift.model import FINDING_ORDER


def distinct_secrets(findings: DataFrame) -> DataFrame:
    """One finding per ``(app_key, SecretString)``: the first in rule order, then place.

    A minimum is combined before the shuffle, so a secret that a third of all
    rows share still arrives as one row per task.
    """
    rest = [c for c in findings.columns if c not in ("app_key", "SecretString", *FINDING_ORDER)]
    first = F.min(F.struct(*FINDING_ORDER, *rest)).alias("first")
    return (
        findings.groupBy("app_key", "SecretString")
        .agg(first)
        .select(*(c if c in ("app_key", "SecretString") else F.col(f"first.{c}") for c in findings.columns))
    )


def count_by_app(findings: DataFrame) -> DataFrame:
    return findings.groupBy("app_key").agg(F.count(F.lit(1)).alias("n_findings"))


def count_by_type(findings: DataFrame) -> DataFrame:
    return findings.groupBy("Type").agg(F.count(F.lit(1)).alias("n_findings"))


def count_by_rule(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings of every rule, including the rules without any.

    The findings are counted first; what joins the rules has one row per rule.
    """
    counts = findings.groupBy("pack", "ordinal").agg(F.count(F.lit(1)).alias("n"))
    return rules.join(counts, ["pack", "ordinal"], "left").select(
        "pack", "ordinal", "name", F.coalesce("n", F.lit(0)).alias("n_findings")
    )


def count_with_subtotals(findings: DataFrame) -> DataFrame:
    """``(pack, Type, level, n_findings, n_apps)``: by pack and type, by pack, and in all.

    ``level`` is the grouping id: 0 for a type of a pack, 1 for a pack, 3 for everything; what is not grouped by is null.
    Findings are first counted by app, so that subtotals expand one row for each app and type.
    """
    by_app = findings.groupBy("pack", "Type", "app_key").agg(F.count(F.lit(1)).alias("n"))
    return by_app.rollup("pack", "Type").agg(
        F.grouping_id().cast("int").alias("level"), F.sum("n").alias("n_findings"), F.count_distinct("app_key").alias("n_apps")
    )
