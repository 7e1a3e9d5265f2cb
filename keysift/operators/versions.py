"""Stored reports compared across the versions of a package."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def compare_versions(reports: DataFrame) -> DataFrame:
    """``(PackageName, VersionCode, before, SecretString, change)``: what each version adds, drops and keeps.

    Versions of a package follow by number (codes that are none come first, by text).  ``before``
    is the version before, null for the first one, whose secrets are all ``added``.  Reports of
    one version count together.
    """
    code = F.col("PackageDataModel.VersionCode")
    named = reports.select(F.col("PackageDataModel.PackageName").alias("PackageName"), code.alias("VersionCode"), "Findings")
    # One slim row per version: its neighbours.
    order = Window.partitionBy("PackageName").orderBy(F.coalesce(F.col("VersionCode").try_cast("long"), F.lit(-1)), "VersionCode")
    versions = named.select("PackageName", "VersionCode").distinct()
    versions = versions.select("*", F.lag("VersionCode").over(order).alias("before"), F.lead("VersionCode").over(order).alias("after"))
    secrets = named.select("PackageName", "VersionCode", F.explode("Findings.SecretString").alias("SecretString"))
    placed = secrets.join(versions, ["PackageName", "VersionCode"])
    # A secret is seen from its own version and from the one after; no version is joined with another.
    own = F.struct(F.col("VersionCode").alias("version"), F.col("before").alias("before"), F.lit(True).alias("here"))
    later = F.struct(F.col("after").alias("version"), F.col("VersionCode").alias("before"), F.lit(False).alias("here"))
    seen = placed.select("PackageName", "SecretString", F.explode(F.array(own, later)).alias("v")).where(F.col("v.version").isNotNull())
    both = seen.groupBy("PackageName", F.col("v.version").alias("VersionCode"), "SecretString").agg(
        F.max("v.before").alias("before"), F.bool_or("v.here").alias("here"), F.bool_or(~F.col("v.here")).alias("there")
    )
    change = F.when(F.col("here") & F.col("there"), "kept").when(F.col("here"), "added").otherwise("removed")
    return both.select("PackageName", "VersionCode", "before", "SecretString", change.alias("change"))


def secret_runs(reports: DataFrame) -> DataFrame:
    """Each secret over all versions of its package, a row per unbroken run of versions that have it.

    ``(PackageName, SecretString, run, first_version, last_version, n_versions, returned, gone)``: ``run`` counts from 1; ``returned`` marks a
    run after a version without the secret, ``gone`` one that ends before the package's last version.  Versions follow by number, as in
    :func:`compare_versions`; reports of one version, and parts of a report, count together.
    """
    named = reports.select(F.col("PackageDataModel.PackageName").alias("PackageName"), F.col("PackageDataModel.VersionCode").alias("VersionCode"), "Findings")
    # One slim row per version: its number in the package, and that of the last one.
    order = Window.partitionBy("PackageName").orderBy(F.coalesce(F.col("VersionCode").try_cast("long"), F.lit(-1)), "VersionCode")
    versions = named.select("PackageName", "VersionCode").distinct()
    versions = versions.select("*", F.row_number().over(order).alias("number"), F.count(F.lit(1)).over(Window.partitionBy("PackageName")).alias("versions"))
    secrets = named.select("PackageName", "VersionCode", F.explode("Findings.SecretString").alias("SecretString")).distinct()
    placed = secrets.join(versions, ["PackageName", "VersionCode"])
    # A secret has at most one row per version; numbers less their place are equal along a run.
    own = Window.partitionBy("PackageName", "SecretString").orderBy("number")
    islands = placed.withColumn("island", F.col("number") - F.row_number().over(own))
    runs = islands.groupBy("PackageName", "SecretString", "island").agg(
        F.min_by("VersionCode", "number").alias("first_version"),
        F.max_by("VersionCode", "number").alias("last_version"),
        F.count(F.lit(1)).alias("n_versions"),
        (F.max("number") < F.max("versions")).alias("gone"),
    )
    run = F.row_number().over(Window.partitionBy("PackageName", "SecretString").orderBy("island"))
    return runs.select("PackageName", "SecretString", run.alias("run"), "first_version", "last_version", "n_versions", (run > 1).alias("returned"), "gone")
