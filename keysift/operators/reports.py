"""Reports: package facts, metadata and findings of one app.

A report is one row, unless an app has more than ``part_size`` distinct secrets:
then it is several rows (``part`` of ``parts``), so that no row and no task holds
an unbounded list.  Parts are cut from the findings in their order: joined by number,
they are the report in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keysift.model import FINDING_FIELDS, FINDING_ORDER, FINDINGS, PACKAGE_LISTS, PACKAGE_STRINGS, require
from keysift.operators.metadata import zero_metadata
from keysift.session import stage

PART_SIZE = 10_000
#: A list of apps of up to this many rows is sent to every executor; its size is counted first.
SMALL_LIST = 1_000_000


def numbered(findings: DataFrame) -> DataFrame:
    """``findings`` with ``place``: the number of each in its app, from 0, in FINDING_ORDER.

    Sorted by ranges over all apps, so a large app fills many tasks; what is counted per app
    is one row per range.
    """
    order = ["app_key", *FINDING_ORDER]
    ranges = findings.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    inside = F.row_number().over(Window.partitionBy("app_key", "_range").orderBy(*FINDING_ORDER)) - 1
    # Ranges may fall differently when they are computed again, so they are written once.
    ranges = stage(ranges.withColumn("_inside", inside), "numbered")
    sizes = ranges.groupBy("app_key", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("app_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("app_key", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = ranges.join(offsets, ["app_key", "_range"])
    return joined.select(*findings.columns, (F.col("_before") + F.col("_inside")).alias("place"))


def collect_findings(findings: DataFrame, part_size: int = PART_SIZE) -> DataFrame:
    """Distinct findings to ``(app_key, part, parts, n_findings, Findings)``; pass findings read from a table."""
    counts = findings.groupBy("app_key").agg(F.count(F.lit(1)).alias("n_findings"))
    large = stage(counts.where(F.col("n_findings") > part_size), "large-apps")
    n_large = large.count()
    if n_large <= SMALL_LIST:
        large = F.broadcast(large)
    ordered = F.struct(*FINDING_ORDER, F.struct(*FINDING_FIELDS).alias("finding"))

    def collected(rows: DataFrame) -> DataFrame:
        found = rows.groupBy("app_key", "part").agg(
            F.max("large_n").alias("large_n"), F.array_sort(F.collect_list(ordered)).alias("sorted")
        )
        n = F.coalesce("large_n", F.size("sorted").cast("long"))
        return found.select(
            "app_key",
            "part",
            F.greatest(F.lit(1), F.ceil(n / part_size)).cast("int").alias("parts"),
            n.alias("n_findings"),
            F.transform("sorted", lambda x: x["finding"]).alias("Findings"),
        )

    in_one = {"part": F.lit(0), "large_n": F.lit(None).cast("long")}
    if not n_large:
        return collected(findings.withColumns(in_one))
    one = findings.join(large, "app_key", "left_anti").withColumns(in_one)
    several = numbered(findings.join(large, "app_key", "left_semi")).join(large.withColumnRenamed("n_findings", "large_n"), "app_key")
    several = several.withColumn("part", F.floor(F.col("place") / part_size).cast("int")).drop("place")
    return collected(one).unionByName(collected(several))


def one_per_app(table: DataFrame) -> DataFrame:
    """One row per app: of several the last by a column ``seq``, if there is one, else the greatest in its fields."""
    rest = [c for c in table.columns if c not in ("app_key", "seq")]
    order = ["seq"] if "seq" in table.columns else []
    last = F.max(F.struct(*order, *rest)).alias("last")
    return table.groupBy("app_key").agg(last).select("app_key", *(F.col(f"last.{c}") for c in rest))


def package_struct() -> Column:
    """Package facts as stored; an app without any has empty ones."""
    none = F.array().cast("array<string>")
    return F.struct(
        F.lit(0).alias("PackageDataID"),
        F.col("APKHash"),
        *(F.coalesce(c, F.lit("")).alias(c) for c in PACKAGE_STRINGS),
        *(F.coalesce(c, none).alias(c) for c in PACKAGE_LISTS),
    )


def build_reports(
    apps: DataFrame,
    facts: DataFrame,
    metadata: DataFrame,
    findings: DataFrame,
    part_size: int = PART_SIZE,
) -> DataFrame:
    """``apps(app_key, FileName, APKHash)`` joined with what is known of each.

    Pass findings read from a table: they are read more than once.  Every app has
    a report; one without findings has a null list, which renders
    as JSON ``null``.  Facts and metadata count once per app (see :func:`one_per_app`).
    """
    require(apps, "app_key", "FileName", "APKHash")
    found = collect_findings(findings, part_size).select("app_key", "part", "Findings")
    counts = findings.groupBy("app_key").agg(F.count(F.lit(1)).alias("n_findings"))
    known = apps.join(one_per_app(facts), "app_key", "left").join(one_per_app(metadata), "app_key", "left")
    one_each = known.join(counts, "app_key", "left")
    parts = F.coalesce(F.ceil(F.col("n_findings") / part_size).cast("int"), F.lit(1))
    # Joined by part, so the parts of a large app do not meet in one task.
    numbered = one_each.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    joined = numbered.join(found, ["app_key", "part"], "left")
    return joined.where((F.col("parts") == 1) | F.col("Findings").isNotNull()).select(
        "app_key",
        "FileName",
        "APKHash",
        F.coalesce("VersionName", F.lit("")).alias("APKVersion"),
        "part",
        "parts",
        F.coalesce("n_findings", F.lit(0).cast("long")).alias("n_findings"),
        F.col("Findings").cast(FINDINGS).alias("Findings"),
        F.coalesce("Metadata", zero_metadata()).alias("Metadata"),
        package_struct().alias("PackageDataModel"),
    )


def findings_json(findings) -> Column:
    """Compact JSON array; ``null`` for no findings."""
    return F.coalesce(F.to_json(findings), F.lit("null"))


def parse_findings(text) -> Column:
    """JSON array of a stored report back to findings."""
    return F.from_json(text, FINDINGS)


def report_documents(reports: DataFrame) -> DataFrame:
    """``(app_key, part, parts, FileName, APKHash, APKVersion, report_json, findings_json)``.

    The full report holds its findings as a JSON *string*, like the stored row does.  The parts of a
    report are pieces of the same two documents: joined by number, they are the documents of
    the report in one row.
    """
    first, last = F.col("part") == 0, F.col("part") == F.col("parts") - 1
    inner = F.regexp_replace(findings_json(F.col("Findings")), r"(?s)^\[(.*)\]$", "$1")
    piece = F.when(F.col("parts") == 1, findings_json(F.col("Findings"))).otherwise(
        F.concat(F.when(first, "[").otherwise(","), inner, F.when(last, "]").otherwise(""))
    )
    escaped = F.regexp_replace(F.to_json(F.struct(piece.alias("x"))), r'(?s)^\{"x":"(.*)"\}$', "$1")
    options = {"pretty": "true", "ignoreNullFields": "false"}
    head = F.regexp_replace(F.to_json(F.struct("FileName", "APKHash", "APKVersion"), options), r"\n\}$", "")
    tail = F.regexp_replace(F.to_json(F.struct("Metadata", "PackageDataModel"), options), r"^\{\n", "")
    body = F.concat(
        F.when(first, F.concat(head, F.lit(',\n  "SecretModel" : "'))).otherwise(""),
        escaped,
        F.when(last, F.concat(F.lit('",\n'), tail)).otherwise(""),
    )
    return reports.select(
        "app_key", "part", "parts", "FileName", "APKHash", "APKVersion", body.alias("report_json"), piece.alias("findings_json")
    )


def explode_findings(reports: DataFrame) -> DataFrame:
    """Findings of stored reports, one per row."""
    return reports.select("app_key", F.inline("Findings"))
