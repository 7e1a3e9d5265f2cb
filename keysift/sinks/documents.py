"""Report documents: rows by batch (named files: see :mod:`keysift.sinks.files`)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.functions.text import findings_name, report_name
from keysift.operators.reports import report_documents


def named_documents(reports: DataFrame) -> DataFrame:
    """``(APKHash, document, part, parts, body)``: the full report and the findings of every report.

    Names are not unique, so a document is known by APKHash and name.  The parts of a
    large report are pieces of its documents, in order.
    """
    name = lambda f: f(F.col("FileName"), F.col("APKVersion"))
    return report_documents(reports).select(
        "APKHash",
        "part",
        "parts",
        F.inline(
            F.array(
                F.struct(name(report_name).alias("document"), F.col("report_json").alias("body")),
                F.struct(name(findings_name).alias("document"), F.col("findings_json").alias("body")),
            )
        ),
    ).select("APKHash", "document", "part", "parts", "body")


def write_documents(documents: DataFrame, batch_id: int, *folders: str) -> None:
    """Write the documents of a batch to every folder, rendering them once.

    A batch is a sub-folder of Parquet rows, as many files as there are tasks: other batches
    stay, and the same one written again replaces itself.
    """
    if not folders:
        raise ValueError("name at least one folder")
    paths = [f"{folder.rstrip('/')}/batch_id={batch_id}" for folder in folders]
    documents.write.mode("overwrite").parquet(paths[0])
    written = documents.sparkSession.read.schema(documents.schema).parquet(paths[0])
    for path in paths[1:]:
        written.write.mode("overwrite").parquet(path)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``(APKHash, document, part, parts, body, batch_id)`` of all batches of a folder."""
    return spark.read.option("basePath", folder).parquet(folder).withColumn("batch_id", F.col("batch_id").cast("long"))


def whole_documents(documents: DataFrame) -> DataFrame:
    """One row per document: its parts joined in order, as long as they fit one string."""
    keys = [c for c in documents.columns if c not in ("part", "parts", "body")]
    one = documents.where(F.col("parts") == 1).select(*keys, "body")
    pieces = F.array_sort(F.collect_list(F.struct("part", "body")))
    several = documents.where(F.col("parts") > 1).groupBy(*keys).agg(F.array_join(F.transform(pieces, lambda p: p["body"]), "").alias("body"))
    return one.unionByName(several)


def write_reports(reports: DataFrame, batch_id: int, results: str, backup: str) -> None:
    """Full reports and findings to the results and the backup folder."""
    write_documents(named_documents(reports), batch_id, backup, results)
