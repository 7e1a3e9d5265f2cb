"""The findings store: a folder of Parquet files, one sub-folder per batch.

Writing a batch again replaces exactly that batch, so a repeated write after a
failure leaves one copy.  Beside it stands an index of known content: fingerprint, batch and app, sorted by
fingerprint, with small pages and Bloom filters, so that a batch of few contents reads the pages these fall into, and
never the reports.  A batch's index is written after its reports: after a failure in between its contents count as
new until the batch is repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keysift.model import (
    FINDINGS,
    INT,
    METADATA_BLOCKS,
    METADATA_TOP,
    PACKAGE_LISTS,
    PACKAGE_STRINGS,
)
from keysift.operators.likely import any_of


def _ddl(fields) -> str:
    return ",".join(f"{name}:{'bigint' if kind == INT else kind}" for name, kind in fields)


METADATA = f"struct<{_ddl(METADATA_TOP)}," + ",".join(
    f"{block}:struct<{_ddl(fields)}>" for block, fields in METADATA_BLOCKS.items()
) + ">"
PACKAGE = (
    "struct<PackageDataID:int,APKHash:string,"
    + ",".join(f"{c}:string" for c in PACKAGE_STRINGS)
    + ","
    + ",".join(f"{c}:array<string>" for c in PACKAGE_LISTS)
    + ">"
)
REPORT = (
    "app_key string, FileName string, APKHash string, APKVersion string, part int, parts int, n_findings bigint, "
    f"Findings {FINDINGS}, Metadata {METADATA}, PackageDataModel {PACKAGE}, batch_id bigint"
)


INDEX = "APKHash string, app_key string, batch_id bigint"
#: Contents that are looked up page by page; a batch of more reads the index as a whole.
PROBES = 1000
#: Rows of a page of the index, and how Parquet finds pages without a content.
PAGES = {
    "parquet.page.row.count.limit": "100",
    "parquet.bloom.filter.enabled#APKHash": "true",
    "parquet.bloom.filter.adaptive.enabled": "true",
}


def append_store(reports: DataFrame, path: str, batch_id: int) -> None:
    """Write the reports of a batch, then its part of the index from what was written."""
    target = f"{path.rstrip('/')}/batch_id={batch_id}"
    reports.drop("batch_id").write.mode("overwrite").parquet(target)
    written = reports.sparkSession.read.schema(reports.drop("batch_id").schema).parquet(target)
    keys = written.where(F.col("part") == 0).select("APKHash", "app_key", F.lit(batch_id).cast("long").alias("batch_id"))
    _write_index(keys, f"{_index(path)}/chunk={batch_id}")


def _index(path: str) -> str:
    return f"{path.rstrip('/')}-index"


def _write_index(keys: DataFrame, target: str) -> None:
    # Sorted by ranges; adaptive execution joins the ranges of a small batch to one file.
    placed = keys.repartitionByRange("APKHash").sortWithinPartitions("APKHash")
    placed.write.mode("overwrite").options(**PAGES).option("maxRecordsPerFile", 20_000_000).parquet(target)


def load_index(spark: SparkSession, path: str, contents: DataFrame | None = None, before: int | None = None) -> DataFrame:
    """``(APKHash, app_key, batch_id)`` of stored content, of batches below ``before``.

    With ``contents(APKHash)``, of which there are few, only the pages are read that these may be on.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_index(path))
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], INDEX)
    index = spark.read.schema(T._parse_datatype_string(f"{INDEX}, chunk string")).option("basePath", _index(path)).parquet(_index(path))
    if contents is not None:
        few = [r[0] for r in contents.select("APKHash").distinct().limit(PROBES + 1).collect()]
        if len(few) <= PROBES:
            # The list decides each row that is read; the equalities decide which pages are.
            index = index.where(F.col("APKHash").isin(few)).where(any_of("APKHash", few))
    return (index if before is None else index.where(F.col("batch_id") < before)).select("APKHash", "app_key", "batch_id")


def batch_index(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """The index of one batch, as :func:`append_store` has written it."""
    return spark.read.schema(INDEX).parquet(f"{_index(path)}/chunk={batch_id}")


def compact_index(spark: SparkSession, path: str, before: int) -> None:
    """Join the index of all batches below ``before`` into one chunk: fewer, larger files.

    For batches that will not be written again.  The joined chunk is complete before the old ones
    go; until then content may be listed twice, which changes no answer.
    """
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_index(path))
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName().removeprefix("chunk=") for s in system.listStatus(root)]
    old = [n for n in names if n.removeprefix("below-").isdigit() and (n.startswith("below-") or int(n) < before) and n != f"below-{before}"]
    if not old:
        return
    _write_index(load_index(spark, path, before=before).distinct(), f"{_index(path)}/chunk=below-{before}")
    for name in old:
        system.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{_index(path)}/chunk={name}"), True)


def load_store(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """All stored reports, or those of batches below ``before``; an absent store is empty."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], REPORT)
    store = spark.read.schema(T._parse_datatype_string(REPORT)).option("basePath", path).parquet(path)
    return store if before is None else store.where(F.col("batch_id") < before)


def last_report(store: DataFrame) -> DataFrame:
    """All parts of the report stored last."""
    latest = store.agg(F.max(F.struct("batch_id", "app_key")).alias("latest"))
    return store.join(
        latest.select("latest.batch_id", "latest.app_key"), ["batch_id", "app_key"], "left_semi"
    )
