"""Files that keep arriving: incremental scan and duplicate rejection.

Every query is checkpointed, so an arrival is acknowledged once its micro-batch
is planned and is processed exactly once.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from keysift.functions.text import fingerprint
from keysift.operators.scan import scan
from keysift.plans.batch import scan_batch
from keysift.session import delete_paths, stage
from keysift.sources.rules import Rule


def arriving_files(
    spark: SparkSession, folder: str, schema: str, file_format: str = "parquet", per_batch: int | None = None, **options
) -> DataFrame:
    """A stream over the files of a folder, present and future."""
    reader = spark.readStream.format(file_format).schema(schema).options(**options)
    if per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.load(folder)


def scan_stream(
    files: DataFrame, rules: DataFrame | Iterable[Rule], path: str, checkpoint: str
) -> DataStreamWriter:
    """Raw findings of a stream of ``files(app_key, file_path, text)``, appended to a folder.

    The scan keeps no state between micro-batches.
    """
    return (
        scan(files, rules)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )


def report_stream(
    arrivals: DataFrame,
    rules: DataFrame | Iterable[Rule],
    store_path: str,
    checkpoint: str,
    badging: DataFrame | None = None,
    documents: DataFrame | None = None,
) -> DataStreamWriter:
    """Store one report per distinct content of a stream of ``arrivals(app_key, FileName, text)``.

    With a column ``file_path`` an app may have several files; they arrive together, and the
    app's hash is that of its sorted paths and file hashes.  ``badging(app_key, text)`` and
    ``documents(app_key, json)`` are tables that know the arriving apps.
    Each micro-batch is one store batch: content of earlier batches is rejected,
    copies inside it count once, and a replayed micro-batch replaces its own output.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        # The texts are read twice, to be hashed and to be scanned; all else comes from the hashes.
        staged: list[str] = []
        several = "file_path" in batch.columns
        path = [F.col("file_path")] if several else []
        slim = stage(batch.select("app_key", "FileName", *path, fingerprint(F.col("text")).alias("hash")), "arrivals", staged)
        if several:
            listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_path", "hash"))), lambda f: F.concat(f["file_path"], F.lit("\0"), f["hash"])), "\n")
            submissions = slim.groupBy("app_key", "FileName").agg(fingerprint(listed).alias("APKHash"))
        else:
            submissions = slim.select("app_key", "FileName", F.col("hash").alias("APKHash"))
        files = batch.select("app_key", F.col("file_path" if several else "FileName").alias("file_path"), "text")
        keys = slim.select("app_key").distinct()
        nothing = slim.select("app_key", F.lit(None).cast("string").alias("text")).where(F.lit(False))
        own = nothing if badging is None else badging.join(keys, "app_key", "left_semi")
        json = nothing.withColumnRenamed("text", "json") if documents is None else documents.join(keys, "app_key", "left_semi")
        scan_batch(submissions, files, own, json, rules, store_path, batch_id).release()
        delete_paths(batch.sparkSession, staged)

    return arrivals.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
