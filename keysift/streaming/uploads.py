"""Uploads whose files arrive one by one, and rejection within a horizon: queries with bounded state.

The state of an upload is one row, however many files it has; the texts stay where they arrive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from keysift.functions.text import fingerprint
from keysift.model import require
from keysift.operators.reports import SMALL_LIST
from keysift.plans.batch import likely_files, scan_batch
from keysift.session import delete_paths, stage
from keysift.sources.rules import Rule


def content_hash(files: DataFrame) -> DataFrame:
    """``(app_key, n_files, APKHash)`` of ``files(app_key, file_path, text)``, whatever their order: sums of hashes, combined in each task."""
    own = [F.xxhash64(F.lit(seed), "file_path", fingerprint(F.col("text"))).cast("decimal(20,0)") for seed in (1, 2)]
    sums = files.groupBy("app_key").agg(F.count(F.lit(1)).alias("n_files"), *[F.sum(c).alias(f"sum{i}") for i, c in enumerate(own)])
    return sums.select("app_key", "n_files", fingerprint(F.concat_ws(":", "n_files", "sum0", "sum1")).alias("APKHash"))


def uploads(arrivals: DataFrame, gap: str, delay: str) -> DataFrame:
    """Closed uploads of a stream of ``arrivals(app_key, FileName, file_path, text, arrived)``.

    The files of an app belong to one upload as long as no ``gap`` of event time lies between them; an upload is given off once the
    watermark, ``delay`` behind the latest file, has passed its end: ``(upload, app_key, FileName, start, end)``.
    """
    require(arrivals, "app_key", "FileName", "arrived")
    seen = arrivals.select("app_key", "FileName", "arrived").withWatermark("arrived", delay)
    sessions = seen.groupBy(F.session_window("arrived", gap).alias("session"), "app_key", "FileName").agg(F.count(F.lit(1)).alias("n"))
    return sessions.select(
        F.concat_ws("@", "app_key", F.date_format("session.start", "yyyy-MM-dd'T'HH:mm:ss.SSS")).alias("upload"),
        "app_key",
        "FileName",
        F.col("session.start").alias("start"),
        F.col("session.end").alias("end"),
    )


def files_of(files: DataFrame, closed: DataFrame) -> DataFrame:
    """``(app_key, file_path, text)`` of the files of closed uploads, under the name of the upload.

    The list of uploads is broadcast if it is short, after its rows are counted; beyond that the files of these apps are shuffled.
    """
    named = closed.select("upload", "app_key", "start", "end")
    few = F.broadcast(named) if named.count() <= SMALL_LIST else named
    own = likely_files(files, closed.select("app_key")).alias("f").join(
        few.alias("u"), (F.col("f.app_key") == F.col("u.app_key")) & (F.col("f.arrived") >= F.col("u.start")) & (F.col("f.arrived") < F.col("u.end"))
    )
    return own.select(F.col("u.upload").alias("app_key"), "f.file_path", "f.text")


def upload_stream(
    arrivals: DataFrame,
    files: Callable[[], DataFrame],
    rules: DataFrame | Iterable[Rule],
    store_path: str,
    checkpoint: str,
    gap: str = "10 minutes",
    delay: str = "10 minutes",
) -> DataStreamWriter:
    """Store a report for each closed upload of a stream (see :func:`uploads`).

    ``files()`` gives the table ``(app_key, file_path, text, arrived)`` of all that has arrived: texts are read there when their upload is
    closed, and are never state.  A report's ``app_key`` names the upload, app and start.  However the files are spread over
    micro-batches, the reports are the same, as long as no file comes later than ``delay``.  A file that does still counts if its upload is
    closed after it; else it is in no report.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        staged: list[str] = []
        closed = stage(batch, "uploads", staged)
        if not closed.isEmpty():
            nothing = closed.select(F.col("upload").alias("app_key"), F.lit(None).cast("string").alias("text")).where(F.lit(False))
            own = files_of(files(), closed)
            # What is hashed is what is scanned.
            submissions = content_hash(own).join(closed.select(F.col("upload").alias("app_key"), "FileName"), "app_key")
            scan_batch(submissions, own, nothing, nothing.withColumnRenamed("text", "json"), rules, store_path, batch_id).release()
        delete_paths(closed.sparkSession, staged)

    return uploads(arrivals, gap, delay).writeStream.outputMode("append").foreachBatch(process).option("checkpointLocation", checkpoint)


def unseen_within(arrivals: DataFrame, horizon: str, key: str = "APKHash", time: str = "arrived") -> DataFrame:
    """A stream without the rows whose ``key`` came before, within ``horizon`` of event time.

    State holds the keys of the horizon alone: a copy after the watermark has passed a key's time and twice the horizon may be reported again, one within the
    horizon never is.  Beside the store's answer, which knows all content, this needs no look-up.
    """
    return arrivals.withWatermark(time, horizon).dropDuplicatesWithinWatermark([key])
