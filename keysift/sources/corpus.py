"""Files, lines and search output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.sources.files import list_files, read_files
from keysift.sources.ignore import IGNORE_FILES, load_ignore_rules, not_ignored


def load_corpus(spark: SparkSession, path: str, app_depth: int = 1, ignore: Sequence[str] = IGNORE_FILES) -> DataFrame:
    """The files below ``path`` that a search reads: ``files(app_key, file_path, text)``.

    ``path`` is one folder, no pattern.  The first ``app_depth`` folders below it name the
    app.  Hidden paths are left out, as are those that ignore files of the names ``ignore`` list (none: nothing is ignored); names are
    filtered before any file is read.  Files with NUL bytes are kept here; :func:`scannable` removes them.
    """
    listing = list_files(spark, path, app_depth)
    if ignore:
        listing = not_ignored(listing, load_ignore_rules(spark, path, ignore))
    return read_files(listing, path)


def scannable(files: DataFrame) -> DataFrame:
    """Drop hidden paths and binary content, as the text search does by default."""
    hidden = F.rlike("file_path", F.lit(r"(^|/)\.[^/]"))
    return files.where(~hidden & ~F.contains("text", F.lit("\0")))


def lines(files: DataFrame, *, with_end: bool = False) -> DataFrame:
    """``lines(app_key, file_path, line_no, line)``, split at ``\\n`` only, with numbers from 1.

    The empty piece after a final ``\\n`` is no line.  ``with_end`` adds ``ended``:
    whether a ``\\n`` follows the line.
    """
    pieces = F.split("text", "\n", -1)
    split = files.select("app_key", "file_path", pieces.alias("pieces"), F.size(pieces).alias("n"))
    # Only the count travels with a line.  The coalesce keeps the generator's input an
    # expression, for which no filter is inferred: it would split every text twice.
    each = split.select(
        "app_key", "file_path", "n", F.posexplode(F.coalesce("pieces", F.array().cast("array<string>"))).alias("pos", "line")
    )
    ended = F.col("pos") + 1 < F.col("n")
    return each.where(ended | (F.col("line") != "")).select(
        "app_key", "file_path", (F.col("pos") + 1).alias("line_no"), "line", *([ended.alias("ended")] if with_end else [])
    )


def parse_search_output(rows: DataFrame, column: str = "value") -> DataFrame:
    """Records ``path:line:content``; those with fewer parts or no integer line are dropped."""
    parts = F.split(column, ":", 3)
    path, number, content = (F.get(parts, F.lit(i)) for i in range(3))
    # Digits only: a cast alone would also take blanks around them.
    line_no = F.when(F.rlike(number, F.lit(r"^[+-]?[0-9]+$")), number.try_cast("int"))
    keep = [c for c in rows.columns if c != column]
    return rows.select(
        *keep, path.alias("file_path"), line_no.alias("line_no"), content.alias("line")
    ).where(F.col("line_no").isNotNull() & F.col("line").isNotNull())
