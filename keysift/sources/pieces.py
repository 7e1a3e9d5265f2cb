"""An inverted index of stored content: which files hold which three-letter pieces.

Every match of a rule contains certain literals (see :mod:`keysift.functions.guards`), and a file that holds a literal
holds all of its pieces.  When rules are added later, the files that can match them are found from a few postings; the others
are not read again.  One sub-folder per batch, sorted by piece, so that a look-up skips most of it by the statistics of
its pages; beside it stand the number of files of each piece, from which the rarest pieces are chosen.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.model import require
from keysift.operators.likely import any_of, mark_likely
from keysift.operators.scan import WORD, folded
from keysift.sources.rules import Matcher, Rule, matchers

PIECE = 3
#: Pieces looked up for a literal: its rarest ones.
RAREST = 3
#: Texts whose pieces are sorted at a time: so many rows, and bytes, at most; a longer text is taken in stretches.
ROWS, BYTES = 1000, 1 << 20
POSTINGS = "piece string, file long"
COUNTS = "piece string, n long"


def file_code() -> Column:
    """The number under which a file's pieces are kept.  Files that share one are read together, never missed."""
    return F.xxhash64("app_key", "file_path")


def file_pieces(files: DataFrame) -> DataFrame:
    """``(piece, file)``, distinct: runs of three printable ASCII letters of each text, folded as the scan folds it.

    A file has the empty piece besides, so that all indexed files are listed.
    """
    require(files, "app_key", "file_path", "text")
    return files.select(file_code().alias("file"), F.expr(f"coalesce({folded('text')}, '')").alias("text")).mapInArrow(_postings, POSTINGS)


def _codes(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where three printable bytes in a row start, none across an end, and a number of 21 bits for each three.

    The bytes of other letters than ASCII are not printable.
    """
    good = (text >= 0x20) & (text <= 0x7E)
    starts = good[:-2] & good[1:-1] & good[2:]
    across = np.concatenate([ends - 2, ends - 1])
    starts[across[(across >= 0) & (across < len(starts))]] = False
    at = np.flatnonzero(starts)
    wide = text.astype(np.int32)
    return at, wide[at] << 14 | wide[at + 1] << 7 | wide[at + 2]


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of :func:`file_pieces` from ``(file, folded text)``."""
    for batch in batches:
        files, column = batch.column(0).to_numpy(), batch.column(1).cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        start = 0
        while start < len(files):
            # As many rows as fit, one at least.
            end = int(np.searchsorted(offsets, offsets[start] + BYTES, "right")) - 1
            end = max(start + 1, min(end, start + ROWS, len(files)))
            text, own = data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
            if len(text) > BYTES:
                seen = np.zeros(1 << 21, bool)
                for k in range(0, len(text), BYTES):
                    seen[_codes(text[k : k + BYTES + PIECE - 1], own[:0])[1]] = True
                keys = np.flatnonzero(seen)
            else:
                at, codes = _codes(text, own[1:])
                keys = np.repeat(np.arange(end - start, dtype=np.int32), np.diff(own))[at] << 21 | codes
                keys.sort()
                keys = keys[np.diff(keys, prepend=-1) != 0]
            yield _frame(keys & (1 << 21) - 1, files[start:end][keys >> 21], files[start:end])
            start = end


def _frame(codes: np.ndarray, holders: np.ndarray, files: np.ndarray) -> pa.RecordBatch:
    """Pieces and their files, then the empty piece of each file."""
    letters = np.stack([codes >> 14, codes >> 7 & 127, codes & 127], axis=1).astype(np.uint8)
    offsets = np.concatenate([np.arange(len(codes) + 1) * PIECE, np.full(len(files), len(codes) * PIECE)]).astype(np.int32)
    pieces = pa.StringArray.from_buffers(len(codes) + len(files), pa.py_buffer(offsets), pa.py_buffer(letters.tobytes()))
    return pa.RecordBatch.from_arrays([pieces, pa.array(np.concatenate([holders, files]))], ["piece", "file"])


def _counts(path: str) -> str:
    return f"{path.rstrip('/')}-counts"


def append_pieces(files: DataFrame, path: str, batch_id: int) -> None:
    """Index the files of a batch; writing a batch again replaces it."""
    target = f"{path.rstrip('/')}/chunk={batch_id}"
    # By ranges of piece and file: a piece that all files have fills many tasks.  In these, by one number in the order of
    # pieces, which is sorted without comparisons.
    letters = [F.ascii(F.substring("piece", i + 1, 1)) for i in range(PIECE)]
    coded = file_pieces(files).withColumn("code", (letters[0] * 16384 + letters[1] * 128 + letters[2]).cast("long"))
    placed = coded.repartitionByRange("code", "file").sortWithinPartitions("code")
    placed.select("piece", "file").write.mode("overwrite").option("maxRecordsPerFile", 50_000_000).parquet(target)
    written = files.sparkSession.read.schema(POSTINGS).parquet(target)
    written.groupBy("piece").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{_counts(path)}/chunk={batch_id}")


def needed_pieces(matcher: Matcher) -> list[list[set[str]]]:
    """What a file must hold to match: of each group, all pieces of one word; no groups if nothing is known."""
    if matcher.guard is None:
        return []
    return [
        [{word.lower()[i : i + PIECE] for i in range(len(word) - PIECE + 1)} for word in group]
        for group in matcher.guard.groups
        if all(len(word) >= PIECE and word.isascii() and word.isprintable() for word in group)
    ]


def candidate_files(spark: SparkSession, rules: DataFrame | Iterable[Rule], path: str) -> tuple[DataFrame, list[Rule], list[Rule]]:
    """``(file)`` of the indexed files that may match, the rules these are for, and the rules that every file may match."""
    needs = [(m, needed_pieces(m)) for m in matchers(spark, rules)]
    open_rules = [r for m, groups in needs if not groups for r in m.rules]
    closed = [(m, groups) for m, groups in needs if groups]
    rules_of = [r for m, _ in closed for r in m.rules]
    wanted = sorted({p for _, groups in closed for group in groups for word in group for p in word})
    if not wanted:
        return spark.createDataFrame([], "file long"), rules_of, open_rules
    counts = spark.read.schema(COUNTS).parquet(f"{_counts(path)}/*").where(any_of("piece", wanted)).groupBy("piece").agg(F.sum("n").alias("n"))
    known = {r["piece"]: r["n"] for r in counts.collect()}  # at most as many as the rules' literals have
    rarest = lambda word: sorted(word, key=lambda p: (known.get(p, 0), p))[:RAREST]
    chosen = [[[rarest(word) for word in group] for group in groups] for _, groups in closed]
    # A word with a piece that no file has is in no file.
    used = sorted({p for groups in chosen for group in groups for word in group for p in word if known.get(p)})
    if not used:
        return spark.createDataFrame([], "file long"), rules_of, open_rules
    at = {p: i for i, p in enumerate(used)}
    words = range(-(-len(used) // WORD))
    place = spark.createDataFrame([(p, i // WORD, 1 << (i % WORD)) for p, i in at.items()], "piece string, word int, bit long")
    postings = spark.read.schema(POSTINGS).parquet(f"{path.rstrip('/')}/*").where(any_of("piece", used))
    bits = postings.join(F.broadcast(place), "piece")  # one row per piece of the rules
    masks = bits.groupBy("file").agg(*[F.bit_or(F.when(F.col("word") == w, F.col("bit")).otherwise(F.lit(0))).alias(f"mask{w}") for w in words])

    def has_all(word: list[str]) -> str:
        if any(p not in at for p in word):
            return "false"
        by: dict[int, int] = {}
        for p in word:
            by[at[p] // WORD] = by.get(at[p] // WORD, 0) | 1 << (at[p] % WORD)
        return "(" + " AND ".join(f"(mask{w} & {m}L) = {m}L" for w, m in sorted(by.items())) + ")"

    tests = ["(" + " AND ".join("(" + " OR ".join(map(has_all, group)) + ")" for group in groups) + ")" for groups in chosen]
    return masks.where(" OR ".join(dict.fromkeys(tests))).select("file"), rules_of, open_rules


def indexed_files(spark: SparkSession, path: str) -> DataFrame:
    """``(file)`` of all files in the index."""
    return spark.read.schema(POSTINGS).parquet(f"{path.rstrip('/')}/*").where("piece = ''").select("file").distinct()


def likely_files_of(files: DataFrame, candidates: DataFrame) -> DataFrame:
    """The rows of ``files`` whose code is among ``candidates(file)``, and a few others; nothing of ``files`` is shuffled."""
    coded = files.withColumn("file", file_code())
    return mark_likely(coded, candidates, "file", "_likely").where("_likely").select(*files.columns)
