"""Documents as named files: a data-source writer with a commit.

``document_files`` writes each document as one file below a staging folder; when all tasks are done the folder takes the place of the
batch's by one rename, so readers see a whole batch or (while one is replaced) none.  A task that fails leaves nothing behind, one that is repeated writes
the same names again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from keysift.sources.files import file_system

DOCUMENTS = "APKHash string, document string, part int, body string"
ATTEMPT = ".attempt-"


def file_name(document: str) -> str:
    """A document's name as that of a file: as it is, but for what no file name can hold."""
    safe = document.replace("%", "%25").replace("/", "%2F").replace("\0", "%00")
    return {"": "%", ".": "%2E", "..": "%2E%2E"}.get(safe, safe)


@dataclass
class Written(WriterCommitMessage):
    files: int


class DocumentFilesWriter(DataSourceArrowWriter):
    """Rows come sorted by hash, document and part; a document's parts follow each other in one task."""

    def __init__(self, path: str) -> None:
        self.path = path
        head, _, name = path.rstrip("/").rpartition("/")
        self.staging = f"{head}/.staging-{name}-{uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, staging = file_system(self.staging)
        attempt = f"{staging}/{ATTEMPT}{uuid4().hex}"
        system.create_dir(attempt, recursive=True)
        current, stream, files = None, None, 0

        def close() -> None:
            # A file gets its name when it is whole.
            stream.close()
            folder = f"{staging}/{current[0]}"
            system.create_dir(folder, recursive=True)
            system.move(f"{attempt}/{files}", f"{folder}/{file_name(current[1])}")

        try:
            for batch in iterator:
                for key, name, body in zip(*(batch.column(c).to_pylist() for c in ("APKHash", "document", "body"))):
                    if (key, name) != current:
                        if stream is not None:
                            close()
                        files += 1
                        current, stream = (key, name), system.open_output_stream(f"{attempt}/{files}", compression=None)
                    stream.write((body or "").encode())
            if stream is not None:
                close()
        finally:
            system.delete_dir(attempt)
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        system, staging = file_system(self.staging)
        _, target = file_system(self.path)
        system.create_dir(staging, recursive=True)
        # Tasks that were lost without a word: one folder each.
        for entry in system.get_file_info(fs.FileSelector(staging)):
            if entry.base_name.startswith(ATTEMPT):
                system.delete_dir(entry.path)
        if system.get_file_info(target).type != fs.FileType.NotFound:
            system.delete_dir(target)
        system.move(staging, target)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        system, staging = file_system(self.staging)
        if system.get_file_info(staging).type != fs.FileType.NotFound:
            system.delete_dir(staging)


class DocumentFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return DOCUMENTS

    def writer(self, schema: StructType, overwrite: bool) -> DocumentFilesWriter:
        return DocumentFilesWriter(self.options["path"])


def export_documents(documents: DataFrame, batch_id: int, folder: str) -> None:
    """One file per document of a batch: ``batch_id=N/APKHash/document``.

    ``documents(APKHash, document, part, body)``; the parts of a document are written one after the other and never meet in memory.
    Writing a batch again replaces it.  The folder must be on a file system that pyarrow opens and that can rename folders.
    """
    documents.sparkSession.dataSource.register(DocumentFiles)
    rows = documents.selectExpr("APKHash", "document", "CAST(part AS INT) AS part", "body")
    dealt = rows.repartition("APKHash", "document").sortWithinPartitions("APKHash", "document", "part")
    dealt.write.format("document_files").mode("append").save(f"{folder.rstrip('/')}/batch_id={batch_id}")
