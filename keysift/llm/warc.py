"""WARC archives with a Zstandard dictionary.

Every page is a record; of pages with equal payloads one is stored in full and the others
revisit it.  A dictionary is built from a bounded sample of the records, stands in a skippable frame
at the head of every archive, and each record is a frame of its own; the manifest holds the place of each, so a
reader that has the dictionary can start at any record (see ``read_record``).  Tasks write archives to the given folder through pyarrow's file systems, under a name of
their attempt; only archives named in the manifest count, so a lost or repeated task leaves no trace
in the result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.llm.common import attach, stage, suspected, table
from keysift.session import scratch_path

# A skippable frame that holds a dictionary, and the record version.
SKIPPABLE = 0x184D2A5D
VERSION = b"WARC/1.1"

LEVEL = 3
#: The dictionary is built from the payloads of so many pages (those with the smallest payload hash), of each
#: at most so many bytes from a place given by its hash.
SAMPLE_RECORDS = 400
SAMPLE_BYTES = 16 << 10
DICTIONARY_BYTES = 64 << 10
#: An archive is closed when it has so many bytes.
ARCHIVE_BYTES = 256 << 20
READ_BYTES = 1 << 20

HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MANIFEST = "archive string, records long, bytes long, offsets array<long>"
RECORDS = "page_id long, uri string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def build_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary trained on the samples, or made of them where training needs more; b'' without any."""
    import zstandard

    samples = [s for s in samples if s]
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few or too short
        return b"".join(samples)[:DICTIONARY_BYTES]


def _dictionary(raw: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(raw) if raw else None


def _line(text: str) -> bytes:
    """A header value: one line, white space and control characters escaped."""
    return "".join(f"%{b:02X}" if b <= 0x20 or b == 0x7F else chr(b) for b in text.encode("utf-8")).encode("latin-1")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, repeated: bool = False) -> bytes:
    """One WARC record; a revisit leaves out the payload and keeps its digest and length.

    The record's id is made of page id and payload digest; a page without an id, or one whose row is
    ``repeated``, gets a random part besides, so that ids are unique.
    """
    block = HTTP_HEAD if revisit else HTTP_HEAD + payload
    digest = payload_digest(payload).encode()
    name = lambda i, own=b"": b"<urn:page:%s:%s%s>" % (b"none" if i is None else str(i).encode(), digest, own)
    head = [
        VERSION,
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: " + name(page_id, b":" + uuid4().hex.encode() if repeated or page_id is None else b""),
        b"WARC-Date: 1970-01-01T00:00:00Z",
        b"WARC-Target-URI: " + (_line(url) if url else b"about:blank"),
        b"WARC-Payload-Digest: sha1:" + digest,
        b"WARC-Payload-Length: %d" % len(payload),
        b"Content-Type: application/http;msgtype=response",
    ]
    if revisit:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: " + name(refers_to)]
    return b"\r\n".join([*head, b"Content-Length: %d" % len(block), b"", block, b"", b""])


def parse(raw: bytes) -> tuple:
    """(page_id, uri, record_type, payload_bytes, payload_digest, refers_to, payload) of a record, digest checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if version != VERSION:
        raise ValueError("not a WARC record")
    fields = dict(line.split(b": ", 1) for line in lines)
    block = rest[: int(fields[b"Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    kind = fields[b"WARC-Type"].decode()
    digest = fields[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
    if kind == "response" and payload_digest(payload) != digest:
        raise ValueError(f"payload of {fields[b'WARC-Record-ID']!r} does not have its digest")
    number = lambda v: None if v is None or v.startswith(b"<urn:page:none:") else int(v.split(b":")[2])
    uri = fields[b"WARC-Target-URI"].decode("latin-1")
    return (number(fields[b"WARC-Record-ID"]), uri, kind, int(fields[b"WARC-Payload-Length"]), digest, number(fields.get(b"WARC-Refers-To")), payload)


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("/") else folder.replace(":", "://", 1))


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, response_id, repeated: of equal payloads the one with the largest page_id is the response.

    Payloads are equal if their SHA-256 and length are.  Null html counts as empty.  ``repeated`` marks
    payloads that some page holds in several rows.  Pages whose payload no other has stay where they are.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    keyed = rows.withColumn("_key", F.concat_ws("-", F.sha2("payload", 256), F.length("payload").cast("string")))
    own = keyed.groupBy("_key", "page_id").agg(F.count("*").alias("m"))
    groups = own.groupBy("_key").agg(F.max("page_id").alias("response_id"), F.sum("m").alias("n"), (F.max("m") > 1).alias("repeated"))
    # Only copied payloads need a partner; their list is slim.
    copied = stage(groups.filter("n > 1"), "warc-copies")
    marked = suspected(keyed, copied, "_key", "_copied")
    found = attach(
        marked.filter("_copied"), copied, "_key", "n", ["response_id", "repeated"], F.concat(F.lit("page"), F.coalesce(F.col("page_id").cast("string"), F.monotonically_increasing_id().cast("string")))
    )
    single = marked.filter(~F.col("_copied")).withColumns({"response_id": F.lit(None).cast("long"), "repeated": F.lit(False)})
    return single.unionByName(found).select("page_id", "url", "payload", "response_id", F.coalesce("repeated", F.lit(False)).alias("repeated"))


def sample_payloads(pages: DataFrame) -> list[bytes]:
    """Bounded sample for the dictionary: at most SAMPLE_RECORDS windows of at most SAMPLE_BYTES."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    code = F.xxhash64(payload)
    # Windows begin at a place given by the hash, so heads are not favoured.
    start = F.pmod(code, F.greatest(F.lit(1), F.length(payload) - SAMPLE_BYTES + 1)).cast("int") + 1
    # Hashes alone are sorted; then each chosen payload comes once, however many copies it has.
    chosen = {r["code"] for r in pages.select(code.alias("code")).orderBy("code").limit(SAMPLE_RECORDS).collect()}
    rows = pages.select(code.alias("code"), F.substring(payload, start, F.lit(SAMPLE_BYTES)).alias("part")).filter(F.col("code").isin(list(chosen)))
    return [bytes(r["part"]) for r in rows.groupBy("code").agg(F.first("part").alias("part")).orderBy("code").collect()]


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write every page to archives below ``folder`` (a URI); returns the manifest: archive, records, bytes, and the offset of each record."""
    dictionary = build_dictionary(sample_payloads(pages))
    shared = pages.sparkSession.sparkContext.broadcast(dictionary)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        raw = shared.value
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(raw), write_checksum=True)
        out, name, size, offsets, done = None, "", 0, [], []
        for batch in batches:
            for page_id, url, payload, response, repeated in zip(_ids(batch["page_id"]), batch["url"], batch["payload"], _ids(batch["response_id"]), batch["repeated"].tolist()):
                if out is None:
                    name, size, offsets = f"part-{uuid4().hex}.warc.zst", 0, []
                    # The frames are the compression: the stream must not add one by the file's name.
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                    if raw:
                        head = struct.pack("<II", SKIPPABLE, len(raw)) + raw
                        out.write(head)
                        size = len(head)
                revisit = response is not None and response != page_id
                frame = compressor.compress(record(page_id, url, bytes(payload), response, revisit, repeated))
                out.write(frame)
                offsets.append(size)
                size += len(frame)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((name, len(offsets), size, offsets))
                    out = None
        if out is not None:
            out.close()
            done.append((name, len(offsets), size, offsets))
        yield pd.DataFrame(done, columns=["archive", "records", "bytes", "offsets"])

    return stage(plan_records(pages).mapInPandas(write, MANIFEST), "warc-manifest")


def _ids(series: pd.Series) -> list:
    return [None if pd.isna(x) else int(x) for x in series]


def read_frames(stream) -> Iterator[bytes]:
    """Records of an archive, one at a time: the leading dictionary, then a frame for each."""
    import zstandard

    buffer = stream.read(8)
    dictionary = None
    if len(buffer) == 8 and struct.unpack("<II", buffer)[0] == SKIPPABLE:
        dictionary = _dictionary(stream.read(struct.unpack("<II", buffer)[1]))
        buffer = b""
    context = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while True:
        buffer = buffer or stream.read(READ_BYTES)
        if not buffer:
            return
        frame, parts = context.decompressobj(), []
        while True:
            parts.append(frame.decompress(buffer))
            if frame.eof:
                buffer = frame.unused_data
                break
            buffer = stream.read(READ_BYTES)
            if not buffer:
                raise ValueError("an archive ends within a record")
        yield b"".join(parts)


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """The records of the archives of a manifest: page_id, uri, record_type, payload_bytes, payload_digest, refers_to, payload.

    A revisit has no payload here; its digest and length are those of the full one.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = _open(folder)
        for batch in batches:
            for name in batch["archive"]:
                rows, held = [], 0
                with system.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for raw in read_frames(stream):
                        rows.append(parse(raw))
                        held += len(raw)
                        if held > 8 << 20:
                            yield _frame(rows)
                            rows, held = [], 0
                if rows:
                    yield _frame(rows)

    # A manifest is a row per archive: an archive per task, by ranges (by hash several would meet).
    spread = manifest.select("archive").repartitionByRange(max(1, min(manifest.count(), 100_000)), "archive")
    return spread.mapInPandas(read, RECORDS)


def read_record(folder: str, archive: str, offset: int) -> tuple:
    """One record, read from its own place; of the rest of the archive only the dictionary is looked at."""
    import zstandard

    system, root = _open(folder)
    with system.open_input_file(f"{root}/{archive}") as file:
        head = file.read(8)
        dictionary = None
        if len(head) == 8 and struct.unpack("<II", head)[0] == SKIPPABLE:
            dictionary = _dictionary(file.read(struct.unpack("<II", head)[1]))
        file.seek(offset)
        context = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
        frame, parts = context.decompressobj(), []
        while not frame.eof:
            block = file.read(READ_BYTES // 16)
            if not block:
                raise ValueError("an archive ends within a record")
            parts.append(frame.decompress(block))
    return parse(b"".join(parts))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["page_id", "uri", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])
    return out.assign(page_id=out["page_id"].astype("Int64"), refers_to=out["refers_to"].astype("Int64"))


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the pages as archives and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload, null or empty url is ``about:blank``.  A page without an id never is the
    response of copies that have one; if none has, all are responses, as are repeated rows with
    the largest id.  A record is held whole in memory, so a payload may be as long as a cell.  An empty table gives no
    archives and no rows; other columns are ignored.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    back = read_archives(write_archives(pages, folder), folder)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


#: The digest's base32 is made of its 160 bits, five at a time.
ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, encode(coalesce(html, '')) AS payload, sha1(encode(coalesce(html, ''))) AS h,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages
), b AS (
  SELECT *, array_to_string([format('{:04b}', CAST('0x' || h[i] AS INTEGER)) for i in range(1, 41)], '') AS bits FROM p
)
SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes,
       array_to_string(['ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + CAST('0b' || bits[5 * i + 1:5 * i + 5] AS INTEGER)] for i in range(32)], '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM b
"""
