import base64
import hashlib
import io
import struct

import pytest

from keysift.llm import warc as W
from tests.compare import connect
from tests.llm import samples

PAGES = "page_id long, url string, html string"
ROWS = [
    (1, "http://a/1", "<p>same</p>"),
    (2, None, "<p>same</p>"),
    (3, "http://é x\n/?q=%", "<p>same</p>"),
    (4, "u", None),
    (4, "u", None),
    (None, "u", ""),
    (None, "q", "only this one"),
    (5, "", "long " * 100_000),
    (6, "v", "one more, with \r\n\r\n in it"),
]


def brute(pages: list[tuple]) -> list[tuple]:
    out = []
    for page_id, _, html in pages:
        payload = (html or "").encode()
        ids = [i for i, _, h in pages if (h or "").encode() == payload and i is not None]
        last = max(ids, default=None)
        revisit = last is not None and page_id != last
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((page_id, len(payload), digest, "revisit" if revisit else "response", last if revisit else None))
    return sorted(out, key=repr)


def test_awkward_rows(spark):
    pages = spark.createDataFrame(ROWS, PAGES)
    assert samples.rows(W.archive_pages(pages)) == brute(ROWS)
    from pyspark.sql import functions as F

    wide = pages.withColumns({c: F.lit(1) for c in ("payload", "n", "response_id", "_key", "archive", "code")})
    assert samples.rows(W.archive_pages(wide)) == brute(ROWS)
    assert W.archive_pages(pages.limit(0)).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").collect()]
    assert samples.rows(W.op6_warc(spark, "/root/testdata/sf0.001")) == brute(rows)


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert samples.rows(W.op6_warc(spark, sf), *columns) == sorted(connect(sf).execute(W.ORACLE).fetchall(), key=repr)


def test_archives_hold_what_was_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "ARCHIVE_BYTES", 40_000)
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    folder = f"file://{tmp_path}/archives"
    manifest = W.write_archives(pages.coalesce(2), folder)
    assert manifest.count() > 2
    texts = {r.page_id: r for r in pages.collect()}
    for r in W.read_archives(manifest, folder).collect():
        assert bytes(r.payload).decode() == texts[r.page_id].html and r.uri == texts[r.page_id].url
    import zstandard

    packed, seen = 0, set()
    for r in manifest.collect():
        raw = (tmp_path / "archives" / r.archive).read_bytes()
        magic, size = struct.unpack("<II", raw[:8])
        # The skippable frame leads, and holds a dictionary.
        assert magic == 0x184D2A5D and raw[8:12] == struct.pack("<I", 0xEC30A437) and len(raw) == r.bytes
        assert r.offsets[0] == 8 + size and r.records == len(r.offsets)
        plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size]))
        for at, end in zip(r.offsets, [*r.offsets[1:], r.bytes]):
            # Each record is one frame: a plain reader opens it without the others.
            assert raw[at : at + 4] == struct.pack("<I", zstandard.MAGIC_NUMBER)
            one = W.parse(plain.decompress(raw[at:end]))
            assert one == W.read_record(folder, r.archive, at) and one[-1].decode() == texts[one[0]].html
            seen.add(one[0])
        packed += r.bytes - 8 - size
    assert seen == set(texts) and packed < sum(len(zstandard.compress(r.html.encode())) for r in texts.values())


def test_record_ids_are_unique(spark, tmp_path):
    folder = f"file://{tmp_path}/archives"
    W.write_archives(spark.createDataFrame([*ROWS, *ROWS, (9, "u", "<p>same</p>")], PAGES), folder)
    ids = []
    for file in (tmp_path / "archives").iterdir():
        with file.open("rb") as stream:
            ids += [raw.split(b"WARC-Record-ID: ")[1].split(b"\r\n")[0] for raw in W.read_frames(stream)]
    assert len(ids) == len(set(ids)) == 2 * len(ROWS) + 1


def test_a_changed_payload_is_noticed():
    raw = W.record(1, "u", b"payload", None, False)
    assert W.parse(raw)[-1] == b"payload"
    with pytest.raises(ValueError):
        W.parse(raw.replace(b"payload\r", b"paYload\r"))
    with pytest.raises(ValueError):
        list(W.read_frames(io.BytesIO(__import__("zstandard").compress(b"x" * 1000)[:-4])))


def test_dictionary_of_few_samples():
    assert W.build_dictionary([]) == b"" and W.build_dictionary([b""]) == b""
    assert W.build_dictionary([b"short"]) == b"short"
