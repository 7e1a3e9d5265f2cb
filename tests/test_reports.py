import json
import random

import pytest
from pyspark.sql import functions as F

from keysift.model import FINDINGS
from keysift.operators import messages as m
from keysift.operators.metadata import flat_metadata, parse_metadata
from keysift.operators.package import package_facts
from keysift.operators.reports import build_reports, collect_findings, findings_json, parse_findings, report_documents
from keysift.sinks.documents import named_documents, read_documents, whole_documents, write_reports
from keysift.sinks.files import export_documents, file_name

BADGING = """package: name='com.ex.app' versionCode='7' versionName='1.2' compileSdkVersion='33' compileSdkVersionCodename='13'
sdkVersion:'21'
targetSdkVersion:'33'
supports-screens: 'small' 'normal' 'large' 'xlarge'
densities: '160' '240' '320'
native-code: 'arm64-v8a' 'armeabi-v7a'
"""


def facts(spark, text):
    row = package_facts(spark.createDataFrame([("a", text)], "app_key string, text string")).first()
    return list(row)[1:]


def test_package_facts(spark):
    full = ["com.ex.app", "7", "1.2", "33", "21", "33", ["small", "normal", "large", "xlarge"], ["160", "240", "320"], ["arm64-v8a", "armeabi-v7a"]]
    assert facts(spark, BADGING) == full
    assert facts(spark, BADGING + "x package y='2' versionName='' z='9'\n")[:4] == ["com.ex.app", "2", "1.2", "9"]
    assert facts(spark, BADGING + "alt-native-code: 'x86'\n")[8] == ["x86"]
    assert facts(spark, "package: name='a' versionCode='1' versionName='1 beta' compileSdkVersion='3'")[:4] == ["a", "1", "", ""]
    assert facts(spark, "package:") == [""] * 6 + [[], [], []]
    assert facts(spark, "") == [""] * 6 + [[], [], []]
    assert facts(spark, None) == [""] * 6 + [[], [], []]


def metadata(spark, text):
    return parse_metadata(spark.createDataFrame([("a", text)], "app_key string, json string")).first().Metadata


def test_metadata(spark):
    zero = metadata(spark, "{}")
    assert zero.fileName == "" and zero.arscSize == 0 and zero.resourceData.locale == []
    for broken in ('{"fileName": "x"', "", "null", "[]", "7", None):
        assert metadata(spark, broken) == zero, broken
    got = metadata(
        spark,
        json.dumps(
            {
                "FileName": "a.apk", "fileSize": 12345678901, "dexSize": "3", "arscSize": 4, "x": 1,
                "ANDROIDMANIFEST": {"packageName": 5, "namesofactivities": ["A", 1, None, "B"], "usesPermissions": "no"},
                "certificateDatas": {"fileName": "C", "version": 2.5}, "resourceData": [], "fileDigest": {"a": 1},
            }
        ),
    )
    assert (got.fileName, got.fileSize, got.dexSize, got.arscSize) == ("a.apk", 12345678901, 0, 4)
    assert got.androidManifest.packageName == "" and got.androidManifest.NamesOfActivities == ["A", "", "", "B"]
    assert got.androidManifest.UsesPermissions == []
    assert got.CertificateDatas.fileName == "C" and got.CertificateDatas.version == 0
    assert got.resourceData == zero.resourceData
    assert metadata(spark, '{"fileName": "first", "FILENAME": "last"}').fileName == "last"


def test_flat_metadata_has_unique_columns(spark):
    flat = flat_metadata(parse_metadata(spark.createDataFrame([("a", "{}")], "app_key string, json string")))
    assert len(set(flat.columns)) == len(flat.columns) == 1 + 4 + 18 + 11 + 21


def findings(spark, counts):
    rows = [
        (app, "p.yml", i % 3 + 1, f"type {i % 3}", i, f"file é{i % 5}", f"type {i % 3}", f"secret {app} {i}" + "x" * (i * 37 % 211))
        for app, n in counts.items()
        for i in range(n)
    ]
    return spark.createDataFrame(
        rows, "app_key string, pack string, ordinal int, Type string, LineNo int, FileLocation string, SecretType string, SecretString string"
    )


def reports(spark, counts, part_size=10_000):
    apps = spark.createDataFrame([(a, f"{a}.apk", "h" + a) for a in counts], "app_key string, FileName string, APKHash string")
    badging = spark.createDataFrame([(a, BADGING) for a in counts], "app_key string, text string")
    docs = spark.createDataFrame([(a, "{}") for a in counts], "app_key string, json string")
    return build_reports(apps, package_facts(badging), parse_metadata(docs), findings(spark, counts), part_size)


def test_report_parts_are_the_report(spark):
    parts = collect_findings(findings(spark, {"big": 500, "small": 4}), part_size=40).collect()
    big = sorted((p for p in parts if p.app_key == "big"), key=lambda p: p.part)
    assert [len(p.Findings) for p in big] == [40] * 12 + [20] and {(p.parts, p.n_findings) for p in big} == {(13, 500)}
    whole = [p for p in collect_findings(findings(spark, {"big": 500})).collect() if p.app_key == "big"]
    assert [f for p in big for f in p.Findings] == whole[0].Findings
    assert [(p.part, p.parts, p.n_findings, len(p.Findings)) for p in parts if p.app_key == "small"] == [(0, 1, 4, 4)]


def greedy(pieces, limit):
    """Plain model: pieces[0] is the header."""
    out, current = [], pieces[0]
    for piece in pieces[1:]:
        if len(current.encode()) + len(piece.encode()) > limit:
            out.append(current)
            current = piece
        else:
            current += piece
    return out + [current]


@pytest.mark.parametrize("part_size", [10_000, 60, 7])
@pytest.mark.parametrize("limit", [90, 700, 4000])
def test_packing_is_greedy_for_any_part_size(spark, part_size, limit):
    found = reports(
        spark, {"none": 0, "one": 1, "some": 25, "many": 230}, part_size
    )
    packed = {}
    for row in m.pack_reports(found, m.chat_header(), m.chat_entry, limit).orderBy("seq").collect():
        packed.setdefault(row.app_key, []).append((row.seq, row.body))
    texts = found.orderBy("app_key", "part").select("app_key", m.chat_header().alias("h"), F.transform(F.coalesce("Findings", F.array().cast(FINDINGS)), m.chat_entry).alias("e"))
    pieces = {}
    for row in texts.collect():
        pieces.setdefault(row.app_key, [row.h]).extend(row.e)
    assert set(packed) == {"none", "one", "some", "many"}
    for app, parts in pieces.items():
        assert packed[app] == list(enumerate(greedy(parts, limit))), app


@pytest.mark.parametrize("fan", [2, 3, 64])
def test_part_starts_against_a_plain_fold(spark, monkeypatch, fan):
    """Tables composed over several levels, down to two a row."""
    monkeypatch.setattr(m, "FAN", fan)
    rng = random.Random(2)
    limit, rows = 30, []
    for app in range(120):
        for part in sorted(rng.sample(range(20), rng.randint(1, 20))):
            sizes = [rng.randint(1, 50 if rng.random() < 0.2 else 12) for _ in range(rng.choice((1, 1, 2, 30)))]
            rows.append((app, part, sizes, 3 + app % 40))
    frame = spark.createDataFrame(rows, "app int, part int, sizes array<int>, head int")
    tables = frame.select("app", "part", F.col("head").alias("head_size"), *m._part_table(F.col("sizes"), limit))
    got = {}
    for r in m._part_starts(tables, ["app"], 20, limit).orderBy("part").collect():
        got.setdefault(r.app, []).append((r.part, r.start, r["first"]))
    for app in range(120):
        size, message, expected = 3 + app % 40, 0, []
        for _, part, sizes, _ in (r for r in rows if r[0] == app):
            expected.append((part, size, message))
            for s in sizes:
                if size + s > limit:
                    size, message = s, message + 1
                else:
                    size += s
        assert got[app] == expected, app


@pytest.mark.parametrize("limit", [90, 4000])
def test_packing_over_levels(spark, monkeypatch, limit):
    monkeypatch.setattr(m, "FAN", 3)
    counts = {"one": 1, "many": 230, "more": 301}
    whole, cut = reports(spark, counts), reports(spark, counts, 7)
    rows = lambda r: sorted(map(tuple, m.pack_reports(r, m.chat_header(), m.chat_entry, limit).collect()))
    assert rows(whole) == rows(cut)


def test_exact_limit_and_oversize(spark):
    head, entry = "h" * 10, "é" * 5  # 10 bytes each
    frame = spark.createDataFrame([([entry] * 3, head)], "e array<string>, h string")

    def run(limit):
        return frame.select(m.pack(F.col("e"), limit, F.col("h"), F.octet_length("h"))).first()[0]

    assert run(20) == [head + entry, entry + entry]
    assert run(19) == [head, entry, entry, entry]
    assert run(5) == [head, entry, entry, entry]


def test_chat_and_ticket_texts(spark):
    found = reports(spark, {"a": 1, "none": 0})
    chat = {r.app_key: r.body for r in m.chat_messages(found).collect()}
    head = "APK Name: {0}.apk\nApp Version: 1.2\nPackage Name: com.ex.app\nSHA1: h{0}\n\nSecrets in APK: \n----------------\n{1} secrets found\n----------------\n"
    entry = "Secret Type: type 0\nSecret Value: secret a 0\nSecret Type: type 0\nLine No: 0\nFile Location: file é0\n----------------\n"
    assert chat == {"a": head.format("a", 1) + entry, "none": head.format("none", 0)}
    ticket = {r.app_key: r.body for r in m.ticket_messages(found, title="T").collect()}
    assert ticket["a"] == (
        "h2. T\nh4. APK Name: a.apk\nh4. App Version: 1.2\nh4. Package Name: com.ex.app\nh4. SHA1: ha\nh4. Secrets in APK:\n"
        "----------------\n1 secrets found\n----------------\n"
        "{noformat}\n === type 0 ===\nSecret Value: secret a 0\nLine No: 0\nFile Location: file é0\n{noformat}"
    )
    absent = found.where("app_key = 'a'").withColumn("n_findings", F.lit(None).cast("long"))
    assert [r.body for r in m.chat_messages(absent).collect()] == ["** No secrets found **"]


def test_notifications(spark):
    sent = spark.createDataFrame([("a", 0, "x\n"), ("a", 1, "y")], "app_key string, seq int, body string")
    requests = spark.createDataFrame([("a", "C", "1.5", "SEC-1")], "app_key string, channel string, ts string, ticket_id string")
    assert sorted(m.chat_notifications(sent, requests.drop("ticket_id")).collect()) == [
        ("C", "1.5", "a", 0, "```x\n```"), ("C", "1.5", "a", 1, "```y```"),
    ]
    batches = sent.withColumn("batch_id", F.lit(1).cast("long")).unionByName(sent.limit(1).withColumn("batch_id", F.lit(2).cast("long")))
    named = requests.withColumn("batch_id", F.lit(2).cast("long"))
    assert [r.seq for r in m.chat_notifications(batches, named).collect()] == [0]
    with pytest.raises(ValueError):
        m.chat_notifications(batches, requests)
    tickets = m.ticket_notifications(sent, requests.select("app_key", "ticket_id")).orderBy("seq").collect()
    assert [json.loads(t.body) for t in tickets] == [{"body": "x\n"}, {"body": "y"}]


def test_documents(spark, tmp_path):
    found = reports(spark, {"a": 2, "none": 0})
    docs = {r.app_key: r for r in report_documents(found).collect()}
    body = json.loads(docs["a"].report_json)
    assert list(body) == ["FileName", "APKHash", "APKVersion", "SecretModel", "Metadata", "PackageDataModel"]
    assert json.loads(body["SecretModel"])[0]["SecretString"].startswith("secret a 0")
    assert body["PackageDataModel"]["Densities"] == ["160", "240", "320"] and "\n" in docs["a"].report_json
    assert json.loads(docs["none"].report_json)["SecretModel"] == "null" and docs["none"].findings_json == "null"
    for batch_id in (0, 1, 1):  # batches stay, and one written again replaces itself
        write_reports(found, batch_id, str(tmp_path / "results"), str(tmp_path / "backup"))
    names = ("a.apk_1.2.json", "a.apk_Secrets_1.2.json", "none.apk_1.2.json", "none.apk_Secrets_1.2.json")
    for folder in ("results", "backup"):
        written = whole_documents(read_documents(spark, str(tmp_path / folder))).collect()
        assert sorted((r.batch_id, r.document) for r in written) == [(b, n) for b in (0, 1) for n in names]
        assert all(json.loads(r.body) == body for r in written if r.document == names[0])
    export_documents(named_documents(reports(spark, {"a": 2}, part_size=1)), 0, str(tmp_path / "files"))
    assert json.loads((tmp_path / "files" / "batch_id=0" / "ha" / "a.apk_1.2.json").read_text()) == body


def test_exported_documents_are_whole_or_absent(spark, tmp_path):
    folder = tmp_path / "out"
    names = ["plain.json", "a/b%.json", "..", "", "é 日.json"]
    rows = [(f"h{i % 3}", f"{names[i % 5]}{'' if i % 5 > 1 and i < 5 else i}", part, f"<{i}.{part}>") for i in range(60) for part in range(1 + i % 4)]
    documents = spark.createDataFrame(rows, "APKHash string, document string, part int, body string")
    for _ in range(2):  # written again, a batch replaces itself
        export_documents(documents, 3, str(folder))
    found = {tuple(p.relative_to(folder).parts): p.read_text() for p in folder.rglob("*") if p.is_file()}
    wanted = {}
    for key, name, part, body in sorted(rows):
        place = ("batch_id=3", key, file_name(name))
        wanted[place] = wanted.get(place, "") + body
    assert found == wanted and len(found) == 60 and ("batch_id=3", "h2", "%2E%2E") in found
    # A task that fails after it has written files leaves none, and the batch that was there stays.
    broken = documents.withColumn("body", F.when(F.col("document") == "plain.json50", F.raise_error(F.lit("no body"))).otherwise(F.lit("new")))
    for batch_id in (3, 4):
        with pytest.raises(Exception, match="no body"):
            export_documents(broken, batch_id, str(folder))
    assert {tuple(p.relative_to(folder).parts): p.read_text() for p in folder.rglob("*") if p.is_file()} == wanted
    assert [p.name for p in folder.iterdir()] == ["batch_id=3"]
    export_documents(documents.limit(0), 5, str(folder))
    assert list((folder / "batch_id=5").iterdir()) == []


def test_a_failing_writer_cleans_up(tmp_path):
    import pyarrow as pa

    from keysift.sinks.files import DocumentFilesWriter

    writer = DocumentFilesWriter(str(tmp_path / "batch_id=0"))

    def batches():
        yield pa.RecordBatch.from_pydict({"APKHash": ["h", "h"], "document": ["a", "b"], "body": ["1", "2"]})
        raise OSError("lost")

    with pytest.raises(OSError, match="lost"):
        writer.write(batches())
    assert not [p for p in tmp_path.rglob(".attempt-*")]
    writer.abort([None])
    assert list(tmp_path.iterdir()) == []


def test_documents_of_equal_name_stay_apart(spark, tmp_path):
    found = reports(spark, {"a": 1, "b": 2}).withColumn("FileName", F.lit("x.apk"))
    write_reports(found, 0, str(tmp_path / "r"), str(tmp_path / "b"))
    written = whole_documents(read_documents(spark, str(tmp_path / "r"))).collect()
    assert sorted((r.APKHash, r.document) for r in written) == [(h, n) for h in ("ha", "hb") for n in ("x.apk_1.2.json", "x.apk_Secrets_1.2.json")]


@pytest.mark.parametrize("part_size", [3, 7])
def test_results_do_not_depend_on_the_part_size(spark, part_size):
    counts = {"big": 61, "even": 21, "none": 0, "one": 1}
    whole, cut = reports(spark, counts), reports(spark, counts, part_size)
    for messages in (m.chat_messages, m.ticket_messages, lambda r: whole_documents(named_documents(r))):
        assert sorted(map(tuple, messages(whole).collect())) == sorted(map(tuple, messages(cut).collect()))
    assert {r.parts for r in cut.where("app_key = 'big'").collect()} == {-(-61 // part_size)}


def test_one_report_per_app(spark):
    apps = spark.createDataFrame([("a", "a.apk", "h")], "app_key string, FileName string, APKHash string")
    badging = spark.createDataFrame([("a", BADGING), ("a", "package: name='z'"), ("b", "")], "app_key string, text string")
    docs = spark.createDataFrame([("a", '{"fileName": "x"}'), ("a", '{"fileName": "y"}')], "app_key string, json string")
    found = build_reports(apps, package_facts(badging), parse_metadata(docs), findings(spark, {"a": 1})).collect()
    assert [(r.PackageDataModel.PackageName, r.Metadata.fileName) for r in found] == [("z", "y")]
    numbered_docs = parse_metadata(docs).withColumn("seq", F.when(F.col("Metadata.fileName") == "x", 2).otherwise(1))
    found = build_reports(apps, package_facts(badging), numbered_docs, findings(spark, {"a": 1})).collect()
    assert [r.Metadata.fileName for r in found] == ["x"]


def test_findings_json_round_trip(spark):
    parts = collect_findings(findings(spark, {"a": 20}))
    text = parts.select(findings_json(F.col("Findings")).alias("j"), "Findings")
    row = text.select("Findings", parse_findings(F.col("j")).alias("back")).first()
    assert row.Findings == row.back
    assert text.first().j.startswith('[{"Type":"type 0","LineNo":0,"FileLocation":"file é0",')


def test_secret_runs(spark):
    from keysift.operators.versions import secret_runs

    held = {"1": "ab", "2": "a", "10": "abc", "11": "c", "x": "b"}
    rows = [(("p", v), [(s,) for s in own]) for v, own in held.items()] + [(("p", "10"), [("a",)]), (("q", "1"), None)]
    kind = "PackageDataModel struct<PackageName:string,VersionCode:string>, Findings array<struct<SecretString:string>>"
    found = secret_runs(spark.createDataFrame(rows, kind))
    # x is no number and comes first; then 1, 2, 10, 11.
    assert sorted(map(tuple, found.collect())) == [
        ("p", "a", 1, "1", "10", 3, False, True),
        ("p", "b", 1, "x", "1", 2, False, True),
        ("p", "b", 2, "10", "10", 1, True, True),
        ("p", "c", 1, "10", "11", 2, False, False),
    ]
