import random

from pyspark.sql import functions as F

from keysift.functions import text as fx


def column(spark, values, function):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in frame.orderBy("i").select(function(F.col("v"))).collect()]


def expected_secret(content: str) -> str:
    first, last = content.find(">"), content.rfind("<")
    if first >= 0 and first + 1 < last:
        return content[first + 1 : last].strip(fx.WHITE_SPACE)
    if content.count('"') >= 2:
        return content.split('"')[1]
    if ":" in content:
        return content[content.rindex(":") + 1 :].strip(fx.WHITE_SPACE)
    return content


def test_extract_secret_on_random_strings(spark):
    rng = random.Random(1)
    values = ["".join(rng.choice('<>": \té\nx') for _ in range(rng.randrange(10))) for _ in range(4000)]
    values += ["<a></a>", '"k": "v"', "x:", '""', ">a<", "<b>", "", "https://host/x"]
    assert column(spark, values, fx.extract_secret) == [expected_secret(v) for v in values]


def test_trim_space(spark):
    assert column(spark, ["  a b 　\r\n", "\t", "", "﻿x"], fx.trim_space) == ["a b", "", "", "﻿x"]


def test_names(spark):
    assert column(spark, ["/a/b/c.apk", "a/b.apk", "x.apk"], fx.base_name) == ["c.apk", "a/b.apk", "x.apk"]
    assert column(spark, ["https://h/a/f.apk", "f", "h/"], fx.last_segment) == ["f.apk", "f", ""]
    assert column(spark, ["a.apk", "a.APK", "pk", ""], fx.is_app_file) == [True, False, False, False]
    assert column(spark, ["a.apk.apk", "a.txt"], fx.json_name) == ["a.json.json", "a.txt"]
    assert column(spark, ["é", ""], fx.byte_length) == [2, 0]


def test_fingerprint(spark):
    import hashlib

    assert column(spark, ["é"], fx.fingerprint) == [hashlib.sha256("é".encode()).digest()[:16].hex()]
    binary = spark.createDataFrame([(b"\x00\xff",)], "v binary").select(fx.fingerprint(F.col("v"))).first()[0]
    assert binary == hashlib.sha256(b"\x00\xff").digest()[:16].hex()


def test_quoted_runs_and_segments(spark):
    values = ["name='com.x'", " 'small' 'normal'", "''", "'a' \"x\" 'b' 'c'", "plain"]
    assert column(spark, values, fx.quoted_runs) == [["com.x"], ["small normal"], [], ["a", "b c"], []]
    assert column(spark, ["a:b:c", "a"], fx.colon_segment) == ["b", None]
    assert column(spark, ["a b  c"], lambda v: fx.token(v, 2)) == [""]


def test_array_text_round_trip(spark):
    arrays = [[], ["a"], ['q"', "b\\", "", "c,d", "{}"]]
    frame = spark.createDataFrame([(a,) for a in arrays], "v array<string>")
    text = frame.select(fx.array_to_text(F.col("v")).alias("t"))
    assert [r.t for r in text.collect()][:2] == ["{}", '{"a"}']
    assert [r[0] for r in text.select(fx.text_to_array(F.col("t"))).collect()] == arrays
