"""Inputs of the registered queries, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.functions.text import fingerprint
from keysift.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _cat(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def with_planted_line(documents: DataFrame) -> DataFrame:
    """Every document with one line in front that depends on its id and its own hash."""
    kind = F.col("doc_id") % 8
    digest = F.col("digest")
    planted = (
        F.when(kind == 0, _cat('github_token = "', F.substring(digest, 1, 40), '"'))
        .when(kind == 1, _cat('<string name="google_api_key">AIzaSy', F.substring(digest, 1, 33), "</string>"))
        .when(kind == 2, _cat("aws_id: AKIA", F.upper(F.substring(digest, 1, 16))))
        .when(kind == 3, F.lit('{"type": "service_account"}'))
        .when(kind == 4, _cat("endpoint https://svc:", F.substring(digest, 1, 12), "@db.example.com/x"))
        .when(kind == 5, F.lit("-----BEGIN RSA PRIVATE KEY-----"))
        .when(kind == 6, _cat("password=", F.substring(digest, 1, 24)))
        .otherwise("")
    )
    hashed = documents.withColumn("digest", F.sha2("text", 256))
    return hashed.withColumn("raw", F.col("text")).withColumn("text", _cat(planted, "\n", F.col("text")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``files(app_key, file_path, text)``: documents by source."""
    return with_planted_line(documents(spark, sf_dir)).select(
        F.col("source").alias("app_key"), F.col("doc_id").cast("string").alias("file_path"), "text"
    )


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an app of one file: ``(doc_id, app_key, FileName, APKHash, text)``."""
    doc = with_planted_line(documents(spark, sf_dir))
    key = _cat("d", F.lpad(F.col("doc_id").cast("string"), 9, "0"))
    return doc.select("doc_id", key.alias("app_key"), _cat(key, ".apk").alias("FileName"), fingerprint(F.col("raw")).alias("APKHash"), "text")


def badging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Badging text per part; the first parts carry the names of the document sources."""
    n, size = F.col("p_partkey"), F.col("p_size")
    dotted = F.replace("p_name", F.lit(" "), F.lit("."))
    version = F.when(n % 13 == 0, _cat(size, " beta")).otherwise(_cat(size, ".", n % 7))
    text = _cat(
        "package: name='com.", dotted, "' versionCode='", n, "' versionName='", version,
        "' compileSdkVersion='", size % 14 + 20, "' compileSdkVersionCodename='13'\n",
        F.when(n % 5 != 0, _cat("sdkVersion:'", size % 9 + 16, "'\n")).otherwise(""),
        "targetSdkVersion:'", size % 7 + 27, "'\n",
        "application: label='", F.col("p_brand"), "' icon='res/icon.png'\n",
        "supports-screens: 'small' 'normal' 'large'\n",
        F.when(n % 4 != 0, _cat("densities: '160' '", size * 10, "'\n")).otherwise(""),
        F.when(n % 3 == 0, F.lit("alt-native-code: 'x86' 'x86_64'\n")).otherwise("native-code: 'arm64-v8a'\n"),
        F.when(n % 11 == 0, _cat("uses-package: name='org.", dotted, "' a='", n, "' b='2' c='31'\n")).otherwise(""),
    )
    return spread(table(spark, sf_dir, "part")).select(_cat("src", n).alias("app_key"), text.alias("text"))


def metadata_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metadata document per supplier: odd key cases, wrong types, unknown keys, broken text."""
    n, nation = F.col("s_suppkey"), F.col("s_nationkey")
    whole = _cat(
        '{"fileName": "', F.col("s_name"), '.apk", "FILESIZE": ', n * 1000, ', "dexSize": "12", "arscSize": ', nation,
        ', "unknown": {"a": [1]}, "androidManifest": {"PackageName": "com.n', nation,
        '", "versionCode": 7, "numberOfActivities": ', n % 17, ', "numberOfServices": 1.5',
        ', "namesOfActivities": ["A', n, '", 5, null, "B \\"q\\""], "usesPermissions": [], "usesLibrary": "x"',
        ', "usesMinSdkVersion": "', nation + 10, '"}, "certificateDatas": {"fileName": "CERT.RSA", "version": ', nation % 4,
        ', "startDate": null}, "resourceData": {"locale": ["en", "l', nation, '"], "menu": ', n % 3,
        ', "pngDrawables": "many"}, "fileDigest": {"x": "y"}}',
    )
    json = F.when(n % 10 == 9, F.lit('{"fileName": "cut')).when(n % 10 == 8, F.lit("{}")).otherwise(whole)
    return spread(table(spark, sf_dir, "supplier")).select(_cat("src", n).alias("app_key"), json.alias("json"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as messages: some without files, some with two, some of equal time."""
    conv, turn = F.col("conv_id"), F.col("turn")
    name = _cat(F.col("role"), conv, "_", turn)

    def file(ending: str) -> Column:
        return F.struct(_cat("https://files.example.com/", conv, "/", name, ending).alias("url"), _cat(name, ending).alias("name"))

    none = F.array().cast("array<struct<url:string,name:string>>")
    files = (
        F.when(turn % 3 == 0, F.array(file(".txt"), file(".apk")))
        .when(turn % 3 == 1, F.array(file(".apk")))
        .otherwise(none)
    )
    return table(spark, sf_dir, "conversations").select(
        _cat("c", conv % 7).alias("channel"),
        (conv * 1000 + turn).alias("msg_pos"),
        _cat(conv, ".", F.floor(turn / 2)).alias("ts"),
        files.alias("files"),
    )
