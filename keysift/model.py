"""Schemas of the tables that flow between the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame

RULE = "pack string, ordinal int, name string, regex string, confidence string, multiline boolean"
RULE_ERROR = "pack string, ordinal int, name string, regex string, error string"

# The fields of one finding, as stored inside a report.
FINDING_FIELDS = ("Type", "LineNo", "FileLocation", "SecretType", "SecretString")
FINDING = "struct<Type:string,LineNo:int,FileLocation:string,SecretType:string,SecretString:string>"
FINDINGS = f"array<{FINDING}>"

# Total order of findings: rule order, then place.
FINDING_ORDER = ("pack", "ordinal", "FileLocation", "LineNo")

MESSAGES = "channel string, msg_pos long, ts string, files array<struct<url:string,name:string>>"

# Field names of the package facts.
PACKAGE_STRINGS = ("PackageName", "VersionCode", "VersionName", "CompileSdkVersion", "SdkVersion", "TargetSdk")
PACKAGE_LISTS = ("SupportScreens", "Densities", "NativeCode")

STRING, INT, LIST = "string", "int", "array<string>"

# Fixed values, metadata documents: field name and kind, per block.
METADATA_TOP = (("fileName", STRING), ("fileSize", INT), ("dexSize", INT), ("arscSize", INT))
METADATA_BLOCKS = {
    "androidManifest": (
        ("packageName", STRING),
        ("versionCode", STRING),
        ("numberOfActivities", INT),
        ("numberOfServices", INT),
        ("numberOfContentProviders", INT),
        ("numberOfBroadcastReceivers", INT),
        ("NamesOfActivities", LIST),
        ("NamesOfServices", LIST),
        ("NamesOfContentProviders", LIST),
        ("NamesOfBroadcastReceivers", LIST),
        ("UsesPermissions", LIST),
        ("UsesLibrary", LIST),
        ("UsesFeature", LIST),
        ("Permissions", LIST),
        ("PermissionsProtectionLevel", LIST),
        ("usesMinSdkVersion", STRING),
        ("usesTargetSdkVersion", STRING),
        ("usesMaxSdkVersion", STRING),
    ),
    "CertificateDatas": (
        ("fileName", STRING),
        ("signAlgorithm", STRING),
        ("signAlgorithmOID", STRING),
        ("startDate", STRING),
        ("endDate", STRING),
        ("publicKeyMd5", STRING),
        ("certBase64Md5", STRING),
        ("certMd5", STRING),
        ("version", INT),
        ("issuerName", STRING),
        ("subjectName", STRING),
    ),
    "resourceData": (
        ("locale", LIST),
        *(
            (name, INT)
            for name in (
                "numberOfStringResource",
                "pngDrawables",
                "ninePatchDrawables",
                "jpgDrawables",
                "gifDrawables",
                "xmlDrawables",
                "differentDrawables",
                "ldpiDrawables",
                "mdpiDrawables",
                "hdpiDrawables",
                "xhdpiDrawables",
                "xxhdpiDrawables",
                "xxxhdpiDrawables",
                "nodpiDrawables",
                "tvdpiDrawables",
                "unspecifiedDpiDrawables",
                "rawResources",
                "menu",
                "layouts",
                "differentLayouts",
            )
        ),
    ),
}


def require(frame: DataFrame, *columns: str) -> None:
    """Reject an input that lacks a column."""
    missing = [c for c in columns if c not in frame.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
