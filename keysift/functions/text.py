"""Scalar functions on strings and arrays; all are native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters with the Unicode White_Space property.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def trim_space(text: Column) -> Column:
    """Strip all Unicode white space from both ends (plain ``trim`` strips blanks only)."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def extract_secret(content: Column) -> Column:
    """The secret part of a matching line.

    In this order: what stands between the first ``>`` and the last ``<``; what
    stands between the first two double quotes; what follows the last colon; the
    whole content.
    """
    opening = F.instr(content, ">")
    closing = F.length(content) - F.instr(F.reverse(content), "<") + 1
    tagged = (opening > 0) & F.contains(content, F.lit("<")) & (opening + 1 < closing)
    quotes = F.length(content) - F.length(F.replace(content, F.lit('"'), F.lit("")))
    return (
        F.when(tagged, trim_space(F.substring(content, opening + 1, closing - opening - 1)))
        .when(quotes >= 2, F.substring_index(F.substring_index(content, '"', 2), '"', -1))
        .when(F.contains(content, F.lit(":")), trim_space(F.substring_index(content, ":", -1)))
        .otherwise(content)
    )


def fingerprint(content: Column) -> Column:
    """Hex of the first 16 bytes of SHA-256; takes strings or binary."""
    return F.substring(F.sha2(content, 256), 1, 32)


def base_name(path: Column) -> Column:
    """Last segment of an absolute path; a relative path stays as it is."""
    return F.when(F.startswith(path, F.lit("/")), last_segment(path)).otherwise(path)


def last_segment(url: Column) -> Column:
    return F.substring_index(url, "/", -1)


def is_app_file(name: Column) -> Column:
    """Case-sensitive ``.apk`` suffix; short names are simply not app files."""
    return F.endswith(name, F.lit(".apk"))


def json_name(name: Column) -> Column:
    return F.replace(name, F.lit(".apk"), F.lit(".json"))


def report_name(file_name: Column, version: Column) -> Column:
    return F.concat(file_name, F.lit("_"), version, F.lit(".json"))


def findings_name(file_name: Column, version: Column) -> Column:
    return F.concat(file_name, F.lit("_Secrets_"), version, F.lit(".json"))


def quoted_runs(text: Column) -> Column:
    """All runs from a single quote to the last single quote before a double quote, unquoted."""
    runs = F.regexp_extract_all(text, F.lit("'[^\"]+'"), F.lit(0))
    return F.transform(runs, lambda run: F.replace(run, F.lit("'"), F.lit("")))


def token(text: Column, n: int) -> Column:
    """The n-th piece between single blanks, counted from 0; null when missing."""
    return F.get(F.split(text, " ", -1), F.lit(n))


def colon_segment(text: Column) -> Column:
    """What stands between the first and the second colon; null without a colon."""
    return F.get(F.split(text, ":", -1), F.lit(1))


def byte_length(text: Column) -> Column:
    return F.octet_length(text)


def array_to_text(items: Column) -> Column:
    """Array literal with every element quoted, e.g. ``{"a","b \\" c"}``."""
    quoted = F.transform(
        items,
        lambda x: F.concat(
            F.lit('"'),
            F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')),
            F.lit('"'),
        ),
    )
    return F.concat(F.lit("{"), F.array_join(quoted, ","), F.lit("}"))


def text_to_array(text: Column) -> Column:
    """Inverse of :func:`array_to_text`."""
    bodies = F.regexp_extract_all(text, F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1))
    return F.transform(bodies, lambda x: F.regexp_replace(x, r"\\(.)", "$1"))
