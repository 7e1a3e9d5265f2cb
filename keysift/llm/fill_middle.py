"""Fill-in-the-middle transformation by a counted-quantifier pattern, in native expressions.

A text is a run of units: words of ASCII letters and single other characters.  ``regexp_count`` gives
their number n; two cut points come from a hash of the id.  A pattern made for each row, with
the possessive groups ``unit{a}+`` and ``unit{b-a}+``, then captures prefix, middle and suffix in one match.
Possessive quantifiers run as loops and never try again, so a text of any length needs no stack
and one pass.  A map without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.llm.common import table, text_of

# The units of a text and the three markers.
UNITS = "[A-Za-z]+|[^A-Za-z]"
UNIT = "(?:[A-Za-z]++|[^A-Za-z])"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = "<[PSM]>"

#: Texts whose third and fourth hash number, modulo 100, lie from here on stay plain; below here turn suffix-first.
PLAIN_FROM = 90
SPM_BELOW = 20


def hash_numbers(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a document: the first hex digits of the SHA-256 of ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def cut_pattern(a: Column, b: Column) -> Column:
    """A row's pattern: a units, then b - a units, then the rest, of the whole text."""
    count = lambda k: F.concat(F.lit("{"), k.cast("string"), F.lit("}+"))
    return F.concat(F.lit(rf"(?s)\A({UNIT}"), count(a), F.lit(f")({UNIT}"), count(b - a), F.lit(r")(.*+)\z"))


def rebuilt(output: Column, form: Column) -> Column:
    """The text that an output was made of.

    No marker occurs in a text that was cut, and none can arise where a marker meets other characters (each begins with
    its only ``<`` and ends with its only ``>``), so the markers of an output are the three set there.
    """
    parts = F.split(output, MARKERS, -1)
    first, second, third = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, third, second)).when(form == "spm", F.concat(second, third, first)).otherwise(output)


def fill_middle(docs: DataFrame, seed: int = 1, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """One row per document: doc_id, n, form, prefix, middle, suffix, output.

    ``n`` counts units.  ``form`` is ``plain`` (the text as it is; prefix, middle and suffix null), ``psm`` or ``spm``.
    Null text counts as empty, and empty texts and those that hold a marker are plain.  A null doc_id stays
    null and hashes as no digits; repeated rows come out alike; an empty table gives no rows; other
    columns are ignored.  Texts are cut whole, whatever their length.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    counted = rows.withColumn("n", F.regexp_count("text", F.lit(UNITS)).cast("long"))
    h1, h2, h3, h4 = hash_numbers(F.col("doc_id"), seed)
    one, other = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    plain = (F.col("n") == 0) | F.col("text").rlike(MARKERS) | (h3 % 100 >= plain_from)
    form = F.when(plain, "plain").when(h4 % 100 < spm_below, "spm").otherwise("psm")
    planned = counted.select("doc_id", "text", "n", form.alias("form"), F.least(one, other).alias("a"), F.greatest(one, other).alias("b"))
    # One match: the captured groups come back with a marker, which the text doesn't hold, between them.
    matched = F.regexp_replace("text", cut_pattern(F.col("a"), F.col("b")), F.lit(f"$1{MIDDLE}$2{SUFFIX}$3"))
    parts = planned.withColumn("parts", F.when(F.col("form") != "plain", F.split(matched, MARKERS, -1)))
    cut = parts.select("doc_id", "text", "n", "form", *[F.get("parts", F.lit(i)).alias(name) for i, name in enumerate(("prefix", "middle", "suffix"))])
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle"))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle"))
        .otherwise(F.col("text"))
    )
    return cut.withColumn("output", output).drop("text")


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_middle(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id",
        "n",
        "form",
        F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"),
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(rebuilt(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


ORACLE = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), k AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t
), c AS (
  SELECT doc_id, text, u, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k
), p AS (
  SELECT doc_id, text, n, form, coalesce(array_to_string(u[1:a], ''), '') AS prefix, coalesce(array_to_string(u[a + 1:b], ''), '') AS middle,
         coalesce(array_to_string(u[b + 1:n], ''), '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
