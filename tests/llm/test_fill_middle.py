import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from keysift.llm import fill_middle as M
from tests.compare import connect
from tests.llm import samples

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text) -> tuple:
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        form, out = "spm", f"<S>{suffix}<P>{prefix}<M>{middle}"
    else:
        form, out = "psm", f"<P>{prefix}<S>{suffix}<M>{middle}"
    return (doc_id, n, form, len(prefix), len(middle), sha(out), sha(text))


def query(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return samples.rows(M.op12_fill_middle(spark, str(tmp_path)))


def awkward_texts() -> list[str]:
    rng = random.Random(5)
    pieces = ["<", ">", "<S", "P>", "<P", "M>", "S>", "ab", "c", " ", "\n", "é", "日", "\U0001f600", "$1", "\\", "{3}", "\x00", "K"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(40))) for _ in range(600)]


def test_against_brute_force(spark, tmp_path):
    rows = [r[:2] for r in samples.AWKWARD] + [(100 + i, t) for i, t in enumerate(awkward_texts())] + [(5000, "a <M> b"), (5001, "<p>"), (None, "<S>")]
    found = query(spark, rows, tmp_path)
    assert found == sorted((expected(*r) for r in rows), key=repr)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("unit", ["x1", "word ", "日", "longwordwithoutblanks"])
def test_very_long_texts(spark, tmp_path, unit):
    rows = [(i, unit * 300_000) for i in range(4)]
    assert query(spark, rows, tmp_path) == sorted((expected(*r) for r in rows), key=repr)


def test_extra_columns_and_empty_tables(spark, awkward, nothing, wide):
    assert samples.rows(M.fill_middle(wide)) == samples.rows(M.fill_middle(awkward))
    assert M.fill_middle(nothing).count() == 0


def test_parts_make_up_the_text(spark, small):
    joined = M.fill_middle(small).join(small.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id")
    whole = F.when(F.col("form") == "plain", F.col("output")).otherwise(F.concat("prefix", "middle", "suffix"))
    assert joined.filter(whole != F.col("text")).count() == 0 and joined.filter("form != 'plain'").count() > 100


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    found = samples.rows(M.op12_fill_middle(spark, sf))
    assert found == sorted(connect(sf).execute(M.ORACLE).fetchall(), key=repr) and len(found) == 200


def test_one_match_and_no_shuffle(spark):
    plan = M.op12_fill_middle(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1 and "Python" not in plan
