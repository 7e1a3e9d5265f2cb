import random
import re

from keysift.llm import licenses as L
from tests.compare import connect
from tests.llm import samples

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(samples.LOWER))


def base(text) -> tuple:
    own = words(text)
    places = [
        (i, label) for phrase, label in L.PHRASES.items() for i in range(len(own)) if own[i : i + len(phrase.split())] == phrase.split()
    ]
    at = [i for i, _ in places]
    return (len(own), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))


def labels(text, threshold=L.THRESHOLD, templates=L.TEMPLATES) -> tuple:
    """Every template against every window of its size, without any filter."""
    own, found, best = words(text), set(), 0.0
    for label, template in templates:
        need, size = set(words(template)), 40
        while size < 2 * len(words(template)):
            size *= 2
        for start in range(0, max(1, len(own)), size // 2):
            block = set(own[start : start + size])
            if need and len(block & need) >= threshold * len(need) - 1e-9:
                found.add(label)
                best = max(best, len(block & need) / len(need))
    return ",".join(sorted(found | set(filter(None, base(text)[4].split(","))))), best


def expected(rows, templates=L.TEMPLATES) -> list[tuple]:
    return sorted(((d, *base(t), *labels(t, templates=templates)) for d, t in rows), key=repr)


NOTICES = [
    (20, "x " * 37 + "Permission is hereby granted, free of charge, to any person obtaining a copy of this software" + " y" * 50),
    (21, "Released under the MIT License."),
    (22, "Licensed under CC BY-NC 4.0. cc by cc by"),
    (23, "This work is licensed under the GNU General Public License, version 3. All rights reserved all rights reserved"),
    (24, "the mit of license under released"),
    (25, "released the word mit and license"),
    (26, "cc\x00by ALL\nRIGHTS--RESERVED écc by ccé by Kcc by"),
    (27, "cc"),
]


def test_awkward_rows(spark, awkward, nothing, wide):
    rows = [r[:2] for r in samples.AWKWARD]
    assert samples.rows(L.scan_licenses(awkward)) == expected(rows)
    assert samples.rows(L.scan_licenses(wide)) == expected(rows)
    assert L.scan_licenses(nothing).count() == 0
    assert samples.rows(L.scan_licenses(spark.createDataFrame(NOTICES, "doc_id long, text string"))) == expected(NOTICES)


def test_query_against_all_blocks_and_templates(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = samples.rows(L.op7_licenses(spark, sf))
    assert found == expected(rows) and sum(1 for r in found if r[6]) > 20


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert samples.rows(L.op7_licenses(spark, sf)) == sorted(connect(sf).execute(L.ORACLE).fetchall(), key=repr)


def test_native(spark):
    plan = L.op7_licenses(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Exchange" not in plan


def edited(rng, text: str, share: float) -> str:
    own = text.split()
    for _ in range(int(share * len(own))):
        own[rng.randrange(len(own))] = f"other{rng.randrange(10**6)}"
    return " ".join(own)


def test_whole_license_texts(spark):
    """Texts of 80 to 250 words, whole, edited and cut, anywhere in a document."""
    rng = random.Random(4)
    rows = []
    for i in range(120):
        label, text = L.TEXTS[i % len(L.TEXTS)]
        body = [lambda: text, lambda: edited(rng, text, 0.04), lambda: edited(rng, text, 0.5), lambda: " ".join(text.split()[: len(text.split()) // 2])][i % 4]()
        rows.append((i, " ".join([*samples.prose(rng, rng.randrange(300)).split(), body, *samples.prose(rng, rng.randrange(300)).split()])))
    found = samples.rows(L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")))
    assert found == expected(rows)
    by = {r[0]: r for r in found}
    for i in range(120):
        if i % 4 < 2:
            assert L.TEXTS[i % len(L.TEXTS)][0] in by[i][6].split(",") and by[i][7] >= L.THRESHOLD
    assert {L.block_words(t) for _, t in L.TEXTS} == {320, 640}


def test_templates_of_the_caller(spark, awkward):
    templates = (("it's \\ \"x\"", "a row without an id, of some words in all"), ("long", "w " * 30 + "row without id words"), ("none", " ... "), ("empty", ""))
    rows = [r[:2] for r in samples.AWKWARD]
    found = samples.rows(L.scan_licenses(awkward, templates))
    assert found == expected(rows, templates) and any("it's" in r[6] for r in found)
    assert L.scan_licenses(awkward, ()).count() == len(samples.AWKWARD)
