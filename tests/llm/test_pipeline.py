import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from keysift.llm.decontaminate import find_copies
from keysift.llm.quality import fit, score_texts
from tests.llm import samples
from tests.llm.test_exact_dedup import brute as exact_groups
from tests.llm.test_packing import check

SF = "/root/testdata/sf0.001"


def test_registered():
    names = set(queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names
    assert set(oracle_sql()) <= names


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept, seen = docs, {}
    for name, apply in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.stage(apply(spark, kept, SF), "test")
        assert kept.columns == docs.columns
        seen[name] = {r.doc_id: r.text for r in kept.collect()}
    scores, bias = fit(docs, labels)
    good = {r.doc_id: r.text for r in docs.collect() if score_texts([r.text], scores.tobytes(), bias)[0] >= 0.5}
    assert seen["quality"] == good
    assert set(seen["exact_dedup"]) == {r[0] for r in exact_groups(list(good.items())) if r[3]}
    shingles = {}
    for doc_id, text in seen["exact_dedup"].items():
        own = text.lower().split()
        shingles[doc_id] = {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))}
    left = sorted(seen["near_dedup"])
    for i, a in enumerate(left):
        for b in left[:i]:
            assert len(shingles[a] & shingles[b]) < 0.9 * len(shingles[a] | shingles[b])
    for gone in set(seen["exact_dedup"]) - set(left):
        best = max(len(shingles[gone] & s) / len(shingles[gone] | s) for d, s in shingles.items() if d != gone)
        assert best > 0.6
    copies = {r.doc_id for r in find_copies(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert set(seen["decontamination"]) == set(left) - copies
    check(corpus_pipeline.run(spark, SF).collect(), list(seen["decontamination"].items()))


def test_empty_and_awkward_documents(spark, awkward, nothing, wide, tmp_path):
    for docs in (awkward, nothing, wide):
        kept = docs
        for _, apply in corpus_pipeline.STAGES[:-1]:
            kept = apply(spark, kept, SF)
            assert kept.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, kept, SF).count() >= 0
    assert samples.rows(corpus_pipeline.near(spark, awkward, SF), "doc_id")
