"""Later rules against stored content, by the index of pieces."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keysift.plans.retro import new_secrets, rescan, rescan_folder
from keysift.operators.scan import scan
from keysift.sources import pieces
from keysift.sources.pieces import append_pieces, candidate_files, file_code, file_pieces, indexed_files, needed_pieces
from keysift.sources.rules import Rule, matchers, read_packs

FILES = "app_key string, file_path string, text string"
RULES = [
    Rule("late.yml", 1, "Exact", r"zebra_[0-9]+"),
    Rule("late.yml", 2, "Folded", r"(?i)walrus=\w+"),
    Rule("late.yml", 3, "Either", r"(otter|badger)-key"),
    Rule("late.yml", 4, "Pairs", r"[Kk][Ee][Yy]stone \d"),
    Rule("late.yml", 5, "Lines", r"begin seal\n.*end", multiline=True),
]
OPEN = Rule("late.yml", 6, "Open", r"[0-9]{9}")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def corpus(spark, n=1500, seed=1):
    rng = random.Random(seed)
    hits = ["zebra_12", "ZEBRA_12", "WalruS=Ab", "walruſ=x", "otter-key", "badger - key", "badger-key", "KEYstone 5", "keystone x", "begin seal\nthe end", "begin sealing", "123456789"]
    out = []
    for i in range(n):
        words = [f"word{rng.randrange(500)}" for _ in range(rng.randrange(1, 60))]
        if rng.random() < 0.06:
            words.insert(rng.randrange(len(words) + 1), rng.choice(hits))
        out.append((f"app{i % 7}", f"f/{i}.txt", rng.choice((" ", "\n", "é ")).join(words)))
    out += [("app0", "empty", ""), ("app0", "short", "ze"), ("app0", "null", None), ("app0", "null bytes", "\0zebra_1\0"), ("app0", "long", "x" * 300_000 + " zebra_99")]
    return spark.createDataFrame(out, FILES)


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pieces") / "index")
    files = corpus(spark)
    for batch_id in (0, 1, 1):  # the repeated batch replaces itself
        append_pieces(files.where(F.pmod(F.xxhash64("file_path"), F.lit(2)) == batch_id), path, batch_id)
    return files, path


def test_equal_to_a_full_scan(spark, indexed):
    files, path = indexed
    for rules in (RULES, RULES[:1], RULES[1:3], [RULES[4]], [*RULES, OPEN], [OPEN], read_packs()[0]):
        assert rows(rescan(files, rules, path)) == rows(scan(files, rules))
    assert rows(rescan(files, RULES, path, first_rule_only=True)) == rows(scan(files, RULES, first_rule_only=True))
    assert rescan(files, RULES, path).count() > 40
    assert rows(rescan(files, [Rule("p", 1, "Nowhere", "quokka-[0-9]")], path)) == []
    with pytest.raises(ValueError):
        rescan(files, [], path)


def test_most_files_are_skipped(spark, indexed):
    files, path = indexed
    candidates, closed, open_rules = candidate_files(spark, [*RULES, OPEN], path)
    assert [r.ordinal for r in closed] == [1, 2, 3, 4, 5] and [r.ordinal for r in open_rules] == [6]
    found = {r.file for r in candidates.collect()}
    assert len(found) < 0.1 * files.count()
    matching = {r[0] for r in scan(files, RULES).select("app_key", F.col("FileLocation").alias("file_path")).select(file_code()).collect()}
    assert matching <= found and len(matching) > 30
    assert indexed_files(spark, path).count() == files.count()


def test_postings_are_looked_up_by_piece(spark, indexed):
    """Equalities reach the scan; only the postings of the rules' pieces come out of it."""
    files, path = indexed
    candidates, _, _ = candidate_files(spark, RULES[:1], path)
    plan = candidates._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(piece," in plan and "PushedFilters" in plan and "CartesianProduct" not in plan
    kept = spark.read.parquet(path).where("piece in ('zeb', 'ebr', 'bra', 'ra_')").count()
    assert kept < 0.01 * spark.read.parquet(path).count()


def test_pieces_of_texts(spark):
    found = {tuple(r) for r in file_pieces(spark.createDataFrame([("a", "f", "AbcD\nabſ é12"), ("a", "g", None)], FILES)).select("piece").collect()}
    assert found == {("abc",), ("bcd",), ("abs",), ("bs ",), ("",)}


def test_pieces_equal_a_plain_loop(spark, monkeypatch):
    """Texts of odd letters, empty and short ones, one of several stretches; repeated files; blocks of few rows and bytes."""
    rng = random.Random(3)
    letters = [*"abcXYZ019 ~\x1f\x7f\t\n\0éſİ中😀"]
    texts = [None, "", "a", "ab", "abc", *("".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(3000))]
    texts.append("".join(rng.choices(letters, weights=[30] * 11 + [1] * 10, k=1_400_000)))
    files = spark.createDataFrame([(f"app{i % 3}", f"f{i // 2}", t) for i, t in enumerate(texts)], FILES)
    lowered = files.select(file_code(), F.expr("coalesce(replace(lower(text), 'ſ', 's'), '')")).collect()
    printable = lambda s: all(" " <= c <= "~" for c in s)
    wanted = sorted((p, f) for f, t in lowered for p in {"", *(t[i : i + 3] for i in range(len(t) - 2) if printable(t[i : i + 3]))})
    assert sorted(map(tuple, file_pieces(files).collect())) == wanted
    small = [r for r in lowered if len(r[1]) < 100]
    monkeypatch.setattr(pieces, "ROWS", 7)
    monkeypatch.setattr(pieces, "BYTES", 40)
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in small], pa.int64()), pa.array([r[1] for r in small])], ["file", "text"])
    found = [t for b in pieces._postings([batch.slice(3)]) for t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert sorted(found) == sorted((p, f) for f, t in small[3:] for p in {"", *(t[i : i + 3] for i in range(len(t) - 2) if printable(t[i : i + 3]))})


def test_needed_pieces(spark):
    by_name = {m.rules[0].name: needed_pieces(m) for m in matchers(spark, [*RULES, OPEN])}
    assert by_name["Exact"] == [[{"zeb", "ebr", "bra", "ra_"}]] and by_name["Open"] == []
    assert {frozenset(w) for w in by_name["Either"][0]} >= {frozenset({"-ke", "key"})} or len(by_name["Either"][0]) == 2


def test_folder(spark, tmp_path):
    root, path = tmp_path / "apps", str(tmp_path / "index")
    for i in range(60):
        file = root / f"app{i % 3}" / f"_d/{i}.txt"
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(f"line {i}\n" + ("zebra_7 otter-key\n" if i % 20 == 0 else "nothing\n"))
    from keysift.sources.corpus import load_corpus

    files = load_corpus(spark, str(root))
    append_pieces(files, path, 0)
    assert rows(rescan_folder(spark, str(root), RULES, path)) == rows(scan(files, RULES))
    assert rescan_folder(spark, str(root), [RULES[0], OPEN], path).count() == 3
    assert candidate_files(spark, RULES, path)[0].count() == 3


def test_new_secrets(spark, indexed):
    files, path = indexed
    found = rescan(files, RULES, path)
    finding = F.struct("Type", "LineNo", "FileLocation", "SecretType", "SecretString")
    reports = found.where("app_key = 'app1'").groupBy("app_key").agg(F.collect_list(finding).alias("Findings"))
    late = new_secrets(found, reports)
    assert late.columns == found.columns and late.where("app_key = 'app1'").count() == 0
    assert late.count() == found.where("app_key != 'app1'").select("app_key", "SecretString").distinct().count()


def test_subtotals(spark):
    from keysift.operators.dedupe import count_with_subtotals

    table = [("p", "x", "a"), ("p", "x", "a"), ("p", "x", "b"), ("p", "y", "a"), ("q", "x", "c"), (None, None, "c")]
    found = {(r.pack, r.Type, r.level): (r.n_findings, r.n_apps) for r in count_with_subtotals(spark.createDataFrame(table, "pack string, Type string, app_key string")).collect()}
    assert found == {
        ("p", "x", 0): (3, 2),
        ("p", "y", 0): (1, 1),
        ("q", "x", 0): (1, 1),
        (None, None, 0): (1, 1),
        ("p", None, 1): (4, 2),
        ("q", None, 1): (1, 1),
        (None, None, 1): (1, 1),
        (None, None, 3): (6, 3),
    }
