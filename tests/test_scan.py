import random
from pathlib import Path

import duckdb
import pytest

from keysift.functions.guards import required_literals
from keysift.operators.dedupe import distinct_secrets
from keysift.operators.scan import plan_probes, rule_hits, scan
from keysift.sources.rules import Rule, load_rules, matchers, read_packs, rule_errors
from tests.samples import matching

RULES = read_packs()[0]


def files(spark, rows):
    return spark.createDataFrame(rows, "app_key string, file_path string, text string")


def spots(frame):
    return sorted((r.FileLocation, r.LineNo, r.pack, r.ordinal) for r in frame.collect())


def test_shipped_packs():
    assert [sum(r.pack == p for r in RULES) for p in ("broad.yml", "strict.yml")] == [61, 40]
    assert len({r.regex for r in RULES}) == 77
    assert {r.confidence for r in RULES} == {"high"}


def test_all_shipped_rules_are_valid_and_guarded(spark):
    found = matchers(spark, RULES)
    assert len(found) == 77 and all(m.guard for m in found)
    probes, probe_of = plan_probes(found)
    assert len(probes) < 62
    for (word, fold), i in probe_of.items():
        text, ignore = probes[i]
        assert text in (word.lower() if ignore else word) and (ignore or not fold)
    assert rule_errors(spark).count() == 0


def test_controls_match_like_re2(spark):
    """Matches, cut matches and case flips of every rule: same answer as RE2 for all rules."""
    rng = random.Random(7)
    texts = []
    for rule in RULES:
        for _ in range(4):
            hit = matching(rule.regex, rng)
            flip = "".join(ch.swapcase() if rng.random() < 0.3 else ch for ch in hit)
            cut = rng.randrange(len(hit))
            texts += [hit, "x " + hit + " y", hit[:cut] + hit[cut + 1 :], flip, hit.replace("s", "ſ").replace("k", "K"), hit + "\r"]
    texts = sorted(set(t for t in texts if "\n" not in t))
    rows = [("a", str(i), t + "\n") for i, t in enumerate(texts)]
    ours = {}
    for path, _, pack, ordinal in spots(rule_hits(files(spark, rows), RULES)):
        ours.setdefault((pack, ordinal), set()).add(path)
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT unnest(?) AS id, unnest(?) AS text", [[r[1] for r in rows], [r[2] for r in rows]])
    for rule in RULES:
        theirs = {r[0] for r in con.execute("SELECT id FROM t WHERE regexp_matches(text, ?)", [rule.regex]).fetchall()}
        assert theirs, rule
        assert ours.get((rule.pack, rule.ordinal), set()) == theirs, rule


def test_unicode_folding_is_simple(spark):
    rows = [("a", "1", "twıtter " + "a" * 40), ("a", "2", "TWITTER " + "a" * 40), ("a", "3", "TWİTTER " + "a" * 40)]
    rule = [r for r in RULES if r.pack == "broad.yml" and r.ordinal == 6]
    assert [s[0] for s in spots(rule_hits(files(spark, rows), rule))] == ["2"]


def test_terminator_counts_for_matches(spark):
    url = "x ftp://user:secret@host.example"
    rule = [r for r in RULES if r.name == "Password in URL"]
    rows = [("a", "ended", url + "\n"), ("a", "open", url), ("a", "inner", url + "\nlast"), ("a", "quoted", url + "'")]
    assert [s[0] for s in spots(rule_hits(files(spark, rows), rule))] == ["ended", "inner", "quoted"]


def test_lines_split_at_newline_only(spark):
    rows = [("a", "f", "none\r\nghp_" + "a" * 36 + "\r\rnone\n\nghp_" + "b" * 36 + "\n")]
    rule = [r for r in RULES if r.name == "Github Personal Access Token"]
    assert [s[1] for s in spots(rule_hits(files(spark, rows), rule))] == [2, 4]


def test_unguarded_rules_scan_every_line(spark):
    rows = [("a", "f", "1\n\n22\n"), ("a", "g", ""), ("a", "h", "x")]
    rules = [Rule("p", 1, "digits", r"[0-9]+"), Rule("p", 2, "key", "AKIA"), Rule("p", 3, "empty", "^$")]
    assert required_literals(r"[0-9]+") is None
    assert spots(rule_hits(files(spark, rows), rules)) == [("f", 1, "p", 1), ("f", 2, "p", 3), ("f", 3, "p", 1)]


def test_guards_never_exclude_a_match():
    rng = random.Random(3)
    for regex in ["ab?c", "(foo|bar)+baz", "x{2,3}y", "(?:ab)?cd", "a|", "(key|pass)=", "[aA][bB]_?cd", "a{0}b", "(a|b)(c|d)(e|f)(g|h)(i|j)k", "q(rs)*t"]:
        guard = required_literals(regex)
        for _ in range(50):
            text = matching(regex, rng)
            for group in guard.groups if guard else ():
                assert any(w in (text.lower() if guard.ignore_case else text) for w in group), (regex, text, guard)


@pytest.mark.parametrize("regex", [r"[[:alpha:]]+x", r"\p{L}x", r"[a&&b]x", r"a\Qb.\E", "(", r"(?x) a b", r"a++b"])
def test_foreign_constructs_are_not_guarded(regex):
    assert required_literals(regex) is None


def test_first_rule_only_equals_distinct_over_all(spark):
    rng = random.Random(5)
    lines = [matching(r.regex, rng) for r in RULES for _ in range(3)]
    rows = [(f"app{i % 3}", f"f{i % 7}", "\n".join(lines[i::21])) for i in range(21)]
    every = distinct_secrets(scan(files(spark, rows), RULES))
    first = distinct_secrets(scan(files(spark, rows), RULES, first_rule_only=True))
    assert sorted(every.collect()) == sorted(first.collect())
    assert every.count() > 100  # more findings than any fixed buffer of a hundred


def test_many_rules_take_several_passes(spark, monkeypatch):
    rows = [("a", "f", "\n".join(f"tok_{i}_" for i in range(100)))]
    rules = [Rule("p", i, f"r{i}", f"tok_{i}_") for i in range(100)]
    monkeypatch.setattr("keysift.operators.scan.PASS", 40)
    assert spots(rule_hits(files(spark, rows), rules)) == [("f", i + 1, "p", i) for i in range(100)]


def test_shared_regexes_name_all_their_rules(spark):
    rows = [("a", "f", "AIza" + "b" * 35)]
    names = {r.Type for r in scan(files(spark, rows), load_rules(spark)).collect()}
    assert {"Google API Key", "Google Drive API Key", "Google Gmail API Key", "Google YouTube API Key"} <= names


def test_spanning_rules(spark):
    text = "a\nBEGIN\nx\nEND\nBEGIN END\nBEGIN\nnever\n"
    rules = [Rule("p", 1, "block", r"BEGIN[^\n]*\n[^\n]*\nEND\n?", multiline=True), Rule("p", 2, "end", "END$", multiline=True)]
    assert spots(rule_hits(files(spark, [("a", "f", text)]), rules)) == [
        ("f", 2, "p", 1), ("f", 3, "p", 1), ("f", 4, "p", 1), ("f", 4, "p", 2), ("f", 5, "p", 2),
    ]


@pytest.mark.parametrize("block", [1, 3, 512])
@pytest.mark.parametrize("regex", ["a\n+b|bb\na", "^(?=\n)|ab", r"(a|b)\1\n", "(?=a)|b\n"])
def test_spanning_rules_against_brute_force(spark, monkeypatch, block, regex):
    import re

    monkeypatch.setattr("keysift.operators.scan.BLOCK", block)

    rng = random.Random(11)
    texts = ["".join(rng.choice("ab\n") for _ in range(40)) for _ in range(60)]
    texts += ["\nb\nab\nb\nab\n", "", "ab", "\n"]
    expected = []
    for i, text in enumerate(texts):
        touched = set()
        for m in re.finditer(regex, text):
            if not m.group():  # an empty match touches no line
                continue
            first = text.count("\n", 0, m.start()) + 1
            touched.update(range(first, first + m.group().rstrip("\n").count("\n") + 1))
        expected += [(str(i), n, "p", 1) for n in touched]
    rows = [("a", str(i), t) for i, t in enumerate(texts)]
    rule = [Rule("p", 1, "r", regex, multiline=True)]
    assert spots(rule_hits(files(spark, rows), rule)) == sorted(expected)


def test_broken_packs_and_rules(spark, tmp_path: Path):
    (tmp_path / "a.yml").write_text("patterns:\n  - pattern:\n      name: 'Own '\n      regex: \"tok_\\\\d+\"\n      confidence: low\n")
    (tmp_path / "b.yaml").write_text("patterns: [unclosed\n")
    (tmp_path / "c.yml").write_text("patterns:\n  - pattern: {name: Bad, regex: '(', confidence: high}\n")
    (tmp_path / "d.txt").write_text("patterns: []")
    rules = load_rules(spark, str(tmp_path))
    assert [(r.pack, r.name, r.regex) for r in rules.collect()] == [("a.yml", "Own ", r"tok_\d+"), ("c.yml", "Bad", "(")]
    errors = {(r.pack, r.name) for r in rule_errors(spark, str(tmp_path)).collect()}
    assert errors == {("b.yaml", None), ("c.yml", "Bad")}
    assert spots(rule_hits(files(spark, [("a", "f", "tok_12")]), rules)) == [("f", 1, "a.yml", 1)]


def test_scan_does_not_shuffle_and_prunes(spark, tmp_path):
    files(spark, [("a", "f", "x")]).selectExpr("*", "1 as unused").write.parquet(str(tmp_path / "t"))
    source = spark.read.parquet(str(tmp_path / "t"))
    plan = scan(source, RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "unused" not in plan
    assert plan.count("split(text") <= 2
