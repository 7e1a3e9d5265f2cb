"""The folder source and ignore files."""

import random

import pytest
from pyspark.sql import functions as F

from keysift.sources.corpus import load_corpus, scannable
from keysift.sources.files import AppFilesReader, list_files, read_files
from keysift.sources.ignore import IGNORE_FILES, ignore_rules, ignored_paths, not_ignored, parse_rule


def write(root, files: dict) -> None:
    for path, data in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(data)


def test_corpus(spark, tmp_path):
    root = tmp_path / "apps"
    write(root, {"a/src/x.txt": b"one\ntwo\n", "a/.git/y": b"z", "b/bin.so": b"\x00tok_1", "b/.hid": b"z", "b/ok..txt": b"ok", "top.txt": b"t"})
    assert load_corpus(spark, str(root)).count() == 4  # hidden paths are not listed
    write(root, {p: b"q" for p in ("a/assets/apps/index.txt", "a/_c.txt", "b/_n x/%2 #.txt", "b/s p/%41 #.txt", "b/.g/_z", "b/_s/_SUCCESS", "é/日本 .txt")})
    expected = {
        *(("a", p) for p in ("a/src/x.txt", "a/assets/apps/index.txt", "a/_c.txt")),
        *(("b", p) for p in ("b/bin.so", "b/ok..txt", "b/_n x/%2 #.txt", "b/s p/%41 #.txt", "b/_s/_SUCCESS")),
        ("top.txt", "top.txt"),
        ("é", "é/日本 .txt"),
    }
    for folder in (str(root), f"{root}/", f"file://{root}", f"file:{root}"):
        assert {(r.app_key, r.file_path) for r in load_corpus(spark, folder).collect()} == expected
    with pytest.raises(ValueError):
        load_corpus(spark, str(tmp_path / "*"))
    assert {r.app_key for r in list_files(spark, str(root), app_depth=2).collect()} > {"a/src", "a/_c.txt", "b/_n x"}
    assert list_files(spark, str(root), hidden=True).where("file_path like '%.g/%' or file_path like '%.git/%'").count() == 2
    texts = {r.file_path: r.text for r in load_corpus(spark, str(root)).collect()}
    assert texts["a/src/x.txt"] == "one\ntwo\n" and texts["b/bin.so"] == "\0tok_1"
    kept = {r.file_path for r in scannable(load_corpus(spark, str(root))).collect()}
    assert kept == {p for _, p in expected} - {"b/bin.so"}


def test_listing_is_partitioned_by_folder_and_reads_only_what_is_left(spark, tmp_path):
    write(tmp_path, {f"app{i}/f{j}.txt": b"x" * j for i in range(6) for j in range(40)})
    reader = AppFilesReader(str(tmp_path), 1, False)
    assert len(reader.partitions()) == 6 and all(len(p.names) == 1 for p in reader.partitions())
    listing = list_files(spark, str(tmp_path))
    assert listing.rdd.getNumPartitions() == 6 and listing.agg(F.sum("size")).first()[0] == 6 * sum(range(40))
    # A folder with all the files is read by several tasks.
    (tmp_path / "app0" / "f3.txt").unlink()
    one = read_files(listing.where("app_key = 'app1'"), str(tmp_path))
    assert one.count() == 40 and one.select(F.spark_partition_id()).distinct().count() > 1
    (tmp_path / "empty").mkdir()
    assert load_corpus(spark, str(tmp_path / "empty")).count() == 0


# A matcher written out by hand: patterns and paths as lists of names.


def name_matches(glob: str, name: str) -> bool:
    if not glob:
        return not name
    if glob[0] == "*":
        return any(name_matches(glob[1:], name[i:]) for i in range(len(name) + 1))
    if not name:
        return False
    if glob[0] == "?":
        return name_matches(glob[1:], name[1:])
    if glob[0] == "[":
        end = glob.index("]", 2)
        inside, negated = glob[1:end], glob[1] in "!^"
        inside = inside[1:] if negated else inside
        ranges = [(inside[i], inside[i + 2]) for i in range(len(inside) - 2) if inside[i + 1] == "-"]
        has = name[0] in inside.replace("-", "") or any(a <= name[0] <= b for a, b in ranges)
        return has != negated and name_matches(glob[end + 1 :], name[1:])
    if glob[0] == "\\":
        return glob[1] == name[0] and name_matches(glob[2:], name[1:])
    return glob[0] == name[0] and name_matches(glob[1:], name[1:])


def path_matches(globs: list[str], names: list[str]) -> bool:
    if not globs:
        return not names
    if globs[0] == "**":
        if len(globs) == 1:
            return bool(names)
        return any(path_matches(globs[1:], names[i:]) for i in range(len(names) + 1))
    return bool(names) and name_matches(globs[0], names[0]) and path_matches(globs[1:], names[1:])


def decision(texts: dict[str, str], path: str, is_folder: bool) -> bool:
    """Whether the rules of the folders above leave a path out, itself alone."""
    names = path.split("/")
    for depth in range(len(names) - 1, -1, -1):
        folder = "/".join(names[:depth])
        verdict = None
        for file in IGNORE_FILES:
            for line in texts.get(f"{folder}/{file}".lstrip("/"), "").split("\n"):
                line = line.rstrip(" ")
                if not line or line[0] == "#":
                    continue
                negated, line = line[0] == "!", line.lstrip("!")
                only, line = line.endswith("/"), line.rstrip("/")
                if not line or (only and not is_folder):
                    continue
                globs = line.removeprefix("/").split("/") if "/" in line else ["**", line]
                if path_matches(globs, names[depth:]):
                    verdict = not negated
        if verdict is not None:
            return verdict
    return False


def brute(texts: dict[str, str], paths: list[str]) -> set[str]:
    out = set()
    for path in paths:
        names = path.split("/")
        above = ["/".join(names[:k]) for k in range(1, len(names))]
        if any(decision(texts, folder, True) for folder in above) or decision(texts, path, False):
            out.add(path)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_ignored_paths_of_a_random_tree(spark, seed):
    rng = random.Random(seed)
    words = ["a", "b", "ab", "ba", "x.log", "y.txt", "a-b", "build", "c d", ".e"]
    paths = sorted({"/".join(rng.choice(words) for _ in range(rng.randrange(1, 6))) for _ in range(400)})
    pieces = ["a", "b", "*", "a*", "*.log", "?", "[ab]", "[!a]", "[a-b]b", "**", "x.log", "build", "c d", "\\a", "y.*", "a?b"]

    def rule() -> str:
        line = "/".join(rng.choice(pieces) for _ in range(rng.choice((1, 1, 2, 3))))
        return rng.choice(("", "", "!")) + rng.choice(("", "/")) + line + rng.choice(("", "", "/", "  "))

    folders = sorted({"/".join(p.split("/")[:k]) for p in paths for k in range(p.count("/") + 1)})
    texts = {}
    for folder in ["", *rng.sample(folders, min(25, len(folders)))]:
        lines = [rng.choice(("# note", "", rule(), rule(), rule())) for _ in range(rng.randrange(1, 4))]
        texts[f"{folder}/{rng.choice(IGNORE_FILES)}".lstrip("/")] = "\n".join(lines)
    if seed % 2:  # without rules for everything at the top
        texts = {k: v for k, v in texts.items() if "/" in k}
    rules = ignore_rules(spark.createDataFrame(list(texts.items()), "file_path string, text string"))
    table = spark.createDataFrame([(p,) for p in paths], "file_path string")
    expected = brute(texts, paths)
    assert {r.file_path for r in ignored_paths(table, rules).collect()} == expected
    assert {r.file_path for r in ignored_paths(table, rules, hot=20).collect()} == expected  # hot folders split
    twice = table.unionByName(table).withColumn("text", F.lit("t"))
    kept = not_ignored(twice, rules)
    assert kept.columns == ["file_path", "text"] and kept.count() == 2 * (len(paths) - len(expected))


def test_lines_of_ignore_files():
    assert parse_rule("") is parse_rule("# a") is parse_rule("/") is parse_rule("[ab") is parse_rule("   ") is None
    assert parse_rule("!a/") == (True, True, r"(?s)\A(?:.*/)?a\z") and parse_rule("a\\ ")[2].endswith(r"a\ \z")
    assert parse_rule("\\#a\r")[2] == r"(?s)\A(?:.*/)?\#a\z" and parse_rule("/a**b")[2] == r"(?s)\Aa[^/]*b\z"


def test_ignore_files_of_a_folder(spark, tmp_path):
    write(
        tmp_path,
        {
            "a/.gitignore": b"*.log\n",  # no repository: without effect
            "a/k.log": b"1",
            "b/.git/HEAD": b"",
            "b/.gitignore": b"*.log\nout/\n",
            "b/s/.ignore": b"!keep.log\n",
            "b/k.log": b"1",
            "b/s/keep.log": b"1",
            "b/s/k.log": b"1",
            "b/out/x": b"1",
            "b/out2/x": b"1",
        },
    )
    found = {r.file_path for r in load_corpus(spark, str(tmp_path)).collect()}
    assert found == {"a/k.log", "b/s/keep.log", "b/out2/x"}
    assert load_corpus(spark, str(tmp_path), ignore=()).count() == 6
