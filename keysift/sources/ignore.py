"""Ignore files: which paths of a folder tree a search leaves out.

The rules of a folder hold for all that lies below it.  A path is decided by the last rule that matches it in the nearest folder
that has one; ``!`` takes a path back in, though not one below an ignored folder.  Folders and files are decided once each, by
joining their paths with the folders above them; only names take part.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.operators.duplicates import HOT_COPIES, skew_join
from keysift.operators.likely import without_keys
from keysift.sources.files import list_files, read_files

# Names of ignore files, of which a later one in the same folder prevails.  The first holds in repositories only.
IGNORE_FILES = (".gitignore", ".ignore", ".rgignore")
REPOSITORY = ".git"

RULES = "array<struct<negated:boolean,folders_only:boolean,pattern:string>>"


def glob_regex(glob: str) -> str | None:
    """The regex of a glob, for paths below its folder; None for one that matches nothing (an open bracket)."""
    out, at = [], 0
    if glob.startswith("**/"):
        out.append("(?:.*/)?")
        at = 3
    while at < len(glob):
        char = glob[at]
        if glob.startswith("/**/", at):
            out.append("/(?:.*/)?")
            at += 4
        elif glob[at:] == "/**":
            out.append("/.+")
            at = len(glob)
        elif char == "*":
            run = len(glob) - at - len(glob[at:].lstrip("*"))
            out.append(".*" if glob == "**" else "[^/]*")
            at += run
        elif char == "?":
            out.append("[^/]")
            at += 1
        elif char == "[":
            end = glob.find("]", at + 2 if glob[at + 1 : at + 2] not in ("!", "^") else at + 3)
            if end < 0:
                return None
            inner = glob[at + 1 : end]
            negated = inner[0] in "!^"
            inner = inner[1:] if negated else inner
            body = re.sub(r"([\\\[\]^&])", r"\\\1", inner)
            out.append(f"(?!/)[{'^' if negated else ''}{body}]")
            at = end + 1
        else:
            if char == "\\" and at + 1 < len(glob):
                at += 1
                char = glob[at]
            out.append("\\" + char if not char.isalnum() and char.isascii() else char)
            at += 1
    return "".join(out)


def parse_rule(line: str) -> tuple[bool, bool, str] | None:
    """(negated, folders only, regex) of a line of an ignore file, None if it is no rule."""
    line = line.rstrip("\r")
    while line.endswith(" ") and not line.endswith("\\ "):
        line = line[:-1]
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line
    folders_only = line.endswith("/")
    line = line.rstrip("/") if folders_only else line
    if not line:
        return None
    # A rule with a slash before its end starts at its folder; another one holds at any depth.
    glob = line.removeprefix("/") if "/" in line else f"**/{line}"
    regex = glob_regex(glob)
    return None if regex is None else (negated, folders_only, rf"(?s)\A{regex}\z")


def _parsed(text: Column) -> Column:
    """The rules of a text; ignore files are few and short."""
    names = ("negated", "folders_only", "pattern")

    @F.pandas_udf(RULES)
    def parsed(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(names, rule)) for line in text.split("\n") if (rule := parse_rule(line))] for text in texts])

    return parsed(F.coalesce(text, F.lit("")))


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, r"(^|/)[^/]*$", "")


def _above(path: Column) -> Column:
    """The folders above a path, the root as an empty text."""
    parts = F.split(path, "/", -1)
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def ignore_rules(files: DataFrame, names: Sequence[str] = IGNORE_FILES) -> DataFrame:
    """``(folder, rules)`` from ignore files ``(file_path, text)``, in the order in which the last one prevails."""
    kind = F.array_position(F.array(*map(F.lit, names)), F.element_at(F.split("file_path", "/"), -1))
    each = files.where(kind > 0).select(_folder(F.col("file_path")).alias("folder"), kind.alias("kind"), _parsed(F.col("text")).alias("rules"))
    # A folder has one file of each name.
    own = F.array_sort(F.collect_list(F.struct("kind", "rules")))
    return each.groupBy("folder").agg(F.flatten(F.transform(own, lambda x: x["rules"])).alias("rules")).where(F.size("rules") > 0)


def load_ignore_rules(spark: SparkSession, path: str, names: Sequence[str] = IGNORE_FILES) -> DataFrame:
    """The rules of the ignore files below ``path``; a ``.gitignore`` counts where its folder, or one above it, holds a repository."""
    listing = list_files(spark, path, hidden=True)
    found = listing.where(F.element_at(F.split("file_path", "/"), -1).isin(list(names)))
    git = found.where(F.endswith("file_path", F.lit(IGNORE_FILES[0])))
    inside = F.regexp_extract("file_path", rf"^(.*?)(?:^|/)\{REPOSITORY}/", 1)
    repositories = listing.where(F.rlike("file_path", F.lit(rf"(^|/)\{REPOSITORY}/"))).select(inside.alias("folder")).distinct()
    above = git.select("file_path", F.explode(F.array_append(_above(F.col("file_path")), _folder(F.col("file_path")))).alias("folder"))
    tracked = above.join(repositories, "folder", "left_semi").select("file_path").distinct()
    used = found.where(~F.endswith("file_path", F.lit(IGNORE_FILES[0]))).unionByName(git.join(tracked, "file_path", "left_semi"))
    return ignore_rules(read_files(used, path), names)


def ignored_paths(paths: DataFrame, rules: DataFrame, hot: int = HOT_COPIES) -> DataFrame:
    """The distinct ``file_path`` of ``paths`` that ``rules(folder, rules)`` leave out.

    Joins are on folder names; those above very many paths are split (see ``skew_join``).
    """
    files = paths.select("file_path").distinct()
    folders = files.select(F.explode(_above(F.col("file_path"))).alias("path")).where("path != ''").distinct()
    nodes = files.select(F.col("file_path").alias("path"), F.lit(False).alias("is_folder")).unionByName(folders.withColumn("is_folder", F.lit(True)))
    pairs = nodes.select("path", "is_folder", F.explode(_above(F.col("path"))).alias("folder"))
    joined = skew_join(pairs, rules, "folder", "path", hot)
    below = F.when(F.col("folder") == "", F.col("path")).otherwise(F.substring("path", F.length("folder") + 2, F.length("path")))
    placed = joined.withColumn("below", below)
    matched = F.filter("rules", lambda r: (F.col("is_folder") | ~r["folders_only"]) & F.rlike(F.col("below"), r["pattern"]))
    decided = placed.select("path", "is_folder", F.length("folder").alias("depth"), F.try_element_at(matched, F.lit(-1))["negated"].alias("negated"))
    last = decided.where(F.col("negated").isNotNull()).groupBy("path", "is_folder").agg(F.max_by("negated", "depth").alias("negated"))
    gone = last.where("NOT negated").select(F.concat_ws(":", F.col("is_folder").cast("string"), "path").alias("node"))
    # A file goes if it, or any folder above it, is ignored.
    own = F.transform(F.filter(_above(F.col("file_path")), lambda f: f != ""), lambda f: F.concat(F.lit("true:"), f))
    reached = files.select("file_path", F.explode(F.array_append(own, F.concat(F.lit("false:"), F.col("file_path")))).alias("node"))
    return skew_join(reached, gone, "node", "file_path", hot).select("file_path").distinct()


def not_ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``files`` (a listing, or a table with texts) without the paths that the rules leave out; nothing but names is shuffled."""
    return without_keys(files, ignored_paths(files, rules), "file_path")
