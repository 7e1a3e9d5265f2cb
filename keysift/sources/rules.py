"""Rule packs: a folder of YAML files, or any table of the same columns."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from keysift.functions.guards import Guard, required_literals
from keysift.model import RULE, RULE_ERROR

try:
    import yaml
except ImportError:  # packs written in YAML's JSON subset still load
    yaml = None

SHIPPED_PACKS = str(Path(__file__).resolve().parent.parent / "packs")
# Unix lines (only \n ends a line) and Unicode case folding.
DIALECT = "(?du)"
DIALECT_MULTILINE = "(?dum)"


@dataclass(frozen=True)
class Rule:
    pack: str
    ordinal: int
    name: str
    regex: str
    confidence: str = ""
    multiline: bool = False


def _read_pack(text: str):
    """Parse one pack; raises ValueError if it is no pack."""
    body = "\n".join(line for line in text.splitlines() if not line.startswith("#"))
    try:
        doc = json.loads(body)
    except ValueError:
        if yaml is None:
            raise ValueError("PyYAML is needed for packs outside YAML's JSON subset") from None
        try:
            doc = yaml.safe_load(text)
        except yaml.YAMLError as error:
            raise ValueError(str(error)) from None
    if doc is None:
        return []
    if not isinstance(doc, dict) or not isinstance(doc.get("patterns") or [], list):
        raise ValueError("a pack is a mapping with a list named patterns")
    entries = []
    for item in doc.get("patterns") or []:
        entry = (item or {}).get("pattern") if isinstance(item or {}, dict) else None
        if entry is not None and not isinstance(entry, dict):
            raise ValueError("each pattern is a mapping")
        entries.append(entry or {})
    return entries


def read_packs(folder: str = SHIPPED_PACKS) -> tuple[list[Rule], list[tuple]]:
    """Rules of every ``*.yml``/``*.yaml`` in name order, and what could not be read.

    A pack that does not parse is skipped whole; the others still load.
    """
    rules, errors = [], []
    for path in sorted(Path(folder).iterdir(), key=lambda p: p.name):
        if path.suffix not in (".yml", ".yaml"):
            continue
        try:
            entries = _read_pack(path.read_text(encoding="utf-8"))
        except (OSError, ValueError) as error:
            errors.append((path.name, None, None, None, str(error)))
            continue
        for ordinal, entry in enumerate(entries, 1):
            text = {k: "" if entry.get(k) is None else str(entry.get(k)) for k in ("name", "regex", "confidence")}
            rules.append(Rule(path.name, ordinal, multiline=bool(entry.get("multiline", False)), **text))
    return rules, errors


def load_rules(spark: SparkSession, folder: str = SHIPPED_PACKS) -> DataFrame:
    return spark.createDataFrame([tuple(vars(r).values()) for r in read_packs(folder)[0]], RULE)


_CHECKED: dict[str, str | None] = {}


def regex_error(spark: SparkSession, regex: str) -> str | None:
    """Why Spark's regex engine rejects a rule, or None."""
    if regex not in _CHECKED:
        _CHECKED[regex] = _compile_error(spark, regex)
    return _CHECKED[regex]


def _compile_error(spark: SparkSession, regex: str) -> str | None:
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(DIALECT + regex)
    except Exception as error:
        cause = getattr(error, "java_exception", None)
        return (cause.getMessage() if cause is not None else str(error)).splitlines()[0]
    return None


def rule_errors(spark: SparkSession, folder: str = SHIPPED_PACKS) -> DataFrame:
    """Packs and rules that yield no findings, with the reason."""
    rules, errors = read_packs(folder)
    bad = [(r.pack, r.ordinal, r.name, r.regex, why) for r in rules if (why := regex_error(spark, r.regex))]
    return spark.createDataFrame(errors + bad, RULE_ERROR)


@dataclass(frozen=True)
class Matcher:
    """One distinct regex and the rules that share it, first rule first."""

    regex: str
    guard: Guard | None
    rules: tuple[Rule, ...]


def matchers(spark: SparkSession, rules: DataFrame | Iterable[Rule]) -> list[Matcher]:
    """Distinct valid regexes in rule order.

    Rules are configuration, so a table of them is read to the driver: the scan
    needs each regex as a literal to compile it once per task.
    """
    if isinstance(rules, DataFrame):
        rules = [Rule(**row.asDict()) for row in rules.select(*Rule.__dataclass_fields__).collect()]
    shared: dict[tuple[str, bool], list[Rule]] = {}
    for rule in sorted(rules, key=lambda r: (r.pack, r.ordinal)):
        shared.setdefault((rule.regex, rule.multiline), []).append(rule)
    return [
        Matcher(regex, required_literals(regex), tuple(group))
        for (regex, _), group in shared.items()
        if regex_error(spark, regex) is None
    ]
