"""The regex join of lines and rules: one pass over the text for all rules.

Three steps, each far rarer than the one before:

1. per file, which probes (short literals) occur at all: one bit per probe;
2. per line of the files with any probe, and only for the rules whose probes the
   file has: does the line contain the rule's own literals;
3. for what is left, the regex.

Nothing is shuffled.  The text leaves the plan as soon as it is split, and a
matching line is the only thing that gets past step 3.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysift.functions.text import extract_secret, trim_space
from keysift.model import require
from keysift.sources.rules import DIALECT, DIALECT_MULTILINE, Matcher, Rule, matchers

WORD = 62  # bits used per mask column
GROUP = 8  # rules behind one test of their probes
BLOCK = 512  # matches folded at a time
PASS = 310  # distinct rules tested in one pass
LINE_PASS = 48  # the same for single lines, whose probes are part of the generated code


def sql_string(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _union(terms: list[str]) -> str:
    """Bitwise or, pairwise, which keeps the expression shallow."""
    while len(terms) > 1:
        terms = [f"({' | '.join(terms[i : i + 2])})" for i in range(0, len(terms), 2)]
    return terms[0]


def _flag(test: str, position: int) -> str:
    return f"if({test}, {1 << (position % WORD)}L, 0L)"


def _bits(tests: list[str]) -> list[str]:
    """Pack conditions into as few longs as they need."""
    flags = [_flag(test, i) for i, test in enumerate(tests)]
    return [_union(flags[start : start + WORD]) for start in range(0, len(flags), WORD)]


def _bit(name: str, positions: Iterable[int]) -> str:
    """Whether any of these bits is set."""
    masks: dict[int, int] = {}
    for p in positions:
        masks[p // WORD] = masks.get(p // WORD, 0) | 1 << (p % WORD)
    return f"({' or '.join(f'({name}{word} & {mask}L) != 0' for word, mask in sorted(masks.items()))})"


def _grouped_bits(tests: list[str], needs: list[set[int]], weight: list[int]) -> list[str]:
    """As :func:`_bits`, for rules of which a file enables few.

    Rules are tested in groups behind one test of all their probes.  Rules with
    long, rare probes share groups, so most lines skip them eight at a time.
    Rules without probes are always tested.
    """
    words = []
    for start in range(0, len(tests), WORD):
        here = range(start, min(start + WORD, len(tests)))
        terms = [_flag(tests[r], r) for r in here if not needs[r]]
        rules = sorted((r for r in here if needs[r]), key=lambda r: (-weight[r], min(needs[r])))
        for at in range(0, len(rules), GROUP):
            group = rules[at : at + GROUP]
            enabled = _bit("probe", set().union(*(needs[r] for r in group)))
            terms.append(f"if({enabled}, {_union([_flag(tests[r], r) for r in group])}, 0L)")
        words.append(_union(terms))
    return words


Word = tuple[str, bool]  # a literal, and whether case is ignored


def plan_probes(found: list[Matcher]) -> tuple[list[Word], dict[Word, int]]:
    """Few literals that stand for all guard words, and the probe of each word.

    A word that contains another one needs no probe of its own; words that start
    alike share their common start.
    """
    wanted: list[Word] = []
    for matcher in found:
        if matcher.guard is not None:
            wanted += [(word, matcher.guard.ignore_case) for word in probe_group(matcher)]
    wanted = list(dict.fromkeys(wanted))

    heads: dict[Word, list[str]] = {}
    for word, fold in wanted:
        if len(word) > 3:
            heads.setdefault((word[:3], fold), []).append(word)
    start: dict[Word, Word] = {}
    for (_, fold), group in heads.items():
        common = group[0]
        for word in group[1:]:
            while not word.startswith(common):
                common = common[:-1]
        start.update({(word, fold): (common, fold) for word in group})
    candidates = list(dict.fromkeys(start.get(w, w) for w in wanted))

    probes: list[Word] = []
    probe_of: dict[Word, int] = {}
    for word in wanted:
        text, fold = start.get(word, word)
        # The shortest candidate that every text with the word also contains.
        inside = [(w, f) for w, f in candidates if (w in text.lower() if f else not fold and w in text)]
        probe = min(inside, key=lambda p: (len(p[0]), p))
        if probe not in probes:
            probes.append(probe)
        probe_of[word] = probes.index(probe)
    return probes, probe_of


def probe_group(matcher: Matcher) -> tuple[str, ...]:
    """The guard group to look for in whole files: few and long words."""
    return min(matcher.guard.groups, key=lambda g: (min(map(len, g)) < 2, len(g) - min(map(len, g))))


def folded(text: str) -> str:
    """Lower case, with the long s that matches ``s`` when case is ignored."""
    return f"replace(lower({text}), 'ſ', 's')"


def _subject(text: str, matcher: Matcher) -> str:
    """What the regex sees.

    Java folds the dotless and the dotted Turkish i to ``i``; simple Unicode case
    folding does not.  They are masked for rules that ignore case.
    """
    flags = "".join(re.findall(r"\(\?([a-zA-Z]+)", matcher.regex))
    if "i" not in flags or set("ıİ") & set(matcher.regex):
        return text
    return f"if(contains({text}, 'ı') or contains({text}, 'İ'), translate({text}, 'ıİ', '¤¤'), {text})"


def _has_any(text: str, words: Iterable[str]) -> str:
    return f"({' or '.join(f'contains({text}, {sql_string(w)})' for w in words)})"


def _probe_columns(found: list[Matcher], column: str) -> tuple[list[str], list[str]]:
    """Columns that hold one bit per probe, and their names."""
    probes, _ = plan_probes(found)
    flags = [f"contains({folded(column) if fold else column}, {sql_string(word)})" for word, fold in probes]
    names = [f"probe{i}" for i in range(-(-len(flags) // WORD))]
    return [f"{bits} as {name}" for bits, name in zip(_bits(flags), names)], names


def _file_lines(files: DataFrame, found: list[Matcher]) -> tuple[DataFrame, list[str]]:
    """Lines of the files that can match at all, with the probes of their file."""
    columns, words = _probe_columns(found, "text")
    files = files.selectExpr("app_key", "file_path", "text", *columns)
    pieces = r"split(text, '\\n', -1)"
    if all(m.guard for m in found):  # an unguarded rule has to see every line
        pieces = f"if({' or '.join(f'{w} != 0' for w in words)}, {pieces}, null)"
    split = files.selectExpr("app_key", "file_path", *words, f"{pieces} as pieces", f"size({pieces}) as n")
    # The coalesce keeps the generator's input an expression, for which no filter is
    # inferred: such a filter would split every text twice.
    each = split.selectExpr(
        "app_key", "file_path", "n", *words, "posexplode(coalesce(pieces, cast(array() as array<string>))) as (pos, line)"
    )
    return each.selectExpr(
        "app_key", "file_path as FileLocation", "pos + 1 as LineNo", "pos + 1 < n as ended", "line", *words
    ), words


def _test_lines(each: DataFrame, words: list[str], found: list[Matcher], first_rule_only: bool) -> DataFrame:
    """Matching rules of ``(app_key, FileLocation, LineNo, ended, line)`` with probe columns.

    Written as SQL text: the conditions of a hundred rules are one parse this way.
    """
    probes, probe_of = plan_probes(found)
    each = each.selectExpr(
        "app_key", "FileLocation", "LineNo", "ended", "line", f"{folded('line')} as low", *words
    )
    flags = []
    for matcher in found:
        tests = []
        if matcher.guard is None:  # a text that ends in \n has no further line after it
            tests.append("(ended or line != '')")
        else:
            fold = matcher.guard.ignore_case
            first = probe_group(matcher)
            # A line is searched only for the words whose probe its file has.
            for group in sorted(matcher.guard.groups, key=lambda g: g is not first):
                present = [
                    f"{_bit('probe', [probe_of[word, fold]])} and " if group is first else "" for word in group
                ]
                has = [f"contains({'low' if fold else 'line'}, {sql_string(word)})" for word in group]
                tests.append(f"({' or '.join(p + h for p, h in zip(present, has))})")
        subject = _subject("line", matcher)
        tests.append(rf"if(ended, concat({subject}, '\n'), {subject}) rlike {sql_string(DIALECT + matcher.regex)}")
        flags.append(" and ".join(tests))
    needs = [
        {probe_of[word, m.guard.ignore_case] for word in probe_group(m)} if m.guard else set() for m in found
    ]
    rarity = [min((len(probes[i][0]) for i in need), default=0) for need in needs]
    columns = _grouped_bits(flags, needs, rarity)
    names = [f"hit{i}" for i in range(len(columns))]
    hits = each.selectExpr("app_key", "FileLocation", "LineNo", "line", *(f"{c} as {n}" for c, n in zip(columns, names)))

    # Bits follow rule order, so without fan-out the first match is the first rule.
    rules = ", ".join(
        f"named_struct('word', {i // WORD}, 'bit', {1 << (i % WORD)}L, 'pack', {sql_string(rule.pack)}, "
        f"'ordinal', {rule.ordinal}, 'Type', {sql_string(rule.name)})"
        for i, matcher in enumerate(found)
        for rule in (matcher.rules[:1] if first_rule_only else matcher.rules)
    )
    word = f"case r.word {' '.join(f'when {i} then {n}' for i, n in enumerate(names))} end"
    matched = f"filter(array({rules}), r -> ({word} & r.bit) != 0)"
    if first_rule_only:
        matched = f"slice({matched}, 1, 1)"
    return hits.selectExpr(
        "app_key", "FileLocation", "LineNo", "line",
        f"explode(if({' or '.join(f'{n} != 0' for n in names)}, {matched}, null)) as rule",
    ).select("app_key", "FileLocation", "LineNo", "line", "rule.pack", "rule.ordinal", "rule.Type")


def _span_hits(files: DataFrame, found: list[Matcher], first_rule_only: bool) -> DataFrame:
    """Rules whose matches may span lines: every line a match touches is one hit.

    Splitting a text at its matches gives the stretches between them; counting
    line ends over stretches and matches gives the lines of each match.
    """

    def newlines(s: Column) -> Column:
        return F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))

    def touched(matcher: Matcher) -> Column:
        pattern = DIALECT_MULTILINE + matcher.regex
        text = F.expr(_subject("text", matcher))
        gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        # There is a stretch more than matches, but for an empty match at the very start: split skips it.
        gaps = F.when(F.size(gaps) == F.size(hits), F.concat(F.array(F.lit("")), gaps)).otherwise(gaps)
        pairs = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"))
        # Line ends in the stretch, in the match, and in the match without a final \n:
        # a match that ends with \n does not touch the next line.  Null for no match.
        steps = F.transform(
            pairs,
            lambda p: F.struct(
                newlines(p["gap"]).alias("gap"),
                F.coalesce(newlines(p["hit"]), F.lit(0)).alias("hit"),
                F.when(p["hit"] != "", newlines(F.regexp_replace(p["hit"], r"\n$", ""))).alias("inner"),
            ),
        )
        # Appending to an array copies it, so long lists are folded block by block.
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")),
            lambda b: F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)),
        )
        heights = F.transform(
            blocks, lambda block: F.aggregate(block, F.lit(0), lambda at, s: at + s["gap"] + s["hit"])
        )
        none = F.array().cast("array<int>")
        starts = F.aggregate(
            heights,
            F.struct(F.lit(1).alias("at"), none.alias("all")),
            lambda acc, h: F.struct((acc["at"] + h).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")),
            lambda acc: acc["all"],
        )

        def step(acc: Column, s: Column) -> Column:
            first = acc["at"] + s["gap"]
            lines = F.when(s["inner"].isNull(), acc["lines"]).otherwise(
                F.concat(acc["lines"], F.sequence(first, first + s["inner"]))
            )
            return F.struct((first + s["hit"]).alias("at"), lines.alias("lines"))

        spans = F.transform(
            F.arrays_zip(blocks.alias("block"), starts.alias("at")),
            lambda b: F.aggregate(
                b["block"], F.struct(b["at"].alias("at"), none.alias("lines")), step, lambda acc: acc["lines"]
            ),
        )
        return F.when(F.rlike(text, F.lit(pattern)), F.array_distinct(F.flatten(spans)))

    parts = []
    for matcher in found:
        rules = F.array(
            *(
                F.struct(F.lit(r.pack).alias("pack"), F.lit(r.ordinal).alias("ordinal"), F.lit(r.name).alias("Type"))
                for r in (matcher.rules[:1] if first_rule_only else matcher.rules)
            )
        )
        guarded = touched(matcher)
        if matcher.guard is not None:
            text = folded("text") if matcher.guard.ignore_case else "text"
            guarded = F.when(F.expr(_has_any(text, matcher.guard.groups[0])), guarded)
        parts.append(F.struct(guarded.alias("lines"), rules.alias("rules")))
    matched = files.select(
        "app_key", "file_path", "text", F.explode(F.filter(F.array(*parts), lambda p: p["lines"].isNotNull())).alias("m")
    )
    # Only files with a match get here; each is split once per matching rule.
    split = matched.select("app_key", "file_path", "m", F.split("text", "\n", -1).alias("pieces"))
    numbered = F.transform(
        F.col("m.lines"), lambda n: F.struct(n.alias("n"), F.get(F.col("pieces"), n - 1).alias("line"))
    )
    each = split.select("app_key", "file_path", F.explode(numbered).alias("at"), F.col("m.rules").alias("rules"))
    return each.select("app_key", "file_path", "at", F.explode("rules").alias("rule")).select(
        "app_key",
        F.col("file_path").alias("FileLocation"),
        F.col("at.n").alias("LineNo"),
        F.col("at.line").alias("line"),
        *(F.col(f"rule.{f}") for f in ("pack", "ordinal", "Type")),
    )


def _chunks(found: list[Matcher], size: int = PASS) -> list[list[Matcher]]:
    """Rules per pass; generated code grows with the rules it tests."""
    return [found[i : i + size] for i in range(0, len(found), size)]


def rule_hits(
    files: DataFrame, rules: DataFrame | Iterable[Rule], *, first_rule_only: bool = False
) -> DataFrame:
    """Which rule matches which line: ``(app_key, FileLocation, LineNo, line, pack, ordinal, Type)``."""
    require(files, "app_key", "file_path", "text")
    found = matchers(files.sparkSession, rules)
    single = [m for m in found if not m.rules[0].multiline]
    spanning = [m for m in found if m.rules[0].multiline]
    parts = []
    for chunk in _chunks(single):
        parts.append(_test_lines(*_file_lines(files, chunk), chunk, first_rule_only))
    if spanning:
        parts.append(_span_hits(files, spanning, first_rule_only))
    if not parts:
        raise ValueError("no valid rule to scan with")
    return reduce(DataFrame.unionByName, parts)


def regex_join(lines: DataFrame, rules: DataFrame | Iterable[Rule]) -> DataFrame:
    """Join ``lines(app_key, file_path, line_no, line)`` with the rules that match them.

    For text that is already in lines, such as ingested search output.  Lines
    without a column ``ended`` count as followed by ``\\n``.  No pair of line and rule
    is built: the rules are conditions, as in :func:`rule_hits`.  Rules over several lines
    need whole files and are refused.
    """
    require(lines, "app_key", "file_path", "line_no", "line")
    found = matchers(lines.sparkSession, rules)
    spanning = [r.name for m in found for r in m.rules if r.multiline]
    if spanning:
        raise ValueError(f"rules over several lines cannot be joined with single lines: {', '.join(spanning)}")
    ended = "ended" if "ended" in lines.columns else "true as ended"
    parts = []
    for chunk in _chunks(found, LINE_PASS):
        columns, words = _probe_columns(chunk, "line")
        each = lines.selectExpr(
            "app_key", "file_path as FileLocation", "line_no as LineNo", ended, "line", *columns
        )
        parts.append(_test_lines(each, words, chunk, False))
    if not parts:
        raise ValueError("no valid rule to join with")
    return reduce(DataFrame.unionByName, parts)


def scan(files: DataFrame, rules: DataFrame | Iterable[Rule], *, first_rule_only: bool = False) -> DataFrame:
    """Findings of ``files(app_key, file_path, text)``, one per matching rule and line.

    ``first_rule_only`` keeps the first matching rule of each line (and pass, with
    more than ``PASS`` distinct rules).  All rules that match a line extract the
    same secret from it, so nothing else can survive :func:`keysift.operators.dedupe.distinct_secrets`.
    """
    hits = rule_hits(files, rules, first_rule_only=first_rule_only)
    return hits.select(
        "app_key",
        "pack",
        "ordinal",
        "Type",
        "LineNo",
        "FileLocation",
        F.col("Type").alias("SecretType"),
        extract_secret(trim_space(F.col("line"))).alias("SecretString"),
    )
