"""Literals that every match of a rule must contain.

A rule's regex is far more expensive to run than a substring test, and almost
no line of a corpus matches any rule.  ``required_literals`` reads a regex and
returns groups of plain strings; a text that misses a whole group cannot match,
so the scan can skip the regex.  The guard only ever *over*-approximates: when
in doubt it returns no group, and the regex runs unguarded.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

try:
    from re import _constants as _c, _parser
except ImportError:  # the standard library's parser moved or went away
    _c = _parser = None

MAX_ALTERNATIVES = 16
_INLINE_FLAGS = re.compile(r"\(\?([a-zA-Z]*)(?:-([a-zA-Z]+))?\)")
# Constructs that Java and Python read differently; such rules stay unguarded.
_DIALECT_RISK = re.compile(r"\[\[|\[\^?\]|&&|\\[QEGpPXRhHvKkzZ]|\\x\{|\(\?[a-zA-Z]*[xX]|\(\?[a-zA-Z-]+:|\(\?<|\(\?>|[+*?}]\+")


@dataclass(frozen=True)
class Guard:
    """Every match contains at least one literal of *each* group."""

    groups: tuple[tuple[str, ...], ...]
    ignore_case: bool


def _minimal(words: frozenset[str]) -> tuple[str, ...]:
    """Drop words implied by a shorter word of the same set."""
    return tuple(sorted(w for w in words if not any(o != w and o in w for o in words)))


def _class_words(items) -> frozenset[str] | None:
    """The characters of a small bracket class, or None for a wide one."""
    words = set()
    for op, arg in items:
        if op is not _c.LITERAL:
            return None
        words.add(chr(arg))
    return frozenset(words) if len(words) <= 3 else None


def _walk(seq, found: list[frozenset[str]]) -> frozenset[str] | None:
    """Collect required groups of ``seq``; return its exact words if it has few."""
    run: frozenset[str] = frozenset([""])
    exact = True

    def close():
        nonlocal run
        if run and "" not in run:
            found.append(run)
        run = frozenset([""])

    for op, arg in seq:
        words = None
        if op is _c.LITERAL:
            words = frozenset([chr(arg)])
        elif op is _c.IN:
            words = _class_words(arg)
        elif op is _c.SUBPATTERN:
            inner: list[frozenset[str]] = []
            words = _walk(arg[3], inner)
            if words is None:
                found.extend(inner)
        elif op is _c.BRANCH:
            words = _branch(arg[1], found)
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT):
            low, _, body = arg
            if low >= 1:
                inner = []
                single = _walk(body, inner)
                if single is not None:
                    inner.append(single)
                found.extend(g for g in inner if "" not in g)
        elif op is _c.AT:
            continue
        product = frozenset(a + b for a in run for b in words) if words else None
        if product is not None and len(product) <= MAX_ALTERNATIVES:
            run = product
        else:
            exact = False
            close()
            if words and len(words) <= MAX_ALTERNATIVES:
                run = words
    if exact:
        return run
    close()
    return None


def _branch(options, found: list[frozenset[str]]) -> frozenset[str] | None:
    """Words of an alternation: exact if all are; else the union of each one's best group."""
    exact: set[str] | None = set()
    best: set[str] | None = set()
    for option in options:
        inner: list[frozenset[str]] = []
        words = _walk(option, inner)
        if words is not None:
            exact = exact | words if exact is not None else None
            inner.append(words)
        else:
            exact = None
        inner = [g for g in inner if "" not in g]
        best = best | max(inner, key=_strength) if inner and best is not None else None
    if exact is not None:
        return frozenset(exact)
    if best:
        found.append(frozenset(best))
    return None


def _strength(group: frozenset[str]) -> tuple[int, int]:
    return (min(len(w) for w in group), -len(group))


def required_literals(regex: str) -> Guard | None:
    if _parser is None or _DIALECT_RISK.search(regex):
        return None
    ignore_case = any("i" in m.group(1) for m in _INLINE_FLAGS.finditer(regex))
    try:
        tree = _parser.parse(_INLINE_FLAGS.sub("", regex))
    except Exception:  # not valid for this parser: run the rule unguarded
        return None
    found: list[frozenset[str]] = []
    whole = _walk(tree, found)
    if whole is not None and "" not in whole:
        found.append(whole)
    # Case pairs such as [aA] multiply words; folding them needs a lower-cased text.
    paired = any(
        op is _c.IN and (cls := _class_words(arg)) and len({w.lower() for w in cls}) < len(cls)
        for op, arg in _flatten(tree)
    )
    ignore_case = ignore_case or paired
    if paired:
        found = []
        _walk(_fold_pairs(tree), found)
    if ignore_case:
        found = [frozenset(w.lower() for w in g) for g in found]
    groups = [_minimal(g) for g in found if all(w.isascii() for w in g)]
    groups = sorted(set(g for g in groups if g), key=lambda g: _strength(frozenset(g)), reverse=True)
    return Guard(tuple(groups[:2]), ignore_case) if groups else None


def _flatten(seq):
    for op, arg in seq:
        yield op, arg
        if op is _c.SUBPATTERN:
            yield from _flatten(arg[3])
        elif op is _c.BRANCH:
            for option in arg[1]:
                yield from _flatten(option)
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT):
            yield from _flatten(arg[2])


def _fold_pairs(seq):
    """The top-level sequence with [aA] classes written as the letter a."""
    out = []
    for op, arg in seq:
        cls = _class_words(arg) if op is _c.IN else None
        if cls and len({w.lower() for w in cls}) == 1:
            out.append((_c.LITERAL, ord(min(w.lower() for w in cls))))
        else:
            out.append((op, arg))
    return out
