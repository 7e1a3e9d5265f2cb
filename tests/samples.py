"""Strings that match a given regex, built from its parse tree."""

import re
import string
from re import _constants as c
from re import _parser

PRINTABLE = string.ascii_letters + string.digits + "-_/+=.!{}~:@\"' "


def _allowed(items, pick):
    chosen, negated = set(), False
    for op, arg in items:
        if op is c.NEGATE:
            negated = True
        elif op is c.LITERAL:
            chosen.add(chr(arg))
        elif op is c.RANGE:
            chosen.update(chr(i) for i in range(arg[0], arg[1] + 1))
        elif op is c.CATEGORY:
            word = {c.CATEGORY_WORD: string.ascii_letters + string.digits + "_", c.CATEGORY_SPACE: " \t"}
            chosen.update(word[arg])
    pool = [x for x in PRINTABLE if x not in chosen] if negated else sorted(chosen)
    return pick(pool)


def matching(regex: str, rng) -> str:
    """One random match, with repeats near their minimum."""

    def build(seq):
        out = []
        for op, arg in seq:
            if op is c.LITERAL:
                out.append(chr(arg))
            elif op is c.ANY:
                out.append(rng.choice("xY7 -"))
            elif op is c.IN:
                out.append(_allowed(arg, rng.choice))
            elif op is c.BRANCH:
                out.append(build(rng.choice(arg[1])))
            elif op is c.SUBPATTERN:
                out.append(build(arg[3]))
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
                low, high, body = arg
                out.append("".join(build(body) for _ in range(rng.randint(low, min(int(high), low + 2)))))
            else:
                raise NotImplementedError(op)
        return "".join(out)

    return build(_parser.parse(re.sub(r"\(\?-?i\)", "", regex)))
