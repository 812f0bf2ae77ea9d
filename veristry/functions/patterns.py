"""Many regular expressions over one text: each needs some literal text, and all literals are looked for in one pass."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_automata: dict[tuple[str, ...], object] = {}


def required_literal(pattern: str) -> str | None:
    """The longest text that every match of ``pattern`` holds, if that can be told and has three characters at least.

    Only plain characters outside alternatives and optional parts count; a
    pattern with flags, or one that this language reads otherwise, gives None.
    """
    try:
        tree = re._parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return None
    if tree.state.flags & ~re.UNICODE or "\\Q" in pattern:
        return None
    runs, now = [], []

    def end() -> None:
        runs.append("".join(now))
        now.clear()

    def walk(items) -> None:
        for kind, value in items:
            kind = str(kind)
            if kind == "LITERAL":
                now.append(chr(value))
            elif kind == "SUBPATTERN" and not value[1] and not value[2]:
                walk(value[3])
            elif kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] >= 1:
                end()
                walk(value[2])
                end()
            else:
                end()
        return

    walk(tree)
    end()
    best = max(runs, key=len)
    return best if len(best) >= 3 else None


def _automaton(literals: tuple[str, ...]):
    if literals not in _automata:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for k, x in enumerate(literals):
            machine.add_word(x, k)
        machine.make_automaton()
        _automata[literals] = machine
    return _automata[literals]


def found_literals(text: Column, literals: list[str]) -> Column:
    """Array of the places in ``literals``, distinct texts, of those that ``text`` holds; empty for null.

    One Aho-Corasick pass over the text, whatever their number.
    """
    known = tuple(literals)

    @F.arrow_udf("array<int>")
    def find(texts: pa.Array) -> pa.Array:
        machine = _automaton(known)
        # one text at a time: a batch's as Python's strings take several times its bytes
        own = (t.as_py() for t in texts)
        return pa.array([[] if t is None else sorted({k for _, k in machine.iter(t)}) for t in own], pa.list_(pa.int32()))

    return find(text)


class Patterns:
    """Patterns by what they need: which of them can match a text follows from the literals found in it."""

    def __init__(self, patterns: list[str]):
        self.patterns, self.needs = patterns, [required_literal(p) for p in patterns]
        self.literals = sorted({x for x in self.needs if x})

    def found(self, text: Column) -> Column:
        """The literals found in a text, to be kept as a column for ``may_match``."""
        return found_literals(text, self.literals) if self.literals else F.array().cast("array<int>")

    def may_match(self, found: Column, k: int) -> Column:
        """Whether pattern k can match a text with these literals."""
        return F.lit(True) if self.needs[k] is None else F.array_contains(found, F.lit(self.literals.index(self.needs[k])))

    def any_may_match(self, found: Column) -> Column:
        return F.lit(True) if None in self.needs else F.size(found) > 0
