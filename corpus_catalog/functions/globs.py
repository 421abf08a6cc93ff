"""Ignore rules: glob patterns as anchored regexes, last matching rule wins.

Semantics kept on purpose, because they decide which rows survive:

* a rule ending in ``/`` is literal (no wildcards) and matches the path itself,
  everything below it, or any path component equal to it;
* a rule starting with ``/`` must match the whole path;
* any other rule may match the whole path or any suffix starting at a component;
* inside ``[...]`` there are no ranges and no negation: ``-``, ``!`` and ``^``
  are ordinary members.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, functions as F

from corpus_catalog.functions.text import normal_path

_SPECIAL = set(r"\.^$|?*+()[]{}-&~#/") - {"/"}


def _literal(text: str) -> str:
    return "".join("\\" + c if c in _SPECIAL else c for c in text)


def glob_regex(glob: str) -> str | None:
    """Body of the regex for a glob; None when a ``[`` is never closed."""
    out: list[str] = []
    members: list[str] | None = None  # of the bracket class being read
    pos = 0
    while pos < len(glob):
        step = 1
        if glob.startswith("**/", pos):
            step, inside, outside = 3, "(?:.*/)?", r"(?:[^\n]*/)?"
        elif glob.startswith("**", pos):
            step, inside, outside = 2, ".*", r"[^\n]*"
        elif glob[pos] == "\\" and pos + 1 < len(glob):
            step, inside = 2, glob[pos + 1]
            outside = _literal(inside)
        else:
            inside = glob[pos]
            outside = {"*": "[^/]*", "?": "[^/]"}.get(inside, _literal(inside))
        single = step == 1
        if members is None:
            if single and inside == "[":
                members = []
            else:
                out.append(outside)
        elif single and inside == "]" and members:
            out.append(f"[{''.join(members)}]")
            members = None
        elif single and inside in "*?":
            # A wildcard's own bracket expression ends the class it stands in.
            members += [_literal(c) for c in "[^/"]
            out.append(f"[{''.join(members)}]" + ("*" if inside == "*" else ""))
            members = None
        else:
            members += [_literal(c) for c in inside]
        pos += step
    return None if members is not None else "".join(out)


_ANYWHERE = r"(?s:.*/)?"  # the top or below any directory


@dataclass(frozen=True)
class Rule:
    ord: int
    negated: bool
    kind: str  # dir | anchored | any
    pattern: str
    floating: bool  # may match from any component on
    tail: str | None  # regex from there on; None: malformed, never matches

    @property
    def regex(self) -> str | None:
        return None if self.tail is None else alternation([self])


def alternation(rules: list[Rule]) -> str:
    """One anchored regex for any of the rules; the common start is tried once."""
    floating = "|".join(r.tail for r in rules if r.floating)
    fixed = [r.tail for r in rules if not r.floating]
    branches = ([f"{_ANYWHERE}(?:{floating})"] if floating else []) + fixed
    return rf"\A(?:{'|'.join(branches)})"


def compile_rule(line: str, ord: int = 0) -> Rule:
    negated = line.startswith("!")
    return compile_pattern(line[1:] if negated else line, negated, ord)


def compile_pattern(pattern: str, negated: bool = False, ord: int = 0) -> Rule:
    """Rule of a pattern without its negation mark."""
    if pattern.endswith("/"):
        name = pattern[:-1]
        tail = rf"{_literal(name)}(?:/|\z)"
        return Rule(ord, negated, "dir", pattern, "/" not in name, tail)
    anchored = pattern.startswith("/")
    body = glob_regex(pattern[1:] if anchored else pattern)
    # One newline may follow, as before `$`.
    tail = None if body is None else rf"{body}\n?\z"
    return Rule(ord, negated, "anchored" if anchored else "any", pattern, not anchored, tail)


def parse_rules(text: str, defaults: list[str] = ()) -> list[Rule]:
    """Default rules, then those of an ignore file: trimmed lines, no blanks or comments."""
    kept = (line.strip() for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"))
    return compile_rules([*defaults, *(line for line in kept if line and line[0] != "#")])


def compile_rules(lines: list[str]) -> list[Rule]:
    return [compile_rule(line, i) for i, line in enumerate(lines)]


def matches(path: Column, pattern: str) -> Column:
    """Does one rule, without negation, match the path?"""
    regex = compile_pattern(pattern).regex
    return F.lit(False) if regex is None else normal_path(path).rlike(regex)


def decision_runs(rules: list[Rule]) -> list[tuple[bool, str]]:
    """(negated, regex) pairs, last rule first; neighbours of one sign are merged."""
    usable = [r for r in reversed(rules) if r.tail is not None]
    return [(sign, alternation(list(run))) for sign, run in groupby(usable, lambda r: r.negated)]


def one_regex(rules: list[Rule], negated: bool) -> str:
    """One regex of all rules of a sign; empty if there are none."""
    chosen = [r for r in rules if r.tail is not None and r.negated == negated]
    return alternation(chosen) if chosen else ""


def is_ignored(path: Column, rules: list[Rule]) -> Column:
    """Last matching rule decides; rules are literals, so nothing is joined."""
    path = normal_path(path)
    decisions = [
        F.when(path.rlike(regex), F.lit(not negated)) for negated, regex in decision_runs(rules)
    ]
    return F.coalesce(*decisions, F.lit(False))


def is_ignored_by(path: Column, ignoring: Column, keeping: Column, runs: Column) -> Column:
    """As ``is_ignored`` with the rules of a row.

    ``ignoring`` and ``keeping`` match what some rule ignores or keeps; only
    paths that both match need the order of the rules.  ``regexp_instr`` keeps
    its last pattern compiled, which rows of one repo share; ``rlike`` would
    compile a pattern per row.
    """

    path = normal_path(path)

    def found(regex: Column) -> Column:
        return (regex != "") & (F.regexp_instr(path, regex) > 0)

    last = F.get(F.filter(runs, lambda run: F.regexp_instr(path, run["regex"]) > 0), F.lit(0))
    return found(ignoring) & (~found(keeping) | ~last["negated"])
