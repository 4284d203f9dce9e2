"""Compiles pattern lists into unrolled literal predicates.

A literal pattern compiles once per task, while a pattern column would compile again and again. Where a regex
needs a literal run of characters, a substring test on that run goes first: it is far cheaper and mostly fails.
"""

from __future__ import annotations

import re._constants as ops
import re._parser as parser
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Columns in one array expression; more would make methods too large to compile.
WIDTH = 40


def required_literal(pattern: str) -> str:
    """Longest run of characters that every match must hold; empty if there is none."""
    try:
        tree = parser.parse(pattern)
    except Exception:
        return ""
    best = run = ""
    if tree.state.flags & 2:  # letter case is ignored
        return ""
    for op, arg in tree:
        run = run + chr(arg) if op is ops.LITERAL else ""
        best = max(best, run, key=len)
    return best


def java(pattern: str) -> str:
    """Unicode classes where the pattern uses any."""
    return ("(?U)" if any(x in pattern for x in (r"\w", r"\s", r"\b", r"\d")) else "") + pattern


def matches(text: Column, pattern: str, flags: str = "") -> Column:
    hit = text.rlike(f"(?{flags})" + java(pattern) if flags else java(pattern))
    need = "" if "i" in flags else required_literal(pattern)
    return text.contains(need) & hit if len(need) > 1 else hit


def any_of(hits: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, hits, F.lit(False))


def any_match(text: Column, patterns: Iterable[str], flags: str = "") -> Column:
    return any_of(matches(text, p, flags) for p in patterns)


def any_contained(text: Column, words: Iterable[str]) -> Column:
    return any_of(text.contains(w) for w in words)


def first_contained(text: Column, words: list[str]) -> Column:
    """The first word of the list that the text contains."""
    return F.coalesce(*(F.when(text.contains(w), F.lit(w)) for w in words))


def listed(items: list[Column], kind: str) -> Column:
    """Array of the items that aren't null, built in pieces of bounded width."""
    pieces = [F.array_compact(F.array(*items[i : i + WIDTH])) for i in range(0, len(items), WIDTH)]
    return F.concat(*pieces) if pieces else F.array().cast(kind)


def keyword(text: Column, word: str) -> Column:
    """A whole word, with a cheap test first."""
    return text.contains(word) & text.rlike(r"(?U)\b" + _quoted(word) + r"\b")


def _quoted(word: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in word)


def lookup(table: dict, key: Column, default=None) -> Column:
    """Value of a small literal table."""
    x = F.lit(default)
    for k, v in reversed(list(table.items())):
        x = F.when(key == k, F.lit(v)).otherwise(x)
    return x


def ranked(order: list[str], key: Column) -> Column:
    """Place in an order, from 0; 0 if it isn't there."""
    return lookup({k: i for i, k in enumerate(order)}, key, 0)


def strings(values: Iterable[str]) -> Column:
    values = list(values)
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")
