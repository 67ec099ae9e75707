"""Case-insensitive rule patterns as cheap string tests.

A rule is written as a regular expression. Most rules are plain words, some anchored; for those a
byte search in the folded text gives the same answer at a fraction of the cost of a regex. Only
what is left of a rule after its leading word is tried as a regex, on rows that contain the word.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

KELVIN = "K"
SPECIAL = re.compile(r"[.^$*+?()\[\]{}|\\]")


def fold(text: Column) -> Column:
    """Lower case for matching. The Kelvin sign is the one letter that would fold into ASCII."""
    return F.lower(F.replace(text, F.lit(KELVIN), F.lit("�")))


def _literal_head(pattern: str) -> tuple[str, str]:
    """Splits a pattern into its leading plain text and the remainder."""
    head, i = "", 0
    while i < len(pattern):
        if pattern[i] == "\\" and i + 1 < len(pattern) and not pattern[i + 1].isalnum():
            head, i = head + pattern[i + 1], i + 2
        elif SPECIAL.match(pattern[i]):
            break
        else:
            head, i = head + pattern[i], i + 1
    rest = pattern[i:]
    if rest[:1] in ("?", "*", "{"):
        head = head[:-1]
    return head.lower(), rest


def _alternative(pattern: str) -> bool:
    depth, i, in_class = 0, 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and depth == 0:
            return True
        i += 1
    return False


def matches(folded: Column, pattern: str) -> Column:
    """Whether a folded text contains a match of the pattern, which must not be an alternative at top level."""
    if _alternative(pattern):
        raise ValueError(f"state the branches of {pattern!r} as patterns of their own")
    anchored = pattern.startswith("^")
    head, rest = _literal_head(pattern.removeprefix("^"))
    found = folded.startswith(head) if anchored else folded.contains(head)
    if rest == "":
        return found
    if rest == r"\z" and not anchored:
        return folded.endswith(head)
    full = folded.rlike("(?i)" + pattern)
    return found & full if head else full


def matches_any(folded: Column, patterns) -> Column:
    return reduce(lambda a, b: a | b, [matches(folded, p) for p in patterns])


def first_match(folded: Column, named) -> Column:
    """Name of the first (name, pattern) pair that matches, NULL when none does."""
    pairs = list(named)
    result = F.when(matches(folded, pairs[0][1]), pairs[0][0])
    for name, pattern in pairs[1:]:
        result = result.when(matches(folded, pattern), name)
    return result
