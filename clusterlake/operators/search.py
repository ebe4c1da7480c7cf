"""The search language of the result viewer: terms with a tag, AND, OR and brackets, to a filter."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TAGS = ("domain", "BGC", "organism", "family")


class SearchError(ValueError):
    """Brackets that don't match, or a term or operator missing."""


def parse(text: str) -> tuple:
    """("AND" or "OR", left, right) or ("term", words, tag or None). Operators have one precedence and group to the right."""
    parts = re.findall(r"[()]|[^\s()]+", text)
    at = 0

    def term() -> tuple:
        nonlocal at
        words = []
        while at < len(parts) and parts[at] not in ("(", ")", "AND", "OR"):
            words.append(parts[at])
            at += 1
        if not words:
            raise SearchError("a term is missing")
        m = re.fullmatch(r"(.*?)\[(\w+)\]", " ".join(words))
        if m and m[2] in TAGS:
            return "term", m[1].strip(), m[2]
        return "term", " ".join(words), None

    def expression() -> tuple:
        nonlocal at
        if at < len(parts) and parts[at] == "(":
            at += 1
            left = expression()
            if at >= len(parts) or parts[at] != ")":
                raise SearchError("a bracket isn't closed")
            at += 1
        else:
            left = term()
        if at < len(parts) and parts[at] in ("AND", "OR"):
            operator = parts[at]
            at += 1
            return operator, left, expression()
        return left

    tree = expression()
    if at < len(parts):
        raise SearchError(f"{parts[at]!r} is out of place")
    return tree


def condition(text: str, columns: dict[str, Column]) -> Column:
    """A filter of the expression; columns gives each tag's column, a string or an array of strings. Matches are substrings, in any case."""

    def matches(words: str, tag: str) -> Column:
        c = columns[tag]
        return F.coalesce(F.contains(F.lower(F.array_join(c, "\n") if tag == "domain" else c), F.lit(words.lower())), F.lit(False))

    def build(tree: tuple) -> Column:
        kind, left, right = tree
        if kind == "term":
            return reduce(Column.__or__, (matches(left, t) for t in ([right] if right else [t for t in TAGS if t in columns])))
        return build(left) & build(right) if kind == "AND" else build(left) | build(right)

    return build(parse(text))
