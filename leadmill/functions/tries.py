"""Many words looked for in one pass: a pattern in the shape of a trie, and what a match stands for.

A pattern finds, at every place of a text, the longest word that begins there. A word is in the text exactly if
one of the found words begins with it, so nothing is lost by taking the longest. Built-in functions only.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Children of a place that are tried one after the other; more are halved by ranges of characters first.
WIDE = 4
#: Levels of groups in a pattern; the reader of patterns calls itself once a level.
DEEP = 120


class TooDeep(ValueError):
    """Words that begin with each other too often for a pattern."""


def _char(c: str) -> str:
    return c if c.isalnum() else f"\\x{{{ord(c):x}}}"


def _grown(words: Iterable[str]) -> dict:
    root: dict = {}
    for word in words:
        here = root
        for c in word:
            here = here.setdefault(c, {})
        here[""] = {}
    return root


def _shape(node: dict, level: int) -> str:
    """The pattern of what may follow a place: runs of single children are plain text, the rest are groups."""
    run = ""
    while len(node) == 1 and "" not in node:
        ((c, node),) = node.items()
        run += _char(c)
    children = sorted(c for c in node if c)
    if not children:
        return run
    if level > DEEP:
        raise TooDeep(f"more than {DEEP} levels")

    def choice(of: Sequence[str], level: int) -> str:
        if len(of) <= WIDE:
            return "|".join(_char(c) + _shape(node[c], level + 1) for c in of)
        half = len(of) // 2
        sides = (of[:half], of[half:])
        return "|".join(f"(?=[{_char(s[0])}-{_char(s[-1])}])(?:{choice(s, level + 1)})" for s in sides)

    return f"{run}(?:{choice(children, level)}){'?' if '' in node else ''}"


def pattern(words: Iterable[str]) -> str | None:
    """The pattern of the longest word at a place; None without words. Empty words are none.

    A place is tested against a number of characters that grows with the logarithm of the words that could begin there.
    Raises TooDeep where words nest in each other so far that a pattern could exhaust the stack.
    """
    root = _grown({w for w in words if w})
    return _shape(root, 0) if root else None


def found(text: Column, words: Iterable[str]) -> Column:
    """The distinct longest words at the places of a text, overlapping ones too; an empty array for a null text."""
    shape = pattern(words)
    none = F.array().cast("array<string>")
    if shape is None:
        return none
    return F.coalesce(F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=({shape}))"), F.lit(1))), none)


def extensions(words: Iterable[str], of: Iterable[str]) -> dict[str, list[str]]:
    """For each word of ``of``: the words that begin with it, itself included if it is one. Empty words have none."""
    ordered = sorted({w for w in words if w})
    out = {}
    for w in of:
        at = bisect_left(ordered, w)
        end = at
        while w and end < len(ordered) and ordered[end].startswith(w):
            end += 1
        out[w] = ordered[at:end]
    return out

