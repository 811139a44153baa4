"""Column names that the caller's columns can't clash with."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def free(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with underscores added until no column has it; Spark ignores case in names."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    """A column name as it stands in SQL, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """The column of exactly that name."""
    return F.col(quoted(name))
