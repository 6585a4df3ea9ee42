"""Names of helper columns that no column of the caller has."""

from __future__ import annotations

from collections.abc import Iterable


def fresh(columns: Iterable[str], name: str) -> str:
    """``name``, with as many underscores before it as it takes; letters of either case are one name."""
    taken = {c.casefold() for c in columns}
    while name.casefold() in taken:
        name = "_" + name
    return name
