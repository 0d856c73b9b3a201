"""Column names that nothing in a table has yet."""

from __future__ import annotations

from collections.abc import Iterable


def unused(taken: Iterable[str], *wanted: str) -> list[str]:
    """wanted names, with underscores added to those that are taken (names are equal whatever their case)."""
    seen, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in seen:
            name += "_"
        seen.add(name.lower())
        out.append(name)
    return out
