"""The one large object that a Python worker keeps between tasks."""

from __future__ import annotations

from collections.abc import Callable, Hashable

_kept: dict[Hashable, object] = {}


def held(key: Hashable, make: Callable[[], object]) -> object:
    """What make gives, made once for a key; whatever else was kept goes first, so that workers, which outlive stages,
    never hold the models of two."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def let_go() -> None:
    """Drop what an earlier stage left in this worker."""
    _kept.clear()
