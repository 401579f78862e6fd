"""Column names that no column of a table has."""

from __future__ import annotations

from collections.abc import Iterable


def unused(taken: Iterable[str], *wanted: str) -> list[str]:
    """``wanted`` with as many underscores before each as it takes that none is in ``taken``, whatever the case."""
    low = {c.lower() for c in taken}
    while any(w.lower() in low for w in wanted):
        wanted = tuple("_" + w for w in wanted)
    return list(wanted)
