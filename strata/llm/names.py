"""Names for helper columns beside the columns that a table brings along."""

from __future__ import annotations

from collections.abc import Iterable


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """``names``, each with as many underscores before it as it takes to differ from all ``columns`` (whatever the case)."""
    taken = {c.lower() for c in columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def aliases(columns: Iterable[str]) -> dict[str, str]:
    """A name for each of ``columns`` by which an operator knows it inside, so that none clashes with its own names."""
    return {c: f"in_{i}" for i, c in enumerate(columns)}
