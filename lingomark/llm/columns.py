"""Names for working columns that a caller's table does not use."""

from __future__ import annotations

from collections.abc import Iterable


def spare(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores behind it as make it differ from those taken."""
    known, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in known:
            name += "_"
        known.add(name.lower())
        out.append(name)
    return out
