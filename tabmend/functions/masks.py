"""The one predicate that decides which cells are anomalous, as SQL text."""

from __future__ import annotations

from tabmend.functions import fixed
from tabmend.functions.kinds import number


def outside(value: str, bounds: tuple | None) -> str | None:
    """Value below or above an inclusive domain; a missing end is open."""
    low, high = bounds or (None, None)
    parts = []
    if low is not None:
        parts.append(f"{value} < {number(low)}")
    if high is not None:
        parts.append(f"{value} > {number(high)}")
    return f"({' OR '.join(parts)})" if parts else None


def far(value: str, mean: float | None, std: float | None) -> str | None:
    """|z| strictly above the limit; undefined without spread."""
    if mean is None or not std or std <= 0:
        return None
    return f"(abs({value} - {number(mean)}) / {number(std)} > {number(fixed.Z_LIMIT)})"


def anomalous(
    value: str,
    bounds: tuple | None = None,
    mean: float | None = None,
    std: float | None = None,
) -> str:
    """Missing, outside the domain, or a z-outlier.  Never null: a missing cell
    is already true, a present one compares cleanly."""
    parts = [f"{value} IS NULL", outside(value, bounds), far(value, mean, std)]
    return f"({' OR '.join(p for p in parts if p)})"
