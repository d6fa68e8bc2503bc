"""Amounts with a unit: [5, "minutes"] is 300000 milliseconds, [3, "elements"] is 3 of any integer domain."""

from __future__ import annotations

_MS = {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}


def standard(amount) -> tuple[int, str]:
    """(number, "ms" or "elements") of a pair of number and unit; singular and plural are the same."""
    n, unit = amount
    name = str(unit).rstrip("s")
    if name == "element":
        return int(n), "elements"
    if name not in _MS:
        raise ValueError(f"unknown unit {unit!r}")
    return int(n * _MS[name]), "ms"
