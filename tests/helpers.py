"""Brute-force counterparts and small conveniences."""

from __future__ import annotations


def rows(frame) -> list[tuple]:
    return [tuple(row) for row in frame.collect()]


def column(frame, name: str) -> list:
    return [row[name] for row in frame.collect()]


def nearest_rank(values: list, p: float):
    """Smallest value whose share of rows at or below it reaches ``p``; None sorts first."""
    present = sorted(v for v in values if v is not None)
    missing = len(values) - len(present)
    for at, value in enumerate(present, start=1):
        tied = at < len(present) and present[at] == value
        if not tied and (missing + at) / len(values) >= p:
            return value
    return None
