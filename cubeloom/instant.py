"""Instants: ISO-8601 texts compared as points in time; a text without zone is UTC."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta


def parse_instant(text: str) -> datetime:
    at = datetime.fromisoformat(text)
    return at.replace(tzinfo=UTC) if at.tzinfo is None else at.astimezone(UTC)


def naive(text: str) -> datetime:
    """The instant as a UTC clock time without zone."""
    return parse_instant(text).replace(tzinfo=None)


def previous_range(start: str, end: str) -> tuple[str, str]:
    """The range of the same length that ends where this one starts."""
    a, b = parse_instant(start), parse_instant(end)
    whole_days = "T" not in start and " " not in start and "T" not in end and " " not in end
    before: datetime = a - timedelta(seconds=(b - a).total_seconds())
    return (before.date().isoformat() if whole_days else before.replace(tzinfo=None).isoformat(), start)
