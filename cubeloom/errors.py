"""Every refusal is a typed error with a stable code and a JSON-ready payload."""

from __future__ import annotations

import difflib
from collections.abc import Iterable, Mapping
from typing import Any


class EngineError(Exception):
    """Base of all refusals. ``details`` holds what a program may want to read."""

    def __init__(self, message: str, **details: Any):
        super().__init__(message)
        self.details = details

    @property
    def code(self) -> str:
        return type(self).__name__

    def to_payload(self) -> dict[str, Any]:
        return {"code": self.code, "message": str(self), **self.details}

    @staticmethod
    def from_payload(payload: Mapping[str, Any]) -> EngineError:
        rest = {k: v for k, v in payload.items() if k not in ("code", "message")}
        for kind in _descendants(EngineError):
            if kind.__name__ == payload["code"]:
                return kind(payload["message"], **rest)
        raise ValueError(f"no error has the code {payload['code']!r}")


def _descendants(kind: type) -> Iterable[type]:
    yield kind
    for sub in kind.__subclasses__():
        yield from _descendants(sub)


class CatalogError(EngineError):
    """The catalog contradicts itself."""


class CompileError(EngineError):
    """The query cannot be answered as asked."""


class UnknownIdentifierError(CompileError):
    """A cube, field, view or segment that the catalog does not have; ``hint`` is the nearest name."""


class JoinPathError(CompileError):
    """No permitted path of joins leads from one cube to another."""


class FanOutError(CompileError):
    """A total would count rows more than once."""


class FilterTypeError(CompileError):
    """A filter value does not fit the field's type."""


class PlaceholderError(CompileError):
    """A ``{name}`` in catalog SQL that nothing defines, or an unsafe value for it."""


class CrossSourceError(CompileError):
    """Cubes of several sources in a query for one."""


class FederationError(CompileError):
    """A query over several sources that the chosen mode refuses; ``reason`` names why."""


class AuthError(EngineError):
    """The viewer may not see or do this."""


class MutationError(EngineError):
    """A write that the catalog does not allow."""


class SqlFrontError(EngineError):
    """SQL outside the narrow dialect."""


class UnparseError(EngineError):
    """A query that the narrow dialect cannot say."""


def nearest(name: str, names: Iterable[str]) -> str | None:
    """The most similar name, if one is similar enough to be meant."""
    found = difflib.get_close_matches(name, list(names), n=1, cutoff=0.6)
    return found[0] if found else None


def unknown(what: str, name: str, names: Iterable[str]) -> UnknownIdentifierError:
    names = sorted(names)
    hint = nearest(name, names)
    return UnknownIdentifierError(f"unknown {what} {name!r}" + (f"; did you mean {hint!r}?" if hint else f"; known: {names}"), name=name, hint=hint, known=names)
