"""Catalog tools on the command line: python -m cubeloom COMMAND package.module:catalog [...]"""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from cubeloom.catalog import Catalog
from cubeloom.errors import EngineError
from cubeloom.query import from_dict
from cubeloom.tools import describe, diff, lint
from cubeloom.tools.validate import validate


def load(where: str) -> Catalog:
    module, _, name = where.partition(":")
    found = getattr(importlib.import_module(module), name or "catalog")
    return found if isinstance(found, Catalog) else found()


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="cubeloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("docs", "diagram", "fields", "prompt", "lint", "schema"):
        commands.add_parser(name).add_argument("catalog")
    check = commands.add_parser("validate")
    check.add_argument("catalog")
    check.add_argument("query", help="a query as JSON, or - for standard input")
    compare = commands.add_parser("diff")
    compare.add_argument("catalog")
    compare.add_argument("newer")
    found = parser.parse_args(args)
    try:
        catalog = load(found.catalog)
        if found.command == "lint":
            findings = lint.lint(catalog)
            print("\n".join(f"{f.rule} {f.where}: {f.message}" for f in findings))
            return int(bool(findings))
        if found.command == "validate":
            problems = validate(from_dict(json.loads(sys.stdin.read() if found.query == "-" else found.query)), catalog)
            print("\n".join(f"{p.where}: {p.code}: {p.message}" for p in problems))
            return int(bool(problems))
        if found.command == "diff":
            changes = diff.diff(catalog, load(found.newer))
            print("\n".join(f"{'breaking ' if c.breaking else ''}{c.kind} {c.where}" for c in changes))
            return int(any(c.breaking for c in changes))
        texts = {"docs": describe.markdown, "diagram": describe.dot, "fields": describe.field_module, "prompt": describe.prompt, "schema": lambda c: json.dumps(describe.query_schema(), indent=2)}
        print(texts[found.command](catalog))
        return 0
    except EngineError as e:
        print(json.dumps(e.to_payload(), default=str), file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
