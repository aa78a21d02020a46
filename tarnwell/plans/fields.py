"""Reading JSON objects by a table of their fields; all that is wrong with one is told at once."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

from tarnwell.errors import RuleError

MISSING = object()


@dataclass(frozen=True)
class Field:
    """A field: its name, what its value must be (in words, and as a function to the value or ``MISSING``) and its default."""

    name: str
    expected: str
    read: Callable[[Any], Any]
    default: Any = MISSING


def text(value: Any) -> Any:
    stripped = value.strip() if isinstance(value, str) else ""
    return stripped or MISSING


def lower_text(value: Any) -> Any:
    found = text(value)
    return found if found is MISSING else found.lower()


def count(value: Any) -> Any:
    return value if type(value) is int and value > 0 else MISSING


def share(value: Any) -> Any:
    return float(value) if isinstance(value, (int, float)) and 0 <= value <= 1 else MISSING


def flag(value: Any) -> Any:
    return value if isinstance(value, bool) else MISSING


def anything(value: Any) -> Any:
    return value


def optional(read: Callable[[Any], Any]) -> Callable[[Any], Any]:
    """A reader that lets null through."""
    return lambda value: None if value is None else read(value)


def read_object(node: Any, what: str, fields: Iterable[Field]) -> dict[str, Any]:
    """The values of an object's fields by name. Fields that it may not have, lacks or has wrong are refused together."""
    if not isinstance(node, dict):
        raise RuleError(f"{what}: not an object but {type(node).__name__}")
    known = {f.name: f for f in fields}
    problems = [f"there is no field {k!r}" for k in sorted(map(str, node.keys() - known.keys()))]
    out: dict[str, Any] = {}
    for name, field in known.items():
        if name in node:
            out[name] = field.read(node[name])
            if out[name] is MISSING:
                problems.append(f"{name!r} should be {field.expected} and is {node[name]!r}")
        elif field.default is MISSING:
            problems.append(f"{name!r} is required")
        else:
            out[name] = field.default
    if problems:
        raise RuleError(f"{what}: {'; '.join(problems)}")
    return out
