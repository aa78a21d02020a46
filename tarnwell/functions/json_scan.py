"""Strictly valid JSON objects found in any text, in time that grows with its length, however deep or broken it is."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

#: What a constant outside the standard (NaN, Infinity) decodes to; whatever holds it isn't valid.
_INVALID = object()


def _integer(digits: str) -> int | float:
    return int(digits) if len(digits) < 1000 else float(digits)  # longer ones are refused by int


_DECODER = json.JSONDecoder(parse_constant=lambda token: _INVALID)
_PATIENT = json.JSONDecoder(parse_constant=lambda token: _INVALID, parse_int=_integer)
_BRACKETS = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"|["{}\[\]]', re.S)
_OPENING = re.compile(r'\{[ \t\r\n]*(?:\}|"[^"\\]*(?:\\.[^"\\]*)*"[ \t\r\n]*:)', re.S)
_SCALAR = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null", re.A)
_STRING = re.compile(r'"(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*"')
_SPACE = re.compile(r"[ \t\r\n]*")


def decode(text: str, at: int = 0) -> tuple[object, int]:
    """The JSON value that begins at a place of a text, and where it ends; a ``JSONDecodeError`` tells how far it is valid."""
    try:
        return _DECODER.raw_decode(text, at)
    except RecursionError:
        return _decode_deep(text, at)
    except ValueError as e:
        if isinstance(e, json.JSONDecodeError):
            raise
        return _PATIENT.raw_decode(text, at)  # it holds an integer of thousands of digits


#: Characters that are decoded at first; an error's cost grows with the text it is raised for, so more is taken only if need be.
WINDOW = 4096


def _decode_within(text: str, at: int) -> tuple[object, int] | int:
    """``decode`` that returns the place up to which the text is valid where it is not an object, at the cost of what it reads."""
    size = WINDOW
    while True:
        whole = at + size >= len(text)
        part, shift = (text, 0) if whole and len(text) <= WINDOW else (text[at : at + size], at)
        try:
            value, end = decode(part, at - shift)
        except json.JSONDecodeError as e:
            if whole or (e.pos < len(part) - 16 and not e.msg.startswith("Unterminated")):
                return e.pos + shift
            size *= 2
        else:
            return value, end + shift


def _decode_deep(text: str, at: int) -> tuple[object, int]:
    """``decode`` with a stack of its own, for values nested deeper than the usual decoder goes."""
    stack: list[tuple[object, str | None]] = []  # open containers, each with the key that waits for a value
    space = _SPACE.match
    want = "value"
    while True:
        at = space(text, at).end()
        ch = text[at : at + 1]
        if want in ("value", "first") and not (want == "first" and ch == "]"):
            if ch == "{":
                stack.append(({}, None))
                at, want = at + 1, "name"
                at = space(text, at).end()
                if text[at : at + 1] != "}":
                    at, want = _name(text, at, stack), "value"
                    continue
                done, at = stack.pop()[0], at + 1
            elif ch == "[":
                stack.append(([], None))
                at, want = at + 1, "first"
                continue
            elif ch == '"':
                found = _STRING.match(text, at)
                if found is None:
                    raise json.JSONDecodeError("no string", text, at)
                done, at = _PATIENT.decode(found.group()), found.end()
            else:
                found = _SCALAR.match(text, at)
                if found is None:
                    raise json.JSONDecodeError("no value", text, at)
                done, at = _PATIENT.decode(found.group()), found.end()
        else:  # an empty list
            done, at = stack.pop()[0], at + 1
        while True:
            if not stack:
                return done, at
            held, key = stack[-1]
            if key is None:
                held.append(done)
            else:
                held[key] = done
            at = space(text, at).end()
            ch = text[at : at + 1]
            if ch == ",":
                at, want = at + 1, "value"
                if key is not None:
                    at = _name(text, space(text, at).end(), stack, again=True)
                break
            if ch != ("]" if key is None else "}"):
                raise json.JSONDecodeError("no end", text, at)
            done, at = stack.pop()[0], at + 1


def _name(text: str, at: int, stack: list, again: bool = False) -> int:
    """Reads the name of an object's member and its colon."""
    found = _STRING.match(text, at)
    colon = _SPACE.match(text, found.end()).end() if found else at
    if found is None or text[colon : colon + 1] != ":":
        raise json.JSONDecodeError("no name", text, at)
    stack[-1] = (stack[-1][0], json.loads(found.group()))
    return colon + 1


def valid_parts(value: object) -> Iterator[dict]:
    """``value`` if it is an object without invalid constants, else the outermost such objects in it, in order."""
    order: list[tuple[object, int]] = []  # containers before what they hold, each with the number of its holder
    todo: list[tuple[object, int]] = [(value, -1)]
    broken: list[bool] = []
    while todo:
        node, holder = todo.pop()
        if node is _INVALID:
            while holder >= 0 and not broken[holder]:
                broken[holder] = True
                holder = order[holder][1]
        elif isinstance(node, (dict, list)):
            number = len(order)
            order.append((node, holder))
            broken.append(False)
            inner = list(node.values()) if isinstance(node, dict) else node
            todo += [(x, number) for x in reversed(inner) if x is _INVALID or isinstance(x, (dict, list))]
    within = [False] * len(order)
    for number, (node, holder) in enumerate(order):
        within[number] = holder >= 0 and (within[holder] or (not broken[holder] and isinstance(order[holder][0], dict)))
        if isinstance(node, dict) and not broken[number] and not within[number]:
            yield node


def objects(text: str) -> Iterator[dict]:
    """The complete, strictly valid JSON objects in a text that lie in no other, left to right.

    Where an object breaks off, everything it left open is as incomplete as itself and isn't tried again; what was complete
    within it counts.
    """
    incomplete: set[int] = set()
    at = text.find("{")
    while at >= 0:
        end = at + 1
        if at not in incomplete and _OPENING.match(text, at):
            found = _decode_within(text, at)
            if isinstance(found, int):
                incomplete.update(_left_open(text, at, found))
            else:
                value, end = found
                strange = text.find("NaN", at, end) >= 0 or text.find("Infinity", at, end) >= 0
                yield from valid_parts(value) if strange else (value,)
        at = text.find("{", end)


def _left_open(text: str, start: int, end: int) -> list[int]:
    """Where the brackets stand that are open at ``end``, in a text that is valid JSON from ``start`` so far."""
    still: list[int] = []
    for token in _BRACKETS.finditer(text, start, end):
        ch = text[token.start()]
        if ch in "{[":
            still.append(token.start())
        elif ch != '"':
            still.pop()
        elif token.end() - token.start() == 1:
            break  # within a text that isn't closed
    return still
