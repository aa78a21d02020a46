"""The condition language: JSON nodes parsed to a tree on the driver and compiled to Catalyst columns.

A node kind is one entry of ``KINDS``: how its JSON is read and written, what it counts and what column it becomes. The
columns refer to counts of boxes by (class, threshold); the planner computes each such count once, however many
conditions ask for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwell.errors import RuleError
from tarnwell.plans.fields import MISSING, Field, anything, count, flag, lower_text, optional, read_object, share

# What a class gets that sets no band of its own.
DEFAULT_CONFIDENCE, DEFAULT_REVIEW_CONFIDENCE, DEFAULT_SECOND_OPINION = 0.65, 0.35, True

#: A count of boxes: the class (None: any) and the least confidence.
Count = tuple[str | None, float]


@dataclass(frozen=True)
class Band:
    """When a class is settled, worth a look, and worth a second opinion."""

    confidence: float = DEFAULT_CONFIDENCE
    review_confidence: float = DEFAULT_REVIEW_CONFIDENCE
    second_opinion: bool = DEFAULT_SECOND_OPINION


@dataclass(frozen=True)
class Node:
    """One condition. ``band`` holds a class's (confidence, review confidence, second opinion), None where unset."""

    kind: str
    children: tuple[Node, ...] = ()
    cls: str | None = None
    min_count: int = 1
    band: tuple[float | None, float | None, bool | None] = field(default=(None, None, None))

    def walk(self) -> Iterator[Node]:
        yield self
        for child in self.children:
            yield from child.walk()

    @property
    def threshold(self) -> float:
        """A condition without its own confidence matches at the default, whatever band its class resolves to."""
        return DEFAULT_CONFIDENCE if self.band[0] is None else self.band[0]

    def counts(self) -> set[Count]:
        return {c for n in self.walk() if (c := KINDS[n.kind].count(n)) is not None}

    def classes(self) -> set[str]:
        return {n.cls for n in self.walk() if n.cls is not None}

    def bands(self) -> dict[str, tuple]:
        return first_set({n.cls: n.band} for n in self.walk() if n.cls is not None)

    def column(self, counted: Callable[[Count], Column]) -> Column:
        """The condition as a column over the columns of its counts."""
        return KINDS[self.kind].column(self, counted)

    def to_json(self) -> Any:
        return KINDS[self.kind].write(self)

    def describe(self) -> str:
        return KINDS[self.kind].describe(self)


def first_set(sources: Iterable[dict[str, tuple]]) -> dict[str, tuple]:
    """Per class and field, the first value that is set, in order of priority; classes in order of first mention."""
    merged: dict[str, tuple] = {}
    for source in sources:
        for cls, values in source.items():
            held = merged.get(cls, (None,) * len(values))
            merged[cls] = tuple(new if old is None else old for old, new in zip(held, values))
    return merged


@dataclass(frozen=True)
class Kind:
    """What a kind of node does."""

    read: Callable[[dict], Node]
    write: Callable[[Node], Any]
    column: Callable[[Node, Callable[[Count], Column]], Column]
    describe: Callable[[Node], str]
    count: Callable[[Node], Count | None] = lambda node: None


#: Key that marks a node -> its kind. The first key in this order that a node has decides.
KINDS: dict[str, Kind] = {}


def register_condition(key: str, kind: Kind) -> None:
    """Adds a kind of condition; it becomes a column like any other, so Catalyst sees it."""
    KINDS[key] = kind


def parse(node: Any) -> Node:
    """A JSON condition as a tree; a bare string is short for a class."""
    if isinstance(node, str):
        return parse({"class": node})
    marks = [k for k in KINDS if isinstance(node, dict) and k in node]
    if not marks:
        raise RuleError(f"no kind of condition in {node!r}; the kinds are {', '.join(KINDS)}")
    return KINDS[marks[0]].read(node)


# The fields of conditions as rules files name them.
COUNT = Field("min_count", "a whole number from 1 up", count, 1)
SURE = Field("min_confidence", "a number from 0 to 1", optional(share), None)
WORTH_A_LOOK = Field("min_review_confidence", "a number from 0 to 1", optional(share), None)
ASK = Field("ollama_review", "true or false", optional(flag), None)
CLASS = Field("class", "the name of a class", lower_text)


def _read_class(node: dict) -> Node:
    at = read_object(node, "condition on a class", (CLASS, COUNT, SURE, WORTH_A_LOOK, ASK))
    band = tuple(at[f.name] for f in (SURE, WORTH_A_LOOK, ASK))
    if None not in band[:2] and band[1] > band[0]:
        raise RuleError(f"condition on class {at['class']!r}: worth a look only from {band[1]} but sure from {band[0]}")
    return Node("class", cls=at["class"], min_count=at["min_count"], band=band)


def _read_any(node: dict) -> Node:
    at = read_object(node, "condition on any box", (Field("any_detection", "", anything), COUNT, SURE))
    return Node("any_detection", min_count=at["min_count"], band=(at["min_confidence"], None, None))


def _fields(node: Node) -> dict:
    held = zip((COUNT, SURE, WORTH_A_LOOK, ASK), (node.min_count, *node.band))
    return {f.name: v for f, v in held if v != f.default}


def _describe_class(node: Node) -> str:
    confidence, review, second = node.band
    limits = [] if confidence is None else [f"sure from {confidence:.2f}"]
    limits += [] if review is None else [f"looked at from {review:.2f}"]
    limits += [] if second is None else ["asked about" if second else "never asked about"]
    number = "" if node.min_count == 1 else f"{node.min_count} or more "
    return f"{number}{node.cls}" + (f" ({', '.join(limits)})" if limits else "")


def _children(value: Any) -> Any:
    return tuple(map(parse, value)) if isinstance(value, list) and value else MISSING


def _group(key: str, join: Callable[[list[Column]], Column], words: str) -> Kind:
    """A kind that joins children; ``words`` has a place for their descriptions, and before a bar what parts them."""
    between, around = words.split("|")
    spec = Field(key, "a list of one condition or more", _children)
    return Kind(
        lambda node: Node(key, read_object(node, f"condition {key!r}", [spec])[key]),
        lambda n: {key: [c.to_json() for c in n.children]},
        lambda n, counted: join([c.column(counted) for c in n.children]),
        lambda n: around.format(between.join(c.describe() for c in n.children)),
    )


def _constant(key: str, value: bool, words: str) -> Kind:
    spec = Field(key, "", anything)

    def read(node: dict) -> Node:
        read_object(node, f"condition {key!r}", [spec])
        return Node(key)

    return Kind(read, lambda n: {key: True}, lambda n, counted: F.lit(value), lambda n: words)


def _read_not(node: dict) -> Node:
    return Node("not", (read_object(node, "condition 'not'", [Field("not", "a condition", parse)])["not"],))


def _enough(node: Node, counted: Callable[[Count], Column]) -> Column:
    return counted((node.cls, node.threshold)) >= node.min_count


register_condition(
    "class", Kind(_read_class, lambda n: {"class": n.cls} | _fields(n), _enough, _describe_class, lambda n: (n.cls, n.threshold))
)
register_condition(
    "any_detection",
    Kind(_read_any, lambda n: {"any_detection": True} | _fields(n), _enough, lambda n: f"{n.min_count} or more boxes of any class", lambda n: (None, n.threshold)),
)
register_condition("all_of", _group("all_of", lambda cs: reduce(and_, cs), " and |{}"))
register_condition("any_of", _group("any_of", lambda cs: reduce(or_, cs), " or |either {}"))
register_condition("none_of", _group("none_of", lambda cs: ~reduce(or_, cs), ", |none of {}"))
register_condition(
    "not",
    Kind(_read_not, lambda n: {"not": n.children[0].to_json()}, lambda n, counted: ~n.children[0].column(counted), lambda n: f"all but [{n.children[0].describe()}]"),
)
register_condition("always", _constant("always", True, "every image"))
# Doubt is a property of the decision, so no detections ever meet this condition; the action planner applies its rule.
register_condition("in_doubt", _constant("in_doubt", False, "images in doubt"))
