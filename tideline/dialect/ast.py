"""Syntax trees of expressions and statements."""

from __future__ import annotations

import dataclasses
from typing import Any


@dataclasses.dataclass
class Lit:
    value: Any


@dataclasses.dataclass
class Ref:
    parts: list[str]


@dataclasses.dataclass
class Star:
    table: str | None = None


@dataclasses.dataclass
class Call:
    name: str
    args: list[Any]
    within_record: bool = False


@dataclasses.dataclass
class Op:
    op: str
    args: list[Any]


@dataclasses.dataclass
class Item:
    expr: Any
    alias: str | None
    text: str


@dataclasses.dataclass
class Table:
    name: str
    alias: str | None = None


@dataclasses.dataclass
class Derived:
    query: "Select | Union"
    alias: str | None = None


@dataclasses.dataclass
class Join:
    left: Any
    right: Any
    kind: str  # inner, left, right, cross
    on: Any = None
    using: list[str] | None = None
    natural: bool = False


@dataclasses.dataclass
class Window:
    """``span``: a table of the first and last time, where they are not those of the rows themselves."""

    time: Any
    size: int
    step: int
    by: list[Any]
    span: Any = None


@dataclasses.dataclass
class Select:
    items: list[Item]
    source: Any = None
    where: Any = None
    group: list[Any] | None = None
    window: Window | None = None
    having: Any = None
    order: list[tuple[Any, bool]] = dataclasses.field(default_factory=list)
    limit: int | None = None
    offset: int = 0
    distinct: bool = False


@dataclasses.dataclass
class Union:
    """``every[i]``: whether repeated rows stay when the part after ``parts[i]`` is added."""

    parts: list[Any]
    every: list[bool]
    order: list[tuple[Any, bool]] = dataclasses.field(default_factory=list)
    limit: int | None = None
    offset: int = 0


@dataclasses.dataclass
class Column:
    name: str
    type: str
    repeated: bool = False
    required: bool = False
    key: bool = False
    fields: list["Column"] | None = None


@dataclasses.dataclass
class Statement:
    kind: str
    args: dict[str, Any]
