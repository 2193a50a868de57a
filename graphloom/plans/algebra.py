"""The query as data: patterns, groups and modifiers."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Const:
    """A term by its text alone: data types and language tags are not kept."""

    text: str


@dataclass(frozen=True)
class Pattern:
    s: Var | Const
    p: str
    o: Var | Const

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(t.name for t in (self.s, self.o) if isinstance(t, Var))


@dataclass(frozen=True)
class Expr:
    """op over args: '=', '!=', '<', '<=', '>', '>=', '&&', '||', '!', '+', '-', '*', '/', 'bound', a function's name, or
    'call' over the name of a function of the engine's own and its arguments."""

    op: str
    args: tuple


@dataclass
class Group:
    patterns: list[Pattern] = field(default_factory=list)
    filters: list[Expr] = field(default_factory=list)
    optionals: list[Group] = field(default_factory=list)
    unions: list[list[Group]] = field(default_factory=list)
    subqueries: list[Query] = field(default_factory=list)


@dataclass(frozen=True)
class Aggregate:
    fn: str
    arg: str | None
    distinct: bool
    name: str


@dataclass(frozen=True)
class Computed:
    """An expression under a name; a variable alone is renamed."""

    value: Var | Const | Expr
    name: str


@dataclass
class Query:
    where: Group
    select: list[str | Aggregate | Computed] | None = None  # None: all variables
    ask: bool = False
    distinct: bool = False
    group_by: list[str] = field(default_factory=list)
    order_by: list[tuple[str, bool]] = field(default_factory=list)  # name, ascending
    limit: int | None = None
    offset: int = 0

    @property
    def extended(self) -> bool:
        """Whether it goes beyond SELECT over one basic graph pattern."""
        w = self.where
        return bool(self.ask or self.distinct or self.group_by or self.order_by or self.limit is not None or self.offset or w.filters or w.optionals or w.unions or w.subqueries or any(isinstance(x, Aggregate) or isinstance(x, Computed) and not isinstance(x.value, Var) for x in self.select or ()))
