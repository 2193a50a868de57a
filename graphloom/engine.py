"""The engine: query text in, DataFrame out, over a store of ids or over relations of terms."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.errors import UnknownProperty, UnsupportedQuery
from graphloom.functions.stats import Stats
from graphloom.operators.bgp import COMPARISONS, Graph, Rows, bgp, constants_of, count_bgp, group, modify, weighable
from graphloom.plans.algebra import Computed, Const, Group, Pattern, Query
from graphloom.plans.parser import RDF_TYPE, parse
from graphloom.settings import Settings
from graphloom.sources.store import Store
from graphloom.sources.terms import TextTerms


@dataclass
class Engine:
    """source: a Store, or a dict of predicate -> (s, o) DataFrame of `terms`. stats guide the join order; a store's own are
    used where none are given. functions: by name or IRI, from columns of text to a column, for filters and projections."""

    source: Store | dict[str, DataFrame]
    stats: Stats | None = None
    settings: Settings = field(default_factory=Settings)
    terms: TextTerms = field(default_factory=TextTerms)
    functions: dict[str, Callable[..., Column]] = field(default_factory=dict)

    def __post_init__(self):
        if isinstance(self.source, Store):
            self.terms = self.source

    def relation(self, p: str, by_object: bool = False) -> DataFrame:
        if isinstance(self.source, Store):
            return self.source.relation(self.source.property_id(p), by_object)
        if p not in self.source:
            raise UnknownProperty(f"property {p} does not exist in RDF graph")
        return self.source[p]

    def query(self, text: str, count_only: bool = False, **settings) -> DataFrame:
        """The result as a DataFrame, columns in SELECT order, duplicates kept; count_only: one row, n."""
        s = self.settings.but(**settings)
        q = parse(text, s.extended)
        if count_only and not q.extended:
            return self.run(q, s.but(decode=False), count=True)
        rows = self.run(q, s.but(decode=s.decode and not count_only))
        return rows.agg(F.count("*").alias("n")) if count_only else rows

    def run(self, q: Query, s: Settings, chosen: list | None = None, count: bool = False) -> DataFrame:
        constants, bounds, patterns = [], [], []
        walk(q, patterns.append, lambda e: (constants.extend(constants_of(e)), bounds.extend(constants_of(e, COMPARISONS[2:]))))
        for p in patterns:
            self.relation(p.p)  # unknown predicates are errors, wherever they stand
        constants += [t.text for p in patterns for t in (p.s, p.o) if isinstance(t, Const)]
        g = Graph(self.relation, self.terms, self.terms.encode(sorted(set(constants))), self.terms.bounds(sorted(set(bounds))) if self.terms.ordered else {}, self.statistics(patterns, s), s.cross, self.functions)
        if count:
            for v in q.select or ():
                if not any(v in p.names for p in patterns):
                    raise UnsupportedQuery(f"variable ?{v} is not in the pattern")
            return count_bgp(q.where.patterns, g)
        return self.rows(q, g, s, chosen, s.decode).df

    def rows(self, q: Query, g: Graph, s: Settings, chosen: list | None = None, decode: bool = False) -> Rows:
        if not q.extended:
            return modify(bgp(q.where.patterns, g, s.extended, chosen, texts=decode), q, g, decode)
        return modify(group(q.where, g, chosen, lambda x: self.rows(x, g, s), weighable(q)), q, g, decode)

    def statistics(self, patterns: list[Pattern], s: Settings) -> Stats:
        """What the planner knows of these patterns' predicates and classes."""
        if self.stats is not None:
            return self.stats
        if isinstance(self.source, Store) and s.statistics and len(patterns) > 1:
            classes = {p.o.text for p in patterns if p.p == RDF_TYPE and isinstance(p.o, Const)}
            return self.source.stats_of({p.p for p in patterns}, classes) or Stats()
        return Stats()

    def explain(self, text: str, **settings) -> str:
        """The chosen join order, its estimated cost, and Spark's plan."""
        s, chosen = self.settings.but(**settings), []
        rows = self.run(parse(text, s.extended), s, chosen)
        order = "".join(f"{i}: {p}\n" for i, p in enumerate(chosen[0])) + f"cost: {chosen[1]:g}\n" if chosen else ""
        return order + rows._sc._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "formatted")

    def show(self, text: str, n: int = 20, **settings) -> None:
        self.query(text, **settings).show(n, truncate=False)

    def batch(self, queries: list[str], runs: int | None = None, **settings) -> dict:
        """Each query `runs` times, the first dropped; mean milliseconds (1 at least) and counts per query, and the
        arithmetic and geometric mean over queries. The timer covers parsing to the last row. A failing query is skipped."""
        times, counts, failed = [], [], []
        for q in queries:
            took = []
            try:
                for _ in range(runs or self.settings.runs):
                    t = time.time()
                    n = self.query(q, count_only=True, **settings).first()["n"]
                    took.append((time.time() - t) * 1000)
            except (ValueError, UnsupportedQuery, UnknownProperty) as e:
                failed.append((q, str(e)))
                continue
            rest = took[1:] or took
            times.append(max(1.0, sum(rest) / len(rest)))
            counts.append(n)
        return {"ms": times, "counts": counts, "failed": failed, "mean": sum(times) / len(times) if times else None, "geomean": math.exp(sum(map(math.log, times)) / len(times)) if times else None}


def walk(q: Query, pattern: Callable[[Pattern], object], filter_: Callable[[object], object]) -> None:
    """Visit every pattern, filter and computed expression of a query and its sub-selects."""

    def inside(g: Group) -> None:
        for p in g.patterns:
            pattern(p)
        for f in g.filters:
            filter_(f)
        for o in [*g.optionals, *(b for branches in g.unions for b in branches)]:
            inside(o)
        for s in g.subqueries:
            walk(s, pattern, filter_)

    inside(q.where)
    for x in q.select or ():
        if isinstance(x, Computed):
            filter_(x.value)
