"""Graph patterns as DataFrames: scans with columns named by variable, joins, projection and the modifiers.

Columns keep the values of the graph (ids, table keys or texts) through patterns, joins, unions, DISTINCT and GROUP BY.
Texts are fetched only where a filter, an order, an aggregate or the result looks at them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.errors import UnsupportedQuery
from graphloom.functions.stats import Stats
from graphloom.operators.range_join import range_join
from graphloom.plans.algebra import Aggregate, Computed, Const, Expr, Group, Pattern, Query, Var
from graphloom.plans.order import Ranges, best_order, connected
from graphloom.sources.terms import TextTerms

#: Rows of each side that meet in one cell of a join with frequent values; keys up to which they are broadcast.
CELL, HOT_KEYS = 2048, 100_000
#: Copies of a row that one step makes.
RUN = 1 << 16

#: relation(predicate, by_object) -> (s, o) rows.
Relation = Callable[[str, bool], DataFrame]


@dataclass
class Graph:
    """What patterns are read from. constants: the values of the query's constants; bounds: of those that order is compared with."""

    relation: Relation
    terms: TextTerms
    constants: dict[str, object] = field(default_factory=dict)
    bounds: dict[str, object] = field(default_factory=dict)
    stats: Stats = field(default_factory=Stats)
    cross: bool = False
    functions: dict[str, Callable[..., Column]] = field(default_factory=dict)

    def texts(self, rows: Rows, names: set[str]) -> DataFrame:
        """rows with the texts of these variables beside them, under text_name."""
        there = names & set(rows.names)
        df = rows.df.withColumns({text_name(n): F.col(n) for n in there & rows.values})
        return self.terms.with_texts(df, {n: text_name(n) for n in sorted(there - rows.values)})


def text_name(name: str) -> str:
    return f"__text_{name}"


@dataclass
class Rows:
    """Columns by variable. maybe: those that may be unbound (null); values: those that hold computed values, not the graph's.
    weighted: a row stands for as many as its column __n says (in what `group` gives to `modify`, and only there)."""

    df: DataFrame
    maybe: frozenset[str] = frozenset()
    values: frozenset[str] = frozenset()
    weighted: bool = False

    @property
    def names(self) -> list[str]:
        return [c for c in self.df.columns if c != "__n"]

    @property
    def weights(self) -> list[str]:
        return ["__n"] if self.weighted else []

    def where(self, condition: Column) -> Rows:
        return Rows(self.df.where(condition), self.maybe, self.values)

    def bound(self, name: str) -> Rows:
        return Rows(self.df.where(F.col(name).isNotNull()), self.maybe - {name}, self.values)

    def unbound(self, name: str) -> Rows:
        return Rows(self.df.where(F.col(name).isNull()).drop(name), self.maybe - {name}, self.values - {name})


def scan(p: Pattern, g: Graph, repeated: bool = False) -> Rows:
    """The pattern's rows, columns named by its variables; constants become filters that reach the scan. A constant the
    graph does not hold makes it empty."""
    rows = g.relation(p.p, isinstance(p.o, Const) and not isinstance(p.s, Const))
    condition = F.lit(True)
    matches = getattr(g.terms, "matches", g.terms.equals)
    for term, col in ((p.s, "s"), (p.o, "o")):
        if isinstance(term, Const):
            v = g.constants[term.text]
            condition = condition & (F.lit(False) if v is None else matches(F.col(col), v))
    if len(p.names) == 2 and p.names[0] == p.names[1]:
        if not repeated:
            raise UnsupportedQuery("the same variable as subject and object is not supported")
        return Rows(rows.where(condition & (F.col("s") == F.col("o"))).select(F.col("s").alias(p.names[0])))
    picked = [F.col(c).alias(t.name) for t, c in ((p.s, "s"), (p.o, "o")) if isinstance(t, Var)]
    return Rows(rows.where(condition).select(*picked) if picked else rows.where(condition).select(F.lit(1).alias("__exists")))


def aligned(a: Rows, b: Rows, g: Graph) -> tuple[Rows, Rows]:
    """Variables that hold the graph's values on one side and computed ones on the other, as texts on both."""
    odd = {v for v in a.names if v in b.names and (v in a.values) != (v in b.values)}

    def plain(r: Rows) -> Rows:
        df = g.texts(r, odd)
        return Rows(df.select(*(F.col(text_name(n)).cast("string").alias(n) if n in odd else F.col(n) for n in r.names)), r.maybe, r.values | odd)

    return (plain(a), plain(b)) if odd else (a, b)


def stacked(parts: list[Rows]) -> Rows:
    """The rows of all; a variable that one of them lacks may be unbound."""
    every = list(dict.fromkeys(n for r in parts for n in r.names))
    maybe = frozenset().union(*(r.maybe | (set(every) - set(r.names)) for r in parts))
    df = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [r.df for r in parts])
    return Rows(df.select(*every), maybe, frozenset().union(*(r.values for r in parts)))


def join(a: Rows, b: Rows, g: Graph) -> Rows:
    """All pairs of rows that agree where both are bound. Every part is a join on equal columns: rows whose shared variable is
    unbound on one side are joined on the others."""
    a, b = aligned(a, b, g)
    shared = [n for n in a.names if n in b.names]
    loose = [n for n in shared if n in a.maybe | b.maybe]
    if not loose:
        df = a.df.join(b.df, shared) if shared else a.df.crossJoin(b.df)
        return Rows(df, a.maybe | b.maybe, a.values | b.values)
    v = loose[0]
    parts = [join(a.bound(v), b.bound(v), g)]
    if v in a.maybe:
        parts.append(join(a.unbound(v), b, g))
    if v in b.maybe:
        parts.append(join(a.bound(v), b.unbound(v), g))
    out = stacked(parts)
    return Rows(out.df, (a.maybe | b.maybe) - (set() if v in a.maybe & b.maybe else {v}), out.values)


def left_join(a: Rows, b: Rows, filters: list[Expr], g: Graph) -> Rows:
    """a's rows with every row of b that agrees and passes the filters, which see both sides; else alone."""
    a, b = aligned(a, b, g)
    shared = [n for n in a.names if n in b.names]
    if not g.cross and not [n for n in shared if n not in a.maybe | b.maybe]:
        raise UnsupportedQuery("an optional part shares no variable that is always bound: its product must be asked for")
    wanted = set().union(*(texts_of(f, g, a.values | b.values) for f in filters))
    left, right = g.texts(a, wanted), g.texts(b, wanted)
    right = right.select(*(F.col(c).alias(f"__right_{c}") for c in right.columns))
    on = F.lit(True)
    for n in shared:
        x, y = F.col(n), F.col(f"__right_{n}")
        on = on & ((x == y) | x.isNull() | y.isNull() if n in a.maybe | b.maybe else x == y)
    held = [*left.columns, *right.columns]

    def resolve(c: str) -> Column | None:
        found = [F.col(x) for x in (c, f"__right_{c}") if x in held]
        return F.coalesce(*found) if found else None

    for f in filters:
        on = on & expression(f, resolve, g, a.values | b.values)
    joined = left.join(right, on, "left")
    new = [n for n in b.names if n not in shared]
    out = joined.select(*(F.coalesce(n, f"__right_{n}").alias(n) if n in shared and n in a.maybe else F.col(n) for n in a.names), *(F.col(f"__right_{n}").alias(n) for n in new))
    return Rows(out, a.maybe | set(new), a.values | b.values)


def frequent_join(a: Rows, b: Rows, g: Graph, texts: bool) -> Rows:
    """`join` where values may be frequent on both sides. The pairs of such a value are a square, cut into cells of CELL by CELL rows
    that are dealt like keys: no task holds more than a cell's rows, and one value's pairs are made in many. texts: the
    variables that are not shared may become texts before the pairs are made."""
    shared = [n for n in a.names if n in b.names]
    counts = [r.df.groupBy(*shared).agg(F.count("*").alias(f"__{side}")) for r, side in ((a, "a"), (b, "b"))]
    cut = lambda c: F.ceil(F.col(c) / CELL).cast("int").alias(c)
    hot = counts[0].join(counts[1], shared).where(F.col("__a").cast("double") * F.col("__b") > CELL * CELL).select(*shared, cut("__a"), cut("__b"))
    held = hot.limit(HOT_KEYS + 1).collect()
    if not held:
        return join(a, b, g)
    spark = a.df.sparkSession
    cells = sum(r["__a"] * r["__b"] for r in held)
    known = F.broadcast(spark.createDataFrame(held, hot.schema)) if len(held) <= HOT_KEYS else hot
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(2 * cells, 4096))

    def dealt(r: Rows, own: str, other: str) -> DataFrame:
        mine = [n for n in r.names if n not in shared]
        # a piece of its own side's rows, and a copy for each piece of the other's
        rows = r.df.join(known, shared, "left")
        rows = rows.withColumn("__own", F.pmod(F.xxhash64(*r.names), F.coalesce(own, F.lit(1))).cast("int")).withColumn("__other", F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)))
        if texts:
            rows = g.terms.with_texts(rows, {n: text_name(n) for n in mine})
        picked = [F.col(text_name(n) if texts else n).alias(n) for n in mine]
        return rows.select(*shared, *picked, F.col("__own").alias(f"__p{own}"), F.col("__other").alias(f"__p{other}")).repartition(parts, *shared, "__p__a", "__p__b")

    left, right = dealt(a, "__a", "__b"), dealt(b, "__b", "__a")
    df = left.join(right.hint("merge"), [*shared, "__p__a", "__p__b"]).drop("__p__a", "__p__b")
    values = frozenset(n for n in df.columns if n not in shared) if texts else a.values | b.values
    return Rows(df, a.maybe | b.maybe, values)


def may_be_frequent(done: list[Pattern], p: Pattern, stats: Stats) -> bool:
    """Whether the pattern meets those done only in objects of both, which many subjects may share."""
    names = {n for q in done for n in q.names} & set(p.names)
    objects = [{q.o.name} if isinstance(q.o, Var) else set() for q in [*done, p]]
    subjects = {q.s.name for q in [*done, p] if isinstance(q.s, Var)}
    if not names or names & subjects or not names <= objects[-1]:
        return False
    sizes = [stats.pairs.get((q.p, p.p, "OO"), 0 if stats.paired else None) for q, o in zip(done, objects, strict=False) if names & o]
    return not any(n is not None and n <= 16 * CELL * CELL for n in sizes)


def count_bgp(patterns: list[Pattern], g: Graph) -> DataFrame:
    """n, the number of `bgp`'s rows. Only variables that patterns share are kept, and rows alike in them are counted before they
    are joined, so no pair is made but of values."""
    if not g.cross and not connected(patterns):
        raise UnsupportedQuery("patterns share no variable: their product must be asked for")
    bound = [p for p in patterns if p.names]
    order = best_order(bound, g.stats)[0] if bound else []
    left = [bound[i] for i in order] + [p for p in patterns if not p.names]
    out, held = None, []
    for i, p in enumerate(left):
        later = {n for q in left[i + 1 :] for n in q.names}
        rows = scan(p, g).df if p.names else scan(p, g).df.limit(1)
        shared = [n for n in p.names if n in held]
        rows = rows.groupBy(*(n for n in dict.fromkeys(p.names) if n in later or n in held)).agg(F.count("*").alias("__m"))
        out = rows.withColumnRenamed("__m", "__n") if out is None else (out.join(rows, shared) if shared else out.crossJoin(rows)).withColumn("__n", F.col("__n") * F.col("__m"))
        held = [c for c in out.columns if c in later]
        out = out.groupBy(*held).agg(F.sum("__n").alias("__n"))
    return out.agg(F.coalesce(F.sum("__n"), F.lit(0)).cast("bigint").alias("n"))


def bgp(patterns: list[Pattern], g: Graph, repeated: bool = False, chosen: list | None = None, filters: list[Expr] | None = None, texts: bool = False) -> Rows:
    """Left-deep natural joins in the planner's order. Patterns without variables are existence checks.

    Disconnected patterns with variables raise unless `cross` allows their product. chosen: gets the order. filters: of the
    group, for the planner. texts: nothing but the result in texts comes after.
    """
    if not g.cross and not connected(patterns):
        raise UnsupportedQuery("patterns share no variable: their product must be asked for")
    bound = [p for p in patterns if p.names]
    order, cost = best_order(bound, g.stats, ranges_of(filters or [], g)) if bound else ([], 0.0)
    if chosen is not None:
        chosen += [[bound[i] for i in order], cost]
    out = None
    for at, i in enumerate(order):
        rows = scan(bound[i], g, repeated)
        if out is None:
            out = rows
        elif may_be_frequent([bound[j] for j in order[:at]], bound[i], g.stats):
            out = frequent_join(out, rows, g, texts and not g.terms.joins and at == len(order) - 1)
        else:
            out = join(out, rows, g)
    for p in patterns:
        if not p.names:  # 0 or 1 row, so the product is an existence check
            there = scan(p, g).df.limit(1)
            out = Rows(there) if out is None else Rows(out.df.crossJoin(F.broadcast(there)))
    return Rows(out.df.drop("__exists"), out.maybe, out.values) if bound else out


COMPARISONS = ("=", "!=", "<", "<=", ">", ">=")
TURNED = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}
NUMERIC = ("+", "-", "*", "/", "strlen", "abs", "integer", "double")


def plain(e, ops: tuple[str, ...]) -> bool:
    """Whether an expression is one of these comparisons of variables, or of one with a constant."""
    return isinstance(e, Expr) and e.op in ops and all(isinstance(a, Var | Const) for a in e.args) and any(isinstance(a, Var) for a in e.args)


def by_order(e, g: Graph, values: frozenset[str] | set[str]) -> bool:
    """Whether a comparison can be made on the graph's values themselves, as they stand in the order of their texts."""
    return g.terms.ordered and plain(e, COMPARISONS[2:]) and not any(isinstance(a, Var) and a.name in values for a in e.args)


def texts_of(e, g: Graph, values: frozenset[str] | set[str]) -> set[str]:
    """The variables whose texts an expression needs."""
    if isinstance(e, Var):
        return {e.name}
    if isinstance(e, Const) or plain(e, COMPARISONS[:2]) or by_order(e, g, values) or e.op == "bound":
        return set()
    return set().union(*(texts_of(a, g, values) for a in e.args))


def constants_of(e, ops: tuple[str, ...] = ("=", "!=")) -> list[str]:
    """The constants that an expression compares so with values of the graph."""
    if not isinstance(e, Expr):
        return []
    return [a.text for a in e.args if isinstance(a, Const)] if plain(e, ops) else [t for a in e.args for t in constants_of(a, ops)]


def ranges_of(filters: list[Expr], g: Graph) -> Ranges:
    """The comparisons of variables with constants that every row must pass, as numbers, for the planner."""
    out: Ranges = {}
    for f in filters:
        if f.op == "&&":
            for name, found in ranges_of([x for x in f.args if isinstance(x, Expr)], g).items():
                out.setdefault(name, []).extend(found)
        elif by_order(f, g, set()) and isinstance(f.args[0], Var) != isinstance(f.args[1], Var):
            x, op, c = (f.args[0], f.op, f.args[1]) if isinstance(f.args[0], Var) else (f.args[1], TURNED[f.op], f.args[0])
            bound = g.bounds.get(c.text)
            if isinstance(bound, tuple):
                out.setdefault(x.name, []).append((op, bound[0]))
    return out


def expression(e, resolve: Callable[[str], Column | None], g: Graph, values: frozenset[str] | set[str]) -> Column:
    """A column from an expression; terms compare as text. resolve: a column of the rows by its name, None if it is not there."""
    null = F.lit(None).cast("string")
    if isinstance(e, Var):
        found = resolve(text_name(e.name))
        return null if found is None else found
    if isinstance(e, Const):
        return F.lit(e.text)
    if e.op == "bound":
        found = resolve(e.args[0].name)
        return F.lit(False) if found is None else found.isNotNull()
    if by_order(e, g, values):
        x, y = e.args
        op, one, other = e.op, *(resolve(a.name) if isinstance(a, Var) else a for a in (x, y))
        if one is None or other is None:
            return F.lit(None).cast("boolean")
        if isinstance(x, Var) and isinstance(y, Var):
            return {"<": one < other, "<=": one <= other, ">": one > other, ">=": one >= other}[op]
        return g.terms.compare(one, op, g.bounds[y.text]) if isinstance(x, Var) else g.terms.compare(other, TURNED[op], g.bounds[x.text])
    if plain(e, COMPARISONS[:2]):
        x, y = e.args if isinstance(e.args[0], Var) else e.args[::-1]
        one, other = resolve(x.name), resolve(y.name) if isinstance(y, Var) else None
        if one is None or isinstance(y, Var) and other is None:
            return F.lit(None).cast("boolean")
        if isinstance(y, Const):
            same = one.cast("string") == y.text if x.name in values else g.terms.equals(one, g.constants[y.text])
        elif (x.name in values) != (y.name in values):
            raise UnsupportedQuery(f"?{x.name} and ?{y.name} are not of one kind")
        else:
            same = one == other
        return same if e.op == "=" else ~same
    if e.op == "call":
        name, args = e.args[0].text, e.args[1:]
        if name not in g.functions:
            raise UnsupportedQuery(f"function {name} is not supported")
        return g.functions[name](*(expression(a, resolve, g, values) for a in args))
    args = [expression(a, resolve, g, values) for a in e.args]
    if e.op in COMPARISONS:
        if any(isinstance(a, Expr) and a.op in NUMERIC for a in e.args):
            args = [a.try_cast("double") for a in args]
        a, b = args
        return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[e.op]
    if e.op in ("+", "-", "*", "/"):
        a, b = (x.try_cast("double") for x in args)
        return {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b)}[e.op]
    table = {
        "&&": lambda a, b: a & b,
        "||": lambda a, b: a | b,
        "!": lambda a: ~a,
        "regex": lambda a, b: F.rlike(a, b),
        "like": lambda a, b: F.like(a, b),
        "contains": lambda a, b: F.contains(a, b),
        "strstarts": lambda a, b: F.startswith(a, b),
        "strends": lambda a, b: F.endswith(a, b),
        "strlen": lambda a: F.length(a),
        "ucase": lambda a: F.upper(a),
        "lcase": lambda a: F.lower(a),
        "str": lambda a: a,
        "abs": lambda a: F.abs(a.try_cast("double")),
        "integer": lambda a: a.try_cast("bigint"),
        "double": lambda a: a.try_cast("double"),
        "concat": lambda *a: F.concat(*(x.cast("string") for x in a)),
    }
    return table[e.op](*args)


def evaluated(rows: Rows, es: list, g: Graph) -> tuple[DataFrame, list[Column]]:
    """rows with the texts that the expressions need, and the expressions as columns of them."""
    df = g.texts(rows, set().union(*(texts_of(e, g, rows.values) for e in es)))
    resolve = lambda c: F.col(c) if c in df.columns else None
    return df, [expression(e, resolve, g, rows.values) for e in es]


def filtered(rows: Rows, e: Expr, g: Graph) -> Rows:
    df, (condition,) = evaluated(rows, [e], g)
    return Rows(df.where(condition).select(*rows.names, *rows.weights), rows.maybe, rows.values, rows.weighted)


def comparing(filters: list[Expr], a: Rows, b: Rows) -> tuple[Expr, str, str, str] | None:
    """A filter, or a part of a conjunction, that orders a variable of a against one of b: (it, a's variable, comparison, b's)."""
    for f in filters:
        if f.op == "&&" and (found := comparing([x for x in f.args if isinstance(x, Expr)], a, b)):
            return found
        if f.op in ("<", "<=", ">", ">=") and all(isinstance(x, Var) for x in f.args):
            x, y = (v.name for v in f.args)
            if x in a.names and y in b.names:
                return f, x, f.op, y
            if y in a.names and x in b.names:
                return f, y, TURNED[f.op], x
    return None


def weighted_range_join(a: Rows, x: str, op: str, b: Rows, y: str, keep: set[str], g: Graph) -> Rows:
    """The pairs with x op y, in the variables of `keep`: rows alike in them and the compared value are counted, not paired."""
    sides = []
    for rows, v, n in ((a, x, "__n"), (b, y, "__m")):
        on_ids = g.terms.ordered and not {x, y} & (a.values | b.values)
        df, by = (rows.df, v) if on_ids else (g.texts(rows, {v}), text_name(v))
        sides += [df.groupBy(*dict.fromkeys([*(c for c in rows.names if c in keep), by])).agg(F.count("*").alias(n)), by]
    df = range_join(sides[0], sides[1], op, sides[2], sides[3]).withColumn("__n", F.col("__n") * F.col("__m"))
    names = [c for c in (*a.names, *b.names) if c in keep]
    return Rows(df.select(*names, "__n"), (a.maybe | b.maybe) & set(names), (a.values | b.values) & set(names), True)


def repeated_rows(df: DataFrame) -> DataFrame:
    """Every row as often as its __n says, made in runs that are dealt over the cluster."""
    runs = df.withColumn("__run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(__n - 1) div {RUN}"))))
    runs = runs.repartition(8 * df.sparkSession.sparkContext.defaultParallelism)
    size = F.least(F.col("__n") - F.col("__run") * RUN, F.lit(RUN)).cast("int")
    return runs.withColumn("__i", F.explode(F.sequence(F.lit(1), size))).drop("__run", "__i", "__n")


def weighable(q: Query) -> set[str] | None:
    """The variables that a query looks at after its pattern, where rows alike in them may stand as one; None where they may not."""
    plainly = q.select is not None and not (q.ask or q.distinct or q.group_by or q.order_by or q.offset or q.limit is not None)
    if not plainly or any(isinstance(x, Aggregate) for x in q.select):
        return None
    return {v for x in q.select for v in ({x} if isinstance(x, str) else variables(x.value))}


def variables(e) -> set[str]:
    return {e.name} if isinstance(e, Var) else set().union(*map(variables, e.args)) if isinstance(e, Expr) else set()


def group(where: Group, g: Graph, chosen: list | None = None, run: Callable[[Query], Rows] | None = None, needed: set[str] | None = None) -> Rows:
    """A group graph pattern: the basic patterns, then sub-selects, unions and optionals joined to them, then filters. Parts that
    share no variable meet by a filter that orders a variable of one against one of the other. needed: the variables looked at
    later, where the rows may be weighted."""
    parts = [bgp(c, g, True, chosen, where.filters) for c in components(where.patterns)]
    parts += [run(q) for q in where.subqueries]
    for branches in where.unions:
        parts.append(union([group(b, g, None, run) for b in branches], g))
    if not parts:
        raise UnsupportedQuery("a group needs a pattern")
    out, left = parts[0], parts[1:]
    while left:
        near = next((p for p in left if set(out.names) & set(p.names)), None)
        if near is not None:
            out = join(out, near, g)
        elif found := next(((p, c) for p in left if (c := comparing(where.filters, out, p))), None):
            near, (_, x, op, y) = found
            if needed is not None and len(left) == 1 and not where.optionals:
                out, left = weighted_range_join(out, x, op, near, y, needed.union(*map(variables, where.filters)), g), []
                continue
            if g.terms.ordered and not {x, y} & (out.values | near.values):
                df = range_join(out.df, x, op, near.df, y)
            else:
                df = range_join(g.texts(out, {x}), text_name(x), op, g.texts(near, {y}), text_name(y))
            out = Rows(df.select(*out.names, *near.names), out.maybe | near.maybe, out.values | near.values)
        elif g.cross:
            near = left[0]
            out = join(out, near, g)
        else:
            raise UnsupportedQuery("patterns share no variable: their product must be asked for")
        left = [p for p in left if p is not near]
    for o in where.optionals:
        out = left_join(out, group(Group(o.patterns, [], o.optionals, o.unions, o.subqueries), g, None, run), o.filters, g)
    for f in where.filters:
        out = filtered(out, f, g)
    return out


def components(patterns: list[Pattern]) -> list[list[Pattern]]:
    """The patterns by connected component; those without variables go with the first."""
    out: list[list[Pattern]] = []
    for p in (p for p in patterns if p.names):
        touching = [c for c in out if any(set(p.names) & set(q.names) for q in c)]
        out = [c for c in out if c not in touching] + [[q for c in touching for q in c] + [p]]
    rest = [p for p in patterns if not p.names]
    order = {id(p): i for i, p in enumerate(patterns)}
    out = sorted((sorted(c, key=lambda p: order[id(p)]) for c in out), key=lambda c: order[id(c[0])])
    return [out[0] + rest, *out[1:]] if out else [rest] if rest else []


def union(parts: list[Rows], g: Graph) -> Rows:
    """The rows of all branches; where one computes what another reads from the graph, both become texts."""
    odd = {n for r in parts for n in r.names if any(n in x.names and (n in x.values) != (n in r.values) for x in parts)}
    return stacked([Rows(g.texts(r, odd).select(*(F.col(text_name(n)).cast("string").alias(n) if n in odd else F.col(n) for n in r.names)), r.maybe, r.values | (odd & set(r.names))) for r in parts])


def modify(rows: Rows, q: Query, g: Graph, decode: bool = False) -> Rows:
    """Projection (bag, in SELECT order), aggregation, DISTINCT, ORDER BY, OFFSET and LIMIT; decode: the result in texts."""
    if q.ask:
        return Rows(rows.df.limit(1).agg((F.count("*") > 0).alias("ask")), values=frozenset({"ask"}))
    chosen = q.select if q.select is not None else [c for c in rows.names if not c.startswith("__")]
    used = [x for x in chosen if isinstance(x, str)] + [x.arg for x in chosen if isinstance(x, Aggregate) and x.arg] + q.group_by
    used += [x.value.name for x in chosen if isinstance(x, Computed) and isinstance(x.value, Var)]
    for v in used:
        if v not in rows.names:
            raise UnsupportedQuery(f"variable ?{v} is not in the pattern")
    aggregates = [x for x in chosen if isinstance(x, Aggregate)]
    if aggregates or q.group_by:
        loose = [x for x in chosen if isinstance(x, str) and x not in q.group_by]
        if loose or any(isinstance(x, Computed) for x in chosen):
            raise UnsupportedQuery(f"variable ?{loose[0]} is neither grouped nor aggregated" if loose else "expressions beside aggregates are not supported")
        rows = aggregated(rows, aggregates, q.group_by, g)
    names = [x if isinstance(x, str) else x.name for x in chosen]
    computed = [x for x in chosen if isinstance(x, Computed)]
    # a key that is a column only before the projection is kept until the rows are in order
    df, columns = evaluated(rows, [x.value for x in computed if not isinstance(x.value, Var)], g)
    weights = rows.weights
    made = dict(zip([x.name for x in computed if not isinstance(x.value, Var)], columns, strict=True))
    renamed = {x.name: x.value.name for x in computed if isinstance(x.value, Var)}
    keys = [(k, up) for k, up in q.order_by if k in names or k in rows.names]
    extra = [k for k, _ in keys if k not in names] if not q.distinct else []
    source = lambda n: made[n] if n in made else F.col(renamed.get(n, n))
    values = frozenset(n for n in [*names, *extra] if n in made or renamed.get(n, n) in rows.values)
    maybe = frozenset(n for n in [*names, *extra] if n in made or renamed.get(n, n) in rows.maybe)
    out = Rows(df.select(*(source(n).alias(n) for n in dict.fromkeys([*names, *extra])), *weights), maybe, values)
    if q.distinct:
        out = Rows(out.df.distinct(), maybe, values)
    keys = [(k, up) for k, up in keys if k in out.names]
    paged = q.limit is not None or q.offset
    df = g.texts(out, {k for k, _ in keys})
    order = [F.col(text_name(k)).asc_nulls_first() if up else F.col(text_name(k)).desc_nulls_last() for k, up in keys]
    if order and paged:
        df = df.orderBy(*order)
    if q.offset:
        df = df.offset(q.offset)
    if q.limit is not None:
        df = df.limit(q.limit)
    if decode:
        asked = {n for n in names if n not in values}
        missing = asked - {k for k, _ in keys}
        df = g.terms.with_texts(df, {n: text_name(n) for n in sorted(missing)})
        # fetching texts by joins loses the order
        df = df.orderBy(*order) if order and (not paged or g.terms.joins and missing) else df
        df = df.select(*(F.col(text_name(n)).alias(n) if n in asked else F.col(n) for n in names), *weights)
        return Rows(repeated_rows(df) if weights else df, maybe, frozenset(names))
    df = df.orderBy(*order) if order and not paged else df
    df = df.select(*names, *weights)
    return Rows(repeated_rows(df) if weights else df, maybe, values)


def aggregated(rows: Rows, aggregates: list[Aggregate], by: list[str], g: Graph) -> Rows:
    df = g.texts(rows, {a.arg for a in aggregates if a.arg and a.fn != "count"})

    def one(a: Aggregate) -> Column:
        if a.fn == "count":
            c = F.col(a.arg) if a.arg else F.lit(1)
            return (F.count_distinct(c) if a.distinct and a.arg else F.count(c)).alias(a.name)
        c = F.col(text_name(a.arg))
        if a.fn in ("sum", "avg"):
            c = c.try_cast("double")
        fn = {"sum": F.sum_distinct if a.distinct else F.sum, "avg": F.avg, "min": F.min, "max": F.max}[a.fn]
        return fn(c).alias(a.name)

    out = df.groupBy(*by).agg(*map(one, aggregates)) if aggregates else df.select(*by).distinct()
    new = {a.name for a in aggregates}
    return Rows(out, (rows.maybe & set(by)) | new, (rows.values & set(by)) | new)
