"""Exact statistics of a graph: per predicate, per class, pairwise join sizes; one-bucket histograms; the stats file."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.folders import read_text, write_text

#: Pairwise statistics of classes are skipped beyond so many classes.
TYPE_LIMIT = 1024
#: What names a class among predicates.
CLASS = "class:"


@dataclass(frozen=True)
class Property:
    count: float = 1000.0
    distinct_s: float = 1000.0
    distinct_o: float = 1000.0
    #: Least and greatest value of a side, where they are numbers.
    span_s: tuple[float, float] | None = None
    span_o: tuple[float, float] | None = None

    def histogram(self, side: str) -> Histogram | None:
        """The values of side s or o as one bucket."""
        span, distinct = (self.span_s, self.distinct_s) if side == "S" else (self.span_o, self.distinct_o)
        return None if span is None else Histogram(*span, self.count / max(distinct, 1), distinct)


@dataclass
class Stats:
    """properties: by predicate; pairs: (p1, p2, kind SS/SO/OS/OO) -> exact join size, a class by CLASS + its name; classes: class ->
    (count, least, greatest subject); typed: classes not listed have no member; paired: pairs not listed have size 0."""

    properties: dict[str, Property] = field(default_factory=dict)
    pairs: dict[tuple[str, str, str], int] = field(default_factory=dict)
    classes: dict[str, tuple] = field(default_factory=dict)
    typed: bool = False
    paired: bool = False

    def of(self, p: str) -> Property:
        return self.properties.get(p, Property())


def property_stats(triples: DataFrame) -> DataFrame:
    """p, n, distinct and extreme subjects and objects of (s, p, o) rows: one partial and one final aggregation."""
    side = lambda c: (F.count_distinct(c).alias(f"distinct_{c}"), F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"))
    return triples.groupBy("p").agg(F.count("*").alias("n"), *side("s"), *side("o"))


def class_stats(types: DataFrame) -> DataFrame:
    """class, n, min_s, max_s of the (s, o) rows of rdf:type."""
    return types.groupBy(F.col("o").alias("class")).agg(F.count("*").alias("n"), F.min("s").alias("min_s"), F.max("s").alias("max_s"))


def pair_sizes(triples: DataFrame) -> DataFrame:
    """p1, p2, kind, n: the exact size of the join of every two predicates on subject or object (pairs of size 0 are absent).

    A degree table, one row per (predicate, side, value), joined with itself on the value: rows are per value and pair
    of predicates that meet there, never per pair of triples.
    """
    degree = triples.select("p", F.explode(F.array(F.struct(F.lit("S").alias("side"), F.col("s").alias("v")), F.struct(F.lit("O").alias("side"), F.col("o").alias("v")))).alias("x")).groupBy("p", F.col("x.side").alias("side"), F.col("x.v").alias("v")).agg(F.count("*").alias("c"))
    other = degree.select(F.col("p").alias("p2"), F.col("side").alias("side2"), "v", F.col("c").alias("c2"))
    return degree.join(other, "v").groupBy(F.col("p").alias("p1"), "p2", F.concat("side", "side2").alias("kind")).agg(F.sum(F.col("c") * F.col("c2")).alias("n"))


def nodes_of(used: DataFrame) -> DataFrame:
    """v, h0, h1, h2 of (v, code, side) rows (side 0: subject, 1: object): every value once. The sums of the hashes, of 31 bits each,
    stand for how often it is used as what."""
    one, other = F.xxhash64("code", "side"), F.xxhash64(F.lit(1), "code", "side")
    hashed = used.select("v", F.shiftrightunsigned(one, 33).alias("h0"), one.bitwiseAND(F.lit((1 << 31) - 1)).alias("h1"), F.shiftrightunsigned(other, 33).alias("h2"))
    return hashed.groupBy("v").agg(*(F.sum(h).alias(h) for h in ("h0", "h1", "h2")))


def alike(nodes: DataFrame) -> DataFrame:
    """many, lo, hi: the nodes that are used alike, counted, and their least and greatest value."""
    return nodes.groupBy("h0", "h1", "h2").agg(F.count("*").alias("many"), F.min("v").alias("lo"), F.max("v").alias("hi")).drop("h0", "h1", "h2")


def with_uses(groups: DataFrame, used: DataFrame, few: bool) -> DataFrame:
    """`alike` with uses: how often its least node is used, by code and side. few: whether the groups may be broadcast."""
    least = groups.select(F.col("lo").alias("v"))
    rows = used.join(F.broadcast(least) if few else least, "v").groupBy("v", "code", "side").agg(F.count("*").alias("c"))
    return groups.join(rows.groupBy(F.col("v").alias("lo")).agg(F.collect_list(F.struct("code", "side", "c")).alias("uses")), "lo")


def property_stats_alike(groups: DataFrame, type_code: int) -> DataFrame:
    """`property_stats` from `alike`; a code below zero is a class, and counts for type_code."""
    p = lambda x: F.when(x["code"] < 0, F.lit(type_code).cast("bigint")).otherwise(x["code"])
    of = lambda side, what: F.when(F.col("x.side") == side, what)
    used = groups.select("many", "lo", "hi", F.explode(F.transform("uses", lambda x: F.struct(p(x).alias("p"), x["side"].alias("side"), x["c"].alias("c")))).alias("x"))
    n = used.groupBy(F.col("x.p").alias("p")).agg(F.sum(of(0, F.col("x.c") * F.col("many"))).alias("n"))
    once = groups.select("many", "lo", "hi", F.explode(F.array_distinct(F.transform("uses", lambda x: F.struct(p(x).alias("p"), x["side"].alias("side"))))).alias("x"))
    side = lambda i, c: (F.sum(of(i, F.col("many"))).alias(f"distinct_{c}"), F.min(of(i, F.col("lo"))).alias(f"min_{c}"), F.max(of(i, F.col("hi"))).alias(f"max_{c}"))
    return n.join(once.groupBy(F.col("x.p").alias("p")).agg(*side(0, "s"), *side(1, "o")), "p").select("p", "n", "distinct_s", "min_s", "max_s", "distinct_o", "min_o", "max_o")


def pair_sizes_alike(groups: DataFrame) -> DataFrame:
    """`pair_sizes` from `alike`."""
    kind = F.concat(*(F.when(F.col(f"{x}.side") == 0, "S").otherwise("O") for x in "ab"))
    both = groups.select("many", "uses", F.explode("uses").alias("a")).select("many", "a", F.explode("uses").alias("b"))
    return both.groupBy(F.col("a.code").alias("p1"), F.col("b.code").alias("p2"), kind.alias("kind")).agg(F.sum(F.col("a.c") * F.col("b.c") * F.col("many")).alias("n"))


def with_classes(triples: DataFrame, type_name: object, limit: int = TYPE_LIMIT, name: Column | None = None) -> DataFrame:
    """Triples in which each class is a relation of its own, named 'class:<c>' (or `name`), in place of the type relation; with
    more than `limit` classes the type relation is dropped instead, and pairs with classes are not known."""
    types = triples.where(F.col("p") == type_name)
    rest = triples.where(F.col("p") != type_name)
    if types.select("o").distinct().limit(limit + 1).count() > limit:
        return rest
    return rest.unionByName(types.select("s", (F.concat(F.lit(CLASS), F.col("o").cast("string")) if name is None else name).alias("p"), "o"))


def collect_stats(triples: DataFrame, type_name: str, pairs: bool = True, limit: int = TYPE_LIMIT) -> Stats:
    """All statistics to the driver: one row per predicate, class and pair of them, not per triple. A store keeps them as
    tables instead, and reads what a query needs."""
    props = {r["p"]: Property(r["n"], r["distinct_s"], r["distinct_o"]) for r in property_stats(triples).collect()}
    classes = {r["class"]: (r["n"], r["min_s"], r["max_s"]) for r in class_stats(triples.where(F.col("p") == type_name)).collect()}
    sizes = {(r["p1"], r["p2"], r["kind"]): r["n"] for r in pair_sizes(with_classes(triples, type_name, limit)).collect()} if pairs else {}
    return Stats(props, sizes, classes, True, pairs and len(classes) <= limit)


def fingerprint(triples: DataFrame) -> str:
    """Changes when the triples do; order does not matter."""
    n, x, total = triples.agg(F.count("*"), F.bit_xor(F.xxhash64("s", "p", "o")), F.sum(F.xxhash64("o", "p", "s").cast("decimal(38,0)"))).first()
    return f"{n}-{x}-{total}"


def save(spark: SparkSession, stats: Stats, path: str, mark: str = "") -> None:
    """The statistics as a JSON file, on any file system of the cluster."""
    write_text(spark, path, json.dumps({"fingerprint": mark, "typed": stats.typed, "paired": stats.paired, "properties": {k: [v.count, v.distinct_s, v.distinct_o] for k, v in stats.properties.items()}, "pairs": [[*k, v] for k, v in stats.pairs.items()], "classes": {k: list(v) for k, v in stats.classes.items()}}))


def load(spark: SparkSession, path: str, mark: str | None = None) -> Stats | None:
    """The saved statistics; None where there are none or their fingerprint is another."""
    text = read_text(spark, path)
    if text is None:
        return None
    x = json.loads(text)
    if mark is not None and x["fingerprint"] != mark:
        return None
    return Stats({k: Property(*v) for k, v in x["properties"].items()}, {(a, b, k): n for a, b, k, n in x["pairs"]}, {k: tuple(v) for k, v in x["classes"].items()}, x["typed"], x["paired"])


def merge(a: Stats, b: Stats) -> Stats:
    """Entries of both; b's where both have one."""
    return Stats(a.properties | b.properties, a.pairs | b.pairs, a.classes | b.classes, a.typed and b.typed, a.paired and b.paired)


@dataclass(frozen=True)
class Histogram:
    """One bucket: values from low to high, `distinct` of them, each `freq` times."""

    low: float
    high: float
    freq: float
    distinct: float

    @property
    def rows(self) -> float:
        return self.freq * self.distinct

    def equal(self, v: float) -> Histogram:
        return Histogram(v, v, self.freq, 1) if self.low <= v <= self.high and self.distinct else Histogram(v, v, 0, 0)

    def not_equal(self, v: float) -> Histogram:
        return Histogram(self.low, self.high, self.freq, max(self.distinct - self.equal(v).distinct, 0))

    def between(self, low: float, high: float) -> Histogram:
        a, b = max(low, self.low), min(high, self.high)
        if a > b or not self.distinct:
            return Histogram(low, high, 0, 0)
        share = (b - a) / (self.high - self.low) if self.high > self.low else 1.0
        return Histogram(a, b, self.freq, self.distinct * share)

    def less(self, v: float) -> Histogram:
        return self.between(self.low, v)

    def greater(self, v: float) -> Histogram:
        return self.between(v, self.high)

    def join(self, other: Histogram) -> Histogram:
        a, b = self.between(other.low, other.high), other.between(self.low, self.high)
        return Histogram(max(self.low, other.low), min(self.high, other.high), a.freq * b.freq, min(a.distinct, b.distinct))

    def range_join_rows(self, other: Histogram) -> float:
        """Estimated pairs with a value of self at most one of other, both spread evenly."""
        steps = 100
        values = [other.low + (other.high - other.low) * (i + 0.5) / steps for i in range(steps)]
        return sum(self.less(v).rows if v < self.high else self.rows for v in values) / steps * other.rows if other.distinct else 0.0

    def combine(self, other: Histogram) -> Histogram:
        distinct = max(self.distinct, other.distinct)
        return Histogram(min(self.low, other.low), max(self.high, other.high), (self.rows + other.rows) / distinct if distinct else 0, distinct)
