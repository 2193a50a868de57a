"""Triples from tables, from N-Triples text, and query files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.parser import RDF_TYPE
from graphloom.sources.terms import KeyTerms

EX = "http://example.org/"
#: Prefixes of the example graph, as query text.
PREFIXES = f"PREFIX ex: <{EX}> "


#: Predicate -> (table, subject kind, subject key, object as (kind, key) or a string column), of the example graph.
MAPPING: dict[str, list[tuple]] = {
    RDF_TYPE: [(t, k, key, ("class", c)) for t, k, key, c in (("region", "region", "r_regionkey", "Region"), ("nation", "nation", "n_nationkey", "Nation"), ("customer", "customer", "c_custkey", "Customer"), ("supplier", "supplier", "s_suppkey", "Supplier"), ("part", "part", "p_partkey", "Part"), ("orders", "order", "o_orderkey", "Order"), ("events", "event", "event_id", "Event"))],
    f"{EX}name": [("region", "region", "r_regionkey", "r_name"), ("nation", "nation", "n_nationkey", "n_name"), ("customer", "customer", "c_custkey", "c_name"), ("supplier", "supplier", "s_suppkey", "s_name")],
    f"{EX}partOf": [("nation", "nation", "n_nationkey", ("region", "n_regionkey"))],
    f"{EX}locatedIn": [("customer", "customer", "c_custkey", ("nation", "c_nationkey")), ("supplier", "supplier", "s_suppkey", ("nation", "s_nationkey"))],
    f"{EX}segment": [("customer", "customer", "c_custkey", "c_mktsegment")],
    f"{EX}brand": [("part", "part", "p_partkey", "p_brand")],
    f"{EX}placedBy": [("orders", "order", "o_orderkey", ("customer", "o_custkey"))],
    f"{EX}status": [("orders", "order", "o_orderkey", "o_orderstatus")],
    f"{EX}containsPart": [("lineitem", "order", "l_orderkey", ("part", "l_partkey"))],
    f"{EX}suppliedBy": [("lineitem", "order", "l_orderkey", ("supplier", "l_suppkey"))],
    f"{EX}performedBy": [("events", "event", "event_id", ("customer", "user_id"))],
}


KINDS = {k for parts in MAPPING.values() for _, k, _, o in parts for k in (k, *(o[:1] if isinstance(o, tuple) and o[0] != "class" else ()))}
TERMS = KeyTerms(EX, KINDS)


def mapped_tables(spark: SparkSession, folder: str, repeats: bool = False) -> dict[str, DataFrame]:
    """The example graph as one (s, o) DataFrame of KeyTerms per predicate, each read from its own tables and columns only.
    repeats: for who drops repeated triples later, leave them in."""

    def one(table: str, kind: str, key: str, o) -> DataFrame:
        if isinstance(o, tuple):
            obj = TERMS.literal(F.lit(EX + o[1])) if o[0] == "class" else TERMS.resource(o[0], F.col(o[1]))
        else:
            obj = TERMS.literal(F.col(o))
        used = [key] + ([o] if isinstance(o, str) else [o[1]] if o[0] != "class" else [])
        rows = spark.read.parquet(f"{folder}/{table}.parquet").select(*dict.fromkeys(used)).dropna()
        # a key's row is one triple; line items repeat their orders' facts
        rows = rows.distinct() if table == "lineitem" and not repeats else rows
        return rows.select(TERMS.resource(kind, F.col(key)).alias("s"), obj.alias("o"))

    out = {}
    for p, parts in MAPPING.items():
        df = one(*parts[0])
        for part in parts[1:]:
            df = df.unionByName(one(*part))
        out[p] = df
    return out


def from_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The same graph in texts."""
    return {p: df.select(TERMS.text(F.col("s")).alias("s"), TERMS.text(F.col("o")).alias("o")) for p, df in mapped_tables(spark, folder).items()}


def as_triples(by_property: dict[str, DataFrame]) -> DataFrame:
    """(s, p, o) of all relations."""
    out = None
    for p, df in by_property.items():
        rows = df.select("s", F.lit(p).alias("p"), "o")
        out = rows if out is None else out.unionByName(rows)
    return out


def by_property(triples: DataFrame, names: list[str] | None = None) -> dict[str, DataFrame]:
    """One (s, o) DataFrame per predicate of (s, p, o) rows, as set. names: the predicates, if known."""
    triples = triples.select("s", "p", "o").distinct()
    names = names if names is not None else [r["p"] for r in triples.select("p").distinct().collect()]
    return {p: triples.where(F.col("p") == p).select("s", "o") for p in names}


LINE = r'^\s*<([^>]*)>\s+<([^>]*)>\s+(?:<([^>]*)>|"((?:[^"\\]|\\.)*)"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*\.\s*(?:#.*)?$'
#: The pieces of an escaped text: escapes by code point, escapes by one character, and what lies between.
PIECES = r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+"
#: The one-letter escapes.
LETTERS = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


def unescaped(text: Column) -> Column:
    """A text's escapes undone, in one pass over its pieces."""

    def one(piece: Column) -> Column:
        code, rest = F.substring(piece, 2, 1), piece.substr(F.lit(3), F.length(piece))
        out = F.when(code.isin("u", "U") & (F.length(piece) > 2), F.decode(F.unhex(F.lpad(rest, 8, "0")), "UTF-32"))
        for letter, char in LETTERS.items():
            out = out.when(code == letter, F.lit(char))
        return F.when(piece.startswith("\\"), out.otherwise(code)).otherwise(piece)

    return F.when(F.contains(text, F.lit("\\")), F.array_join(F.transform(F.regexp_extract_all(text, F.lit(PIECES), 0), one), "")).otherwise(text)


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o) of an N-Triples file or folder. Literals lose type and language; blank nodes and malformed lines are errors."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    part = lambda i: unescaped(F.regexp_extract("value", LINE, i))
    bad = F.raise_error(F.concat(F.lit("not a triple of IRIs and literals: "), F.col("value")))
    return lines.select(
        F.when(F.col("value").rlike(LINE), part(1)).otherwise(bad.cast("string")).alias("s"),
        part(2).alias("p"),
        F.when(F.regexp_extract("value", LINE, 3) != "", part(3)).otherwise(part(4)).alias("o"),
    ).distinct()


def read_queries(path: str, least: int = 30) -> list[str]:
    """Queries of a file, one a line; lines under `least` characters are skipped."""
    with open(path) as f:
        return [x.strip() for x in f if len(x.strip()) >= least]
