"""How the values in a graph's columns stand for terms: as their text, as a table's key, or as an id of the store."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class TextTerms:
    """Terms as they are."""

    #: Whether getting at texts joins a dictionary (and so loses an order).
    joins = False
    #: Whether the values stand in the order of their texts.
    ordered = True

    def bounds(self, texts: list[str]) -> dict[str, object]:
        """What `compare` needs to know of each constant."""
        return {t: t for t in texts}

    def compare(self, col: Column, op: str, bound: object) -> Column:
        """col op constant, where values are ordered; null where the column is."""
        return {"<": col < bound, "<=": col <= bound, ">": col > bound, ">=": col >= bound}[op]

    def encode(self, texts: list[str]) -> dict[str, object]:
        """The value of each constant; None where the graph cannot hold it."""
        return {t: t for t in texts}

    def equals(self, col: Column, value: object) -> Column:
        """Whether a column holds the constant of this value (null where the column is)."""
        return col == F.lit(value) if value is not None else F.when(col.isNotNull(), F.lit(False))

    def with_texts(self, rows: DataFrame, columns: dict[str, str]) -> DataFrame:
        """rows with the texts of columns under new names (column -> name)."""
        return rows.withColumns({new: F.col(c) for c, new in columns.items()})


class KeyTerms(TextTerms):
    """Resources of tables as struct<kind, key, text>: kind and key of '<base><kind>/<key>', or any other text.

    A constant compares field by field, so that a scan gets the key as a pushed filter and tables of another kind fall away.
    """

    ordered = False

    def __init__(self, base: str, kinds: set[str]):
        self.base, self.kinds = base, kinds

    @staticmethod
    def resource(kind: str, key: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.cast("bigint").alias("key"), F.lit(None).cast("string").alias("text"))

    @staticmethod
    def literal(text: Column) -> Column:
        return F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("bigint").alias("key"), text.cast("string").alias("text"))

    def encode(self, texts: list[str]) -> dict[str, object]:
        def one(text: str):
            m = re.fullmatch(re.escape(self.base) + r"(\w+)/(0|-?[1-9]\d{0,17})", text)
            return (m[1], int(m[2])) if m and m[1] in self.kinds else text

        return {t: one(t) for t in texts}

    def equals(self, col: Column, value: object) -> Column:
        if isinstance(value, tuple):
            return F.coalesce((col["kind"] == value[0]) & (col["key"] == value[1]), F.when(col.isNotNull(), F.lit(False)))
        return F.coalesce(col["text"] == value, F.when(col.isNotNull(), F.lit(False)))

    def matches(self, col: Column, value: object) -> Column:
        """`equals` where null may be false, as in a scan: plain comparisons that reach the tables."""
        return (col["kind"] == value[0]) & (col["key"] == value[1]) if isinstance(value, tuple) else col["text"] == value

    def text(self, col: Column) -> Column:
        return F.coalesce(col["text"], F.concat(F.lit(self.base), col["kind"], F.lit("/"), col["key"].cast("string")))

    def with_texts(self, rows: DataFrame, columns: dict[str, str]) -> DataFrame:
        return rows.withColumns({new: self.text(F.col(c)) for c, new in columns.items()})
