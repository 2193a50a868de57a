"""Ids that are computed from table keys, so that no join with a dictionary encodes or decodes a resource.

The terms '<base><kind>/<key>' of a kind stand together in the order of all texts. Each kind has a slot of ids, and so has each gap
between kinds, for the other texts that stand there. In a kind's slot a key's id is its digits filled up with zeros, then their
number: the order of digits as text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Most digits of a key, and the bits of a slot.
DIGITS, BITS = 15, 54


class KeyedIds:
    def __init__(self, base: str, kinds: set[str]):
        self.base, self.kinds = base, sorted(kinds, key=lambda k: f"{base}{k}/".encode())

    def fits(self, key: Column) -> Column:
        return (key >= 0) & (key < 10**DIGITS)

    def own(self, text: Column) -> Column:
        """Whether a text stands among a kind's."""
        return reduce(lambda a, b: a | b, (text.startswith(f"{self.base}{k}/") for k in self.kinds))

    def gap(self, text: Column) -> Column:
        """The least id of the gap of a text that is no kind's."""
        before = reduce(lambda a, b: a + b, ((text >= f"{self.base}{k}/").cast("bigint") for k in self.kinds))
        return before * (2 << BITS)

    def of_key(self, kind: Column, key: Column) -> Column:
        n = F.length(key.cast("string"))
        fill = F.element_at(F.array(*(F.lit(10 ** (DIGITS - i) * 16).cast("bigint") for i in range(1, DIGITS + 1))), n)
        slot = F.element_at(F.array(*(F.lit((2 * i + 1) << BITS) for i in range(len(self.kinds)))), F.array_position(F.array(*map(F.lit, self.kinds)), kind).cast("int"))
        return slot + key * fill + n

    def is_key(self, id_: Column) -> Column:
        return F.shiftright(id_, BITS).bitwiseAND(F.lit(1)) == 1

    def text(self, id_: Column) -> Column:
        """The text of a key's id; null for others."""
        low = id_.bitwiseAND(F.lit((1 << BITS) - 1))
        fill = F.element_at(F.array(*(F.lit(10 ** (DIGITS - i)).cast("bigint") for i in range(1, DIGITS + 1))), F.greatest(low.bitwiseAND(F.lit(15)), F.lit(1).cast("bigint")).cast("int"))
        digits = F.call_function("div", F.shiftright(low, 4), fill).cast("string")
        prefix = F.element_at(F.array(*(F.lit(f"{self.base}{k}/") for k in self.kinds)), (F.shiftright(id_, BITS + 1) + 1).cast("int"))
        return F.when(self.is_key(id_), F.concat(prefix, digits))
