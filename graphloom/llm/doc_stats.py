"""Word, line and symbol statistics of whole texts, for the quality operators."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut, types_of

#: The characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
DIGITS = b"0123456789"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_bangs", "n_distinct_words", "n_lines")


def repeated_words(words: list[bytes]) -> int:
    """How many words stand in a 3-word window that the text holds twice or more, the first included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    n, upto = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            n += i + 3 - max(i, upto)
            upto = i + 3
    return n


def text_stats(text: str | None) -> tuple[int, ...]:
    """STATS of one text; a null text counts as empty."""
    s = text or ""
    b = s.encode("utf-8", "surrogatepass")
    without = lambda drop: len(b) - len(b.translate(None, drop))
    words = b.split()
    lines = [x for x in b.split(b"\n") if x.strip()]
    return (len(words), len(s) - without(SPACES), without(SYMBOLS), len(lines) - len(set(lines)), repeated_words(words), without(UPPER), without(DIGITS), b.count(b"!!"), len(set(words)), len(lines))


def with_stats(rows: DataFrame) -> DataFrame:
    """row__ and STATS of the whole text of every row of rows (row__, text__). Only the text goes to Python."""

    @F.arrow_udf(types_of(", ".join(f"{s} long" for s in STATS)))
    def stats(texts: pa.Array) -> pa.Array:
        made = [text_stats(t) for part in cut(pa.RecordBatch.from_arrays([texts], names=["t"])) for t in part.column(0).to_pylist()]
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in zip(*made, strict=True)] if made else [pa.array([], pa.int64())] * len(STATS), names=list(STATS))

    # not deterministic for the optimizer, so that no filter computes it again
    return rows.select("row__", stats.asNondeterministic()("text__").alias("s")).select("row__", "s.*")
