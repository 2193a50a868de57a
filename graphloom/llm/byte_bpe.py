"""Byte-level BPE: ranked merges folded over the byte arrays of distinct words.

A word's bytes become an array of token ids; each step looks up the merged id of every adjacent pair and joins the
pair of least rank, leftmost first, until no pair has one. The rank map is a perfect hash in two arrays, so a lookup is
two array reads and some arithmetic.

`fold` says this in Spark's higher-order functions, for tables of words (`Codec.fold_words`). Over whole corpora its
interpreted steps cost more than the time there is (figures in the README), so `Codec.encode` takes the same steps for all
new words of one length at once, in array operations: a worker numbers its words as they come, folds each once, and
puts texts together by number. Its table of words is bounded; frequent ones stay. Nothing is shuffled or sent to the driver; decoding concatenates the tokens' byte strings.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut, record, releasing, text_of, types_of, whole_row, worker_memo, written
from graphloom.llm.word_table import Numbers, WordTable, gather, in_order

#: Distinct words that a worker keeps, and bytes beyond which a word is merged by itself.
WORDS, LONG = 500_000, 256


def load_ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


#: Multipliers of the perfect hash: (l * A + r * B + d * (l * C + r * D + 1)) mod size, d by (l * E + r) mod buckets.
A, B, C, D, E = 100_003, 7_919, 611, 953, 8_191
#: Bits of a token id.
ID = 17


def prime_from(n: int) -> int:
    while any(n % i == 0 for i in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def rank_map(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """A perfect hash of all pairs (l, r) of tokens that make a token m: displacements d by bucket, and entries
    (l << ID | r) << ID | m by place, -1 elsewhere. Fuller buckets choose their displacement first."""
    pairs = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                pairs[left, right] = rank
    size, n = prime_from(len(pairs) * 3 // 2 + 2), prime_from(len(pairs) // 4 + 2)
    shift, entries = np.zeros(n, np.int64), np.full(size, -1, np.int64)
    buckets: dict[int, list[tuple[int, int]]] = {}
    for left, right in pairs:
        buckets.setdefault((left * E + right) % n, []).append((left, right))
    taken = bytearray(size)
    for g, members in sorted(buckets.items(), key=lambda x: (-len(x[1]), x[0])):
        hashes, d = [(x * A + y * B, x * C + y * D + 1) for x, y in members], 0
        while len(places := {(h + d * k) % size for h, k in hashes}) < len(members) or any(taken[i] for i in places):
            d += 1
        shift[g] = d
        for (x, y), (h, k) in zip(members, hashes, strict=True):
            taken[(h + d * k) % size] = 1
            entries[(h + d * k) % size] = (x << ID | y) << ID | pairs[x, y]
    return shift, entries


def literal(values: np.ndarray, kind: str) -> Column:
    """An array literal, folded once by the optimizer, from JSON: far fewer calls than one literal per element."""
    return F.from_json(F.lit("[" + ",".join(map(str, values.tolist())) + "]"), f"array<{kind}>")


def spell(word: Column, table: Column) -> Column:
    """The byte tokens (array<bigint>) of a binary word; table: the token of each byte."""
    return F.transform(F.filter(F.split(F.decode(word, "ISO-8859-1"), ""), lambda c: c != ""), lambda c: F.element_at(table, F.ascii(c) + 1))


def fold(ids: Column, shift: Column, shifts: int, entries: Column, places: int) -> Column:
    """The BPE tokens (array<bigint>) of an array<bigint> of byte tokens.

    The state holds the tokens between two marks, the merged id of every adjacent pair (above NONE - 1 where there is
    none), and the least of these. A step replaces the leftmost pair of the least and looks up only the two new pairs.
    """
    none, mark = F.lit(1 << 62), F.lit((1 << ID) - 1).cast("bigint")
    bind = lambda x, use: F.element_at(F.transform(F.array(x), use), 1)  # noqa: E731  computes x once

    def merged(left: Column, right: Column) -> Column:
        """The merged id, or a number of more than ID bits where the pair has none."""
        d = F.element_at(shift, ((left * E + right) % shifts + 1).cast("int"))
        at = (left * A + right * B + d * (left * C + right * D + 1)) % places
        # an empty place reads -1, so the result is negative: without its sign it is far above every id
        return F.element_at(entries, (at + 1).cast("int")).bitwiseXOR(F.shiftleft(F.shiftleft(left, ID).bitwiseOR(right), ID)).bitwiseAND(F.lit((1 << 62) - 1))

    def state(tokens: Column, pairs: Column) -> Column:
        return bind(pairs, lambda p: F.struct(tokens.alias("tokens"), p.alias("pairs"), F.array_min(p).alias("least")))

    def step(s: Column, _: Column) -> Column:
        tokens, pairs, least = s["tokens"], s["pairs"], s["least"]

        def join(at: Column) -> Column:
            # before the first and behind the last token stands a mark, which no pair holds, so `at` is never an end
            new = F.concat(F.slice(tokens, F.lit(1), at - 1), F.array(least), F.slice(tokens, at + 2, F.size(tokens)))
            around = F.array(merged(F.element_at(tokens, at - 1), least), merged(least, F.element_at(tokens, at + 2)))
            return state(new, F.concat(F.slice(pairs, F.lit(1), at - 2), around, F.slice(pairs, at + 2, F.size(pairs))))

        return F.when(least >= 1 << ID, s).otherwise(bind(F.array_position(pairs, least).cast("int"), join))

    def start(tokens: Column) -> Column:
        return state(tokens, F.zip_with(F.slice(tokens, F.lit(1), F.size(tokens) - 1), F.slice(tokens, F.lit(2), F.size(tokens)), merged))

    marked = F.concat(F.array(mark), ids, F.array(mark))
    whole = bind(marked, lambda t: F.aggregate(F.sequence(F.lit(2), F.size(t) - 2), start(t), step, lambda s: F.slice(s["tokens"], F.lit(2), F.size(s["tokens"]) - 2)))
    return F.when(F.size(ids) < 2, ids).otherwise(whole)


class Words:
    """Splits a text into the pattern's matches. Matches never cross a lone space between two other characters, so
    such texts split there first, and each chunk's matches are looked up, not found again."""

    def __init__(self, pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        self.blanks = regex.compile(r"\s\s").search

    def chunks(self, text: str) -> list[str] | None:
        """The chunks, all but the first to be read with a space before; None where the text needs one search throughout."""
        if not text or self.blanks(text):
            return None
        parts = text.split(" ")
        return None if not parts[0] or not parts[-1] else parts


class Chunks(dict):
    """The words' numbers, as bytes, of each chunk read after a space."""

    def __init__(self, numbers: Numbers, find):
        self.numbers, self.find = numbers, find

    def __missing__(self, chunk: str) -> bytes:
        out = self[chunk] = self.of(" " + chunk)
        return out

    def of(self, text: str) -> bytes:
        return np.fromiter(map(self.numbers.__getitem__, self.find(text)), "<u4").tobytes()


class Merger:
    """The fold over many words at once. shift, entries: the rank map; table: the token of each byte."""

    def __init__(self, shift: np.ndarray, entries: np.ndarray, table: np.ndarray):
        self.shift, self.entries, self.table = shift, entries, table

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged id of each pair; above all ids where there is none."""
        d = self.shift[(left * E + right) % len(self.shift)]
        e = self.entries[(left * A + right * B + d * (left * C + right * D + 1)) % len(self.entries)]
        return np.where(e >> ID == (left << ID | right), e & ((1 << ID) - 1), 1 << ID)

    def fold(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of the words, one after the other, and how many each has."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order, out = np.argsort(lengths, kind="stable"), []
        for group in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
            if not len(group) or not lengths[group[0]]:
                continue
            if lengths[group[0]] > LONG:
                for i in group.tolist():
                    tokens = self.fold_long(words[i])
                    out.append((np.array([i]), tokens, np.array([len(tokens)])))
                continue
            raw = np.frombuffer(b"".join([words[i] for i in group.tolist()]), np.uint8)
            tokens = self.table[raw].reshape(len(group), -1)
            pairs = self.merged(tokens[:, :-1], tokens[:, 1:])
            # every row that is left joins one pair a step, so all rows have one width
            while len(group):
                width = tokens.shape[1]
                at = pairs.argmin(axis=1) if width > 1 else np.zeros(len(group), np.int64)
                least = pairs[np.arange(len(group)), at] if width > 1 else np.full(len(group), 1 << ID)
                done = least >= 1 << ID
                out.append((group[done], tokens[done].reshape(-1), np.full(int(done.sum()), width)))
                group, at, least = group[~done], at[~done], least[~done]
                if not len(group):
                    break
                rows, tokens, pairs = np.arange(len(group)), tokens[~done], pairs[~done]
                columns = np.arange(width - 1)
                tokens = np.take_along_axis(tokens, columns + (columns > at[:, None]), axis=1)
                tokens[rows, at] = least
                columns = columns[:-1]
                pairs = np.take_along_axis(pairs, columns + (columns >= at[:, None]), axis=1)
                before, after = rows[at > 0], rows[at < width - 2]
                pairs[before, at[before] - 1] = self.merged(tokens[before, at[before] - 1], least[before])
                pairs[after, at[after]] = self.merged(least[after], tokens[after, at[after] + 1])
        return in_order(out, len(words))

    def fold_long(self, word: bytes) -> np.ndarray:
        """The same for one word, by a heap of its pairs: in time that grows with n log n."""
        import heapq

        tokens = self.table[np.frombuffer(word, np.uint8)].tolist()
        n, none = len(tokens), 1 << ID
        one = lambda a, b: int(self.merged(np.array([a]), np.array([b]))[0])
        first = self.merged(np.array(tokens[:-1], np.int64), np.array(tokens[1:], np.int64)).tolist()
        heap = [(r, i) for i, r in enumerate(first) if r < none]
        heapq.heapify(heap)
        now, before, after = dict(enumerate(first)), list(range(-1, n - 1)), list(range(1, n + 1))
        while heap:
            r, i = heapq.heappop(heap)
            if now.get(i) != r:
                continue
            j = after[i]
            tokens[i], after[i] = r, after[j]
            now.pop(j, None)
            tokens[j] = -1
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n:
                    now[a] = one(tokens[a], tokens[after[a]])
                    if now[a] < none:
                        heapq.heappush(heap, (now[a], a))
                else:
                    now.pop(a, None)
        return np.array([t for t in tokens if t >= 0], np.int64)


class Encoder:
    """What a worker keeps from task to task: words by number, their tokens, and the tokens' byte strings."""

    def __init__(self, merger: Merger, ranks: dict[bytes, int], pattern: str, limit: int):
        self.merger, self.ranks, self.words = merger, ranks, Words(pattern)
        ids, pieces = np.array(list(ranks.values())), list(ranks)
        self.blob = np.frombuffer(b"".join(pieces), np.uint8)
        self.size, self.begin = (np.zeros(int(ids.max()) + 1, np.int64) for _ in range(2))
        self.size[ids] = list(map(len, pieces))
        self.begin[ids] = np.cumsum(self.size[ids]) - self.size[ids]
        self.table = WordTable(self.tokens, limit)
        self.chunks = Chunks(self.table.numbers, self.words.find)

    def tokens(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A word that is a token is that token; others fold."""
        spelled = [w.encode("utf-8", "surrogatepass") for w in words]
        ids = np.fromiter((self.ranks.get(w, -1) for w in spelled), np.int64, len(words))
        whole, rest = np.flatnonzero(ids >= 0), np.flatnonzero(ids < 0)
        folded, lengths = self.merger.fold([spelled[i] for i in rest.tolist()])
        return in_order([(whole, ids[whole], np.ones(len(whole), np.int64)), (rest, folded, lengths)], len(words))

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """The ids of each text, little-endian unsigned 32-bit, and what they decode to."""
        if self.table.make_room():
            self.chunks = Chunks(self.table.numbers, self.words.find)
        drafts = []
        for text in texts:
            parts = self.words.chunks(text)
            if parts is None:
                drafts.append(np.frombuffer(self.chunks.of(text), "<u4"))
            else:
                drafts.append(np.frombuffer(b"".join([self.chunks.of(parts[0]), *map(self.chunks.__getitem__, parts[1:])]), "<u4"))
        self.table.settle(drafts)
        ids_out, bytes_out = [], []
        for draft in drafts:
            ids = self.table.of(draft)
            ids_out.append(ids.astype("<u4", copy=False).tobytes())
            bytes_out.append(gather(self.blob, self.begin[ids], self.size[ids]).tobytes())
        return ids_out, bytes_out


class Codec:
    """A byte-level BPE of the file at `path` and its pattern of words."""

    def __init__(self, spark, path: str, pattern: str):
        self.spark, self.pattern, self.ranks = spark, pattern, load_ranks(path)
        self.shift, self.entries = rank_map(self.ranks)
        self.table = np.array([self.ranks[bytes([b])] for b in range(256)])

    def fold_words(self, words: DataFrame) -> DataFrame:
        """(word, ids array<bigint>) of (word binary), in DataFrame functions alone."""
        ids = fold(spell(F.col("word"), literal(self.table, "bigint")), literal(self.shift, "bigint"), len(self.shift), literal(self.entries, "bigint"), len(self.entries))
        return words.select("word", ids.alias("ids"))

    def encode(self, rows: DataFrame, limit: int = WORDS) -> DataFrame:
        """row__, ids (binary: little-endian unsigned 32-bit) and bytes (what the ids decode to) of every row of rows (row__, text__)."""
        pattern, model = self.pattern, self.spark.sparkContext.broadcast((self.shift, self.entries, self.table, self.ranks))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kinds = pa.schema([("row__", pa.null()), ("ids", pa.binary()), ("bytes", pa.binary())])
            shift, entries, table, ranks = model.value
            held = worker_memo(f"bpe-{zlib.crc32(repr((pattern, limit, len(ranks))).encode() + entries.tobytes())}")
            if not held:
                held["encoder"] = Encoder(Merger(shift, entries, table), ranks, pattern, limit)
            for batch in batches:
                for part in cut(batch):
                    ids, data = held["encoder"].encode(part.column("text__").to_pylist())
                    yield record({"row__": part.column("row__"), "ids": ids, "bytes": data}, kinds)

        return rows.mapInArrow(releasing(run), types_of("ids binary, bytes binary", rows))


def tokenize(docs: DataFrame, path: str, pattern: str, **options) -> DataFrame:
    """row__ (the row of docs, as a struct), ids (binary) and bytes (what the ids decode to) of every row of docs.

    Null and empty texts have no ids. Rows come back one for one, repeated or not; docs may have columns of any name
    beside text. A very long word costs time in proportion to n log n.
    """
    return Codec(docs.sparkSession, path, pattern).encode(docs.select(whole_row(), text_of().alias("text__")), **options)


def op9_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to."""
    import public_tokenizers as tokenizers

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.struct("doc_id").alias("row__"), text_of().alias("text__"))
    out = Codec(spark, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN).encode(rows)
    return written(spark, "digests", lambda: out.select("row__.doc_id", F.expr("cast(length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256")))
