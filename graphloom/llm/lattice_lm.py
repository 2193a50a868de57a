"""Language-model scores from a subword lattice.

The pieces of an existing vocabulary, started from its scores, form a unigram model; a text's probability is the sum
over all its segmentations into pieces (a forward recursion in log space), so no single segmentation is preferred. No
piece crosses white space, so the sum is a product over words, and every distinct word needs one lattice; the end of a text
is a token of its own. The vocabulary stays as it is; its pieces' probabilities are learned on the training
documents by expectation maximisation over their words. An add-one word unigram is scored beside it.

Texts are read once: a task turns its documents into blocks, each a dictionary of distinct words and, per document,
compressed indices into it. Dictionary rows meet by word, where they are counted and scored, and go back to their
blocks. Lattices are computed for many words of one length at once. Nothing that grows with the corpus is broadcast
or sent to the driver: the model has the size of the vocabulary.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import Scratch, cut, fraction_crc32, record, text_of, types_of, written

#: A block closes at so many distinct words; a document never spans blocks.
BLOCK_DISTINCT = 400_000
#: Words scored together at most, and cells (words by length) of one lattice array.
TOGETHER, CELLS = 1 << 16, 1 << 17
ROUNDS, PRIOR_MASS = 2, 2_000.0
START = "▁"


@dataclass(frozen=True)
class Trie:
    """The pieces by their characters: keys (node << 21 | code point, ascending) lead to the node in `to`; piece: its
    number at the node that ends it, else -1."""

    keys: np.ndarray
    to: np.ndarray
    piece: np.ndarray

    def plain(self) -> tuple:
        """The fields, for a broadcast (which pickles by reference)."""
        return self.keys, self.to, self.piece

    @classmethod
    def of(cls, pieces: list[str]) -> Trie:
        step: dict[int, int] = {}
        ends = {}
        for number, p in enumerate(pieces):
            node = 0
            for c in p:
                node = step.setdefault(node << 21 | ord(c), len(step) + 1)
            ends[node] = number
        piece = np.full(len(step) + 1, -1, np.int64)
        piece[list(ends)] = list(ends.values())
        keys = np.array(sorted(step), np.int64)
        return cls(keys, np.array([step[k] for k in keys.tolist()], np.int64), piece)


@dataclass(frozen=True)
class Model:
    """Natural-log probabilities of the pieces (by number), of the 256 byte pieces, and of a text's end."""

    pieces: np.ndarray
    bytes_: np.ndarray
    end: float


class Lattice:
    """All segmentations of words of one length: arcs from a start over a piece, or over a character spelled in bytes.

    chars: (words, length) code points, START first. The arrays take about 200 bytes a character.
    """

    def __init__(self, chars: np.ndarray, trie: Trie, model: Model):
        n, size = self.shape = chars.shape
        flat = chars.reshape(-1).astype(np.int64)
        self.kinds, self.kind = np.unique(flat, return_inverse=True)
        self.spelled = [chr(c).encode("utf-8", "surrogatepass") for c in self.kinds.tolist()]
        self.by_bytes = np.array([model.bytes_[list(b)].sum() for b in self.spelled])[self.kind].reshape(n, size)
        self.arcs: list[tuple[np.ndarray, np.ndarray]] = []  # by length: cells (word * size + start), pieces
        at, node = np.arange(n * size), np.zeros(n * size, np.int64)
        room = size - at % size
        while len(at):
            m = len(self.arcs)
            inside = room > m
            at, node, room = at[inside], node[inside], room[inside]
            key = node << 21 | flat[at + m]
            i = np.minimum(np.searchsorted(trie.keys, key), len(trie.keys) - 1) if len(trie.keys) else np.zeros(len(key), np.int64)
            hit = trie.keys[i] == key if len(trie.keys) else np.zeros(len(key), bool)
            at, node, room = at[hit], trie.to[i[hit]], room[hit]
            piece = trie.piece[node]
            self.arcs.append((at[piece >= 0], piece[piece >= 0]))
        # log probability by length of the arc and start; a character's bytes join the arcs of length 1
        self.weight = np.full((max(1, len(self.arcs)), n, size), -np.inf)
        for m, (cells, piece) in enumerate(self.arcs):
            self.weight[m].reshape(-1)[cells] = model.pieces[piece]
        np.logaddexp(self.weight[0], self.by_bytes, out=self.weight[0])
        self.model = model

    def forward(self) -> np.ndarray:
        """(words, length + 1): log sums over all segmentations up to each position."""
        n, size = self.shape
        alpha = np.zeros((n, size + 1))
        for j in range(1, size + 1):
            alpha[:, j] = log_sum(np.stack([alpha[:, j - m] + self.weight[m - 1][:, j - m] for m in range(1, min(j, len(self.weight)) + 1)]))
        return alpha

    def expect(self, times: np.ndarray, pieces: np.ndarray, bytes_: np.ndarray) -> None:
        """Add the expected uses of each piece and byte in `times` occurrences of each word."""
        n, size = self.shape
        alpha, beta = self.forward(), np.zeros((n, size + 1))
        for i in range(size - 1, -1, -1):
            beta[:, i] = log_sum(np.stack([self.weight[m - 1][:, i] + beta[:, i + m] for m in range(1, min(size - i, len(self.weight)) + 1)]))
        rest = alpha[:, :size] - alpha[:, size:]
        for m, (cells, piece) in enumerate(self.arcs, 1):
            word, start = cells // size, cells % size
            pieces += np.bincount(piece, times[word] * np.exp(rest[word, start] + self.model.pieces[piece] + beta[word, start + m]), len(pieces))
        spelled = times[:, None] * np.exp(rest + self.by_bytes + beta[:, 1:])
        for b, uses in zip(self.spelled, np.bincount(self.kind.reshape(-1), spelled.reshape(-1), len(self.kinds)), strict=True):
            np.add.at(bytes_, list(b), uses)


def log_sum(terms: np.ndarray) -> np.ndarray:
    top = terms.max(axis=0)
    return top + np.log(np.exp(terms - top).sum(axis=0))


def lattices(words: list[str], trie: Trie, model: Model) -> Iterator[tuple[np.ndarray, Lattice]]:
    """(which words, their lattice), by length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for group in np.split(order, cuts):
        size = int(lengths[group[0]]) if len(group) else 1
        per = max(1, CELLS // size)
        for at in range(0, len(group), per):
            which = group[at : at + per]
            text = "".join([START + words[i] for i in which.tolist()])
            yield which, Lattice(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(which), size), trie, model)


def word_scores(words: list[str], trie: Trie, model: Model) -> np.ndarray:
    """Log probability of each word: all segmentations of START + word."""
    out = np.zeros(len(words))
    for which, lattice in lattices(words, trie, model):
        out[which] = lattice.forward()[:, -1]
    return out


def vocabulary(path: str) -> dict[str, float]:
    """Pieces and weights from a vocabulary's scores. Scores that fall by one a rank, as merge orders do, weigh 1 / (1 - score);
    true log probabilities (none under -100) weigh exp(score)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    scores = [sp.get_score(i) for i in ids]
    ranks = min(scores, default=0) < -100
    return {sp.id_to_piece(i): 1 / (1 - s) if ranks else math.exp(s) for i, s in zip(ids, scores, strict=True)}


def settle(weights: np.ndarray, uses: np.ndarray, bytes_: np.ndarray, ends: float, mass: float = PRIOR_MASS) -> Model:
    """Probabilities from expected uses and a prior of `mass` uses spread as the vocabulary's weights; bytes share 1/100 of it."""
    counts = weights * (0.99 * mass / (weights.sum() or 1)) + uses
    raw = 0.01 * mass / 256 + bytes_
    total = counts.sum() + raw.sum() + ends + 1
    return Model(np.log(counts / total), np.log(raw / total), math.log((ends + 1) / total))


class Index(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def blocks(rows: DataFrame, distinct: int = BLOCK_DISTINCT) -> DataFrame:
    """Rows of two kinds, of rows (row__, text__, train__). Documents: block, row__, n_words, words (compressed indices).
    Words: block, word, idx, n (occurrences in the block's training documents)."""
    schema = types_of("block long, n_words long, words binary, word binary, idx int, n long", rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        pack = zstandard.ZstdCompressor(level=1).compress
        partition, seq, at, counts = TaskContext.get().partitionId(), 0, Index(), np.zeros(0, np.int64)
        kinds = pa.schema([("row__", pa.null()), ("block", pa.int64()), ("n_words", pa.int64()), ("words", pa.binary()), ("word", pa.binary()), ("idx", pa.int32()), ("n", pa.int64())])
        blank = lambda n: {f.name: pa.nulls(n, f.type) for f in kinds}
        row_type = None

        def close():
            words = list(at)
            for i in range(0, len(words), 50_000):
                some = words[i : i + 50_000]
                yield record(blank(len(some)) | {"row__": pa.nulls(len(some), row_type), "block": np.full(len(some), partition << 24 | seq), "word": some, "idx": np.arange(i, i + len(some)), "n": counts[i : i + len(some)]}, kinds)

        for batch in batches:
            for part in cut(batch):
                row_type, ids = part.column("row__").type, []
                for text in part.column("text__").to_pylist():
                    words = text.encode("utf-8", "surrogatepass").lower().split()
                    ids.append(np.fromiter(map(at.__getitem__, words), np.uint32, len(words)))
                counted = [x for x, t in zip(ids, part.column("train__").to_pylist(), strict=True) if t]
                now = np.bincount(np.concatenate(counted), minlength=len(at)) if counted else np.zeros(len(at), np.int64)
                now[: len(counts)] += counts
                counts = now
                yield record(blank(part.num_rows) | {"row__": part.column("row__"), "block": np.full(part.num_rows, partition << 24 | seq), "n_words": [len(x) for x in ids], "words": [pack(x.tobytes()) for x in ids]}, kinds)
                if len(at) >= distinct:
                    yield from close()
                    seq, at, counts = seq + 1, Index(), np.zeros(0, np.int64)
        if at:
            yield from close()

    return rows.mapInArrow(run, schema)


def counted_words(entries: DataFrame) -> DataFrame:
    """(word, c, first, block, idx): every dictionary row (word, block, idx, n) with its word's count, rows of a word together, first once a word.

    A task holds the rows of one word at a time, one a block at most.
    """
    kinds = pa.schema([("word", pa.binary()), ("c", pa.int64()), ("first", pa.bool_()), ("block", pa.int64()), ("idx", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def give(table: pa.Table) -> Iterator[pa.RecordBatch]:
            if table.num_rows:
                starts = run_starts(table["word"])
                sums = np.add.reduceat(table["n"].to_numpy(), starts)
                first = np.zeros(table.num_rows, bool)
                first[starts] = True
                out = pa.table({"word": table["word"], "c": np.repeat(sums, np.diff(np.append(starts, table.num_rows))), "first": first, "block": table["block"], "idx": table["idx"]}, schema=kinds)
                yield from out.combine_chunks().to_batches(50_000)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(b.num_rows for b in held) >= TOGETHER:
                    table = pa.Table.from_batches(held)
                    last = int(run_starts(table["word"])[-1])
                    yield from give(table.slice(0, last))
                    held = table.slice(last).combine_chunks().to_batches()
        if held:
            yield from give(pa.Table.from_batches(held))

    return entries.select("word", "block", "idx", "n").repartition("word").sortWithinPartitions("word").mapInArrow(run, "word binary, c long, first boolean, block long, idx int")


def run_starts(words: pa.ChunkedArray) -> np.ndarray:
    """Where runs of equal words begin; the column is not empty."""
    change = pc.not_equal(words.slice(1), words.slice(0, len(words) - 1)).to_numpy()
    return np.concatenate([[0], np.flatnonzero(change) + 1])


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of about TOGETHER rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            if sum(b.num_rows for b in held) >= TOGETHER:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def decoded(words: pa.ChunkedArray) -> list[str]:
    return [w.decode("utf-8", "surrogatepass") for w in words.to_pylist()]


def learn(words: DataFrame, weights: dict[str, float], ends: float, rounds: int = ROUNDS) -> Model:
    """The pieces' probabilities fitted to the words of (word, c) rows, c times each, and to the ends; each round's
    expected uses are summed on the executors, one row a piece."""
    spark = words.sparkSession
    trie, start = spark.sparkContext.broadcast(Trie.of(list(weights)).plain()), np.array(list(weights.values()))
    model = settle(start, np.zeros(len(start)), np.zeros(256), 0)
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            pieces, raw = np.zeros(len(model.pieces)), np.zeros(256)
            for table in together(batches):
                times = table["c"].to_numpy()
                for which, lattice in lattices(decoded(table["word"]), Trie(*trie.value), model):
                    lattice.expect(times[which], pieces, raw)
            uses = np.concatenate([pieces, raw])
            at = np.flatnonzero(uses)
            yield pa.RecordBatch.from_pydict({"i": at, "uses": uses[at]})

        got = words.mapInArrow(run, "i long, uses double").groupBy("i").agg(F.sum("uses").alias("uses")).collect()
        uses = np.zeros(len(start) + 256)
        for r in got:
            uses[r["i"]] = r["uses"]
        model = settle(start, uses[:-256], uses[-256:], ends)
    return model


def score_documents(docs: DataFrame, vocabulary_path: str, train: Column, rounds: int = ROUNDS, distinct: int = BLOCK_DISTINCT) -> DataFrame:
    """doc_id, train, n_tokens (words and an end), n_known (tokens seen in training), train_tokens, base_score (add-one
    word unigram), score (the lattice's) of every row of docs; both are log10 probabilities.

    Null and empty texts hold the end alone. No training document: counts are zero, the pieces keep the vocabulary's
    weights. Repeated rows count as often as they stand. A null `train` is false. Other columns of docs are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    rows = docs.select(F.struct("doc_id", F.coalesce(train, F.lit(False)).alias("train")).alias("row__"), text_of().alias("text__"))
    both = scratch.keep(blocks(rows.withColumn("train__", F.col("row__.train")), distinct), "blocks")
    texts, entries = both.where("words is not null").select("block", "row__", "n_words", "words"), both.where("word is not null")
    counted = scratch.keep(counted_words(entries), "counts")
    seen = counted.where("first and c > 0")
    total, kinds = seen.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = texts.where("row__.train").count()
    total, kinds = total + ends, kinds + (ends > 0)
    weights = vocabulary(vocabulary_path)
    model = learn(seen.select("word", "c"), weights, float(ends), rounds)
    trie = spark.sparkContext.broadcast(Trie.of(list(weights)).plain())
    base_all, ln10 = math.log10(total + kinds + 1), math.log(10)

    def score_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in together(batches):
            starts = run_starts(table["word"])
            scores = word_scores(decoded(table["word"].take(starts)), Trie(*trie.value), model)
            lp = np.repeat(scores, np.diff(np.append(starts, table.num_rows))) / ln10
            out = pa.table({"block": table["block"], "idx": table["idx"], "c": table["c"], "lp": lp})
            yield from out.combine_chunks().to_batches(50_000)

    scored = counted.mapInArrow(score_words, "block long, idx int, c long, lp double")
    row_type = texts.schema["row__"].dataType
    left = scored.select("block", F.lit(0).alias("kind"), "idx", "c", "lp", F.lit(None).cast(row_type).alias("row__"), F.lit(None).cast("long").alias("n_words"), F.lit(None).cast("binary").alias("words"))
    right = texts.select("block", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("idx"), F.lit(None).cast("long").alias("c"), F.lit(None).cast("double").alias("lp"), "row__", "n_words", "words")

    def score_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        out_kinds = pa.schema([("row__", pa.null()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
        block, held, table = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            of, kind = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(of) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(of)], strict=True):
                if of[a] != block:
                    block, held, table = of[a], [], None
                part = batch.slice(a, b - a)
                if kind[a] == 0:
                    held.append(tuple(part.column(c).to_numpy() for c in ("idx", "c", "lp")))
                    continue
                if table is None:
                    at, c, lp = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
                    table = np.zeros((len(at), 3))
                    table[at] = np.column_stack([c > 0, np.log10(c + 1.0) - base_all, lp])
                sums = np.array([table[np.frombuffer(unpack(w), np.uint32)].sum(axis=0) if n else np.zeros(3) for w, n in zip(part.column("words").to_pylist(), part.column("n_words").to_pylist(), strict=True)])
                yield record({"row__": part.column("row__"), "n_tokens": part.column("n_words").to_numpy() + 1, "n_known": sums[:, 0].astype(np.int64) + (ends > 0), "train_tokens": np.full(part.num_rows, total), "base_score": sums[:, 1] + (math.log10(ends + 1) - base_all), "score": sums[:, 2] + model.end / ln10}, out_kinds)

    gathered = left.unionByName(right).repartition("block").sortWithinPartitions("block", "kind")
    out = gathered.mapInArrow(score_texts, types_of("n_tokens long, n_known long, train_tokens long, base_score double, score double", texts))
    return out.select("row__.doc_id", "row__.train", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_lattice_lm(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    score = lambda: score_documents(docs, tokenizers.path("piece_bpe_32k.model"), fraction_crc32(F.col("doc_id"), 7) != 2)
    return written(spark, "scores", score).select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
