"""Token-id shards as wavelet matrices.

A shard file holds the ids of consecutive documents (ascending doc_id) as a wavelet matrix: one bit-plane per bit of
the largest id, from the top; each level's ids are stably parted by its bit, zeros first. Beside each plane stands the
number of ones before every 512th bit, so `access`, `rank` and `count` walk the planes once down, and `select` once
down and once up; the sequence itself is not stored. Planes are cut into frames that are zstd-compressed each on its
own: a look-up unpacks one frame a plane.

File: magic, number and lengths of the parts (uint64 each), then the parts: header (JSON), doc ids (JSON or int64), tokens per
document, samples of all planes, frames of all planes.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import Scratch, arrow_map, cut, text_of, worker_memo
from graphloom.llm.word_table import WordTable, in_order

MAGIC, BLOCK, FRAME = b"GLWM0002", 512, 1 << 16
#: A shard closes at so many tokens; only a longer single document makes a larger one.
SHARD_TOKENS = 1 << 21
#: Words that a worker keeps, and words that go to the tokenizer at once.
WORDS, TOGETHER = 800_000, 200
#: The first combining character: below it, NFC changes nothing and every character has one lower case.
COMBINING = "\u0300"
END_ID = 1


class Plane:
    """A bit per position, in frames that are fetched when needed, with the ones before every BLOCK bits."""

    def __init__(self, n: int, samples: np.ndarray, frame: Callable[[int], np.ndarray]):
        self.n, self.samples, self.frame = n, samples, frame

    @classmethod
    def of(cls, ones: np.ndarray) -> Plane:
        n, packed = len(ones), np.packbits(ones, bitorder="little")
        blocks = np.pad(packed, (0, -len(packed) % (BLOCK // 8))).reshape(-1, BLOCK // 8)
        samples = np.concatenate([[0], np.bitwise_count(blocks.view(np.uint64)).sum(axis=1, dtype=np.int64).cumsum()])
        return cls(n, samples, lambda i: packed[i * FRAME : (i + 1) * FRAME])

    @property
    def frames(self) -> int:
        return -(-self.n // (8 * FRAME))

    def ones(self) -> np.ndarray:
        """All bits, as bool."""
        packed = np.concatenate([np.zeros(0, np.uint8), *map(self.frame, range(self.frames))])
        return np.unpackbits(packed, count=self.n, bitorder="little").view(bool)

    def block(self, i: int) -> np.ndarray:
        frame, at = divmod(i * (BLOCK // 8), FRAME)
        return np.unpackbits(self.frame(frame)[at : at + BLOCK // 8], bitorder="little")[: self.n - i * BLOCK]

    def ones_before(self, i: int) -> int:
        block, rest = divmod(i, BLOCK)
        return int(self.samples[block]) + (int(self.block(block)[:rest].sum()) if rest else 0)

    def select(self, bit: int, k: int) -> int:
        """The position of the k-th (from 0) such bit, which must be there."""
        before = self.samples if bit else np.arange(len(self.samples)) * BLOCK - self.samples
        block = int(np.searchsorted(before, k, side="right")) - 1
        return block * BLOCK + int(np.flatnonzero(self.block(block) == bit)[k - before[block]])


class WaveletMatrix:
    """Bit-planes, from the top bit, over a sequence of unsigned ids; zeros: how many zeros each plane holds."""

    def __init__(self, n: int, planes: list[Plane], zeros: list[int]):
        self.n, self.planes, self.zeros = n, planes, zeros

    @classmethod
    def of(cls, ids: np.ndarray) -> WaveletMatrix:
        n = len(ids)
        bits = max(1, int(ids.max()).bit_length() if n else 1)
        now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros = [], []
        for level in reversed(range(bits)):
            ones = (now & now.dtype.type(1 << level)) != 0
            planes.append(Plane.of(ones))
            left = np.flatnonzero(~ones)
            zeros.append(len(left))
            now = now[np.concatenate([left, np.flatnonzero(ones)])]
        return cls(n, planes, zeros)

    def ids(self) -> np.ndarray:
        """The whole sequence: from the lowest plane up, each level's order is undone."""
        bits = len(self.planes)
        kind = np.uint16 if bits <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for level, (plane, z) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            ones = plane.ones()
            out = np.empty(self.n, kind)
            out[np.flatnonzero(~ones)] = now[:z]
            out[np.flatnonzero(ones)] = now[z:] | kind(1 << level)
            now = out
        return now

    def access(self, i: int) -> int:
        """The id at position i."""
        out = 0
        for plane, z in zip(self.planes, self.zeros, strict=True):
            before = plane.ones_before(i)
            one = plane.ones_before(i + 1) - before
            out = out << 1 | one
            i = z + before if one else i - before
        return out

    def interval(self, value: int, i: int) -> tuple[int, int]:
        """Where, below the last plane, the occurrences of value before position i stand: [start, end)."""
        start, bits = 0, len(self.planes)
        if value < 0 or value >> bits:
            return 0, 0
        for level, (plane, z) in enumerate(zip(self.planes, self.zeros, strict=True)):
            a, b = plane.ones_before(start), plane.ones_before(i)
            start, i = (z + a, z + b) if value >> (bits - 1 - level) & 1 else (start - a, i - b)
        return start, i

    def rank(self, value: int, i: int) -> int:
        """How often value stands before position i."""
        start, end = self.interval(value, i)
        return end - start

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """The position of the k-th (from 0) occurrence of value; -1 where there is none."""
        start, end = self.interval(value, self.n)
        if not 0 <= k < end - start:
            return -1
        at = start + k
        for level, (plane, z) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            at = plane.select(1, at - z) if value >> level & 1 else plane.select(0, at)
        return at


def dump(doc_ids: list, sizes: list[int], ids: np.ndarray) -> bytes:
    """A shard file's bytes. Doc ids are whole numbers or strings, or None."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    wm = WaveletMatrix.of(ids)
    strings = any(isinstance(d, str) for d in doc_ids)
    frames = [[pack(p.frame(i).tobytes()) for i in range(p.frames)] for p in wm.planes]
    head = {"n": wm.n, "zeros": wm.zeros, "docs": len(sizes), "strings": strings, "nulls": [] if strings else [i for i, d in enumerate(doc_ids) if d is None]}
    names = json.dumps(doc_ids).encode() if strings else np.array([d or 0 for d in doc_ids], "<i8").tobytes()
    samples = np.concatenate([p.samples for p in wm.planes]).astype("<i8").tobytes()
    parts = [pack(json.dumps(head).encode()), pack(names), pack(np.array(sizes, "<i8").tobytes()), pack(samples), *(f for fs in frames for f in fs)]
    return MAGIC + struct.pack("<Q", len(parts)) + struct.pack(f"<{len(parts)}Q", *map(len, parts)) + b"".join(parts)


def load(data: bytes) -> tuple[list, np.ndarray, WaveletMatrix]:
    """doc ids, tokens per document and the wavelet matrix of a shard file; its frames are unpacked when a look-up needs them."""
    import zstandard

    if data[:8] != MAGIC:
        raise ValueError("not a token shard")
    (n,) = struct.unpack_from("<Q", data, 8)
    lengths = np.frombuffer(data, "<u8", n, 16).astype(np.int64)
    starts = 16 + 8 * n + np.cumsum(lengths) - lengths

    def part(i: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(data[starts[i] : starts[i] + lengths[i]])

    head = json.loads(part(0))
    docs: list = json.loads(part(1)) if head["strings"] else np.frombuffer(part(1), "<i8").tolist()
    for i in head["nulls"]:
        docs[i] = None
    samples = np.frombuffer(part(3), "<i8").reshape(len(head["zeros"]), -1)
    planes = []
    for level, own in enumerate(samples):
        plane = Plane(head["n"], own, lambda i: np.zeros(0, np.uint8))
        first, held = 4 + level * plane.frames, {}

        def frame(i: int, first=first, held=held) -> np.ndarray:
            if i not in held:
                held.clear()
                held[i] = np.frombuffer(part(first + i), np.uint8)
            return held[i]

        plane.frame = frame
        planes.append(plane)
    return docs, np.frombuffer(part(2), "<i8"), WaveletMatrix(head["n"], planes, head["zeros"])


class WordEncoder:
    """The tokenizers library over distinct words, many a call: a special token, which splits a text before anything
    else looks at it, stands between them.

    Words of characters before COMBINING go, in lower case, to a copy without the normalizer where that is NFC, white
    space and lower case, as it does nothing else to them. Words that may hold a special token go alone and as they are.
    """

    def __init__(self, spec: bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        told = json.loads(spec)
        self.full = self.bare = Tokenizer.from_buffer(spec)
        marks = [t for t in told.get("added_tokens", []) if t["special"] and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"])]
        self.mark = marks[0] if marks else None
        self.added = [t["content"] for t in told.get("added_tokens", [])]
        kinds = [n["type"] for n in (told.get("normalizer") or {}).get("normalizers", [])]
        self.lower = kinds == ["NFC", "Replace", "Lowercase"]
        if self.lower:
            self.bare = Tokenizer.from_buffer(spec)
            self.bare.normalizer = None

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words (without white space), one after the other, and how many each has."""
        if not words:
            return in_order([], 0)
        together = b"\n".join(words).decode("utf-8", "surrogatepass")
        texts, plain, other, alone = together.split("\n"), list(range(len(words))), [], []
        if not self.lower or max(together) >= COMBINING or self.mark is None or any(a[:2] in together for a in self.added):
            plain = []
            for i, w in enumerate(texts):
                if self.mark is None or any(a[:2] in w for a in self.added):
                    alone.append(i)
                else:
                    (plain if self.lower and max(w) < COMBINING else other).append(i)
        out = []
        for i, e in zip(alone, self.full.encode_batch_fast([texts[i] for i in alone], add_special_tokens=False), strict=True):
            out.append((np.array([i]), np.array(e.ids, np.int64), np.array([len(e.ids)])))
        for which, encoder, lower in ((plain, self.bare, True), (other, self.full, False)):
            some = [texts[i].lower() if lower else texts[i] for i in which]
            joined = [self.mark["content"].join(some[at : at + TOGETHER]) + self.mark["content"] for at in range(0, len(some), TOGETHER)]
            for e in encoder.encode_batch_fast(joined, add_special_tokens=False):
                ids = np.array(e.ids, np.int64)
                ends = np.flatnonzero(ids == self.mark["id"])
                first = sum(len(x[0]) for x in out[len(alone) :]) if lower else sum(len(x[0]) for x in out[len(alone) :]) - len(plain)
                out.append((np.array(which[first : first + len(ends)]), ids[ids != self.mark["id"]], np.diff(ends, prepend=-1) - 1))
        return in_order(out, len(words))


def put_file(folder: str, name: str, data: bytes) -> None:
    """Write a file whole or not at all: under a name of this attempt's own, then moved into place."""
    import uuid

    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    own = f"{path}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as out:
        out.write(data)
    system.move(own, f"{path}/{name}")


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode whole texts in ascending doc_id order (null first) into files folder/shard-PPPPP-SSSS.wm; (file, tokens) of each.

    A text splits at ASCII white space, which the tokenizer drops and never joins across, so a distinct word is
    encoded once a worker while its table of words (bounded) holds it; ids come from the tokenizers library alone, special tokens in a text included. Null and empty texts have end_id only. Repeated doc_ids keep all their
    rows; doc_ids that are no whole numbers count as strings. Other columns are not read. Executors write the files
    under the attempt's own names and move them, so lost or repeated tasks leave whole files.
    """
    spark = docs.sparkSession
    with open(tokenizer, "rb") as f:
        spec = spark.sparkContext.broadcast(f.read())
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = docs.select(numbered(docs), text_of().alias("text")).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = worker_memo(f"wavelet-{zlib.crc32(spec.value)}")
        if not held:
            held["table"] = WordTable(WordEncoder(spec.value).encode, WORDS)
        table, partition, seq = held["table"], TaskContext.get().partitionId(), 0
        end = np.array([end_id], np.uint32)
        names, sizes, ids, tokens = [], [], [], 0

        def flush():
            nonlocal seq, tokens
            name = f"shard-{partition:05d}-{seq:04d}.wm"
            put_file(folder, name, dump(names, sizes, np.concatenate(ids)))
            made = pa.RecordBatch.from_pydict({"file": [name], "tokens": [tokens]}, pa.schema([("file", pa.string()), ("tokens", pa.int64())]))
            seq, tokens = seq + 1, 0
            names.clear(), sizes.clear(), ids.clear()
            return made

        for batch in batches:
            for part in cut(batch):
                table.make_room()
                number, drafts = table.numbers.__getitem__, []
                for text in part.column("text").to_pylist():
                    words = text.encode("utf-8", "surrogatepass").split()
                    drafts.append(np.fromiter(map(number, words), np.int64, len(words)))
                table.settle(drafts)
                for name, draft in zip(part.column("doc_id").to_pylist(), drafts, strict=True):
                    own = np.concatenate([table.of(draft), end])
                    if tokens and tokens + len(own) > shard_tokens:
                        yield flush()
                    names.append(name), sizes.append(len(own)), ids.append(own)
                    tokens += len(own)
        if names:
            yield flush()

    return sorted_.mapInArrow(run, "file string, tokens long")


def numbered(docs: DataFrame) -> Column:
    """doc_id, as a long where its type is a whole number, else as a string."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return F.col("doc_id").cast("long" if kind in ("tinyint", "smallint", "int", "bigint") else "string").alias("doc_id")


def read_shards(spark, folder: str, id_type: str = "long") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone.

    The starts of the shards are running sums over one row per shard.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.wm").load(folder)
    name = F.element_at(F.split("path", "/"), -1)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for file, data in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist(), strict=True):
            docs, sizes, wm = load(data)
            ids, ends = wm.ids().astype("<u4"), np.cumsum(sizes)
            starts = ends - sizes
            yield {"file": [file] * len(docs), "doc_id": docs, "at": starts, "n_tokens": sizes, "ids_crc32": [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]}

    return arrow_map(files.select(name.alias("file"), "content"), run, f"file string, doc_id {id_type}, at long, n_tokens long, ids_crc32 long")


def encode_corpus(docs: DataFrame, tokenizer: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> tuple[str, DataFrame]:
    """Write the shards, read them back: the folder, and doc_id, start, n_tokens, ids_crc32 of every row of docs.

    An empty table leaves no file and gives no row.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    folder = scratch.path("shards")
    made = scratch.keep(write_shards(docs, folder, tokenizer, end_id, shard_tokens), "made")
    first = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = scratch.keep(made.select("file", F.coalesce(F.sum("tokens").over(first), F.lit(0)).alias("before")), "offsets")
    read = read_shards(spark, folder, docs.select(numbered(docs)).schema[0].dataType.simpleString())
    scratch.drop("made")
    return folder, read.join(offsets, "file").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op2_wavelet(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    return encode_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizers.path("word_bpe_49k.json"))[1]
