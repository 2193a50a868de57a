"""Removal of byte strings that repeat anywhere in a corpus, by sharded suffix arrays.

Every start of `length` bytes gets a key: the least hash of the 48-byte strings (grams) inside it. Equal strings have
equal keys, so a key's starts are compared within one shard and no other. Neighbouring starts with one key form a run;
a run is cut out with its length - 1 further bytes. Keys that the corpus holds once cannot repeat and are dropped, equal
cut-outs are counted and travel once, and a key whose only cut-out stands twice needs no comparison. Cut-outs none of whose
starts has the hash of another's in their key cannot repeat and are left out. Over the rest, a shard at a time, a suffix
array by induced sorting and permuted common prefixes mark the starts whose prefix of `length` bytes another start shares.

A key with more cut-outs than a shard should hold is never brought together: its cut-outs are texts of their own, cut
into runs once more by longer grams, the last as long as the string itself. All is computed per distinct text, so
copies cost one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import HASHES, Scratch, arrow_map, releasing, text_key, text_of, types_of, whole_row, written
from graphloom.llm.suffix_array import repeated_starts

LENGTH, GRAMS = 200, (48, 104, 160, 200)
#: Bytes of cut-outs that one suffix array is built over (it takes about 100 times that in memory), and of texts whose
#: runs are found at once. A key with half a shard or more is cut again.
SHARD_BYTES, RUN_BYTES = 1 << 20, 1 << 19
MULTIPLIER, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours: prefix and suffix minima of blocks."""
    n = len(x) - width + 1
    padded = np.append(x, np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype)).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).reshape(-1)
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


class Runs:
    """Cuts concatenated texts into runs of starts with one key."""

    def __init__(self, length: int = LENGTH, gram: int = GRAMS[0]):
        self.length, self.gram, self.width = length, gram, length - gram + 1
        self.powers = self.inverse = np.ones(0, np.uint64)

    def grams(self, data: np.ndarray) -> np.ndarray:
        """A hash of the `gram` bytes from each position, from prefix sums of byte * MULTIPLIER^position."""
        n = len(data)
        if len(self.powers) < n:
            self.powers = np.cumprod(np.append(np.uint64(1), np.full(n - 1, MULTIPLIER, np.uint64)))
            self.inverse = np.cumprod(np.append(np.uint64(1), np.full(n - 1, pow(MULTIPLIER, -1, 1 << 64), np.uint64)))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[:n])])
        h = (sums[self.gram :] - sums[: -self.gram]) * self.inverse[: n - self.gram + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(MIX)
        h ^= h >> np.uint64(29)
        return h

    def of(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """start, count of starts, key and occurrences of the key's gram (1, or 2 for more) of each run; texts end at `ends`."""
        none = np.zeros(0, np.int64)
        if len(data) < self.length:
            return none, none, none, none
        h = self.grams(data)
        least = sliding_min(h, self.width)
        starts = np.concatenate([[0], ends[:-1]])
        sizes = np.maximum(ends - starts - self.length + 1, 0)
        total = int(sizes.sum())
        if not total:
            return none, none, none, none
        at = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(total)
        key = least[at]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1)])
        first = np.flatnonzero(new)
        begin, count, run_key = at[first], np.diff(np.append(first, total)), key[first]
        # a gram met twice in a run may repeat a string within it: count the places that are least in some window
        valid = np.zeros(len(h), np.uint64)
        valid[at] = key
        high = ~sliding_min(~np.concatenate([np.zeros(self.width - 1, np.uint64), valid]), self.width)
        places = np.flatnonzero(h == high)
        low, up = np.searchsorted(places, begin), np.searchsorted(places, begin + count + self.width - 1)
        seen, live = np.zeros(len(begin), np.int64), np.arange(len(begin))
        while len(live := live[(low[live] < up[live]) & (seen[live] < 2)]):
            seen[live] += h[places[low[live]]] == run_key[live]
            low[live] += 1
        return begin, count, run_key.view(np.int64), np.maximum(seen, 1)


def numbered_texts(docs: DataFrame, hashes=HASHES) -> DataFrame:
    """t (two hashes), id, n (rows), data (bytes): one row per distinct text of docs; null texts are empty ones."""
    rows = docs.select(text_key(hashes).alias("t"), text_of().cast("binary").alias("data"))
    return rows.groupBy("t").agg(F.count("*").alias("n"), F.first("data").alias("data")).withColumn("id", F.monotonically_increasing_id())


def cut_runs(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """key, h, id, lo, starts, n, seen of every run of texts (id, n, data); h is a hash of the bytes cut out. Where the gram is the whole
    string, a run is one string over and over, and two starts of it say all."""
    whole = gram == length

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        import xxhash

        runs = Runs(length, gram)
        blobs = batch.column("data").to_pylist()
        ends = np.cumsum([len(b) for b in blobs])
        joined = b"".join(blobs)
        begin, count, key, seen = runs.of(np.frombuffer(joined, np.uint8), ends)
        doc = np.searchsorted(ends, begin, side="right")
        digest, held = xxhash.xxh3_64_intdigest, np.minimum(count, 2) if whole else count
        h = np.array([digest(joined[a:b]) for a, b in zip(begin.tolist(), (begin + held + length - 1).tolist(), strict=True)], np.uint64).view(np.int64)
        lo = begin - np.concatenate([[0], ends[:-1]])[doc] if len(doc) else begin
        yield {"key": key, "h": h, "id": batch.column("id").to_numpy()[doc], "lo": lo.astype(np.int32), "starts": count.astype(np.int32), "n": batch.column("n").to_numpy()[doc], "seen": seen.astype(np.int32)}

    return arrow_map(texts.select("id", "n", "data"), run, "key long, h long, id long, lo int, starts int, n long, seen int", RUN_BYTES)


def cut_out(places: DataFrame, texts: DataFrame, length: int, whole: bool) -> DataFrame:
    """key, h, n, piece of every row of places (key, h, n, at: id, lo, starts), out of texts (id, data)."""
    by_text = places.groupBy(F.col("at.id").alias("of")).agg(F.collect_list(F.struct("key", "h", "n", F.col("at.lo").alias("lo"), F.col("at.starts").alias("starts"))).alias("cuts"))

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        out: dict[str, list] = {"key": [], "h": [], "n": [], "piece": []}
        for data, cuts in zip(batch.column("data").to_pylist(), batch.column("cuts").to_pylist(), strict=True):
            for c in cuts:
                for k in ("key", "h", "n"):
                    out[k].append(c[k])
                out["piece"].append(data[c["lo"] : c["lo"] + (min(c["starts"], 2) if whole else c["starts"]) + length - 1])
        yield out

    joined = texts.select("id", "data").join(by_text, F.col("id") == F.col("of")).select("data", "cuts")
    return arrow_map(joined, run, "key long, h long, n long, piece binary")


def hopeful(pieces: list[bytes], length: int, separator: bytes = b"\xff") -> np.ndarray:
    """Whether each piece holds a start whose `length` bytes have the hash of another start's; the others cannot hold a repeat."""
    data = np.frombuffer(separator.join(pieces) + separator, np.uint8)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    counts = np.maximum(sizes - length + 1, 0)
    of = np.repeat(np.arange(len(pieces)), counts)
    first = np.cumsum(sizes + 1) - sizes - 1
    if not len(of):
        return np.zeros(len(pieces), bool)
    at = np.arange(len(of)) + np.repeat(first - (np.cumsum(counts) - counts), counts)
    h = Runs(length, length).grams(data)[at]
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    out = np.zeros(len(pieces), bool)
    out[of[order[1:][same]]] = out[of[order[:-1][same]]] = True
    return out


def mark_shards(pieces: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """(key, h, spans) of (key, h, n, piece) rows: the spans [a, b) of starts that repeat. Whole keys are looked through for
    cut-outs that may repeat, shard_bytes at a time, and those fill the shards."""
    out = pa.schema([("key", pa.int64()), ("h", pa.int64()), ("spans", pa.list_(pa.list_(pa.int32())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # whole keys, and the one being read
        shard: list[tuple] = []
        size, shard_size, last = 0, 0, None

        def give(rows: list[tuple], spans: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"key": [r[0] for r in rows], "h": [r[1] for r in rows], "spans": spans}, out)

        def sift() -> pa.RecordBatch:
            """The held rows that need no shard; the others go to it."""
            nonlocal size, shard_size
            may = hopeful([r[3] for r in held], length).tolist()
            done = [r for r, m in zip(held, may, strict=True) if not m]
            shard.extend(r for r, m in zip(held, may, strict=True) if m)
            shard_size += sum(len(r[3]) for r, m in zip(held, may, strict=True) if m)
            held.clear()
            size = 0
            return give(done, [spans_of(r, None) for r in done])

        def spans_of(row: tuple, twice: np.ndarray | None) -> list:
            if row[2] > 1:
                return [[0, len(row[3]) - length + 1]]
            return [] if twice is None else edges(twice)

        def solve() -> pa.RecordBatch:
            nonlocal shard_size
            made = give(shard, [spans_of(r, t) for r, t in zip(shard, repeated_starts([r[3] for r in shard], length), strict=True)])
            shard.clear()
            shard_size = 0
            return made

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "h", "n", "piece")), strict=True):
                if row[0] != last and size >= shard_bytes:
                    yield sift()
                    if shard_size >= shard_bytes:
                        yield solve()
                last = row[0]
                held.append(row)
                size += len(row[3])
        if held:
            yield sift()
        if shard:
            yield solve()

    sorted_ = pieces.select("key", "h", "n", "piece").repartition("key").sortWithinPartitions("key", "h")
    return sorted_.mapInArrow(releasing(run), "key long, h long, spans array<array<int>>")


def repeated_spans(texts: DataFrame, length: int, grams: tuple[int, ...], shard_bytes: int, scratch: Scratch, level: int = 0) -> DataFrame:
    """(id, spans) of the texts (id, n: copies, data) that hold a start whose `length` bytes start elsewhere too: the spans [a, b)
    of such starts, of one text in any order. A written table."""
    gram, last, name = grams[level], level + 1 == len(grams), lambda what: f"{what}-{level}"
    runs = scratch.keep(cut_runs(texts, length, gram), name("runs"))
    twice = runs.groupBy("key").agg(F.sum(F.col("n") * F.col("seen")).alias("c")).where("c > 1").select("key")
    kept = scratch.keep(runs.join(twice, "key", "left_semi"), name("kept"))
    scratch.drop(name("runs"))
    # one place to cut each different run out of, and how often it stands in the corpus
    places = kept.groupBy("key", "h").agg(F.sum("n").alias("n"), F.min(F.struct("id", "lo", "starts")).alias("at"))
    places = scratch.keep(places, name("places"))
    sizes = places.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("pieces"), F.sum(F.col("at.starts") + F.lit(length - 1)).alias("bytes"))
    kind = F.when((F.col("pieces") == 1) & (F.col("n") > 1), F.lit("whole")).when(F.lit(not last) & (F.col("pieces") > 1) & (F.col("bytes") >= shard_bytes // 2), F.lit("over")).otherwise(F.lit("solve"))
    classed = scratch.keep(places.join(sizes, F.col("key") == F.col("k")).select("key", "h", "n", "at", kind.alias("kind")), name("classed"))
    scratch.drop(name("places"))
    solved = mark_shards(cut_out(classed.where("kind = 'solve'"), texts, length, last), length, shard_bytes)
    spans = scratch.keep(solved.where("size(spans) > 0"), name("solved"))
    spans = spans.union(classed.where("kind = 'whole'").select("key", "h", F.array(F.array(F.lit(0), F.col("at.starts"))).alias("spans")))
    over = classed.where("kind = 'over'")
    if over.limit(1).count():
        again = cut_out(over, texts, length, last).select(F.monotonically_increasing_id().alias("id"), "n", F.col("piece").alias("data"), "key", "h")
        again = scratch.keep(again, name("again"))
        inner = repeated_spans(again, length, grams, shard_bytes, scratch, level + 1)
        spans = spans.union(again.select("id", "key", "h").join(inner, "id").select("key", "h", "spans"))
    at = F.array(F.array(F.col("lo"), F.col("lo") + F.col("starts"))) if last else F.transform("spans", lambda s: F.array(F.col("lo") + s[0], F.col("lo") + s[1]))
    found = kept.select("key", "h", "id", "lo", "starts").join(spans, ["key", "h"]).select("id", at.alias("spans"))
    found = scratch.keep(found.groupBy("id").agg(F.flatten(F.collect_list("spans")).alias("spans")), name("found"))
    scratch.drop(name("kept"), name("classed"), name("solved"), name("again"), f"found-{level + 1}")
    return found


def edges(flags: np.ndarray) -> list[list[int]]:
    """[a, b) spans of set flags."""
    change = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return change.reshape(-1, 2).tolist()


def whole_characters(data: bytes, spans: list[list[int]]) -> list[list[int]]:
    """Spans shrunk to whole UTF-8 characters."""
    inner = lambda i: i < len(data) and data[i] & 0xC0 == 0x80
    out = []
    for a, b in spans:
        while a < b and inner(a):
            a += 1
        while b > a and inner(b):
            b -= 1
        if a < b:
            out.append([a, b])
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, grams: tuple[int, ...] = GRAMS, shard_bytes: int = SHARD_BYTES, kept_text: bool = False, hashes=HASHES) -> DataFrame:
    """row__ (the row of docs, as a struct), n_bytes, spans (maximal byte runs [a, b) covered by a `length`-byte string that
    starts elsewhere too), n_removed, n_spans, kept_sha256, kept_text of every row of docs; kept_text, where spans are shrunk to
    whole characters, is null unless asked for.

    Texts are UTF-8 bytes; null is empty; strings never cross texts. Repeated rows make all of their text (from
    `length` bytes on) repeat. Texts shorter than `length` keep all. Other columns, whatever their names, only pass.
    grams ascend to `length`. hashes: the two that stand for a text.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    texts = scratch.keep(numbered_texts(docs, hashes), "texts")
    found = repeated_spans(texts, length, grams, shard_bytes, scratch)
    spans = scratch.keep(texts.select("id", "t").join(found, "id").select(F.col("t.a").alias("a2"), F.col("t.b").alias("b2"), "spans"), "spans")
    scratch.drop("texts", "found-0")
    rows = docs.select(whole_row(), text_of().alias("text__"), text_key(hashes).alias("t")).select("row__", "text__", F.col("t.a").alias("a"), F.col("t.b").alias("b"))
    joined = rows.join(spans, (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2")), "left").select("row__", "text__", "spans")

    def finish(batch: pa.RecordBatch) -> Iterator[dict]:
        import hashlib

        out: dict[str, list] = {k: [] for k in ("n_bytes", "spans", "n_removed", "n_spans", "kept_sha256", "kept_text")}
        for text, starts in zip(batch.column("text__").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            data, merged = text.encode("utf-8", "surrogatepass"), []
            for a, b in sorted(starts or []):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b + length - 1)
                else:
                    merged.append([a, b + length - 1])
            out["n_bytes"].append(len(data))
            out["spans"].append(merged)
            out["n_removed"].append(sum(b - a for a, b in merged))
            out["n_spans"].append(len(merged))
            out["kept_sha256"].append(hashlib.sha256(without(data, merged)).hexdigest())
            out["kept_text"].append(without(data, whole_characters(data, merged)).decode("utf-8", "surrogatepass") if kept_text else None)
        yield {"row__": batch.column("row__")} | out

    return arrow_map(joined, finish, types_of("n_bytes long, spans array<array<int>>, n_removed long, n_spans long, kept_sha256 string, kept_text string", joined))


def without(data: bytes, spans: list[list[int]]) -> bytes:
    at, out = 0, []
    for a, b in spans:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return written(spark, "removed", lambda: remove_repeats(docs).select("row__.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))


#: Every 200-byte string of the whole table, in hexadecimal, by its MD5; spans are islands of starts that stand twice.
ORACLE = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT r, unnest(range(0, length(h) // 2 - 199)) AS i, h FROM d WHERE length(h) >= 400),
k AS (SELECT r, i, md5(substr(h, 2 * i + 1, 400)) AS m FROM s),
st AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM k WHERE m IN (SELECT m FROM k GROUP BY m HAVING count(*) > 1)),
isl AS (SELECT r, i, sum(CASE WHEN p IS NULL OR i > p + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS g FROM st),
sp AS (SELECT r, g, min(i) AS a, max(i) + 200 AS b FROM isl GROUP BY r, g),
cut AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS e FROM sp),
per AS (SELECT cut.r, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * e + 1, 2 * (a - e)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
  FROM cut JOIN d ON d.r = cut.r GROUP BY cut.r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN per ON d.r = per.r"""
