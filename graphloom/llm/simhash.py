"""SimHash near-duplicates by covering locality-sensitive hashing, and connected components of the links.

Each of the 64 bit positions gets a nonzero vector of F2^(r+1). Table v keeps the bits whose vector has an odd product
with v. Up to r differing positions give up to r vectors, so some v is orthogonal to them all: in table v the two
fingerprints agree. With r = 3 that is 15 tables of about 34 bits, and no pair within the radius is missed.

A bucket of up to LIMIT fingerprints is compared within itself in blocks; a larger one is covered again over the bits
that its table leaves out, which separates its members by about 16 bits more, and so leaves 2^14 or fewer to compare.
Only a spanning forest of each bucket is emitted, never its pairs; copies are one fingerprint throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import HASHES, Scratch, arrow_map, releasing, text_key, text_of, types_of, whole_row, worker_memo, written

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
#: Fingerprints compared within one bucket before it is covered a second time.
LIMIT = 2048
#: Rounds after which components that still change are an error (their number grows with the logarithm of the longest path).
ROUNDS = 100


def simhash(hashes: np.ndarray) -> int:
    """Unsigned 64-bit SimHash of unsigned 64-bit hashes: a bit is 1 if set in over half of them; 0 of none."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of the text's word shingles, repeats included; 0 where it has no word."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n < shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends[:-1]]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[shingle - 1 :], strict=False)]
    return simhash(np.array(hashes, np.uint64))


def with_fingerprint(rows: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """row__ and fp, the fingerprint as a signed long, of every row of rows (row__, text__)."""

    def per_batch(batch: pa.RecordBatch) -> Iterator[dict]:
        fps = np.array([fingerprint(t, shingle, seed) for t in batch.column("text__").to_pylist()], np.uint64)
        yield {"row__": batch.column("row__"), "fp": fps.view(np.int64)}

    return arrow_map(rows, per_batch, types_of("fp long", rows))


def covering(bits: list[int], radius: int) -> list[int]:
    """Masks over the given bit positions such that any `radius` of them are all left out by some mask."""
    dims = radius + 1
    vector = {b: i % (2**dims - 1) + 1 for i, b in enumerate(bits)}
    return [sum(1 << b for b in bits if (vector[b] & v).bit_count() & 1) for v in range(1, 2**dims)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, root) for members that link, in any number of steps within the bucket, to one that stands before them."""
    n, bits = len(fps), fps.view(np.uint64)  # bitwise_count takes the absolute value of signed numbers
    label = np.arange(n)
    while True:
        new = label.copy()
        for at in range(0, n, 512):
            hit = np.bitwise_count(bits[at : at + 512, None] ^ bits[None, :]) <= radius
            new[at : at + 512] = np.where(hit, label[None, :], n).min(axis=1)
        new = np.minimum(new, label)
        while not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(n)
    return fps[moved], fps[label[moved]]


def bucket_links(rows: DataFrame, keys: list[str], radius: int, limit: int | None) -> DataFrame:
    """Links of (keys, fp) rows within equal keys: a, b are fingerprints, over = false. Rows of a bucket beyond
    `limit` come back as they are (a and b the fingerprint), over = true. A task streams its sorted rows and holds one bucket at most."""
    sized = rows.repartition(*keys).sortWithinPartitions(*keys, "fp")
    out = pa.schema([*((k, pa.int64()) for k in keys), ("a", pa.int64()), ("b", pa.int64()), ("over", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give(key, a, b, over):
            n = len(a)
            return pa.RecordBatch.from_arrays([*(pa.array(np.full(n, k)) for k in key), pa.array(a), pa.array(b), pa.array(np.full(n, over))], schema=out)

        held, held_key, spilling = [], None, False

        def close():
            if held_key is not None and not spilling and sum(map(len, held)) > 1:
                a, b = forest(np.concatenate(held), radius)
                if len(a):
                    yield give(held_key, a, b, False)

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy() for k in keys]
            fp = batch.column("fp").to_numpy()
            change = np.zeros(len(fp), bool)
            for c in cols:
                change[1:] |= c[1:] != c[:-1]
            at = np.flatnonzero(change)
            starts, ends = np.concatenate([[0], at]), np.concatenate([at, [len(fp)]])
            # pairs standing alone inside the batch: all at once
            i = starts[np.flatnonzero((ends - starts == 2) & (starts > 0) & (ends < len(fp)))]
            i = i[np.bitwise_count(fp[i].view(np.uint64) ^ fp[i + 1].view(np.uint64)) <= radius]
            if len(i):
                yield pa.RecordBatch.from_arrays([*(pa.array(c[i]) for c in cols), pa.array(fp[i + 1]), pa.array(fp[i]), pa.array(np.zeros(len(i), bool))], schema=out)
            for s, e in ((s, e) for s, e in zip(starts.tolist(), ends.tolist(), strict=True) if e - s > 2 or s == 0 or e == len(fp)):
                key = tuple(c[s] for c in cols)
                if key != held_key:
                    yield from close()
                    held, held_key, spilling = [], key, False
                held.append(fp[s:e].copy())
                if limit is not None and (spilling or sum(map(len, held)) > limit):
                    spilling = True
                    every = np.concatenate(held)
                    yield give(key, every, every, True)
                    held = []
        yield from close()

    return sized.mapInArrow(releasing(run), ", ".join([*(f"`{k}` long" for k in keys), "a long", "b long", "over boolean"]))


def links(fps: DataFrame, scratch: Scratch, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """Edges (a, b) between fingerprints (column fp, distinct) whose components are those of all pairs within the radius."""
    masks = covering(list(range(BITS)), radius)
    # one array literal each for the masks and, by table, for the second covering of the bits left out
    second = [covering([b for b in range(BITS) if not m >> b & 1], radius) for m in masks]
    table = F.explode(F.array(*(F.struct(F.lit(v).cast("long").alias("v"), F.lit(signed(m)).alias("m")) for v, m in enumerate(masks))))
    rows = fps.select("fp", table.alias("t")).select(F.col("t.v").alias("v"), F.col("fp").bitwiseAND(F.col("t.m")).alias("key"), "fp")
    first = scratch.keep(bucket_links(rows, ["v", "key"], radius, limit), "first")
    masks2 = F.element_at(F.array(*(F.array(*(F.struct(F.lit(u).cast("long").alias("u"), F.lit(signed(m)).alias("m")) for u, m in enumerate(ms))) for ms in second)), (F.col("v") + 1).cast("int"))
    over = first.where("over").select("v", "key", F.col("a").alias("fp"), F.explode(masks2).alias("t"))
    over = over.select("v", "key", F.col("t.u").alias("u"), F.col("fp").bitwiseAND(F.col("t.m")).alias("key2"), "fp")
    return first.where("not over").select("a", "b").union(bucket_links(over, ["v", "key", "u", "key2"], radius, None).select("a", "b")).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node of the edges (a, b), a <> b; root is the least node of its component.

    Alternating large-star and small-star steps on written tables. Every step aggregates before it shuffles; the joins
    on a star's centre have one row per node on the other side, so skewed partitions can be split.
    """
    e = scratch.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges-0")
    mark, i = None, 0
    while True:  # each round halves the longest path at least, until nothing changes
        i += 1
        both = e.union(e.select("b", "a"))
        least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("n")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        hung = large.join(least, F.col("a") == F.col("n")).select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x"))
        e = scratch.keep(hung.select(F.col("x.b").alias("a"), F.col("x.m").alias("b")).where("a <> b").distinct(), f"edges-{i}")
        scratch.drop(f"edges-{i - 1}")
        new = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        if i == ROUNDS:
            raise RuntimeError("components have not settled")
        mark = new
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED, limit: int = LIMIT) -> DataFrame:
    """doc_id, fp, component_id for every row of docs: the least doc_id reachable over fingerprints within the radius.

    Null, empty and blank texts have fingerprint 0, linked like any other. Null doc_ids never become a component_id
    unless a component holds nothing else (then null). Repeated rows come back repeated. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.keep(with_fingerprint(docs.select(F.struct("doc_id").alias("row__"), text_of().alias("text__")), shingle, seed).select("row__.doc_id", "fp"), "rows")
    nodes = scratch.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = scratch.keep(components(links(nodes.select("fp"), scratch, radius, limit), scratch), "components")
    rooted = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = scratch.keep(rooted.join(ids, "root").select(F.col("fp").alias("fp2"), "component_id"), "by-fp")
    scratch.drop("nodes", "first", "components")
    return rows.join(by_fp, F.col("fp") == F.col("fp2")).select("doc_id", "fp", "component_id")


#: Near copies of the pipeline: sets of five-word shingles with a Jaccard similarity of 0.8 or more.
NEAR_WORDS, SIMILARITY = 5, 0.8
#: Shingles that stand last in all texts' order: at most so many, each in this many or more of a share of the texts. The
#: order decides only how many candidates there are.
COMMON, COMMON_LEAST, COMMON_SHARE = 50_000, 4, 8
#: 64-bit words of a text's bitmap: the wider, the fewer pairs that are not similar pass it.
MAP_WORDS = 16
#: Odd multipliers, one per word of a shingle, repeated for longer shingles with a shift.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
BASE, SPACES = 0x9E3779B97F4A7C15, b" \t\n\v\f\r"


def similarity(a: str, b: str, shingle: int = NEAR_WORDS) -> float:
    """Jaccard similarity of the sets of word shingles (of a shorter text: its words as one)."""

    def shingles(text: str) -> set:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        return set(zip(*(words[i:] for i in range(shingle)), strict=False)) or {tuple(words)}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


class WordHashes:
    """64-bit hashes of a text's words from prefix sums of byte * BASE^position; the powers are kept and grow with the longest text."""

    def __init__(self):
        self.powers = self.inverse = np.ones(0, np.uint64)
        self.space = np.zeros(256, bool)
        self.space[list(SPACES)] = True

    def of(self, data: bytes) -> np.ndarray:
        d = np.frombuffer(data, np.uint8)
        if len(self.powers) < len(d):
            n = 1 << len(d).bit_length()
            self.powers, self.inverse = (np.cumprod(np.append(np.uint64(1), np.full(n - 1, x, np.uint64))) for x in (BASE, pow(BASE, -1, 1 << 64)))
        edges = np.flatnonzero(np.diff(np.concatenate([[True], self.space[d], [True]])))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((d.astype(np.uint64) + np.uint64(1)) * self.powers[: len(d)])])
        h = (sums[edges[1::2]] - sums[edges[::2]]) * self.inverse[edges[::2]]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(MIX[1])
        return h ^ (h >> np.uint64(29))


def shingle_set(text: str, shingle: int, words: WordHashes) -> np.ndarray:
    """Ascending 64-bit hashes of the set of word shingles that `similarity` compares."""
    h = words.of(text.encode("utf-8", "surrogatepass").lower())
    size = min(shingle, len(h))  # a shorter text is one shingle
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out += h[i : i + n] * np.uint64((MIX[i % len(MIX)] + 2 * (i // len(MIX))) % 2**64)
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(29)))


def prefix_size(n: int, least_similarity: float) -> int:
    """Of a set of n: so many of its first elements, in an order common to all sets, meet those of every similar set."""
    return n - int(np.ceil(least_similarity * n - 1e-9)) + 1


def shingle_prefixes(texts: DataFrame, least_similarity: float, shingle: int, common: np.ndarray, full: bool = True) -> DataFrame:
    """id and prefix per row of texts (id, text), and if `full` n (shingles), fp (their SimHash) and w0... (a bitmap of
    them); shingles in `common` (ascending) stand last in the order."""
    schema = ", ".join(["id long", "prefix array<long>", *(["n long", "fp long", *(f"w{i} long" for i in range(MAP_WORDS))] if full else [])])

    def per_batch(batch: pa.RecordBatch) -> Iterator[dict]:
        words, sizes, fps, maps, firsts = worker_memo("near").setdefault("words", WordHashes()), [], [], [], []
        for text in batch.column("text").to_pylist():
            s = shingle_set(text, shingle, words)
            if full:
                bits = np.zeros(64 * MAP_WORDS, np.uint8)
                bits[(s % np.uint64(64 * MAP_WORDS)).astype(np.int64)] = 1
                maps.append(np.packbits(bits, bitorder="little").view(np.int64))
                sizes.append(len(s))
                fps.append(signed(simhash(s)))
            if len(common):
                last = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
                s = np.concatenate([s[~last], s[last]])
            firsts.append(s[: prefix_size(len(s), least_similarity)].view(np.int64))
        yield {"id": batch.column("id"), "prefix": firsts} | ({"n": sizes, "fp": fps} | {f"w{i}": np.array([m[i] for m in maps], np.int64) for i in range(MAP_WORDS)} if full else {})

    return arrow_map(texts.select("id", "text"), per_batch, schema)


def common_shingles(texts: DataFrame, least_similarity: float, shingle: int, scratch: Scratch) -> np.ndarray:
    """The most frequent shingles, ascending: those whose count, in a share of the texts, reaches the least power of two
    that COMMON or fewer reach."""
    seen = shingle_prefixes(texts.where(F.pmod(F.xxhash64("text"), F.lit(COMMON_SHARE)) == 0), least_similarity, shingle, np.zeros(0, np.uint64), False)
    seen = seen.select(F.explode("prefix").alias("tok")).groupBy("tok").agg(F.count("*").alias("c")).where(F.col("c") >= COMMON_LEAST)
    seen = scratch.keep(seen.withColumn("size", F.floor(F.log2("c")).cast("int")), "common")
    total, least = 0, None
    for r in sorted(seen.groupBy("size").agg(F.count("*").alias("n")).collect(), reverse=True):
        total += r["n"]
        if total > COMMON:
            break
        least = r["size"]
    if least is None:
        return np.zeros(0, np.uint64)
    return np.sort(np.array([r["tok"] for r in seen.where(F.col("size") >= least).select("tok").collect()], np.int64).view(np.uint64))


def similar_pairs(x: DataFrame, y: DataFrame, least_similarity: float, also: Column) -> DataFrame:
    """Distinct (a, b) of ids of x and y (aliased so: tok, id, n, w0...) with a tok in common whose sizes and bitmaps
    allow the similarity. No similar pair is lost: sets differ by at least as many elements as their bitmaps by bits."""
    n, m = F.col("x.n"), F.col("y.n")
    apart = sum((F.bit_count(F.col(f"x.w{i}").bitwiseXOR(F.col(f"y.w{i}"))) for i in range(1, MAP_WORDS)), F.bit_count(F.col("x.w0").bitwiseXOR(F.col("y.w0"))))
    can = (F.least(n, m) >= least_similarity * F.greatest(n, m) - 1e-6) & (apart <= (1 - least_similarity) / (1 + least_similarity) * (n + m) + 1e-6)
    return x.join(y, (F.col("x.tok") == F.col("y.tok")) & also & can).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def verified(pairs: DataFrame, texts: DataFrame, least_similarity: float, shingle: int, scratch: Scratch, name: str) -> DataFrame:
    """The written pairs (a, b) of ids whose texts are similar, by exact comparison."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("w")).distinct()
    bodies = scratch.keep(texts.join(asked, F.col("id") == F.col("w"), "left_semi").select("id", F.col("text").alias("body")), f"bodies-{name}")
    both = pairs.join(bodies, F.col("a") == F.col("id")).select("a", "b", F.col("body").alias("one"))
    both = both.join(bodies, F.col("b") == F.col("id")).select("a", "b", "one", "body")

    def verify(batch: pa.RecordBatch) -> Iterator[dict]:
        near_ = [similarity(x, y, shingle) >= least_similarity for x, y in zip(batch.column("one").to_pylist(), batch.column("body").to_pylist(), strict=True)]
        at = np.flatnonzero(near_)
        yield {"a": batch.column("a").to_numpy()[at], "b": batch.column("b").to_numpy()[at]}

    return scratch.keep(arrow_map(both, verify, "a long, b long"), f"links-{name}")


def similar_groups(texts: DataFrame, least_similarity: float, shingle: int, scratch: Scratch) -> DataFrame:
    """(node, root) of every text (id, text) that is similar to another: the components of all similar pairs.

    First the pairs whose SimHashes (of the sets of shingles) lie within RADIUS, found by covering tables. SimHash alone
    may miss similar pairs, so a prefix filter finds the rest: in any order common to all sets, similar sets share
    one of their first elements, so every similar pair stands under a common shingle. There each text is compared with one text
    per shingle, the one that has most in common with others; then all pairs under a shingle that this has left in
    different components. Pairs already in one component are not looked at again, and every link is verified on whole texts.
    """
    common = common_shingles(texts, least_similarity, shingle, scratch)
    scratch.drop("common")
    sets = scratch.keep(shingle_prefixes(texts, least_similarity, shingle, common), "sets")
    reps = scratch.keep(sets.groupBy("fp").agg(F.min("id").alias("rep")), "reps")
    same = sets.select("id", "fp").join(reps, "fp").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    one, other = (reps.select(F.col("fp").alias(c), F.col("rep").alias(r)) for c, r in (("a", "ra"), ("b", "rb")))
    close = links(reps.select("fp"), scratch).join(one, "a").join(other, "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
    links0 = verified(scratch.keep(same.union(close), "pairs-hash"), texts, least_similarity, shingle, scratch, "hash")
    scratch.drop("reps", "first", "bodies-hash", "pairs-hash")
    found = scratch.keep(components(links0, scratch), "hash-components")
    entries = sets.select("id", F.explode("prefix").alias("tok"))
    shared = scratch.keep(entries.groupBy("tok").agg(F.count("*").alias("c")).where("c > 1"), "shared")
    entries = scratch.keep(entries.join(shared.withColumnRenamed("tok", "t"), F.col("tok") == F.col("t")).select("tok", "id", "c"), "entries")
    weight = entries.groupBy(F.col("id").alias("i")).agg(F.sum("c").alias("weight"))
    about = sets.drop("prefix", "fp").withColumnRenamed("id", "i2").join(weight, F.col("i2") == F.col("i")).drop("i")
    about = scratch.keep(about.join(found, F.col("i2") == F.col("node"), "left").withColumn("root", F.coalesce("root", "i2")).drop("node"), "about")
    members = scratch.keep(entries.select("tok", "id").join(about, F.col("id") == F.col("i2")).drop("i2"), "members")
    scratch.drop("sets", "shared", "entries", "about", "hash-components")
    cols = ["id", "n", *(f"w{i}" for i in range(MAP_WORDS)), "root"]
    centres = members.groupBy("tok").agg(F.max(F.struct("weight", *cols)).alias("m")).select("tok", *(f"m.{c}" for c in cols))
    star = scratch.keep(similar_pairs(members.alias("x"), centres.alias("y"), least_similarity, F.col("x.root") != F.col("y.root")), "pairs-star")
    links1 = verified(star, texts, least_similarity, shingle, scratch, "star")
    scratch.drop("bodies-star")
    found = scratch.keep(components(links0.union(links1), scratch), "star-components")
    placed = members.select("tok", "id").join(found, F.col("id") == F.col("node"), "left").select("tok", F.coalesce("root", "id").alias("root"))
    mixed = placed.groupBy(F.col("tok").alias("t")).agg(F.min("root").alias("one"), F.max("root").alias("other")).where("one <> other").select("t")
    open_ = members.drop("root").join(scratch.keep(mixed, "mixed"), F.col("tok") == F.col("t"), "left_semi")
    open_ = scratch.keep(open_.join(found, F.col("id") == F.col("node"), "left").select("tok", *cols[:-1], F.coalesce("root", "id").alias("root")), "open")
    scratch.drop("members", "mixed")
    rest = similar_pairs(open_.alias("x"), open_.alias("y"), least_similarity, (F.col("x.id") < F.col("y.id")) & (F.col("x.root") != F.col("y.root")))
    rest = scratch.keep(rest.join(star, ["a", "b"], "left_anti"), "pairs-rest")
    scratch.drop("open", "pairs-star", "star-components")
    links2 = verified(rest, texts, least_similarity, shingle, scratch, "rest")
    scratch.drop("bodies-rest", "pairs-rest")
    return components(links0.union(links1).union(links2), scratch)


def drop_near_duplicates(docs: DataFrame, least_similarity: float = SIMILARITY, shingle: int = NEAR_WORDS, hashes=HASHES) -> DataFrame:
    """docs without near copies: of each group the row with the least doc_id stays; columns as in docs, whatever their names.

    Groups are the components of all pairs of texts with a similarity of least_similarity or more, found by SimHash and
    a prefix filter that misses none, and compared exactly over whole texts. Null counts as the empty text; all empty
    texts are copies. A null doc_id stands behind all others. Wholly repeated (doc_id, text) rows leave one row.
    hashes: the two that stand for a text.
    """
    scratch = Scratch(docs.sparkSession, "near")
    rows = docs.select(whole_row(), F.col("doc_id").alias("doc__"), text_of().alias("text__"), text_key(hashes).alias("t"))
    texts = rows.groupBy("t").agg(F.min("doc__").alias("least"), F.first("text__").alias("text"))
    texts = scratch.keep(texts.withColumn("id", F.monotonically_increasing_id()), "texts")
    found = scratch.keep(similar_groups(texts.select("id", "text"), least_similarity, shingle, scratch), "components")
    placed = texts.select("id", "t", "least").join(found, F.col("id") == F.col("node"), "left")
    first = placed.groupBy(F.coalesce("root", "id").alias("root")).agg(F.min(F.struct(F.col("least").isNull().alias("null"), "least", "t")).alias("f"))
    stay = scratch.keep(first.select(F.col("f.t.a").alias("a"), F.col("f.t.b").alias("b"), F.col("f.least").alias("least")), "stay")
    scratch.drop("texts", "components", "links-hash", "links-star", "links-rest")
    same = (F.col("t.a") == F.col("a")) & (F.col("t.b") == F.col("b")) & F.col("doc__").eqNullSafe(F.col("least"))
    out = rows.join(stay, same).select("row__", "a", "b")
    # does a text that stays stand twice under one doc_id?
    if rows.select("t", "doc__").join(stay, same).count() > stay.count():
        out = out.dropDuplicates(["a", "b"])
    return out.select("row__.*")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return written(spark, "components", lambda: near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))
