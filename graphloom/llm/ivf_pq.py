"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Centroids and codebooks are fitted on a bounded sample (SAMPLE_ROWS) and are small; every row is indexed. Lists are
cut into blocks of about BLOCK_ROWS rows, so a list that holds a third of all rows is many blocks, and queries into
groups of about QUERY_ROWS. A query goes first to the blocks of its nearest lists, as many as it takes to reach PROBE_SHARE of
all rows, and RERANK of them at least; there an asymmetric distance table ranks the codes, and the best RERANK rows are
ranked again by the exact distance. The k-th distance found bounds what is left: the query then goes to every other list whose
ball may reach within it, and in each block every row whose coded distance, less the error of its code, may lie within it is
ranked exactly too. So no nearest row is missed, however the rows lie; how well they cluster decides only the work.
The merge keeps k rows per query and block, never a pair beyond.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import Scratch, small, written

#: Documented bounds and parameters: rows fitted on, most lists, share of rows probed first, sub-spaces, code words, rows reranked per block, rows of a block, queries of a group.
SAMPLE_ROWS, MAX_LISTS, PROBE_SHARE, SUBSPACES, CODES, RERANK, BLOCK_ROWS, QUERY_ROWS = 20_000, 4096, 0.05, 16, 256, 200, 4096, 4096
#: What rounding may add to a distance, as a part of the lengths it comes from.
SLACK = 1e-9


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Centroids of x by Lloyd's steps from distinct random rows; at most as many as there are distinct rows."""
    rows = np.unique(x, axis=0)
    c = rows[np.random.default_rng(seed).permutation(len(rows))[:k]].copy()
    for _ in range(rounds):
        at = nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    norm = (c**2).sum(axis=1)
    for at in range(0, len(x), 4096):
        out[at : at + 4096] = (norm - 2 * x[at : at + 4096] @ c.T).argmin(axis=1)
    return out


def fit(sample: np.ndarray, lists: int, subspaces: int = SUBSPACES, codes: int = CODES) -> tuple[np.ndarray, list[np.ndarray]]:
    """Coarse centroids, and one codebook of residuals per sub-space (a contiguous run of components)."""
    centroids = kmeans(sample, lists)
    rest = sample - centroids[nearest(sample, centroids)]
    return centroids, [kmeans(part, codes, 6, i + 1) for i, part in enumerate(np.array_split(rest, min(subspaces, sample.shape[1]), axis=1))]


def encode(x: np.ndarray, centroids: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    at = nearest(x, centroids)
    rest = x - centroids[at]
    return at, np.column_stack([nearest(part, book) for part, book in zip(np.array_split(rest, len(books), axis=1), books, strict=True)]).astype(np.uint8)


def decode(at: np.ndarray, codes: np.ndarray, centroids: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    """The vectors that codes stand for."""
    return centroids[at] + np.column_stack([book[codes[:, m]] for m, book in enumerate(books)])


def length(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x**2).sum(axis=-1))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id (long) and vec (array<double>) of the rows whose vector is not null, empty or zero and holds only finite numbers."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("vec")).where(F.col("id").isNotNull() & F.col("vec").isNotNull() & fine)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, probe_share: float = PROBE_SHARE, sample_rows: int = SAMPLE_ROWS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest rows found, by (Euclidean distance, vec_id).

    vectors and queries hold id_col and vec_col; a query's own id is no candidate. Rows with a null id, or a vector
    that is null, empty, zero, of another length than most, or holds null or non-finite components, take no part.
    Repeated ids are candidates of their own; a repeated query row is one query, an id with two vectors two.
    Columns beside the two are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ivf")
    rows = scratch.keep(usable(vectors, id_col, vec_col), "rows")
    n = rows.count()
    empty = "query_id long, rank int, vec_id long, score double"
    lengths = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not n or not lengths:
        return spark.createDataFrame([], empty)
    dims = lengths[0]["d"]
    rows = rows.where(F.size("vec") == dims)
    share = min(1.0, sample_rows / n)
    got = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < math.ceil(share * 1_000_000)).select("vec").limit(2 * sample_rows).toArrow()
    if not got.num_rows:
        got = rows.select("vec").limit(sample_rows).toArrow()
    sample = got["vec"].combine_chunks().flatten().to_numpy().reshape(-1, dims)
    sample = sample[np.lexsort(sample.T[::-1])]
    lists = int(min(MAX_LISTS, max(1, math.sqrt(n) / 2), max(1, len(sample) / 8)))
    centroids, books = fit(sample, lists)
    lists = len(centroids)
    model = spark.sparkContext.broadcast((centroids, books))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cs, bs = model.value
        for batch in batches:
            x = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            if len(x):
                at, codes = encode(x, cs, bs)
                off, far = length(x - decode(at, codes, cs, bs)), length(x - cs[at])
                yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("id"), batch.column("vec"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(off), pa.array(far)], names=["list", "id", "vec", "code", "off", "far"])

    indexed = rows.mapInArrow(index, "list long, id long, vec array<double>, code binary, off double, far double")
    indexed = scratch.keep(indexed, "index")
    counts = scratch.keep(indexed.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("radius")).coalesce(1), "sizes")
    held, radius = np.zeros(lists, np.int64), np.zeros(lists)
    for r in counts.collect():  # one row per list, MAX_LISTS at most
        held[r["list"]], radius[r["list"]] = r["n"], r["radius"]
    reach = max(probe_share * held.sum(), min(max(RERANK, k), int(held.sum())))
    sizes = small(counts.select("list", F.ceil(F.col("n") / BLOCK_ROWS).alias("cuts")))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cs, _ = model.value
        for batch in batches:
            x = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            if len(x):
                order = np.argsort((cs**2).sum(axis=1) - 2 * x @ cs.T, axis=1, kind="stable")
                probes = (np.cumsum(held[order], axis=1) < reach).sum(axis=1) + 1
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), pa.array([o[:p].tolist() for o, p in zip(order, probes.tolist(), strict=True)], pa.list_(pa.int64()))], names=["id", "vec", "lists"])

    asked = usable(queries, id_col, vec_col).where(F.size("vec") == dims).dropDuplicates(["id", "vec"])
    asked = scratch.keep(asked.mapInArrow(probe, "id long, vec array<double>, lists array<long>").withColumns({"qnum": F.monotonically_increasing_id(), "most": F.lit(float("inf"))}), "asked")
    groups = max(1, math.ceil(asked.count() / QUERY_ROWS))
    stored = indexed.join(sizes, "list").withColumn("cut", F.pmod(F.xxhash64("id", "vec"), F.col("cuts"))).drop("cuts")
    stored = stored.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def sent(to: DataFrame) -> DataFrame:
        """Queries beside each block of their lists."""
        each = to.select("id", "vec", "qnum", "most", F.explode("lists").alias("list")).join(sizes, "list")
        return each.select(F.col("list").alias("qlist"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cuts") - 1)).alias("qcut"), F.pmod(F.xxhash64("qnum"), F.lit(groups)).cast("int").alias("qgrp"), F.col("id").alias("qid"), "qnum", F.col("vec").alias("qvec"), "most")

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with the lists not probed yet that may hold a row within `most`."""
        cs, _ = model.value
        for batch in batches:
            x = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            left = []
            for vec, most, seen in zip(x, batch.column("most").to_pylist(), batch.column("lists").to_pylist(), strict=True):
                at = length(cs - vec)
                # what is not a number rules nothing out
                may = ~(at - radius - SLACK * (at + radius + length(vec)) > most) & (held > 0)
                may[seen] = False
                left.append(np.flatnonzero(may).tolist())
            if len(x):
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), pa.array(left, pa.list_(pa.int64())), batch.column("qnum"), batch.column("most")], names=["id", "vec", "lists", "qnum", "most"])

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        cs, bs = model.value
        out = {"query_id": [], "qnum": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            x = left["vec"].combine_chunks().flatten().to_numpy().reshape(-1, dims)
            ids, off = left["id"].to_numpy(), left["off"].to_numpy()
            codes = np.frombuffer(b"".join(left["code"].to_pylist()), np.uint8).reshape(len(ids), -1)
            q = right["qvec"].combine_chunks().flatten().to_numpy().reshape(-1, dims)
            rest = q - cs[left["list"][0].as_py()]
            parts = np.array_split(rest, len(bs), axis=1)
            for i, (qid, num, vec, most) in enumerate(zip(right["qid"].to_pylist(), right["qnum"].to_pylist(), q, right["most"].to_pylist(), strict=True)):
                # asymmetric distances: one table row per sub-space, then a sum of look-ups
                adc = np.zeros(len(ids))
                for m, (part, book) in enumerate(zip(parts, bs, strict=True)):
                    adc += ((part[i] - book) ** 2).sum(axis=1)[codes[:, m]]
                near = np.sqrt(adc)
                least = near - off - SLACK * (near + off + length(vec))
                other = np.flatnonzero((ids != qid) & ~(least > most))
                if len(other) > max(RERANK, k):
                    first = np.argpartition(adc[other], max(RERANK, k))[: max(RERANK, k)]
                    within = np.partition(length(x[other[first]] - vec), k - 1)[k - 1]
                    other = other[~(least[other] > within)]
                d = length(x[other] - vec)
                best = np.lexsort((ids[other], d))[:k]
                out["query_id"] += [qid] * len(best)
                out["qnum"] += [num] * len(best)
                out["vec_id"] += ids[other][best].tolist()
                out["score"] += d[best].tolist()
        return pa.table(out, pa.schema([("query_id", pa.int64()), ("qnum", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    def found(to: DataFrame) -> DataFrame:
        return stored.groupBy("list", "cut", "grp").cogroup(sent(to).groupBy("qlist", "qcut", "qgrp")).applyInArrow(rank, "query_id long, qnum long, vec_id long, score double")

    def ranked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qnum").orderBy("score", "vec_id"))).where(F.col("rank") <= k)

    first = scratch.keep(ranked(found(asked)), "first")
    reached = first.where(F.col("rank") == k).select("qnum", F.col("score").alias("most"))
    again = scratch.keep(asked.drop("most").join(reached, "qnum", "left").select("id", "vec", "lists", "qnum", F.coalesce("most", F.lit(float("inf"))).alias("most")).mapInArrow(rest, asked.select("id", "vec", "lists", "qnum", "most").schema), "again")
    both = first.drop("rank").unionByName(found(again))
    return ranked(both).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_ivf_pq(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return written(spark, "neighbours", lambda: search(vectors, vectors.where("vec_id % 100 = 0")))
