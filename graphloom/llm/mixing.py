"""Mixing sources to target weights: capped shares, then whole copies and one hash-seeded Bernoulli copy.

Native: DataFrame functions only. Every pass over the documents aggregates before it shuffles, and what is
shuffled is one row of sums per source and task, so a source with a third of all rows costs no more than another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import WORD, Scratch, small, text_of, written

#: Weights by rank of the source, repeating.
WEIGHTS = (1, 2, 3)
#: A source is taken at most so many times.
MAX_RATE = 3
#: Candidate seeds of the Bernoulli draws; per source the one whose mix comes nearest its target is used.
SEEDS = 16


def draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the row's key and the seed: 32 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed // 4}|"), key))
    return F.conv(F.substring(digest, seed % 4 * 8 + 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """(source, source_size, target) of rows (source, size).

    Sources rank by code point, null last, and weigh `weights` in turn. With all sizes T, the target is
    min(max_rate * size, L * weight), where L spends T exactly: the fixed point of resharing each excess by weight.
    L is the largest of (T - capped before i) / (weights from i on) over sources i ascending by size / weight.
    The windows run over one row per source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by_source.select("source", "source_size", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).alias("rank"))
    weigh = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long")
    order = [F.col("full") / F.col("weight"), F.col("rank")]
    before, after = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = ranked.select("source", "source_size", "rank", weigh.alias("weight"), (F.col("source_size") * max_rate).alias("full"))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(before), F.lit(0))) / F.sum("weight").over(after)
    leveled = full.withColumn("level", level)
    return leveled.select("source", "source_size", F.least(F.col("full").cast("double"), F.max("level").over(everything) * F.col("weight")).alias("target"))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE, seeds: int = SEEDS, carry: bool = False) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate, copies, and with `carry` its row as the struct row__.

    size counts words (null text: 0). copies is floor(rate) plus 1 where the row's draw is under the rate's
    fraction; rate is target / source_size, 0 where the source holds no word. Equal (doc_id, size) draw alike, so
    reruns and repeated rows agree. A null source is a source; an empty table gives an empty plan.
    Other columns of docs, whatever their names, are not looked at. `copies` <= max_rate always.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    key = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("size").cast("string"))
    sizes = docs.select("doc_id", F.col("source").cast("string").alias("source"), *([F.struct("*").alias("row__")] if carry else []), F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"))
    if not carry:
        sizes = scratch.keep(sizes, "sizes")
    goal = scratch.keep(targets(sizes.select("source", "size"), weights, max_rate).coalesce(1), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))

    def joined(to: DataFrame) -> DataFrame:
        t = small(to.withColumnRenamed("source", "goal_source"))
        return sizes.join(t, F.col("source").eqNullSafe(F.col("goal_source")), "inner").drop("goal_source")

    whole = F.floor("rate")
    copies = lambda seed: whole + (draw(key, seed) < F.col("rate") - whole).cast("long")
    sums = joined(goal).withColumn("rate", rate).groupBy("source").agg(*(F.sum(copies(s) * F.col("size")).alias(f"taken_{s}") for s in range(seeds)))
    off = F.array(*(F.struct(F.abs(F.col(f"taken_{s}") - F.col("target")).alias("off"), F.lit(s).alias("seed")) for s in range(seeds)))
    goal2 = goal.withColumnRenamed("source", "goal_source").join(sums, F.col("goal_source").eqNullSafe(F.col("source")), "inner")
    chosen = scratch.keep(goal2.select("source", "source_size", "target", F.array_min(off)["seed"].alias("seed")).coalesce(1), "chosen")
    digest = F.md5(F.concat(F.floor(F.col("seed") / 4).cast("string"), F.lit("|"), key))
    u = F.conv(F.substring(digest, (F.col("seed") % 4 * 8 + 1).cast("int"), F.lit(8)), 16, 10).cast("double") / F.lit(4294967296.0)
    return joined(chosen).withColumn("rate", rate).withColumn("copies", whole + (u < F.col("rate") - whole).cast("long")).drop("seed")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as many times as its plan says; columns as in docs."""
    plan = mix_plan(docs, carry=True, **options).where("copies > 0")
    return plan.select("row__", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row__.*")


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return written(spark, "mix", lambda: mix_plan(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")))


def _oracle() -> str:
    draws = ", ".join(f"CAST('0x' || substr(md5('{s // 4}|' || k), {s % 4 * 8 + 1}, 8) AS BIGINT) / 4294967296.0 AS u{s}" for s in range(SEEDS))
    sums = ", ".join(f"abs(sum((whole + CASE WHEN u{s} < frac THEN 1 ELSE 0 END) * size) - any_value(target)) AS d{s}" for s in range(SEEDS))
    least = "least(" + ", ".join(f"d{s}" for s in range(SEEDS)) + ")"
    pick = "CASE " + " ".join(f"WHEN d{s} = {least} THEN {s}" for s in range(SEEDS)) + " END"
    u = "CASE seed " + " ".join(f"WHEN {s} THEN u{s}" for s in range(SEEDS)) + " END"
    return f"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rk FROM sizes GROUP BY source),
weighed AS (SELECT *, CAST((rk - 1) % 3 + 1 AS BIGINT) AS weight, 3 * source_size AS most FROM sources),
leveled AS (
  SELECT *, ((SELECT sum(source_size) FROM sources) - coalesce(sum(most) OVER (ORDER BY CAST(most AS DOUBLE) / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / CAST(sum(weight) OVER (ORDER BY CAST(most AS DOUBLE) / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM weighed),
goal AS (SELECT source, source_size, least(CAST(most AS DOUBLE), (SELECT max(level) FROM leveled) * weight) AS target FROM leveled),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM goal),
drawn AS (
  SELECT d.doc_id, d.source, d.size, r.source_size, r.target, floor(rate) AS whole, rate - floor(rate) AS frac, {draws}
  FROM (SELECT *, coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || size AS k FROM sizes) d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
offs AS (SELECT source, {sums} FROM drawn GROUP BY source),
seeds AS (SELECT source, {pick} AS seed FROM offs)
SELECT doc_id, size, source_size, target, CAST((whole + CASE WHEN {u} < frac THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM drawn JOIN seeds ON drawn.source IS NOT DISTINCT FROM seeds.source"""


ORACLE = _oracle()
