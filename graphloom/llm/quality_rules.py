"""Quality rules whose cutoffs are risk-controlled.

The rules reject a document whose statistic passes a cutoff. The labelled documents are split by a hash of their ids.
One part (TUNE) makes a ladder of cutoff sets, from lenient to strict, out of the statistics of its good documents, and
says how far to go: to the step that catches most of its bad documents for the good ones it costs. The other part is the
holdout: per stratum, the ladder is walked from the lenient end while the exact (Clopper-Pearson) upper bound of the
share of good documents that the rules reject stays at or under `risk`, at confidence 1 - delta / strata:
fixed-sequence testing needs no further correction along the ladder, which the holdout did not choose; Bonferroni covers the strata.
With probability 1 - delta, every stratum's false rejection is at most `risk`. A stratum with too few good labelled
documents gets no cutoffs and rejects nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import Scratch, arrow_map, small, text_of, whole_row, written
from graphloom.llm.doc_stats import STATS, with_stats

MIN_WORDS = 50
RISK, DELTA = 0.05, 0.05
#: One in so many labelled documents makes the ladder; the others certify it.
TUNE = 4
#: A good document lost on the tuning part weighs as many bad ones caught.
LOSS = 20.0

#: The statistics under rule, each rejecting above its cutoff.
RULES: dict[str, str] = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "bangs_per_word": "n_bangs / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "upper_per_char": "n_upper / greatest(word_chars, 1)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
}
#: The steps of the ladder: above the greatest value of a good document, by a factor (and a tenth of what it adds); then quantiles.
FACTORS, QUANTILES = (3.0, 2.0, 1.5, 1.25, 1.1, 1.0), (0.9995, 0.999, 0.998, 0.995, 0.99)

#: One row of cutoffs per step, in the order of RULES.
Ladder = tuple[tuple[float, ...], ...]


def upper_bound(k: int, n: int, alpha: float) -> float:
    """Exact one-sided upper confidence bound of a proportion with k of n seen: the p at which P(X <= k) is alpha."""
    if n <= 0 or k >= n:
        return 1.0

    def at_most(p: float) -> float:
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
        top = max(logs)
        return math.exp(top) * math.fsum(math.exp(x - top) for x in logs)

    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if mid <= 0 or at_most(min(mid, 1 - 1e-15)) > alpha:
            low = max(mid, 1e-300)
        else:
            high = mid
    return high


def steps_held(counts: list[int], n: int, risk: float, alpha: float) -> int:
    """Certified steps, walking from the lenient end; counts[i]: good documents rejected at step i, of n."""
    held = 0
    for k in counts:
        if upper_bound(k, n, alpha) > risk:
            break
        held += 1
    return held


def first_step(ladder: Ladder) -> Column:
    """The first step (0-based) whose cutoffs reject a row of STATS; len(ladder) where none does. Steps only grow stricter."""
    out = F.lit(len(ladder))
    for i in reversed(range(len(ladder))):
        hit = F.lit(False)
        for expr, cutoff in zip(RULES.values(), ladder[i], strict=True):
            hit = hit | (F.expr(expr) > F.lit(float(cutoff)))
        out = F.when(hit, F.lit(i)).otherwise(out)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def tunes(doc_id: Column) -> Column:
    """Whether a document's label makes the ladder: by 32 bits of an MD5 of its id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("tune|"), doc_id.cast("string"))), 1, 8), 16, 10).cast("bigint") % TUNE == 0


def make_ladder(good: DataFrame) -> Ladder:
    """The steps from the STATS of the tuning part's good documents; none without a row."""
    values = [F.expr(e).cast("double") for e in RULES.values()]
    got = good.agg(F.count("*").alias("n"), F.array(*map(F.max, values)).alias("top"), F.array(*(F.percentile_approx(v, list(QUANTILES), 100_000) for v in values)).alias("q")).first()
    if not got["n"]:
        return ()
    steps = [[top * f + (f - 1) / 10 for top in got["top"]] for f in FACTORS]
    for i in range(len(QUANTILES)):
        steps.append([min(q[i], above) for q, above in zip(got["q"], steps[-1], strict=True)])
    return tuple(map(tuple, steps))


def steps_wanted(counts: list[tuple[int, int]]) -> int:
    """How many steps to walk at most; counts[i]: bad and good documents of the tuning part that step i is the first to reject, the last those that none does."""
    bad, good = (max(1, sum(x)) for x in zip(*counts, strict=True))
    best, want, caught, lost = 0.0, 0, 0, 0
    for i, (b, g) in enumerate(counts[:-1]):
        caught, lost = caught + b, lost + g
        if (gain := caught / bad - LOSS * lost / good) > best:
            best, want = gain, i + 1
    return want


@dataclass(frozen=True)
class Rules:
    """The ladder, cut where the tuning part says, and (stratum, held), the certified steps of every stratum with a good holdout document."""

    ladder: Ladder
    held: DataFrame

    def judge(self, stats: DataFrame, stratum: Column) -> DataFrame:
        """stats (row__, STATS) with base_failed, step (the first that rejects) and kept; the stratum is a column of them."""
        held = self.held.select(F.col("stratum").alias("of"), "held")
        judged = stats.withColumns({"stratum": stratum, "base_failed": base_failed(), "step": first_step(self.ladder)})
        judged = judged.join(small(held), F.col("stratum").eqNullSafe(F.col("of")), "left")
        return judged.withColumn("kept", ~F.col("base_failed") & (F.col("step") >= F.coalesce("held", F.lit(0)))).drop("stratum", "of", "held")


def calibrate(stats: DataFrame, labels: DataFrame, scratch: Scratch, risk: float = RISK, delta: float = DELTA) -> Rules:
    """The rules from all labelled documents that pass the base. stats: doc_id, stratum, STATS (one row per document).

    Good: every label of the doc_id is 1; bad: one is 0. Counts are summed by (stratum, step), and the ladders walked, on
    the executors; the driver sees the ladder's quantiles, the counts by step and the number of strata only.
    """
    marks = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = stats.where(~base_failed()).join(marks, "doc_id").withColumn("tune", tunes(F.col("doc_id")))
    known = scratch.keep(known.select("stratum", "quality", "tune", *STATS), "known")
    ladder = make_ladder(known.where("tune and quality = 1"))
    if ladder:
        seen = known.where("tune").groupBy(first_step(ladder).alias("step")).agg(F.count_if(F.col("quality") == 0).alias("bad"), F.count_if(F.col("quality") == 1).alias("good"))
        by = {r["step"]: (r["bad"], r["good"]) for r in seen.collect()}
        ladder = ladder[: steps_wanted([by.get(i, (0, 0)) for i in range(len(ladder) + 1)])]
    upto = [F.sum(F.when(F.col("step") <= i, F.col("n")).otherwise(0)) for i in range(len(ladder))]
    good = known.where("not tune and quality = 1").groupBy("stratum", first_step(ladder).alias("step")).agg(F.count("*").alias("n"))
    counts = scratch.keep(good.groupBy("stratum").agg(F.sum("n").alias("good"), (F.array(*upto) if upto else F.expr("cast(array() as array<bigint>)")).alias("counts")), "counts")
    level = delta / max(counts.count(), 1)

    def walk(batch: pa.RecordBatch) -> Iterator[dict]:
        seen = zip(batch.column("counts").to_pylist(), batch.column("good").to_pylist(), strict=True)
        yield {"stratum": batch.column("stratum"), "held": [steps_held(counts, n, risk, level) for counts, n in seen]}

    held = scratch.keep(arrow_map(counts, walk, "stratum string, held int"), "held")
    scratch.drop("known", "counts")
    return Rules(ladder, held)


def stratified(docs: DataFrame, stratum: str) -> DataFrame:
    return with_stats(docs.select(F.struct("doc_id", F.col(stratum).cast("string").alias("stratum")).alias("row__"), text_of().alias("text__")))


def verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **options) -> DataFrame:
    """One row per row of docs: doc_id, STATS, base_failed, step, kept.

    Null or empty texts have zero words, so they fail the base. A null stratum is one of its own. Labels of unknown
    documents don't count; with no label nothing but the base rejects. Repeated rows get equal verdicts. Columns of
    docs beside doc_id, text and the stratum are not read.
    """
    scratch = Scratch(docs.sparkSession, "rules")
    stats = scratch.keep(stratified(docs, stratum), "stats")
    rules = calibrate(stats.select("row__.*", *STATS), labels, scratch, **options)
    return rules.judge(stats, F.col("row__.stratum")).select("row__.doc_id", *STATS, "base_failed", "step", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **options) -> DataFrame:
    """The rows of docs that `verdicts` keeps, columns as in docs, whatever their names. The texts are read twice, once for
    the calibration, so that no row is written or shuffled."""
    scratch = Scratch(docs.sparkSession, "rules")
    stats = scratch.keep(stratified(docs, stratum), "stats")
    rules = calibrate(stats.select("row__.*", *STATS), labels, scratch, **options)
    scratch.drop("stats")
    rows = with_stats(docs.select(whole_row(), text_of().alias("text__")))
    return rules.judge(rows, F.col("row__")[stratum].cast("string")).where("kept").select("row__.*")


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return written(spark, "verdicts", lambda: verdicts(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))


def _oracle() -> str:
    """The whole query in SQL. A step holds where at most so many rejections of n would be seen with probability of `level` or
    less if the share were `risk`, which is the exact bound's condition."""
    rules = {k: e.replace(" / ", "::DOUBLE / ") for k, e in RULES.items()}
    values = ", ".join(f"{e} AS {k}" for k, e in rules.items())
    factors = " UNION ALL ".join(f"SELECT {i} AS k, {', '.join(f'max({r}) * {f} + {f - 1} / 10 AS {r}' for r in RULES)} FROM good" for i, f in enumerate(FACTORS))
    quantiles = " UNION ALL ".join(f"SELECT {len(FACTORS) + i} AS k, {', '.join(f'quantile_disc({r}, {q}) AS {r}' for r in RULES)} FROM good" for i, q in enumerate(QUANTILES))
    least = ", ".join(f"min({r}) OVER (ORDER BY k) AS {r}" for r in RULES)
    hit = " OR ".join(f"s.{r} > l.{r}" for r in RULES)
    steps = len(FACTORS) + len(QUANTILES)
    space = "[^\\x20\\x09-\\x0D]"
    return f"""
WITH d AS (SELECT doc_id, lang, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '{space}+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{space}')) AS ls FROM d),
win AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
twice AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, sum(CASE WHEN p IS NULL THEN 3 ELSE least(3, i - p) END) AS n FROM twice GROUP BY r),
stats AS (
  SELECT d.r, doc_id, lang, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, (length(t) - length(replace(t, '!!', ''))) // 2 AS n_bangs
  FROM d JOIN w USING (r) LEFT JOIN rep USING (r)),
s AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, {values} FROM stats),
marks AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
known AS (SELECT s.*, quality, CAST('0x' || substr(md5('tune|' || s.doc_id), 1, 8) AS BIGINT) % {TUNE} = 0 AS tune FROM s JOIN marks m ON s.doc_id = m.doc_id WHERE NOT base_failed),
good AS (SELECT * FROM known WHERE tune AND quality = 1),
ladder AS (SELECT k, {least} FROM ({factors} UNION ALL {quantiles}) WHERE EXISTS (SELECT 1 FROM good)),
first AS (SELECT s.r, min(k) AS step FROM s JOIN ladder l ON {hit} GROUP BY s.r),
seen AS (SELECT known.*, coalesce(step, {steps}) AS step FROM known LEFT JOIN first USING (r)),
gains AS (
  SELECT k, (SELECT count(*) FROM seen WHERE tune AND quality = 0 AND step <= k)::DOUBLE / greatest(1, (SELECT count(*) FROM seen WHERE tune AND quality = 0))
    - {LOSS} * (SELECT count(*) FROM seen WHERE tune AND quality = 1 AND step <= k) / greatest(1, (SELECT count(*) FROM seen WHERE tune AND quality = 1)) AS gain FROM ladder),
want AS (SELECT coalesce((SELECT min(k) + 1 FROM gains WHERE gain > 0 AND gain = (SELECT max(gain) FROM gains)), 0) AS want),
certify AS (SELECT lang, step FROM seen WHERE NOT tune AND quality = 1),
strata AS (SELECT lang, count(*) AS n FROM certify GROUP BY lang),
counts AS (SELECT strata.lang, n, k, (SELECT count(*) FROM certify c WHERE c.lang IS NOT DISTINCT FROM strata.lang AND step <= k) AS x FROM strata, ladder, want WHERE k < want),
tails AS (
  SELECT lang, k, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK}) + (n - i) * ln(1 - {RISK}))) AS p
  FROM (SELECT lang, n, k, unnest(range(0, x + 1)) AS i FROM counts) GROUP BY lang, k),
held AS (SELECT lang, coalesce(min(k) FILTER (p > {DELTA} / (SELECT count(*) FROM strata)), (SELECT want FROM want)) AS held FROM tails GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND least(coalesce(step, {steps}), want) >= coalesce(held, 0) AS kept
FROM s LEFT JOIN first ON s.r = first.r LEFT JOIN held ON s.lang IS NOT DISTINCT FROM held.lang, want"""


ORACLE = _oracle()
