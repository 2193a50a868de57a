"""Quality classifier: a sparse rule ensemble.

Small trees, grown by boosting on a bounded sample of labelled rows, give conjunctive rules over document statistics
(every path from the root). A logistic model with an L1 penalty weights the rules, most weights become zero, and the
rest compile into one Spark column expression that scores every document.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import Scratch, fraction_crc32, text_of, written
from graphloom.llm.doc_stats import with_stats

#: The bound of the sample the trees and weights are fitted on, in rows (documented parameter).
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, SHRINK, LASSO, STEPS = 24, 3, 32, 0.3, 0.001, 400
THRESHOLD = 0.3

#: Features over the statistics, as SQL.
FEATURES: dict[str, str] = {
    "log_words": "ln(1 + n_words)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_per_char": "n_upper / greatest(word_chars, 1)",
    "digit_per_char": "n_digits / greatest(word_chars, 1)",
    "bangs_per_word": "n_bangs / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}

#: A condition is (feature, 'le' or 'gt', cutoff); a rule is a sorted tuple of conditions.
Rule = tuple[tuple[str, str, float], ...]


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    intercept: float

    def score(self) -> Column:
        """The probability of label 1, as a column over FEATURES' columns."""
        z = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            hit = F.lit(True)
            for name, side, cutoff in rule:
                hit = hit & ((F.col(name) <= F.lit(cutoff)) if side == "le" else (F.col(name) > F.lit(cutoff)))
            z = z + F.when(hit, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def describe(self) -> list[str]:
        return [f"{w:+.3f}: " + " and ".join(f"{n} {'<=' if s == 'le' else '>'} {c:.4g}" for n, s, c in r) for r, w in zip(self.rules, self.weights, strict=True)]


def grow(x: np.ndarray, cuts: list[np.ndarray], binned: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, names: list[str]) -> tuple[list[Rule], np.ndarray]:
    """A tree on gradients g and Hessians h; the rules of all its paths, and its prediction."""
    rules: list[Rule] = []
    out = np.zeros(len(g))

    def split(rows: np.ndarray, path: dict, left: int) -> None:
        gs, hs = g[rows].sum(), h[rows].sum()
        out[rows] = gs / (hs + 1.0)
        if path:
            rules.append(tuple(sorted((n, s, c) for (n, s), c in path.items())))
        if not left or len(rows) < 20:
            return
        best = (1e-6, None)
        for f in range(len(names)):
            gb = np.bincount(binned[rows, f], g[rows], len(cuts[f]) + 1)
            hb = np.bincount(binned[rows, f], h[rows], len(cuts[f]) + 1)
            nb = np.bincount(binned[rows, f], minlength=len(cuts[f]) + 1)
            gl, hl, nl = gb.cumsum()[:-1], hb.cumsum()[:-1], nb.cumsum()[:-1]
            gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
            gain[(nl < 5) | (len(rows) - nl < 5)] = 0
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), (f, int(gain.argmax())))
        if best[1] is None:
            return
        f, b = best[1]
        cutoff, low = float(cuts[f][b]), binned[rows, f] <= b
        name = names[f]
        split(rows[low], path | {(name, "le"): min(cutoff, path.get((name, "le"), math.inf))}, left - 1)
        split(rows[~low], path | {(name, "gt"): max(cutoff, path.get((name, "gt"), -math.inf))}, left - 1)

    split(np.arange(len(g)), {}, depth)
    return rules, out


def holds(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for name, side, cutoff in rule:
        v = x[:, names.index(name)]
        hit &= v <= cutoff if side == "le" else v > cutoff
    return hit


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Logistic weights with an L1 penalty (none on the intercept), by accelerated proximal gradient steps."""
    n, m = r.shape
    lip = 0.25 * (np.linalg.norm(np.hstack([r, np.ones((n, 1))]), 2) ** 2) / n if n else 1.0
    w, b = np.zeros(m), 0.0
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(r @ vw + vb, -30, 30)))
        e = (p - y) / n
        step = vw - (r.T @ e) / lip
        nw, nb = np.sign(step) * np.maximum(np.abs(step) - penalty / lip, 0), vb - e.sum() / lip
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = TREES, depth: int = DEPTH, penalty: float = LASSO) -> RuleModel:
    """The rule model of features x (rows by names) and labels y. One class only, or no row: a constant model."""
    n, pos = len(y), float(y.sum())
    prior = math.log((pos + 0.5) / (n - pos + 0.5))
    if pos in (0, n):
        return RuleModel((), (), prior)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(len(names))]
    # a bin more where most values are one and the quantiles miss the rest
    cuts = [np.unique(np.concatenate([c, np.quantile(v, np.linspace(0, 1, BINS + 1)[:-1])])) if len(v := x[x[:, f] > x[:, f].min(), f]) else c for f, c in enumerate(cuts)]
    binned = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
    z, found = np.full(n, prior), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        rules, out = grow(x, cuts, binned, y - p, p * (1 - p), depth, names)
        found |= dict.fromkeys(rules)
        z += SHRINK * out
    rules = list(found)
    if not rules:
        return RuleModel((), (), prior)
    hits = np.column_stack([holds(r, x, names) for r in rules]).astype(float)
    w, b = lasso(hits, y, penalty, STEPS)
    live = np.abs(w) > 1e-4
    return RuleModel(tuple(r for r, k in zip(rules, live, strict=True) if k), tuple(float(v) for v in w[live]), float(b))


def features(docs: DataFrame) -> DataFrame:
    """doc_id and FEATURES of every row of docs."""
    stats = with_stats(docs.select(F.struct("doc_id").alias("row__"), text_of().alias("text__")))
    return stats.select("row__.doc_id", *(F.expr(e).cast("double").alias(n) for n, e in FEATURES.items()))


def fit(features_: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, **options) -> RuleModel:
    """Fit on labelled rows; at most about sample_rows of them, picked by a hash of doc_id.

    labels: doc_id, quality. Null labels don't count; of several for a document, the least counts.
    """
    marks = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = features_.join(marks, "doc_id")
    n = rows.count()
    share = min(1.0, sample_rows / max(n, 1))
    picked = rows.where(F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1_000_000)) < F.lit(math.ceil(share * 1_000_000)))
    got = picked.select("doc_id", *FEATURES, "quality").toArrow().to_pandas().sort_values(["doc_id", *FEATURES])
    return fit_rules(got[list(FEATURES)].to_numpy(float), got["quality"].to_numpy(float), list(FEATURES), **options)


def classify(docs: DataFrame, labels: DataFrame, train: Column | None = None, threshold: float = THRESHOLD, **options) -> DataFrame:
    """doc_id, score, predicted for every row of docs. `train` says which documents may lend their labels (default: all).

    Null and empty texts are scored by the same rules (all statistics zero). Without labels the score is one constant.
    Repeated rows score alike, and count as often in the fit. Other columns of docs are not read.
    """
    scratch = Scratch(docs.sparkSession, "classifier")
    f = scratch.keep(features(docs), "features")
    model = fit(f if train is None else f.where(train), labels, **options)
    return f.select("doc_id", model.score().alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = fraction_crc32(F.col("doc_id"), 5) == 0
    return written(spark, "classified", lambda: classify(docs, labels, train=~held_out).select("doc_id", held_out.alias("held_out"), "score", "predicted"))
