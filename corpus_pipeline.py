"""The corpus pipeline: five stages over documents, each writing Parquet that the next reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.byte_bpe import tokenize
from graphloom.llm.common import Scratch, text_of, written
from graphloom.llm.mixing import mix
from graphloom.llm.quality_rules import keep_good
from graphloom.llm.simhash import drop_near_duplicates
from graphloom.llm.suffix_dedup import remove_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the risk-controlled rules keep.

    Null, empty and short texts go by the base rules. Equal texts of one language get equal verdicts; a null language is
    one of its own. An empty table stays empty; columns of any name pass.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: the one with the least doc_id, a null one last.

    All null and empty texts are copies of each other; repeated rows leave one. An empty table stays empty; columns of any
    name pass.
    """
    return drop_near_duplicates(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the whole characters of every 200-byte string that also starts elsewhere; n_chars follows.

    Null texts become empty ones; texts that repeat whole (200 bytes or more) become empty. Every row stays; an empty table
    stays empty; columns of any name pass.
    """
    kept = remove_repeats(docs, kept_text=True)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return kept.select(*(new[c].alias(c) if c in new else F.col("row__").getField(c).alias(c) for c in docs.columns))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them.

    Null and empty texts have size 0 and are taken like others; a null source is one; repeated rows draw alike. An empty
    table stays empty; columns of any name pass.
    """
    return mix(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids (little-endian unsigned 32-bit integers) and whether they decode to the text.

    Null and empty texts have no ids. One row per row; an empty table stays empty; other columns are not read.
    """
    import public_tokenizers as tokenizers

    rows = docs.select("doc_id", "source", "text", F.sha2(text_of(), 256).alias("text_sha256"))
    out = tokenize(rows, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
    return out.select("row__.doc_id", "row__.source", F.expr("cast(length(ids) div 4 as bigint)").alias("n_tokens"), "ids", (F.sha2("bytes", 256) == F.col("row__.text_sha256")).alias("decodes"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("mixing", mixing),
    ("byte_bpe", byte_bpe),
]
#: No SQL: SimHash, suffix arrays and BPE are beyond it. The stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written to the shared folder and read again."""
    scratch, before = Scratch(spark, "pipeline"), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(spark, name, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), scratch)
        if before:
            scratch.drop(before)
        before = name
    return docs
