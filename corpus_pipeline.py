"""A training corpus from raw documents: five stages, each written as Parquet and read by the next.

Language id drops what has no recognised language, line de-duplication cuts repeated runs, near-duplicate
groups shrink to one document, sources are mixed to target weights, and what is left is tokenised.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadmill.llm import langid, linededup, minhash, mixing, pieces
from leadmill.llm.columns import col
from leadmill.llm.scratch import delete, shared_dir, temporary
from leadmill.llm.tasks import text_batches

#: The tokenizer's file, a name of the installed public tokenizers.
TOKENIZER = "piece_bpe_32k.model"
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    text_batches(spark)
    return langid.keep_known(docs, langid.fit(docs)).select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of lines that stand earlier in the corpus; one that had nothing else goes."""
    cut = linededup.dedup_lines(docs)
    lines, removed, _ = map(col, linededup.added(docs.columns))
    emptied = (removed > 0) & (removed == lines)
    return cut.where(~emptied).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of every group of near copies."""
    text_batches(spark)
    return minhash.keep_one_each(docs).select(*COLUMNS)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix of sources takes it."""
    return mixing.resample(docs).select(*COLUMNS)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids and byte spans of every document."""
    text_batches(spark)
    import public_tokenizers

    return pieces.encode(docs, pieces.read_model(public_tokenizers.path(TOKENIZER))).drop("decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_languages),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", one_of_each_group),
    ("source_mix", mixed_sources),
    ("sentencepiece", tokenized),
]

#: Viterbi over a trained model is not SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Only the last stage's table stays, in the shared folder; it is the caller's to delete."""
    import uuid

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex[:12]}"
    last = None
    for name, stage in STAGES:
        with temporary(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        if last:
            delete(spark, last)
        last = f"{root}/{name}"
    return docs
