"""A training corpus from documents: language, exact copies, near copies, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, decontam, exact, langid, minhash
from gridloom.llm.common import fresh, release, scratch, stored

#: Below this mean marginal no language holds most of a text.
MIN_LANGUAGE_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of some language stay: those without a letter (null and empty texts too), or whose words agree on no language, go.

    Each row is judged by its text alone, so ids may repeat or be null. Columns may have any name. Without a row that tells its language, nothing can be learned, and all go.
    """
    return langid.of_a_language(docs, MIN_LANGUAGE_SCORE)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, that of the largest id; null is an empty text. Of rows that repeat an id and a text, one stays."""
    return exact.exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least id.

    Rows are told apart by id and text, as an id may repeat with other texts. Rows with a null id, and texts without words, are in no group and stay. Columns may have any name.
    """
    gone = stored(minhash.near_groups(docs, digests=True).where(~F.col("kept")).select("doc_id", "text_sha256").distinct(), "gone")
    i, t = fresh(docs, "id"), fresh(docs, "digest")
    keyed = docs.withColumns({i: F.col("doc_id").cast("long"), t: F.sha2(F.coalesce("text", F.lit("")), 256)})
    return keyed.join(gone.hint("merge"), (keyed[i] == gone["doc_id"]) & (keyed[t] == gone["text_sha256"]), "left_anti").drop(i, t)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go: 13 of its words in a row or more, however long the document, or a twentieth of the document's words.

    Each row is judged by its text alone, so ids may repeat or be null; null and empty texts stay. Columns may have any name.
    """
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row; null and empty texts have no tokens."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), ids=False, decoded=False, digests=True)


STAGES = [
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("benchmark_passages", benchmark_passages),
    ("tokens", tokens),
]

#: A learned model decides the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has written goes when the next one's documents are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch() as kept:
            kept.append(new := stored(stage(spark, docs, sf_dir), name))
        release(docs)
        docs = new
    return STAGES[-1][1](spark, docs, sf_dir)
