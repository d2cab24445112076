"""The corpus pipeline: five stages, each a function (spark, docs, sf_dir) on all that the one before kept.

Every stage but the last returns the columns of ``documents`` and each one's decisions take effect: rejected documents go, one
document of each group of near copies stays, documents that hold a benchmark passage go, and the mix repeats or drops whole
documents (never parts of one) until the sources have their weights; the last stage writes token ids and returns what the files hold.
Nulls, ties, repeated rows and empty tables are handled as each operator's module says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontaminate, ngram_jaccard, quality, source_mix, token_parquet

#: At most so many copies of a document in the mix.
EPOCHS = 2


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4, fitted on all labels: documents that it rejects go."""
    return quality.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: one document of each group stays, that of the smallest doc_id."""
    return ngram_jaccard.first_of_each(docs)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that hold a passage of the benchmark go, however long they are."""
    return decontaminate.remove_affected(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: as many tokens as there are, at the target weights."""
    return source_mix.mixed_documents(docs, 1.0, source_mix.WEIGHTS, max_epochs=EPOCHS)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: doc_id, start, n_tokens, ids_crc32, lang, source of the rows in the files."""
    return token_parquet.encoded(docs, ("lang", "source"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_filter),
    ("mixing to weights", mixture),
    ("token-ID output", token_output),
]

#: Learnt scores and token ids have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written as Parquet and read again for the next."""
    from corpusloom.llm.common import shared_dir, stored

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = shared_dir(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"{base}/stage-{k}")
    return docs
