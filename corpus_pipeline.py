"""From raw documents to token files: five stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir); its rows are written as Parquet and read again for the next.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gravitrove.llm import common, decontamination, mixing, quality, similar, tokens


def _apart(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work(docs) with the columns of docs as they were: an operator may add columns of the same names."""
    held = {c: f"held_{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text", "source")}
    return work(docs.withColumnsRenamed(held)).select(*[F.col(held.get(c, c)).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep; null and empty texts go, repeated rows share their verdict."""
    return _apart(docs, lambda held: quality.quality(held).where("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no near copy precedes (five-word shingles, similarity of 0.8 or more).

    Candidates come from the SimHash index and, where similar texts differ in more bits than it guarantees, from MinHash
    bands. One row of each group stays, repeated rows and rows without words included; see similar.without_near_copies.
    """
    return similar.without_near_copies(docs, size=5, least=0.8)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage, judged by their text alone: ids may be null or shared."""
    return decontamination.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: never, once or twice.

    A null source is a source; rows of one id move together; texts without words take part but don't count.
    """
    return _apart(docs, lambda held: mixing.mix(held, mixing.ranked_weights).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the token files, as read back: doc_id, start, n_tokens, ids_crc32.

    A row each, null ids first, repeated rows each for themselves; a text without words is the end id alone.
    """
    return tokens.tokenized(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicate removal", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("source mix", source_mix),
    ("token files", token_files),
]

#: SQL can express neither MinHash bands nor the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table documents."""
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
