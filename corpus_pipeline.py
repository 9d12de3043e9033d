"""A training corpus from ``documents`` in five stages.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept; ``run`` writes every stage's
result as Parquet in the shared folder and reads it again for the next.  All stages but the last return the columns
of ``documents``.

1. quality: rejects documents that the line classifier scores under 0.7.
2. near duplicates: one document of each group linked by 5-word shingles at Jaccard 0.8 stays.
3. decontamination: documents with a benchmark passage go.
4. secrets: what the scan finds is replaced by a placeholder; ``n_chars`` follows the text.
5. packing: token pieces with their sequences and places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readlake.llm import decontaminate, jaccard, packing, quality, secrets
from readlake.llm.shared import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from labelled rows of the whole ``documents`` table."""
    model = quality.fit_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), folds=4, held_out=2)
    return quality.accepted(docs, model, threshold=0.7)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that with the smallest id; rows without words all stay, as do rows that
    share an id but not the text."""
    return jaccard.one_of_each(docs, written(jaccard.shingle_groups(docs, shingle=5, percent=80)))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in whose text no item of ``benchmark`` is found; null and empty texts stay, an empty benchmark drops none."""
    return decontaminate.without_leaks(docs, _table(spark, sf_dir, "benchmark"), shingle=5, percent=80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, secrets replaced in its text and ``n_chars`` counted again where something was; null texts stay null."""
    return secrets.with_redactions(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every row's tokens (null text: its end token alone)
    in sequences of 2,048; repeated rows are packed each."""
    import public_tokenizers

    pieces = written(packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), 2048, 0))
    placed = packing.place(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), 2048)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality", keep_quality),
    ("near duplicates", keep_one_of_each),
    ("decontamination", drop_leaks),
    ("secrets", redact_secrets),
    ("packing", pack),
]
#: Models and tokenizers take part, so SQL can't express it; tests hold it against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole of ``documents``, each on what the one before wrote; an empty table gives no rows."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
