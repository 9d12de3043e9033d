"""The operators of this package on the given tables, each as one registered query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readlake.llm import bottomk, centroids, chats, decontaminate, jaccard, merkle, neighbours, packing, pitman_yor, quality, records, secrets, toxicity
from readlake.llm.labelled import fold
from readlake.llm.shared import written


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = written(packing.token_pieces(docs, _vocabulary("word_bpe_49k.json"), 2048, 0))
    digests = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.place(digests, 2048).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = records.write_token_records(docs, _vocabulary("byte_bpe_50k.json"), 2)
    return records.read_token_records(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return decontaminate.find_leaks(docs, benchmark, shingle=5, percent=80)


def op4_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), folds=7, held_out=2)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return secrets.secret_digest(secrets.find_secrets(docs))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard.shingle_groups(docs, shingle=3, percent=90)


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_quality(docs, labels, folds=4, held_out=2)
    scored = quality.score_quality(docs, model, threshold=0.7)
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op8_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.render_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op9_vantage_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = neighbours.usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return neighbours.nearest(vectors, vectors.where("id % 50 = 0"), k=5)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_toxicity(docs, labels, folds=5, held_out=0)
    scored = toxicity.score_toxicity(docs, model, threshold=0.5)
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op11_bottomk_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottomk.sketch_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=5, percent=85)


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = centroids.usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return centroids.cluster(vectors, k=8, rounds=10, seed=3, scale=1024)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"), forged_by=7)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_token_records": op2_token_records,
    "op3_decontamination": op3_decontamination,
    "op4_pitman_yor": op4_pitman_yor,
    "op5_secret_scan": op5_secret_scan,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_line_quality": op7_line_quality,
    "op8_chat_snapshots": op8_chat_snapshots,
    "op9_vantage_neighbours": op9_vantage_neighbours,
    "op10_toxicity": op10_toxicity,
    "op11_bottomk_groups": op11_bottomk_groups,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_merkle_manifest": op13_merkle_manifest,
}
ORACLE: dict[str, str] = {"op8_chat_snapshots": chats.ORACLE, "op12_centroid_clusters": centroids.ORACLE, "op13_merkle_manifest": merkle.ORACLE}
