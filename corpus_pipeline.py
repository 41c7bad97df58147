"""A training corpus from documents: five stages of the training-data operators, each over all that its
predecessor kept. Each takes (spark, docs, sf_dir); all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlens.llm import compression_quality, mixing, order_minhash, secrets, sentencepiece_nbest
from meshlens.llm.common import Scratch, table, unused
from meshlens.llm.queries import PIECES


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = compression_quality.fit(docs, table(spark, sf_dir, "labels"))
    names = unused(docs, "quality_score"), unused(docs, "quality_predicted")
    scored = compression_quality.score(docs, model, names=names)
    return scored.where(F.col(names[1]) == 1).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: that with the smallest doc_id; of rows with its id and text the one
    whose other columns, as JSON, have the least hash."""
    kept = order_minhash.near_duplicates(docs).where("kept").select(F.struct("doc_id", "fp").alias("kept")).distinct()
    rows = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("fp")).alias("own"), F.struct(*docs.columns).alias("row"), F.md5(F.to_json(F.struct(*[c for c in docs.columns if c.lower() != "text"]))).alias("place"))
    once = rows.join(kept, F.col("own").eqNullSafe(F.col("kept"))).groupBy("own").agg(F.min_by("row", "place").alias("row"))
    return once.select("row.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are blotted out; every document stays."""
    clean = secrets.redact(secrets.find_secrets(docs, secrets.Ledger.named(spark)))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources' documents as often as their target weights ask, in shards, each in a random order."""
    mixed = mixing.materialise(mixing.mix(docs))
    shuffled = mixed.repartition("mix_shard").sortWithinPartitions("mix_shard", "mix_order")
    return shuffled.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its best segmentation's ids, the scores of the best ones, and whether the ids decode to the text."""
    coded = sentencepiece_nbest.encode(docs, PIECES, decoded="decoded")
    same = F.col("decoded").eqNullSafe(F.coalesce(F.col("text"), F.lit("")))
    return coded.select(
        *docs.columns, F.expr("segmentations[0].ids").alias("ids"), F.expr("length(segmentations[0].ids) div 2").alias("n_tokens"),
        F.transform("segmentations", lambda s: s["score"]).alias("scores"), same.alias("round_trip"),
    )


STAGES = [("quality classifier", quality), ("near-dedup", near_dedup), ("secret scan", secret_scan), ("mixing", mix_sources), ("piece encoding", encode_pieces)]

#: Compression, sketches and lattices are beyond SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's result written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.cut(docs)
    return docs
