"""From raw documents to packed training windows, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last
keep the columns of ``documents``. ``run`` writes each stage's result as Parquet in the
shared folder and reads it again as the next one's input, so a lost executor costs a
part of one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import jaccard, langid, linededup, mixing, packing, queries, shared


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with calibrated confidence."""
    model = langid.fit(docs, shared.fold("doc_id", 5) != 0)
    return langid.accepted(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the boilerplate lines of their source."""
    return linededup.without_boilerplate(docs, ratio=0.05)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: five-word shingles, similarity 0.8."""
    return jaccard.keep_one(docs, words=5, least=(4, 5))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens, as near to the target weights as one epoch allows."""
    mixed = mixing.mix(docs, mixing.levels_of_documents(), mixing.WEIGHTS, share=(9, 10), max_epochs=1, seed=1)
    return mixed.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 tokens."""
    pieces = packing.pack(docs, queries.tokenizer("byte_bpe_50k.json"), end_id=1, capacity=2048, cache_chunks=100_000)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_windows", pack_windows),
]

#: SQL can't express the trained model of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
