"""From raw documents to token ids: quality, near duplicates, personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs.

Null and empty texts are scored as empty, never are near duplicates, hold no
personal data, have size 0 in the mix (they come as often as their whole source
does) and no ids. Rows with a null id stay. Of rows that repeat an id, each is a
document of its own until the near duplicates, where equal texts become one. Empty
tables give empty results; columns beyond those of documents are dropped first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.llm import bbpe, jaccard_join, mixing, pii, quality
from mapweave.llm.common import materialise, table
from mapweave.llm.queries import KEY, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents that the quality classifier scores below this go.
LEAST_SCORE = 0.3
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier, fitted on labelled ones, rejects."""
    docs = docs.select(*COLUMNS)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, "__score").where(F.col("__score") >= LEAST_SCORE).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id."""
    return jaccard_join.keep_one(docs.select(*COLUMNS)).select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates; n_chars is that of the new text."""
    out = pii.pseudonymise(docs.select(*COLUMNS), KEY, count_col="__entities")
    return out.withColumn("n_chars", F.when(F.col("__entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once, or twice. Of rows that share an id and a size, some may be."""
    return mixing.repeat(docs.select(*COLUMNS)).select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids) of every whole text."""
    import public_tokenizers

    out = bbpe.encode_column(docs.select("doc_id", "lang", "source", "text"), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("pii", pii_stage), ("mixing", mixing_stage), ("encoding", encoding_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from documents; each is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
