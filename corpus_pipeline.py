"""A training corpus from the table documents: toxic documents go, one of each group of near copies stays, sources are mixed to target weights, and the mix is packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of docs with the columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamspark.llm import op2_toxicity, op3_mixing, op4_jaccard, op5_packing
from loamspark.llm.common import table, written
from loamspark.llm.tokens import default_vocabulary

#: Near copies share word shingles of this length, with this similarity (per cent) or more.
SHINGLE_WORDS, SIMILARITY = 5, 80
#: A column that stages add and drop again.
OWN = "pipeline_own"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that a model of the labelled rows of documents does not call toxic.

    Every row is scored by its own text, so rows with equal ids stay or go each for itself; null and empty texts stay, null ids too. Columns
    are as they were, also one named score. An empty table gives no rows.
    """
    scored = op2_toxicity.score(docs, op2_toxicity.train_on_tables(spark, sf_dir), OWN)
    return scored.where(F.col(OWN) < op2_toxicity.THRESHOLD).select(docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the row with the smallest id (of those, the smallest text hash).

    Rows are told apart by id and text: rows with equal ids and different texts are different documents, and rows with equal id and text are
    copies of which one stays (the first by its other columns). Rows without words or without an id are in no group, and all stay.
    """
    groups = written(op4_jaccard.join_documents(docs, SHINGLE_WORDS, SIMILARITY).where("keeper is not null").select("doc_id", "text_key", "keeper"), "groups")
    own = F.struct("doc_id", "text_key")
    away = groups.where(own != F.col("keeper")).select("doc_id", "text_key").distinct()
    keyed = docs.withColumn(OWN, op4_jaccard.text_key())
    key = ["doc_id", OWN]
    kept = keyed.join(_sized(away.withColumnRenamed("text_key", OWN)), key, "left_anti")
    repeated = written(groups.where(own == F.col("keeper")).groupBy("doc_id", "text_key").count().where("count > 1").select("doc_id", F.col("text_key").alias(OWN)), "repeated")
    if repeated.isEmpty():
        return kept.select(docs.columns)
    once = kept.join(_sized(repeated), key, "left_semi").groupBy(*key).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return kept.join(_sized(repeated), key, "left_anti").select(docs.columns).unionByName(once.select(docs.columns))


def _sized(ids: DataFrame) -> DataFrame:
    """ids to be broadcast if they are few enough, else joined by a shuffle."""
    return F.broadcast(ids) if ids.count() <= op4_jaccard.BROADCAST_IDS else ids


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row of docs as often as the mix takes it, with its columns as they were. A null source is a source; a source without words is not taken; rows with equal ids draw each for itself; an empty table gives no rows."""
    return op3_mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces of all rows of docs in sequences: the end of the pipeline, with op5_packing's columns. Null and empty texts are a piece of one id; repeated rows are packed each; an empty table gives no rows."""
    return op5_packing.packed_documents(docs, default_vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL cannot express the classifier; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
