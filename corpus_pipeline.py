"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of documents.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuplewright.llm import langid, mixing, packing, pii, simhash
from tuplewright.llm._common import checkpoint_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose language is less sure than this are rejected.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or without a sure language; lang becomes the language found."""
    rows = docs.select(*COLUMNS)
    model = langid.train(rows.select("doc_id", "text", "lang").where(~langid.held_out(F.col("doc_id"))))
    found = langid.predict(rows, model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest doc_id of each class of near copies, by SimHash over five-word
    shingles at a similarity of 0.8 or more."""
    return simhash.deduplicated(docs.select(*COLUMNS))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in place of each span of personal data; keeps every document."""
    return pii.detect(docs.select(*COLUMNS), mask=True).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents as often as their source's target says: a row for each copy taken."""
    return mixing.mixed(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences, each with its token ids and their checksum."""
    return packing.pack(docs.select(*COLUMNS))


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_copies),
    ("personal_data", mask_personal_data),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language models, fingerprints and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
