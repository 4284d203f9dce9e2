"""The corpus pipeline: toxicity, exact dedup, near dedup, decontamination, SentencePiece.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. `run` writes each stage's result to the shared folder and reads it again for the next one, so a
lost executor never costs more than the stage that runs.

Defined results, for every stage: a null text counts as an empty one and is no error; a null doc_id is an id like another; null lang or
source stay null; extra columns stay as they are, whatever they are called; an empty table gives an empty one. Stages say below what
becomes of ties and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import cuckoo_dedup, decontam, minhash, pieces, toxicity
from veilspark.llm.common import shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity reaches the threshold go; one that is just on it goes too. Repeated rows share their fate; of several
    labels of an id the largest counts, null ones don't; without toxic labels nothing goes. Empty texts stay."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (blanks in a row are one) the one with the smallest id stays; null ids come last. Empty texts are equal to each
    other. Rows that repeat the id and the text of the one that stays, stay too."""
    return cuckoo_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group of near copies the one with the smallest id stays, of several texts under it the one with the smallest hash; null ids come
    last. Rows that repeat the one that stays, stay too. Texts without a word are near nothing."""
    return minhash.without_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or a re-parameterised one, go, and so do rows that repeat them. Items without a text, an id or a
    word match nothing; without items nothing goes."""
    return decontam.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and the text that they decode to; an empty text has none. Repeated rows repeat their result. Only doc_id, lang and source
    are kept beside."""
    coded = pieces.encode_decode(docs.select("doc_id", "lang", "source", "text"))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").alias("text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode_pieces),
]

#: Fitted severities and near-duplicate classes have no SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        folder = shared_folder(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
