"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
``run`` writes each stage's result to the shared folder and reads it for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import session
from tidemark.llm import language, queries
from tidemark.llm.line_dedup import line_dedup
from tidemark.llm.near_dedup import near_copy_groups
from tidemark.llm.packing import pack_documents
from tidemark.llm.pii import pii_spans

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document that no learned language claims by this score is rejected. Texts unlike the labelled ones have score 0.
LEAST_LANGUAGE_SCORE = 0.2
#: Near copies: a Jaccard similarity of five-word shingles of 0.8 or more. Fingerprints of 512 bits propose the pairs:
#: all within 39 bits are compared, and most others (see ``tidemark.llm.near_dedup``); 128 bits may differ in 40 at most.
SHINGLE, RADIUS, WORDS, VERIFY = 5, 39, 8, 40
LEAST_JACCARD = 0.8


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, unchanged. Texts without any letter, or in no learned language, go."""
    done = language.identify(docs.select(*COLUMNS), language.train(docs))
    return done.filter((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are in ten documents or more."""
    return _with_length(line_dedup(docs.select(*COLUMNS)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies. Rows that share an id are one document."""
    groups = near_copy_groups(docs, shingle=SHINGLE, radius=RADIUS, words=WORDS, verify=VERIFY, least=LEAST_JACCARD)
    dropped = groups.filter("doc_id <> component_id").select("doc_id")
    return docs.select(*COLUMNS).join(dropped, "doc_id", "left_anti").select(*COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each span of personal data replaced by the name of its kind."""
    return _with_length(pii_spans(docs.select(*COLUMNS), masked=True))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row for each piece of a document, with its sequence and its place there."""
    return pack_documents(docs, queries.vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language", identify_language),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("pii", mask_personal_data),
    ("packing", pack),
]
#: Language models, fingerprints and tokenizers are beyond SQL; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = session.shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
