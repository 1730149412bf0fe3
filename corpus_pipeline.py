"""The corpus pipeline: five stages over ``documents``, each on all that its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes each
stage's result as Parquet to the shared folder and reads it again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge.llm import bpe, exact_dedup, language_id, mixing, near_dedup
from tablegauge.llm.common import store
from tablegauge.llm.queries import TOKENIZER, held_out, load

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected: no null texts, texts without letters or texts like no learned language."""
    model = language_id.train(docs, "text", "lang", "doc_id", ~held_out())
    return language_id.identify(docs, model).filter("NOT rejected").select("row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id."""
    return exact_dedup.exact_dedup(docs).filter("kept").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked texts the one with the smallest doc_id."""
    return near_dedup.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.emitted(mixing.mix(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mixed documents, with the digests of the ids and of the text decoded from them."""
    out = bpe.bpe_round_trip(docs, TOKENIZER, carry=["doc_id", "lang", "source"])
    return out.select("row.*", "ids", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

# The trained model of the first stage has no form in SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    # Arrays have no common form outside of Spark, so the ids are given as text here; STAGES keep them as they are.
    return docs.withColumn("ids", F.concat_ws(" ", F.transform("ids", lambda i: i.cast("string"))))
