"""A corpus pipeline of the operators in ``docquarry.llm``.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns the columns of
documents, but for the last, which returns packed pieces. Quality and language models are learnt anew from bounded
samples: labelled rows for the one, documents with a language outside the held-out part for the other.

* quality: rows whose posterior is under one half go;
* language: rows without a letter, or not clearly in one of the learnt languages, go;
* near_copies: of each component of texts that share 80 % of their five-word shingles the row of the least id stays;
* personal_data: valid numbers, dates, addresses and secrets give way to pseudonyms of their format (n_chars follows);
* packing: token ids in sequences of 1024, a row for each piece.

Null texts are rejected by the first stage; an empty table passes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import language, ngram_join, packing, pii, quality
from docquarry.llm.queries import PII_KEY, tokenizer_file


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality.keep_good(docs, quality.learn_evidence(docs, labels))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs, language.learn_from(docs))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one_of_each(docs, n=5, p=80, q=100)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    replaced = pii.pseudonymize(docs, PII_KEY)
    return replaced.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else replaced


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.cut_documents(docs, tokenizer_file("byte_bpe_50k.json"), end_id=0)
    return packing.place_pieces(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


STAGES = [
    ("quality", keep_good_quality),
    ("language", keep_known_languages),
    ("near_copies", keep_one_of_near_copies),
    ("personal_data", replace_personal_data),
    ("packing", pack_sequences),
]

#: The classifiers, the signatures and the tokenizer are beyond SQL; the tests hold each stage against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again as the next one's input."""
    from docquarry.llm.common import written

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
