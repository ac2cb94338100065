"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. What it
drops is gone; all but the last return the columns of documents. A stage's result is written
as Parquet in the folder that the cluster names, and reread as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecmill.llm.bpe_automaton import round_trip_digests
from vecmill.llm.common import new_folder, written
from vecmill.llm.langid import predict, train_model
from vecmill.llm.mixing import take
from vecmill.llm.quality import keep_good
from vecmill.llm.superminhash import near_duplicates

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: The least share of learned words, and from how many words on it is asked for.
KNOWN, FEW_WORDS = 0.2, 5
#: Up to so many ids (8 MB) are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the hierarchical classifier gives less than even odds. Null and empty
    texts are judged by their features like others; without labels all stay."""
    return keep_good(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no letters, or (of ``FEW_WORDS`` words or more) less than
    ``KNOWN`` of the words learned. It learns from the texts and languages of all its documents, so what
    goes is noise and text of a language that has no name here. A null text has no letters."""
    model = train_model(docs, F.lit(True))
    found = predict(docs, model, list(COLUMNS))
    return found.where((F.col("lang_pred") != "und") & ((F.col("n_words") < FEW_WORDS) | (F.col("known") >= KNOWN))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group of near copies; of rows that repeat a
    doc_id, one. Rows without a doc_id stay."""
    groups = near_duplicates(docs)
    gone = written(groups.where("not kept").select("doc_id").distinct(), "gone")
    few = gone.count() <= MOST_BROADCAST
    kept = docs.select(*COLUMNS).join(F.broadcast(gone) if few else gone, "doc_id", "left_anti")
    twice = written(groups.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"), "twice")
    if not twice.limit(1).count():
        return kept
    first = kept.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("row")).select("doc_id", "row.*")
    return kept.join(twice, "doc_id", "left_anti").unionByName(first).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it; what it doesn't take goes. Sizes of zero
    words have no part in a mix."""
    return take(docs.select(*COLUMNS))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids by the automaton and their decoding, as digests: a row for each copy in the mix. A null or
    empty text has no ids."""
    return round_trip_digests(docs, TOKENIZER)


STAGES = [
    ("quality classifier", quality_classifier),
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources to target weights", mixing),
    ("BPE encoding and decoding", bpe),
]

#: The classifier, the seeded mix and the tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES:
        path = new_folder(spark, "stage-" + name.split()[0].lower())
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
