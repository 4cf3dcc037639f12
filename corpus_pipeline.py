"""From raw documents to token counts: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's ``docs``.  All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tesserix.llm.bpe import tokenize
from tesserix.llm.decontaminate import drop_leaks
from tesserix.llm.jaccard import drop_near_duplicates
from tesserix.llm.pii import sanitise
from tesserix.llm.queries import tokenizer_path
from tesserix.llm.toxicity import drop_toxic
from tesserix.plans.session import delete, shared_folder


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the model learns from the labels that aren't held out.
    Null and empty texts stay, repeated rows share a fate, and no documents stay none."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.7)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component under five-word shingle Jaccard of 0.75 stays, that of the
    least id; of rows that repeat it one.  Null and empty texts stay; rows without an id are one
    node a text and come after all others; no documents stay none."""
    return drop_near_duplicates(docs, size=5, percent=75)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go.  Null and empty texts stay, repeated rows share
    a fate, and without documents or a benchmark nothing goes."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is generalised and terms that disclose it are removed.  All rows stay: null
    and empty texts as they are, repeated rows alike."""
    return sanitise(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's BPE ids, with digests of the ids and of the decoded text; null and empty
    texts have none, and repeated rows the same."""
    return tokenize(docs, tokenizer_path()).drop("decoded")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: SQL can't express a trained classifier; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of ``sf_dir``; returns what the last one made.  A stage's
    files are deleted once the next one has read them."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
