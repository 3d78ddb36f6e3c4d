"""From raw documents to token ids, in five stages.

Each stage takes the documents that its predecessor kept and returns a DataFrame; all
but the last return the columns of ``documents``.  ``run`` writes every stage's result
to the shared folder and reads it again for the next; what the next has read goes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dawnchorus.llm.common import drop_table, materialize, read_table
from dawnchorus.llm.importance_resampling import quality_filter
from dawnchorus.llm.ordinal_toxicity import toxicity_filter
from dawnchorus.llm.partition_jaccard import keep_one_of_each
from dawnchorus.llm.poisson_mixing import mix_sources
from dawnchorus.llm.queries import bpe_vocabulary, good_labels, toxic_labels
from dawnchorus.llm.recursive_bpe import encode_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling (5): documents that are not drawn go."""
    return quality_filter(docs, good_labels(spark, sf_dir))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ordinal regression (4): toxic documents go."""
    return toxicity_filter(docs, toxic_labels(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (8): of each group the document with the smallest id stays."""
    return keep_one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Poisson replication (7): sources weigh as the square root of their number of documents."""
    return mix_sources(docs, alpha=0.5).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE (6): doc_id, n_tokens, ids, and whether the ids decode to the text."""
    encoded = encode_documents(docs, *bpe_vocabulary())
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("near duplicates", near_duplicates),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: The models' stages cannot be said in SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        drop_table(before)
    return docs
