"""From documents to training ids: five stages, each of which applies one operator to all that the one before has kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns the columns of ``documents``; the last
one returns ids. ``run`` writes each stage's result to the shared folder and reads it for the next, so a lost
executor costs one stage's tasks at most. Rows count as such: ids may repeat or be null, and further columns of any name pass through
all stages but the last. A null text is an empty one: it fails or passes the classifier as such, and is no token.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.llm.bpe import bpe_encode
from symgraph.llm.common import stash
from symgraph.llm.mixing import mixed
from symgraph.llm.near_copies import drop_near_copies
from symgraph.llm.pii import redacted
from symgraph.llm.quality_classifier import quality_filter
from symgraph.llm.queries import tokenizer_file
from symgraph.shipping import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier accepts, each by its own text: repeated and null ids make no difference. An empty table stays empty."""
    labels = ship(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return quality_filter(docs, labels)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five-word shingles, Jaccard similarity 0.8), that of the smallest id.

    Of rows equal in id and text one stays, of rows equal in id alone each counts; a null id comes after all others. An empty table stays empty.
    """
    ship(spark)
    return drop_near_copies(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data replaced by its kind; ``n_chars`` follows the text.

    Each row is judged and changed by its own text, so repeated rows, repeated ids and null ids make no difference; an empty table stays empty.
    """
    return redacted(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; rows that are equal in id and text are taken alike, and an empty table gives none."""
    return mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, ids array<int>, n_tokens)``, a row per row."""
    ship(spark)
    encoded = bpe_encode(docs, tokenizer_file("byte_bpe_multi_50k.tiktoken"))
    return encoded.select("doc_id", "ids").withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_duplicates),
    ("pii", personal_data),
    ("mixing sources", mixture),
    ("byte-level bpe", encode),
]

#: The first stage's model is trained in numpy, so SQL cannot express the result; tests compare it with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
