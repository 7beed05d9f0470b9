"""Training-data pipeline: quality filter, near-duplicate removal, source mixing, packing.

Every stage is a function (spark, docs, sf_dir) -> DataFrame that works on all
documents its predecessor kept. Stages hand on the columns of ``documents``; the
last one returns the packed pieces. ``run`` writes each stage's result as a
table in the shared scratch folder and reads it back for the next stage.

* quality: fits the classifier on the labelled documents among ``docs`` (bounded by
  its TRAIN_ROWS) and drops documents whose score is below 0.5. Documents
  without text score by the bias alone.
* near_duplicates: links SimHash fingerprints of 3-word shingles at 3 or fewer differing bits and
  keeps the document with the smallest doc_id of each component, once.
* mixing: gives every source its token target along the curriculum; documents
  appear as often as their source's target asks for (0 to 3 times), in training order.
* packing: tokenises and packs every remaining row into sequences of 2048 tokens.

Null texts, sources and ids, repeated rows, empty tables and further columns are
handled as each operator defines it; further columns are carried to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftlab.llm import mixing, packing, quality, simhash
from liftlab.llm.common import fresh, stored, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    weights = quality.fit(quality.labelled_rows(docs, table(spark, sf_dir, "labels")))
    (score,) = fresh(docs.columns, "_quality")
    return quality.with_score(docs, weights, score).where(F.col(score) >= 0.5).drop(score)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.training_order(mixing.mix(docs, mixing.n_words(F.col("text"))))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [("quality", quality_filter), ("near_duplicates", remove_near_duplicates),
          ("mixing", mix_sources), ("packing", pack_sequences)]

#: A classifier, connected components and a tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
