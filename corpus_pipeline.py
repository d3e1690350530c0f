"""A corpus pipeline over ``documents``: five stages, each written as Parquet and read again.

language ID -> quality rules -> near-dedup -> mixing -> SentencePiece.  The
near-dedup stage takes the SimHash operator's links of fingerprints and, for
copies whose fingerprints lie further apart, MinHash bands, and decides all
by exact similarity (``docsight.llm.near_copies``).
Every stage but the last returns the columns of its input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsight.llm import langid, mixing, near_copies, quality, sentencepiece_scan
from docsight.llm.common import checkpoint_dir
from docsight.llm.queries import tokenizer_path

#: A row's number, fixed by its place in the stage's input files: stages take tables that were written and read again.
ROW = "__docsight_row"
COPIES = "__docsight_copies"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is known with probability 0.5 or more; null and empty texts and texts without letters go.

    Very long texts are read whole, repeated rows are judged alike, an empty
    table gives an empty result; further columns pass through, whatever their names.
    """
    return langid.known_language(docs, least=0.5)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass all quality rules; empty and null texts go.

    Very long texts are read whole, repeated rows are judged alike, an empty
    table gives an empty result; further columns pass through, whatever their names.
    """
    return quality.rejected_by(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicate texts: that of the smallest doc_id, then the first of equals.

    Texts are proposed by the SimHash operator's links of five-word
    fingerprints and by MinHash bands; they link at an exact Jaccard similarity of 0.8 or more of their sets of
    five-word shingles; a text of fewer words is one shingle, and texts without
    words, null ones too, are copies of one another.  Null doc_ids come last.  Very long texts are shingled whole,
    an empty table gives an empty result, and further columns pass through,
    whatever their names but those that begin with ``__docsight``.  Rows are
    numbered by their place, so ``docs`` is to be a table that was written.
    """
    numbered = docs.withColumn(ROW, F.monotonically_increasing_id())
    return numbered.join(near_copies.firsts(numbered, "doc_id", ROW), ROW, "left_semi").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mixture takes it; each source's words come near its target.

    Null and empty texts have no words: they are taken as often as their
    source's threshold says and add nothing.  A very long text weighs as its
    words.  Further columns pass through, whatever their names but those that
    begin with ``__docsight``; an empty table gives an empty result.  Rows of
    equal doc_id and text move as one.
    """
    numbered = docs.withColumn(ROW, F.monotonically_increasing_id())
    sized = numbered.select(F.col(ROW), "source", "doc_id", F.xxhash64("text").alias("text_hash"), mixing.word_count("text").alias("size"))
    mixed = mixing.mix(sized, "size", "source", [ROW], hash_columns=["doc_id", "text_hash"])
    copies = mixed.filter("copies > 0").select(ROW, F.col("copies").alias(COPIES))
    repeated = numbered.join(copies, ROW)
    return repeated.withColumn(COPIES, F.explode(F.sequence(F.lit(1).cast("long"), F.col(COPIES)))).select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, n_tokens, round_trip of every row.

    Null texts have null ids, empty ones none; very long texts go through the
    scan; repeated rows each get a row, an empty table gives an empty result,
    and further columns are dropped.
    """
    return sentencepiece_scan.encode(docs, tokenizer_path(), ["doc_id", "source"])


STAGES = [
    ("language", identify_language),
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("mixture", mix_sources),
    ("tokens", tokenize),
]

#: Models, hashes and tokens have no SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; intermediate tables go to the shared checkpoint folder."""
    base = f"{checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        at = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
