"""Corpus pipeline over ``documents``: each stage's result is written and read again.

Language ID drops documents without text or letters, whatever languages are called and also where no
row can be learned from; exact dedup keeps, of equal texts, the one with the most code points; the n-gram join keeps one document of each
group of near-duplicates (five words, Jaccard 0.8); mixing takes documents to the target weights
of the tree of domains, languages and sources, a document once for each epoch; SentencePiece gives
the chosen documents' token ids. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltern.llm import exact_dedup, language_id, ngram_join, sentencepiece_codec, source_mixing
from saltern.llm.common import DOCUMENT_COLUMNS, table, written
from saltern.llm.queries import MIX_EPOCHS, MIX_FRACTION, MIX_SEED, MIX_WEIGHTS, piece_model


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = language_id.predict(docs.select(*DOCUMENT_COLUMNS), language_id.fit(docs), determined="determined")
    return out.filter("determined").select(*DOCUMENT_COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs.select(*DOCUMENT_COLUMNS))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.deduplicate(docs.select(*DOCUMENT_COLUMNS), n=5, num=80, den=100)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = source_mixing.mix(docs.select(*DOCUMENT_COLUMNS), weights=MIX_WEIGHTS, fraction=MIX_FRACTION, max_epochs=MIX_EPOCHS, seed=MIX_SEED)
    return out.select(*DOCUMENT_COLUMNS)


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids, their number, and the SHA-256 of what they decode to."""
    out = sentencepiece_codec.encode_decode(docs.select("doc_id", "lang", "source", "text"), piece_model())
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("language_id", language_stage), ("exact_dedup", exact_stage), ("ngram_join", near_stage), ("source_mixing", mixing_stage), ("sentencepiece", piece_stage)]

#: Language ID and SentencePiece have no SQL form; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
