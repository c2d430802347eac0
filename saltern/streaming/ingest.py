"""Incremental ingest as a stream of page files: parse, chunk and drop what was seen before.

Each run takes up the files that are new since the checkpoint and stops; running it again without
new files does nothing. Chunks with one (doc_id, text_hash) are taken up once across all runs: the
stream's own deduplication state says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltern.functions import text as T
from saltern.sources.shared import disk_state

PAGES = "doc_id string, pdf_page int, text string"


def chunks(pages: DataFrame) -> DataFrame:
    """Pages as chunks with hash, tags, formula flag and type."""
    clean = T.page_text(F.col("text"))
    out = pages.withColumn("text", clean).filter(F.col("text") != "")
    out = out.withColumns({"text_hash": T.text_hash(F.col("text")), "product_types": T.product_tags(F.col("text")), "is_formula": T.is_formula(F.col("text"))})
    return out.withColumn("chunk_type", T.chunk_type(F.col("text"), F.col("is_formula")))


def run(spark: SparkSession, source: str, target: str, checkpoint: str, max_files: int = 1000) -> None:
    """Take up new JSON page files of ``source`` into the Parquet folder ``target``, and stop."""
    pages = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", max_files).json(source)
    fresh = chunks(pages).dropDuplicates(["doc_id", "text_hash"])
    with disk_state(spark):  # what was seen is kept for ever
        query = fresh.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
