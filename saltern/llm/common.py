"""What the operators of this subpackage share: shared-folder tables, folds, column hygiene."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saltern.sources.shared import TEXT_BYTES, TEXT_ROWS, delete, drop_written, exists, new_path, shared_dir, small_batches, written

__all__ = ["TEXT_BYTES", "TEXT_ROWS", "delete", "drop_written", "exists", "new_path", "shared_dir", "small_batches", "written"]

#: `[\x20\x09-\x0D]`, the white space of every contract here.
SPACE = " \t\n\x0b\x0c\r"

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", by: str = "node", salts: int = 16) -> DataFrame:
    """Join where one key may hold much of ``left`` and ``right`` has one row a key: each row of
    ``right`` goes to ``salts`` tasks, and ``left`` is dealt among them by ``by``."""
    right = right.withColumn("saltern_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    left = left.withColumn("saltern_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("long"))
    return left.join(right, [key, "saltern_salt"], how).drop("saltern_salt")


def fold_is(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32(doc_id as text) mod modulus == remainder; a null id is in no fold (false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def in_training(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Rows that a model may learn from; rows without an id are left out."""
    return doc_id.isNotNull() & ~fold_is(doc_id, modulus, remainder)
