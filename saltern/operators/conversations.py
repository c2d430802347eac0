"""Conversations and feedback: latest messages, history, carried context, ratings, quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saltern.functions.text import quote_in, squeeze
from saltern.operators.fingerprints import holding


def latest_message(messages: DataFrame, by: str = "conv_id", at: str = "turn") -> DataFrame:
    """Each conversation's last message: a map-side combined maximum, no sort."""
    rest = [c for c in messages.columns if c not in (by, at)]
    return messages.groupBy(by).agg(F.max(F.struct(at, *rest)).alias("x")).select(by, "x.*")


def history(messages: DataFrame, n: int = 10, by: str = "conv_id", at: str = "turn") -> DataFrame:
    """The last ``n`` messages of each conversation, with ``pos`` from the oldest of them."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.col(at).desc()))
    kept = messages.withColumn("back", rank).filter(F.col("back") <= n)
    return kept.withColumn("pos", F.row_number().over(Window.partitionBy(by).orderBy(at))).drop("back")


def carried(messages: DataFrame, role: str = "user", by: str = "conv_id", at: str = "turn") -> DataFrame:
    """Messages with the latest text of a role before them."""
    frame = Window.partitionBy(by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("last_text", F.last(F.when(F.col("role") == role, F.col("text")), ignorenulls=True).over(frame))


# Words that point back to an earlier message.
FOLLOW_UP = r"(?i)^\s*(and|also|but|make it|what about|how about|instead|without|with|it|that|this|same)\b"


def rewritten(messages: DataFrame) -> DataFrame:
    """User messages with ``query``: a short follow-up is put after the user message before it."""
    own = carried(messages).filter(F.col("role") == "user")
    follow = F.col("last_text").isNotNull() & (F.col("text").rlike(FOLLOW_UP) | (F.size(F.split("text", r"\s+")) <= 4))
    return own.withColumn("query", F.when(follow, F.concat_ws(" - ", "last_text", "text")).otherwise(F.col("text")))


def feedback(ratings: DataFrame, rating: str = "rating") -> DataFrame:
    """Positive, negative, and their sum: other ratings do not count."""
    out = ratings.agg(F.count_if(F.col(rating) > 0).alias("positive"), F.count_if(F.col(rating) < 0).alias("negative"))
    return out.withColumn("count", F.col("positive") + F.col("negative"))


def verified_quotes(quotes: DataFrame, chunks: DataFrame) -> DataFrame:
    """``quotes`` (quote_id, key, quote) with whether the named chunk (key, text) has the quote."""
    return quotes.join(chunks, "key", "left").select("quote_id", "key", F.coalesce(quote_in(F.col("quote"), F.col("text")), F.lit(False)).alias("verified"))


def find_quotes(quotes: DataFrame, chunks: DataFrame, head: int = 40) -> DataFrame:
    """(quote_id, key, verified): chunks (key, text) that hold the first ``head`` characters of a quote.

    Chunks and heads meet through the heads' rarest winnowed fingerprints (`fingerprints.holding`), so
    no frequent word or line brings them together.
    """
    own = quotes.select("quote_id", F.substring(F.lower(squeeze(F.col("quote"))), 1, head).alias("head")).filter("head <> ''")
    texts = chunks.select("key", F.lower(squeeze(F.col("text"))).alias("text"))
    found = holding(texts, own.select("head")).join(own, "head").select("quote_id", "key")
    return found.distinct().withColumn("verified", F.lit(True))
