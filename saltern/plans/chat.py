"""A table of questions to how each is answered: by a template, by a model with sources, or not at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltern.plans import intent
from saltern.plans.answers import DIRECT, USED

# Fixed value: the score from which recipes support a model; answers.py has the other two.
HYBRID = 50.0
# What a question about replacing an ingredient says.
REPLACE = ["instead of", "substitute", "alternative"]


def suggested_actions(text: Column) -> Column:
    """array<string> of what to offer next: scaling always, substitution where the question asks for it."""
    asks = F.exists(F.array(*map(F.lit, REPLACE)), lambda x: F.lower(text).contains(x))
    return F.array_compact(F.array(F.lit("scale_to_batch"), F.when(asks, "substitute_ingredient")))


def stuck_topic(asked: Column, before: Column, rewritten: Column) -> Column:
    """Whether a rewriting dragged an earlier product into a question: it has a type of the message
    before, and the question had none, or only others."""
    kept = F.arrays_overlap(rewritten, before)
    other = (F.size(asked) > 0) & (F.size(before) > 0) & ~F.arrays_overlap(asked, before)
    return F.coalesce(kept & ((F.size(asked) == 0) | other), F.lit(False))


def outcomes(questions: DataFrame, recipes: DataFrame, hits: DataFrame) -> DataFrame:
    """``questions`` (query_id, text) with their route, types, ``outcome`` and suggested actions.

    ``recipes``: query_id, score, met (whether the recipe meets what the question names), at most a
    few rows a question; ``hits``: query_id, score, pos. Outcomes: ``empty``; ``chitchat`` for what
    names no product; ``direct`` (a template) where the best recipe answers a lookup or comparison;
    ``hybrid`` and ``model`` with recipes or sources; ``failed`` without either.
    """
    best = recipes.groupBy("query_id").agg(F.max("score").alias("top"), F.max_by("met", "score").alias("met"), F.count("*").alias("n"))
    found = hits.filter("pos = 0").select("query_id", F.col("score").alias("hit"))
    rows = intent.classified(questions).join(best, "query_id", "left").join(found, "query_id", "left")
    n, top, met = F.coalesce("n", F.lit(0)), F.coalesce("top", F.lit(0.0)), F.coalesce("met", F.lit(False))
    sources = F.coalesce(F.col("hit") >= USED, F.lit(False))
    enough = F.when(F.col("route") == "compare", n >= 2).otherwise(n >= 1)
    outcome = (
        F.when(F.btrim(F.coalesce("text", F.lit(""))) == "", "empty")
        .when((F.col("route") == "unknown") & ~F.col("wants_formula") & (F.size("product_types") == 0), "chitchat")
        .when((F.col("route") != "reasoning") & (top >= DIRECT) & met & enough, "direct")
        .when((F.col("route") != "reasoning") & (top >= HYBRID), "hybrid").when(sources | (n > 0), "model").otherwise("failed")
    )
    return rows.select("query_id", "route", "product_types", outcome.alias("outcome"), suggested_actions(F.col("text")).alias("actions"))
