"""Evaluation: precision and recall of a mark, ranking quality, top-k expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saltern.functions.text import bounded


def confusion(rows: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """One row: true and false positives and negatives, precision, recall and F1 (0 where undefined)."""
    out = rows.agg(F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & actual).alias("fn"), F.count_if(~predicted & ~actual).alias("tn"))
    share = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))).otherwise(F.lit(0.0))
    out = out.withColumn("precision", share("tp", "fp")).withColumn("recall", share("tp", "fn"))
    p, r = F.col("precision"), F.col("recall")
    out = out.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)))
    return out.withColumns({c: bounded(F.col(c), 6) for c in ("precision", "recall", "f1")})


def ndcg(hits: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg): of hits with ``pos`` from 0 and a boolean ``relevant``."""
    top = hits.filter(F.col("pos") < k)
    gain = F.when(F.col("relevant"), F.lit(1.0) / F.log2(F.col("pos") + F.lit(2.0))).otherwise(F.lit(0.0))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("relevant").desc(), "pos"))
    ideal = F.when(F.col("relevant"), F.lit(1.0) / F.log2(rank + F.lit(1.0))).otherwise(F.lit(0.0))
    both = top.withColumn("ideal", ideal).groupBy("query_id").agg(F.sum(gain).alias("dcg"), F.sum("ideal").alias("idcg"))
    return both.select("query_id", bounded(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(F.lit(0.0)), 6).alias("ndcg"))


def expectations(hits: DataFrame, spec: DataFrame) -> DataFrame:
    """(query_id, passed): hits (query_id, pos, score, is_formula, tags, text) against a spec
    (query_id, top_k, min_formula, any_types, all_types, min_top_score, must_match, must_not_contain)."""
    own = hits.join(spec, "query_id").filter(F.col("pos") < F.col("top_k"))
    out = own.groupBy("query_id").agg(
        F.count_if("is_formula").alias("formulas"),
        F.max(F.col("score")).alias("top"),
        F.max(F.arrays_overlap("tags", "any_types")).alias("any_ok"),
        F.max(F.size(F.array_except("all_types", "tags")) == 0).alias("all_ok"),
        F.max(F.expr("must_match IS NULL OR text RLIKE must_match")).alias("match_ok"),
        F.max(F.expr("must_not_contain IS NOT NULL AND contains(lower(text), lower(must_not_contain))")).alias("bad"),
        *[F.first(c).alias(c) for c in ("min_formula", "min_top_score", "any_types", "all_types")],
    )
    passed = (F.col("formulas") >= F.coalesce("min_formula", F.lit(0))) & (F.col("top") >= F.coalesce("min_top_score", F.lit(0.0)))
    passed = passed & (F.col("any_ok") | (F.size(F.coalesce("any_types", F.array())) == 0)) & (F.col("all_ok") | (F.size(F.coalesce("all_types", F.array())) == 0))
    return out.select("query_id", (passed & F.col("match_ok") & ~F.col("bad")).alias("passed"))
