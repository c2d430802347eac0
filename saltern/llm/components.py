"""Connected components of a link table, by alternating large and small stars.

Every step is a map-side combined minimum and a join, so a node with very many links costs no task
more than its share: minima are pre-aggregated, and adaptive execution splits a skewed join side.
Each round is written to the shared folder; nothing is collected but two numbers a round.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltern.llm.common import drop_written, written
from saltern.llm.packing import runs


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node in ``links``; the component is its smallest node.

    Loops and repeated or reversed links are fine; rows with a null are dropped; no links, no rows.
    """
    ends = links.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna()
    own = written(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    loops = own.filter("a = b").select("a").distinct()
    stars = own.filter("a <> b")
    held, before = own, _print(stars)
    while True:
        both = stars.union(stars.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = written(small.union(low).distinct(), "small-star")
        drop_written(large)
        now = _print(small)
        if held is not own:
            drop_written(held)
        held = stars = small
        if now == before:
            break
        before = now
    roots = stars.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    found = stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
    alone = loops.select(F.col("a").alias("node")).join(found.select("node"), "node", "left_anti").withColumn("component", F.col("node"))
    return found.union(alone)


def _print(stars: DataFrame) -> tuple:
    mark = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(stars.agg(F.count("*"), F.sum(mark)).first())


def least_linked(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n numbered nodes, the smallest one that links reach from it. ``a`` is sorted."""
    label = np.arange(n)
    if not len(a):
        return label
    first_a, _ = runs(a)
    order = np.argsort(b, kind="stable")
    sorted_b, back = b[order], a[order]
    first_b, _ = runs(sorted_b)
    while True:
        before = label.copy()
        label[a[first_a]] = np.minimum(label[a[first_a]], np.minimum.reduceat(label[b], first_a))
        label[sorted_b[first_b]] = np.minimum(label[sorted_b[first_b]], np.minimum.reduceat(label[back], first_b))
        label = np.minimum(label, label[label])
        if (label == before).all():
            return label
