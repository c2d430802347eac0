"""Containment joins against all pairs, and their plans."""

import random
import re

from pyspark.sql import functions as F

from saltern.operators import analytics, containment
from saltern.plans import queries, report_queries


def test_containing_is_all_pairs(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    texts = [word(rng.randrange(30)) for _ in range(150)] + [None, "", "ab", "ab"]
    terms = [word(rng.randrange(1, 9)) for _ in range(150)] + [None, "", "ab", "zz", "aé😀"]
    got = containment.containing(spark.createDataFrame([(t,) for t in texts], "t string"), spark.createDataFrame([(t,) for t in terms], "`a.b` string")).collect()
    want = {(x, t) for x in texts for t in terms if x and t and t in x}
    assert len(got) == len(want) and {(r["text"], r["term"]) for r in got} == want
    both = containment.either_way(spark.createDataFrame([(t,) for t in texts], "t string"), spark.createDataFrame([(t,) for t in terms], "t string")).collect()
    assert {(r["name"], r["term"]) for r in both} == {(x, t) for x in texts for t in terms if x and t and (t in x or x in t)} and len(both) == len({tuple(r) for r in both})
    assert containment.containing(spark.createDataFrame([], "t string"), spark.createDataFrame([("a",)], "t string")).count() == 0


def test_many_rules(spark):
    """200,000 prices and regulatory rules: no nested loop, and the results of a few names by hand."""
    lines = spark.createDataFrame([("f", k, n, n.lower(), 1.0, "%") for k, n in enumerate(["Ingredient 77", "Pure ingredient 123456 USP", "Wax"])], "formulation_id string, line_no int, raw_name string, normalized_name string, amount double, unit string")
    many = spark.range(200_000)
    prices = many.select(F.concat(F.lit("ingredient "), F.col("id").cast("string")).alias("ingredient"), F.col("id").cast("double").alias("price"), F.col("id").alias("pos"))
    out = analytics.line_prices(lines, prices)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    first = min(k for k in range(200_000) if f"ingredient {k}" in "ingredient 123456" or "ingredient 123456" in f"ingredient {k}")
    assert {r["raw_name"]: r["price"] for r in out.collect()} == {"Ingredient 77": 77.0, "Pure ingredient 123456 USP": float(first), "Wax": None}
    rules = many.select(F.concat(F.lit("ingredient "), F.col("id").cast("string")).alias("ingredient"), F.array(F.lit(None).cast("string")).alias("aliases"), F.lit("EU").alias("market"), F.when(F.col("id") == 123456, "prohibited").otherwise("restricted").alias("status"), F.lit(50.0).alias("max_percent"))
    assert [r["status"] for r in analytics.compliance(lines, rules, ["eu"]).collect()] == ["fail"]


def test_no_nested_loops(spark, sf):
    known = queries.queries() | report_queries.queries()
    for name in known:
        if re.match(r"q(30|32|37|42|98|99)_", name):
            assert "NestedLoop" not in known[name](spark, sf)._jdf.queryExecution().executedPlan().toString(), name
