import random
import re

from pyspark.sql import functions as F

from saltern.operators import names as N
from saltern.sources import recipes as R
from saltern.sources import tables


def test_titles(spark):
    rows = spark.createDataFrame([("Anti-Acne Cream", "Moisturisins Anti-Acne Cream", True), ("Hand Cream", "Baby Shampoo", False), ("Moisturizing Facial Lotion", "moisturizina facial lotion no 4", True), ("", "x", False), (None, "x", False)], "a string, b string, want boolean")
    assert all(r["got"] == r["want"] for r in rows.withColumn("got", N.same_title(F.col("a"), F.col("b"))).collect())


RECIPES = "id string, name string, source_text string, product_types array<string>, score double, ingredients array<struct<raw_name:string,normalized_name:string>>"


def test_signals_and_types(spark):
    rows = spark.createDataFrame([("1", "Sun Lotion", "SPF 24 lotion", ["lotion"], 1.0, [("Sodium Lauryl Sulfate", "sodium lauryl sulfate")]), ("2", "Baby Shampoo", "text", ["shampoo"], 2.0, [("Water", "water")])], RECIPES)
    ids = lambda c: {r["id"] for r in rows.filter(c).collect()}
    assert ids(N.matches_signals(["lauryl sulfate"], [])) == {"1"} and ids(N.matches_signals(["SPF 15"], [])) == set() and ids(N.matches_signals(["spf 24"], [])) == {"1"}
    assert ids(N.matches_signals([], ["Baby Shampoo"])) == {"2"}
    assert ids(N.has_types(["baby", "shampoo"], F.col("product_types"), F.col("name"), F.col("source_text"))) == {"2"}
    assert {(r["target"], r["id"]) for r in N.best_for_targets(rows, ["Baby Shampoo", "Sun Lotion"]).collect()} == {("Baby Shampoo", "2"), ("Sun Lotion", "1")}


def test_reports(spark):
    assert tuple(N.ocr_summary(spark.createDataFrame([("a", 3), ("b", 0), ("c", None)], "doc_id string, ocr_pages_count int")).first()) == (1, 3)
    assert tuple(N.resolve_totals(spark.createDataFrame([("water", 0.9), ("wax", 0.5), (None, None)], "canonical_name string, confidence double")).first()) == (1, 2)
    out = N.price_sample(spark.createDataFrame([(1.0, 0.1), (2.0, 0.2), (None, 0.0)], "cost_per_kg double, covered_percent double")).first()
    assert (out["priced"], out["median_coverage"], out["sampled"]) == (2, 0.2, 3)
    assert N.price_sample(spark.createDataFrame([], "cost_per_kg double, covered_percent double")).first()["share_priced"] == 0.0


def test_readings_never_get_worse():
    text = "Ingredients: (wt%)\nSodium laureth sulfate 12.0 %\nBetaine 8.5 %\nGlycerin 3 %\nPanthenol 0.5 %"
    rows = R.parse_block(text)[0]
    assert R.reparsed(rows, "table", text) is None
    assert R.reparsed([R.Row("Betaine", None)], "list", text)[1] == "table"
    full = [R.Row(f"Name {k}", 20.0, "%") for k in range(5)]
    assert R.reparsed(full, "llm", text) is None and R.reparsed(full, "table", text) is None


def test_sources_resolve_without_broadcasts(spark):
    rng = random.Random(7)
    stem = lambda: "_".join(rng.choice(["oil", "wax", "Red", "a1"]) for _ in range(rng.randrange(1, 4)))
    known = sorted({stem().lower() + rng.choice(["", "_1", "_12"]) for _ in range(25)})
    asked = sorted({rng.choice(["", " "]) + stem() + rng.choice(["", " 1", "_12_x", "_", "!"]) for _ in range(60)} | {"", " ", "!!", "nowhere"})
    frames = spark.createDataFrame([(a,) for a in asked] * 2, "asked string"), spark.createDataFrame([(k,) for k in known], "doc_id string")
    want = set()
    for a in asked:
        key = a.strip(" ")
        slug = re.sub("[^a-z0-9]+", "_", key.lower()).strip("_")
        exact = [x for x in (key, key.lower(), slug) if x in known]
        near = [k for k in known if slug and (k.startswith(slug) or slug.startswith(k))]
        if key and (exact or near):
            want.add((a, (exact or near)[0]))
    out = tables.resolve_sources(*frames)
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert tables.resolve_sources(frames[0], frames[1].limit(0)).count() == 0 and tables.resolve_sources(frames[0].limit(0), frames[1]).count() == 0
