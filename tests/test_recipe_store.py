"""The store of recipes: children are replaced with their recipe, commits, untouched buckets, validation."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from saltern.sources import recipe_store
from saltern.sources.commits import Conflict
from saltern.sources.recipe_store import RecipeStore

RECIPE, LINE, FOUND = "id long, name string, confidence double", "formulation_id long, raw_name string, amount double", "formulation_id long, rule_id string"


@pytest.fixture
def store(spark, tmp_path):
    it = RecipeStore(spark, str(tmp_path / "store"), RECIPE, {"lines": LINE, "findings": FOUND}, buckets=8)
    recipes = spark.range(60).select("id", F.concat(F.lit("r"), "id").alias("name"), F.lit(0.5).alias("confidence"), F.lit("x").alias("saltern_bucket"))
    lines = spark.range(120).select((F.col("id") % 62).alias("formulation_id"), F.concat(F.lit("n"), "id").alias("raw_name"), F.col("id").cast("double").alias("amount"))
    it.upsert(recipes, lines=lines)
    return it


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_children_are_replaced(spark, store):
    assert store.count() == store.read().count() == 60 and store.read("lines").filter("formulation_id >= 60").isEmpty()
    lines = {r for r in rows(store.read("lines"))}
    files = {str(p) for p in Path(store.path).rglob("*.parquet")}
    held = store._state()[1]["held"]
    new = spark.createDataFrame([(3, "b", 0.9), (3, "a", 0.9), (7, "c", 0.1), (90, "d", None), (None, "lost", 1.0)], RECIPE)
    store.upsert(new, lines=spark.createDataFrame([(3, "only", 1.0), (3, "only", 1.0), (90, "x", None), (4, "of another", 2.0), (None, "y", 1.0)], LINE))
    assert rows(store.read().filter("id IN (3, 7, 90)")) == [(3, "a", 0.9), (7, "c", 0.1), (90, "d", None)]
    want = {r for r in lines if r[0] not in (3, 7)} | {(3, "only", 1.0), (90, "x", None)}
    got = rows(store.read("lines"))
    assert set(got) == want and len(got) == len(want) + 1  # a line that is given twice stays twice
    assert files <= {str(p) for p in Path(store.path).rglob("*.parquet")}
    after = store._state()[1]["held"]
    assert sum(held[b]["segment"] == after[b]["segment"] for b in held) >= len(held) - 3
    got = store.get(spark.createDataFrame([(90,), (3,), (3,), (1000,), (None,)], "id long"))
    assert rows(got["recipes"]) == [(3, "a", 0.9), (90, "d", None)] and got["lines"].count() == 3
    again = RecipeStore(spark, store.path, RECIPE, {"lines": LINE, "findings": FOUND}, buckets=3)
    assert again.buckets == 8 and again.count() == 61


def test_a_failure_shows_neither_table(spark, store, monkeypatch):
    before = {name: rows(df) for name, df in store.snapshot().items()}
    new = spark.createDataFrame([(3, "new", 1.0)], RECIPE)
    bad = spark.createDataFrame([(3, "n", 1.0)], LINE).withColumn("amount", F.raise_error(F.lit("lost between the two writes")).cast("double"))
    with pytest.raises(Exception, match="lost between"):
        store.upsert(new, lines=bad)
    assert {name: rows(df) for name, df in store.snapshot().items()} == before
    real, seen = recipe_store.commit, store._state()
    monkeypatch.setattr(recipe_store, "commit", lambda s, p, n, c: (real(s, p, n, seen[1]), real(s, p, n, c)))  # another writer is first
    with pytest.raises(Conflict):
        store.upsert(new)
    assert {name: rows(df) for name, df in store.snapshot().items()} == before


def test_patch_validates_what_it_touches(spark, store):
    seen = []

    def validate(recipes, children):
        seen.append((rows(recipes), {r["formulation_id"] for r in children["lines"].collect()}))
        return recipes.filter("confidence < 0.3").select(F.col("id").alias("formulation_id"), F.lit("low").alias("rule_id"))

    changes = spark.createDataFrame([(5, None, 0.1), (6, "six", None), (5000, "nobody", 1.0), (None, "null", 1.0)], RECIPE)
    store.patch(changes, validate, "findings")
    assert seen == [([(5, "r5", 0.1), (6, "six", 0.5)], {5, 6})]
    assert rows(store.read("findings")) == [(5, "low")] and store.count() == 60
    store.patch(spark.createDataFrame([(5, 0.8)], "id long, confidence double"), validate, "findings")
    assert rows(store.read("findings")) == [] and rows(store.read().filter("id IN (5, 6)")) == [(5, "r5", 0.8), (6, "six", 0.5)]
    number = store._state()[0]
    store.patch(changes.filter("id > 1000"))
    store.upsert(changes.limit(0))
    assert store._state()[0] == number


def test_delete_cascades(spark, store):
    store.delete(spark.createDataFrame([(1,), (2,), (2,), (999,), (None,)], "id long"))
    assert store.count() == 58 and store.read("lines").filter("formulation_id IN (1, 2)").isEmpty()
    store.delete(store.read())
    assert store.count() == 0 and store.read("lines").isEmpty()
    store.upsert(spark.createDataFrame([(1, "back", 1.0)], RECIPE))
    assert rows(store.read()) == [(1, "back", 1.0)]
    store.clear()
    assert store.count() == 0 and store.read().isEmpty()
    with pytest.raises(ValueError, match="no such child"):
        store.upsert(store.read(), procedures=store.read())
