"""Structured search for a table of questions: pools of candidates, scores, order, hints, comparisons.

``questions``: query_id, text, types, required, titles (arrays of strings). ``formulations``: id, name,
product_types, doc_id, confidence, source_text, names, ingredients (lines with raw_name and
normalized_name), and cost_per_kg and compliance where a brief is given.

A question is scored only against what its pools offer: the surest recipes of all its types (of
each of them alone, if none has all), and those whose names or ingredients contain a title, a
word of it, or a word of an ingredient. Pools are made once for each distinct key, not for each
question: types by an inverted index, names and ingredients through the grams of
`containment`; a key's recipes are ranked by confidence within each task before they are shuffled,
and as many are kept as its pool holds. Only then do questions meet recipes.

Defined results: a question without types takes the surest recipes of all; without anything in its
pools it has no row. Null arrays ask for nothing. Questions that share an id are one search. Ties are broken
by id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saltern.operators import catalog
from saltern.operators.containment import containing
from saltern.operators.names import meets, same_title
from saltern.plans import answers, intent, ranking
from saltern.plans.intent import Brief
from saltern.plans.ranking import Asked

# Recipes that a pool holds, as multiples of the rows asked for; needles of hand creams; words
# that are no needles; titles, words and ingredients that are looked up.
HELD = {"types": 12, "type": 6, "name": 4, "first": 6, "later": 4}
HAND_NEEDLES = ["hand cream", "tube-dispensed", "hand and nail", "hand"]
NO_NEEDLES = ["cream", "lotion", "shampoo", "formula"]
TITLES, TITLE_WORDS, INGREDIENTS = 4, 2, 4

#: Separates the types of a key.
MARK = "\n"


def with_questions(questions: DataFrame, text: str = "text") -> DataFrame:
    """``questions`` with the arrays that the search takes, found in their texts."""
    rows = answers.with_signals(questions, text)
    none = F.array().cast("array<string>")
    return rows.withColumns({"types": F.coalesce(intent.question_types(F.col(text)), none), "titles": F.array_distinct(F.concat("named", "compare"))}).drop("named")


def wanted(questions: DataFrame, limit: int) -> DataFrame:
    """(query_id, kind, key, held): the pools of each question; kind ``type`` is for questions whose types pool is empty."""
    filed = F.when(F.array_contains("types", "anti_dandruff") & F.array_contains("types", "shampoo"), F.array(F.lit("anti_dandruff"))).otherwise(F.array_sort(F.array_distinct("types")))
    pool = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"), F.lit(HELD[kind] * limit).alias("held"))
    words = lambda t: F.regexp_extract_all(t, F.lit("[A-Za-z]{4,}"), F.lit(0))
    needles = F.flatten(F.transform(F.slice("titles", 1, TITLES), lambda t: F.concat(F.array(F.substring(t, 1, 40)), F.slice(F.filter(words(t), lambda w: ~F.lower(w).isin(NO_NEEDLES)), 1, TITLE_WORDS))))
    first = lambda t: F.get(F.split(F.btrim(t), r"\s+"), F.lit(0))
    asked = F.filter(F.slice("required", 1, INGREDIENTS), lambda t: F.char_length(first(t)) >= 3)
    later = lambda t: F.get(F.filter(words(t), lambda w: F.lower(w) != F.lower(first(t))), F.lit(0))
    pools = F.concat(
        F.array(pool("types", F.array_join(filed, MARK))),
        F.transform("types", lambda t: pool("type", t)),
        F.transform(F.when(F.col("text").rlike(ranking.HAND_CREAM), F.array(*map(F.lit, HAND_NEEDLES))).otherwise(F.array().cast("array<string>")), lambda t: pool("name", t)),
        F.transform(needles, lambda t: pool("name", F.lower(t))),
        F.transform(asked, lambda t: pool("first", F.lower(first(t)))),
        F.transform(F.filter(F.transform(asked, later), lambda t: t.isNotNull()), lambda t: pool("later", F.lower(t))),
    )
    return questions.select("query_id", F.explode(pools).alias("p")).select("query_id", "p.*").filter("key <> '' OR kind = 'types'").distinct()


def _surest(rows: DataFrame, most: int) -> DataFrame:
    """Of each key the ``most`` recipes of the greatest confidence, with their ``place``."""
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.col("confidence").desc(), "id"))
    return rows.withColumn("place", place).filter(F.col("place") <= most).select("key", "id", "place")


def pools(wants: DataFrame, formulations: DataFrame, limit: int) -> DataFrame:
    """(query_id, id): the recipes that each question's pools offer."""
    own = formulations.select("id", "confidence", F.lower("name").alias("name"), "product_types", "ingredients")
    most = lambda *kinds: limit * max(HELD[k] for k in kinds)
    typed = wants.filter("kind IN ('types', 'type') AND key <> ''").select("key").distinct().withColumn("all", F.split("key", MARK))
    by_type = own.select("id", "confidence", "product_types", F.explode(F.array_distinct("product_types")).alias("type"))
    by_type = by_type.join(typed.withColumn("type", F.get("all", F.lit(0))), "type").filter(F.size(F.array_except("all", "product_types")) == 0)
    every = own.orderBy(F.col("confidence").desc(), "id").limit(most("types")).select(F.lit("").alias("key"), "id", "confidence")
    every = _surest(every, most("types"))
    named = containing(own.select("name"), wants.filter("kind = 'name'").select("key")).withColumnsRenamed({"text": "name", "term": "key"})
    named = own.select("id", "confidence", "name").join(named, "name")
    lines = own.select("id", "confidence", F.explode(F.flatten(F.transform("ingredients", lambda x: F.array(F.lower(x["raw_name"]), F.lower(x["normalized_name"]))))).alias("line")).distinct()
    held = containing(lines.select("line"), wants.filter("kind IN ('first', 'later')").select("key")).withColumnsRenamed({"text": "line", "term": "key"})
    held = lines.join(held, "line").select("key", "id", "confidence").distinct()
    offers = [(("types", "type"), _surest(by_type, most("types", "type")).unionByName(every)), (("name",), _surest(named, most("name"))), (("first", "later"), _surest(held, most("first", "later")))]
    found = reduce(DataFrame.unionByName, [wants.filter(F.col("kind").isin(*kinds)).join(offer, "key").filter("place <= held").select("query_id", "kind", "id") for kinds, offer in offers])
    each = found.groupBy("query_id", "id").agg(F.min(F.col("kind") == "type").alias("alone"))
    has = found.filter("kind = 'types'").select("query_id").distinct().withColumn("has", F.lit(True))
    return each.join(has, "query_id", "left").filter("NOT alone OR has IS NULL").select("query_id", "id")


def _without(formulations: DataFrame, banned: tuple[str, ...]) -> DataFrame:
    """Recipes without a line that contains one of the terms."""
    names = F.flatten(F.transform("ingredients", lambda x: F.array(F.lower(x["raw_name"]), F.coalesce(F.lower(x["normalized_name"]), F.lit("")))))
    terms = F.array(*map(F.lit, map(str.lower, banned))).cast("array<string>")
    return formulations.filter(~F.coalesce(F.exists(names, lambda n: F.exists(terms, lambda t: n.contains(t))), F.lit(False))) if banned else formulations


def search(questions: DataFrame, formulations: DataFrame, limit: int = 5, brief: Brief | None = None, trusted: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, place from 1 on, id, name, score, breakdown, met): the best recipes of each question."""
    brief = brief or Brief()
    none = F.array().cast("array<string>")
    asked = questions.select("query_id", "text", *[F.coalesce(c, none).alias(c) for c in ("types", "required", "titles")]).dropDuplicates(["query_id"])
    recipes = _without(formulations, brief.banned)
    rows = pools(wanted(asked, limit), recipes, limit).join(recipes.filter(F.size("ingredients") >= 2), "id").join(asked, "query_id")
    own = Asked(F.col("types"), F.col("required"), F.col("titles"), F.coalesce("text", F.lit("")))
    rows = ranking.scored_for(rows, own, brief, trusted)
    rows = catalog.best(rows.withColumn("key_", F.substring(F.lower("name"), 1, 80)), ["query_id", "key_"], [F.col("score").desc(), F.size("ingredients").desc(), F.col("id")])
    rows = ranking.brief_filter(rows, Brief(markets=brief.markets, cost_target=brief.cost_target))
    order = [*ranking.tiers_for(own), F.col("score").desc(), F.col("id")]
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("place") <= limit)
    return rows.select("query_id", "place", "id", "name", "score", "breakdown", meets(own.required, own.titles).alias("met"))


def hints(found: DataFrame) -> DataFrame:
    """(query_id, top, hint) of `search`'s rows; a question without rows has none (it falls back)."""
    best = found.filter("place = 1")
    return best.select("query_id", F.col("score").alias("top"), intent.hint(F.col("score"), F.col("met")).alias("hint"))


def compare(questions: DataFrame, formulations: DataFrame, limit: int = 5, brief: Brief | None = None, trusted: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, pos, target, id, name, score) for questions with two ``targets`` at least: each of the first
    three targets is searched for as a question of its own. Its recipe is the one whose title
    matches, the shortest title first, else the best of those whose text names it, else the first;
    a target whose recipe serves an earlier one gets nothing."""
    none = F.array().cast("array<string>")
    subs = questions.filter(F.size("targets") >= 2).dropDuplicates(["query_id"]).select("query_id", F.posexplode(F.slice("targets", 1, 3)).alias("pos", "text"))
    subs = subs.select(F.struct("query_id", "pos").alias("query_id"), "text", F.coalesce(intent.question_types(F.col("text")), none).alias("types"), none.alias("required"), F.array("text").alias("titles"))
    found = search(subs, formulations, limit, brief, trusted).select("query_id.*", "place", "id", "name", "score", "breakdown")
    found = found.join(subs.select("query_id.*", F.col("text").alias("target")), ["query_id", "pos"])
    same = same_title(F.col("target"), F.col("name"))
    told = F.col("breakdown")["named_formula"] >= 28
    stage = F.when(same, 0).when(told, 1).otherwise(2)
    order = F.struct(stage.alias("stage"), F.when(same, F.char_length("name")).alias("length"), F.when(told & ~same, -F.col("score")).alias("rank"), "place")
    picked = found.groupBy("query_id", "pos", "target").agg(F.min_by(F.struct("id", "name", "score"), order).alias("x")).select("query_id", "pos", "target", "x.*")
    taken = F.row_number().over(Window.partitionBy("query_id", "id").orderBy("pos"))
    return picked.withColumn("taken", taken).filter("taken = 1").drop("taken")
