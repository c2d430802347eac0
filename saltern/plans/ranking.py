"""Structured ranking of recipes for a question and a brief, as one plan."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltern.operators import analytics
from saltern.operators.catalog import best
from saltern.operators.names import has_ingredient, matches_signals, same_title, types_of
from saltern.plans.intent import Brief

COST_SLACK = 1.1


def cost_score(cost: Column, target: float | None) -> Column:
    """Points for a price against a target; unknown prices are neutral."""
    if target is None:
        return F.lit(0.0)
    return F.when(cost.isNull(), 0.0).when(cost <= target, 8.0).when(cost <= target * COST_SLACK, 2.0).otherwise(-15.0)


def preferred_score(names: Column, preferred: tuple[str, ...]) -> Column:
    """Eight points for each preferred ingredient, 24 at most."""
    named = lambda t: F.exists(names, lambda n: n.contains(t))
    hits = [F.when(named(t.lower()), 8.0).otherwise(0.0) for t in preferred]
    return F.least(F.lit(24.0), reduce(lambda a, b: a + b, hits, F.lit(0.0)))


# Modifiers that a question and a recipe may share.
MODIFIERS = [r"(?i)\banti[-\s]?dandruff\b|\bantidandruff\b", r"(?i)\bbaby\b", r"(?i)\bsulfate[-\s]?free\b", r"(?i)\bhand\s+(and\s+)?(nail\s+)?cream\b"]
HAND_CREAM, TUBE, NAMED_HAND_CREAM = r"(?i)\bhand\s+cream\b", r"(?i)\btube[-\s]?dispensed\b", r"(?i)\bhand\s+(and\s+)?(nail\s+)?cream\b"


def _first(default: float, *cases: tuple[Column, float]) -> Column:
    """The points of the first case that holds."""
    return F.coalesce(*[F.when(test, points) for test, points in cases], F.lit(default))


@dataclass(frozen=True)
class Asked:
    """What a question asks for, as columns: arrays of types, ingredients and titles, and its text."""

    types: Column
    required: Column
    titles: Column
    question: Column

    @classmethod
    def given(cls, types: list[str], required: list[str] = (), titles: list[str] = (), question: str = "") -> Asked:
        names = [F.array(*map(F.lit, x)).cast("array<string>") for x in (types, required, titles)]
        return cls(*names, F.lit(question))

    def wants(self, *types: str) -> Column:
        return reduce(and_, [F.array_contains(self.types, t) for t in types])

    def hand_cream(self) -> Column:
        return self.question.rlike(HAND_CREAM)

    def hits(self) -> Column:
        """How many of the ingredients a recipe has."""
        return F.size(F.filter(self.required, lambda t: has_ingredient(t, F.col("ingredients"), F.col("name"), F.coalesce("source_text", F.lit("")))))


def name_bonus(name: Column, asked: Asked) -> Column:
    """Points of a lower-cased name for what the question is after."""
    tight = F.regexp_replace(name, "[ -]", "")
    baby = _first(0.0, (asked.wants("baby") & name.contains("baby") & name.contains("shampoo"), 10.0))
    dandruff = _first(0.0, (asked.wants("anti_dandruff") & F.replace(name, F.lit("-"), F.lit("")).contains("dandruff"), 10.0))
    shampoo = _first(0.0, (~asked.wants("anti_dandruff", "shampoo"), 0.0), (tight.contains("shamdoo") | name.contains("shampoo"), 12.0), (name.contains("lotion"), -10.0))
    hand = _first(0.0, (~asked.hand_cream(), 0.0), (name.rlike(TUBE), 18.0), (name.rlike(NAMED_HAND_CREAM), 8.0), (name.contains("baby"), -15.0), (name.contains("shampoo"), -10.0))
    return baby + dandruff + shampoo + hand


def title_points(title: Column, name: Column, source: Column) -> Column:
    return _first(-18.0, (same_title(title, name), 48.0), (same_title(title, F.concat_ws("\n", name, F.substring(source, 1, 500))), 28.0))


def scored_for(rows: DataFrame, asked: Asked, brief: Brief | None = None, trusted: tuple[str, ...] = ()) -> DataFrame:
    """Recipes, or pairs of a question and a recipe, with ``breakdown`` and ``score`` from 0 to 100.

    ``rows``: name, product_types, doc_id, source_text, ingredients (lines with raw_name and
    normalized_name), names (array of line names), cost_per_kg and compliance where a brief is
    given, and the columns of ``asked``."""
    brief = brief or Brief()
    name, n, source = F.lower("name"), F.size("names"), F.coalesce("source_text", F.lit(""))
    hits, need = asked.hits(), F.size(asked.required)
    shared = reduce(or_, [asked.question.rlike(p) for p in MODIFIERS])  # the question's own words count among the recipe's
    cap = F.when((need > 0) | (F.size(asked.titles) > 0), 8.0).otherwise(20.0)
    typed = F.size(F.array_except(asked.types, types_of(F.col("product_types"), F.col("name"), source))) == 0
    parts: dict[str, Column] = {
        "product_type_match": _first(0.0, (F.size(asked.types) == 0, 20.0), (typed, 40.0)),
        "modifier_match": _first(0.0, (shared, 30.0)),
        "ingredient_completeness": F.least(n, F.lit(15)) / 15.0 * cap,
        "source_quality": _first(5.0, (reduce(or_, [F.col("doc_id").startswith(p) for p in trusted], F.lit(False)), 10.0)),
        "name_bonus": name_bonus(name, asked),
        "preferred_ingredients": preferred_score(F.col("names"), brief.preferred),
        "ingredient_match": _first(-30.0, (need == 0, 0.0), (hits == need, 45.0), (hits > 0, hits * 12.0 - 8.0)),
        "named_formula": F.when(F.size(asked.titles) == 0, 0.0).otherwise(F.array_max(F.transform(asked.titles, lambda t: title_points(t, F.col("name"), source)))),
    }
    if brief.markets:
        parts["compliance"] = _first(4.0, (F.col("compliance") == "fail", -100.0), (F.col("compliance") == "warn", -12.0))
    if brief.cost_target is not None:
        parts["cost_target"] = cost_score(F.col("cost_per_kg"), brief.cost_target)
    parts["hand_cream_title"] = F.when(asked.hand_cream(), _first(0.0, (name.rlike(TUBE), 25.0), (name.rlike(NAMED_HAND_CREAM), 10.0), (name.contains("baby") | name.contains("shampoo"), -20.0)))
    out = rows.withColumn("breakdown", F.map_filter(F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), v.cast("double"))]), lambda _, v: v.isNotNull()))
    total = F.aggregate(F.map_values("breakdown"), F.lit(0.0), lambda a, b: a + b)
    return out.withColumn("score", F.least(F.lit(100.0), F.greatest(F.lit(0.0), total)))


def scored(formulations: DataFrame, types: list[str], required: list[str] = (), titles: list[str] = (), brief: Brief | None = None, trusted: tuple[str, ...] = (), question: str = "") -> DataFrame:
    """`scored_for` for one question over ``formulations``: ``required`` are ingredients and ``titles``
    the recipes that it names."""
    return scored_for(formulations, Asked.given(types, required, titles, question), brief, trusted)


def tiers_for(asked: Asked) -> list[Column]:
    """Orders that precede the score, the last re-sort first: named recipes and required ingredients,
    shampoos where one against dandruff is asked for, hand creams by their titles. An order that a
    question does not ask for is the same for all recipes."""
    name, need, hits = F.lower("name"), F.size(asked.required), asked.hits()
    named = F.exists(asked.titles, lambda t: same_title(t, F.col("name")))
    every = hits == need
    none = (F.size(asked.titles) == 0) & (need == 0)
    return [
        _first(3, (none, 3), (named & every, 0), (named | (every & (need > 0)), 1), (hits > 0, 2)),
        _first(1, (asked.wants("anti_dandruff", "shampoo") & F.replace(name, F.lit(" "), F.lit("")).contains("sham"), 0)),
        _first(2, (~asked.hand_cream(), 2), (name.rlike(TUBE), 0), (name.rlike(NAMED_HAND_CREAM), 1)),
    ]


def tiers(types: list[str], required: list[str] = (), titles: list[str] = (), question: str = "") -> list[Column]:
    """The orders of `tiers_for` that one question asks for."""
    used = [bool(titles or required), {"anti_dandruff", "shampoo"} <= set(types), bool(re.search(HAND_CREAM, question))]
    return [t for t, use in zip(tiers_for(Asked.given(types, required, titles, question)), used, strict=True) if use]


def brief_filter(rows: DataFrame, brief: Brief) -> DataFrame:
    """Rows without banned lines (either name containing the other), failures, or too high a price."""
    held = lambda t: F.exists("names", lambda x: analytics.either_way(x, F.lit(t)))
    for term in brief.banned:
        rows = rows.filter(~held(term.lower()))
    if brief.markets:
        rows = rows.filter(F.coalesce("compliance", F.lit("pass")) != "fail")
    if brief.cost_target is not None:
        rows = rows.filter(F.col("cost_per_kg").isNull() | (F.col("cost_per_kg") <= brief.cost_target * COST_SLACK))
    return rows


def structured_search(formulations: DataFrame, types: list[str], limit: int = 5, brief: Brief | None = None, **how) -> DataFrame:
    """The best recipes: scored over the whole catalogue, the best of each name, filtered by the
    brief, re-sorted by `tiers` and cut. Titles, ingredients and modifiers come from the question
    (`answers.signals`) as ``titles``, ``required`` and ``question``."""
    for c, kind in (("source_text", "string"), ("ingredients", "array<struct<raw_name:string,normalized_name:string>>")):
        if c not in formulations.columns:
            lines = F.transform("names", lambda x: F.struct(x.alias("raw_name"), x.alias("normalized_name")))
            formulations = formulations.withColumn(c, lines if c == "ingredients" else F.lit(None).cast(kind))
    rows = scored(formulations.filter(F.size("names") >= 2), types, brief=brief, **how)
    rows = best(rows.withColumn("name_key", F.substring(F.lower("name"), 1, 80)), ["name_key"], [F.col("score").desc(), F.size("names").desc(), F.col("id")]).drop("name_key")
    order = tiers(types, how.get("required", ()), how.get("titles", ()), how.get("question", ""))
    return brief_filter(rows, brief or Brief()).orderBy(*order, F.col("score").desc(), "id").limit(limit)


def route_hint(found: DataFrame, required: list[str] = (), titles: list[str] = (), direct: float = 80.0, hybrid: float = 50.0) -> str:
    """direct, hybrid or fallback for the rows of `structured_search` (a few): by the best score; a
    best row that does not meet what was named is no direct answer."""
    rows = found.withColumn("met", matches_signals(list(required), list(titles)) if required or titles else F.lit(True)).select("score", "met").collect()
    top = max((r["score"] for r in rows), default=0.0)
    if top >= direct and rows[0]["met"]:
        return "direct"
    return "hybrid" if top >= hybrid else "fallback"
