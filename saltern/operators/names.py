"""Matching of recipe titles, ingredients and types, and reports over catalogues, as expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Misreadings of recognition and what they stand for, and words that tell no titles apart.
MISREADINGS = [
    ("moisturizins", "moisturizing"), ("moisturizina", "moisturizing"), ("moisturisins", "moisturizing"), ("moisturixins", "moisturizing"), ("moisturising", "moisturizing"),
    ("liahteninu", "lightening"), ("shamdoo", "shampoo"), ("shamwoo", "shampoo"), ("conditionina", "conditioning"), ("usins", "using"),
]
PLAIN_WORDS = ["cream", "lotion", "shampoo", "conditioner", "gel", "formula", "formulation", "product", "products", "skin", "hair", "body", "liquid"]

# Signs of a product type in a recipe's name and text (the third set of patterns).
RECIPE_TYPES = {
    "anti_dandruff": r"anti[-\s]?dandruff|antidandruff", "baby": r"\bbaby\b", "shampoo": r"\bshampoo\b|\bshamdoo\b", "cream": r"\bcream\b", "lotion": r"\blotion\b", "conditioner": r"\bcondition",
    "sunscreen": r"\bsun|spf|solar|uv", "soap": r"\bsoap\b|hand\s+cleaner", "makeup": r"\blipstick\b|make[-\s]?up", "deodorant": r"\bdeodorant\b|antiperspirant", "cleanser": r"\bcleanse|facial\s+wash",
    "toner": r"\btoner\b", "gel": r"\bgel\b|shower\s+(?:gel|bath)",
}


def unfolded(text: Column) -> Column:
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), MISREADINGS, F.lower(text))


def _words(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 0))


def same_title(asked: Column, title: Column) -> Column:
    """Whether a title is the one asked for: equal, one within the other from twelve letters on, or
    with enough words in common, telling words among them."""
    a, b = unfolded(asked), unfolded(title)
    x, y = F.regexp_replace(a, "[^a-z0-9]", ""), F.regexp_replace(b, "[^a-z0-9]", "")
    inside = (x.contains(y) | y.contains(x)) & (F.least(F.char_length(x), F.char_length(y)) >= 12)
    p, q = _words(a, "[a-z]{3,}"), _words(b, "[a-z]{3,}")
    telling = F.array_except(p, F.array(*map(F.lit, PLAIN_WORDS)))
    told = F.size(F.array_intersect(telling, q))
    share = F.size(F.array_intersect(p, q)) / F.greatest(F.size(p), F.lit(1))
    words = F.when(F.size(telling) >= 2, (share >= 0.7) & (told >= 2)).when(F.size(telling) == 1, (share >= 0.65) & (told >= 1)).otherwise((F.size(p) >= 2) & (share == 1))
    return F.coalesce((x != "") & (y != "") & ((x == y) | inside | ((F.size(p) > 0) & words)), F.lit(False))


def has_ingredient(needle: str | Column, ingredients: Column, name: Column, source: Column) -> Column:
    """Whether a recipe has an ingredient: in a line (with or without spaces, or three quarters of
    its words), or, failing that, in its text; sun protection factors by their number. ``needle`` is a
    name or a column of names."""
    n = F.lower(F.btrim(needle if isinstance(needle, Column) else F.lit(needle)))
    text, tight = F.lower(F.concat_ws("\n", name, source)), F.replace(n, F.lit(" "), F.lit(""))
    digits = F.regexp_replace(n, "[^0-9]", "")
    factor = F.rlike(text, F.when(digits != "", F.concat(F.lit(r"\bspf\s*"), digits, F.lit(r"\b"))).otherwise(F.lit(r"\bspf\b")))
    words = _words(n, "[a-z0-9]{3,}")

    def line(x: Column) -> Column:
        raw, norm = F.lower(F.coalesce(x["raw_name"], F.lit(""))), F.lower(F.coalesce(x["normalized_name"], F.lit("")))
        close = raw.contains(n) | norm.contains(n) | F.replace(raw, F.lit(" "), F.lit("")).contains(tight) | F.replace(norm, F.lit(" "), F.lit("")).contains(tight)
        own = _words(F.concat_ws(" ", raw, norm), "[a-z0-9]{3,}")
        return close | (F.size(words) > 0) & (F.size(F.array_intersect(words, own)) >= 0.75 * F.size(words))

    telling = F.array_except(words, F.array(F.lit("the"), F.lit("and")))
    hits = F.size(F.filter(telling, lambda w: text.contains(w)))
    rest = F.when(F.size(telling) >= 2, hits >= F.greatest(F.lit(2), F.size(telling) - 1)).otherwise(text.contains(n) & (F.char_length(n) >= 5))
    return F.when(F.coalesce(n, F.lit("")) == "", F.lit(False)).when(n.startswith("spf"), factor).otherwise(F.exists(ingredients, line) | rest)


def types_of(tags: Column, name: Column, source: Column) -> Column:
    """All types that a recipe is of, by its tags or its text."""
    text = F.lower(F.concat_ws("\n", name, source))
    return F.array_union(F.coalesce(tags, F.array().cast("array<string>")), F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(t)) for t, p in RECIPE_TYPES.items()])))


def has_types(required: list[str], tags: Column, name: Column, source: Column) -> Column:
    """Whether a recipe is of all types, by its tags or its text."""
    return F.size(F.array_except(F.array(*map(F.lit, required)).cast("array<string>"), types_of(tags, name, source))) == 0


def meets(required: Column, titles: Column) -> Column:
    """Whether a recipe (name, source_text, ingredients) has all ingredients, and the one title, asked for."""
    name, source, title = F.col("name"), F.col("source_text"), F.get(titles, F.lit(0))
    titled = (F.size(titles) != 1) | same_title(title, name) | same_title(title, F.substring(source, 1, 240))
    return F.forall(required, lambda t: has_ingredient(t, F.col("ingredients"), name, source)) & titled


def matches_signals(required: list[str], titles: list[str]) -> Column:
    """`meets` for given ingredients and titles."""
    return meets(*[F.array(*map(F.lit, x)).cast("array<string>") for x in (required, titles)])


def best_for_targets(ranked: DataFrame, targets: list[str]) -> DataFrame:
    """(target, id): for each named target the recipe whose title matches, the shortest title first,
    else the best-scored one; a recipe serves one target. ``ranked``: id, name, score."""
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(t).alias("target")) for k, t in enumerate(targets[:3])]))
    rows = ranked.select("id", "name", "score", wanted.alias("w")).select("id", "name", "score", "w.*")
    rows = rows.withColumn("same", same_title(F.col("target"), F.col("name")))
    first = F.struct((~F.col("same")).alias("other"), F.when(F.col("same"), F.char_length("name")).alias("length"), (-F.col("score")).alias("rank"), "id")
    rows = rows.groupBy("k", "target").agg(F.min(first).getField("id").alias("id"))  # a row a target; minima are taken before the shuffle
    first = F.row_number().over(Window.partitionBy("id").orderBy("k"))
    return rows.withColumn("r", first).filter("r = 1").select("target", "id")


def relevance(confidence: Column, name_points: Column, n_ingredients: Column) -> Column:
    """The plain ranking of recipes: confidence, points of the name, and completeness."""
    return confidence + 0.2 * name_points + 0.06 * F.least(n_ingredients, F.lit(24))


def ocr_summary(manifest: DataFrame) -> DataFrame:
    """One row: documents with recognised pages, and their number."""
    count = F.coalesce(F.col("ocr_pages_count"), F.lit(0))
    return manifest.agg(F.count_if(count > 0).alias("documents_with_ocr"), F.coalesce(F.sum(F.when(count > 0, count)), F.lit(0)).alias("total_ocr_pages"))


def resolve_totals(aliases: DataFrame, sure: float = 0.7) -> DataFrame:
    """One row: materials with a sure (or manual) name, and all others, which someone should look at."""
    manual = F.col("source").eqNullSafe("manual") if "source" in aliases.columns else F.lit(False)
    good = F.col("canonical_name").isNotNull() & (manual | (F.coalesce("confidence", F.lit(0.0)) >= sure))
    return aliases.agg(F.count_if(good).alias("resolved"), F.count_if(~good).alias("needs_review"))


def corpus_names(lines: DataFrame) -> DataFrame:
    """(normalized_name, raw_name): distinct names, the first spelling of each."""
    return lines.filter("normalized_name <> ''").groupBy("normalized_name").agg(F.min(F.struct("formulation_id", "line_no", "raw_name")).alias("x")).select("normalized_name", "x.raw_name")


def by_route(results: DataFrame) -> DataFrame:
    """(route, n, mean, passed) of judged answers."""
    return results.groupBy(F.coalesce("route", F.lit("unknown")).alias("route")).agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.count_if("pass").alias("passed"))


def price_sample(costs: DataFrame) -> DataFrame:
    """One row: priced recipes, their share and mean price, and the upper middle of their coverage."""
    priced = costs.filter("cost_per_kg IS NOT NULL")
    middle = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY covered_percent DESC)")  # of an even number, the upper one
    out = priced.agg(F.count("*").alias("priced"), F.avg("cost_per_kg").alias("mean_cost_per_kg"), F.when(F.count("*") > 0, middle).alias("median_coverage"))
    return out.crossJoin(costs.agg(F.count("*").alias("sampled"))).withColumn("share_priced", F.when(F.col("sampled") > 0, F.col("priced") / F.col("sampled")).otherwise(0.0))
