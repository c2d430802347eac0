"""Recipe analytics: cost, compliance, comparison, roles, substitution and batches.

``lines``: formulation_id, line_no, raw_name, normalized_name, amount, unit. Names meet reference
tables (prices, regulatory rules, substitution rules) through the grams of `containment`, whatever
the tables' sizes. `theta` serves conditions that have no such form: it counts the table before it
broadcasts, and deals larger ones into blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saltern.functions.text import SPACES, bounded, canonical_key, ingredient_name
from saltern.operators import containment
from saltern.operators.catalog import best

#: Rows of a reference table (a few hundred bytes each) that are broadcast to a containment join.
BROADCAST_ROWS = 20_000

# Functional roles by pattern.
ROLES = [
    ("surfactant", r"(?i)sulfate|betaine|capb|lauryl|laureth|surfactant"),
    ("emulsifier", r"(?i)emulsif|stearate|peg-|cetearyl|polysorbate"),
    ("preservative", r"(?i)phenoxy|paraben|benzoate|sorbate|caprylyl|preserv"),
    ("humectant", r"(?i)glycerin|propylene glycol|sorbitol|humectant"),
    ("oil", r"(?i)\boil\b|butter|wax|dimethicone|silicone"),
]


def theta(left: DataFrame, rules: DataFrame, condition: Column, how: str = "inner") -> DataFrame:
    """A containment join with a reference table of any size.

    Beyond the bound, an inner join is the union of joins with blocks of about ``BROADCAST_ROWS``
    rows, dealt by a hash of the whole row; ``left`` is then read once for each block.
    """
    n = rules.count()
    if n <= BROADCAST_ROWS:
        return left.join(F.broadcast(rules), condition, how)
    if how != "inner":
        raise ValueError(f"a reference table of {n} rows; at most {BROADCAST_ROWS} are joined by containment unless the join is inner")
    blocks = -(-n // BROADCAST_ROWS)
    block = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rules.columns]), F.lit(blocks))
    return reduce(DataFrame.union, [left.join(F.broadcast(rules.filter(block == k)), condition) for k in range(blocks)])


def either_way(a: Column, b: Column) -> Column:
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a))


def price_table(raw: DataFrame) -> DataFrame:
    """(ingredient, price, pos) from rows of text: the name and its canonical form, last price wins.

    ``raw``: pos, ingredient or name, price_per_kg_usd or price_per_kg or price, all strings.
    """
    pick = lambda *names: F.coalesce(*[F.when(F.btrim(F.col(n)) != "", F.col(n)) for n in names if n in raw.columns])
    rows = raw.select("pos", F.lower(F.btrim(pick("ingredient", "name"), F.lit(SPACES))).alias("ingredient"), pick("price_per_kg_usd", "price_per_kg", "price").try_cast("double").alias("price"))
    rows = rows.filter("ingredient <> '' AND price IS NOT NULL")
    both = rows.withColumn("alias", F.lit(0)).unionByName(rows.withColumn("ingredient", ingredient_name(F.col("ingredient"))).withColumn("alias", F.lit(1)).filter("ingredient <> ''"))
    first = both.groupBy("ingredient").agg(F.min(F.struct("pos", "alias")).alias("first"))
    last = best(both, ["ingredient"], [F.col("pos").desc(), F.col("alias").desc()]).select("ingredient", "price")
    out = last.join(first, "ingredient")
    return out.select("ingredient", "price", (F.col("first.pos") * 2 + F.col("first.alias")).alias("pos"))


def merge_prices(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by lower-case name, the last row winning; negative prices are dropped."""
    rows = old.select("ingredient", "price", "pos", F.lit(0).alias("side")).unionByName(new.select("ingredient", "price", "pos", F.lit(1).alias("side")))
    rows = rows.withColumn("ingredient", F.lower(F.btrim("ingredient"))).filter((F.col("ingredient") != "") & ((F.col("side") == 0) | (F.col("price") >= 0)))
    return best(rows, ["ingredient"], [F.col("side").desc(), F.col("pos").desc()]).select("ingredient", "price")


def line_prices(lines: DataFrame, prices: DataFrame) -> DataFrame:
    """``lines`` with ``price``: the exact name of three candidates in order, else the first price
    that contains a candidate or is contained in one.

    Only distinct names meet the price table.
    """
    names = lines.select("raw_name", "normalized_name").distinct()
    candidates = F.array(F.lower(F.coalesce("normalized_name", F.lit(""))), F.lower(F.btrim("raw_name", F.lit(SPACES))), ingredient_name(F.col("raw_name")))
    asked = names.select("raw_name", "normalized_name", F.posexplode(candidates).alias("candidate", "name")).filter("name <> ''")
    near = containment.either_way(asked.select("name"), prices.select("ingredient")).withColumnRenamed("term", "ingredient")
    pairs = asked.join(near, "name").join(prices, "ingredient")
    rank = F.struct(F.when(F.col("name") == F.col("ingredient"), 0).otherwise(1).alias("stage"), "candidate", "pos")
    found = pairs.groupBy("raw_name", "normalized_name").agg(F.min(F.struct(rank.alias("rank"), "price")).alias("x"))
    keys = found.select("raw_name", "normalized_name", F.col("x.price").alias("price")).withColumnsRenamed({"raw_name": "r_", "normalized_name": "n_"})
    return lines.join(keys, lines["raw_name"].eqNullSafe(keys["r_"]) & lines["normalized_name"].eqNullSafe(keys["n_"]), "left").drop("r_", "n_")


def costs(lines: DataFrame, prices: DataFrame) -> DataFrame:
    """(formulation_id, cost_per_kg, covered_percent, missing): of lines in per cent with an amount."""
    used = line_prices(lines.filter("unit = '%' AND amount > 0"), prices)
    total, covered = F.sum("amount"), F.sum(F.when(F.col("price").isNotNull(), F.col("amount")))
    missing = F.sort_array(F.collect_list(F.when(F.col("price").isNull(), F.struct("line_no", "raw_name"))))
    out = used.groupBy("formulation_id").agg(F.sum(F.col("amount") / 100 * F.col("price")).alias("cost"), total.alias("total"), covered.alias("covered"), F.slice(missing, 1, 12).alias("missing"))
    share = F.coalesce(F.col("covered"), F.lit(0.0)) / F.col("total")
    return out.select("formulation_id", bounded(F.when(F.col("covered") > 0, F.col("cost")), 4).alias("cost_per_kg"), bounded(share, 4).alias("covered_percent"), F.transform("missing", lambda x: x["raw_name"]).alias("missing"))


def _regulated(lines: DataFrame, rules: DataFrame, markets: list[str]) -> DataFrame:
    """(formulation_id, raw_name, rule, over, source): lines that a rule of the markets names. Only
    distinct names meet the rules."""
    own = F.lower(F.coalesce(F.when(F.col("normalized_name") != "", F.col("normalized_name")), F.when(ingredient_name(F.col("raw_name")) != "", ingredient_name(F.col("raw_name"))), F.col("raw_name")))
    asked = rules.filter(F.upper("market").isin([m.strip().upper() for m in markets if m.strip()]))
    source = F.col("source_ref") if "source_ref" in rules.columns else F.lit(None).cast("string")
    asked = asked.select(F.explode(F.concat(F.array(F.lower("ingredient")), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), F.lower))).alias("term"), F.lower("status").alias("rule"), "max_percent", source.alias("source")).filter("term <> ''")
    used = lines.select("formulation_id", "raw_name", "amount", "unit", own.alias("name_"))
    names = used.select("name_", F.lower("raw_name").alias("raw_")).distinct()
    near = containment.either_way(names.select(F.explode(F.array("name_", "raw_"))), asked.select("term"))
    hits = reduce(DataFrame.union, [names.join(near, F.col(c) == F.col("name")) for c in ("name_", "raw_")]).join(asked, "term")
    hits = hits.select(F.col("name_").alias("n_"), F.col("raw_").alias("r_"), "rule", "max_percent", "source").distinct()
    both = used.join(hits, used["name_"].eqNullSafe(hits["n_"]) & F.lower(used["raw_name"]).eqNullSafe(hits["r_"]))
    over = F.coalesce((F.col("unit") == "%") & (F.col("amount") > F.col("max_percent")), F.lit(False))
    return both.select("formulation_id", "raw_name", "rule", over.alias("over"), "source")


def compliance(lines: DataFrame, rules: DataFrame, markets: list[str]) -> DataFrame:
    """(formulation_id, status): fail, warn or pass over the given markets.

    ``rules``: ingredient, aliases, market, status, max_percent. A name matches where one contains
    the other, in either direction, aliases too; a limit needs an amount in per cent.
    """
    level = F.when(F.col("rule") == "prohibited", 2).when((F.col("rule") == "restricted") & F.col("over"), 2).when(F.col("rule") == "restricted", 1).otherwise(0)
    worst = _regulated(lines, rules, markets).groupBy("formulation_id").agg(F.max(level).alias("level"))
    every = lines.select("formulation_id").distinct().join(worst, "formulation_id", "left")
    return every.select("formulation_id", F.when(F.col("level") == 2, "fail").when(F.col("level") == 1, "warn").otherwise("pass").alias("status"))


def regulatory_findings(lines: DataFrame, rules: DataFrame, markets: list[str]) -> DataFrame:
    """Findings of the regulatory family, as the rule engine's: an error for a prohibited name, a
    warning for another rule's; they cap the status and do not enter the score."""
    rule = F.col("rule")
    return _regulated(lines, rules, markets).select("formulation_id", F.concat(F.lit("regulatory."), rule).alias("rule_id"), F.lit("regulatory").alias("family"), F.when(rule == "prohibited", "error").otherwise("warning").alias("severity"), F.col("raw_name").alias("ingredient"), rule.alias("observed"))


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """Lines by key: ``side`` (left, right or both), with both amounts; equal ones are left out."""
    def keyed(lines: DataFrame, name: str) -> DataFrame:
        own = lines.withColumn("key", canonical_key(F.coalesce(F.when(F.col("normalized_name") != "", F.col("normalized_name")), F.col("raw_name"))))
        last = best(own, ["key"], [F.col("line_no").desc()])
        return last.select("key", F.col("raw_name").alias(f"{name}_name"), F.col("amount").alias(f"{name}_amount"), F.col("unit").alias(f"{name}_unit"), F.lit(True).alias(f"in_{name}"))

    both = keyed(left, "left").join(keyed(right, "right"), "key", "full_outer")
    side = F.when(F.col("in_left") & F.col("in_right"), "both").when(F.col("in_left"), "left").otherwise("right")
    same = F.col("left_amount").eqNullSafe(F.col("right_amount")) & F.col("left_unit").eqNullSafe(F.col("right_unit"))
    return both.withColumn("side", side).filter((F.col("side") != "both") | ~same).drop("in_left", "in_right")


def roles(lines: DataFrame) -> DataFrame:
    """(formulation_id, role, n, examples): lines by functional role, with up to four names."""
    text = F.concat_ws(" ", "raw_name", "normalized_name")
    held = F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(r)) for r, p in ROLES]))
    rows = lines.select("formulation_id", "line_no", "raw_name", F.explode(held).alias("role"))
    names = F.slice(F.sort_array(F.collect_list(F.struct("line_no", "raw_name"))), 1, 4)
    return rows.groupBy("formulation_id", "role").agg(F.count("*").alias("n"), F.transform(names, lambda x: x["raw_name"]).alias("examples"))


def rule_substitutes(lines: DataFrame, rules: DataFrame, banned: tuple[str, ...] = (), types: DataFrame | None = None) -> DataFrame:
    """(formulation_id, name, substitute, confidence): of rules whose name matches the line's either
    way. With ``types`` (formulation_id, product_types), rules for product types are for recipes
    that share one."""
    typed = "product_types" in rules.columns and types is not None
    asked = rules.select(F.explode(F.concat(F.array(F.lower("from")), F.transform(F.coalesce("aliases_from", F.array().cast("array<string>")), F.lower))).alias("term"), F.col("to").alias("substitute"), "confidence", *([F.col("product_types").alias("for_types")] if typed else []))
    own = lines.select("formulation_id", F.lower(F.coalesce("normalized_name", "raw_name")).alias("name"))
    names = own.select("name").distinct()
    hits = own.join(containment.either_way(names, asked.select("term")).join(asked, "term"), "name")
    for term in banned:
        hits = hits.filter(~either_way(F.lower("substitute"), F.lit(term.lower())))
    if typed:
        hits = hits.join(types.select("formulation_id", "product_types"), "formulation_id", "left")
        hits = hits.filter((F.size(F.coalesce("for_types", F.array())) == 0) | F.coalesce(F.arrays_overlap("for_types", "product_types"), F.lit(False)))
    return hits.groupBy("formulation_id", "name", "substitute").agg(F.max("confidence").alias("confidence"))


def peer_substitutes(recipe: DataFrame, ingredient: str, formulations: DataFrame, lines: DataFrame, peers: int = 40, top: int = 5) -> DataFrame:
    """(formulation_id, name, substitute, confidence): what the surest ``peers`` formulations with all
    of the recipe's product types hold most often, if the recipe holds the ingredient.

    ``recipe``: one row of ``formulations`` (id, product_types, confidence)."""
    wanted = canonical_key(F.lit(ingredient))
    name = F.lower(F.coalesce(F.when(F.col("normalized_name") != "", F.col("normalized_name")), F.col("raw_name")))
    held = lines.join(recipe.select(F.col("id").alias("formulation_id")), "formulation_id").filter(F.lower(F.coalesce("normalized_name", F.lit(""))).contains(wanted) | F.lower("raw_name").contains(wanted)).select(F.col("formulation_id").alias("id")).distinct()
    own = recipe.join(held, "id").select(F.col("id").alias("own"), F.coalesce("product_types", F.array().cast("array<string>")).alias("types"))
    like = formulations.join(F.broadcast(own), F.size(F.array_except("types", "product_types")) == 0).orderBy(F.col("confidence").desc(), "id").limit(peers)  # own is one row
    found = lines.join(like.filter("id <> own").select(F.col("id").alias("formulation_id"), "own"), "formulation_id").select("own", name.alias("substitute"))
    counts = found.filter(~either_way(F.col("substitute"), wanted)).groupBy("own", "substitute").agg(F.count("*").alias("n"))
    counts = counts.orderBy(F.col("n").desc(), "substitute").limit(top)
    return counts.select(F.col("own").alias("formulation_id"), wanted.alias("name"), "substitute", co_confidence(F.col("n")).alias("confidence"))


def suggest_substitutions(recipe: DataFrame, ingredient: str, formulations: DataFrame, lines: DataFrame, rules: DataFrame, banned: tuple[str, ...] = (), limit: int = 5) -> DataFrame:
    """(formulation_id, name, substitute, confidence): rules for the ingredient and peers' ingredients,
    of each substitute the surer, the surest first."""
    one = recipe.select(F.col("id").alias("formulation_id"), "product_types", F.lit(ingredient.lower()).alias("raw_name"), F.lit(None).cast("string").alias("normalized_name"))
    by_rule = rule_substitutes(one, rules, banned, one).withColumn("name", canonical_key(F.lit(ingredient)))
    both = merge_suggestions(by_rule.withColumn("substitute", F.lower("substitute")), peer_substitutes(recipe, ingredient, formulations, lines), key=["formulation_id", "name", "substitute"])
    return both.orderBy(F.col("confidence").desc(), "substitute").limit(limit)


def co_occurrence(lines: DataFrame, group: str = "formulation_id", name: str = "normalized_name", top: int = 5, most: int = 500) -> DataFrame:
    """(name, other, n, pos): what a name most often shares a formulation with.

    Pairs are made of a formulation's distinct names, which are few; formulations with more than
    ``most`` names are joined with the others' names through an equi-join instead of an array, so
    neither side is dropped.
    """
    rows = lines.select(group, name).distinct()
    sizes = rows.groupBy(group).agg(F.count("*").alias("k"))
    own = rows.join(sizes, group)
    small = own.filter(F.col("k") <= most).groupBy(group).agg(F.collect_list(name).alias("names"))
    pairs = small.select(F.explode("names").alias("a"), "names").select("a", F.explode("names").alias("b"))
    large = own.filter(F.col("k") > most)
    pairs = pairs.union(large.select(group, F.col(name).alias("a")).join(large.select(group, F.col(name).alias("b")), group).select("a", "b"))
    counted = pairs.filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))
    order = Window.partitionBy("a").orderBy(F.col("n").desc(), "b")
    return counted.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= top).select(F.col("a").alias("name"), F.col("b").alias("other"), "n", "pos")


def co_confidence(n: Column) -> Column:
    return F.least(F.lit(0.9), F.lit(0.5) + F.lit(0.08) * n)


def merge_suggestions(*parts: DataFrame, key: list[str]) -> DataFrame:
    """Suggestions of all parts; of a key, the one with the most confidence."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy(*key).agg(F.max("confidence").alias("confidence"))


def scale_batch(lines: DataFrame, kg: float) -> DataFrame:
    """``lines`` with ``grams`` for a batch: shares of the mass in per cent, others in proportion."""
    base = F.sum(F.when(F.col("unit") == "%", F.col("amount"))).over(Window.partitionBy("formulation_id"))
    grams = F.when(F.col("unit") == "%", F.col("amount") / 100 * kg * 1000).when(base > 0, F.col("amount") * kg / base)
    return lines.withColumn("grams", grams).withColumn("percent_total", base).withColumn("balanced", F.abs(F.col("percent_total") - 100) <= 0.5)
