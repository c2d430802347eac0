"""Inventory: upload merge, name resolution, fuzzy scores, coverage and discovery."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saltern.functions.arabic import ARABIC_NAMES
from saltern.functions.text import SPACES, arabic_key, canonical_key, has_arabic, ingredient_name
from saltern.operators.catalog import best

# What names rows of an upload that are no materials, and names that stand for none.
SKIP = r"(?i)رصيد|دفعة|فاتورة|خصم|إجمالي|مجموع|تسوية|بدل\s*تلف|balance|payment|invoice|total|opening"
NO_NAMES = ["nan", "none", "null", "-"]
# Headers of an upload's name, quantity and stock-keeping columns.
NAME_HEADER = r"(?i)^(material|ingredient|name|description|item|product|raw|component|بيان|البيان|المادة|الصنف|المنتج|اسم|الوصف)s?$"
QTY_HEADER = r"(?i)^(qty|quantity|amount|stock|الكمية|كمية)$"
SKU_HEADER = r"(?i)^(sku|code|id|item_?code|الكود|كود)$"
HEADER_ROW = r"(?i)بيان|المادة|material|ingredient|description|الصنف"
# Confidences of resolved names by stage (the fuzzy ones at most so much).
ARABIC_EXACT, ARABIC_FUZZY, RULES, CORPUS = 0.93, 0.88, 0.95, 0.92
#: Rows of an upload that are kept, by default.
MAX_ROWS = 2000


def upload_key(raw: Column) -> Column:
    """What tells materials of an upload apart: the name, trimmed in lower case, with Arabic letters folded."""
    name = F.btrim(raw, F.lit(SPACES))
    return F.lower(F.when(has_arabic(raw), arabic_key(raw)).otherwise(name))


def is_material(name: Column) -> Column:
    """Whether a trimmed name of an upload is a material, and no total, payment or number."""
    return (F.char_length(name) >= 2) & ~F.lower(name).isin(NO_NAMES) & ~name.rlike(SKIP) & ~name.rlike("^[0-9]+$")


def merge_upload(rows: DataFrame, max_rows: int | None = MAX_ROWS) -> DataFrame:
    """One row for each `upload_key` of ``rows`` (pos, raw_name, sku, qty as text): the first
    spelling, the first sku, the sum of quantities (null if none is a number)."""
    name = F.btrim("raw_name", F.lit(SPACES))
    own = rows.filter(F.coalesce(is_material(name), F.lit(False)))
    qty = F.replace(F.col("qty").cast("string"), F.lit(","), F.lit("")).try_cast("double")
    own = own.select("pos", name.alias("raw_name"), F.when(F.btrim("sku") != "", F.btrim("sku")).alias("sku"), qty.alias("qty"), upload_key(F.col("raw_name")).alias("key"))
    out = own.groupBy("key").agg(F.min(F.struct("pos", "raw_name")).alias("first"), F.min(F.when(F.col("sku").isNotNull(), F.struct("pos", "sku"))).alias("s"), F.sum("qty").alias("qty"))
    out = out.select("key", F.col("first.raw_name").alias("raw_name"), F.col("s.sku").alias("sku"), "qty")
    return out if max_rows is None else out.orderBy("raw_name", "key").limit(max_rows)


def name_column(columns: list[str]) -> str:
    """The column of an upload that holds names: by its header, else one with an Arabic header, else the first."""
    for c in columns:
        if re.search(NAME_HEADER, c.strip()):
            return c
    return next((c for c in columns if re.search("[\u0600-\u06ff]", c)), columns[0])


def optional_column(columns: list[str], header: str) -> str | None:
    return next((c for c in columns if re.search(header, c.strip())), None)


def _ratio(a: str, b: str) -> float:
    """100 times twice the longest common subsequence over both lengths.

    The subsequence's length comes from a whole row of the table at a time, as the bits of one
    integer: a bit is cleared where the length grows."""
    if not a and not b:
        return 100.0
    places: dict[str, int] = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & places.get(y, 0)
        row = (row + hit | row - hit) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


def set_ratio(a: str, b: str) -> float:
    """Similarity of two names' word sets: common words against common and own words of each."""
    x, y = set(a.lower().split()), set(b.lower().split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not only_x or not only_y):
        return 100.0
    common, left, right = " ".join(both), " ".join(both + only_x), " ".join(both + only_y)
    return max(_ratio(common, left), _ratio(common, right), _ratio(left, right)) if both else _ratio(left, right)


def sort_ratio(a: str, b: str) -> float:
    return _ratio(" ".join(sorted(a.lower().split())), " ".join(sorted(b.lower().split())))


def fuzzy(pairs: DataFrame, a: str, b: str, out: str = "score", scorer=set_ratio) -> DataFrame:
    """``pairs`` with the similarity of two name columns, in Arrow batches."""

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in parts:
            yield pd.Series([scorer(p, q) if p is not None and q is not None else 0.0 for p, q in zip(x, y, strict=True)])

    return pairs.withColumn(out, score(F.col(a), F.col(b)))


def _grams(key: str, q: int) -> list[str]:
    """The q-grams of a key, each with its number, so that sets of them are multisets."""
    seen: dict[str, int] = {}
    out = []
    for k in range(len(key) - q + 1):
        gram = key[k : k + q]
        seen[gram] = seen.get(gram, 0) + 1
        out.append(f"{seen[gram]}:{gram}")
    return out


def _blocks(name: str, threshold: float, by_set: bool) -> list[tuple[int, int, str]]:
    """(q, keep, block): whole words (q = 0, for the set score), letters and pairs of letters.

    A score of t (of 1) between keys of mean length m leaves at most d = 2 (1 - t) m letters out of
    the common subsequence. So t m letters are shared, and m - d / 2 - 1 - d pairs of letters, as a
    letter left out parts one pair of neighbours at most. The other key has at least t / (2 - t) of
    a key's length, hence m >= length / (2 - t). Names that must share n of their g blocks share
    one of the first g - n + 1 in any fixed order. Letters are for keys whose partner may be too
    short to be bound to share a pair.
    """
    t = threshold / 100
    words = name.lower().split()
    words = sorted(set(words)) if by_set else sorted(words)
    key = " ".join(words)
    if not key:
        return []
    out = [(0, len(words), w) for w in words] if by_set else []
    share = (3 * t - 2) / (2 - t)

    def need(n: int) -> int:
        return math.ceil(n * share - 1 - 1e-9)

    if need(len(key)) >= 1:
        pairs = _grams(key, 2)
        out += [(2, len(pairs) - need(len(key)) + 1, g) for g in pairs]
    # the longest key that need not share a pair, and the longest partner of such a key
    short = 2 / share + 1e-6 if share > 0 else math.inf
    if len(key) <= short * (2 - t) / t:
        letters = _grams(key, 1)
        out += [(1, len(letters) - max(1, math.ceil(len(key) * t / (2 - t) - 1e-9)) + 1, g) for g in letters]
    return out


def fuzzy_match(names: DataFrame, known: DataFrame, threshold: float = 82.0, scorer=set_ratio) -> DataFrame:
    """(name, match, score): the best known name of each name with at least ``threshold`` (over 0).

    ``scorer`` is `set_ratio` or `sort_ratio`. Only distinct names meet, and without a cross join:
    through a common word (for the set score), or through one of their rarest pairs of letters, of
    which so many are taken that no pair of names over the threshold is missed (`_blocks`).
    """
    if not threshold > 0:
        raise ValueError("a threshold over 0 is needed")
    by_set = scorer is set_ratio

    @F.pandas_udf("array<struct<q:int,keep:int,block:string>>")
    def blocks(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in parts:
            yield pd.Series([[{"q": q, "keep": k, "block": b} for q, k, b in _blocks(v, threshold, by_set)] for v in x], dtype=object)

    def exploded(x: DataFrame, c: str) -> DataFrame:
        own = x.select(c).filter(F.col(c).isNotNull()).distinct()
        return own.select(c, F.explode(blocks(F.col(c))).alias("b")).select(c, "b.q", "b.keep", "b.block")

    right = exploded(known, "match")
    seen = right.groupBy("q", "block").agg(F.count("*").alias("seen"))

    def first(x: DataFrame, c: str) -> DataFrame:
        rare = Window.partitionBy(c, "q").orderBy(F.coalesce("seen", F.lit(0)), "block")
        ranked = x.join(seen, ["q", "block"], "left").withColumn("r_", F.row_number().over(rare))
        return ranked.filter(F.col("r_") <= F.col("keep")).select(c, "q", "block")

    pairs = first(exploded(names, "name"), "name").join(first(right, "match"), ["q", "block"]).select("name", "match").distinct()
    scored = fuzzy(pairs, "name", "match", scorer=scorer).filter(F.col("score") >= threshold)
    return best(scored, ["name"], [F.col("score").desc(), F.col("match")])


def arabic_names(spark: SparkSession) -> DataFrame:
    """(key, canonical_name): the dictionary of Arabic trade names."""
    return spark.createDataFrame(list(ARABIC_NAMES.items()), "key string, canonical_name string")


def resolve(materials: DataFrame, overrides: DataFrame, arabic: DataFrame | None, corpus: DataFrame, arabic_threshold: float = 88.0, corpus_threshold: float = 82.0, vectors: DataFrame | None = None) -> DataFrame:
    """(material_id, raw_name, canonical_name, source, confidence), by the first stage that knows the
    name: override, Arabic dictionary (exact, then fuzzy), rules, names of the corpus, embeddings.
    A name that no stage knows has nulls.

    ``overrides``: key, canonical_name; ``arabic`` (None: `arabic_names`): key, canonical_name;
    ``corpus``: match; ``vectors``: raw_name, canonical_name, similarity, already filtered by its own
    threshold. Rules resolve every name that is not Arabic, so the later stages see Arabic names alone.
    """
    arabic = arabic_names(materials.sparkSession) if arabic is None else arabic
    own = materials.select(F.col("id").alias("material_id"), "raw_name", F.lower(F.btrim("raw_name", F.lit(SPACES))).alias("key"), F.lower(arabic_key(F.col("raw_name"))).alias("ar"))
    out = own.join(overrides.select("key", F.col("canonical_name").alias("c0")), "key", "left")
    out = out.join(arabic.select(F.col("key").alias("ar"), F.col("canonical_name").alias("c1")), "ar", "left")
    left = own.filter(has_arabic(F.col("raw_name"))).select(F.col("ar").alias("name"))
    near = fuzzy_match(left, arabic.select(F.col("key").alias("match")), arabic_threshold, sort_ratio).join(arabic.select(F.col("key").alias("match"), F.col("canonical_name").alias("c2")), "match").select(F.col("name").alias("ar"), "c2", F.col("score").alias("s2"))
    out = out.join(near, "ar", "left")
    named = fuzzy_match(left, corpus, corpus_threshold, sort_ratio).select(F.col("name").alias("ar"), F.col("match").alias("c4"), F.col("score").alias("s4"))
    out = out.join(named, "ar", "left")
    if vectors is not None:
        out = out.join(vectors.select("raw_name", F.col("canonical_name").alias("c5"), F.col("similarity").alias("s5")), "raw_name", "left")
    else:
        out = out.withColumns({"c5": F.lit(None).cast("string"), "s5": F.lit(None).cast("double")})
    rules = F.when(~has_arabic(F.col("raw_name")), F.nullif(ingredient_name(F.col("raw_name")), F.lit("")))
    stages = [
        ("override", F.col("c0"), F.lit(1.0)), ("arabic", F.col("c1"), F.lit(ARABIC_EXACT)), ("arabic", F.col("c2"), F.least(F.lit(ARABIC_FUZZY), F.col("s2") / 100)),
        ("rules", rules, F.lit(RULES)), ("corpus", F.col("c4"), F.least(F.lit(CORPUS), F.col("s4") / 100)), ("embedding", F.col("c5"), F.col("s5")),
    ]
    pick = F.coalesce(*[F.when(c.isNotNull(), F.struct(canonical_key(c).alias("canonical_name"), F.lit(s).alias("source"), v.cast("double").alias("confidence"))) for s, c, v in stages])
    return out.select("material_id", "raw_name", pick.alias("x")).select("material_id", "raw_name", "x.canonical_name", "x.source", "x.confidence")


def inventory(materials: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name): each material's most confident alias, or its own canonical name."""
    top = best(aliases, ["material_id"], [F.col("confidence").desc(), F.col("canonical_name")]).select("material_id", "canonical_name")
    out = materials.join(top, materials["id"] == top["material_id"], "left")
    return out.select(canonical_key(F.coalesce("canonical_name", "raw_name")).alias("name")).distinct()


def held(lines: DataFrame, stock: DataFrame, threshold: float | None = 86.0) -> DataFrame:
    """``lines`` with ``held``: whether the normalised or the raw name is in stock, or is as near to
    a name in stock as ``threshold`` (None: exact names only). Only distinct names meet the stock."""
    names = lines.select("raw_name", "normalized_name").distinct()
    candidates = F.array_compact(F.array(canonical_key(F.when(F.col("normalized_name") != "", F.col("normalized_name"))), canonical_key(F.col("raw_name"))))
    asked = names.select("raw_name", "normalized_name", F.explode(candidates).alias("name")).filter("name <> ''")
    known = stock.select("name").filter("name <> ''").distinct()
    hits = asked.join(known, "name", "left_semi").select("raw_name", "normalized_name")
    if threshold is not None:
        missed = asked.join(known, "name", "left_anti")
        near = fuzzy_match(missed.select("name"), known.select(F.col("name").alias("match")), threshold)
        hits = hits.unionByName(missed.join(near.select("name"), "name").select("raw_name", "normalized_name"))
    keys = hits.distinct().select(F.col("raw_name").alias("r_"), F.col("normalized_name").alias("n_"), F.lit(True).alias("held"))
    out = lines.join(keys, lines["raw_name"].eqNullSafe(keys["r_"]) & lines["normalized_name"].eqNullSafe(keys["n_"]), "left").drop("r_", "n_")
    return out.withColumn("held", F.coalesce("held", F.lit(False)))


def coverage(lines: DataFrame, stock: DataFrame, exclude_water: bool = True, least: int = 2, min_coverage: float = 50.0, threshold: float | None = 86.0) -> DataFrame:
    """(formulation_id, counted, matched, coverage_pct, tier): lines whose name is in stock, by `held`.

    Matched and missing lists come with `coverage_lists`.
    """
    own = lines.select("formulation_id", "raw_name", "normalized_name")
    if exclude_water:
        own = own.filter(canonical_key(F.coalesce("normalized_name", "raw_name")) != "water")
    marked = held(own, stock, threshold)
    out = marked.groupBy("formulation_id").agg(F.count("*").alias("counted"), F.count_if("held").alias("matched")).filter(F.col("counted") >= least)
    out = out.withColumn("coverage_pct", F.floor(F.col("matched") * 1000.0 / F.col("counted") + 0.5) / 10.0)
    return out.withColumn("tier", tier(F.col("coverage_pct"), min_coverage))


def tier(pct: Column, min_coverage: float = 50.0) -> Column:
    return F.when(pct >= 95, "makeable").when(pct >= min_coverage, "partial").otherwise("low")


def coverage_lists(lines: DataFrame, stock: DataFrame, threshold: float | None = 86.0) -> DataFrame:
    """(formulation_id, matched, missing): names in the order of their lines, by `held`."""
    own = held(lines.select("formulation_id", "line_no", "raw_name", "normalized_name"), stock, threshold)
    pick = lambda c: F.transform(F.sort_array(F.collect_list(F.when(c, F.struct("line_no", "raw_name")))), lambda x: x["raw_name"])
    return own.groupBy("formulation_id").agg(pick(F.col("held")).alias("matched"), pick(~F.col("held")).alias("missing"))


# Names of formulations that are none.
JUNK_FORMULATION = r"(?i)^(wt\s*%|wt%|\d+\.?\d*\s*%|formulation\s*\d*|page\s*\d+|cosmetic and toiletry formulations\s*$)"


def is_junk_formulation(name: Column) -> Column:
    """Whether a formulation's name is too short, a number or a page's heading; null counts as short."""
    own = F.btrim(F.coalesce(name, F.lit("")), F.lit(SPACES))
    return (F.char_length(own) < 5) | own.rlike(JUNK_FORMULATION) | own.rlike("^[0-9]+$")


def discover(covered: DataFrame, formulations: DataFrame, costs: DataFrame, min_coverage: float = 50.0, limit: int = 100) -> DataFrame:
    """What can be made, best first: tier, coverage, cost (unknown last), name. Junk names are left out."""
    formulations = formulations.filter(~is_junk_formulation(F.col("name")))
    rows = covered.filter(F.col("coverage_pct") >= min_coverage).join(formulations, covered["formulation_id"] == formulations["id"]).join(costs, "formulation_id", "left")
    rank = F.when(F.col("tier") == "makeable", 0).when(F.col("tier") == "partial", 1).otherwise(2)
    return rows.orderBy(rank, F.col("coverage_pct").desc(), F.coalesce("cost_per_kg", F.lit(1e9)), F.lower("name"), "id").limit(limit)


def latest(rows: DataFrame, key: str, at: list[str]) -> DataFrame:
    return rows.withColumn("r_", F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in at]))).filter("r_ = 1").drop("r_")
