"""Further registered queries, each with its SQL: layouts, sources, names, reports, ranking and rules.

They read the same stand-ins as `saltern.plans.queries`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saltern.functions import text as T
from saltern.functions.text import bounded
from saltern.operators import analytics, catalog, conversations, evaluate, fingerprints, names, retrieval, rules, warehouse
from saltern.operators.calls import CallTable
from saltern.operators.vector_collection import VectorCollection
from saltern.plans import answers, chat, intent, question_search, ranking
from saltern.plans.queries import _BM25, LINES, _boost_sql, _dot, _formula_sql, _round, formulations_of, lines_of, read
from saltern.sources import recipes, tables
from saltern.sources.recipe_store import RecipeStore
from saltern.sources.shared import new_path, written
from saltern.streaming.jobs import IngestStore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """Register a query, with its SQL if SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# Layouts: each part's name and numbers in one of the thirteen layouts, and what is read from it.

#: By layout: the block's text with name {n} and amounts {a}, {b} (two decimals), and (suffix of the name, amount or None, unit or None, phase or None) of each row.
LAYOUTS = {
    "japan_rx": ("Prescription 4\nPart\nIngredient\n%\n1\nA\n{n} acid\n{a}\n2\nB\nPurified water\nto 100\nDirections: heat", [("acid", "a", "%", "A"), (None, None, "qs", "B")]),
    "phase_inline": ("Wt%\nA\n{n} one\n{n} two\nB\n{n} three\n{n} four\n{a}\n{b}\n{a}\n{b}\nProcedure: mix", [("one", "a", "wt%", "A"), ("two", "b", "wt%", "A"), ("three", "a", "wt%", "B"), ("four", "b", "wt%", "B")]),
    "part_labeled": ("[TABLE]\nPhase | Ingredients: | wt%\nA | {n} one | {a}\nA | {n} two | {b}\nB | {n} three | {a}\nC | {n} oil | q s", [("one", "a", "wt%", "A"), ("two", "b", "wt%", "A"), ("three", "a", "wt%", "B"), ("oil", None, "qs", "C")]),
    "part_function": ("Ingredient / Function\nPart A:\n{n} one / Thickener\n{a}\nPart B:\n{n} two / Solvent\n{b}\nProcedure: mix", [("one", "a", "wt%", "A"), ("two", "b", "wt%", "B")]),
    "leading_amounts": ("Rinse\nwt%\n{a}\n{b}\nIngredients:\n{n} one\n{n} two\nProcedure: mix", [("one", "a", "wt%", None), ("two", "b", "wt%", None)]),
    "column_wt": ("Ingredients:\n{n} one\n{n} two\n{n} three\nwt%\n{a}\n{b}\n{a}\nProcedure: mix", [("one", "a", "wt%", None), ("two", "b", "wt%", None), ("three", "a", "wt%", None)]),
    "numbered_stage": ("Stage: Material\nwt%\nOil Phase:\n1\n{n} one\n{a}\n2\n{n} two\n{b}\nAqueous Phase:\n3\n{n} three\n{a}\nMixing instructions", [("one", "a", "wt%", "Oil"), ("two", "b", "wt%", "Oil"), ("three", "a", "wt%", "Aqueous")]),
    "component_wt": ("Components:\nwt%\n{n} long\nname one\n{a}\n{n} two\n{b}\nProcedure", [("long name one", "a", "wt%", None), ("two", "b", "wt%", None)]),
    "table": ("Ingredients: (all)\n{n} one {a} %\n{n} two {b} %\n{n} three {a} %\n{n} four {b} %", [("one", "a", "%", None), ("two", "b", "%", None), ("three", "a", "%", None), ("four", "b", "%", None)]),
    "wtg": ("* wt. g\n{n} one\n{a}\n{n} two\n{b}\n{n} three\n{a}", [("one", "a", "wtg", None), ("two", "b", "wtg", None), ("three", "a", "wtg", None)]),
    "list": ("A cleanser.\nIngredients:\n{n} one\n{n} two\n{n} three", [("one", None, None, None), ("two", None, None, None), ("three", None, None, None)]),
}


def _layout_sql() -> str:
    values = []
    for k, (method, (_, rows)) in enumerate(LAYOUTS.items()):
        for i, (suffix, amount, unit, phase) in enumerate(rows):
            text = lambda x: "NULL" if x is None else f"'{x}'"
            values.append(f"({k}, '{method}', {i}, {text(suffix)}, {text(amount)}, {text(unit)}, {text(phase)})")
    return f"""WITH v(k, method, line_no, suffix, amount, unit, phase) AS (VALUES {', '.join(values)})
SELECT p_partkey AS block_id, method, CAST(line_no AS INTEGER) AS line_no, CASE WHEN suffix IS NULL THEN 'Purified water' ELSE p_name || ' ' || suffix END AS raw_name,
       CASE amount WHEN 'a' THEN (1 + p_size % 50) + 25e-2 WHEN 'b' THEN (1 + p_partkey % 40) + 5e-1 END AS amount, unit, phase
FROM part JOIN v ON k = p_partkey % {len(LAYOUTS)}"""


@query(_layout_sql())
def q71_layouts(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part").select("p_partkey", "p_name", (F.lit(1) + F.col("p_size") % 50).alias("a"), (F.lit(1) + F.col("p_partkey") % 40).alias("b"))
    layout = F.element_at(F.array(*[F.lit(t) for t, _ in LAYOUTS.values()]), (F.col("p_partkey") % len(LAYOUTS) + 1).cast("int"))
    text = F.replace(F.replace(F.replace(layout, F.lit("{n}"), F.col("p_name")), F.lit("{a}"), F.concat(F.col("a").cast("string"), F.lit(".25"))), F.lit("{b}"), F.concat(F.col("b").cast("string"), F.lit(".50")))
    out = recipes.parse_blocks(part.select(F.col("p_partkey").alias("block_id"), text.alias("text")))
    return out.select("block_id", "method", "line_no", "raw_name", "amount", "unit", "phase")


@query("SELECT 'r' || p_partkey AS id, 2 AS n, '[\"Heat ' || p_name || ' to 70 C\",\"Stir in ' || p_name || '\"]' AS steps FROM part")
def q72_procedure(spark: SparkSession, d: str) -> DataFrame:
    """Numbered steps after the heading of each part's made-up text."""
    rows = read(spark, d, "part").select(F.concat(F.lit("r"), "p_partkey").alias("id"), F.concat(F.lit("Wax 3\nProcedure:\n1. Heat "), "p_name", F.lit(" to 70 C\n2) Stir in "), "p_name", F.lit("\n")).alias("text"))
    steps = F.pandas_udf(lambda texts: texts.map(recipes.procedure), "array<string>")
    return rows.select("id", steps("text").alias("s")).select("id", F.size("s").alias("n"), F.to_json("s").alias("steps"))


# Sources


@query(r"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(text, '[ \t\x{00A0}]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), E' \t\n\r\x0b\x0c')) AS page_hash FROM documents")
def q73_page_text(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.sha2(T.page_text(F.col("text")).cast("binary"), 256).alias("page_hash"))


@query("SELECT p_partkey AS id, trim(regexp_replace(lower(p_brand || ' ' || p_name), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part")
def q74_slug(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), T.slug(F.concat(F.lit("/books/"), "p_brand", F.lit(" "), "p_name", F.lit(".pdf"))).alias("slug"))


@query("""WITH r AS (SELECT p_partkey AS pos, lower(p_name) AS ingredient, p_retailprice AS price FROM part WHERE p_partkey % 3 <> 0)
SELECT ingredient, price FROM (SELECT *, row_number() OVER (PARTITION BY ingredient ORDER BY pos DESC) AS n FROM r) WHERE n = 1""")
def q75_price_table(spark: SparkSession, d: str) -> DataFrame:
    raw = read(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.concat(F.lit(" "), "p_name").alias("name"), F.when(F.col("p_partkey") % 3 == 0, F.lit("n/a")).otherwise(F.col("p_retailprice").cast("string")).alias("price"))
    return analytics.price_table(raw).select("ingredient", "price")


@query("""SELECT doc_id, max(n_chars) AS n_chars, max(version) AS version FROM (SELECT doc_id, n_chars, 1 AS version FROM documents WHERE doc_id % 3 <> 1 UNION ALL SELECT doc_id, n_chars, 2 FROM documents WHERE doc_id % 2 = 0)
WHERE doc_id % 5 <> 0 GROUP BY 1""")
def q76_stored_table(spark: SparkSession, d: str) -> DataFrame:
    """Two upserts and a delete of a stored table, read back."""
    docs = read(spark, d, "documents").select("doc_id", "n_chars")
    store = tables.Table(spark, new_path(spark, "table"), "doc_id long, n_chars long, version int", ["doc_id"])
    store.upsert(docs.filter("doc_id % 3 <> 1").selectExpr("doc_id", "CAST(n_chars AS LONG) AS n_chars", "1 AS version"))
    store.upsert(docs.filter("doc_id % 2 = 0").selectExpr("doc_id", "CAST(n_chars AS LONG) AS n_chars", "2 AS version"))
    store.delete(docs.filter("doc_id % 5 = 0").select("doc_id"))
    return store.read()


@query(f"""WITH {LINES}, r AS (SELECT formulation_id, line_no, raw_name, min('| ' || raw_name || ' | ' || CAST(CAST(amount AS BIGINT) AS VARCHAR) || ' | ' || unit || ' |') AS x FROM l GROUP BY ALL)
SELECT formulation_id, '| Ingredient | Amount | Unit |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg(x, chr(10) ORDER BY line_no, x) AS text FROM r GROUP BY 1""")
def q77_markdown(spark: SparkSession, d: str) -> DataFrame:
    lines = lines_of(spark, d).withColumn("amount", F.col("amount").cast("long"))
    row = F.concat(F.lit("| "), "raw_name", F.lit(" | "), F.col("amount").cast("string"), F.lit(" | "), "unit", F.lit(" |"))  # of lines with one number and name, the first
    lines = lines.groupBy("formulation_id", "line_no", "raw_name").agg(F.min(F.struct(row.alias("k"), "amount", "unit")).alias("x")).select("formulation_id", "line_no", "raw_name", "x.amount", "x.unit")
    return tables.markdown(lines)


@query("""SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'Use 2% ' || p_name || ' [S1].' WHEN 1 THEN 'Plain words on ' || p_name WHEN 2 THEN '{"text": "' || p_name || '"}' WHEN 3 THEN p_name WHEN 4 THEN '' END AS answer,
       CASE WHEN p_partkey % 5 = 0 THEN 'quote of ' || p_name || ':high' WHEN p_partkey % 5 = 3 THEN p_name || ':low' ELSE '' END AS citations, CASE WHEN p_partkey % 5 = 0 THEN p_name || ':5.0%' ELSE '' END AS lines FROM part""")
def q78_model_output(spark: SparkSession, d: str) -> DataFrame:
    """What is read from a model's output: fenced, plain, without an answer, within prose, empty."""
    n = F.col("p_name")
    raw = F.element_at(F.array(
        F.concat(F.lit('```json\n{"answer": "Use 2% '), n, F.lit(' [S1].", "citations": [{"source_index": 1, "quote": "quote of '), n, F.lit('", "confidence": "HIGH"}, {"source_index": 2, "quote": " "}, {"quote": "x"}], "formula_lines": [{"ingredient": "'), n, F.lit('", "percentage": "5.0%", "source_index": 1}, {"ingredient": ""}]}\n```')),
        F.concat(F.lit(" Plain words on "), n), F.concat(F.lit('{"text": "'), n, F.lit('"}')),
        F.concat(F.lit('Here it is: {"answer": "'), n, F.lit('", "citations": [{"source_index": "3", "quote": "'), n, F.lit('", "confidence": "sure"}]} thanks')), F.lit(""),
    ), (F.col("p_partkey") % 5 + 1).cast("int"))
    out = read(spark, d, "part").select(F.col("p_partkey").alias("id"), answers.model_output(raw).alias("x"))
    return out.select(
        "id", "x.answer",
        F.array_join(F.transform("x.citations", lambda c: F.concat_ws(":", c["quote"], c["confidence"])), ",").alias("citations"),
        F.array_join(F.transform("x.formula_lines", lambda c: F.concat_ws(":", c["ingredient"], c["percentage"])), ",").alias("lines"),
    )


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN page_id % 900 + 1 WHEN 1 THEN page_id % 90 + 1 WHEN 2 THEN 7 END AS printed_page FROM pages")
def q79_printed_page(spark: SparkSession, d: str) -> DataFrame:
    """The page number printed at the head or foot of made-up pages around each page's text."""
    k = F.col("page_id")
    body = F.concat(F.lit("\n"), F.regexp_replace("html", r"\n", " "), F.lit(" 12 of 34 and more words than a margin has\n"))
    text = F.when(k % 4 == 0, F.concat(F.lit("Cosmetic Formulas"), body, (k % 900 + 1).cast("string"))).when(k % 4 == 1, F.concat(F.lit("Page "), (k % 90 + 1).cast("string"), body, F.lit("end"))).when(k % 4 == 2, F.concat(F.lit("- 7 -"), body, F.lit("7 / 90"))).otherwise(F.concat(F.lit("Preface"), body, F.lit("end")))
    return read(spark, d, "pages").select("page_id", T.printed_page(text).alias("printed_page"))


# Names and reports


@query("""WITH a AS (SELECT p_partkey AS id, lower(p_name) AS canonical_name, p_size / 50e0 AS confidence, 'rules' AS source FROM part WHERE p_partkey % 4 > 0 UNION ALL SELECT p_partkey, 'thing ' || p_brand, 9e-1, 'rules' FROM part WHERE p_size > 40)
SELECT DISTINCT coalesce(x, lower(p_name)) AS name FROM part LEFT JOIN (SELECT id, lower(arg_min(canonical_name, (-confidence, canonical_name))) AS x FROM a GROUP BY id) ON id = p_partkey""")
def q80_inventory_names(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part")
    one = part.filter("p_partkey % 4 > 0").select(F.col("p_partkey").alias("material_id"), F.lower("p_name").alias("canonical_name"), (F.col("p_size") / 50).alias("confidence"))
    two = part.filter("p_size > 40").select(F.col("p_partkey").alias("material_id"), F.concat(F.lit("thing "), "p_brand").alias("canonical_name"), F.lit(0.9).alias("confidence"))
    return warehouse.inventory(part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("raw_name")), one.unionByName(two))


@query("SELECT count(*) FILTER (p_partkey % 4 > 0 AND p_size / 50e0 >= 7e-1) AS resolved, count(*) FILTER (NOT (p_partkey % 4 > 0 AND p_size / 50e0 >= 7e-1)) AS needs_review FROM part")
def q81_resolve_totals(spark: SparkSession, d: str) -> DataFrame:
    return names.resolve_totals(read(spark, d, "part").select(F.when(F.col("p_partkey") % 4 > 0, F.col("p_name")).alias("canonical_name"), (F.col("p_size") / 50).alias("confidence")))


@query("SELECT count(*) FILTER (page_id % 5 > 1) AS documents_with_ocr, CAST(coalesce(sum(page_id % 5 - 1) FILTER (page_id % 5 > 1), 0) AS BIGINT) AS total_ocr_pages FROM pages")
def q82_ocr_summary(spark: SparkSession, d: str) -> DataFrame:
    return names.ocr_summary(read(spark, d, "pages").select((F.col("page_id") % 5 - 1).alias("ocr_pages_count")))


@query(f"""WITH {LINES} SELECT normalized_name, arg_min(raw_name, (formulation_id, line_no, raw_name)) AS raw_name FROM l GROUP BY 1""")
def q83_corpus_names(spark: SparkSession, d: str) -> DataFrame:
    return names.corpus_names(lines_of(spark, d))


@query(f"SELECT coalesce(CASE role WHEN 'user' THEN 'lookup' WHEN 'assistant' THEN 'compare' END, 'unknown') AS route, count(*) AS n, {_round('avg(CAST(length(text) % 11 AS DOUBLE))', 6)} AS mean, count(*) FILTER (length(text) % 11 > 5) AS passed FROM conversations GROUP BY 1")
def q84_by_route(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "conversations").select(F.when(F.col("role") == "user", "lookup").when(F.col("role") == "assistant", "compare").alias("route"), (F.char_length("text") % 11).cast("double").alias("score"))
    return names.by_route(own.withColumn("pass", F.col("score") > 5)).withColumn("mean", bounded(F.col("mean"), 6))


@query(f"""WITH c AS (SELECT CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS cost, CAST(o_orderkey % 101 AS DOUBLE) AS covered FROM orders),
p AS (SELECT covered, cost, row_number() OVER (ORDER BY covered) AS r, count(*) OVER () AS n FROM c WHERE cost IS NOT NULL)
SELECT (SELECT count(*) FROM p) AS priced, (SELECT {_round('avg(cost)', 4)} FROM p) AS mean_cost_per_kg, (SELECT max(covered) FROM p WHERE r = n // 2 + 1) AS median_coverage, (SELECT count(*) FROM c) AS sampled, {_round('(SELECT count(*) FROM p) / CAST((SELECT count(*) FROM c) AS DOUBLE)', 6)} AS share_priced""")
def q85_price_sample(spark: SparkSession, d: str) -> DataFrame:
    costs = read(spark, d, "orders").select(F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice")).alias("cost_per_kg"), (F.col("o_orderkey") % 101).cast("double").alias("covered_percent"))
    return names.price_sample(costs).withColumns({"mean_cost_per_kg": bounded(F.col("mean_cost_per_kg"), 4), "share_priced": bounded(F.col("share_priced"), 6)})


@query(f"SELECT p_partkey AS id, {_round('p_size / 50e0 + 2e-1 * (p_partkey % 4) + 6e-2 * least(p_size, 24)', 6)} AS relevance, {_round('CASE WHEN abs(floor((4e-1 * p_size / 50e0 + 6e-1 * (p_partkey % 7) / 7e0) * 1e4 + 5e-1) / 1e4 - p_size / 50e0) >= 5e-3 THEN floor((4e-1 * p_size / 50e0 + 6e-1 * (p_partkey % 7) / 7e0) * 1e4 + 5e-1) / 1e4 ELSE p_size / 50e0 END', 4)} AS rescored FROM part")
def q86_relevance(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 50).alias("c"), (F.col("p_partkey") % 4).alias("points"), (F.col("p_partkey") % 7 / 7).alias("precision"), "p_size")
    return part.select("id", bounded(names.relevance(F.col("c"), F.col("points"), F.col("p_size")), 6).alias("relevance"), bounded(rules.rescored(F.col("c"), F.col("precision")), 4).alias("rescored"))


# Questions


_QUESTION = ["'give me a baby shampoo with ' || p_name", "'compare a lotion and a cream of ' || p_name", "'why is ' || p_name || ' used'", "'is this ' || p_name || ' suitable for skin'", "'what is the best ' || p_name", "'hello ' || p_name", "'toner recipe with ' || p_name"]


def _question(x: str) -> str:
    return f"CASE p_partkey % {len(_QUESTION)} " + " ".join(f"WHEN {k} THEN {q}" for k, q in enumerate(_QUESTION)) + f" END {x}"


def _route_sql() -> str:
    sign = lambda k: f"regexp_matches(q, '{intent.SIGNS[k]}')"
    types = " || ".join(f"CASE WHEN regexp_matches(q, '{p}') THEN '{t},' ELSE '' END" for t, p in intent.QUESTION_TYPES if t != "gel")
    return f"""WITH q AS (SELECT p_partkey AS id, {_question('AS q')} FROM part), t AS (SELECT *, {types} AS types FROM q)
SELECT id, CASE WHEN {sign('role')} OR ({sign('advice')} AND NOT {sign('lookup')}) OR ({sign('reasoning')} AND NOT {sign('compare')}) THEN 'reasoning' WHEN {sign('compare')} THEN 'compare' WHEN {sign('best')} THEN 'unknown'
       WHEN {sign('formula')} OR types <> '' OR {sign('lookup')} THEN 'lookup' WHEN {sign('open')} THEN 'reasoning' ELSE 'unknown' END AS route, trim(types, ',') AS types FROM t"""


@query(_route_sql())
def q87_routes(spark: SparkSession, d: str) -> DataFrame:
    """Routes and types of made-up questions; none names a gel, whose pattern looks behind, which the SQL cannot."""
    asked = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr(_question("")).alias("text"))
    return intent.classified(asked).select("id", "route", F.array_join("product_types", ",").alias("types"))


@query("""SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F' AND (o_orderkey % 10 = 0 OR o_totalprice <= 11e4) AND NOT EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey AND (contains(lower(p_name), 'bolt') OR contains('bolt', lower(p_name))))""")
def q88_brief_filter(spark: SparkSession, d: str) -> DataFrame:
    held = lines_of(spark, d).groupBy(F.col("formulation_id").alias("id")).agg(F.collect_set("normalized_name").alias("names"))
    rows = formulations_of(spark, d).join(held, "id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    rows = rows.withColumns({"compliance": F.when(F.col("status") == "F", "fail").otherwise("pass"), "cost_per_kg": F.when(F.col("id") % 10 != 0, F.col("confidence"))})
    return ranking.brief_filter(rows, intent.Brief(banned=("bolt",), markets=("EU",), cost_target=1e5)).select("id")


@query(f"""WITH {LINES}, f AS (SELECT o_orderkey AS id, o_custkey, o_totalprice, o_orderstatus, (SELECT list(DISTINCT normalized_name) FROM l WHERE formulation_id = o_orderkey) AS ns FROM orders),
s AS (SELECT id, least(len(coalesce(ns, [])), 15) / 15e0 * 20 AS completeness, CASE WHEN starts_with(CAST(o_custkey AS VARCHAR), '1') THEN 10e0 ELSE 5e0 END AS source,
  least(24e0, CASE WHEN len(list_filter(coalesce(ns, []), lambda x: contains(x, 'gizmo'))) > 0 THEN 8e0 ELSE 0e0 END + CASE WHEN len(list_filter(coalesce(ns, []), lambda x: contains(x, 'ring'))) > 0 THEN 8e0 ELSE 0e0 END) AS preferred,
  CASE WHEN o_totalprice <= 1e5 THEN 8e0 WHEN o_totalprice <= 11e4 THEN 2e0 ELSE -15e0 END AS cost, CASE o_orderstatus WHEN 'F' THEN -100e0 WHEN 'P' THEN -12e0 ELSE 4e0 END AS compliance FROM f)
SELECT id, {_round('least(100e0, greatest(0e0, 20 + completeness + source + preferred + cost + compliance))', 4)} AS score, cost, preferred FROM s""")
def q89_structured_score(spark: SparkSession, d: str) -> DataFrame:
    held = lines_of(spark, d).groupBy(F.col("formulation_id").alias("id")).agg(F.collect_set("normalized_name").alias("names"))
    rows = formulations_of(spark, d).join(held, "id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    rows = rows.withColumns({
        "compliance": F.when(F.col("status") == "F", "fail").when(F.col("status") == "P", "warn").otherwise("pass"), "cost_per_kg": F.col("confidence"), "product_types": F.array().cast("array<string>"),
        "source_text": F.lit(""), "ingredients": F.transform("names", lambda x: F.struct(x.alias("raw_name"), x.alias("normalized_name"))),
    })
    out = ranking.scored(rows, [], brief=intent.Brief(preferred=("gizmo", "ring"), markets=("EU",), cost_target=1e5), trusted=("1",))
    return out.select("id", bounded(F.col("score"), 4).alias("score"), F.col("breakdown")["cost_target"].alias("cost"), F.col("breakdown")["preferred_ingredients"].alias("preferred"))


# A table of questions: every benchmark item asks for a part, mostly its type, and at times a recipe by its name.

_PLAIN = ", ".join(f"'{w}'" for w in names.PLAIN_WORDS)


def _same_title_sql(a: str, b: str) -> str:
    x, y = (f"regexp_replace(lower({t}), '[^a-z0-9]', '', 'g')" for t in (a, b))
    p, q = (f"list_distinct(regexp_extract_all(lower({t}), '[a-z]{{3,}}'))" for t in (a, b))
    telling = f"list_filter({p}, lambda w: NOT list_contains([{_PLAIN}], w))"
    share, told = f"len(list_intersect({p}, {q})) / greatest(len({p}), 1)", f"len(list_intersect({telling}, {q}))"
    inside = f"((contains({x}, {y}) OR contains({y}, {x})) AND least(length({x}), length({y})) >= 12)"
    words = f"CASE WHEN len({telling}) >= 2 THEN {share} >= 7e-1 AND {told} >= 2 WHEN len({telling}) = 1 THEN {share} >= 65e-2 AND {told} >= 1 ELSE len({p}) >= 2 AND {share} = 1 END"
    return f"coalesce({x} <> '' AND {y} <> '' AND ({x} = {y} OR {inside} OR (len({p}) > 0 AND {words})), false)"


def _pool_sql(kind: str, condition: str, most: int) -> str:
    return f"SELECT query_id, id FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id, k ORDER BY confidence DESC, id) AS place FROM {kind} JOIN r ON {condition}) WHERE place <= {most}"


@query(rf"""WITH {LINES},
r AS (
    SELECT o_orderkey AS id, o_totalprice AS confidence, min(normalized_name) || ' ' || any_value(o_orderpriority) AS name, list(DISTINCT tag) AS tags, list(normalized_name) AS lines
    FROM orders JOIN l ON formulation_id = o_orderkey GROUP BY o_orderkey, o_totalprice
),
q AS (
    SELECT item_id AS query_id, b.text, lower(p_name) AS n, CASE WHEN item_id % 3 <> 0 THEN p_type END AS type, CASE WHEN item_id % 2 = 0 THEN name END AS title,
           list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]{{3,}}')) AS words
    FROM benchmark b JOIN part ON p_partkey = item_id LEFT JOIN r ON id = item_id
),
types AS (SELECT query_id, coalesce(type, '') AS k FROM q),
needles AS (
    SELECT query_id, lower(unnest(list_concat([title[1:40]], list_filter(regexp_extract_all(title, '[A-Za-z]{{4,}}'), lambda w: NOT list_contains(['cream', 'lotion', 'shampoo', 'formula'], lower(w)))[1:2]))) AS k
    FROM q WHERE title IS NOT NULL
),
firsts AS (SELECT query_id, string_split(n, ' ')[1] AS k FROM q WHERE length(string_split(n, ' ')[1]) >= 3),
laters AS (SELECT query_id, list_filter(regexp_extract_all(n, '[A-Za-z]{{4,}}'), lambda w: w <> string_split(n, ' ')[1])[1] AS k FROM q WHERE length(string_split(n, ' ')[1]) >= 3),
pool AS (
    {_pool_sql("types", "k = '' OR list_contains(tags, k)", 60)}
    UNION {_pool_sql("needles", "contains(lower(name), k)", 20)}
    UNION {_pool_sql("firsts", "len(list_filter(lines, lambda x: contains(x, k))) > 0", 30)}
    UNION {_pool_sql("laters", "len(list_filter(lines, lambda x: contains(x, k))) > 0", 20)}
),
t AS (
    SELECT q.*, r.*, {_same_title_sql("title", "name")} AS titled,
           len(list_filter(lines, lambda x: contains(x, n) OR contains(replace(x, ' ', ''), replace(n, ' ', '')) OR len(list_intersect(words, regexp_extract_all(x, '[a-z0-9]{{3,}}'))) >= 75e-2 * len(words))) > 0
           OR CASE WHEN len(words) >= 2 THEN len(list_filter(words, lambda w: contains(lower(name), w))) >= greatest(2, len(words) - 1) ELSE contains(lower(name), n) AND length(n) >= 5 END AS has
    FROM pool JOIN q USING (query_id) JOIN r USING (id) WHERE len(lines) >= 2
),
s AS (
    SELECT *, least(100e0, greatest(0e0, CASE WHEN type IS NULL THEN 20e0 WHEN list_contains(tags, type) THEN 40e0 ELSE 0e0 END
           + CASE WHEN regexp_matches(text, '(?i)\banti[-\s]?dandruff\b|\bantidandruff\b|\bbaby\b|\bsulfate[-\s]?free\b|\bhand\s+(and\s+)?(nail\s+)?cream\b') THEN 30e0 ELSE 0e0 END
           + least(len(list_distinct(lines)), 15) / 15e0 * 8 + 5 + CASE WHEN has THEN 45e0 ELSE -30e0 END + CASE WHEN title IS NULL THEN 0e0 WHEN titled THEN 48e0 ELSE -18e0 END)) AS score
    FROM t
),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id, lower(name)[1:80] ORDER BY score DESC, len(lines) DESC, id) AS first FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN titled AND has THEN 0 WHEN titled OR has THEN 1 ELSE 3 END, score DESC, id) AS place FROM b WHERE first = 1)
SELECT query_id, CAST(place AS INTEGER) AS place, id, {_round("score", 4)} AS score, has AND (title IS NULL OR titled) AS met FROM o WHERE place <= 5""")
def q105_question_search(spark: SparkSession, d: str) -> DataFrame:
    lines, none = lines_of(spark, d), F.array().cast("array<string>")
    held = lines.groupBy(F.col("formulation_id").alias("id")).agg(
        F.min("normalized_name").alias("least"), F.collect_set("tag").alias("product_types"), F.collect_set("normalized_name").alias("names"), F.collect_list(F.struct("raw_name", "normalized_name")).alias("ingredients"))
    recipes = formulations_of(spark, d).join(held, "id").withColumns({"name": F.concat("least", F.lit(" "), "name"), "source_text": F.lit("")}).drop("least", "status")
    part = read(spark, d, "part").select(F.col("p_partkey").alias("query_id"), "p_name", "p_type")
    asked = read(spark, d, "benchmark").withColumnRenamed("item_id", "query_id").join(part, "query_id").join(recipes.select(F.col("id").alias("query_id"), "name"), "query_id", "left")
    some = lambda c, use: F.when(use, F.array(c)).otherwise(none)
    asked = asked.select("query_id", "text", some("p_type", F.col("query_id") % 3 != 0).alias("types"), F.array("p_name").alias("required"), some("name", (F.col("query_id") % 2 == 0) & F.col("name").isNotNull()).alias("titles"))
    return question_search.search(asked, recipes).select("query_id", "place", "id", bounded(F.col("score"), 4).alias("score"), "met")


# Retrieval


@query(f"""WITH h AS (SELECT source AS query_id, doc_id, n_chars / 1e5 AS score, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) - 1 AS pos, 1 / (1 + exp(-(doc_id % 13 - 6e0))) AS cross_score FROM documents),
n AS (SELECT *, {_round('72e-2 * cross_score + 18e-2 * score + 1e-1 * least(doc_id % 3, 1)', 6)} AS blended FROM h),
r AS (SELECT query_id, doc_id, CASE WHEN pos < 40 THEN blended ELSE {_round('score', 6)} END AS score, pos AS old, pos < 40 AS inside FROM n)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY inside DESC, CASE WHEN inside THEN score END DESC, old, doc_id) - 1 AS pos FROM r""")
def q90_rerank(spark: SparkSession, d: str) -> DataFrame:
    hits = read(spark, d, "documents").select(F.col("source").alias("query_id"), "doc_id", (F.col("n_chars") / 1e5).alias("score"), "n_chars")
    hits = hits.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n_chars"), "doc_id")) - 1)
    new = retrieval.blend(retrieval.sigmoid(F.col("doc_id") % 13 - F.lit(6.0)), F.col("score"), F.col("doc_id") % 3)
    out = retrieval.rerank(hits, bounded(new, 6), "doc_id")
    return out.select("query_id", "doc_id", bounded(F.col("score"), 6).alias("score"), F.col("pos").cast("long").alias("pos"))


@query("""WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ['baby', 'shampoo'] WHEN 1 THEN ['baby'] WHEN 2 THEN ['anti_dandruff', 'shampoo'] ELSE [] END AS tags FROM documents)
SELECT doc_id, CASE WHEN len(tags) = 0 THEN 0e0 ELSE floor((18e-2 * len(list_intersect(tags, ['baby', 'shampoo'])) - 1e-1 * (2 - len(list_intersect(tags, ['baby', 'shampoo']))) - CASE WHEN list_contains(tags, 'baby') AND NOT list_contains(tags, 'shampoo') THEN 15e-2 ELSE 0e0 END) * 1e6 + 5e-1) / 1e6 END AS baby,
       CASE WHEN len(tags) = 0 THEN 0e0 ELSE floor((18e-2 * len(list_intersect(tags, ['anti_dandruff'])) - 22e-2 * (1 - len(list_intersect(tags, ['anti_dandruff'])))) * 1e6 + 5e-1) / 1e6 END AS dandruff FROM t""")
def q91_type_boost(spark: SparkSession, d: str) -> DataFrame:
    k, tags = F.col("doc_id") % 4, lambda *x: F.array(*map(F.lit, x))
    own = read(spark, d, "documents").select("doc_id", F.when(k == 0, tags("baby", "shampoo")).when(k == 1, tags("baby")).when(k == 2, tags("anti_dandruff", "shampoo")).otherwise(F.array().cast("array<string>")).alias("tags"))
    boost = lambda need: bounded(retrieval.type_boost(F.col("tags"), need), 6)
    return own.select("doc_id", boost(["baby", "shampoo"]).alias("baby"), boost(["anti_dandruff"]).alias("dandruff"))


def _phrase_sql() -> str:
    case = "CASE " + " ".join(f"WHEN contains(q, '{needle}') AND regexp_matches(t, '{p}') THEN {amount}" for needle, p, amount in retrieval.PHRASES) + " ELSE 0e0 END"
    return f"""WITH x AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'a baby shampoo' WHEN 1 THEN 'hand cream' WHEN 2 THEN 'some toner' WHEN 3 THEN 'shaving cream' WHEN 4 THEN 'leave-in' ELSE 'a soap' END AS q,
  CASE p_partkey % 3 WHEN 0 THEN 'a baby  shampoo formula with 5 % water' WHEN 1 THEN 'hand and nail cream, toner, leave in' ELSE 'starting formula of shaving cream and a toner' END AS t FROM part)
SELECT id, {_round(f"({case}) * CASE WHEN contains(t, '%') THEN 1e0 ELSE 4e-1 END * CASE WHEN contains(t, 'starting formula') THEN 0e0 ELSE 1e0 END - CASE WHEN contains(t, 'starting formula') AND ({case}) > 0 THEN 12e-2 ELSE 0e0 END", 6)} AS boost FROM x"""


@query(_phrase_sql())
def q92_phrase_boost(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    q = F.element_at(F.array(*map(F.lit, ["a baby shampoo", "hand cream", "some toner", "shaving cream", "leave-in", "a soap"])), (k % 6 + 1).cast("int"))
    t = F.element_at(F.array(*map(F.lit, ["a baby  shampoo formula with 5 % water", "hand and nail cream, toner, leave in", "starting formula of shaving cream and a toner"])), (k % 3 + 1).cast("int"))
    return read(spark, d, "part").select(k.alias("id"), bounded(retrieval.phrase_boost(q, t), 6).alias("boost"))


_TEXTS = ["a baby shampoo formula with 5 % water", "a lotion of oil", "hand and nail cream, an emollient", "shampoo formula 12 %", "lipstick and toner", "antiperspirant formula with 3 % salt"]
_ASKS = [("['baby', 'shampoo']", "a baby shampoo"), ("['cream']", "a hand cream"), ("['anti_dandruff', 'shampoo']", "anti-dandruff shampoo"), ("['toner']", "some toner"), ("['deodorant', 'makeup']", "a deodorant")]


def _text_boost_sql() -> str:
    has = lambda p: f"regexp_matches(t, '{p}')"
    wants = lambda *tags: f"list_has_all(types, [{', '.join(repr(x) for x in tags)}])"
    worth = lambda whole, prose: f"CASE WHEN formula THEN {whole} ELSE {prose} END"
    pattern = dict(retrieval.TEXT_TYPES)
    parts = [f"CASE WHEN ({wants(tag)} OR contains(q, '{tag.replace('_', ' ')}')) AND {has(p)} THEN {worth(0.22, 0.10)} WHEN {wants(tag)} AND NOT {has(p)} THEN {-0.04 if tag in retrieval.RARE_TYPES else -0.12} ELSE 0 END" for tag, p in retrieval.TEXT_TYPES]
    parts.append(f"CASE WHEN NOT {wants('anti_dandruff')} THEN 0 WHEN {has(pattern['anti_dandruff'])} THEN 0.25 WHEN formula AND contains(t, 'shampoo') AND NOT contains(t, 'dandruff') THEN -0.20 ELSE 0 END")
    parts.append(f"CASE WHEN NOT {wants('baby', 'shampoo')} THEN 0 WHEN {has('baby +shampoo')} THEN 0.22 WHEN {has('baby +bath')} AND NOT contains(t, 'shampoo') THEN -0.18 ELSE 0 END")
    parts.append(f"CASE WHEN NOT contains(q, 'hand cream') THEN 0 WHEN {has(pattern['hand_cream'])} THEN 0.22 WHEN contains(t, 'lotion') AND NOT contains(t, 'cream') THEN -0.08 ELSE 0 END")
    skin = "list_has_any(types, ['lotion', 'cream', 'moisturizer']) AND NOT list_has_any(types, ['shampoo', 'conditioner', 'anti_dandruff'])"
    parts.append(f"CASE WHEN {skin} AND {has('shampoo|condition')} THEN -0.28 ELSE 0 END + CASE WHEN {skin} AND {has('lotion|cream|emollient|moistur')} THEN {worth(0.12, 0.05)} ELSE 0 END")
    parts += [f"CASE WHEN {wants(tag)} AND {has(p)} THEN {worth(whole, prose)} ELSE 0 END" for tag, p, whole, prose in retrieval.SIGN_BOOSTS]
    types = "CASE p_partkey % 5 " + " ".join(f"WHEN {k} THEN {x}" for k, (x, _) in enumerate(_ASKS)) + " END"
    asks = "CASE p_partkey % 5 " + " ".join(f"WHEN {k} THEN '{x}'" for k, (_, x) in enumerate(_ASKS)) + " END"
    texts = "CASE p_partkey % 6 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(_TEXTS)) + " END"
    return f"WITH x AS (SELECT p_partkey AS id, {types} AS types, {asks} AS q, {texts} AS t, {texts} LIKE '% formula %' AND {texts} LIKE '%!%%' ESCAPE '!' AS formula FROM part) SELECT id, {_round(f'CAST({chr(43).join(parts)} AS DOUBLE)', 6)} AS boost FROM x"


@query(_text_boost_sql())
def q103_text_boost(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda values, n: F.element_at(F.array(*values), (k % n + 1).cast("int"))
    types = [F.array(*map(F.lit, x.strip("[]").replace("'", "").split(", "))) for x, _ in _ASKS]
    boost = retrieval.text_boost(pick(types, 5), pick([F.lit(q) for _, q in _ASKS], 5), pick([F.lit(t) for t in _TEXTS], 6))
    return read(spark, d, "part").select(k.alias("id"), bounded(boost, 6).alias("boost"))


@query(f"""WITH {_BM25.replace("1e4", "1e6")},
qv AS (SELECT item_id AS query_id, b.text, embedding AS v FROM benchmark b JOIN embeddings ON vec_id = item_id),
cs AS (SELECT query_id, vec_id AS id, {_round(f"{_dot('e.embedding', 'v')} / sqrt({_dot('e.embedding', 'e.embedding')}) / sqrt({_dot('v', 'v')})", 6)} AS score FROM embeddings e, qv),
ds AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS pos FROM cs),
u AS (SELECT query_id, id, pos FROM ds WHERE pos < 50 UNION ALL SELECT query_id, doc_id, pos FROM bm WHERE pos < 40 AND query_id IN (SELECT query_id FROM qv)),
fu AS (SELECT query_id, id, sum(1e0 / (61 + pos)) AS s FROM u GROUP BY ALL),
nu AS (SELECT query_id, id, {_round("s / max(s) OVER (PARTITION BY query_id)", 6)} AS score FROM fu),
ru AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS pos FROM nu),
w AS (SELECT query_id, doc_id, {_round("score + boost", 6)} AS score, pos FROM ru JOIN ({_boost_sql()}) ON doc_id = id)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos, doc_id) - 1 AS pos FROM w QUALIFY pos < 10""".replace("QUALIFY pos < 10", "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos, doc_id) <= 10"))
def q104_hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as questions, with the vectors of their numbers, against documents and all vectors."""
    docs, vectors = read(spark, d, "documents"), read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    items = read(spark, d, "benchmark").join(vectors, F.col("item_id") == F.col("doc_id"))
    asked = items.select(F.col("item_id").alias("query_id"), "text", F.col("embedding").alias("vector"), F.array().cast("array<string>").alias("product_types"))
    chunks = docs.select("doc_id", "text", F.array().cast("array<string>").alias("tags"))
    return retrieval.hybrid_search(chunks, vectors, asked).withColumn("pos", F.col("pos").cast("long"))


# The stored collection of vectors


def _collection(spark: SparkSession, d: str) -> tuple[VectorCollection, DataFrame]:
    """All vectors, in two upserts of which the second replaces every seventh; and the stated query set."""
    rows = read(spark, d, "embeddings")
    size = rows.agg(F.max(F.size("embedding"))).first()[0] or 1
    out = VectorCollection(spark, new_path(spark, "collection"), size, payload="label int")
    out.upsert(rows.withColumn("embedding", F.when(F.col("vec_id") % 7 == 0, F.transform("embedding", lambda x: -x)).otherwise(F.col("embedding"))))
    out.upsert(rows.filter("vec_id % 7 = 0"))
    return out, rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query(f"""WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 20 = 0),
c AS (SELECT query_id, vec_id, {_round(f"{_dot('embedding', 'v')} / sqrt({_dot('embedding', 'embedding')}) / sqrt({_dot('v', 'v')})", 6)} AS score FROM embeddings, q WHERE label <> 3 AND (label < 6 OR vec_id % 2 = 0))
SELECT query_id, vec_id, score, pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS pos FROM c) WHERE pos < 10""")
def q107_vector_collection(spark: SparkSession, d: str) -> DataFrame:
    """First rows under must and should conditions from a stored collection, all cells probed."""
    it, asked = _collection(spark, d)
    out = it.search(asked, 10, None, must=[F.col("label") != 3], should=[F.col("label") < 6, F.col("vec_id") % 2 == 0])
    return out.withColumn("pos", F.col("pos").cast("long"))


@query(None)
def q108_vector_recall(spark: SparkSession, d: str) -> DataFrame:
    """How many of each query's exact first ten rows a search finds, with as many cells as stored vectors ask for."""
    it, asked = _collection(spark, d)
    return it.recall(asked, 10, it.probes_for(0.95))


# The store of recipes with children


@query(f"""WITH {LINES}, k AS (SELECT * FROM l WHERE formulation_id % 3 <> 0 OR line_no % 2 = 1)
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'again' ELSE o_orderpriority END AS name, CASE WHEN o_orderkey % 5 = 0 THEN 0e0 ELSE o_totalprice END AS confidence,
       count(raw_name) AS n, coalesce(sum(amount), 0e0) AS amount, o_orderkey % 5 = 0 AND count(raw_name) = 0 AS empty
FROM orders LEFT JOIN k ON formulation_id = o_orderkey WHERE o_orderkey % 11 <> 0 GROUP BY o_orderkey, o_orderpriority, o_totalprice""")
def q109_recipe_store(spark: SparkSession, d: str) -> DataFrame:
    """Recipes and lines after an upsert of all, one that replaces every third, a deletion, and a validated patch."""
    store = RecipeStore(spark, new_path(spark, "recipes"), "id long, name string, confidence double", {"lines": "formulation_id long, line_no int, raw_name string, amount double", "findings": "formulation_id long, rule_id string"}, buckets=16)
    forms, lines = formulations_of(spark, d), lines_of(spark, d)
    store.upsert(forms, lines=lines)
    store.upsert(forms.filter("id % 3 = 0").withColumn("name", F.lit("again")), lines=lines.filter("line_no % 2 = 1"))
    store.delete(forms.filter("id % 11 = 0"))
    empty = lambda r, c: r.join(c["lines"], F.col("id") == F.col("formulation_id"), "left_anti").select(F.col("id").alias("formulation_id"), F.lit("no-lines").alias("rule_id"))
    store.patch(forms.filter("id % 5 = 0").select("id", F.lit(0.0).alias("confidence")), empty, "findings")
    now = store.snapshot()
    sums = now["lines"].groupBy(F.col("formulation_id").alias("id")).agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))
    found = now["findings"].select(F.col("formulation_id").alias("id"), F.lit(True).alias("empty"))
    return now["recipes"].join(sums, "id", "left").join(found, "id", "left").fillna(0, ["n", "amount"]).fillna(False, ["empty"])


# Calls by content


def _spaces(most: int | None):
    """Stands for a model: the number of spaces, and no answer to a batch with a longer text than ``most``."""

    def call(texts: list[str]) -> list[str]:
        if most is not None and max(map(len, texts)) > most:
            raise ValueError("too long")
        return [str(t.count(" ")) for t in texts]

    return call


@query("""SELECT doc_id, CAST(length(text) - length(replace(text, ' ', '')) AS VARCHAR) AS reply FROM documents""")
def q110_calls(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct text is sent once; batches that fail in the first run are sent again in the second."""
    docs, calls = read(spark, d, "documents").select("doc_id", "text"), CallTable(spark, new_path(spark, "calls"), "spaces")
    for most in (2000, None):
        calls.run(docs, _spaces(most), prompt="text")
    return calls.answered(docs, "text").select("doc_id", "reply")


# Rules with a source text


@query(f"""WITH {LINES}, s AS (SELECT l.*, 'Formula of ' || (SELECT min(raw_name) FROM l k WHERE k.formulation_id = l.formulation_id) || ' 12.50 g' AS src FROM l)
SELECT formulation_id, 'fidelity.name-in-source' AS rule_id, count(*) AS n FROM s
WHERE NOT contains(lower(src), list_aggregate(list_transform(list_filter(regexp_extract_all(lower(raw_name), '[a-z0-9]+'), lambda w: length(w) = list_max(list_transform(regexp_extract_all(lower(raw_name), '[a-z0-9]+'), lambda v: length(v)))), lambda w: w), 'first')) GROUP BY 1
UNION ALL SELECT formulation_id, 'fidelity.amount-verbatim', count(*) FROM s WHERE amount <> 125e-1 GROUP BY 1""")
def q93_source_rules(spark: SparkSession, d: str) -> DataFrame:
    lines = lines_of(spark, d)
    items = F.collect_list(F.struct("raw_name", "normalized_name", "amount", "unit", F.lit(None).cast("string").alias("phase")))
    rows = lines.groupBy(F.col("formulation_id").alias("id")).agg(items.alias("ingredients"), F.concat(F.lit("Formula of "), F.min("raw_name"), F.lit(" 12.50 g")).alias("source_text"))
    rows = rows.withColumns({"name": F.lit("Formula"), "vector_text": F.lit(None).cast("string"), "extraction_method": F.lit("table"), "chunk_texts": F.lit(None).cast("array<string>")})
    found = rules.findings(rules.facts(rows), [rules.name_in_source, rules.amount_verbatim])
    return found.groupBy("formulation_id", "rule_id").agg(F.count("*").alias("n"))


@query("""WITH h AS (SELECT source AS query_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) - 1 AS pos, n_chars, lang, text FROM documents)
SELECT query_id, count(*) FILTER (n_chars % 2 = 0) >= 2 AND max(n_chars / 1e6) >= 2e-2 AND bool_or(lang IN ('de', 'en')) AND NOT bool_or(contains(lower(text), 'idiot')) AS passed FROM h WHERE pos < 10 GROUP BY 1""")
def q94_expectations(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    hits = docs.select(F.col("source").alias("query_id"), "doc_id", "n_chars", "lang", "text").withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n_chars"), "doc_id")) - 1)
    hits = hits.select("query_id", "pos", (F.col("n_chars") / 1e6).alias("score"), (F.col("n_chars") % 2 == 0).alias("is_formula"), F.array("lang").alias("tags"), "text")
    spec = docs.select(F.col("source").alias("query_id")).distinct().selectExpr("query_id", "10 AS top_k", "2 AS min_formula", "array('de', 'en') AS any_types", "CAST(array() AS array<string>) AS all_types", "0.02D AS min_top_score", "CAST(NULL AS string) AS must_match", "'IDIOT' AS must_not_contain")
    return evaluate.expectations(hits, spec)


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'patched' ELSE o_orderpriority END AS name, o_totalprice AS confidence FROM orders""")
def q95_patch(spark: SparkSession, d: str) -> DataFrame:
    rows = formulations_of(spark, d).select("id", "name", "confidence")
    changes = rows.filter("id % 3 = 0").select("id", F.lit("patched").alias("name"), F.lit(None).cast("double").alias("confidence"))
    return catalog.patch(rows, changes, "id")


@query("""WITH u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY 1)
SELECT conv_id, turn FROM a QUALIFY row_number() OVER (ORDER BY turn DESC, conv_id) <= 30""")
def q96_threads(spark: SparkSession, d: str) -> DataFrame:
    """Threads by their latest message, the first thirty."""
    return conversations.latest_message(read(spark, d, "conversations")).orderBy(F.desc("turn"), "conv_id").limit(30).select("conv_id", "turn")


# Sources, substitution, regulation and routing


@query("""WITH d AS (SELECT trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') || '_' || p_partkey AS doc_id, p_partkey FROM part WHERE p_partkey % 2 = 0),
a AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN p_name || ' ' || p_partkey WHEN 2 THEN upper(p_name) || '_' || p_partkey ELSE p_name || '_' || p_partkey || '_tail' END AS asked, p_partkey FROM part),
s AS (SELECT asked, trim(regexp_replace(lower(trim(asked)), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM a),
x AS (SELECT s.asked, d.doc_id, s.slug FROM s JOIN d ON s.slug = d.doc_id),
n AS (SELECT s.asked, min(d.doc_id) AS doc_id FROM s JOIN d ON starts_with(d.doc_id, s.slug) OR starts_with(s.slug, d.doc_id) WHERE s.asked NOT IN (SELECT asked FROM x) GROUP BY 1)
SELECT asked, doc_id FROM x UNION ALL SELECT asked, doc_id FROM n""")
def q97_resolve_sources(spark: SparkSession, d: str) -> DataFrame:
    part, k = read(spark, d, "part"), F.col("p_partkey")
    known = part.filter("p_partkey % 2 = 0").select(F.concat(T.slug(F.concat("p_name", F.lit(".pdf"))), F.lit("_"), k).alias("doc_id"))
    asked = part.select(F.when(k % 4 == 0, F.concat("p_name", F.lit(" "), k)).when(k % 4 == 2, F.concat(F.upper("p_name"), F.lit("_"), k)).otherwise(F.concat("p_name", F.lit("_"), k, F.lit("_tail"))).alias("asked"))
    return tables.resolve_sources(asked, known)


_REGULATED = [("hot anvil", [], "EU", "prohibited", None, "annex 2"), ("red", ["blue bolt"], "EU", "restricted", 30.0, "annex 3"), ("cold ring", [], "JP", "prohibited", None, "law")]


@query(f"""WITH {LINES}, r(term, status) AS (VALUES ('hot anvil', 'prohibited'), ('red', 'restricted'), ('blue bolt', 'restricted'))
SELECT formulation_id, 'regulatory.' || status AS rule_id, CASE status WHEN 'prohibited' THEN 'error' ELSE 'warning' END AS severity, raw_name AS ingredient, count(*) AS n FROM l JOIN r ON contains(normalized_name, term) OR contains(term, normalized_name) GROUP BY ALL""")
def q98_regulatory_findings(spark: SparkSession, d: str) -> DataFrame:
    table = spark.createDataFrame(_REGULATED, "ingredient string, aliases array<string>, market string, status string, max_percent double, source_ref string")
    found = analytics.regulatory_findings(lines_of(spark, d), table, ["eu"])
    return found.groupBy("formulation_id", "rule_id", "severity", "ingredient").agg(F.count("*").alias("n"))


@query(f"""WITH {LINES}, t AS (SELECT formulation_id, list(DISTINCT tag) AS types FROM l GROUP BY 1), r(f, s, types, c) AS (VALUES ('anvil', 'brass rod', ['PROMO'], 8e-1), ('bolt', 'brass screw', [], 7e-1), ('gizmo', 'brass rod', ['LARGE', 'SMALL'], 6e-1))
SELECT formulation_id, normalized_name AS name, s AS substitute, max(c) AS confidence FROM l JOIN t USING (formulation_id) JOIN r ON contains(normalized_name, f) OR contains(f, normalized_name)
WHERE len(r.types) = 0 OR list_has_any(r.types, t.types) GROUP BY ALL""")
def q99_typed_substitutes(spark: SparkSession, d: str) -> DataFrame:
    lines = lines_of(spark, d)
    types = lines.groupBy("formulation_id").agg(F.collect_set("tag").alias("product_types"))
    table = spark.createDataFrame([("anvil", [], "brass rod", ["PROMO"], 0.8), ("bolt", [], "brass screw", [], 0.7), ("gizmo", [], "brass rod", ["LARGE", "SMALL"], 0.6)], "`from` string, aliases_from array<string>, `to` string, product_types array<string>, confidence double")
    return analytics.rule_substitutes(lines, table, types=types)


_ASKED = "CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'good morning ' || p_name WHEN 2 THEN 'give me a baby shampoo formula' WHEN 3 THEN 'compare lotion and cream instead of ' || p_name ELSE 'why is ' || p_name || ' used' END"


@query(f"""WITH q AS (SELECT p_partkey, p_size, p_partkey % 5 AS k, {_ASKED} AS text FROM part),
o AS (SELECT p_partkey AS query_id, k, text, CASE WHEN p_size > 10 THEN p_size * 2e0 END AS top, CASE WHEN p_size > 10 THEN p_size % 3 + 1 ELSE 0 END AS n, p_size / 1e2 AS hit FROM q)
SELECT query_id, CASE k WHEN 1 THEN 'unknown' WHEN 2 THEN 'lookup' WHEN 3 THEN 'compare' WHEN 4 THEN 'reasoning' ELSE 'unknown' END AS route,
       CASE WHEN k = 0 THEN 'empty' WHEN k = 1 THEN 'chitchat' WHEN k < 4 AND coalesce(top, 0) >= 80 AND n >= CASE k WHEN 3 THEN 2 ELSE 1 END THEN 'direct' WHEN k < 4 AND coalesce(top, 0) >= 50 THEN 'hybrid' WHEN hit >= 3e-1 OR n > 0 THEN 'model' ELSE 'failed' END AS outcome,
       CASE WHEN contains(text, 'instead of') THEN 'scale_to_batch,substitute_ingredient' ELSE 'scale_to_batch' END AS actions FROM o""")
def q100_outcomes(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part")
    asked = part.select(F.col("p_partkey").alias("query_id"), F.expr(_ASKED).alias("text"))
    recipes_ = part.filter("p_size > 10").select(F.col("p_partkey").alias("query_id"), "p_size", F.explode(F.sequence(F.lit(0), F.col("p_size") % 3)).alias("k")).select("query_id", (F.col("p_size") * 2.0 - F.col("k")).alias("score"), (F.col("k") == 0).alias("met"))
    hits = part.select(F.col("p_partkey").alias("query_id"), (F.col("p_size") / 100).alias("score"), F.lit(0).alias("pos"))
    out = chat.outcomes(asked, recipes_, hits)
    return out.select("query_id", "route", "outcome", F.array_join("actions", ",").alias("actions"))


@query(f"""WITH {LINES}, f AS (SELECT o_orderkey AS id, o_orderpriority || ' ' || o_custkey AS name, o_totalprice AS c, (SELECT count(*) FROM l WHERE formulation_id = o_orderkey) AS n FROM orders),
b AS (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY n DESC, c DESC, id) AS r FROM f WHERE n >= 3) SELECT id, n, 'Formula: ' || name AS head FROM b WHERE r = 1 ORDER BY n DESC, c DESC, id LIMIT 25""")
def q101_sample_recipes(spark: SparkSession, d: str) -> DataFrame:
    items = lines_of(spark, d).groupBy(F.col("formulation_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("line_no", "raw_name", "amount", "unit"))).alias("ingredients"))
    rows = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat_ws(" ", "o_orderpriority", "o_custkey").alias("name"), F.col("o_totalprice").alias("confidence")).join(items, "id")
    out = tables.sample_recipes(rows, 25).join(rows.select("id", F.size("ingredients").cast("long").alias("n")), "id")
    return out.select("id", "n", F.substring_index("text", "\n", 1).alias("head"))


@query(f"""WITH {LINES}, one AS (SELECT min(o_orderkey) AS id FROM orders WHERE EXISTS (SELECT 1 FROM l WHERE formulation_id = o_orderkey AND contains(normalized_name, 'gizmo'))),
t AS (SELECT formulation_id AS id, list(DISTINCT tag) AS types FROM l GROUP BY 1), p AS (SELECT t.id, o_totalprice AS c FROM t JOIN orders ON o_orderkey = t.id WHERE list_has_all(t.types, (SELECT types FROM t WHERE id = (SELECT id FROM one)))),
k AS (SELECT id FROM p ORDER BY c DESC, id LIMIT 40), n AS (SELECT normalized_name AS s, count(*) AS n FROM l JOIN k ON k.id = formulation_id WHERE k.id <> (SELECT id FROM one) AND NOT contains(normalized_name, 'gizmo') GROUP BY 1 ORDER BY n DESC, s LIMIT 5),
u AS (SELECT s, least(9e-1, 5e-1 + 8e-2 * n) AS c FROM n UNION ALL SELECT 'brass rod', 7e-1)
SELECT (SELECT id FROM one) AS formulation_id, 'gizmo' AS name, s AS substitute, {_round('max(c)', 6)} AS confidence FROM u GROUP BY s ORDER BY confidence DESC, s LIMIT 5""")
def q102_suggest_substitutions(spark: SparkSession, d: str) -> DataFrame:
    """The feature is one recipe and one of its ingredients, here of the first order with a gizmo."""
    lines = lines_of(spark, d)
    types = lines.groupBy(F.col("formulation_id").alias("id")).agg(F.collect_set("tag").alias("product_types"))
    forms = formulations_of(spark, d).select("id", "confidence").join(types, "id")
    one = lines.filter(F.col("normalized_name").contains("gizmo")).agg(F.min("formulation_id").alias("id"))
    rules_ = spark.createDataFrame([("gizmo", ["widget"], "Brass Rod", None, 0.7)], "`from` string, aliases_from array<string>, `to` string, product_types array<string>, confidence double")
    out = analytics.suggest_substitutions(forms.join(F.broadcast(one), "id"), "Gizmo", forms, lines, rules_)
    return out.withColumn("confidence", bounded(F.col("confidence"), 6))


# Passages and drift, by fingerprints

_SQ = r"lower(trim(regexp_replace({}, '[ \t\n\r\x0B\x0C]+', ' ', 'g'), ' '))"


@query(f"""WITH d AS (SELECT doc_id, {_SQ.format("text")} AS t FROM documents), q AS (SELECT doc_id AS query_id, substr(t, 101, 50) AS head FROM d WHERE doc_id % 20 = 0 AND substr(t, 101, 50) <> '')
SELECT query_id, doc_id FROM q JOIN d ON contains(t, head)""")
def q111_passages(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold fifty characters of a document of the stated query set, from its 101st on (fewer at its end)."""
    docs = read(spark, d, "documents").select("doc_id", F.lower(T.squeeze(F.col("text"))).alias("text"))
    heads = docs.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.substring("text", 101, 50).alias("head"))
    found = fingerprints.holding(docs.select(F.col("doc_id").alias("key"), "text"), heads.select("head"))
    return found.join(heads, "head").select("query_id", F.col("key").alias("doc_id"))


@query(f"""WITH r AS (SELECT doc_id, substr({_SQ.format("text")}, 1, 80) AS head FROM documents), c AS (SELECT doc_id, substr(text, 41, 3200) AS text FROM documents UNION ALL SELECT doc_id, substr(text, 1, 3200) FROM documents WHERE doc_id % 7 <> 0)
SELECT doc_id AS id, head FROM r WHERE head <> '' AND doc_id IN (SELECT doc_id FROM c) AND NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = r.doc_id AND contains({_SQ.format("coalesce(c.text, '')")}, head))""")
def q112_chunk_drift(spark: SparkSession, d: str) -> DataFrame:
    """Documents as records, with two overlapping chunks each; every seventh has lost its first one."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    chunks = docs.select("id", F.substring("text", 41, 3200).alias("text")).union(docs.filter("id % 7 <> 0").select("id", F.substring("text", 1, 3200).alias("text")))
    return rules.drifted(docs, chunks)


# Ingest in batches, each one commit


@query("""SELECT doc_id AS path, octet_length(encode(text)) AS length, sha256(text) AS sha256, CASE WHEN doc_id % 3 <> 0 AND (doc_id % 5 <> 0 OR text = upper(text)) THEN 1 ELSE 2 END AS at FROM documents WHERE text IS NOT NULL""")
def q113_ingest_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files: a first batch of two thirds, some of them in another version, taken twice; then a batch of all."""
    docs = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id", "text")
    as_files = lambda rows: rows.select("path", F.octet_length("text").cast("long").alias("length"), F.col("text").cast("binary").alias("content"))
    first = docs.filter("doc_id % 3 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.upper("text")).otherwise(F.col("text")))
    store = IngestStore(spark, new_path(spark, "ingest"))
    for batch, rows in [(0, first), (0, first), (1, docs)]:
        store.take(as_files(rows), "documents", batch)
    return store.manifest().select(F.col("path").cast("long").alias("path"), "length", "sha256", "at")


# Which formulas go first: BM25 hits of the benchmark items, asked in four ways, on documents with what makes formulas

_KINDS = ["compare a toner vs the baby shampoo ", "a lipstick with percentages ", "hand cream ", ""]
_KIND_TYPES = [["toner", "baby", "shampoo"], ["makeup"], [], []]
_ENDS = [" Baby shampoo ingredients 12 % water", " Toner of 5 % rose water, ingredients", " lipstick ingredients: 9 % wax", " Hand cream 3 % ingredients", " ingredients 4 %", ""]


def _preferred_sql() -> str:
    pick = lambda values, by: "CASE " + " ".join(f"WHEN {by} % {len(values)} = {k} THEN {v}" for k, v in enumerate(values)) + " END"
    q = pick([f"'{k}'" for k in _KINDS], "query_id")
    types = pick([f"CAST({t} AS VARCHAR[])" for t in _KIND_TYPES], "query_id")
    signs = [f"(list_contains(types, '{tag}') OR contains(q, '{tag.replace('_', ' ')}')) AND regexp_matches(lower(t), '{p}')" for tag, p in retrieval.TEXT_TYPES]
    signs += [f"contains(q, '{needle}') AND regexp_matches(lower(t), '{p}')" for needle, p, _ in retrieval.PHRASES]
    return f"""WITH {_BM25.replace("1e4", "1e6")}, met AS (SELECT query_id, bm.doc_id, pos, lower({q} || b.text) AS q, {types} AS types, query_id % 4 <> 2 AS wants, d.text || {pick([f"'{e}'" for e in _ENDS], "bm.doc_id")} AS t, CASE WHEN bm.doc_id % 4 = 0 THEN ['toner'] ELSE CAST([] AS VARCHAR[]) END AS tags
FROM bm JOIN benchmark b ON item_id = query_id JOIN documents d ON d.doc_id = bm.doc_id WHERE pos < 40),
kinds AS (SELECT *, CASE WHEN NOT ({_formula_sql("t")}) THEN 2 WHEN list_has_any(types, tags) OR {" OR ".join(signs)} THEN 0 ELSE 1 END AS kind, regexp_matches(q, '{retrieval.COMPARES}') AS cmp FROM met),
places AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY pos, doc_id) AS place FROM kinds),
groups_ AS (SELECT *, CASE WHEN wants AND kind = 0 AND place <= CASE WHEN cmp THEN 4 ELSE 3 END THEN 0 WHEN wants AND kind = 1 AND cmp AND place <= 2 THEN 1 ELSE 2 END AS grp FROM places)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY grp, pos, doc_id) - 1 AS pos FROM groups_"""


@query(_preferred_sql())
def q114_preferred_formulas(spark: SparkSession, d: str) -> DataFrame:
    """Pins of three formulas, or of four and two where the question compares."""
    pick = lambda values, by: F.element_at(F.array(*values), (F.col(by) % len(values) + 1).cast("int"))
    docs, items = read(spark, d, "documents"), read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    hits = written(retrieval.bm25(docs, items, 40), "preferred-hits")
    asked = items.select("query_id", F.concat(pick([F.lit(k) for k in _KINDS], "query_id"), "text").alias("q"), pick([F.array(*map(F.lit, t)).cast("array<string>") for t in _KIND_TYPES], "query_id").alias("types"))
    chunks = docs.select("doc_id", F.concat("text", pick([F.lit(e) for e in _ENDS], "doc_id")).alias("t"), F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("toner"))).otherwise(F.array().cast("array<string>")).alias("tags"))
    rows = hits.join(asked, "query_id").join(retrieval.texts_of(chunks, hits, "doc_id"), "doc_id")
    fits = retrieval.on_type(F.col("tags"), F.col("types"), F.col("q"), F.col("t"))
    out = retrieval.prefer_formulas(rows, F.col("q"), F.col("query_id") % 4 != 2, fits, T.is_formula(F.col("t")))
    return out.select("query_id", "doc_id", F.col("pos").cast("long").alias("pos"))


# The audit of an ingested catalogue


@query(f"""WITH c AS (SELECT l_orderkey AS id, count(*) AS n, max(CASE WHEN l_quantity IS NOT NULL THEN 1 ELSE 0 END) AS a FROM lineitem GROUP BY 1),
b AS (SELECT o_orderkey AS key, o_orderpriority || ' ' || o_custkey AS name, CASE WHEN o_orderkey % 13 = 0 THEN 'unknown' ELSE o_orderpriority END AS m, o_totalprice / 1e6 AS confidence, coalesce(n, 0) AS n, coalesce(a, 0) AS a FROM orders LEFT JOIN c ON id = o_orderkey),
thin AS (SELECT *, row_number() OVER (ORDER BY confidence DESC, n, key) AS r FROM b WHERE n < 6)
SELECT count(*) AS total, {_round('avg(CASE WHEN n >= 6 THEN 1e0 ELSE 0e0 END)', 6)} AS six_plus, {_round('avg(CAST(a AS DOUBLE))', 6)} AS with_amounts, {_round('avg(CASE WHEN key % 3 = 0 THEN 1e0 ELSE 0e0 END)', 6)} AS with_procedure,
       {_round('avg(CASE WHEN confidence >= 2e-1 THEN 1e0 ELSE 0e0 END)', 6)} AS confident, {_round('avg(CASE WHEN n = 2 THEN 1e0 ELSE 0e0 END)', 6)} AS two_only, CAST(median(n) AS DOUBLE) AS median_lines, {_round('avg(n)', 6)} AS mean_lines,
       (SELECT string_agg(m || '=' || k, ',' ORDER BY m) FROM (SELECT m, count(*) AS k FROM b GROUP BY 1)) AS by_method,
       (SELECT string_agg(printf('%s (%d ing, %s, conf=%.2f)', substr(name, 1, 50), n, m, confidence), '; ' ORDER BY r) FROM thin WHERE r <= 8) AS thin_examples FROM b""")
def q115_catalogue_audit(spark: SparkSession, d: str) -> DataFrame:
    """Orders as recipes: their priority is the method, every third has a procedure."""
    method = F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderpriority"))
    steps = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("mix"))).when(F.col("o_orderkey") % 3 == 1, F.array().cast("array<string>"))
    forms = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat_ws(" ", "o_orderpriority", "o_custkey").alias("name"), (F.col("o_totalprice") / 1e6).alias("confidence"), method.alias("extraction_method"), steps.alias("procedure"))
    out = catalog.audit(forms, lines_of(spark, d), high=0.2)
    out = out.withColumns({c: bounded(F.col(c), 6) for c in ("six_plus", "with_amounts", "with_procedure", "confident", "two_only", "mean_lines")})
    by = F.array_join(F.transform(F.map_entries("by_method"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return out.withColumns({"by_method": by, "thin_examples": F.array_join("thin_examples", "; ")})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
