"""The registered queries against their SQL, and operators on small fixtures."""

import json
import uuid

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from saltern.functions import text as T
from saltern.operators import analytics, catalog, conversations, evaluate, retrieval, rules, warehouse
from saltern.plans import intent, queries, ranking
from saltern.sources.tables import Table, markdown
from saltern.streaming import ingest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    def cell(v):
        return repr(round(v, 9)) if isinstance(v, float) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    own = queries.QUERIES[name](spark, sf)
    columns = sorted(own.columns)
    assert plain(own.select(*columns).collect()) == plain(db.sql(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})").fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def lines(spark, rows):
    return spark.createDataFrame([(f, i, n, T_normal(n), a, u) for i, (f, n, a, u) in enumerate(rows)], "formulation_id string, line_no int, raw_name string, normalized_name string, amount double, unit string")


def T_normal(name):
    return T.ALIASES.get(name.lower(), name.lower())


PRICES = [("water", 0.05, 0), ("glycerin", 1.2, 1), ("tocopherol", 30.0, 2)]


def test_cost(spark):
    prices = spark.createDataFrame(PRICES, "ingredient string, price double, pos long")
    data = lines(spark, [("a", "Water", 90.0, "%"), ("a", "Glycerin", 10.0, "%"), ("b", "Water", 50.0, "%"), ("b", "Polymer X", 50.0, "%"), ("c", "Water", 5.0, "wt%")])
    got = {r["formulation_id"]: r for r in analytics.costs(data, prices).collect()}
    assert got["a"]["cost_per_kg"] == 0.165 and got["a"]["covered_percent"] == 1.0 and got["a"]["missing"] == []
    assert got["b"]["covered_percent"] == 0.5 and got["b"]["missing"] == ["Polymer X"] and "c" not in got


def test_compliance(spark):
    table = spark.createDataFrame([("formaldehyde", [], "EU", "prohibited", None), ("phenoxyethanol", [], "EU", "restricted", 1.0)], "ingredient string, aliases array<string>, market string, status string, max_percent double")
    data = lines(spark, [("bad", "Formaldehyde", 0.1, "%"), ("over", "Phenoxyethanol", 1.5, "%"), ("warn", "Phenoxyethanol", 0.5, "%"), ("ok", "CAPB", 10.0, "%")])
    assert {r["formulation_id"]: r["status"] for r in analytics.compliance(data, table, ["eu"]).collect()} == {"bad": "fail", "over": "fail", "warn": "warn", "ok": "pass"}
    assert {r["status"] for r in analytics.compliance(data, table, []).collect()} == {"pass"}


def test_compare_and_roles(spark):
    left, right = lines(spark, [("l", "Water", 95.0, "%"), ("l", "Glycerin", 5.0, "%")]), lines(spark, [("r", "Aqua", 50.0, "%"), ("r", "Tocopherol", 50.0, "%")])
    got = {r["key"]: r["side"] for r in analytics.compare(left, right).collect()}
    assert got == {"water": "both", "glycerin": "left", "tocopherol": "right"}
    assert {r["role"] for r in analytics.roles(lines(spark, [("x", "SLS", 10.0, "%"), ("x", "Glycerin", 5.0, "%")])).collect()} == {"surfactant", "humectant"}


def test_catalogue_filters(spark):
    forms = spark.createDataFrame([("g", "Gentle", ["shampoo"], "d", 0.9), ("c", "Classic", ["shampoo", "cream"], "d", 0.8)], "id string, name string, product_types array<string>, doc_id string, confidence double")
    own = lines(spark, [("g", "Water", 90.0, "%"), ("g", "CAPB", 10.0, "%"), ("c", "Water", 70.0, "%"), ("c", "SLS", 10.0, "%")])
    ids = lambda f: [r["id"] for r in catalog.search(forms, own, f).collect()]
    assert ids(catalog.Filters(banned=("sls",))) == ["g"] and ids(catalog.Filters(product_types=("cream",))) == ["c"]
    assert ids(catalog.Filters(ingredient="water")) == ["g", "c"] and ids(catalog.Filters(name="zzz")) == []


CLEAN = [("Water", 74.5), ("Sodium laureth sulfate", 12.0), ("Cocamidopropyl betaine", 8.0), ("Glycerin", 3.0), ("PEG-80 sorbitan laurate", 2.0), ("Phenoxyethanol", 0.4), ("Citric acid", 0.1)]


def record(spark, rows=CLEAN, method="table", source=None, chunks=None, unit="%"):
    text = source if source is not None else " ".join(f"{n} {a}" for n, a in CLEAN)
    items = [(n, T_normal(n), a, "qs" if a is None and n.startswith("Q") else unit, None) for n, a in rows]
    schema = "id string, name string, ingredients array<struct<raw_name:string,normalized_name:string,amount:double,unit:string,phase:string>>, source_text string, vector_text string, extraction_method string, chunk_texts array<string>"
    return rules.facts(spark.createDataFrame([("f", "Baby shampoo", items, text, text, method, chunks)], schema))


def test_clean_record_is_verified(spark):
    f = record(spark)
    found = rules.findings(f)
    assert found.filter("severity <> 'info'").count() == 0
    report = rules.reports(rules.family_scores(f.select("id"), found)).first()
    assert (report["precision_score"], report["status"]) == (1.0, "verified")


@pytest.mark.parametrize(("rows", "how", "rule", "severity"), [
    ([*CLEAN[:-1], ("Citric acid", None)], {}, "completeness.ingredient-fields", "warning"),
    (CLEAN[:1], {}, "completeness.min-ingredients", "error"),
    (CLEAN, {"source": ""}, "completeness.has-source-text", "error"),
    ([*CLEAN, ("Honey", 20.0)], {}, "consistency.percent-sum", "error"),
    ([*CLEAN, ("Honey", 5.0)], {}, "consistency.percent-sum", "warning"),
    ([*CLEAN[1:], ("Water", 150.0)], {}, "consistency.amount-range", "error"),
    ([*CLEAN[1:], ("Water", -1.0)], {}, "consistency.amount-range", "error"),
    ([*CLEAN, ("Glycerin", 0.1)], {}, "consistency.duplicate-ingredient", "warning"),
    ([*CLEAN[:-1], ("Citric acid", 0.2)], {}, "fidelity.amount-verbatim", "warning"),
    ([*CLEAN[:-1], ("Citric acid", 0.2)], {"method": "llm"}, "fidelity.amount-verbatim", "error"),
    ([*CLEAN[:-1], ("Xylitol", 0.1)], {}, "fidelity.name-in-source", "warning"),
    (CLEAN, {"chunks": ["something else"]}, "fidelity.chunk-drift", "warning"),
    ([*CLEAN[:-1], ("Total", 0.1)], {}, "completeness.junk-row", "error"),
])
def test_rules(spark, rows, how, rule, severity):
    assert (rule, severity) in {(r["rule_id"], r["severity"]) for r in rules.findings(record(spark, rows, **how)).collect()}


def test_errors_cap_the_status_and_broken_rules_are_skipped(spark):
    def broken(f, config):
        raise ValueError("no plan")

    f = record(spark, [*CLEAN, ("Honey", 20.0)])
    found = rules.findings(f, [broken, *rules.RULES])
    assert rules.reports(rules.family_scores(f.select("id"), found)).first()["status"] != "verified"


def test_ranges(spark):
    table = spark.createDataFrame([(0, "preservative", "phenoxyethanol", 0.2, 0.8, 1.0)], "pos int, category string, member string, typical_min double, typical_max double, hard_max double")
    rule = rules.ingredient_range(table)
    rows = lambda a: [*CLEAN[:-2], ("Phenoxyethanol", a), CLEAN[-1]]
    level = lambda a, **how: [r["severity"] for r in rule(record(spark, rows(a), **how), rules.CONFIG).collect()]
    assert level(0.4) == [] and level(0.9) == ["warning"] and level(2.5) == ["error"] and level(2.5, source="Phenoxyethanol 2.5 %") == ["warning"]


def test_identity(spark):
    row = spark.createDataFrame([("  A\n\tb ",)], "t string").select(T.text_hash(F.col("t")).alias("h"), T.slug(F.lit("/x/My Book (2).PDF")).alias("s"), T.uuid5(str(uuid.NAMESPACE_URL), F.lit("doc:1")).alias("u")).first()
    import hashlib

    assert row["h"] == hashlib.sha256(b"a b").hexdigest() and row["s"] == "my_book_2" and row["u"] == str(uuid.uuid5(uuid.NAMESPACE_URL, "doc:1"))


def test_bm25_tokens_and_order(spark):
    assert {"shampoo", "2.5", "%"} <= set(spark.range(1).select(T.tokens(F.lit("Sulfate-free baby shampoo 2.5% CAPB")).alias("t")).first()["t"])
    docs = spark.createDataFrame([(1, "baby shampoo with water"), (2, "motor oil"), (3, "hand cream")], "doc_id long, text string")
    out = retrieval.bm25(docs, spark.createDataFrame([(0, "baby shampoo")], "query_id long, text string")).collect()
    assert out[0]["doc_id"] == 1


@pytest.mark.parametrize(("text", "route"), [("give me a baby shampoo formula", "lookup"), ("compare lotion and cream", "compare"), ("why is glycerin used", "reasoning"), ("is this cream suitable for face", "reasoning"), ("what is the best one", "unknown"), ("hello there", "unknown")])
def test_routes(spark, text, route):
    assert intent.classified(spark.createDataFrame([(text,)], "text string")).first()["route"] == route


def test_structured_search(spark):
    rows = [("a", "Baby Shampoo", ["baby", "shampoo"], "d", ["water", "glycerin"], 0.5, "pass"), ("b", "Rich Cream", ["cream"], "d", ["water", "tocopherol"], 5.0, "pass"), ("c", "Old Cream", ["cream"], "d", ["water", "formaldehyde"], 0.5, "fail")]
    forms = spark.createDataFrame(rows, "id string, name string, product_types array<string>, doc_id string, names array<string>, cost_per_kg double, compliance string")
    assert [r["id"] for r in ranking.structured_search(forms, ["shampoo"]).collect()][0] == "a"
    brief = intent.Brief(cost_target=1.0, markets=("EU",))
    assert [r["id"] for r in ranking.structured_search(forms, ["cream"], brief=brief).collect()] == ["a"]


def test_warehouse(spark):
    up = spark.createDataFrame([(0, " SLS ", None, "1,000"), (1, "Sodium lauryl sulfate", "S1", "2"), (2, "Total", None, "5"), (3, "Glycerine", None, "x"), (4, "sls", "S2", "1"), (5, "Payment received", None, "1"), (6, "أكواجل", None, "1"), (7, "اكواجل ", None, "2"), (8, "12", None, "1"), (9, "رصيد افتتاحي", None, "1")], "pos long, raw_name string, sku string, qty string")
    got = {r["key"]: (r["raw_name"], r["sku"], r["qty"]) for r in warehouse.merge_upload(up).collect()}
    assert got == {"sls": ("SLS", "S2", 1001.0), "sodium lauryl sulfate": ("Sodium lauryl sulfate", "S1", 2.0), "glycerine": ("Glycerine", None, None), "اكواجل": ("أكواجل", None, 3.0)}
    stock = spark.createDataFrame([("water",), ("glycerin",)], "name string")
    cover = warehouse.coverage(lines(spark, [("f", "Water", 1.0, "%"), ("f", "Glycerin", 1.0, "%"), ("f", "Wax", 1.0, "%")]), stock).first()
    assert (cover["counted"], cover["coverage_pct"], cover["tier"]) == (2, 50.0, "partial")
    assert warehouse.set_ratio("hot rod", "rod hot grade") == 100.0 and warehouse.set_ratio("abc", "xyz") == 0.0
    arabic = spark.createDataFrame([("جليسرين", "glycerin")], "key string, canonical_name string")
    mats = spark.createDataFrame([(1, "جليسرين"), (2, "Parfum"), (3, "Mystery")], "id long, raw_name string")
    out = {r["material_id"]: (r["canonical_name"], r["source"]) for r in warehouse.resolve(mats, spark.createDataFrame([("mystery", "water")], "key string, canonical_name string"), arabic, spark.createDataFrame([("glycerin",)], "match string")).collect()}
    assert out == {1: ("glycerin", "arabic"), 2: ("fragrance", "rules"), 3: ("water", "override")}
    names = spark.createDataFrame([(1, "توين 20"), (2, "توين 200"), (3, "Parfum"), (4, "مادة مجهولة تماما")], "id long, raw_name string")
    out = {r["material_id"]: (r["canonical_name"], r["source"], r["confidence"]) for r in warehouse.resolve(names, spark.createDataFrame([], "key string, canonical_name string"), None, spark.createDataFrame([("glycerin",)], "match string")).collect()}
    assert out == {1: ("polysorbate 20", "arabic", 0.93), 2: ("polysorbate 20", "arabic", 0.88), 3: ("fragrance", "rules", 0.95), 4: (None, None, None)}
    junk = spark.createDataFrame([("Wt %",), ("12 %",), ("Page 12",), ("abc",), (None,), ("Baby Shampoo",)], "n string").select(warehouse.is_junk_formulation(F.col("n"))).collect()
    assert [r[0] for r in junk] == [True] * 5 + [False]
    assert warehouse.name_column(["qty", "الصنف"]) == "الصنف" and warehouse.name_column(["a", "Ingredients"]) == "Ingredients" and warehouse.optional_column(["x", "Item_Code"], warehouse.SKU_HEADER) == "Item_Code"


def test_follow_ups(spark):
    chat = spark.createDataFrame([(1, 0, "user", "baby shampoo formula please now"), (1, 1, "assistant", "here"), (1, 2, "user", "make it sulfate-free")], "conv_id long, turn long, role string, text string")
    assert [r["query"] for r in conversations.rewritten(chat).orderBy("turn").collect()][1] == "baby shampoo formula please now - make it sulfate-free"


def test_expectations(spark):
    hits = spark.createDataFrame([("q", 0, 0.9, True, ["shampoo"], "a shampoo"), ("q", 1, 0.1, False, ["cream"], "oil")], "query_id string, pos int, score double, is_formula boolean, tags array<string>, text string")
    spec = spark.createDataFrame([("q", 1, 1, ["shampoo"], ["shampoo"], 0.5, "shampoo", "oil")], "query_id string, top_k int, min_formula int, any_types array<string>, all_types array<string>, min_top_score double, must_match string, must_not_contain string")
    assert evaluate.expectations(hits, spec).first()["passed"]
    assert not evaluate.expectations(hits, spec.withColumn("top_k", F.lit(2))).first()["passed"]


def test_table_upserts(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"), "id long, v string", ["id"])
    assert t.count() == 0
    t.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string"))
    t.upsert(spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string"))
    assert {(r["id"], r["v"]) for r in t.read().collect()} == {(1, "a"), (2, "c"), (3, "d")}
    t.delete(spark.createDataFrame([(1,)], "id long"))
    assert t.count() == 2
    t.clear()
    assert t.count() == 0


def test_stream_takes_up_pages_once(spark, tmp_path):
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    (tmp_path / "in").mkdir()
    page = lambda k, text: (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"doc_id": "d", "pdf_page": k, "text": text}) + "\n")
    page(1, "Baby shampoo formula 12.50 %")
    page(2, "Baby   shampoo formula 12.50 %")
    ingest.run(spark, source, target, check)
    page(3, "baby shampoo formula 12.50 %")
    page(4, "Hand cream")
    ingest.run(spark, source, target, check)
    ingest.run(spark, source, target, check)
    out = spark.read.parquet(target).collect()
    assert len(out) == 2 and {r["is_formula"] for r in out} == {True, False}


def test_markdown(spark):
    assert markdown(lines(spark, [("f", "Water", 1.0, "%")])).first()["text"].endswith("| Water | 1.0 | % |")
