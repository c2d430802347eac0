"""Cases in which a part of the job was once left out."""

import random

import pytest

from saltern.operators import analytics, retrieval, rules, warehouse
from saltern.plans import queries


def test_every_order_is_scored_by_every_rule(spark, sf):
    orders = {r["o_orderkey"] for r in queries.read(spark, sf, "orders").select("o_orderkey").collect()}
    sizes = {r["l_orderkey"]: r["count"] for r in queries.read(spark, sf, "lineitem").groupBy("l_orderkey").count().collect()}
    got = {(r["formulation_id"], r["family"]): r for r in queries.q45_every_rule_scores(spark, sf).collect()}
    assert {k for k, _ in got} == orders
    few = {k for k in orders if sizes.get(k, 0) < 2}
    assert few and {k for (k, family), r in got.items() if family == "completeness" and r["errors"]} == few
    assert any(r["score"] < 1 for (_, family), r in got.items() if family == "ranges")


def typos(n):
    """Names of one to four words and copies of them with letters changed, first letters above all."""
    rng = random.Random(n)
    words = ["glycerin", "xanthan", "gum", "oil", "acid", "citric", "peg", "a", "ab", "زيت", "الجليسرين", "جليسرين", "tocopherol"]
    known = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    names = []
    for name in known:
        letters = list(name)
        for _ in range(rng.randint(0, 3)):
            at = rng.choice([0, rng.randrange(len(letters))]) if letters else 0
            letters[at : at + 1] = rng.choice(["", "z", "zy"])
        names.append("".join(letters))
    return [*names, "lycerin", "zanthan", "", " "], [*known, "glycerin", "xanthan", "ac", ""]


@pytest.mark.parametrize("scorer", [warehouse.set_ratio, warehouse.sort_ratio])
@pytest.mark.parametrize("threshold", [60.0, 82.0, 88.0, 100.0])
def test_fuzzy_match_is_brute_force(spark, threshold, scorer):
    names, known = typos(60)
    want = {}
    for a in set(names):
        scores = [(-s, b) for b in set(known) if (s := scorer(a, b)) >= threshold and a.strip() and b.strip()]
        if scores:
            want[a] = (min(scores)[1], -min(scores)[0])
    frame = lambda x, c: spark.createDataFrame([(v,) for v in [*x, None]], f"{c} string")
    got = {r["name"]: (r["match"], r["score"]) for r in warehouse.fuzzy_match(frame(names, "name"), frame(known, "match"), threshold, scorer=scorer).collect()}
    assert got == want
    if threshold == 82.0:
        assert got["lycerin"][0] == "glycerin" and got["zanthan"][0] == "xanthan"


def test_article_does_not_part_arabic_names(spark):
    arabic = spark.createDataFrame([("جليسرين", "glycerin")], "key string, canonical_name string")
    known = spark.createDataFrame([("جليسرين",)], "match string")
    got = warehouse.fuzzy_match(spark.createDataFrame([("الجليسرين",)], "name string"), known, 87.0).first()
    assert got["match"] == "جليسرين" and got["score"] == 87.5
    mats = spark.createDataFrame([(1, "الجليسرين")], "id long, raw_name string")
    none = spark.createDataFrame([], "key string, canonical_name string")
    out = warehouse.resolve(mats, none, arabic, spark.createDataFrame([], "match string"), arabic_threshold=87.0).first()
    assert (out["canonical_name"], out["source"]) == ("glycerin", "arabic")


def test_coverage_is_fuzzy_and_tries_the_raw_name(spark):
    rows = [("f", 0, "Glycerine USP", "glycerine usp"), ("f", 1, "Xanthan Gum", "thickener"), ("f", 2, "zanthan gum", None), ("f", 3, "Beeswax", "beeswax"), ("f", 4, None, None), ("f", 5, "Beeswax", "")]
    lines = spark.createDataFrame(rows, "formulation_id string, line_no int, raw_name string, normalized_name string")
    stock = spark.createDataFrame([("glycerin usp",), ("xanthan gum",), ("xanthan gum",), ("",)], "name string")
    counts = lambda **how: tuple(warehouse.coverage(lines.filter("raw_name IS NOT NULL"), stock, **how).select("counted", "matched").first())
    assert counts() == (5, 3) and counts(threshold=None) == (5, 1)
    lists = warehouse.coverage_lists(lines, stock).first()
    assert lists["matched"] == ["Glycerine USP", "Xanthan Gum", "zanthan gum"] and lists["missing"] == ["Beeswax", None, "Beeswax"]


def test_resolve_scores_all_words(spark):
    none = spark.createDataFrame([], "key string, canonical_name string")
    arabic = spark.createDataFrame([("زيت", "oil"), ("زيت جوز الهند", "coconut oil")], "key string, canonical_name string")
    mats = spark.createDataFrame([(1, "زيت جوز هند خام"), (2, "الهند زيت جوز")], "id long, raw_name string")
    got = {r["material_id"]: r["canonical_name"] for r in warehouse.resolve(mats, none, arabic, spark.createDataFrame([], "match string")).collect()}
    assert got == {1: None, 2: "coconut oil"}


def test_bm25_fills_up(spark):
    docs = spark.createDataFrame([(k, "rare word" if k == 7 else f"other{k} text") for k in range(12)], "doc_id long, text string")
    asked = spark.createDataFrame([("a", "rare"), ("b", "unknown"), ("c", "text")], "query_id string, text string")
    rows = retrieval.bm25(docs, asked, 4, fill=True).orderBy("query_id", "pos").collect()
    got = {q: [r["doc_id"] for r in rows if r["query_id"] == q] for q in "abc"}
    assert got == {"a": [7, 0, 1, 2], "b": [0, 1, 2, 3], "c": [0, 1, 2, 3]}
    assert [r["score"] for r in rows if r["query_id"] == "b"] == [0.0] * 4


def test_large_reference_tables_are_joined_in_blocks(spark, monkeypatch):
    prices = spark.createDataFrame([(f"name{k}", float(k), k) for k in range(20)] + [("wax", 9.0, 20), ("wax", 9.0, 20)], "ingredient string, price double, pos int")
    lines = spark.createDataFrame([("f", k, f"Name{k} extra", f"name{k}") for k in (1, 13, 19)] + [("f", 9, "Gum", None)], "formulation_id string, line_no int, raw_name string, normalized_name string")
    items = "id string, name string, ingredients array<struct<raw_name:string,normalized_name:string,amount:double,unit:string,phase:string>>, source_text string, vector_text string, extraction_method string, chunk_texts array<string>"
    f = rules.facts(spark.createDataFrame([("f", "Baby shampoo", [("Wax", "wax", 9.0, "%", None)] * 2, None, None, "table", None)], items))
    ranges = spark.createDataFrame([(k, f"c{k}", "wax", 1.0, 2.0, 3.0) for k in range(9)], "pos int, category string, member string, typical_min double, typical_max double, hard_max double")
    run = lambda: (sorted(map(str, analytics.line_prices(lines, prices).collect())), sorted(map(str, rules.ingredient_range(ranges)(f, rules.CONFIG).collect())), analytics.theta(lines, prices, lines["normalized_name"].contains("name") & (prices["ingredient"] == "wax")).count())
    want = run()
    assert len(want[1]) == 2 and want[2] == 6
    monkeypatch.setattr(analytics, "BROADCAST_ROWS", 4)
    assert run() == want
