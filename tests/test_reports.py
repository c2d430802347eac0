"""Report queries against their SQL, and the whole way of a question to its sources."""

import math
import random
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest

from saltern.operators import retrieval
from saltern.plans import answers, report_queries

TABLES = ["customer", "documents", "embeddings", "labels", "conversations", "benchmark", "pages", "part", "orders", "lineitem", "supplier"]


def shown(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(report_queries.SQL))
def test_report_equals_sql(spark, sf, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    own = report_queries.QUERIES[name](spark, sf)
    columns = sorted(own.columns)
    got = sorted(tuple(str(shown(x)) for x in r) for r in own.select(*columns).collect())
    want = db.sql(f"SELECT {', '.join(columns)} FROM ({report_queries.SQL[name]})").fetchall()
    assert got == sorted(tuple(str(shown(x)) for x in r) for r in want) and got


def test_hybrid_search(spark):
    chunks = [(1, "baby shampoo formula with 12 % water", ["baby", "shampoo"]), (2, "toner of rose water", ["toner"]), (3, "a lotion of oil", ["lotion"]), (4, "shampoo history", ["shampoo"]), (5, "nothing", [])]
    vectors = [(k, [1.0 if k == j else 0.1 for j in range(1, 6)]) for k in range(1, 6)]
    chunks = spark.createDataFrame(chunks, "doc_id long, text string, tags array<string>")
    vectors = spark.createDataFrame(vectors, "doc_id long, embedding array<float>")
    asked = [("q", "a baby shampoo formula", [0.1, 0.1, 0.1, 1.0, 0.1], ["baby", "shampoo"]), ("r", "toner", [0.1, 0.1, 1.0, 0.1, 0.1], ["toner"])]
    queries = spark.createDataFrame(asked, "query_id string, text string, vector array<double>, product_types array<string>")
    out = {(r["query_id"], r["pos"]): (r["doc_id"], r["score"]) for r in retrieval.hybrid_search(chunks, vectors, queries, top_k=3).collect()}
    assert len(out) == 6 and out[("q", 0)][0] == 1 and out[("r", 0)][0] == 2
    known = spark.createDataFrame([("r", 5, 0.94)], "query_id string, doc_id long, score double")
    held = chunks.select("doc_id", retrieval.T.tokens(retrieval.F.col("text")).alias("terms"))
    led = retrieval.hybrid_search(chunks, vectors, queries, held=held, structured=known, top_k=5).filter("query_id = 'r'").collect()
    assert len(led) == 5 and {r["doc_id"] for r in led} == {1, 2, 3, 4, 5}


def test_dense_blocks_and_odd_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0]), (6, [None, 1.0]), (7, [3.0, 4.0])], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(6)], "query_id long, vector array<double>")
    whole = sorted(map(tuple, retrieval.dense_top_k(rows, asked, 2).collect()))
    assert whole == sorted(map(tuple, retrieval.dense_top_k(rows, asked, 2, limit_bytes=20).collect())) and len(whole) == 12
    assert {r[1] for r in whole} <= {1, 2, 7}


def test_top_k_is_cut_before_the_shuffle(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    queries = docs.limit(3).selectExpr("doc_id AS query_id", "text")
    plan = retrieval.bm25(docs, queries, 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_named_boost_and_gates(spark):
    row = spark.createDataFrame([("a lotion with Glycerin for the night", ["glycerin", "wax"], ["Silk Veil Night Cream"])], "t string, r array<string>, n array<string>")
    assert row.select(retrieval.named_boost(*map(retrieval.F.col, "trn"))).first()[0] == pytest.approx(0.18)
    hits = spark.createDataFrame([("a", 0.5), ("a", 0.1), ("b", 0.29), ("c", 0.30)], "query_id string, score double")
    assert {r["query_id"] for r in answers.usable(hits).collect()} == {"a", "c"}
    direct = spark.createDataFrame([(90.0, "lookup", 3), (90.0, "compare", 3), (70.0, "lookup", 3)], "s double, r string, n int").select(answers.can_answer_directly(*map(retrieval.F.col, "srn")))
    assert [r[0] for r in direct.collect()] == [True, False, False]


def test_validate_all(spark):
    from saltern.operators import rules

    line = lambda n, a, u="%": {"raw_name": n, "normalized_name": n.lower(), "amount": a, "unit": u, "phase": None}
    rows = [("a", "Fine cream", [line("Water", 60.0), line("Glycerin", 40.0)], 0.5), ("b", "Old cream", [line("Water", 60.0), line("Formaldehyde", 40.0)], 0.5), ("c", "", [line("Water", None, None)], 0.5)]
    forms = spark.createDataFrame([(*r, "Water 60 Glycerin 40 Formaldehyde", None, "table", None) for r in rows], "id string, name string, ingredients array<struct<raw_name:string,normalized_name:string,amount:double,unit:string,phase:string>>, confidence double, source_text string, vector_text string, extraction_method string, chunk_texts array<string>")
    lines = forms.selectExpr("id AS formulation_id", "inline(ingredients)")
    law = spark.createDataFrame([("formaldehyde", None, "EU", "prohibited", None, "annex")], "ingredient string, aliases array<string>, market string, status string, max_percent double, source_ref string")
    plain = {r["formulation_id"]: r for r in rules.validate_all(forms, lines).collect()}
    assert {r["compliance"] for r in plain.values()} == {"skipped"} and plain["a"]["status"] == plain["b"]["status"] == "verified" and plain["c"]["status"] == "review"
    checked = {r["formulation_id"]: r for r in rules.validate_all(forms, lines, regulation=law, markets=("eu",)).collect()}
    assert (checked["b"]["status"], checked["b"]["compliance"]) == ("review", "fail") and checked["b"]["precision_score"] == plain["b"]["precision_score"]
    assert (checked["a"]["status"], checked["a"]["compliance"]) == ("verified", "pass") and checked["a"]["confidence"] == pytest.approx(0.8)


def test_stuck_topics(spark):
    from saltern.plans import chat

    rows = spark.createDataFrame([(["cream"], ["shampoo"], ["shampoo"]), ([], ["shampoo"], ["shampoo"]), (["shampoo"], ["shampoo"], ["shampoo"]), (["cream"], ["shampoo"], ["cream"]), ([], [], ["cream"])], "a array<string>, b array<string>, c array<string>")
    assert [r[0] for r in rows.select(chat.stuck_topic(*map(retrieval.F.col, "abc"))).collect()] == [True, True, False, False, False]


def test_formulas_that_fit_go_first(spark):
    f, h = "% ingredients", "prose"
    kinds = [h, f"oil {f}", f"toner {f}", h, *[f"a toner {f}"] * 5, f"wax {f}", f"salt {f}", "toner history"]
    rows = [(q, k, k, text, question, types, wants) for q, question, types, wants in [("one", "best toner", [], True), ("two", "Toner vs. wax", ["toner"], False), ("none", "toner", [], False), ("null", "toner", [], None)] for k, text in enumerate(kinds)]
    hits = spark.createDataFrame(rows, "query_id string, doc_id long, pos long, t string, q string, types array<string>, wants boolean")
    c = retrieval.F.col
    fits = retrieval.on_type(retrieval.F.array().cast("array<string>"), c("types"), c("q"), c("t"))
    out = retrieval.prefer_formulas(hits, c("q"), c("wants") | (retrieval.F.size("types") > 0), fits, retrieval.T.is_formula(c("t")))
    got = {}
    for r in out.orderBy("query_id", "pos").collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    rest = lambda first: first + [k for k in range(len(kinds)) if k not in first]
    assert got == {"one": rest([2, 4, 5]), "two": rest([2, 4, 5, 6, 1, 9]), "none": rest([]), "null": rest([])}


def test_boosts_by_types_in_a_column(spark):
    tags = [["baby"], ["baby", "shampoo"], ["toner"], [], ["anti_dandruff", "shampoo"]]
    for types in (["baby", "shampoo"], ["anti_dandruff"], ["toner", "gel"], []):
        rows = spark.createDataFrame([(t, types) for t in tags], "tags array<string>, types array<string>")
        got = rows.select(retrieval.tags_boost(retrieval.F.col("tags"), retrieval.F.col("types")).alias("a"), retrieval.type_boost(retrieval.F.col("tags"), types).alias("b")).collect()
        assert [r["a"] for r in got] == pytest.approx([r["b"] for r in got])


def test_typed_hybrid_search(spark):
    texts = ["prose on toners", "toner: rose 12 % ingredients", "wax 5 % ingredients", "about nothing", "gel toner 3 % ingredients with glycerin"]
    chunks = spark.createDataFrame([(k, t, ["toner"] if k == 1 else []) for k, t in enumerate(texts)], "doc_id long, text string, tags array<string>")
    vectors = spark.createDataFrame([(k, [1.0 if k == j else 0.2 for j in range(5)]) for k in range(5)], "doc_id long, embedding array<double>")
    schema = "query_id string, text string, vector array<double>, product_types array<string>, wants_formula boolean, required array<string>, titles array<string>"
    queries = spark.createDataFrame([("a", "compare toner and wax", [0.2, 0.2, 0.2, 1.0, 0.2], ["toner"], True, ["Glycerin"], []), ("b", "about nothing", [0.2, 0.2, 0.2, 1.0, 0.2], None, None, [], [])], schema)
    recipes = spark.createDataFrame([("a", 77, 0.94, "Formula: toner of mint 2 % ingredients", ["toner"]), ("a", 1, 0.92, "not taken: there is a chunk", [])], "query_id string, doc_id long, score double, text string, tags array<string>")
    got = {}
    for r in retrieval.hybrid_search(chunks, vectors, queries, structured=recipes).orderBy("query_id", "pos").collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    assert set(got["a"][:3]) == {1, 4, 77} and got["a"][3] == 2 and sorted(got["a"]) == [0, 1, 2, 3, 4, 77]
    assert got["b"][0] == 3 and 77 not in got["b"]


def test_an_audit_of_nothing(spark):
    from saltern.operators import catalog

    forms = spark.createDataFrame([("a", None, 0.5, None, None)], "id string, name string, confidence double, extraction_method string, procedure array<string>")
    lines = spark.createDataFrame([], "formulation_id string, amount double")
    one = catalog.audit(forms, lines).first()
    assert (one["total"], one["with_procedure"], one["by_method"], one["median_lines"]) == (1, 0.0, {"unknown": 1}, 0.0) and len(one["thin_examples"]) == 1
    none = catalog.audit(forms.limit(0), lines).first()
    assert (none["total"], none["six_plus"], none["with_procedure"], none["by_method"], none["thin_examples"], none["mean_lines"]) == (0, 0.0, 0.0, {}, [], 0.0)


def test_large_query_sets_shuffle_no_vectors(spark):
    rng = random.Random(9)
    base = [[rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(3)] for _ in range(8)]
    rows = [(k * 3, rng.choice(base)) for k in range(300)] + [(1, None), (2, [0.0, 0.0, 0.0]), (4, [1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = vectors.filter("vec_id % 15 = 0").selectExpr("vec_id AS query_id", "embedding AS vector")
    unit = lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v]
    usable = {k: unit(v) for k, v in rows if v and len(v) == 3 and any(v)}
    want = set()
    for q in (k for k, _ in rows if k % 15 == 0 and k in usable):
        by = sorted((-math.floor(sum(a * b for a, b in zip(usable[q], v, strict=True)) * 1e6 + 0.5), k) for k, v in usable.items())
        want |= {(q, k, pos) for pos, (_, k) in enumerate(by[:7])}
    for limit in (1 << 20, 100):  # at once, and in many passes
        out = retrieval.dense_top_k(vectors, asked, 7, limit_bytes=limit)
        assert {(r["query_id"], r["vec_id"], r["pos"]) for r in out.collect()} == want and out.count() == len(want)
        assert "CoGroups" not in out._jdf.queryExecution().executedPlan().toString()


def test_ties_do_not_pile_up_in_a_task():
    ids = pa.table({"query_id": pa.array([5, 6]), "vector": pa.array([[1.0, 0.0], [0.0, 1.0]])})
    batches = [pa.RecordBatch.from_pydict({"key": pa.array([f"k{at:03d}" for at in range(k, k + 100)]), "embedding": pa.array([[1.0, 1.0]] * 100)}) for k in (100, 0)]
    got = [r for batch in retrieval._near(ids, "key", 3, 2)(iter(batches)) for r in batch.to_pylist()]
    assert sorted((r["query_id"], r["key"]) for r in got) == [(q, k) for q in (5, 6) for k in ("k000", "k001", "k002")]


def test_nearest_keys_equal_brute_force(spark):
    rng = random.Random(4)
    keys = sorted(rng.sample(range(-400, 4000), 150)) + [10**9, -(10**9)]
    asked = keys[::9] + [-5000, 5000, 17]
    out = retrieval.nearest_keys(spark.createDataFrame([(k,) for k in keys], "vec_id long"), spark.createDataFrame([(q,) for q in asked], "query_id long"), 6)
    want = {(q, k, pos) for q in set(asked) for pos, k in enumerate(sorted(keys, key=lambda k: (abs(k - q), k))[:6])}
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(want) and set(rows) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_texts_and_queries_are_scored_where_texts_stand(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: rng.choice("abcdefgh") * rng.randrange(1, 4)
    rows = [(k, " ".join(word() for _ in range(rng.randrange(0, 30)))) for k in range(150)] + [(7, "a b zz"), (7, "a cc"), (None, "a b"), (None, "c"), (300, None), (301, "!")]
    asked = [(q, " ".join(word() for _ in range(rng.randrange(0, 9)))) for q in range(12)] + [(3, "a a bb"), (50, None), (51, "unknown")]
    docs, queries = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(asked, "query_id long, text string")

    def plain(top_k):
        texts = [(k, (t or "").split() if t != "!" else []) for k, t in rows]
        mean = sum(len(t) for (_, t), (_, raw) in zip(texts, rows, strict=True) if raw is not None) / sum(raw is not None for _, raw in rows)
        df = Counter(t for _, terms in texts for t in set(terms))
        idf = {t: math.log(len(rows) - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
        low = 0.25 * sum(idf.values()) / len(idf)
        once, sizes = defaultdict(Counter), defaultdict(set)
        for k, terms in texts:
            once[k].update(terms)
            sizes[k].add(len(terms))
        out = set()
        for q in {q for q, _ in asked}:
            words = Counter(t for p, text in asked if p == q and text for t in text.split() if t in idf)
            hits = []
            for k, tf in once.items():
                if len(sizes[k]) == 1 and any(t in tf for t in words):
                    dl = min(sizes[k])
                    score = sum(n * (low if idf[t] < 0 else idf[t]) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * dl / mean)) for t, n in words.items() if t in tf)
                    hits.append((-math.floor(score * 1e4 + 0.5) / 1e4, k))
            out |= {(q, k, -s) for s, k in sorted(hits)[:top_k]}
        return out

    def found(top_k):
        got = retrieval.bm25(docs.filter("doc_id <> 7"), queries, top_k, digits=4)
        return got, {(r["query_id"], r["doc_id"], r["score"]) for r in got.collect()}

    rows = [r for r in rows if r[0] not in (7, None)]
    for top_k in (4, None):
        out, got = found(top_k)
        assert got == plain(top_k)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Generate" not in plan
    once = found(4)[1]
    repeated = retrieval.bm25(docs, queries, 4, digits=4)
    assert repeated.count() == repeated.select("query_id", "doc_id").distinct().count()  # rows of one key are one text
    monkeypatch.setattr(retrieval, "QUERY_SET", 2)
    assert found(4)[1] == once
    monkeypatch.setattr(retrieval, "SCORES", 5)
    assert found(4)[1] == once


def test_hits_fetch_their_texts_without_a_shuffle_of_texts(spark):
    texts = spark.range(100).selectExpr("id AS doc_id", "repeat('x', 50) AS text")
    out = retrieval.texts_of(texts, spark.createDataFrame([(1, 5), (2, 5), (2, 7), (2, 500)], "query_id long, doc_id long"), "doc_id")
    assert sorted(r["doc_id"] for r in out.collect()) == [5, 7]
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_hybrid_search_looks_for_asked_types_and_fetches_few_texts(spark, monkeypatch):
    chunks = spark.createDataFrame([(k, f"word{k % 5} cream {k} %", ["toner"] if k % 3 == 0 else []) for k in range(40)], "doc_id long, text string, tags array<string>")
    vectors = spark.createDataFrame([(k, [1.0, float(k % 7)]) for k in range(40)], "doc_id long, embedding array<float>")
    queries = spark.createDataFrame([(1, "word1 cream", [1.0, 2.0], []), (2, "word2", [1.0, 0.0], ["toner"])], "query_id long, text string, vector array<float>, product_types array<string>")
    runs, fetched, dense, texts = [], [], retrieval.dense_top_k, retrieval.texts_of
    monkeypatch.setattr(retrieval, "dense_top_k", lambda *a, **k: runs.append(a) or dense(*a, **k))
    monkeypatch.setattr(retrieval, "texts_of", lambda *a: fetched.append(a) or texts(*a))
    both = retrieval.hybrid_search(chunks, vectors, queries).collect()
    assert len(runs) == 2 and len(fetched) == 1  # all vectors, and those of toners
    assert {r["query_id"] for r in both} == {1, 2} and len(both) == 20
    alone = retrieval.hybrid_search(chunks, vectors, queries.filter("query_id = 1")).collect()
    assert len(runs) == 3 and sorted(map(tuple, alone)) == sorted(tuple(r) for r in both if r["query_id"] == 1)
