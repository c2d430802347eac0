"""Structured search over a table of questions against a plain version, question by question."""

import random

import pytest
from pyspark.sql import functions as F

from saltern.plans import question_search as Q
from saltern.plans import ranking
from saltern.plans.intent import Brief

RECIPE = "id string, name string, product_types array<string>, doc_id string, confidence double, source_text string, names array<string>, ingredients array<struct<raw_name:string,normalized_name:string>>, cost_per_kg double, compliance string"
WORDS = ["silk", "veil", "night", "hand", "baby", "fresh", "tube-dispensed", "glow"]
KINDS = ["cream", "shampoo", "lotion", "anti_dandruff"]
LINES = ["water", "glycerin", "ultrez 20 polymer", "salicylic acid", "vitamin e", "cetyl alcohol"]


@pytest.fixture(scope="module")
def catalogue(spark):
    rng = random.Random(8)
    rows = []
    for k in range(120):
        kind, names = rng.sample(KINDS, rng.choice([1, 1, 2])), rng.sample(LINES, rng.choice([1, 2, 3, 4]))
        title = " ".join(rng.sample(WORDS, 2)).title() + " " + kind[0].replace("_", "-").title()
        rows.append((f"r{k:03}", title, kind, f"{k % 3}doc", round(rng.random(), 3), rng.choice(["", None, "see the Silk Veil Cream"]), names, [{"raw_name": n.title(), "normalized_name": n} for n in names], rng.choice([None, 1.0, 5.0]), rng.choice(["pass", "fail", "warn"])))
    return spark.createDataFrame(rows, RECIPE).cache()


QUESTIONS = [
    ("q1", "a hand cream for the night", ["cream"], [], []),
    ("q2", "anti-dandruff shampoo", ["anti_dandruff", "shampoo"], [], []),
    ("q3", "what has glycerin", [], ["glycerin", "Vitamin E"], []),
    ("q4", "the Silk Veil Cream", ["cream"], [], ["Silk Veil Cream"]),
    ("q5", "three types at once", ["cream", "lotion", "shampoo"], [], []),
    ("q6", None, None, None, None),
    ("q7", "unknown", ["soap"], ["zzz acid"], ["Glow Baby Lotion", "Nothing Like It"]),
]


def plain(rows, q, limit, brief):
    """The pools of one question, by loops."""
    _, text, types, required, titles = q
    types, required, titles = types or [], required or [], titles or []
    best = lambda keep, n: {r["id"] for r in sorted((r for r in rows if keep(r)), key=lambda r: (-r["confidence"], r["id"]))[:n]}
    words = lambda t: [w for w in __import__("re").findall("[A-Za-z]{4,}", t)]
    filed = ["anti_dandruff"] if {"anti_dandruff", "shampoo"} <= set(types) else types
    out = best(lambda r: set(filed) <= set(r["product_types"]), 12 * limit)
    if not out:
        for t in types:
            out |= best(lambda r, t=t: t in r["product_types"], 6 * limit)
    needles = ["hand cream", "tube-dispensed", "hand and nail", "hand"] if "hand cream" in (text or "") else []
    for t in titles[:4]:
        needles += [t[:40], *[w for w in words(t) if w.lower() not in ("cream", "lotion", "shampoo", "formula")][:2]]
    for n in needles:
        out |= best(lambda r, n=n: n.lower() in r["name"].lower(), 4 * limit)
    for t in required[:4]:
        first = t.split()[0]
        if len(first) >= 3:
            later = [w for w in words(t) if w.lower() != first.lower()][:1]
            for n, m in [(first, 6), *[(w, 4) for w in later]]:
                out |= best(lambda r, n=n: any(n.lower() in x["raw_name"].lower() or n.lower() in x["normalized_name"] for x in r["ingredients"]), m * limit)
    return out


@pytest.mark.parametrize(("limit", "brief"), [(5, Brief()), (1, Brief(banned=("Cetyl",), markets=("EU",), cost_target=2.0))])
def test_search_is_one_question_at_a_time(spark, catalogue, limit, brief):
    questions = spark.createDataFrame(QUESTIONS, "query_id string, text string, types array<string>, required array<string>, titles array<string>")
    got = {}
    found = Q.search(questions.union(questions), catalogue, limit, brief, trusted=("1",))
    for r in sorted(found.collect(), key=lambda r: r["place"]):
        got.setdefault(r["query_id"], []).append((r["id"], round(r["score"], 6)))
    rows = [r.asDict(recursive=True) for r in catalogue.filter(~F.exists("names", lambda x: x.contains("cetyl")) if brief.banned else F.lit(True)).collect()]
    for q in QUESTIONS:
        offered = plain(rows, q, limit, brief)
        part = catalogue.filter(F.col("id").isin(sorted(offered) or [""]))
        one = ranking.structured_search(part, q[2] or [], limit, Brief(markets=brief.markets, cost_target=brief.cost_target), required=q[3] or [], titles=q[4] or [], question=q[1] or "", trusted=("1",))
        assert got.get(q[0], []) == [(r["id"], round(r["score"], 6)) for r in one.collect()], q
    hints = {r["query_id"]: r["hint"] for r in Q.hints(found).collect()}
    assert set(hints) == set(got) and hints.get("q7", "fallback") != "direct"


def test_comparisons(spark, catalogue):
    rows = [("c1", ["Silk Veil Cream", "Night Hand Shampoo"]), ("c2", ["Silk Veil Cream", "Silk Veil Cream", "Zzzz Yyyy Lotion"]), ("c3", ["Only One"]), ("c4", None)]
    questions = spark.createDataFrame(rows, "query_id string, targets array<string>")
    out = Q.compare(questions, catalogue).collect()
    by = {q: [r for r in sorted(out, key=lambda r: r["pos"]) if r["query_id"] == q] for q in ("c1", "c2", "c3", "c4")}
    assert len(by["c1"]) == 2 and len({r["id"] for r in by["c1"]}) == 2 and not by["c3"] and not by["c4"]
    assert [r["pos"] for r in by["c2"]] == [0, 2] and by["c2"][0]["id"] == by["c1"][0]["id"]
    from saltern.operators.names import same_title

    assert spark.createDataFrame([(by["c1"][0]["name"],)], "n string").select(same_title(F.lit("Silk Veil Cream"), F.col("n"))).first()[0]


def test_questions_are_read(spark):
    rows = spark.createDataFrame([(1, "Compare the Silk Veil Cream and the Baby Shampoo"), (2, "a shampoo with glycerin")], "query_id int, text string")
    out = {r["query_id"]: r for r in Q.with_questions(rows).collect()}
    assert out[1]["compare"] == ["Silk Veil Cream", "Baby Shampoo"] and set(out[1]["compare"]) <= set(out[1]["titles"]) and out[2]["required"] == ["glycerin"] and out[2]["types"] == ["shampoo"]


def test_nothing(spark, catalogue):
    questions = spark.createDataFrame([], "query_id string, text string, types array<string>, required array<string>, titles array<string>")
    assert Q.search(questions, catalogue).count() == 0 and Q.search(spark.createDataFrame(QUESTIONS, questions.schema), catalogue.limit(0)).count() == 0
