"""Heads in texts by fingerprints, against plain containment."""

import random

import pytest

from saltern.operators import conversations, fingerprints, rules


def test_runs_of_a_part_are_runs_of_the_whole():
    rng = random.Random(5)
    text = "".join(rng.choice("ab cé𝄞") for _ in range(700))
    for level, (k, w) in enumerate(fingerprints.LEVELS):
        whole = set(fingerprints.selected(text, level).tolist())
        for _ in range(40):
            n = rng.randrange(k + w - 1, k + w + 30)
            at = rng.randrange(len(text) - n)
            part = fingerprints.selected(text[at : at + n], level)
            assert len(part) and set(part.tolist()) <= whole
        assert len(fingerprints.selected(text[: k + w - 2], level)) == 0


def test_strides_do_not_change_what_is_selected(monkeypatch):
    text = "".join(random.Random(2).choice("abcd ") for _ in range(5000))
    whole = [fingerprints.selected(text, level).tolist() for level in range(5)]
    monkeypatch.setattr(fingerprints, "STRIDE", 97)
    assert [fingerprints.selected(text, level).tolist() for level in range(5)] == whole


def test_equals_brute_force(spark):
    rng = random.Random(11)
    words = ["the", "of", "cream", "wax", "éther", "x", "a b", "glycerin", "…"]
    texts = [(k, "the " + " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for k in range(120)]
    texts += [(None, "the wax of the cream"), (500, None), (501, ""), (3, texts[3][1]), (3, "another text of the key: the wax")]
    heads = [t[s : s + n] for (_, t), n in zip(texts, [1, 2, 3, 4, 5, 7, 8, 11, 15, 16, 20, 27, 28, 29, 40, 80] * 6) if t for s in (0, 9)]
    heads += ["the", "nowhere at all in any of the texts, not once", "", None, "q", heads[0]]
    got = fingerprints.holding(spark.createDataFrame(texts, "key long, text string"), spark.createDataFrame([(h,) for h in heads], "head string"))
    want = {(k, h) for k, t in texts for h in heads if k is not None and t and h and h in t}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


@pytest.mark.parametrize("heads", [[], [("",)]])
def test_nothing_asked(spark, heads):
    texts = spark.createDataFrame([(1, "a")], "key long, text string")
    out = fingerprints.holding(texts, spark.createDataFrame(heads, "head string"))
    assert out.columns == ["key", "head"] and out.count() == 0
    assert fingerprints.holding(texts.limit(0), spark.createDataFrame([("a",)], "head string")).count() == 0


def test_quotes_by_their_first_characters(spark):
    chunks = spark.createDataFrame([("c1", "Mix  the\nwater phase and heat it to seventy degrees, slowly."), ("c2", "Water."), ("c3", None)], "key string, text string")
    quotes = spark.createDataFrame([(1, "mix the WATER phase and heat it to seventy degrees at once"), (2, "water"), (3, "oil"), (4, None), (5, "  ")], "quote_id long, quote string")
    got = {(r["quote_id"], r["key"]) for r in conversations.find_quotes(quotes, chunks).collect()}
    assert got == {(1, "c1"), (2, "c1"), (2, "c2")}


def test_drift_looks_at_a_records_own_chunks(spark):
    source = "Phase A: water and glycerin, heated to seventy degrees and then stirred for an hour until clear."
    records = spark.createDataFrame([("same", source), ("other", source), ("bare", source), ("blank", " "), ("none", None), ("short", "Oil"), ("twice", source), ("twice", "gone")], "id string, text string")
    chunks = spark.createDataFrame(
        [("same", "x"), ("same", "Title\n" + source.upper()), ("other", source[1:]), ("other", None), ("blank", "x"), ("none", "x"), ("short", "No  OIL here"), ("twice", source), (None, source)], "id string, text string"
    )
    got = {tuple(r) for r in rules.drifted(records, chunks).collect()}
    head = source.lower()[:80]
    assert got == {("other", head), ("twice", "gone")}


def test_drift_of_records_with_few_heads_needs_no_fingerprints(spark, monkeypatch):
    rng = random.Random(3)
    words = ["oil", "wax", "water", "aloe", "zinc", "Ä"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    records = [(k % 9, line(rng.randrange(0, 4))) for k in range(60)] + [(None, "oil"), (70, "oil"), (71, None)]
    chunks = [(k % 10, line(rng.randrange(0, 9)).upper()) for k in range(40)] + [(None, "oil"), (3, None), (71, "wax")]
    want = {(i, t.lower()) for i, t in records if i in {c for c, _ in chunks} - {None} and t and not any(c == i and x and t.lower() in x.lower() for c, x in chunks)}
    frames = spark.createDataFrame(records, "id long, text string"), spark.createDataFrame(chunks, "id long, text string")
    assert {tuple(r) for r in rules.drifted(*frames, direct=2).collect()} == want  # most ids through fingerprints

    def refuse(*_, **__):
        raise AssertionError("texts were cut into fingerprints")

    monkeypatch.setattr(rules, "holding", refuse)
    rows = [tuple(r) for r in rules.drifted(*frames).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
