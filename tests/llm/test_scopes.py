"""Cases in which a part of a training-data operator's job was once left out."""

import corpus_pipeline
from saltern.llm import secret_scan


def test_scope_alone_links(spark):
    run = "aB3xY9" * 80
    body = "\n".join("aB3+" * 16 for _ in range(26))
    rows = [
        (1, run + "\nclient_id: abc"),
        (2, "key_id: abcd\n" + body),
        (3, "client_id: abcd\n" + "aB3xY9" * 6 + "\n" + "word " * 200 + "\nhttps://h.example/v1"),
        (4, "client_id: abcd\n" + "word " * 200 + "\n\n" + run),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: [s["kind"] for s in r["linked"]] for r in secret_scan.scan(docs).collect()}
    assert got == {1: ["secret", "id"], 2: ["id"] + ["secret"] * 26, 3: ["id", "secret", "endpoint"], 4: []}


def test_language_stage_without_a_model(spark):
    rows = [(1, "plain words", None, "a", 11), (2, "12 345 !!", None, "a", 9), (3, None, None, "a", 0), (4, "слово", None, "b", 5), (5, "x² ", None, "b", 3), (6, "_1", None, "b", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.language_stage(spark, docs, "").collect()) == [1, 4, 5]
