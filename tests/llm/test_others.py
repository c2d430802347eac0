"""Vectors, chats, components, the pipeline, and queries against their SQL."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from saltern.llm import chat_format, embedding_dedup, queries
from saltern.llm.components import components

TABLES = ["documents", "embeddings", "labels", "conversations", "benchmark", "pages"]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    own = queries.queries()[name](spark, sf)
    columns = sorted(own.columns)
    got = sorted(tuple(map(str, r)) for r in own.select(*columns).collect())
    assert got == sorted(tuple(map(str, r)) for r in db.sql(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall())


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, k) for k in range(1001, 1100)] + [(k, k + 1) for k in range(2000, 2040)] + [(5000, 5000)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_vectors(rows, threshold):
    unit = []
    for _, v, label in rows:
        x = np.array(v if v is not None and None not in v else [np.nan], float)
        unit.append(x / np.linalg.norm(x) if label is not None and len(x) and np.isfinite(x).all() and x.any() else None)
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(unit):
        for j in range(i):
            b = unit[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b >= threshold:
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((r[0], links[i], least[find(i)]) for i, r in enumerate(rows))


def test_vectors_are_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "ROWS", 16)
    rng, rows = np.random.default_rng(5), []
    for g in range(25):
        base = rng.normal(size=48)
        for _ in range(12):
            rows.append((len(rows), (base + rng.normal(size=48) * rng.uniform(0, 0.45)).tolist(), g % 3))
    rows += [(len(rows) + k, rows[k][1], rows[k][2]) for k in range(10)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 48, 1), (n + 2, [float("nan")] + [1.0] * 47, 1), (n + 3, rows[0][1], None), (n + 4, [None] + [1.0] * 47, 1), (n + 5, [], 1), (n + 6, [1.0, 2.0], 1), (n + 7, [1.0, 2.0], 1), (n + 8, [float("inf")] * 48, 1), (n + 8, [2.0, 4.0], 1)]
    data = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, label int, node string, copies string")
    out = sorted((r["id"], r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(data, threshold=0.93).collect())
    want = brute_vectors([(a, None if b is None else [None if x is None else float(np.float32(x)) for x in b], c) for a, b, c in rows], 0.93)
    found, all_ = sum(x[1] for x in out), sum(x[1] for x in want)
    assert found >= 0.99 * all_ and all(g[1] <= w[1] for g, w in zip(out, want, strict=True))
    assert out == want
    assert embedding_dedup.near_duplicates(data.limit(0)).count() == 0


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 64))
    y = embedding_dedup.hadamard(x)
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)) and np.allclose(embedding_dedup.hadamard(y), x)


def cheapest(roles):
    best = [None]

    def go(k, state, cost):
        if best[0] is not None and cost >= best[0]:
            return
        if k == len(roles):
            total = cost + chat_format.END[state]
            best[0] = total if best[0] is None else min(best[0], total)
            return
        for before, new, price, _, _ in chat_format.MOVES:
            if before == state:
                go(k + 1, new, cost + price + (0 if new == roles[k] else chat_format.RELABEL))

    go(0, chat_format.START, 0)
    return best[0]


@pytest.mark.parametrize("rows", [50_000, 7, 2])
def test_chat_repair_is_cheapest(spark, monkeypatch, rows):
    monkeypatch.setattr(chat_format, "SEGMENT_ROWS", rows)
    rng, turns, want = random.Random(3), [], {}
    for c in range(40):
        roles = [rng.choice(["system", "user", "assistant", "bot", None]) for _ in range(rng.randint(1, 7))]
        turns += [(c, t, r, None if t == 3 else f"t{c}.{t} <|im_end|>", "x", 1) for t, r in enumerate(roles)]
        want[c] = cheapest([chat_format._role(r) for r in roles])
    data = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, pos string, seg int")
    out = chat_format.repair(data).persist()
    whole = {r["conv"]: r for r in chat_format.rendered(out).collect()}
    assert out.count() == len(turns) and {c: r["cost"] for c, r in whole.items()} == want
    for r in whole.values():
        text = r["rendered"]
        parts = [p.split("\n")[0] for p in text.split("<|im_start|>")[1:]]
        assert text.count("<|im_start|>") == text.count("<|im_end|>\n") == text.count("<|")/2
        assert parts[-1] == "assistant" and all((a, b) in {("system", "user"), ("user", "assistant"), ("assistant", "user")} for a, b in zip(parts, parts[1:]))


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert chat_format.repair(spark.createDataFrame([], schema)).count() == 0
    out = chat_format.repair(spark.createDataFrame([(None, None, None, None), (None, None, None, None), (1, 0, "user", "same"), (1, 0, "user", "same"), (2, 0, " Assistant ", "hi")], schema)).collect()
    assert len(out) == 5 and next(r for r in out if r["conv"] == 2)["rendered"].startswith("<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\nhi")
    assert [r["action"] for r in out if r["conv"] == 1] == ["append", "merge"]


def test_pipeline_stages(spark, tmp_path):
    rows = [(k, f"Das ist ein Text mit der Nummer {k} und noch mehr Worten darin {k * 7}" if k % 2 else f"This is a text with number {k} and with some more words in it {k * 5}", "de" if k % 2 else "en", f"src{k % 4}", 60) for k in range(60)]
    rows += [(100, rows[0][1] + "  ", "en", "src0", 70), (101, None, "en", "src0", 0), (102, "123 456", "en", "src0", 7), (103, LONG_A, "en", "src1", 9), (104, LONG_A + " tail", "en", "src1", 9)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, d)
        docs.write.parquet(f"{d}/{k}")
        docs = spark.read.parquet(f"{d}/{k}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r["doc_id"] for r in docs.collect()}
    assert kept["language_id"] == {r[0] for r in rows} - {101, 102}
    assert kept["exact_dedup"] == kept["language_id"] - {0}
    assert kept["ngram_join"] == kept["exact_dedup"] - {104}
    assert kept["source_mixing"] <= kept["ngram_join"]
    out = corpus_pipeline.run(spark, d).collect()
    assert {r["doc_id"] for r in out} == kept["source_mixing"] and all(len(r["ids"]) == r["n_tokens"] for r in out)


LONG_A = "The quick brown fox and the lazy dog: " + " ".join(f"story{k}" for k in range(80))
