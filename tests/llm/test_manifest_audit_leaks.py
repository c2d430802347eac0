"""Merkle manifest, filter audit and decontamination against plain versions, and inputs with clashing columns."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from saltern.llm import decontaminate, exact_dedup, filter_audit, language_id, lm_scoring, merkle, ngram_join

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes, n):
    """Levels from the leaves to the root."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + n]) for k in range(0, len(out[-1]), n)])
    return out


def siblings(levels, at, n):
    out = []
    for level in levels[:-1]:
        low = at - at % n
        out.append((level[low:at], level[at + 1 : low + n]))
        at //= n
    return out


def plain_manifest(rows, n, tamper):
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r: h(*[field(x) for x in (r[0], r[3], r[2], r[4], r[1])])
    trees = {}
    for source in {r[3] for r in rows}:
        own = sorted((r for r in rows if r[3] == source), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[source] = own, plain_tree([leaf(r) for r in own], n)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    top = plain_tree([trees[s][1][-1][0] for s in order], n)
    out = []
    for at, source in enumerate(order):
        own, levels = trees[source]
        for k, r in enumerate(own):
            path = siblings(levels, k, n) + siblings(top, at, n)
            acc = leaf(tamper(r))
            for left, right in path:
                acc = h(*left, acc, *right)
            out.append((r[0], leaf(r), levels[-1][0], top[-1][0], h(*[x for a, b in path for x in a + b]), acc, acc == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize(("n", "range_rows"), [(3, 7), (2, 1000)])
def test_manifest_is_plain(spark, monkeypatch, n, range_rows):
    monkeypatch.setattr(merkle, "RANGE_ROWS", range_rows)
    rng = random.Random(n)
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, "", "a\nb", "ä\n" * 3, "plain"]), rng.choice([None, "de"]), rng.choice([None, "", "hot", "hot", "hot", "ä", "z"]), rng.choice([None, 3])) for _ in range(80)]
    rows += [rows[0]] * 5 + [(1, "alone", "en", "only", 5)]
    docs = spark.createDataFrame(rows, COLUMNS)
    drop = lambda columns: {"text": F.when(columns["doc_id"] % 2 == 0, F.replace(columns["text"], F.lit("\n"), F.lit(""))).otherwise(columns["text"])}
    out = merkle.verify(merkle.manifest(docs, fanout=n, tampered=drop))
    got = out.select("id", "leaf", "subroot", "root", F.sha2(merkle.proof(F.col("path")).cast("binary"), 256), "folded_root", "verified").collect()
    plain = plain_manifest(rows, n, lambda r: (r[0], r[1].replace("\n", "") if r[1] and r[0] is not None and r[0] % 2 == 0 else r[1], *r[2:]))
    assert sorted(map(tuple, got), key=str) == plain and 0 < sum(r[-1] for r in plain) < len(plain)


def test_manifest_edges(spark):
    assert merkle.verify(merkle.manifest(spark.createDataFrame([], COLUMNS))).count() == 0
    one = merkle.verify(merkle.manifest(spark.createDataFrame([(None, None, None, None, None)], COLUMNS))).collect()
    assert [(r["leaf"], r["root"], r["path"], r["verified"]) for r in one] == [(h("-----"), h("-----"), [], True)]
    wide = spark.createDataFrame([(1, "t", "de", "s", 1, 5, "x", 7)], COLUMNS + ", tree int, _metadata string, `a.b` int")
    assert merkle.verify(merkle.manifest(wide)).first()["verified"]
    with pytest.raises(ValueError):
        merkle.manifest(wide, fanout=1)


TEXTS = ["", None, " ", "a", "a a A", "\tx\ny\x0bz\x0c\r", "ä ö ü ß", "#5 %", "日本 日本", "ABC def", "w " * 300, "long" * 5000, "😀 😀 😀x"]


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(re.findall("[#$%&*|]", text)), len(text)


@pytest.mark.parametrize("slice_bytes", [1, 50, 1 << 20])
def test_measures_are_plain(slice_bytes):
    rng = random.Random(slice_bytes)
    texts = TEXTS + ["".join(rng.choice("aab  \n#Zé日") for _ in range(rng.randrange(40))) for _ in range(300)]
    for column in (pa.array(texts), pa.array(["skipped", *texts]).slice(1)):
        parts = [filter_audit.Measures().measure(*x) for x in filter_audit._slices(column, slice_bytes)]
        got = list(zip(*[np.concatenate([p[c] for p in parts]).tolist() for c in filter_audit.COUNTS], strict=True))
        assert got == [plain_counts(t) for t in texts]
    assert list(filter_audit._slices(pa.array([], pa.string()), 10)) == []


def test_collisions_of_words_are_verified(monkeypatch):
    monkeypatch.setattr(filter_audit.Measures, "hashes", lambda self, data, starts, ends: (ends - starts).astype(np.uint64))
    texts = ["ab cd ab", "x y x z", "same same", "one"]
    parts = [filter_audit.Measures().measure(*x) for x in filter_audit._slices(pa.array(texts), 1000)]
    assert np.concatenate([p["distinct"] for p in parts]).tolist() == [2, 3, 1, 1]


def test_audit_is_plain(spark):
    rng = random.Random(5)
    long = " ".join(f"w{k}" for k in range(210))
    rows = [(rng.choice([None, *range(40)]), rng.choice([long, long + " #", long.upper(), long + " a" * 300, "short", "", None, "$ X"]), rng.choice(["de", "en", None, ""])) for _ in range(120)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 40, 2)] + [(0, 1, 0), (None, 1, 1)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(map(tuple, filter_audit.audit(filter_audit.masks(docs, marks)).collect()))
    good, toxic = {k for k, q, _ in labels if q == 1 and k is not None}, {k for k, _, t in labels if t == 1 and k is not None}
    failed = []
    for key, text, part in rows:
        n, distinct, capitals, symbols, points = plain_counts(text)
        seen = any(k is not None and key is not None and k < key and (t or "") == (text or "") for k, t, _ in rows)
        failed.append((part or "", key, {f for f, x in zip("ABCDE", (n < 200, 100 * distinct < 50 * n, 100 * capitals > 3 * points, symbols > 0, seen), strict=True) if x}))
    want, removed = {}, Counter()
    for part in {p for p, _, _ in failed}:
        for order in map("".join, permutations("ABCDE")):
            left = [x for x in failed if x[0] == part]
            for step, f in enumerate(order, 1):
                out = [x for x in left if f in x[2]]
                fails = [x for x in failed if x[0] == part and f in x[2]]
                left = [x for x in left if f not in x[2]]
                removed[part, f] += len(out)
                want[part, order, step] = [len(left), len(out), len(fails) - len(out), sum(x[2] == {f} for x in fails), sum(x[1] in good for x in out), sum(x[1] in toxic for x in out)]
    assert got == sorted((*k, *v, removed[k[0], k[1][k[2] - 1]]) for k, v in want.items())
    assert filter_audit.audit(filter_audit.masks(docs.limit(0), marks.limit(0))).count() == 0


def plain_hits(text, items, n):
    cut = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, found = cut(text), set(), set()
    for item, body in items:
        own = cut(body)
        size = min(n, len(own))
        for k in range(len(own) - size + 1 if own else 0):
            for at in range(len(words) - size + 1):
                if words[at : at + size] == own[k : k + size]:
                    hit |= set(range(at, at + size))
                    found |= {str(item)} if item is not None else set()
    return len(words), sorted(hit), sorted(found)


@pytest.mark.parametrize(("n", "limit"), [(10, 1 << 25), (3, 200), (4, 1 << 25)])
def test_leaks_are_plain(spark, monkeypatch, n, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", limit)
    rng = random.Random(n)
    text = lambda size: "".join(rng.choice(["a", "B", "É", "é", "İ", "Σ"]) + rng.choice([" ", ", ", "\n", "'"]) for _ in range(size))
    items = [(k, text(rng.randrange(4, 14))) for k in range(6)] + [(2, text(8)), (None, text(12)), (7, None), (8, "..."), (9, "x1 ü2"), (10, text(5)), (11, text(5))]
    rows = [(k, text(rng.randrange(30))) for k in range(60)] + [(None, "X1  Ü2 x1-ü2"), (5, None), (5, ""), (6, items[0][1]), (6, items[0][1]), (70, "a b " * 3000)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((str(r["id"]), r["n_words"], r["hit"], r["items"]) for r in decontaminate.scan(docs, bench, n).collect())
    want = [(key, body, *plain_hits(body, items, n)) for key, body in rows]
    assert got == sorted((str(w[0]), *w[2:]) for w in want) and any(w[3] for w in want)
    whole = decontaminate.decontaminate(docs, bench, "documents", n).collect()
    assert Counter(map(tuple, whole)) == Counter((w[0], w[1]) for w in want if not w[3])
    clean = Counter((r["doc_id"], r["text"]) for r in decontaminate.decontaminate(docs, bench, "spans", n).collect())
    piece = lambda body: re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+[^0-9A-Za-z\x80-\U0010ffff]*", body)
    assert clean == Counter((w[0], "".join(p for k, p in enumerate(piece(w[1])) if k not in set(w[3])) if w[3] else w[1]) for w in want)


def test_leak_edges(spark):
    docs, items = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert sorted((r["id"], r["n_words"], r["hit"], r["items"]) for r in decontaminate.scan(docs, items).collect()) == [(1, 2, [], []), (2, 0, [], [])]
    assert decontaminate.scan(docs.limit(0), items).count() == 0 and decontaminate.decontaminate(docs, items).count() == 2
    with pytest.raises(ValueError):
        decontaminate.decontaminate(docs, items, "lines")


def test_input_columns_come_back(spark, tmp_path):
    """Columns of the operators' own names, of Spark's hidden column, and names with dots."""
    texts = ["the same words stand here for everyone to read today"] * 2 + ["another text with other words that nobody else has written"]
    rows = [(k, t, "de", "s", 3, f"at{k}", f"spot{k}", f"meta{k}", k * 10, f"c{k}") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, COLUMNS + ", saltern_at string, saltern_spot string, _metadata string, `a.b` int, c0 string")
    docs.write.parquet(str(tmp_path / "docs"))
    for table in (docs, spark.read.parquet(str(tmp_path / "docs"))):
        for out in (exact_dedup.deduplicate(table), ngram_join.deduplicate(table), decontaminate.decontaminate(table, spark.createDataFrame([(1, texts[0])], "item_id long, text string"), "documents")):
            assert out.columns == docs.columns and {tuple(r) for r in out.collect()} <= set(rows)
        assert {tuple(r) for r in exact_dedup.deduplicate(table).collect()} == {rows[0], rows[2]}
        assert lm_scoring.score(table, fold=None).count() == 3
        assert exact_dedup.decisions(table).count() == 3 and ngram_join.join(table, n=4, num=85, den=100).count() == 3
        assert {r["lang_pred"] for r in language_id.predict(table, language_id.fit(table, fold=None)).collect()} == {"de"}


def test_numerals_are_no_letters_and_languages_may_be_undetermined(spark):
    rows = [(k, f"der die das und nicht {k}" if k % 2 else f"the of and with this {k}", "de" if k % 2 else "und", "a", 9) for k in range(40)]
    odd = [(100, "½ ²", "de", "a", 3), (101, "①", "und", "a", 1), (102, "Ⅷ", "und", "a", 1), (103, "", "und", "a", 0)]
    docs = spark.createDataFrame(rows + odd, COLUMNS)
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(docs, language_id.fit(docs, fold=None)).collect()}
    assert all(out[r[0]] == ("und", 0.0) for r in odd) and all(out[r[0]][0] == r[2] for r in rows)
    assert {r["doc_id"] for r in corpus_pipeline.language_stage(spark, docs, "").collect()} == {r[0] for r in rows}


def test_language_samples_are_cut_in_spark(spark, monkeypatch):
    """No more samples than asked for reach the driver, however many languages there are."""
    docs = spark.createDataFrame([(k, f"text of number {k}", f"l{k % 50}", "a", 9) for k in range(2000)], COLUMNS)
    seen = []
    monkeypatch.setattr(language_id, "Model", lambda samples, langs: seen.append(len(samples)))
    plan = []
    monkeypatch.setattr(type(docs), "toArrow", lambda self, f=type(docs).toArrow: plan.append(f(self)) or plan[-1])
    language_id.fit(docs, fold=None, max_sample=60)
    assert seen == [50] and [t.num_rows for t in plan] == [50]
