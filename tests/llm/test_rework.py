"""Recovery, hot keys, learned groups and brute-force versions of single operators."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from test_texts import docs

from saltern.llm import exact_dedup, language_id, lm_scoring, queries, secret_scan, sentencepiece_codec, source_mixing, toxicity


def outcome(df):
    return {r["id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in df.collect()}


def test_exact_is_tried_again(spark, tmp_path, monkeypatch):
    """A path with a space, the same input twice, and a failure between arrivals and state."""
    path, state = str(tmp_path / "in put+%20"), str(tmp_path / "state")
    docs(spark, [(1, "a b"), (2, "c"), (3, "ab")]).coalesce(1).write.parquet(path)
    stream = exact_dedup._stream
    monkeypatch.setattr(exact_dedup, "_stream", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        exact_dedup.decisions(spark.read.parquet(path), state_dir=state)
    monkeypatch.setattr(exact_dedup, "_stream", stream)
    want = {1: (1, 2, True), 2: (2, 1, True), 3: (1, 2, False)}
    for _ in range(2):
        assert outcome(exact_dedup.decisions(spark.read.parquet(path), state_dir=state)) == want
    docs(spark, [(4, "c")]).coalesce(1).write.parquet(path + "2")
    assert outcome(exact_dedup.decisions(spark.read.parquet(path + "2"), state_dir=state)) == want | {2: (2, 2, True), 4: (2, 2, False)}


def test_exact_by_shuffle(spark, monkeypatch):
    rows = [(k, f"text {k % 7}", "en", "a") for k in range(40)]
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 0)
    assert sum(r["kept"] for r in exact_dedup.decisions(docs(spark, rows)).collect()) == 7
    assert sorted(r["doc_id"] for r in exact_dedup.deduplicate(docs(spark, rows)).collect()) == list(range(7))


def test_zero_weights_are_redistributed(spark):
    leaves = spark.createDataFrame([("d0", "xx", "a", 1000), ("d1", "en", "a", 1000), ("d1", "xx", "a", 500), ("d2", "en", "b", 100)], "domain string, lang string, source string, supply long")
    got = {(r["domain"], r["lang"]): r["budget"] for r in source_mixing.budgets(leaves, weights={"lang": {"xx": 0.0}}, total=800, max_epochs=1).collect()}
    assert got == {("d0", "xx"): 0, ("d1", "en"): 700, ("d1", "xx"): 0, ("d2", "en"): 100}
    none = source_mixing.budgets(leaves, weights={"lang": {"xx": 0.0, "en": 0.0}}, total=800).collect()
    assert [r["budget"] for r in none] == [0, 0, 0, 0]


def test_mix_by_shuffle_and_clashing_columns(spark, monkeypatch):
    rows = [(k, "w " * (1 + k % 5), "en" if k % 2 else "de", f"s{k % 3}") for k in range(100)]
    frame = docs(spark, rows).selectExpr("*", "'old' AS mix_domain", "1 AS mix_epoch")
    want = Counter((r["doc_id"], r["mix_epoch"]) for r in source_mixing.mix(frame).collect())
    monkeypatch.setattr(source_mixing, "BROADCAST_LEAVES", 0)
    out = source_mixing.mix(frame).collect()
    assert Counter((r["doc_id"], r["mix_epoch"]) for r in out) == want and all(r["mix_domain"].startswith("d") for r in out)


def test_long_texts_are_scanned_in_time(spark):
    """Many spans and blank lines in one text; scopes as a plain count says."""
    text = "".join(f"user: name{k}\npassword: secret{k:05d}\n\n" for k in range(6000)) + "\n \n" * 6000
    row = secret_scan.scan(docs(spark, [(1, text, "en", "a"), (1, text, "en", "a")])).collect()
    assert len(row) == 2 and all(len(r["base"]) == 6000 and len(r["linked"]) == 6000 for r in row)
    at = text.index("password: secret04321")
    assert (at, at + 21) in {(s["start"], s["end"]) for s in row[0]["base"]}
    apart = "user: name1\n\npassword: secret00001\n\nuser: name2 password: secret00002"
    (one,) = secret_scan.scan(docs(spark, [(1, apart, "en", "a")])).collect()
    assert [apart[s["start"] : s["end"]] for s in one["linked"]] == ["user: name2"] and len(one["base"]) == 2


def test_repeated_rows_of_a_language_model(spark):
    rows = [(1, "a b a", "en", "a")] * 5 + [(2, "b c", "en", "a"), (None, "c", "en", "a")]
    out = lm_scoring.score(docs(spark, rows), fold=None, order=3).collect()
    assert len(out) == 7 and {r["train_tokens"] for r in out} == {5 * 4 + 3}
    assert len({r["score"] for r in out if r["id"] == 1}) == 1


def test_corpus_table_and_chunks_outside(spark, sf):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    frame = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    with open(queries.piece_model(), "rb") as f:
        ids, texts = sentencepiece_codec.corpus_table(frame, f.read(), rows=30)
    marked = Counter(c for r in frame.collect() for c in sentencepiece_codec._CHUNK.findall("▁" + (r["text"] or "").replace(" ", "▁")) if r["text"] and len(c) <= sentencepiece_codec.TABLE_CHUNK)
    assert set(ids) == {c for c, _ in sorted(marked.items(), key=lambda x: (-x[1], x[0].encode()))[:30]} == set(texts)
    for r in sentencepiece_codec.encode_decode(frame, queries.piece_model(), table_rows=30).collect():
        want = sp.encode(r["text"] or "")
        assert list(r["ids"]) == want and r["decoded"] == sp.decode(want)


# Language ID by brute force


def grams(text):
    text = text.lower()
    return {text[k : k + n] for n in range(1, 4) for k in range(len(text) - n + 1)}


@pytest.mark.parametrize("cells", [8 << 20, 50])
def test_kernel_machine_is_brute_force(monkeypatch, cells):
    """Kernel, Nystrom features and one-versus-rest ridge regression, written out."""
    monkeypatch.setattr(language_id, "CELLS", cells)
    rng = random.Random(5)
    words_ = {"de": "der die und nicht äß", "en": "the of and with this", "fr": "les des où été"}
    langs = [rng.choice(sorted(words_)) for _ in range(60)]
    texts = [" ".join(rng.choice(words_[x].split()) for _ in range(rng.randrange(2, 9))) for x in langs]
    model = language_id.Model(texts, langs, landmarks=20)
    order = sorted((langs[: i + 1].count(x), x, i) for i, x in enumerate(langs))
    marks = [texts[i] for _, _, i in order[:20]]
    kernel = lambda a, b: np.array([[len(grams(x) & grams(y)) / math.sqrt(len(grams(x)) * len(grams(y))) for y in b] for x in a])
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    good = values > 1e-8 * values.max()
    to_feature = vectors[:, good] / np.sqrt(values[good])
    x = kernel(texts, marks) @ to_feature
    weight = np.array([len(langs) / 3 / langs.count(lang) for lang in langs])
    new = ["der und", "the and été", "où"]
    got = model.score(new)
    for c, lang in enumerate(sorted(words_)):
        y = np.where(np.array(langs) == lang, 1.0, -1.0)
        mean, base = np.average(x, axis=0, weights=weight), np.average(y, weights=weight)
        a = ((x - mean) * weight[:, None]).T @ (x - mean) + language_id.RIDGE * len(langs) / x.shape[1] * np.eye(x.shape[1])
        w = np.linalg.solve(a, ((x - mean) * weight[:, None]).T @ (y - base))
        assert np.allclose((kernel(new, marks) @ to_feature - mean) @ w + base, got[:, c], atol=1e-4)


def test_language_learns_each_id_once(spark):
    rows = [(1, "der die das", "de", "a")] * 50 + [(k, "the of and", "en", "a") for k in range(2, 8)]
    model = language_id.fit(docs(spark, rows), fold=None)
    assert model.langs == ["de", "en"]
    assert {r["lang_pred"] for r in language_id.predict(docs(spark, rows[:1]), model).collect()} == {"de"}


# Toxicity by brute force


def test_swaps_act_on_the_corpus(spark, sf):
    """The registered query's documents name no given group; learned groups make swaps act."""
    frame, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    assert toxicity.fit(frame, labels, fold=(4, 2)).swaps > 100


def test_swaps_are_word_sets():
    others = toxicity.others_of([["muslim", "christian", "jewish"], ["frau", "mann"]])
    assert others["frau"] == ["mann"] and sorted(others["muslim"]) == ["christian", "jewish"]
    words = {"a", "muslim", "museum", "frau"}
    got = {(tuple(sorted(a)), tuple(sorted(b))) for a, b in toxicity.swaps(words, others)}
    want = set()
    for term in words & others.keys():
        for other in others[term]:
            old, new = toxicity.features(words), toxicity.features((words - {term}) | {other})
            want.add((tuple(sorted(old - new)), tuple(sorted(new - old))))
    assert got == want and toxicity.swaps({"nobody"}, others) == []


def test_learned_groups(spark):
    """Words that follow the same word and do not depend on the label form a group."""
    rng = random.Random(2)
    rows = [(k, f"my {['velu', 'doru', 'kani', 'besa', 'timo'][k // 4 % 5]} neighbour {rng.choice(['scum', 'pest']) if k % 4 == 0 else 'came'}", int(k % 4 == 0)) for k in range(400)]
    sample = spark.createDataFrame([(r[1], r[2]) for r in rows], "t string, y int")
    assert ["besa", "doru", "kani", "timo", "velu"] in [sorted(g) for g in toxicity._mentions(sample)]
    assert not any({"scum", "pest"} & set(g) for g in toxicity._mentions(sample))


def test_model_minimises_its_loss():
    """The fitted weights' loss against small changes of each weight, with the loss written out."""
    rng = random.Random(4)
    f = {w: zlib.crc32(b"w" + w.encode()) for w in ("bad", "one", "two", "oth")}
    rows = []
    for _ in range(300):
        own, group = [w for w in ("bad", "oth") if rng.random() < 0.4], rng.choice(("one", "two"))
        y = int(rng.random() < (0.8 if "bad" in own else 0.4 if group == "one" else 0.1))
        rows.append((sorted(f[w] for w in [*own, group]), [([f[group]], [f["two" if group == "one" else "one"]])], y))
    model = toxicity.Model(rows, swap_weight=0.5, terms={"one", "two"})

    def loss(w, b):
        z = [b + sum(w.get(x, 0) for x in r[0]) for r in rows]
        nll = sum(math.log(1 + math.exp(-v if r[2] else v)) for v, r in zip(z, rows, strict=True)) / len(rows)
        swap = sum((sum(w.get(x, 0) for x in lost) - sum(w.get(x, 0) for x in gained)) ** 2 for r in rows for lost, gained in r[1])
        return nll + 0.5 * swap / model.swaps + toxicity.L2 / 2 * sum(v * v for v in w.values())

    best = loss(model.weights, model.bias)
    for name in model.weights:
        for step in (-0.05, 0.05):
            assert loss(model.weights | {name: model.weights[name] + step}, model.bias) > best - 1e-4
    assert abs(model.weights[f["one"]] - model.weights[f["two"]]) < abs(toxicity.Model(rows, 0.0, {"one", "two"}).weights[f["one"]] - toxicity.Model(rows, 0.0, {"one", "two"}).weights[f["two"]])


def test_scores_are_brute_force(spark):
    model = toxicity.Model([([zlib.crc32(b"wbad")], [], 1), ([zlib.crc32(b"wgood")], [], 0)] * 20)
    texts = ["bad day", "Good, BAD!", "", None, "nothing"]
    got = [r["score"] for r in toxicity.score(docs(spark, [(k, t) for k, t in enumerate(texts)]), model).orderBy("doc_id").collect()]
    for g, t in zip(got, texts, strict=True):
        z = model.bias + sum(w for x, w in model.weights.items() if x in toxicity.features(toxicity.words_of(t)))
        assert math.isclose(g, 1 / (1 + math.exp(-z)), rel_tol=1e-9)


# Chats


def test_registered_chats_are_cheapest(spark, sf):
    from test_others import cheapest

    from saltern.llm import chat_format

    turns, cost = {}, Counter()
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        turns.setdefault(r["conv_id"], []).append((r["turn"], r["role"]))
    for r in queries.op7_chat_format(spark, sf).collect():
        cost[r["conv_id"]] += r["cost"]
    short = {c: sorted(x, key=lambda t: (t[0], t[1] or "")) for c, x in turns.items() if len(x) <= 7}
    assert len(short) > 10 and {c: cost[c] for c in short} == {c: cheapest([chat_format._role(r) for _, r in x]) for c, x in short.items()}


def test_long_turns_stay_whole(spark):
    from saltern.llm import chat_format

    text = "<|x " * 400_000
    rows = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", "y")], "conv_id long, turn long, role string, text string")
    got = {r["turn"]: r["rendered"] for r in chat_format.repair(rows).collect()}
    assert got[0] == "<|im_start|>user\n" + text.replace("<|", "< |") and got[1].endswith("y<|im_end|>\n")


# Pipeline


def plain_pipeline(rows, sf_dir):
    """The stages written out: letters, normal forms, all pairs of n-grams, the mixing query's SQL, the library."""
    import duckdb
    import sentencepiece
    from test_texts import words

    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    groups = {}
    for r in rows:
        groups.setdefault("".join(c for c in r[1] if c not in " \t\n\x0b\x0c\r"), []).append(r)
    rows = [min(g, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0)) for g in groups.values()]
    sets = []
    for r in rows:
        w = words(r[1])
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both * 100 >= 80 * (len(sets[i]) + len(sets[j]) - both):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    parts = {}
    for i, r in enumerate(rows):
        parts.setdefault(find(i), []).append(r)
    rows = [min(p, key=lambda r: (r[0] is None, r[0] or 0)) for p in parts.values()]
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [r[:5] for r in rows])
    times = Counter(r[0] for r in db.sql(f"SELECT doc_id FROM ({queries.oracle_sql()['op6_source_mixing']})").fetchall())
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    return sorted((r[0] is None, r[0] or 0, sp.encode(r[1])) for r in rows for _ in range(times[r[0]]))


def test_pipeline_is_plain(spark, tmp_path):
    """Null ids, repeated and near rows, empty and very long texts, and extra columns with clashing names."""
    import corpus_pipeline

    rng = random.Random(9)
    rows = []
    for k in range(150):
        text = " ".join(rng.choice(("der die das und nicht haus baum" if k % 2 else "the of and with this house tree").split()) + str(rng.randrange(40)) for _ in range(rng.randrange(1, 60)))
        rows.append((k, text, rng.choice(["de", "en", None]), f"src{k % 4}", len(text)))
    rows += [(200 + k, rows[k][1] + " tail", "en", "src1", 9) for k in range(0, 40, 2)] + [(300 + k, f" {rows[k][1]} ", "de", None, 9) for k in range(20)]
    rows += [rows[5], rows[5], (None, rows[7][1], "de", "src0", 1), (400, None, "en", "src0", 0), (401, "", None, None, 0), (402, "12 34", "en", "src0", 5), (403, "word " * 50_000 + "end", "en", "src9", 250_003)]
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, at string, node long, component long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, list(r["ids"])) for r in out) == plain_pipeline(rows, str(tmp_path))


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    docs(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_batches_of_long_texts_end_by_bytes(spark):
    from saltern.llm import common

    rows, size = (f"spark.sql.execution.arrow.{x}" for x in ("maxRecordsPerBatch", "maxBytesPerBatch"))
    before = {k: spark.conf.get(k) for k in (rows, size)}

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "size": [sum(len(x.as_py()) for x in batch.column("text"))]})

    try:
        spark.conf.set(size, "64m")
        common.small_batches(spark)
        found = spark.range(0, 40, 1, 1).selectExpr("repeat('x', 262144) AS text").mapInArrow(run, "n long, size long").collect()
        assert sum(r["n"] for r in found) == 40 and sum(r["size"] for r in found) == 40 * 262144
        assert max(r["size"] for r in found) <= common.TEXT_BYTES + 262144
        spark.conf.set(size, "512kb")  # a smaller setting stays
        common.small_batches(spark)
        assert spark.conf.get(size) == "512kb"
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
