"""The registered queries of this subpackage: thin contracts over its operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltern.llm import chat_format, decontaminate, embedding_dedup, exact_dedup, filter_audit, language_id, lm_scoring, merkle, ngram_join, secret_scan, sentencepiece_codec, source_mixing, toxicity
from saltern.llm.common import fold_is, table


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_scoring.score(table(spark, sf_dir, "documents"))
    return out.withColumnRenamed("id", "doc_id")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


OP2_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
pairs AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 93e-2
),
reach(id, x) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, p.b FROM reach r JOIN pairs p ON p.a = r.x)
SELECT id AS vec_id, coalesce((SELECT count(*) FROM pairs WHERE a = id), 0) AS n_links, min(x) AS component_id, id = min(x) AS kept
FROM reach GROUP BY id
"""


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sentencepiece_codec.encode_decode(docs, piece_model())
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    out = toxicity.score(docs, toxicity.fit(docs, labels))
    return out.select("doc_id", fold_is(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"),
        *[secret_scan.count_of(F.col("base"), k).alias(f"n_{k}") for k in secret_scan.BASE],
        F.sha2(secret_scan.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secret_scan.joined(F.concat("base", "linked")).alias("spans"),
    )


def _op5_sql() -> str:
    kinds = ",\n".join(f"({k}, '{kind}', '{pattern.replace(chr(39), chr(39) * 2)}', {group}, {least})" for k, (kind, (pattern, group, least)) in enumerate((secret_scan.BASE | secret_scan.WEAK).items()))
    near = f"abs(a.start - b.start) <= {secret_scan.WINDOW}"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
kinds(rank, kind, pattern, grp, least) AS (VALUES {kinds}),
m AS (
    SELECT r, t, rank, kind, least, regexp_extract_all(t, pattern) AS ms, string_split_regex(t, pattern) AS gaps,
           CASE WHEN grp = 2 THEN regexp_extract_all(t, pattern, 2) ELSE regexp_extract_all(t, pattern) END AS vs
    FROM d, kinds WHERE regexp_matches(t, pattern)
),
i AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m),
s AS (
    SELECT r, rank, kind, least, vs[i] AS v, ms[i] AS x,
           list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0) AS start,
           len(string_split_regex(t[1:list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0)], '\n[\x20\t\r]*\n')) AS scope
    FROM i WHERE len(vs[i]) >= least
),
p AS (
    SELECT r, rank, kind, CAST(start AS BIGINT) AS start, CAST(start + length(x) AS BIGINT) AS fin, scope
    FROM s WHERE kind <> 'secret' OR regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]')
),
ids AS (SELECT * FROM p WHERE kind IN ('access', 'id')),
secrets AS (SELECT * FROM p WHERE kind IN ('assign', 'hex', 'secret')),
linked AS (SELECT * FROM secrets a WHERE EXISTS (SELECT 1 FROM ids b WHERE a.r = b.r AND a.scope = b.scope AND {near})),
every AS (
    SELECT * FROM p WHERE kind IN ('assign', 'access', 'hex')
    UNION ALL SELECT * FROM linked WHERE kind = 'secret'
    UNION ALL SELECT * FROM ids a WHERE kind = 'id' AND EXISTS (SELECT 1 FROM secrets b WHERE a.r = b.r AND a.scope = b.scope AND {near})
    UNION ALL SELECT * FROM p a WHERE kind = 'endpoint' AND EXISTS (SELECT 1 FROM linked b WHERE a.r = b.r AND a.scope = b.scope AND {near})
),
g AS (
    SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
           string_agg(kind || ':' || start || ':' || fin, ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
           string_agg(kind || ':' || start || ':' || fin, ',' ORDER BY start, rank) AS spans
    FROM every GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)
"""


#: Weights of languages among their siblings; domains and sources weigh the same.
MIX_WEIGHTS = {"lang": {"en": 3.0, "de": 2.0, "fr": 2.0, "es": 1.0}}
MIX_FRACTION, MIX_EPOCHS, MIX_SEED = 0.5, 3, "mix"


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = source_mixing.mix(table(spark, sf_dir, "documents"), weights=MIX_WEIGHTS, fraction=MIX_FRACTION, max_epochs=MIX_EPOCHS, seed=MIX_SEED)
    return out.select("doc_id", "lang", "source", F.col("mix_domain").alias("domain"), F.col("mix_tokens").alias("n_tokens"), F.col("mix_epoch").alias("epoch"))


def _fill_sql(name: str, above: str, parent: list[str], level: str, weight: str) -> str:
    keys = ", ".join([*parent, level])
    group = f"PARTITION BY {', '.join(parent)}" if parent else ""
    join = f"JOIN {above} USING ({', '.join(parent)})" if parent else f"CROSS JOIN {above}"
    return f"""
{name}0 AS (
    SELECT n.*, budget FROM (SELECT {keys}, CAST(sum(supply) * {MIX_EPOCHS} AS DOUBLE) AS cap, CAST({weight} AS DOUBLE) AS weight FROM leaves GROUP BY {keys}) n {join}
),
{name}1 AS (
    SELECT *, coalesce(sum(cap) OVER r, 0) + cap / weight * (sum(weight) OVER g - coalesce(sum(weight) OVER r, 0)) <= budget AS filled
    FROM {name}0 WINDOW g AS ({group}), r AS ({group} ORDER BY cap / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
{name} AS (
    SELECT {keys}, CASE WHEN filled THEN cap ELSE weight * (budget - coalesce(sum(CASE WHEN filled THEN cap END) OVER g, 0)) / sum(CASE WHEN NOT filled THEN weight END) OVER g END AS budget
    FROM {name}1 WINDOW g AS ({group})
)"""


def _op6_sql() -> str:
    langs = "CASE lang " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in MIX_WEIGHTS["lang"].items()) + " ELSE 1 END"
    return rf"""
WITH d AS (
    SELECT doc_id, lang AS lang0, source AS source0, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS n_tokens,
           CASE WHEN left(md5(coalesce(source, '')), 1) < '4' THEN 'd0' WHEN left(md5(coalesce(source, '')), 1) < '8' THEN 'd1'
                WHEN left(md5(coalesce(source, '')), 1) < 'c' THEN 'd2' ELSE 'd3' END AS domain
    FROM documents
),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS supply FROM d WHERE n_tokens > 0 GROUP BY ALL),
root AS (SELECT least(CAST(sum(supply) * {MIX_EPOCHS} AS DOUBLE), floor(CAST(sum(supply) AS DOUBLE) * CAST({MIX_FRACTION} AS DOUBLE))) AS budget FROM leaves),
{_fill_sql("domains", "root", [], "domain", "1")},
{_fill_sql("langs", "domains", ["domain"], "lang", langs)},
{_fill_sql("sources", "langs", ["domain", "lang"], "source", "1")},
plan AS (
    SELECT domain, lang, source, supply, CAST(floor(budget) AS BIGINT) AS budget, CAST(floor(budget) AS BIGINT) // CAST(supply AS BIGINT) AS epochs
    FROM leaves JOIN sources USING (domain, lang, source)
),
o AS (
    SELECT d.*, p.epochs, p.budget - p.epochs * p.supply AS rest,
           sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{MIX_SEED}:' || p.epochs || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) RANGE UNBOUNDED PRECEDING) AS upto
    FROM d JOIN plan p USING (domain, lang, source) WHERE n_tokens > 0
)
SELECT doc_id, lang0 AS lang, source0 AS source, domain, n_tokens, CAST(unnest(range(epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END)) AS INTEGER) AS epoch FROM o
"""


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest is the SHA-256 of the normalised text, so it serves as ``text_sha256``."""
    out = exact_dedup.decisions(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat_format.repair(table(spark, sf_dir, "conversations"))
    return out.drop("pos").withColumnsRenamed({"conv": "conv_id"})


OP8_SQL = r"""
WITH d AS (
    SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
    FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id)
"""


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id.predict(docs.select("doc_id", "text"), language_id.fit(docs))
    return out.select("doc_id", fold_is(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_join.join(table(spark, sf_dir, "documents"), n=4, num=85, den=100)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "n_links")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tampering deletes line feeds of the texts of ids whose crc32 is even."""

    def tampered(columns):
        return {"text": F.when(F.crc32(columns["doc_id"].cast("string").cast("binary")) % 2 == 0, F.replace(columns["text"], F.lit("\n"), F.lit(""))).otherwise(columns["text"])}

    out = merkle.verify(merkle.manifest(table(spark, sf_dir, "documents"), tampered=tampered))
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(merkle.proof(F.col("path")).cast("binary"), 256).alias("proof_sha256"), "folded_root", "verified")


def _op11_sql(documents: str = "documents") -> str:
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda t: "sha256(" + " || ".join(map(field, ["doc_id", "source", "lang", "n_chars", t])) + ")"
    n = merkle.FANOUT
    side = lambda low, high: f"coalesce(array_to_string(nodes[{low}:{high}], ''), '')"
    first = f"(pos // {n}) * {n}"
    return rf"""
WITH RECURSIVE d AS (
    SELECT row_number() OVER () AS r, doc_id, source, {leaf("text")} AS leaf,
           CASE WHEN crc % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf("text")} END AS own
    FROM (SELECT *, {_crc32_sql("doc_id")} AS crc FROM {documents})
),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos FROM d),
up(source, level, nodes) AS (
    SELECT source, 0, list(leaf ORDER BY pos) FROM o GROUP BY source
    UNION ALL
    SELECT up.source, up.level + 1, list_transform(range(0, len(nodes), {n}), lambda k: sha256(array_to_string(nodes[k + 1:k + {n}], ''))) FROM up WHERE len(nodes) > 1
),
tips AS (SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM up WHERE len(nodes) = 1),
over_(level, nodes) AS (
    SELECT 0, list(subroot ORDER BY pos) FROM tips
    UNION ALL
    SELECT level + 1, list_transform(range(0, len(nodes), {n}), lambda k: sha256(array_to_string(nodes[k + 1:k + {n}], ''))) FROM over_ WHERE len(nodes) > 1
),
fold(r, source, level, pos, proof, acc) AS (
    SELECT r, source, 0, pos, '', own FROM o
    UNION ALL
    SELECT r, fold.source, fold.level + 1, pos // {n}, proof || {side(f"{first} + 1", "pos")} || {side("pos + 2", f"{first} + {n}")},
           sha256({side(f"{first} + 1", "pos")} || acc || {side("pos + 2", f"{first} + {n}")})
    FROM fold JOIN up ON fold.source IS NOT DISTINCT FROM up.source AND fold.level = up.level AND len(nodes) > 1
),
mid AS (SELECT r, t.subroot, t.pos, proof, acc FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY level DESC) AS last FROM fold) f JOIN tips t ON f.source IS NOT DISTINCT FROM t.source WHERE last = 1),
rise(r, level, pos, proof, acc) AS (
    SELECT r, 0, pos, proof, acc FROM mid
    UNION ALL
    SELECT r, rise.level + 1, pos // {n}, proof || {side(f"{first} + 1", "pos")} || {side("pos + 2", f"{first} + {n}")},
           sha256({side(f"{first} + 1", "pos")} || acc || {side("pos + 2", f"{first} + {n}")})
    FROM rise JOIN over_ ON rise.level = over_.level AND len(nodes) > 1
),
done AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY level DESC) AS last FROM rise) WHERE last = 1),
root AS (SELECT nodes[1] AS root FROM over_ WHERE len(nodes) = 1)
SELECT doc_id, leaf, subroot, root, sha256(done.proof) AS proof_sha256, done.acc AS folded_root, done.acc = root AS verified
FROM d JOIN mid USING (r) JOIN done USING (r), root
"""


def _crc32_sql(column: str) -> str:
    """The CRC-32 of an integer's decimal text, bit by bit; null for null."""
    text = f"CAST({column} AS VARCHAR)"
    shifted = "list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda x, i: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))"
    codes = f"list_transform(range(1, length({text}) + 1), lambda k: CAST(ascii({text}[k]) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: {shifted}), 4294967295)"


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = filter_audit.masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return filter_audit.audit(counts)


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
           len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
           100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
           coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false) AS e
    FROM w LEFT JOIN l USING (doc_id)
),
f AS (SELECT *, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails FROM m),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
    SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM letters p, letters q, letters r, letters s, letters t
    WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
),
steps AS (SELECT filter_order, step, filter_order[step] AS own, filter_order[1:step - 1] AS before FROM orders, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)),
x AS (
    SELECT part, filter_order, step, n, good, toxic, own, fails, contains(fails, own) AS fail,
           len(list_intersect(string_split(fails, ''), string_split(before, ''))) > 0 AND fails <> '' AND before <> '' AS gone
    FROM g, steps
),
y AS (
    SELECT part, filter_order, step, own,
           sum(CASE WHEN NOT gone AND NOT fail THEN n ELSE 0 END) AS kept, sum(CASE WHEN fail AND NOT gone THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN fail AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN fail AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fail AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
    FROM x GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM y
"""


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("n_words").cast("long").alias("n_words"),
        F.size("hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"),
    )


OP13_SQL = rf"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{decontaminate.UPPER}', '{decontaminate.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
),
b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{decontaminate.UPPER}', '{decontaminate.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
),
p AS (SELECT *, least(len(w), {decontaminate.WINDOW}) AS n FROM b WHERE len(w) > 0),
q AS (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM p),
items AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS x FROM q),
lengths AS (SELECT DISTINCT n FROM items),
e AS (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN lengths ON len(w) >= n),
hits AS (SELECT r, i, n, item_id FROM (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS x FROM e) JOIN items USING (n, x)),
covered AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hits) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN ids USING (r)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_scoring, op2_embedding_dedup, op3_sentencepiece, op4_toxicity, op5_secret_scan, op6_source_mixing, op7_chat_format, op8_exact_dedup, op9_language_id, op10_ngram_join, op11_merkle, op12_filter_audit, op13_decontaminate)}


def oracle_sql() -> dict[str, str]:
    return {"op2_embedding_dedup": OP2_SQL, "op5_secret_scan": _op5_sql(), "op6_source_mixing": _op6_sql(), "op8_exact_dedup": OP8_SQL, "op11_merkle": _op11_sql(), "op12_filter_audit": OP12_SQL, "op13_decontaminate": OP13_SQL}
