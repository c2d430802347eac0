"""Registered queries on the star schema and text tables, each with its SQL.

A formulation is an order (confidence: o_totalprice, document: o_custkey); its lines are line
items with their parts; chunks are documents, vectors are embeddings, and chat is conversations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saltern.functions import text as T
from saltern.functions.text import bounded
from saltern.operators import analytics, catalog, chunking, containment, conversations, evaluate, retrieval, rules, warehouse
from saltern.operators.bm25_index import BM25Index
from saltern.sources.shared import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    own = read(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return own.select(
        F.col("l_orderkey").alias("formulation_id"), F.col("l_linenumber").alias("line_no"), F.col("p_name").alias("raw_name"), F.lower("p_name").alias("normalized_name"),
        F.col("l_quantity").alias("amount"), F.when(F.col("l_returnflag") == "N", "%").otherwise("wt%").alias("unit"), F.col("l_linestatus").alias("phase"), F.col("p_type").alias("tag"),
    )


def formulations_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("doc_id"), F.col("o_totalprice").alias("confidence"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("status"))


LINES = """l AS (
    SELECT l_orderkey AS formulation_id, l_linenumber AS line_no, p_name AS raw_name, lower(p_name) AS normalized_name, l_quantity AS amount,
           CASE WHEN l_returnflag = 'N' THEN '%' ELSE 'wt%' END AS unit, l_linestatus AS phase, p_type AS tag
    FROM lineitem JOIN part ON l_partkey = p_partkey
)"""


def _round(x: str, k: int) -> str:
    return f"floor(({x}) * 1e{k} + 5e-1) / 1e{k}"


@query(f"""WITH {LINES}
SELECT o_orderkey AS id, o_totalprice AS confidence FROM orders
WHERE lower(o_orderpriority) LIKE '%high%' AND EXISTS (SELECT 1 FROM l WHERE formulation_id = o_orderkey AND normalized_name LIKE '%gizmo%')
ORDER BY o_totalprice DESC, o_orderkey LIMIT 50""")
def q01_search_filtered(spark: SparkSession, d: str) -> DataFrame:
    return catalog.search(formulations_of(spark, d), lines_of(spark, d), catalog.Filters(name="high", ingredient="gizmo")).select("id", "confidence")


@query(f"""WITH {LINES}
SELECT o_orderkey AS id, o_totalprice AS confidence FROM orders
WHERE NOT EXISTS (SELECT 1 FROM l WHERE formulation_id = o_orderkey AND (normalized_name LIKE '%bolt%' OR normalized_name LIKE '%anvil%'))""")
def q02_banned_anti(spark: SparkSession, d: str) -> DataFrame:
    return catalog.search(formulations_of(spark, d), lines_of(spark, d), catalog.Filters(banned=("bolt", "anvil"), limit=None)).select("id", "confidence")


@query(f"""WITH {LINES}
SELECT formulation_id AS id FROM l WHERE tag IN ('PROMO', 'SMALL', 'LARGE') GROUP BY 1 HAVING count(DISTINCT tag) = 3""")
def q03_all_of_types(spark: SparkSession, d: str) -> DataFrame:
    types = lines_of(spark, d).groupBy(F.col("formulation_id").alias("id")).agg(F.collect_set("tag").alias("product_types"))
    return catalog.search(types.withColumns({"doc_id": F.lit(None), "confidence": F.lit(0)}), types, catalog.Filters(product_types=("PROMO", "SMALL", "LARGE"), limit=None)).select("id")


@query(f"""WITH {LINES}
SELECT formulation_id AS id, count(*) AS n, string_agg(line_no || ':' || raw_name || ':' || CAST(CAST(amount AS BIGINT) AS VARCHAR), '|' ORDER BY line_no, raw_name, amount) AS children FROM l GROUP BY 1""")
def q04_nested_children(spark: SparkSession, d: str) -> DataFrame:
    lines = lines_of(spark, d).select("formulation_id", "line_no", "raw_name", "amount")
    out = catalog.nested(lines.select(F.col("formulation_id").alias("id")).distinct(), lines, ["line_no", "raw_name", "amount"])
    item = lambda x: F.concat_ws(":", x["line_no"].cast("string"), x["raw_name"], x["amount"].cast("long").cast("string"))
    return out.select("id", F.size("ingredients").cast("long").alias("n"), F.array_join(F.transform("ingredients", item), "|").alias("children"))


@query("SELECT count(*) AS n_rows, count(DISTINCT lower(p_name)) AS n_names FROM part")
def q05_count_distinct_names(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").agg(F.count("*").alias("n_rows"), F.count_distinct(F.lower("p_name")).alias("n_names"))


@query(f"SELECT {_round('avg(n)', 6)} AS avg_children, count(*) AS parents FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)")
def q06_avg_children_per_parent(spark: SparkSession, d: str) -> DataFrame:
    return catalog.average_children(read(spark, d, "lineitem"), "l_orderkey").withColumn("avg_children", bounded(F.col("avg_children"), 6))


@query(f"""WITH c AS (SELECT l_orderkey AS id, count(*) AS n, max(CASE WHEN l_quantity IS NOT NULL THEN 1 ELSE 0 END) AS a FROM lineitem GROUP BY 1),
b AS (SELECT o_orderkey, o_totalprice AS confidence, coalesce(n, 0) AS n, coalesce(a, 0) AS a FROM orders LEFT JOIN c ON id = o_orderkey)
SELECT count(*) AS total, {_round('avg(CASE WHEN n >= 6 THEN 1e0 ELSE 0e0 END)', 6)} AS six_plus, {_round('avg(CAST(a AS DOUBLE))', 6)} AS with_amounts,
       {_round('avg(CASE WHEN confidence >= 2e5 THEN 1e0 ELSE 0e0 END)', 6)} AS confident, {_round('avg(CASE WHEN n = 2 THEN 1e0 ELSE 0e0 END)', 6)} AS two_only,
       CAST(median(n) AS DOUBLE) AS median_lines, {_round('avg(n)', 6)} AS mean_lines FROM b""")
def q07_corpus_quality(spark: SparkSession, d: str) -> DataFrame:
    out = catalog.quality(formulations_of(spark, d), lines_of(spark, d), high=2e5)
    return out.withColumns({c: bounded(F.col(c), 6) for c in ("six_plus", "with_amounts", "confident", "two_only", "mean_lines")})


@query("SELECT o_custkey AS doc_id, o_orderkey AS id, o_totalprice AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def q08_best_per_name(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("confidence"))
    return catalog.best(rows, ["doc_id"], [F.col("confidence").desc(), F.col("id")])


_HASH = r"sha256(regexp_replace(lower(trim(text, E' \t\n\r\x0b\x0c')), '[ \t\n\r\x0B\x0C]+', ' ', 'g'))"


@query(f"SELECT {_HASH} AS text_hash, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1")
def q10_text_hash_dedup(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").groupBy(T.text_hash(F.col("text")).alias("text_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query("""WITH w AS (SELECT doc_id, text, unnest(range(CASE WHEN length(text) <= 3200 THEN 1 ELSE 1 + CAST(ceil((length(text) - 3200) / 2800e0) AS BIGINT) END)) AS i FROM documents WHERE length(text) > 0)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, CAST(i * 2800 AS INTEGER) AS start, length(substr(text, i * 2800 + 1, 3200)) AS n_chars, sha256(substr(text, i * 2800 + 1, 3200)) AS chunk_hash FROM w""")
def q11_sliding_chunks(spark: SparkSession, d: str) -> DataFrame:
    out = chunking.sliding(read(spark, d, "documents"))
    return out.select("doc_id", "chunk_index", "start", F.char_length("chunk").cast("long").alias("n_chars"), F.sha2(F.col("chunk").cast("binary"), 256).alias("chunk_hash"))


@query("SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) - 1 AS chunk_index FROM documents")
def q12_chunk_index(spark: SparkSession, d: str) -> DataFrame:
    return chunking.indexed(read(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", ["n_chars", "doc_id"]).drop("n_chars").withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN substr(text, 1, 40) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM conversations""")
def q13_section_carry(spark: SparkSession, d: str) -> DataFrame:
    return chunking.carried_section(read(spark, d, "conversations"), "conv_id", ["turn"], F.when(F.col("role") == "user", F.substring("text", 1, 40))).select("conv_id", "turn", "section")


def _tag_sql(column: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({column}, '{p}') THEN '{t}' END" for t, p in T.PRODUCT_TAGS) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT 'd' || doc_id AS id, array_to_string({_tag_sql('text')}, ',') AS tags FROM documents UNION ALL SELECT 'p' || p_partkey, array_to_string({_tag_sql(chr(39) + 'baby shampoo for ' + chr(39) + ' || p_name')}, ',') FROM part")
def q14_tag_regex(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("text").alias("t"))
    parts = read(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.concat(F.lit("baby shampoo for "), "p_name").alias("t"))
    return docs.union(parts).select("id", F.array_join(T.product_tags(F.col("t")), ",").alias("tags"))


def _formula_sql(t: str) -> str:
    s = {k: f"regexp_matches({t}, '{p}')" for k, p in T.FORMULA_SIGNS.items()}
    pct = f"contains({t}, '%')"
    return f"""({pct} AND {s['keyword']}) OR (({s['wtg']} OR {s['wtb']}) AND ({s['weight']} OR {s['part']})) OR ({s['part']} AND {s['weight']}) OR ({s['recipe']} AND {s['part_line']})
      OR ({s['qs']} AND {s['weight']} AND ({s['keyword']} OR {s['recipe']})) OR ({s['percent']} AND {s['context']}) OR ({pct} AND {s['part']})"""


@query(f"SELECT doc_id, {_formula_sql('text')} AS is_formula FROM documents")
def q15_formula_flag(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", T.is_formula(F.col("text")).alias("is_formula"))


@query("""SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:\\.[0-9]+)?|[%]')) AS term FROM documents) GROUP BY ALL)
GROUP BY term ORDER BY df DESC, cf DESC, term LIMIT 100""".replace("\\\\", "\\"))
def q16_tokens_topn(spark: SparkSession, d: str) -> DataFrame:
    post = retrieval.postings(read(spark, d, "documents"))
    return post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).orderBy(F.desc("df"), F.desc("cf"), "term").limit(100)


def _points_sql(n: str) -> str:
    signs = " + ".join(f"CASE WHEN regexp_matches({n}, '{p}') THEN {v} ELSE 0 END" for p, v in T.NAME_SIGNS)
    return signs


@query(f"""WITH n AS (SELECT p_partkey AS id, trim(p_name || CASE p_partkey % 5 WHEN 0 THEN ' | 3' WHEN 1 THEN ' Hiqhh' WHEN 2 THEN ' strngthz' WHEN 3 THEN ' fooBar' ELSE '' END) AS name FROM part)
SELECT id, {_points_sql('name')} + CASE WHEN length(name) >= 3 AND length(regexp_replace(regexp_replace(name, '\\s', '', 'g'), '[^\\p{{L}}]', '', 'g')) / CAST(greatest(length(regexp_replace(name, '\\s', '', 'g')), 1) AS DOUBLE) < 55e-2 THEN 2 ELSE 0 END
  + CASE WHEN len(list_filter(regexp_extract_all(name, '[A-Za-z]+'), lambda w: length(w) >= 3 AND w <> upper(w) AND NOT regexp_matches(w, '(?i)[aeiouy]'))) > 0 THEN 1 ELSE 0 END AS points FROM n""")
def q17_name_quality(spark: SparkSession, d: str) -> DataFrame:
    tail = F.when(F.col("p_partkey") % 5 == 0, " | 3").when(F.col("p_partkey") % 5 == 1, " Hiqhh").when(F.col("p_partkey") % 5 == 2, " strngthz").when(F.col("p_partkey") % 5 == 3, " fooBar").otherwise("")
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), T.name_points(F.concat("p_name", tail)).alias("points"))


_BM25 = r"""
t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+(?:\.[0-9]+)?|[%]') AS ts FROM documents),
s AS (SELECT count(*) AS n, avg(CAST(len(ts) AS DOUBLE)) AS avgdl FROM t),
p AS (SELECT term, doc_id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM t) GROUP BY term, doc_id),
f AS (SELECT term, ln(CAST(n - count(*) AS DOUBLE) + 5e-1) - ln(CAST(count(*) AS DOUBLE) + 5e-1) AS idf FROM p, s GROUP BY term, n),
g AS (SELECT term, CASE WHEN idf < 0 THEN 25e-2 * (SELECT avg(idf) FROM f) ELSE idf END AS idf FROM f),
q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:\.[0-9]+)?|[%]')) AS term FROM benchmark) GROUP BY ALL),
h AS (SELECT query_id, doc_id, sum(qtf * idf * tf * 25e-1 / (tf + 15e-1 * (25e-2 + 75e-2 * dl / avgdl))) AS score FROM p JOIN g USING (term) JOIN q USING (term), s GROUP BY ALL),
b AS (SELECT query_id, doc_id, floor(score * 1e4 + 5e-1) / 1e4 AS score FROM h),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS pos FROM b)"""


@query(f"WITH {_BM25} SELECT query_id, doc_id, score, pos FROM bm WHERE pos < 20")
def q20_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark item as a query against all documents."""
    queries = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.bm25(read(spark, d, "documents"), queries, 20, digits=4).withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {_BM25} SELECT query_id, doc_id, score, pos FROM bm WHERE pos < 20")
def q106_bm25_index(spark: SparkSession, d: str) -> DataFrame:
    """As q20, from a stored index to which short, middling and long documents have been appended in turn."""
    docs, index = read(spark, d, "documents"), BM25Index(spark, new_path(spark, "index"))
    size = F.coalesce("n_chars", F.lit(0))
    for part in (size < 500, (size >= 500) & (size < 2000), size >= 2000):
        index.append(docs.filter(part))
    queries = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return index.search(queries, 20, digits=4).withColumn("pos", F.col("pos").cast("long"))


def _dot(a: str, b: str) -> str:
    return f"list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


_COS = f"""q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 20 = 0),
c AS (SELECT query_id, vec_id, label, {_round(f"{_dot('embedding', 'v')} / sqrt({_dot('embedding', 'embedding')}) / sqrt({_dot('v', 'v')})", 6)} AS score FROM embeddings, q)"""


def _vector_queries(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set of searches: vectors whose id is divisible by 20."""
    return read(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query(f"WITH {_COS} SELECT query_id, vec_id, score, pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS pos FROM c) WHERE pos < 10")
def q21_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.dense_top_k(read(spark, d, "embeddings"), _vector_queries(spark, d)).withColumn("pos", F.col("pos").cast("long"))


@query(f"""WITH {_COS}, dense AS (SELECT query_id, vec_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS pos FROM c),
other AS (SELECT query_id, vec_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY abs(vec_id - query_id), vec_id) - 1 AS pos FROM c),
u AS (SELECT * FROM dense WHERE pos < 30 UNION ALL SELECT * FROM other WHERE pos < 40),
f AS (SELECT query_id, id, sum(1e0 / (61 + pos)) AS s FROM u GROUP BY ALL),
n AS (SELECT query_id, id, {_round("s / max(s) OVER (PARTITION BY query_id)", 6)} AS score FROM f)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS pos FROM n""")
def q22_rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    vectors, queries = read(spark, d, "embeddings"), _vector_queries(spark, d)
    dense = retrieval.dense_top_k(vectors, queries, 30).select("query_id", F.col("vec_id").alias("id"), "pos")
    other = retrieval.nearest_keys(vectors, queries, 40).select("query_id", F.col("vec_id").alias("id"), "pos")  # the stated query set against all ids
    return retrieval.rrf([dense, other], "id").withColumn("pos", F.col("pos").cast("long"))


@query(f"""WITH {_COS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS pos FROM c),
r3 AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS pos FROM c WHERE label = 3),
u AS (SELECT query_id, vec_id, score, pos, 0 AS pool FROM r WHERE pos < 10 UNION ALL SELECT query_id, vec_id, score, pos, 1 FROM r3 WHERE pos < 5),
k AS (SELECT *, max(score) OVER (PARTITION BY query_id, vec_id) AS top, row_number() OVER (PARTITION BY query_id, vec_id ORDER BY pool, pos) AS n FROM u)
SELECT query_id, vec_id, top AS score, row_number() OVER (PARTITION BY query_id ORDER BY pool, pos, vec_id) - 1 AS pos FROM k WHERE n = 1""")
def q23_anchor_pool_union(spark: SparkSession, d: str) -> DataFrame:
    vectors, queries = read(spark, d, "embeddings"), _vector_queries(spark, d)
    pool = retrieval.dense_top_k(vectors, queries, 5, F.col("label") == 3)
    return retrieval.with_pools(retrieval.dense_top_k(vectors, queries), [pool], "vec_id").withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {_COS} SELECT query_id, vec_id, score, pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS pos FROM c WHERE label IN (1, 2)) WHERE pos < 10")
def q24_filtered_dense(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.dense_top_k(read(spark, d, "embeddings"), _vector_queries(spark, d), 10, F.col("label").isin(1, 2)).withColumn("pos", F.col("pos").cast("long"))


@query("""WITH h AS (SELECT source AS query_id, doc_id, lang, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) - 1 AS p FROM documents),
o AS (SELECT *, lang = 'de' AND row_number() OVER (PARTITION BY query_id, lang = 'de' ORDER BY p, doc_id) <= 3 AS pinned FROM h)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY pinned DESC, p, doc_id) - 1 AS pos FROM o""")
def q25_pin_on_type(spark: SparkSession, d: str) -> DataFrame:
    hits = read(spark, d, "documents").select(F.col("source").alias("query_id"), "doc_id", "lang", "n_chars")
    order = Window.partitionBy("query_id").orderBy(F.desc("n_chars"), "doc_id")
    hits = hits.withColumn("pos", F.row_number().over(order) - 1)
    return retrieval.pin(hits, F.col("lang") == "de").select("query_id", "doc_id", F.col("pos").cast("long").alias("pos"))


def _boost_sql() -> str:
    sign = lambda k: f"regexp_matches(text, '{T.FORMULA_SIGNS[k]}')"
    boost = f"""CASE WHEN {_formula_sql('text')} THEN 2e-1 WHEN contains(text, '%') THEN 8e-2 ELSE 0e0 END + CASE WHEN {sign('keyword')} THEN 6e-2 ELSE 0e0 END
      + CASE WHEN contains(text, '|') THEN 4e-2 ELSE 0e0 END + CASE WHEN {sign('wtg')} THEN 6e-2 ELSE 0e0 END"""
    return f"SELECT doc_id, {_round(boost, 6)} AS boost FROM documents"


@query(_boost_sql())
def q26_formula_boost(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", bounded(retrieval.formula_boost(F.col("text")), 6).alias("boost"))


def _prices(spark: SparkSession, d: str) -> DataFrame:
    """Average part price by name, of the names that do not end in "gear"."""
    own = read(spark, d, "part").groupBy(F.lower("p_name").alias("ingredient")).agg(F.min("p_retailprice").alias("price"), F.min("p_partkey").alias("pos"))
    return own.filter(~F.col("ingredient").endswith("gear"))


@query(f"""WITH {LINES}, p AS (SELECT lower(p_name) AS ingredient, min(p_retailprice) AS price FROM part WHERE NOT lower(p_name) LIKE '%gear' GROUP BY 1),
j AS (SELECT l.*, price FROM l LEFT JOIN p ON normalized_name = ingredient WHERE unit = '%' AND amount > 0)
SELECT formulation_id, {_round('CASE WHEN sum(CASE WHEN price IS NOT NULL THEN amount END) > 0 THEN sum(amount / 100 * price) END', 4)} AS cost_per_kg,
       {_round('coalesce(sum(CASE WHEN price IS NOT NULL THEN amount END), 0e0) / sum(amount)', 4)} AS covered_percent FROM j GROUP BY 1""")
def q30_cost_per_kg(spark: SparkSession, d: str) -> DataFrame:
    return analytics.costs(lines_of(spark, d), _prices(spark, d)).drop("missing")


@query("""WITH o AS (SELECT lower(p_name) AS ingredient, p_retailprice AS price, p_partkey AS pos, 0 AS side FROM part),
n AS (SELECT lower(p_name), p_retailprice * 2 - 2000, p_partkey, 1 FROM part WHERE p_size > 25),
u AS (SELECT * FROM o UNION ALL SELECT * FROM n)
SELECT ingredient, price FROM (SELECT *, row_number() OVER (PARTITION BY ingredient ORDER BY side DESC, pos DESC) AS r FROM u WHERE side = 0 OR price >= 0) WHERE r = 1""")
def q31_price_upsert(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part")
    old = part.select(F.col("p_name").alias("ingredient"), F.col("p_retailprice").alias("price"), F.col("p_partkey").alias("pos"))
    new = part.filter("p_size > 25").select(F.col("p_name").alias("ingredient"), (F.col("p_retailprice") * 2 - 2000).alias("price"), F.col("p_partkey").alias("pos"))
    return analytics.merge_prices(old, new)


#: Rules for the stand-in ingredients: name, aliases, market, status, limit.
_RULES = [("hot anvil", [], "EU", "prohibited", None), ("red", ["blue bolt"], "EU", "restricted", 30.0), ("old gear", [], "US", "prohibited", None), ("cold ring", [], "JP", "prohibited", None)]


@query(f"""WITH {LINES}, r(term, status, lim) AS (VALUES ('hot anvil', 'prohibited', CAST(NULL AS DOUBLE)), ('red', 'restricted', 30e0), ('blue bolt', 'restricted', 30e0), ('old gear', 'prohibited', NULL)),
h AS (SELECT formulation_id, max(CASE WHEN status = 'prohibited' THEN 2 WHEN unit = '%' AND amount > lim THEN 2 WHEN status = 'restricted' THEN 1 ELSE 0 END) AS level
      FROM l JOIN r ON contains(normalized_name, term) OR contains(term, normalized_name) GROUP BY 1)
SELECT formulation_id, CASE level WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'pass' END AS status FROM (SELECT DISTINCT formulation_id FROM l) LEFT JOIN h USING (formulation_id)""")
def q32_compliance(spark: SparkSession, d: str) -> DataFrame:
    table = spark.createDataFrame(_RULES, "ingredient string, aliases array<string>, market string, status string, max_percent double")
    return analytics.compliance(lines_of(spark, d), table, ["eu", "us"])


@query(f"""WITH {LINES}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY formulation_id, normalized_name ORDER BY line_no DESC, amount DESC, unit DESC) AS r FROM l WHERE formulation_id IN (5, 7)) WHERE r = 1),
a AS (SELECT * FROM k WHERE formulation_id = 5), b AS (SELECT * FROM k WHERE formulation_id = 7)
SELECT coalesce(a.normalized_name, b.normalized_name) AS key, a.amount AS left_amount, a.unit AS left_unit, b.amount AS right_amount, b.unit AS right_unit,
       CASE WHEN a.normalized_name IS NULL THEN 'right' WHEN b.normalized_name IS NULL THEN 'left' ELSE 'both' END AS side
FROM a FULL JOIN b ON a.normalized_name = b.normalized_name WHERE a.amount IS DISTINCT FROM b.amount OR a.unit IS DISTINCT FROM b.unit""")
def q33_compare_pair(spark: SparkSession, d: str) -> DataFrame:
    """The feature is the comparison of two given recipes, here those of orders 5 and 7."""
    lines = lines_of(spark, d).filter(F.col("formulation_id").isin(5, 7))
    order = Window.partitionBy("formulation_id").orderBy("line_no", "amount", "unit")
    lines = lines.withColumn("line_no", F.row_number().over(order))
    return analytics.compare(lines.filter("formulation_id = 5"), lines.filter("formulation_id = 7")).drop("left_name", "right_name")


@query(f"""WITH {LINES}, r(role, p) AS (VALUES ('surfactant', 'gizmo|widget'), ('oil', 'red|blue'))
SELECT role, count(DISTINCT formulation_id) AS formulations, count(*) AS n FROM l JOIN r ON regexp_matches(raw_name || ' ' || normalized_name, p) GROUP BY 1""")
def q34_role_counts(spark: SparkSession, d: str) -> DataFrame:
    """Roles of stand-in names: those of soap makers match none of the parts."""
    names = F.regexp_replace(F.regexp_replace("raw_name", "gizmo|widget", "sulfate"), "red|blue", "butter")
    lines = lines_of(spark, d).withColumn("raw_name", names).withColumn("normalized_name", F.lit(None).cast("string"))
    return analytics.roles(lines).groupBy("role").agg(F.count("*").alias("formulations"), F.sum("n").alias("n"))


@query(f"""WITH {LINES}, d AS (SELECT DISTINCT formulation_id, normalized_name FROM l),
p AS (SELECT a.normalized_name AS name, b.normalized_name AS other, count(*) AS n FROM d a JOIN d b ON a.formulation_id = b.formulation_id AND a.normalized_name <> b.normalized_name GROUP BY ALL)
SELECT name, other, n, pos FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, other) AS pos FROM p) WHERE pos <= 5""")
def q35_co_occurrence(spark: SparkSession, d: str) -> DataFrame:
    return analytics.co_occurrence(lines_of(spark, d)).withColumn("pos", F.col("pos").cast("long"))


@query(f"""WITH {LINES}, s AS (SELECT *, sum(CASE WHEN unit = '%' THEN amount END) OVER (PARTITION BY formulation_id) AS base FROM l)
SELECT formulation_id, line_no, raw_name, unit, amount, {_round("CASE WHEN unit = '%' THEN amount / 100 * 25 * 1000 WHEN base > 0 THEN amount * 25 / base END", 4)} AS grams, base AS percent_total, abs(base - 100) <= 5e-1 AS balanced FROM s""")
def q36_batch_scale(spark: SparkSession, d: str) -> DataFrame:
    out = analytics.scale_batch(lines_of(spark, d), 25.0)
    return out.select("formulation_id", "line_no", "raw_name", "unit", "amount", bounded(F.col("grams"), 4).alias("grams"), "percent_total", "balanced")


@query("""WITH a AS (SELECT lower(p_name) AS name, 'brass rod' AS substitute, 8e-1 AS confidence FROM part WHERE contains(lower(p_name), 'rod')),
b AS (SELECT lower(p_name), 'brass rod', 5e-1 + 5e-3 * p_size FROM part)
SELECT name, substitute, max(confidence) AS confidence FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL""")
def q37_substitution_merge(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part")
    lines = part.select(F.col("p_partkey").alias("formulation_id"), F.col("p_name").alias("raw_name"), F.lower("p_name").alias("normalized_name"))
    table = spark.createDataFrame([("rod", None, "brass rod", 0.8)], "from string, aliases_from array<string>, to string, confidence double")
    a = analytics.rule_substitutes(lines, table).drop("formulation_id")
    b = part.select(F.lower("p_name").alias("name"), F.lit("brass rod").alias("substitute"), (F.lit(0.5) + F.lit(0.005) * F.col("p_size")).alias("confidence"))
    return analytics.merge_suggestions(a, b, key=["name", "substitute"])


def _facts(spark: SparkSession, d: str) -> DataFrame:
    lines = lines_of(spark, d).select("formulation_id", "line_no", "raw_name", "normalized_name", "amount", "unit", "phase")
    items = catalog.nested(formulations_of(spark, d), lines, ["line_no", "raw_name", "amount", "unit", "phase"]).filter(F.size("ingredients") > 0)
    return rules.facts(items.withColumns({"source_text": F.lit("x"), "vector_text": F.lit("x"), "chunk_texts": F.lit(None).cast("array<string>"), "extraction_method": F.lit("table")}))


_SUM = f"""{LINES}, s AS (SELECT formulation_id, sum(amount) AS total, count(amount) AS n FROM l GROUP BY 1),
ps AS (SELECT formulation_id, CASE WHEN abs(total - 100) > 10 THEN 'error' ELSE 'warning' END AS severity FROM s WHERE n >= 2 AND abs(total - 100) > 3)"""


@query(f"WITH {_SUM} SELECT formulation_id, severity FROM ps")
def q40_percent_sum(spark: SparkSession, d: str) -> DataFrame:
    return rules.percent_sum(_facts(spark, d), rules.CONFIG).select("formulation_id", "severity")


@query(f"WITH {LINES} SELECT formulation_id, normalized_name AS ingredient, CAST(count(*) AS VARCHAR) AS observed FROM l GROUP BY 1, 2 HAVING count(*) > 1")
def q41_duplicates_units(spark: SparkSession, d: str) -> DataFrame:
    return rules.duplicates(_facts(spark, d), rules.CONFIG).select("formulation_id", "ingredient", "observed")


_CATEGORIES = [(0, "warm", "hot", 1.0, 40.0, 45.0), (1, "rods", "hot rod", 5.0, 30.0, 40.0), (2, "rings", "ring", 2.0, 20.0, None)]


@query(f"""WITH {LINES}, c(pos, category, member) AS (VALUES (0, 'warm', 'hot'), (1, 'rods', 'hot rod'), (2, 'rings', 'ring')),
m AS (SELECT p_partkey AS id, category, row_number() OVER (PARTITION BY p_partkey ORDER BY length(member) DESC, pos) AS r FROM part JOIN c ON contains(' ' || lower(p_name) || ' ', ' ' || member || ' '))
SELECT id, category FROM m WHERE r = 1""")
def q42_longest_category(spark: SparkSession, d: str) -> DataFrame:
    table = spark.createDataFrame(_CATEGORIES, "pos int, category string, member string, typical_min double, typical_max double, hard_max double")
    own = F.concat(F.lit(" "), F.lower("p_name"), F.lit(" "))
    rows, table = read(spark, d, "part").select(F.col("p_partkey").alias("id"), own.alias("own")), table.withColumn("term", F.concat(F.lit(" "), "member", F.lit(" ")))
    pairs = containment.containing(rows.select("own"), table.select("term")).withColumnRenamed("text", "own")
    hits = rows.join(pairs, "own").join(table, "term")
    return hits.groupBy("id").agg(F.min(F.struct((-F.char_length("member")).alias("l"), "pos", "category")).alias("x")).select("id", "x.category")


_FINDINGS = f"""{_SUM}, dup AS (SELECT formulation_id, normalized_name FROM l GROUP BY 1, 2 HAVING count(*) > 1),
fs AS (SELECT formulation_id, 'consistency' AS family, severity FROM ps UNION ALL SELECT formulation_id, 'consistency', 'warning' FROM dup),
fam(family, weight) AS (VALUES ('fidelity', 35e-2), ('consistency', 25e-2), ('completeness', 2e-1), ('ranges', 2e-1)),
agg AS (SELECT formulation_id, family, sum(CASE severity WHEN 'error' THEN 35e-2 ELSE 12e-2 END) AS penalty, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM fs GROUP BY ALL),
sc AS (SELECT formulation_id, family, weight, greatest(0e0, 1 - coalesce(penalty, 0e0)) AS score, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings
       FROM (SELECT DISTINCT formulation_id FROM l) CROSS JOIN fam LEFT JOIN agg USING (formulation_id, family))"""


def _scores(spark: SparkSession, d: str) -> DataFrame:
    f = _facts(spark, d)
    return rules.family_scores(f.select("id"), rules.findings(f, [rules.percent_sum, rules.duplicates]))


@query(f"WITH {_FINDINGS} SELECT formulation_id, family, weight, {_round('score', 6)} AS score, errors, warnings FROM sc")
def q43_family_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).withColumn("score", bounded(F.col("score"), 6))


@query(f"""WITH {_FINDINGS}, r AS (SELECT formulation_id, {_round('sum(weight * score) / sum(weight)', 4)} AS p, sum(errors) AS e FROM sc GROUP BY 1)
SELECT CASE WHEN p < 4e-1 THEN 'low_precision' WHEN p < 7e-1 OR e > 0 THEN 'review' ELSE 'verified' END AS status, count(*) AS n FROM r GROUP BY 1""")
def q44_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return rules.reports(_scores(spark, d)).groupBy("status").agg(F.count("*").alias("n"))


_PERCENT = "(" + ", ".join(f"'{u}'" for u in rules.CONFIG["percent_units"]) + ")"
_EVERY_FINDING = f"""{_SUM},
c(pos, category, member, low, high, hard) AS (VALUES (0, 'warm', 'hot', 1e0, 4e1, 45e0), (1, 'rods', 'hot rod', 5e0, 3e1, 4e1), (2, 'rings', 'ring', 2e0, 2e1, NULL)),
k AS (SELECT o_orderkey AS formulation_id, count(l.formulation_id) AS lines, count(unit) AS units, count(*) FILTER (lower(trim(unit)) IN {_PERCENT}) AS pct,
             coalesce(CASE WHEN count(unit) > 0 THEN count(*) FILTER (lower(trim(unit)) IN {_PERCENT}) >= 5e-1 * count(unit) ELSE count(amount) >= 2 AND sum(amount) BETWEEN 60 AND 130 END, false) AS pm
      FROM orders LEFT JOIN l ON l.formulation_id = o_orderkey GROUP BY 1),
x AS (SELECT l.*, pm, row_number() OVER () AS own FROM l JOIN k USING (formulation_id)),
rr AS (SELECT formulation_id, amount, low, high, hard, row_number() OVER (PARTITION BY own ORDER BY length(member) DESC, pos) AS r
       FROM x JOIN c ON contains(' ' || normalized_name || ' ', ' ' || member || ' ') WHERE pm AND amount IS NOT NULL),
fs AS (
    SELECT formulation_id, 'consistency' AS family, severity FROM ps
    UNION ALL SELECT formulation_id, 'consistency', 'warning' FROM (SELECT formulation_id FROM l WHERE normalized_name NOT IN ('', 'water') GROUP BY formulation_id, normalized_name HAVING count(*) > 1)
    UNION ALL SELECT formulation_id, 'consistency', 'error' FROM x WHERE amount <= 0 OR amount > 100 AND (lower(trim(unit)) IN {_PERCENT} OR unit IS NULL AND pm)
    UNION ALL SELECT formulation_id, 'consistency', 'warning' FROM k WHERE pct > 0 AND pct < units
    UNION ALL SELECT formulation_id, 'completeness', 'error' FROM k WHERE lines < 2
    UNION ALL SELECT o_orderkey, 'completeness', 'warning' FROM orders WHERE length(trim(coalesce(o_orderpriority, ''))) < 3
    UNION ALL SELECT formulation_id, 'completeness', 'error' FROM x WHERE trim(raw_name) = ''
    UNION ALL SELECT formulation_id, 'completeness', 'warning' FROM x WHERE amount IS NULL OR unit IS NULL AND NOT pm
    UNION ALL SELECT formulation_id, 'completeness', 'error' FROM x WHERE regexp_matches(trim(raw_name), '{rules.JUNK}')
    UNION ALL SELECT formulation_id, 'completeness', 'error' FROM (SELECT formulation_id FROM l GROUP BY 1 HAVING count(*) >= 3 AND count(amount) = 0)
    UNION ALL SELECT formulation_id, 'ranges', CASE WHEN amount > hard THEN 'error' ELSE 'warning' END FROM rr WHERE r = 1 AND (amount > hard OR amount < low OR amount > high)),
fam(family, weight) AS (VALUES ('fidelity', 35e-2), ('consistency', 25e-2), ('completeness', 2e-1), ('ranges', 2e-1)),
agg AS (SELECT formulation_id, family, sum(CASE severity WHEN 'error' THEN 35e-2 ELSE 12e-2 END) AS penalty, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM fs GROUP BY ALL),
sc AS (SELECT formulation_id, family, weight, greatest(0e0, 1 - coalesce(penalty, 0e0)) AS score, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings
       FROM (SELECT o_orderkey AS formulation_id FROM orders) CROSS JOIN fam LEFT JOIN agg USING (formulation_id, family))"""

#: Rules that compare with a source text, which orders do not have.
_WITH_SOURCE = {rules.has_source, rules.amount_verbatim, rules.name_in_source, rules.chunk_drift}


def _every_score(spark: SparkSession, d: str) -> DataFrame:
    """Scores of every order, also without lines, by all rules that need no source text."""
    lines = lines_of(spark, d).select("formulation_id", "line_no", "raw_name", "normalized_name", "amount", "unit", "phase")
    items = catalog.nested(formulations_of(spark, d), lines, ["line_no", "raw_name", "amount", "unit", "phase"])
    none = F.lit(None).cast("string")
    f = rules.facts(items.withColumns({"source_text": none, "vector_text": none, "chunk_texts": F.lit(None).cast("array<string>"), "extraction_method": F.lit("table")}))
    table = spark.createDataFrame(_CATEGORIES, "pos int, category string, member string, typical_min double, typical_max double, hard_max double")
    return rules.family_scores(f.select("id"), rules.findings(f, [*[r for r in rules.RULES if r not in _WITH_SOURCE], rules.ingredient_range(table)]))


@query(f"WITH {_EVERY_FINDING} SELECT formulation_id, family, weight, {_round('score', 6)} AS score, errors, warnings FROM sc")
def q45_every_rule_scores(spark: SparkSession, d: str) -> DataFrame:
    """As q43, whose SQL is fixed to two rules, by every rule and over every order."""
    return _every_score(spark, d).withColumn("score", bounded(F.col("score"), 6))


@query(f"""WITH {_EVERY_FINDING}, r AS (SELECT formulation_id, {_round('sum(weight * score) / sum(weight)', 4)} AS p, sum(errors) AS e FROM sc GROUP BY 1)
SELECT CASE WHEN p < 4e-1 THEN 'low_precision' WHEN p < 7e-1 OR e > 0 THEN 'review' ELSE 'verified' END AS status, count(*) AS n FROM r GROUP BY 1""")
def q46_every_rule_status(spark: SparkSession, d: str) -> DataFrame:
    return rules.reports(_every_score(spark, d)).groupBy("status").agg(F.count("*").alias("n"))


@query("""WITH u AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS pos, p_name, p_brand, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT lower(p_name) AS key, sum(l_quantity) AS qty, count(*) AS n FROM u GROUP BY 1""")
def q50_upload_merge(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    rows = read(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    up = rows.select(F.col("l_orderkey").alias("pos"), F.concat(F.lit("  "), F.col("p_name")).alias("raw_name"), F.col("p_brand").alias("sku"), F.col("l_quantity").cast("string").alias("qty"))
    n = up.groupBy(warehouse.upload_key(F.col("raw_name")).alias("key")).agg(F.count("*").alias("n"))
    return warehouse.merge_upload(up, None).select("key", "qty").join(n, "key")


@query("""WITH o(key, canonical_name) AS (VALUES ('small ring', 'ring'), ('hot rod', 'rod'))
SELECT p_partkey AS material_id, coalesce(canonical_name, lower(p_name)) AS canonical_name, CASE WHEN canonical_name IS NOT NULL THEN 'override' ELSE 'rules' END AS source, CASE WHEN canonical_name IS NOT NULL THEN 1e0 ELSE 95e-2 END AS confidence
FROM part LEFT JOIN o ON key = lower(p_name)""")
def q51_alias_cascade(spark: SparkSession, d: str) -> DataFrame:
    materials = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("raw_name"))
    overrides = spark.createDataFrame([("small ring", "ring"), ("hot rod", "rod")], "key string, canonical_name string")
    return warehouse.resolve(materials, overrides, None, spark.createDataFrame([("glycerin",)], "match string")).drop("raw_name")


_COVER = f"""{LINES}, inv AS (SELECT DISTINCT lower(p_name) AS name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey = 3),
cv AS (SELECT formulation_id, count(*) AS counted, count(inv.name) AS matched FROM l LEFT JOIN inv ON normalized_name = inv.name GROUP BY 1 HAVING count(*) >= 2),
cc AS (SELECT *, floor(matched * 1000e0 / counted + 5e-1) / 10 AS coverage_pct FROM cv),
cov AS (SELECT *, CASE WHEN coverage_pct >= 95 THEN 'makeable' WHEN coverage_pct >= 50 THEN 'partial' ELSE 'low' END AS tier FROM cc)"""


def _stock(spark: SparkSession, d: str) -> DataFrame:
    """The feature is one inventory, here what supplier 3 delivers."""
    part = read(spark, d, "part")
    held = read(spark, d, "lineitem").filter("l_suppkey = 3").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return held.select(T.canonical_key(F.col("p_name")).alias("name")).distinct()


@query(f"WITH {_COVER} SELECT formulation_id, counted, matched, coverage_pct, tier FROM cov")
def q52_coverage(spark: SparkSession, d: str) -> DataFrame:
    return warehouse.coverage(lines_of(spark, d), _stock(spark, d), threshold=None)


@query(f"""WITH {_COVER}, p AS (SELECT lower(p_name) AS ingredient, min(p_retailprice) AS price FROM part WHERE NOT lower(p_name) LIKE '%gear' GROUP BY 1),
j AS (SELECT formulation_id, {_round('CASE WHEN sum(CASE WHEN price IS NOT NULL THEN amount END) > 0 THEN sum(amount / 100 * price) END', 4)} AS cost_per_kg FROM l LEFT JOIN p ON normalized_name = ingredient WHERE unit = '%' AND amount > 0 GROUP BY 1)
SELECT formulation_id, tier, coverage_pct FROM cov JOIN orders ON o_orderkey = formulation_id LEFT JOIN j USING (formulation_id) WHERE coverage_pct >= 50
ORDER BY CASE tier WHEN 'makeable' THEN 0 WHEN 'partial' THEN 1 ELSE 2 END, coverage_pct DESC, coalesce(cost_per_kg, 1e9), lower(o_orderpriority), formulation_id LIMIT 100""")
def q53_discover_sort(spark: SparkSession, d: str) -> DataFrame:
    lines = lines_of(spark, d)
    out = warehouse.discover(warehouse.coverage(lines, _stock(spark, d), threshold=None), formulations_of(spark, d), analytics.costs(lines, _prices(spark, d)))
    return out.select("formulation_id", "tier", "coverage_pct")


@query()
def q54_fuzzy_match(spark: SparkSession, d: str) -> DataFrame:
    names = read(spark, d, "part").select(F.concat("p_name", F.lit(" grade a")).alias("name"))
    return warehouse.fuzzy_match(names, read(spark, d, "part").select(F.col("p_name").alias("match")))


@query("""WITH a AS (SELECT d.doc_id, 'status' AS reason, CAST(quality AS DOUBLE) AS value FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE quality = 0)
SELECT * FROM a UNION ALL SELECT doc_id, 'confidence', CAST(n_chars AS DOUBLE) FROM documents WHERE n_chars <= 300 AND doc_id NOT IN (SELECT doc_id FROM a)""")
def q60_verdict_join(spark: SparkSession, d: str) -> DataFrame:
    reports = read(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("string").alias("status"), F.col("quality").cast("double").alias("precision_score"))
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("confidence"))
    return catalog.review_queue(reports, docs, ("0",), 300.0, None).withColumnRenamed("id", "doc_id")


@query("""SELECT c.user_id, c.event_id AS child, max_by(p.event_id, (p.ts, p.event_id)) AS parent FROM events c JOIN events p ON c.user_id = p.user_id AND p.event_type = 'signup' AND p.ts <= c.ts
WHERE c.event_type = 'purchase' GROUP BY ALL""")
def q61_asof_parent(spark: SparkSession, d: str) -> DataFrame:
    events = read(spark, d, "events").select("user_id", "ts", F.col("event_id").alias("id"), "event_type")
    return catalog.as_of_parent(events.filter("event_type = 'purchase'").drop("event_type"), events.filter("event_type = 'signup'").drop("event_type"), "user_id", "ts")


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1")
def q62_latest_message(spark: SparkSession, d: str) -> DataFrame:
    return conversations.latest_message(read(spark, d, "conversations"))


@query("""WITH h AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_text FROM conversations)
SELECT conv_id, turn, role, last_text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM h WHERE b <= 4""")
def q63_last_n_history(spark: SparkSession, d: str) -> DataFrame:
    out = conversations.history(conversations.carried(read(spark, d, "conversations")), 4)
    return out.select("conv_id", "turn", "role", "last_text", F.col("pos").cast("long").alias("pos"))


@query("SELECT count(*) FILTER (quality > 0) AS positive, count(*) FILTER (quality < 0) AS negative, count(*) FILTER (quality <> 0) AS count FROM labels")
def q64_feedback_stats(spark: SparkSession, d: str) -> DataFrame:
    return conversations.feedback(read(spark, d, "labels"), "quality")


_SQ = r"lower(trim(regexp_replace({}, '[ \t\n\r\x0B\x0C]+', ' ', 'g')))"


@query(f"""SELECT item_id AS quote_id, doc_id AS key, count(*) > 0 AS verified FROM benchmark JOIN documents
ON contains({_SQ.format('documents.text')}, substr({_SQ.format('benchmark.text')}, 1, 40)) GROUP BY ALL""")
def q65_quote_verify(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark item is a quote, every document a chunk that it may come from."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    return conversations.find_quotes(read(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote")), docs.withColumnRenamed("doc_id", "key"))


@query(f"""WITH c AS (SELECT count(*) FILTER (n_chars > 1000 AND quality = 1) AS tp, count(*) FILTER (n_chars > 1000 AND quality = 0) AS fp, count(*) FILTER (n_chars <= 1000 AND quality = 1) AS fn, count(*) FILTER (n_chars <= 1000 AND quality = 0) AS tn FROM labels JOIN documents USING (doc_id)),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0e0 END AS p, CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0e0 END AS r FROM c)
SELECT tp, fp, fn, tn, {_round('p', 6)} AS precision, {_round('r', 6)} AS recall, {_round('CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0e0 END', 6)} AS f1 FROM m""")
def q66_precision_recall(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return evaluate.confusion(rows, F.col("n_chars") > 1000, F.col("quality") == 1)


@query(f"""WITH {_COS}, ql AS (SELECT vec_id AS query_id, label AS ql FROM embeddings),
r AS (SELECT query_id, label IS NOT DISTINCT FROM ql AS rel, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS pos FROM c JOIN ql USING (query_id)),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, pos) AS k FROM r WHERE pos < 10)
SELECT query_id, {_round('CASE WHEN sum(CASE WHEN rel THEN 1e0 / log2(k + 1) ELSE 0e0 END) > 0 THEN sum(CASE WHEN rel THEN 1e0 / log2(pos + 2) ELSE 0e0 END) / sum(CASE WHEN rel THEN 1e0 / log2(k + 1) ELSE 0e0 END) ELSE 0e0 END', 6)} AS ndcg FROM t GROUP BY 1""")
def q67_ndcg(spark: SparkSession, d: str) -> DataFrame:
    vectors = read(spark, d, "embeddings")
    hits = retrieval.dense_top_k(vectors, _vector_queries(spark, d))
    labels = vectors.select("vec_id", "label")
    hits = hits.join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    return evaluate.ndcg(hits.withColumn("relevant", F.col("label").eqNullSafe(F.col("own"))))


@query(f"""WITH m AS (SELECT {_HASH} AS h FROM documents WHERE source IN ('src1', 'src2'))
SELECT h AS text_hash, min(doc_id) AS doc_id FROM (SELECT {_HASH} AS h, doc_id FROM documents) WHERE h NOT IN (SELECT h FROM m) GROUP BY 1""")
def q70_incremental_skip(spark: SparkSession, d: str) -> DataFrame:
    """What remains to be taken up when two sources have been: the manifest lists their hashes."""
    docs = read(spark, d, "documents").select("doc_id", "source", T.text_hash(F.col("text")).alias("text_hash"))
    done = docs.filter(F.col("source").isin("src1", "src2")).select("text_hash").distinct()
    return docs.join(done, "text_hash", "left_anti").groupBy("text_hash").agg(F.min("doc_id").alias("doc_id"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
