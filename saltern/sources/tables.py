"""Stored tables and file sources: versioned upserts, manifests, prices, rules, uploads, exports.

A table is a folder of versions; a write makes a new version and then moves a one-row pointer, so
a reader never meets a half-written table and nothing is overwritten while it is read.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltern.functions.text import page_text, slug
from saltern.operators.catalog import best, upsert
from saltern.sources.shared import written


class Table:
    """A Parquet table with upsert and delete by key."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str]):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key

    def _version(self) -> str | None:
        try:
            row = self.spark.read.schema("version string, at timestamp").json(f"{self.path}/current").orderBy(F.desc("at")).first()
        except AnalysisException:
            return None
        return row["version"] if row else None

    def read(self) -> DataFrame:
        version = self._version()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{version}") if version else self.spark.createDataFrame([], self.schema)

    def write(self, rows: DataFrame) -> None:
        version = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/{version}")
        self.spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("at")).coalesce(1).write.mode("append").json(f"{self.path}/current")

    def upsert(self, rows: DataFrame) -> None:
        """Rows replace those of their keys; of repeated keys, the last by ``pos_`` if there is one."""
        new = rows if "pos_" in rows.columns else rows.withColumn("pos_", F.lit(0))
        self.write(upsert(self.read().withColumn("pos_", F.lit(0)), new, self.key, "pos_").drop("pos_"))

    def delete(self, keys: DataFrame) -> None:
        self.write(self.read().join(keys.select(*self.key), self.key, "left_anti"))

    def clear(self) -> None:
        self.write(self.read().limit(0))

    def count(self) -> int:
        return self.read().count()


def files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, doc_id, length, sha256, content) of a folder's files, without lock files."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return rows.filter(~name.startswith("~$")).select("path", slug(F.col("path")).alias("doc_id"), "length", F.sha2("content", 256).alias("sha256"), "content")


def text_pages(spark: SparkSession, path: str, glob: str = "*.txt", least: int = 40) -> DataFrame:
    """(doc_id, pdf_page, text) of text files whose pages a form feed parts; short pages are dropped."""
    rows = files(spark, path, glob).select("doc_id", F.posexplode(F.split(F.col("content").cast("string"), "\f")).alias("at", "text"))
    return rows.select("doc_id", (F.col("at") + 1).alias("pdf_page"), page_text(F.col("text")).alias("text")).filter(F.char_length("text") >= least)


def csv_text(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, all values as text, with ``pos`` in file order."""
    return spark.read.csv(path, header=True, inferSchema=False).withColumn("pos", F.monotonically_increasing_id())


def regulatory_rules(spark: SparkSession, csv_path: str, json_path: str) -> DataFrame:
    """(ingredient, aliases, market, status, max_percent, source_ref) of both kinds of rule files."""
    limits = spark.read.csv(csv_path, header=True, inferSchema=False)
    limits = limits.select("ingredient", F.array().cast("array<string>").alias("aliases"), "market", "status", F.col("max_percent").try_cast("double").alias("max_percent"), "source_ref")
    schema = "ingredient string, aliases array<string>, market string, status string, source_ref string"
    named = spark.read.schema(schema).json(json_path, multiLine=True)
    return limits.unionByName(named.select("ingredient", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "market", "status", F.lit(None).cast("double").alias("max_percent"), "source_ref"))


def substitution_rules(spark: SparkSession, path: str) -> DataFrame:
    schema = "`from` string, aliases_from array<string>, `to` string, aliases_to array<string>, product_types array<string>, reason string, confidence double"
    return spark.read.schema(schema).json(path, multiLine=True)


def feedback_log(spark: SparkSession, path: str) -> DataFrame:
    """Feedback lines; broken lines are passed over."""
    return spark.read.schema("message_id string, rating int, at string, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path).filter("_corrupt IS NULL").drop("_corrupt")


def export_csv(lines: DataFrame, path: str) -> None:
    """A recipe's lines as CSV, one file."""
    lines.orderBy("line_no").select("raw_name", "amount", "unit", "phase").coalesce(1).write.mode("errorifexists").csv(path, header=True)


def markdown(lines: DataFrame) -> DataFrame:
    """(formulation_id, text): each recipe's table in Markdown."""
    cell = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    row = F.concat(F.lit("| "), cell(F.col("raw_name")), F.lit(" | "), cell(F.col("amount")), F.lit(" | "), cell(F.col("unit")), F.lit(" |"))
    items = F.sort_array(F.collect_list(F.struct("line_no", row.alias("row"))))
    head = F.lit("| Ingredient | Amount | Unit |\n| --- | --- | --- |")
    return lines.groupBy("formulation_id").agg(F.concat_ws("\n", head, F.transform(items, lambda x: x["row"])).alias("text"))


def sample_excerpts(chunks: DataFrame, n: int, seed: str, least: int = 80) -> DataFrame:
    """A seeded sample of distinct chunks with enough text."""
    rows = chunks.filter(F.char_length("text") >= least).withColumn("head_", F.substring("text", 1, 200)).dropDuplicates(["head_"])
    return rows.orderBy(F.xxhash64("head_", F.lit(seed))).limit(n).drop("head_")


def resolve_sources(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(asked, doc_id): each asked name's document: by its id, its lower-case id, its slug, else the
    first id that begins with the slug or that the slug begins with. ``asked``: asked; ``known``: doc_id.

    Joins are merged: prefixes are many times the rows that a plan expects, too many to be broadcast on its word."""
    known = known.select("doc_id").distinct().hint("merge")
    own = asked.select("asked").distinct().withColumn("key", F.btrim("asked")).filter("key <> ''")
    own = own.withColumn("slug", F.btrim(F.regexp_replace(F.lower("key"), r"[^a-z0-9]+", "_"), F.lit("_")))
    keys = own.select("asked", F.posexplode(F.array_distinct(F.array("key", F.lower("key"), "slug"))).alias("stage", "try"))
    exact = keys.join(known, F.col("try") == F.col("doc_id")).groupBy("asked").agg(F.min_by("doc_id", "stage").alias("doc_id"))
    # A prefix of either side is an equi-join on the slug's own prefixes and on the ids' prefixes, of lengths that the other side has.
    left = written(own.join(exact.hint("merge"), "asked", "left_anti").filter("slug <> ''").select("asked", "slug"), "unresolved").hint("merge")
    lengths = lambda df, c: F.array(*[F.lit(r["n"]) for r in df.select(F.char_length(c).alias("n")).filter("n > 0").distinct().sort("n").collect()]).cast("array<int>")
    cut = lambda c, sizes: F.transform(F.filter(sizes, lambda k: k <= F.char_length(c)), lambda k: F.substring(F.col(c), F.lit(1), k))
    longer = known.select("doc_id", F.explode(cut("doc_id", lengths(left, "slug"))).alias("slug")).hint("merge").join(left, "slug").select("asked", "doc_id")
    shorter = left.select("asked", F.explode(cut("slug", lengths(known, "doc_id"))).alias("doc_id")).hint("merge").join(known, "doc_id").select("asked", "doc_id")
    near = longer.unionByName(shorter).groupBy("asked").agg(F.min("doc_id").alias("doc_id"))
    return exact.unionByName(near)


def sample_recipes(formulations: DataFrame, n: int, least: int = 3, shown: int = 12, most: int = 1200) -> DataFrame:
    """(id, text): the richest recipes (id, name, confidence, ingredients), one of each name, as excerpts."""
    rows = formulations.filter(F.size("ingredients") >= least).withColumn("head_", F.substring(F.lower("name"), 1, 60))
    rows = best(rows, ["head_"], [F.size("ingredients").desc(), F.col("confidence").desc(), F.col("id")])
    line = lambda x: F.concat(F.lit("- "), x["raw_name"], F.when(x["amount"].isNotNull(), F.concat_ws(" ", F.lit(""), x["amount"].cast("string"), x["unit"])).otherwise(""))
    text = F.concat_ws("\n", F.concat(F.lit("Formula: "), "name"), F.array_join(F.transform(F.slice("ingredients", 1, shown), line), "\n"))
    return rows.orderBy(F.size("ingredients").desc(), F.col("confidence").desc(), "id").limit(n).select("id", F.substring(text, 1, most).alias("text"))
