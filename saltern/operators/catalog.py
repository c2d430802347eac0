"""Catalogue queries: filters, semi and anti joins, nesting, quality, best rows and upserts.

``formulations``: id, name, product_types, doc_id, confidence ...; ``lines``: formulation_id,
raw_name, normalized_name, amount, unit, phase, line_no.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filters:
    doc_id: str | None = None
    name: str | None = None
    ingredient: str | None = None
    product_types: tuple[str, ...] = ()
    banned: tuple[str, ...] = field(default=())
    limit: int | None = 50


def mentions(terms: tuple[str, ...]) -> Column:
    """A line that names one of the terms, in its raw or normalised name."""
    out = F.lit(False)
    for term in terms:
        out = out | F.lower("raw_name").contains(term.lower()) | F.coalesce(F.lower("normalized_name").contains(term.lower()), F.lit(False))
    return out


def search(formulations: DataFrame, lines: DataFrame, filters: Filters) -> DataFrame:
    """Formulations that pass every given filter, best confidence first.

    The ingredient and banned filters are semi and anti joins on the id, so no DISTINCT is needed
    and the line predicate is evaluated before the shuffle.
    """
    out = formulations
    if filters.doc_id is not None:
        out = out.filter(F.col("doc_id") == filters.doc_id)
    if filters.name:
        out = out.filter(F.lower("name").contains(filters.name.lower()))
    if filters.product_types:
        out = out.filter(F.forall(F.array(*map(F.lit, filters.product_types)), lambda t: F.array_contains("product_types", t)))
    if filters.ingredient:
        out = out.join(lines.filter(mentions((filters.ingredient,))).select(F.col("formulation_id").alias("id")), "id", "left_semi")
    if filters.banned:
        out = out.join(lines.filter(mentions(filters.banned)).select(F.col("formulation_id").alias("id")), "id", "left_anti")
    if filters.limit is None:
        return out
    return out.orderBy(F.col("confidence").desc(), "id").limit(filters.limit)


def nested(formulations: DataFrame, lines: DataFrame, order: list[str]) -> DataFrame:
    """Formulations with their lines as an array in ``order``."""
    own = [c for c in lines.columns if c not in ("formulation_id", *order)]
    items = lines.groupBy(F.col("formulation_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct(*order, *own))).alias("ingredients"))
    return formulations.join(items, "id", "left").withColumn("ingredients", F.coalesce("ingredients", F.array().cast(items.schema["ingredients"].dataType)))


def best(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("rank_", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("rank_ = 1").drop("rank_")


def average_children(lines: DataFrame, parent: str) -> DataFrame:
    """The average number of lines of a parent that has some."""
    return lines.groupBy(parent).agg(F.count("*").alias("n")).agg(F.avg("n").alias("avg_children"), F.count("*").alias("parents"))


# The quality gate of an ingested catalogue.
GATE = {"six_plus": 0.45, "amounts": 0.80, "procedure": 0.25, "median": 5, "two_only": 0.08}


def quality(formulations: DataFrame, lines: DataFrame, high: float = 0.85) -> DataFrame:
    """One row: shares, exact median and mean of the numbers of ingredients."""
    per = lines.groupBy(F.col("formulation_id").alias("id")).agg(F.count("*").alias("n"), F.max(F.col("amount").isNotNull()).alias("amounts"))
    both = formulations.select("id", "confidence").join(per, "id", "left").fillna(0, ["n"])
    share = lambda c: F.avg(c.cast("double"))
    return both.agg(
        F.count("*").alias("total"),
        share(F.col("n") >= 6).alias("six_plus"),
        share(F.coalesce("amounts", F.lit(False))).alias("with_amounts"),
        share(F.col("confidence") >= high).alias("confident"),
        share(F.col("n") == 2).alias("two_only"),
        F.median("n").cast("double").alias("median_lines"),
        F.avg("n").alias("mean_lines"),
    )


def audit(formulations: DataFrame, lines: DataFrame, high: float = 0.85, thin: int = 8) -> DataFrame:
    """`quality` with the share of recipes that have a procedure, recipes by extraction method (a map), and examples of the
    surest recipes of fewer than six lines. ``formulations`` with name, extraction_method and procedure.

    One row, also without recipes: shares are 0 then, and the median and mean of lines too. A null method counts
    as "unknown"; of equally sure examples those of fewer lines, then of smaller ids, come first."""
    method = F.coalesce("extraction_method", F.lit("unknown"))
    shares = quality(formulations, lines, high).fillna(0.0)
    more = formulations.agg(F.coalesce(F.avg((F.coalesce(F.size("procedure"), F.lit(0)) > 0).cast("double")), F.lit(0.0)).alias("with_procedure"))
    counts = formulations.groupBy(method.alias("m")).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("m", "n")))).alias("by_method"))
    per = lines.groupBy(F.col("formulation_id").alias("id")).agg(F.count("*").alias("n"))
    few = formulations.select("id", "name", "confidence", method.alias("m")).join(per, "id", "left").fillna(0, ["n"]).filter("n < 6")
    few = few.orderBy(F.col("confidence").desc(), "n", "id").limit(thin)
    text = F.format_string("%s (%d ing, %s, conf=%.2f)", F.substring("name", 1, 50), "n", "m", "confidence")
    few = few.agg(F.sort_array(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "n", "id", text.alias("t")))).alias("x")).select(F.transform("x", lambda x: x["t"]).alias("thin_examples"))
    for one in (more, counts, few):  # one row each
        shares = shares.crossJoin(F.broadcast(one))
    return shares


def gate_failures(report: dict[str, float], gate: dict[str, float] | None = None) -> list[str]:
    """Names of the thresholds that a quality report misses."""
    gate = gate or GATE
    low = [k for k, c in (("six_plus", "six_plus"), ("amounts", "with_amounts"), ("procedure", "with_procedure"), ("median", "median_lines")) if c in report and report[c] < gate[k]]
    return low + ["two_only"] * (report.get("two_only", 0) > gate["two_only"])


def upsert(old: DataFrame, new: DataFrame, key: list[str], pos: str = "pos") -> DataFrame:
    """Rows of both, the last of a key winning; new rows come after old ones. ``pos`` orders a side."""
    both = old.withColumn("side_", F.lit(0)).unionByName(new.withColumn("side_", F.lit(1)), allowMissingColumns=True)
    return best(both, key, [F.col("side_").desc(), F.col(pos).desc()]).drop("side_")


def patch(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows with the non-null values of ``changes`` in place of their own."""
    fields = [c for c in changes.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"new_{c}") for c in fields])
    out = rows.join(new, key, "left")
    return out.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns])


def review_queue(reports: DataFrame, formulations: DataFrame, statuses: tuple[str, ...], confidence_max: float, limit: int | None = 50) -> DataFrame:
    """Reported formulations of the statuses, then those of low confidence that are not among them."""
    bad = reports.filter(F.col("status").isin(*statuses)).join(formulations, "id").select("id", F.lit("status").alias("reason"), F.col("precision_score").alias("value"))
    low = formulations.filter(F.col("confidence") <= confidence_max).join(bad.select("id"), "id", "left_anti").select("id", F.lit("confidence").alias("reason"), F.col("confidence").alias("value"))
    out = bad.unionByName(low)
    return out if limit is None else out.orderBy(F.col("reason").desc(), "value", "id").limit(limit)


def as_of_parent(children: DataFrame, parents: DataFrame, by: str, at: str) -> DataFrame:
    """Each child with its key's latest parent at or before it: one shuffle of both sides together.

    ``parents`` and ``children``: by, at, id. Runs over the union, so no pair is ever made; a key
    with very many rows costs one sorted window, not a join product.
    """
    both = parents.select(by, at, F.col("id").alias("parent"), F.lit(0).alias("kind"), F.lit(None).cast(children.schema["id"].dataType).alias("child"))
    both = both.unionByName(children.select(by, at, F.lit(None).cast(parents.schema["id"].dataType).alias("parent"), F.lit(1).alias("kind"), F.col("id").alias("child")))
    frame = Window.partitionBy(by).orderBy(at, "kind", "parent").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("parent", F.last("parent", ignorenulls=True).over(frame)).filter("kind = 1 AND parent IS NOT NULL").select(by, "child", "parent")
