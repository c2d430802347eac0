"""Mixing sources to target weights by hierarchical budgets.

Documents are leaves of a domain-language-source tree. A node's budget goes to its children in
proportion to their weights, no child getting more than its subtree can give (its tokens times
``max_epochs``); what a child cannot take goes to its siblings, so a shortage is made up among
siblings first, and reaches other subtrees only through a parent that is itself exhausted. A leaf with a weight of 0 at any level can take nothing, and no node above it counts on
it. Each leaf then takes whole seeded epochs and, of the next epoch, the longest prefix in seeded order
whose tokens fit: documents whose hash does not exceed the leaf's cutoff.

Only leaf totals meet in windows. The cutoff comes from totals of ``SLICES`` hash slices a leaf and
the rows of one slice, so a leaf with a third of all rows is no task's burden. The final choice
filters the documents by their leaf's cutoff, without a shuffle while the leaves are few.

Tokens are words `[^\\x20\\x09-\\x0D]+`. Documents without tokens (null, empty or blank text) are
never taken. Null lang and source are leaves named ``""``. Rows with one id stand or fall together,
and null ids share a place. Empty input gives an empty result; a total above what the tree can give
takes everything ``max_epochs`` times. Columns that the result adds replace those of the same name.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saltern.llm.common import written

SLICES_DIGITS = 3
#: Leaves (about 200 bytes each, so 20 MB) up to which their cutoffs are broadcast.
BROADCAST_LEAVES = 100_000
LEVELS = ["domain", "lang", "source"]


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """Four domains by the first hexadecimal digit of the source's MD5, where no other rule is given."""
    digit = F.substring(F.md5(source.cast("binary")), 1, 1)
    return F.when(digit < "4", "d0").when(digit < "8", "d1").when(digit < "c", "d2").otherwise("d3")


def place(seed: str, epoch: Column, key: Column) -> Column:
    """Where a row stands in the seeded order of an epoch."""
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))


def _weight(level: str, weights: dict[str, dict[str, float]]) -> Column:
    out = F.lit(1.0)
    for name, weight in weights.get(level, {}).items():
        if weight < 0:
            raise ValueError("weights must not be negative")
        out = F.when(F.col(level) == name, float(weight)).otherwise(out)
    return out


def fill(children: DataFrame, parent: list[str], own: str) -> DataFrame:
    """``children`` with ``share``: of their parent's ``budget`` by ``weight``, at most ``cap``."""
    group = Window.partitionBy(*parent)
    ranked = group.orderBy(F.col("cap") / F.col("weight"), own).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    out = children.filter("weight > 0").withColumns({
        "cap_before": F.coalesce(F.sum("cap").over(ranked), zero),
        "left": F.sum("weight").over(group) - F.coalesce(F.sum("weight").over(ranked), zero),
    })
    full = F.col("cap_before") + F.col("cap") / F.col("weight") * F.col("left") <= F.col("budget")
    out = out.withColumn("full", full)
    free = F.sum(F.when(~F.col("full"), F.col("weight"))).over(group)
    rest = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(group), zero)
    return out.withColumn("share", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * rest / free)).drop("cap_before", "left", "full")


def budgets(leaves: DataFrame, weights: dict[str, dict[str, float]] | None = None, fraction: float = 0.5, total: int | None = None, max_epochs: int = 3) -> DataFrame:
    """``leaves`` (domain, lang, source, supply) with ``budget`` (tokens), ``epochs`` (whole ones) and ``rest``."""
    weights = weights or {}
    usable = reduce(and_, [_weight(level, weights) > 0 for level in LEVELS])
    leaves = leaves.withColumn("cap", F.when(usable, F.col("supply") * max_epochs).otherwise(0).cast("double"))
    root = leaves.agg(F.sum("cap").alias("cap"), F.sum("supply").alias("supply")).select(F.least("cap", F.lit(float(total)) if total is not None else F.floor(F.col("supply") * F.lit(float(fraction))).cast("double")).alias("budget"))
    parent, above = [], root
    for depth, level in enumerate(LEVELS):
        nodes = leaves.filter("cap > 0").groupBy(*parent, level).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(level, weights))
        nodes = nodes.join(above, parent) if parent else nodes.crossJoin(F.broadcast(above))  # the root is one row
        parent = [*parent, level]
        above = fill(nodes, parent[:-1] or [F.lit(0)], level).select(*parent, F.col("share").alias("budget"))
    out = leaves.drop("cap").join(above.select(*LEVELS, F.floor("budget").cast("long").alias("budget")), LEVELS, "left").fillna(0, ["budget"])
    whole = F.when(F.col("supply") > 0, F.floor(F.col("budget") / F.col("supply"))).otherwise(F.lit(0)).cast("int")
    return out.withColumn("epochs", whole).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("supply"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", domain: Column | None = None, weights: dict[str, dict[str, float]] | None = None, fraction: float = 0.5, total: int | None = None, max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """The chosen rows, once for each epoch that takes them, with ``mix_domain``, ``mix_tokens`` and ``mix_epoch``."""
    none = F.lit("")
    leaf = [F.coalesce(domain if domain is not None else domain_of(F.coalesce(F.col(f"`{source}`"), none)), none).alias("domain"), F.coalesce(F.col(f"`{lang}`"), none).alias("lang"), F.coalesce(F.col(f"`{source}`"), none).alias("source")]
    slim = written(docs.select(F.col(f"`{key}`").alias("key"), *leaf, tokens(F.col(f"`{text}`")).alias("n")).filter("n > 0"), "mix-slim")
    plan = written(budgets(slim.groupBy(*LEVELS).agg(F.sum("n").alias("supply")), weights, fraction, total, max_epochs), "mix-budgets")
    small = plan.count() <= BROADCAST_LEAVES
    listed = F.broadcast if small else (lambda x: x)

    own = slim.join(listed(plan.filter("rest > 0").select(*LEVELS, "epochs", "rest")), LEVELS).withColumn("place", place(seed, F.col("epochs"), F.col("key")))
    own = own.withColumn("slice", F.substring("place", 1, SLICES_DIGITS))
    slices = own.groupBy(*LEVELS, "rest", "slice").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("slice").rowsBetween(Window.unboundedPreceding, 0))
    edge = slices.withColumn("upto", upto).filter("upto > rest").groupBy(*LEVELS).agg(F.min(F.struct("slice", (F.col("upto") - F.col("n")).alias("before"))).alias("x"))
    edge = edge.select(*LEVELS, F.col("x.slice").alias("slice"), F.col("x.before").alias("before"))  # of each leaf, the slice where the rest ends
    inside = own.join(listed(edge), [*LEVELS, "slice"])
    so_far = F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("place").rangeBetween(Window.unboundedPreceding, 0))
    last = inside.withColumn("so_far", F.col("before") + so_far).filter("so_far <= rest").groupBy(*LEVELS).agg(F.max("place").alias("last"))
    cut = plan.join(edge, LEVELS, "left").join(last, LEVELS, "left")
    # Every place below the edge's slice is in; without an edge the whole epoch would be, which budgets exclude.
    cut = written(cut.select(*LEVELS, "epochs", "rest", F.coalesce("last", "slice").alias("cutoff")), "mix-cutoffs")

    columns = [c for c in docs.columns if c not in ("mix_domain", "mix_tokens", "mix_epoch")]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)], *leaf, F.col(f"`{key}`").alias("key"), tokens(F.col(f"`{text}`")).alias("n")).filter("n > 0")
    rows = rows.join(listed(cut), LEVELS)
    partly = (F.col("rest") > 0) & (place(seed, F.col("epochs"), F.col("key")) <= F.col("cutoff"))
    times = F.col("epochs") + F.when(F.coalesce(partly, F.lit(False)), 1).otherwise(0)
    rows = rows.withColumn("epoch", F.explode(F.when(times > 0, F.sequence(F.lit(0), times - 1)).otherwise(F.array().cast("array<int>"))))
    return rows.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(columns)], F.col("domain").alias("mix_domain"), F.col("n").alias("mix_tokens"), F.col("epoch").alias("mix_epoch"))
