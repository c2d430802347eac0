"""Merkle manifest of a dataset: a tree of SHA-256 digests over the rows of each source, and one over
the sources' subroots, with each row's proof.

H is the lowercase hex SHA-256 of its inputs, concatenated; digests enter as hex text. A row's leaf
is H of its fields, each ``-`` if null, else its number of UTF-8 bytes, ``:`` and its value. Per source, leaves
ascend by id; every ``fanout`` consecutive nodes (the last run: fewer, even one) become their H
while several remain. What remains is the source's subroot, a lone leaf itself. Subroots, ordered by
source, give the root in the same way.

Leaves are numbered without a window over a source: rows are dealt by ranges of (source, id, leaf,
locator), written, counted by range and source, and numbered within both; the counts' running
sums give each range its first number. So a source that holds most rows is many tasks. Then, level by
level, nodes are grouped by (source, number div fanout) and their sorted digests hashed; each level
is a table a ``fanout``-th of the size of the one below, and holds the digests of each run. On the
way down, one join a level with the runs appends each node's siblings to the path above it; leaves
come out of the lowest runs, so they are never shuffled with their paths. Recomputing a root folds
a leaf through its path.

Defined results: null ids come first, sources ascend bytewise with null first. Rows that agree in
id and source are ordered by leaf; equal leaves have proofs of their own. A table without rows has
none in the result. Columns other than the fields are not looked at. Everything is DataFrame
operations.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saltern.llm.common import drop_written, written
from saltern.llm.exact_dedup import located, position, spot

FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of a range, and with it of a task, that are numbered together.
RANGE_ROWS = 200_000


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def digest(data: Column) -> Column:
    """SHA-256 as bytes: half the size of its hex text."""
    return F.unhex(F.sha2(data.cast("binary"), 256))


def leaf(fields: Sequence[Column]) -> Column:
    text = [x.cast("string") for x in fields]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(x), F.lit(":"), x), F.lit("-")) for x in text]))


def numbered(rows: DataFrame, group: str, order: list[str], size: int) -> DataFrame:
    """``rows`` with ``number``, from 0 on in each group, and ``nodes``, the group's rows, without a task that
    holds a whole group. ``size``: the number of rows; what ``order`` leaves equal must be interchangeable."""
    parts = max(1, -(-size // RANGE_ROWS), rows.sparkSession.sparkContext.defaultParallelism if size > 1000 else 1)
    dealt = written(rows.repartitionByRange(parts, group, *order).withColumn("range", F.spark_partition_id()), "merkle-ranges")
    counts = dealt.groupBy(group, "range").agg(F.count("*").alias("n"))
    whole = Window.partitionBy(group)
    counts = written(counts.select(group, "range", (F.sum("n").over(whole.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"), F.sum("n").over(whole).alias("nodes")), "merkle-counts")
    place = F.row_number().over(Window.partitionBy(group, "range").orderBy(*order))
    out = dealt.withColumn("number", place).join(counts, [group, "range"]).withColumn("number", F.col("before") + F.col("number") - 1).drop("before", "range")
    out.saltern_tables = [dealt, counts]
    return out


def _up(level: DataFrame, fanout: int) -> DataFrame:
    """Runs of a level: ``tree``, ``number`` of the parent, ``nodes`` on its level, ``run`` and ``digest``."""
    runs = level.groupBy("tree", F.expr(f"number div {fanout}").alias("number")).agg(
        F.expr(f"(max(nodes) + {fanout - 1}) div {fanout}").alias("nodes"),
        F.array_sort(F.collect_list(F.struct(F.col("number").alias("at"), "digest", "row"))).alias("run"),
    )
    return runs.withColumn("digest", digest(F.array_join(F.transform("run", lambda x: _hex(x["digest"])), "")))


def levels(leaves: DataFrame, fanout: int, most: int) -> tuple[list[DataFrame], DataFrame]:
    """The tables of runs above ``leaves`` (tree, number, nodes, digest, row), up to the tree of ``most``
    leaves, and the top node of each tree."""
    out, level, nodes = [], leaves, most
    tops = leaves.filter("nodes = 1").select("tree", "digest")
    while nodes > 1:
        level = written(_up(level.filter("nodes > 1"), fanout), "merkle-level")
        tops = tops.unionByName(level.filter("nodes = 1").select("tree", "digest"))
        out.append(level)
        level = level.withColumn("row", F.lit(None).cast(leaves.schema["row"].dataType))
        nodes = -(-nodes // fanout)
    return out, tops


def _down(runs: list[DataFrame], tops: DataFrame, leaves: DataFrame) -> DataFrame:
    """The leaves' ``row``, ``digest`` and ``path``, from the leaf up; ``tops``: tree, path and what else goes down."""
    more = [c for c in tops.columns if c not in ("tree", "path")]
    above = None
    for level in [*runs[::-1], None]:
        top = (leaves if level is None else level).filter("nodes = 1")
        here = top.select("tree", "number", *(["digest", "row"] if level is None else [])).join(tops, "tree")
        if above is not None:
            here = here.unionByName(above if level is None else above.select(*here.columns))
        if level is None:
            return here.select("row", "digest", "path", *more)
        side = lambda low, size: F.array_join(F.transform(F.slice("run", low, size), lambda x: _hex(x["digest"])), "")
        child = F.explode(F.transform("run", lambda x, k: F.struct(x["at"].alias("number"), x["digest"].alias("digest"), x["row"].alias("row"), F.struct(F.unhex(side(F.lit(1), k)).alias("left"), F.unhex(side(k + 2, F.size("run"))).alias("right")).alias("step"))))
        inner = here.join(level.select("tree", "number", "run"), ["tree", "number"])
        above = inner.select("tree", child.alias("x"), "path", *more).select("tree", "x.number", "x.digest", "x.row", F.concat(F.array("x.step"), "path").alias("path"), *more)


def folded(own: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path give."""
    return F.aggregate(path, own, lambda at, step: digest(F.concat(_hex(step["left"]), _hex(at), _hex(step["right"]))))


def proof(path: Column) -> Column:
    """The siblings' digests along a path as hex text, one after the other."""
    return F.array_join(F.transform(path, lambda x: F.concat(_hex(x["left"]), _hex(x["right"]))), "")


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, key: str = "doc_id", source: str = "source", fanout: int = FANOUT, tampered: Callable[[dict[str, Column]], dict[str, Column]] | None = None) -> DataFrame:
    """One row a document: ``id``, ``source``, ``leaf``, ``subroot`` and ``root`` (hex), ``path`` (array of the
    digests left and right of the node, as bytes, from the leaf to the root) and ``own``: the leaf of
    the fields that ``tampered`` gives from the original ones, or the leaf itself, as bytes."""
    if fanout < 2:
        raise ValueError("fanout is 2 at least")
    rows = located(docs)
    columns = {c: F.col(position(docs.columns, c)) for c in fields}
    id_, from_ = (F.col(position(docs.columns, c)) for c in (key, source))
    own = leaf([(columns | tampered(columns))[c] for c in fields]) if tampered else F.lit(None).cast("binary")
    tree = F.coalesce(F.concat(F.lit("s"), from_.cast("string")), F.lit(""))  # orders as the sources do, null first
    rows = rows.select(tree.alias("tree"), id_.alias("id"), leaf(list(columns.values())).alias("digest"), own.alias("own"), spot().alias("spot"), F.col("saltern_at.row").alias("at"))
    leaves = numbered(rows, "tree", ["id", "digest", "spot", "at"], docs.count())
    leaves_of = leaves.saltern_tables
    leaves = leaves.select("tree", "number", "nodes", "digest", F.struct("id", "own").alias("row"))
    most = leaves_of[1].agg(F.coalesce(F.max("nodes"), F.lit(0))).first()[0]
    runs, subroots = levels(leaves, fanout, most)

    subroots = written(subroots, "merkle-subroots")
    trees = subroots.count()
    tips = numbered(subroots.select(F.lit("").alias("all"), "tree", "digest"), "all", ["tree"], trees)
    tips = tips.select(F.col("all").alias("tree"), "number", "nodes", "digest", F.struct(F.col("tree").alias("of")).alias("row"))
    over, root = levels(tips, fanout, trees)
    root = root.select("tree", F.array().cast("array<struct<left:binary,right:binary>>").alias("path"), F.col("digest").alias("root"))
    tops = _down(over, root, tips).select(F.col("row.of").alias("tree"), F.col("digest").alias("subroot"), "path", "root")

    out = _down(runs, written(tops, "merkle-tops"), leaves)
    drop_written(subroots)
    name = F.col("row.id").alias("id")
    return out.select(name, _hex(F.col("digest")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), _hex(F.col("root")).alias("root"), "path", F.coalesce("row.own", "digest").alias("own"))


def verify(out: DataFrame) -> DataFrame:
    """``out`` of `manifest` with ``folded_root`` (hex), recomputed from ``own``, and ``verified``."""
    out = out.withColumn("folded_root", _hex(folded(F.col("own"), F.col("path"))))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
