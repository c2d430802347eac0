"""A stored collection of vectors whose partitions are the cells of a coarse quantiser.

The first upsert fits the cells' centres by k-means on unit vectors, on a sample of at most
``SAMPLE_PER_CELL`` vectors a cell and ``SAMPLE_BYTES`` altogether (the rows of smallest hash); every row is then
put into the cell of its nearest centre. A commit names, for each cell, the segments that hold its
rows. An upsert writes one segment: new rows, and, of cells that hold older rows of the same keys,
the other rows; cells without such keys keep their files. A search reads only the cells that its queries
probe, with the payload's conditions pushed to the scan, and ranks by exact cosines.

Queries for which the probed cells have fewer than ``top_k`` rows under the conditions are searched in
all cells, so a narrow condition costs time and never rows. What a search can miss is a closer vector in
a cell that was not probed: `recall` measures that, `probes_for` gives the number of cells for a wanted
recall (vectors without clusters need many), ``nprobe=None`` probes all.

Defined results: vectors that are null, zero or hold null or non-finite components are not stored,
and as queries match nothing; a stored key whose new vector is such keeps its row. A vector of another
length than the collection's makes the upsert fail before anything is written. Rows without a key are left
out; of repeated keys in one upsert the smallest row stays. An empty collection has no results.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saltern.operators.retrieval import QUERY_BYTES, VECTOR_BYTES, _unit, dense_top_k, ranked
from saltern.sources.commits import commit, latest
from saltern.sources.shared import drop_written, new_path, written

#: Names of stored columns that the engine adds: a key of any name, and what a row's folder says.
KEY, CELL, SEGMENT = "saltern_key", "saltern_cell", "saltern_segment"
#: Cells at most: their centres go to every task, and a search lists them on the driver.
MOST_CELLS = 1024
SAMPLE_PER_CELL, SAMPLE_BYTES, ROUNDS = 64, 64 << 20, 12
#: Vectors on which the number of probed cells is settled, at most.
JUDGES = 256

# Types that a hit must have, and types for which plain text chunks are searched too.
ANCHOR_TYPES = ("anti_dandruff", "makeup", "deodorant", "toner", "soap")
RELAXED_TYPES = ("anti_dandruff", "toner", "deodorant", "makeup")


def payload_filter(types: Sequence[str], formulas: bool) -> tuple[list[Column], list[Column]]:
    """(must, should) over ``is_formula`` and ``product_types`` for a question's types; ``formulas``: it wants formulas."""
    has = lambda t: F.array_contains("product_types", t)
    must = [F.col("is_formula")] if formulas and not set(types) & set(RELAXED_TYPES) else []
    return must + [has(t) for t in types if t in ANCHOR_TYPES], [has(t) for t in types if t not in ANCHOR_TYPES]


def condition(must: Sequence[Column] = (), should: Sequence[Column] = ()) -> Column:
    """All of ``must``, and one of ``should`` if there are any."""
    return reduce(and_, [*must, *([reduce(or_, should)] if should else [])], F.lit(True))


def centres(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres of unit vectors: k-means by cosine; a cell that runs empty takes the row worst placed."""
    out = np.unique(sample, axis=0)
    out = out[np.random.default_rng(0).permutation(len(out))[:cells]]
    for _ in range(rounds):
        near = sample @ out.T
        cell = near.argmax(axis=1)
        sums = np.zeros_like(out)
        np.add.at(sums, cell, sample)
        worst = iter(np.argsort(near.max(axis=1), kind="stable"))
        for empty in np.flatnonzero(np.bincount(cell, minlength=len(out)) == 0):
            sums[empty] = sample[next(worst)]
        norms = np.linalg.norm(sums, axis=1)
        new = np.where(norms[:, None] > 1e-12, sums / np.maximum(norms, 1e-12)[:, None], out)
        if np.allclose(new, out):
            break
        out = new
    return out


def _assign(own: np.ndarray, column: str, n: int):
    """Rows with the ``n`` nearest cells of their vectors, one row a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _unit(batch.column(column), own.shape[1])
            near = np.argsort(-(x @ own.T), axis=1, kind="stable")[:, :n]
            out = batch.take(pa.array(np.repeat(rows, near.shape[1])))
            yield out.append_column(CELL, pa.array(near.ravel().astype(np.int32)))

    return run


def _hits(ids: pa.Array, asked: np.ndarray, keys: pa.Array, own: np.ndarray, top_k: int) -> pa.RecordBatch:
    """Scores of rows that can be among a query's first ``top_k``."""
    scores = own @ asked.T
    if len(own) > top_k:  # with all that could round to the last place
        last = np.partition(scores, len(own) - top_k, axis=0)[len(own) - top_k]
        at, q = np.nonzero(scores >= last[None, :] - 1e-5)
    else:
        at, q = (x.ravel() for x in np.indices(scores.shape))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(q)), keys.take(pa.array(at)), pa.array(scores[at, q])], names=["query_id", KEY, "score"])


def _scan(probes: pa.Table, top_k: int, dim: int):
    """Rows of cells against the queries that probe these cells."""
    rows, unit = _unit(probes["vector"].combine_chunks(), dim)
    ids, cells = probes["query_id"].combine_chunks().take(pa.array(rows)), probes[CELL].to_numpy()[rows]
    asked = {c: (ids.take(pa.array(at)), unit[at]) for c in np.unique(cells) for at in [np.flatnonzero(cells == c)]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, own = _unit(batch.column("embedding"), dim)
            cells, keys = batch.column(CELL).to_numpy()[rows], batch.column(KEY).take(pa.array(rows))
            for c in np.intersect1d(cells, list(asked)):
                at = np.flatnonzero(cells == c)
                yield _hits(*asked[c], keys.take(pa.array(at)), own[at], top_k)

    return run


def _tile(top_k: int, dim: int, schema: pa.Schema):
    """A tile of a cell's rows against a block of the queries that probe the cell."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        at, own = _unit(rows["embedding"].combine_chunks(), dim) if rows.num_rows else ((), ())
        asked_at, asked = _unit(queries["vector"].combine_chunks(), dim) if queries.num_rows else ((), ())
        if not len(at) or not len(asked_at):
            return schema.empty_table()
        keys, ids = rows[KEY].combine_chunks().take(pa.array(at)), queries["query_id"].combine_chunks().take(pa.array(asked_at))
        found = [_hits(ids, asked, keys[k : k + 4096], own[k : k + 4096], top_k) for k in range(0, len(own), 4096)]
        return pa.Table.from_batches(found).cast(schema)

    return run


class VectorCollection:
    """A collection in a folder of the shared file system.

    ``dim``: length of its vectors; ``key`` and ``kind``: name and type of its keys; ``payload``: further
    columns with types. A collection that was made with another length is refused.
    """

    def __init__(self, spark: SparkSession, path: str, dim: int, key: str = "vec_id", kind: str = "long", payload: str = ""):
        self.spark, self.path, self.dim, self.key = spark, path.rstrip("/"), dim, key
        self.schema = f"{KEY} {kind}, embedding array<float>" + (f", {payload}" if payload else "")
        self._state()

    def _state(self) -> tuple[int, dict]:
        number, state = latest(self.spark, self.path)
        if state and state["dim"] != self.dim:
            raise ValueError(f"the collection at {self.path} has vectors of {state['dim']} components, not {self.dim}; reset it or open it with its own length")
        return number, state or {"dim": self.dim, "centres": None, "cells": {}}

    def _rows(self, state: dict, cells: Sequence[int] | None = None) -> DataFrame:
        """Rows of the given cells, with ``cell``; only these cells' folders are listed."""
        wanted = state["cells"] if cells is None else {str(c): state["cells"][str(c)] for c in cells if str(c) in state["cells"]}
        paths = [f"{self.path}/data/{SEGMENT}={s}/{CELL}={c}" for c, v in wanted.items() for s in v["segments"]]
        schema = f"{self.schema}, {SEGMENT} string, {CELL} int"
        out = self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return out.drop(SEGMENT)

    def _named(self, rows: DataFrame) -> DataFrame:
        return rows.withColumnRenamed(KEY, self.key)

    def _where(self, rows: DataFrame, must: Sequence[Column], should: Sequence[Column]) -> DataFrame:
        """Rows under the conditions, which know the key by its own name."""
        return self._named(rows).filter(condition(must, should)).withColumnRenamed(self.key, KEY)

    def _usable(self, column: str) -> Column:
        x = F.col(column)
        return x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)

    def _centres(self, state: dict) -> np.ndarray:
        rows = self.spark.read.schema("cell int, centre array<double>").parquet(f"{self.path}/{state['centres']}").toArrow().sort_by("cell")
        return rows["centre"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, self.dim)

    def _fit(self, rows: DataFrame, cells: int | None) -> str:
        """Centres of a sample, written; the name of their folder."""
        count = rows.count()
        cells = min(cells or max(1, int(count**0.5)), MOST_CELLS)
        most = max(1, min(SAMPLE_PER_CELL * cells, SAMPLE_BYTES // (8 * self.dim)))
        sample = rows.orderBy(F.xxhash64(KEY), KEY).limit(most).select("embedding").toArrow()["embedding"].combine_chunks()
        found = centres(_unit(sample, self.dim)[1], cells)
        name = new_path(self.spark, "centres").rpartition("/")[2]
        self.spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(found)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{self.path}/{name}")
        return name

    def _segment(self, rows: DataFrame) -> tuple[str, dict[str, int]]:
        """Write rows with ``cell``; large cells become several files. The segment's name and its rows by cell."""
        name = new_path(self.spark, "s").rpartition("/")[2]
        where = f"{self.path}/data/{SEGMENT}={name}"
        rows.hint("rebalance", F.col(CELL)).write.partitionBy(CELL).parquet(where)
        counts = self.spark.read.schema(f"{self.schema}, {CELL} int").parquet(where).groupBy(CELL).count().collect()  # at most MOST_CELLS rows
        return name, {str(r[CELL]): r["count"] for r in counts}

    def _placed(self, rows: DataFrame, state: dict) -> DataFrame:
        return rows.mapInArrow(_assign(self._centres(state), "embedding", 1), f"{self.schema}, {CELL} int")

    def upsert(self, rows: DataFrame, cells: int | None = None) -> None:
        """Add rows, or put them in place of those of the same keys. ``cells``: for the first upsert, the square
        root of the rows by default."""
        number, state = self._state()
        kind = self.spark.createDataFrame([], self.schema).schema
        own = rows.select(F.col(f"`{self.key}`").cast(kind[KEY].dataType).alias(KEY), *[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in kind.fields[1:]]).filter(F.col(KEY).isNotNull() & self._usable("embedding"))
        rest = [f"`{f.name}`" for f in kind.fields[1:]]
        own = own.groupBy(KEY).agg(F.min(F.struct(*rest)).alias("row_")).select(KEY, "row_.*")
        own = written(own, "collection-rows")
        wrong = own.filter(F.size("embedding") != self.dim).count()
        if wrong:
            drop_written(own)
            raise ValueError(f"{wrong} vectors have not {self.dim} components; nothing was written")
        if own.isEmpty():
            drop_written(own)
            return
        if not state["centres"]:
            state = state | {"centres": self._fit(own, cells)}
        new, touched = self._placed(own, state), []
        if state["cells"]:
            keys = own.select(KEY)
            held = self._rows(state)
            touched = [r[CELL] for r in held.select(KEY, CELL).join(keys, KEY, "left_semi").select(CELL).distinct().collect()]
            if touched:
                new = new.unionByName(self._rows(state, touched).join(keys, KEY, "left_anti"))
        name, counts = self._segment(new)
        kept = {c: v for c, v in state["cells"].items() if int(c) not in set(touched)}
        for c, n in counts.items():
            before = kept.get(c, {"rows": 0, "segments": []})
            kept[c] = {"rows": before["rows"] + n, "segments": [*before["segments"], name]}
        commit(self.spark, self.path, number + 1, state | {"cells": kept})
        drop_written(own)

    def rebuild(self, cells: int | None = None) -> None:
        """Fit the centres again, on the rows of today, and write all rows as one segment."""
        number, state = self._state()
        if not state["cells"]:
            return
        rows = self._rows(state).drop(CELL)
        state = state | {"centres": self._fit(rows, cells)}
        name, counts = self._segment(self._placed(rows, state))
        commit(self.spark, self.path, number + 1, state | {"cells": {c: {"rows": n, "segments": [name]} for c, n in counts.items()}})

    def reset(self) -> None:
        """Make the collection empty."""
        number, _ = self._state()
        commit(self.spark, self.path, number + 1, {"dim": self.dim, "centres": None, "cells": {}})

    def stats(self) -> dict[str, int]:
        _, state = self._state()
        segments = {s for v in state["cells"].values() for s in v["segments"]}
        return {"points": sum(v["rows"] for v in state["cells"].values()), "cells": len(state["cells"]), "segments": len(segments)}

    def read(self) -> DataFrame:
        """All rows."""
        return self._named(self._rows(self._state()[1]).drop(CELL))

    def search(self, queries: DataFrame, top_k: int = 10, nprobe: int | None = 8, must: Sequence[Column] = (), should: Sequence[Column] = (), limit_bytes: int = QUERY_BYTES) -> DataFrame:
        """(query_id, key, score, pos). ``queries``: query_id, vector; ``nprobe``: cells for each query.

        The queries' bytes, once for each probed cell, are measured: up to ``limit_bytes`` they go to the tasks that
        read the cells; more are dealt in blocks to tiles of their cells, so that no cell is one task's work.
        """
        _, state = self._state()
        asked = queries.select("query_id", "vector").filter(self._usable("vector") & (F.size("vector") == self.dim))
        types = {f.name: f.dataType.simpleString() for f in [*asked.schema, *self.spark.createDataFrame([], self.schema).schema]}
        schema = f"query_id {types['query_id']}, {KEY} {types[KEY]}, score double"
        if not state["cells"]:
            return self._named(ranked(self.spark.createDataFrame([], schema), KEY, top_k))
        own = self._centres(state)
        probes = asked.mapInArrow(_assign(own, "vector", min(nprobe or len(own), len(own))), f"query_id {types['query_id']}, vector {types['vector']}, {CELL} int")
        probes = written(probes, "collection-probes")
        per = {r[CELL]: r["count"] for r in probes.groupBy(CELL).count().collect()}  # at most MOST_CELLS rows
        rows = self._where(self._rows(state, sorted(per)), must, should).select(KEY, "embedding", CELL)
        if sum(per.values()) * self.dim * 8 <= limit_bytes:
            found = rows.mapInArrow(_scan(probes.toArrow(), top_k, self.dim), schema)
        else:
            found = self._tiled(rows, probes, state, per, top_k, schema, limit_bytes)
        hits = written(ranked(found, KEY, top_k), "collection-hits")
        full = hits.groupBy("query_id").count().filter(F.col("count") >= top_k)
        short = written(asked.join(full, "query_id", "left_anti"), "collection-short")
        if nprobe is None or nprobe >= len(own) or short.isEmpty():
            return self._named(hits)
        whole = dense_top_k(self._where(self._rows(state), must, should), short, top_k, key=KEY)
        return self._named(hits.join(short.select("query_id"), "query_id", "left_anti").unionByName(whole))

    def _tiled(self, rows: DataFrame, probes: DataFrame, state: dict, per: dict[int, int], top_k: int, schema: str, limit_bytes: int) -> DataFrame:
        parts = [(c, max(1, -(-state["cells"][str(c)]["rows"] * self.dim * 8 // VECTOR_BYTES)), max(1, -(-n * self.dim * 8 // limit_bytes))) for c, n in per.items() if str(c) in state["cells"]]
        parts = F.broadcast(self.spark.createDataFrame(parts, f"{CELL} int, tiles long, blocks long"))  # at most MOST_CELLS rows
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        rows = rows.join(parts, CELL).withColumn("tile", F.pmod(F.xxhash64(KEY), "tiles")).withColumn("block", every("blocks")).drop("tiles", "blocks")
        probes = probes.join(parts, CELL).withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks")).withColumn("tile", every("tiles")).drop("tiles", "blocks")
        at = [CELL, "tile", "block"]
        arrow = self.spark.createDataFrame([], schema).toArrow().schema
        return rows.groupBy(*at).cogroup(probes.groupBy(*at)).applyInArrow(_tile(top_k, self.dim, arrow), schema)

    def probes_for(self, target: float = 0.95, top_k: int = 10) -> int:
        """The least ``nprobe`` that finds a share ``target`` of the exact first ``top_k`` rows of at most
        ``JUDGES`` stored vectors (those of smallest hash), which do not count as their own results."""
        _, state = self._state()
        if not state["cells"]:
            return 1
        rows, own = self._rows(state), self._centres(state)
        judges = written(rows.orderBy(F.xxhash64(KEY, F.lit("judge")), KEY).limit(JUDGES).select(F.col(KEY).alias("query_id"), F.col("embedding").alias("vector")), "collection-judges")
        hits = dense_top_k(rows.select(KEY, "embedding"), judges, top_k + 1, key=KEY).filter(F.col("query_id") != F.col(KEY)).filter(F.col("pos") <= top_k)
        hits = hits.join(rows.select(KEY, CELL), KEY).groupBy("query_id").agg(F.collect_list(CELL).alias("cells"))  # top_k + 1 rows a judge
        table = judges.join(hits, "query_id").select("vector", "cells").toArrow()
        if not table.num_rows:
            return 1
        order = np.argsort(-(_unit(table["vector"].combine_chunks(), self.dim)[1] @ own.T), axis=1, kind="stable")
        place = np.argsort(order, axis=1, kind="stable")
        places = np.concatenate([place[k, c] for k, c in enumerate(table["cells"].to_pylist())])
        found = np.cumsum(np.bincount(places, minlength=len(own))) / len(places)
        return int(np.argmax(found >= target)) + 1

    def recall(self, queries: DataFrame, top_k: int = 10, nprobe: int | None = 8, must: Sequence[Column] = (), should: Sequence[Column] = ()) -> DataFrame:
        """(query_id, wanted, found): how many of the exact first ``top_k`` rows a search finds."""
        rows = self._where(self._rows(self._state()[1]), must, should)
        exact = dense_top_k(rows, queries, top_k, key=KEY).select("query_id", KEY)
        got = self.search(queries, top_k, nprobe, must, should).withColumnRenamed(self.key, KEY).select("query_id", KEY, F.lit(1).alias("hit"))
        return exact.join(got, ["query_id", KEY], "left").groupBy("query_id").agg(F.count("*").alias("wanted"), F.count("hit").alias("found"))
