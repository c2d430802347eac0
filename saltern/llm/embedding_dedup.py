"""Embedding near-duplicates by cross-polytope hashing.

Vectors are compared within their label. Each of K hash functions rotates a unit vector with three
rounds of random signs and a fast Hadamard transform and takes the nearest vertex of the
cross-polytope (largest coordinate and its sign); a table's bucket is the K vertices together. A
vector probes, besides its home bucket, those where one function takes its second or third vertex.
Vectors that meet in a bucket, one of them at home, are compared in double precision; only pairs
that reach the threshold are linked. K follows the number of vectors, and the number of tables
follows from a simulation of pairs at the threshold, so that a link at the threshold is met with
probability ``RECALL`` (closer pairs nearly always).

Equal vectors of a label form a class, and only classes are hashed. A bucket's rows are cut into
row blocks of ``ROWS``; each pair of row blocks is a tile, and tiles are dealt to groups by hash, so
memory is bounded for any bucket. A pair is counted where it meets first (smallest table, then
smallest bucket), which both rows' vectors tell, so nothing is gathered to drop repeats: a tile's
links are counted and joined into a forest ``PAIRS`` at a time, and no list of them is kept. A tile
returns counts of links and, for each node, one that its links lead to: rows grow with vectors, never with pairs.

Defined results: a vector that is null, empty, zero or has a null or non-finite component, or whose
label is null, links with nothing; so do vectors of different lengths. Repeated rows are links of
each other. Ids may repeat; null ids come after all others. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltern.llm.common import drop_written, written
from saltern.llm.components import components, least_linked

ROWS, RECALL, SEED, ALTERNATIVES = 1024, 0.9995, 20240, 2
#: Vectors that one bucket holds on average, and bytes of vectors in a group of tiles.
PER_BUCKET, GROUP_BYTES = 32, 8 << 20
#: Cells of a product, and pairs whose first meeting is looked up, at once.
CELLS, PAIRS = 1 << 20, 50_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the Hadamard matrix of their length, a power of two, in place of log steps."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


class Hashes:
    """The home bucket and the probes of unit vectors, for each table."""

    def __init__(self, dims: int, functions: int, tables: int):
        self.width = 1 << max(1, (dims - 1).bit_length())
        self.functions, self.tables = functions, tables
        rng = np.random.default_rng([SEED, dims])
        self.signs = rng.choice([-1.0, 1.0], (tables, functions, 3, self.width))

    def table(self, unit: np.ndarray, t: int) -> np.ndarray:
        """Codes of one table: column 0 is home, the others are probes."""
        padded = np.zeros((len(unit), self.width))
        padded[:, : unit.shape[1]] = unit
        ranked = []
        for k in range(self.functions):
            x = padded
            for r in range(3):
                x = hadamard(x * self.signs[t, k, r])
            take = min(1 + ALTERNATIVES, self.width)
            best = np.argpartition(-np.abs(x), take - 1, axis=1)[:, :take]
            size = np.take_along_axis(x, best, axis=1)
            order = np.lexsort((best, -np.abs(size)), axis=1)
            best, size = np.take_along_axis(best, order, axis=1), np.take_along_axis(size, order, axis=1)
            ranked.append(2 * best + (size < 0))
        base = 2 * self.width
        home = np.zeros(len(unit), np.int64)
        for k in range(self.functions):
            home = home * base + ranked[k][:, 0]
        out = [home]
        for k in range(self.functions):
            scale = base ** (self.functions - 1 - k)
            for alternative in range(1, ranked[k].shape[1]):
                out.append(home + (ranked[k][:, alternative] - ranked[k][:, 0]) * scale)
        return np.stack(out, axis=1)

    def all(self, unit: np.ndarray) -> np.ndarray:
        """Vectors by tables by codes."""
        return np.stack([self.table(unit, t) for t in range(self.tables)], axis=1)


def met(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pairs meet: the first table, and the smallest of its codes at which they do. -1: nowhere."""
    at_b = (a == b[:, :, :1]).any(axis=2)
    at_a = (b == a[:, :, :1]).any(axis=2)
    some = at_a | at_b
    first = np.where(some.any(axis=1), some.argmax(axis=1), -1)
    row = np.arange(len(a))
    most = np.iinfo(np.int64).max
    code = np.minimum(np.where(at_a[row, first], a[row, first, 0], most), np.where(at_b[row, first], b[row, first, 0], most))
    return first, code


def plan(rows: int, dims: int, threshold: float, recall: float = RECALL) -> Hashes:
    """Hash functions and tables for so many vectors of one length."""
    width = 1 << max(1, (dims - 1).bit_length())
    least = 2 if rows > PER_BUCKET else 1  # one function has few buckets: their rows would grow with the square of the vectors
    functions = max(least, min(8, round(math.log(max(1.0, rows / PER_BUCKET)) / math.log(2 * width)), int(62 / math.log2(2 * width))))
    rng = np.random.default_rng(SEED)
    a, noise = rng.normal(size=(3000, dims)), rng.normal(size=(3000, dims))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    noise -= (noise * a).sum(axis=1, keepdims=True) * a
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-300)
    b = threshold * a + math.sqrt(max(0.0, 1 - threshold**2)) * noise
    if dims == 1:
        b = a
    trial = Hashes(dims, functions, 1)
    p = float((met(trial.all(a), trial.all(b))[0] >= 0).mean())
    p = min(max(p - 0.02, 0.01), 0.999)
    return Hashes(dims, functions, max(1, math.ceil(math.log(1 - recall) / math.log(1 - p))))


def _clean(wide: bool):
    """(id, label, embedding) to (id, label, vec): the bytes of a usable vector, or null."""
    kind = np.float64 if wide else np.float32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cell in batch.column("embedding"):
                values = cell.values if cell.is_valid else None
                x = values.to_numpy(zero_copy_only=False).astype(kind) if values is not None and len(values) and not values.null_count else None
                good = x is not None and np.isfinite(x).all() and x.any()
                out.append(x.tobytes() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(out, pa.binary())], names=["id", "label", "vec"])

    return run


def _unit(vecs: list[bytes], wide: bool) -> np.ndarray:
    x = np.frombuffer(b"".join(vecs), np.float64 if wide else np.float32).astype(np.float64).reshape(len(vecs), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _spread(hashes: Hashes, wide: bool):
    """(node, label) to a row for each bucket: (node, table, code, home)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                unit, n = _unit(batch.column("vec").to_pylist(), wide), batch.num_rows
                for t in range(hashes.tables):
                    codes = hashes.table(unit, t)
                    probes = codes.shape[1]
                    at = np.repeat(np.arange(n), probes)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("node").take(pa.array(at)), batch.column("label").take(pa.array(at)), pa.array(np.full(n * probes, t, np.int32)), pa.array(codes.reshape(-1)), pa.array(np.tile(np.arange(probes) == 0, n))],
                        names=["node", "label", "tbl", "code", "home"],
                    )

    return run


class Codes:
    """The hash codes of the vectors of a group, made when one is asked for."""

    def __init__(self, hashes: Hashes, unit: np.ndarray):
        self.hashes, self.unit, self.codes, self.have = hashes, unit, None, np.zeros(len(unit), bool)

    def of(self, at: np.ndarray) -> np.ndarray:
        new = np.unique(at[~self.have[at]])
        if len(new):
            got = self.hashes.all(self.unit[new])
            if self.codes is None:
                self.codes = np.zeros((len(self.unit), *got.shape[1:]), got.dtype)
            self.codes[new], self.have[new] = got, True
        return self.codes[at]


class Forest:
    """Components of so many nodes by their least node, linked a few pairs at a time."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        new = self.label[a] != self.label[b]
        if new.any():
            tree = np.flatnonzero(self.label != np.arange(len(self.label)))
            a, b = np.concatenate([self.label[tree], a[new]]), np.concatenate([tree, b[new]])
            order = np.argsort(a, kind="stable")
            self.label = least_linked(a[order], b[order], len(self.label))


def _tiles(hashes: Hashes, threshold: float, wide: bool):
    """Links of a group of tiles: (a, b, links); a row with b null counts a's links."""

    def run(group: pa.Table) -> pa.Table:
        rows = {c: group[c].to_numpy() for c in ("tbl", "code", "left", "right", "side", "node", "copies", "home")}
        label = group["label"].combine_chunks().dictionary_encode().indices.to_numpy()
        order = np.lexsort((rows["node"], rows["right"], rows["left"], rows["code"], rows["tbl"], label))
        vecs, first_at = group["vec"].to_pylist(), {}
        for k, node in enumerate(rows["node"].tolist()):
            first_at.setdefault(node, k)
        nodes = np.array(sorted(first_at), np.int64)
        unit = _unit([vecs[first_at[n]] for n in nodes.tolist()], wide)
        copies = rows["copies"][[first_at[n] for n in nodes.tolist()]]
        place = np.searchsorted(nodes, rows["node"])
        keys = np.stack([label, rows["tbl"], rows["code"], rows["left"], rows["right"]], axis=1)[order]
        starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
        ends = np.append(starts[1:], len(keys))
        forest = Forest(len(nodes))
        links, codes = np.zeros(len(nodes), np.int64), Codes(hashes, unit)
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            if e - s < 2:
                continue
            at = order[s:e]
            _, table, code, left, right = keys[s].tolist()
            a = at[rows["side"][at] == left]
            b = a if left == right else at[rows["side"][at] == right]
            step = max(1, CELLS // max(1, len(b)))
            for low in range(0, len(a), step):
                x = a[low : low + step]
                near = unit[place[x]] @ unit[place[b]].T >= threshold
                near &= rows["home"][x][:, None] | rows["home"][b][None, :]
                if left == right:
                    near &= rows["node"][x][:, None] < rows["node"][b][None, :]
                i, j = np.nonzero(near)
                for cut in range(0, len(i), PAIRS):
                    p, q = place[x[i[cut : cut + PAIRS]]], place[b[j[cut : cut + PAIRS]]]
                    tables, met_at = met(codes.of(p), codes.of(q))
                    first = (tables == table) & (met_at == code)  # each pair counts where it meets first
                    p, q = p[first], q[first]
                    links += np.bincount(p, weights=copies[q], minlength=len(nodes)).astype(np.int64)
                    links += np.bincount(q, weights=copies[p], minlength=len(nodes)).astype(np.int64)
                    forest.join(p, q)
        label, some = forest.label, np.flatnonzero(links)
        tree = np.flatnonzero(label != np.arange(len(nodes)))
        out_b = [*nodes[label[tree]].tolist(), *[None] * len(some)]
        return pa.table({"a": pa.array(np.concatenate([nodes[tree], nodes[some]])), "b": pa.array(out_b, pa.int64()), "links": pa.array(np.concatenate([np.zeros(len(tree), np.int64), links[some]]))})

    return run


def _links(classes: DataFrame, hashes: Hashes, threshold: float, wide: bool) -> DataFrame:
    """``classes``: node, label, vec, copies, of one vector length."""
    label = classes.schema["label"].dataType.simpleString()
    bucket = ["label", "tbl", "code"]
    rows = classes.select("node", "label", "vec").mapInArrow(_spread(hashes, wide), f"node long, label {label}, tbl int, code long, home boolean")
    rows = written(rows, "embedding-buckets")
    sizes = rows.groupBy(*bucket).agg(F.count("*").alias("size"), F.max("home").alias("any")).filter("size > 1 AND any")
    rows_ = rows.join(sizes, bucket).withColumn("cut", F.ceil(F.col("size") / ROWS).cast("int"))
    rows_ = rows_.withColumn("side", F.pmod(F.xxhash64("node"), F.col("cut")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
    tiles = rows_.select("node", *bucket, "home", "side", F.least("side", "other").alias("left"), F.greatest("side", "other").alias("right"))
    total = rows.count() * hashes.width * (8 if wide else 4)
    group = F.pmod(F.xxhash64(*bucket, "left", "right"), F.lit(max(8, -(-total // GROUP_BYTES))))
    work = tiles.join(classes.select("node", "vec", "copies"), "node").withColumn("group", group)
    return work.groupBy("group").applyInArrow(_tiles(hashes, threshold, wide), "a long, b long, links long")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = 0.93, recall: float = RECALL) -> DataFrame:
    """One row a vector: ``id``, ``n_links`` (other rows linked directly) and ``component_id``
    (smallest id reachable by links, itself included)."""
    kind = vectors.schema[embedding].dataType.elementType.simpleString()
    wide = kind != "float"
    rows = vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{embedding}`").cast("array<double>" if wide else "array<float>").alias("embedding"))
    kinds = rows.schema
    base = rows.mapInArrow(_clean(wide), f"id {kinds['id'].dataType.simpleString()}, label {kinds['label'].dataType.simpleString()}, vec binary")
    base = written(base.withColumn("node", F.monotonically_increasing_id()), "embedding-base")
    own = base.filter("vec IS NOT NULL AND label IS NOT NULL").groupBy("label", "vec")
    classes = written(own.agg(F.min("node").alias("node"), F.count("*").alias("copies"), F.min("id").alias("least")), "embedding-classes")
    size = F.octet_length("vec")
    lengths = classes.groupBy(size.alias("bytes")).count().collect()  # a row for each vector length
    links = None
    for r in sorted(lengths):
        hashes = plan(r["count"], r["bytes"] // (8 if wide else 4), threshold, recall)
        part = _links(classes.filter(size == r["bytes"]), hashes, threshold, wide)
        links = part if links is None else links.unionByName(part)
    if links is None:
        links = vectors.sparkSession.createDataFrame([], "a long, b long, links long")
    links = written(links, "embedding-links")
    joined = components(links.filter("b IS NOT NULL"))
    counted = links.filter("b IS NULL").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "node")
    found = classes.select("label", "vec", "node", "copies", "least").join(joined, "node", "left").join(counted, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = found.groupBy("component").agg(F.min("least").alias("component_id"))
    found = found.join(ids, "component").select("label", "vec", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = base.join(found, ["label", "vec"], "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
