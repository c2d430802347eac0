"""N-gram Jaccard join: blocked sparse products of document by n-gram incidence.

A document is the set of its distinct word n-grams (64-bit hashes). Equal sets form a class, and
only classes are compared. Two stages then find every link between different classes.

Candidates. If J(A, B) >= t, A has at most |A| - ceil(t |A|) n-grams that B lacks. So in any order of
all n-grams, both have their first common one among the first |A| - ceil(t |A|) + 1, and the smaller
one of them even among its first |A| - ceil(2t / (1 + t) |A|) + 1. The order is rarest first. Texts
are read once: those of about ``FLUSH`` n-grams go together, send each of their n-grams with the
number of their rows that hold it to a bucket of the hash range, and get its frequency back, packed,
so that a frequent n-gram is one entry for each flush and no more. (A flush sends a row to each
bucket, yet never more rows than it has n-grams.) N-grams that only one class has lead to no
partner; a class whose first n-grams are all such is done. So classes that share passages or common
lines, but also hold text of their own, never meet. What is left meets by n-gram and size step, where
one could be the smaller one; candidate components follow from each meeting's smallest member.

Product. A candidate component is a tile of its own or, where large, is cut by size steps into row
blocks of ``TILE_BYTES``, and each pair of row blocks of equal or neighbouring steps is a tile. A
tile multiplies its two incidence matrices, ``ROWS`` by ``ROWS``, over the columns that both have:
columns with few entries as sparse outer products, full ones as matrix products in column blocks.
Overlap counts accumulate, and pairs below the bound that their sizes give are discarded. A tile
returns counts of links by class and, for each node, one linked node that leads to the smallest, so
rows grow with documents, never with pairs. Only members of one candidate component cost products in
the square of their number, in tiles of bounded memory.

Defined results: a null or empty text, or one without words, has an empty set and no links, and is
its own component. With fewer words than n, the whole sequence is the one n-gram. Repeated rows
are linked like any copies; ids may repeat or be null (a component's id is its smallest id). Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltern.llm.common import drop_written, small_batches, spread_join, written
from saltern.llm.components import components, least_linked
from saltern.llm.exact_dedup import located, position, spot, without
from saltern.llm.packing import expand, mix as _mix, runs as _runs, squeeze

ROWS, COLUMNS = 512, 2048
#: Entries of sparse outer products that are added at once (and one row's more).
PRODUCTS = 500_000
#: Bytes of the sets in one row block of a tile, on average, and its rows.
TILE_BYTES, TILE_ROWS = 4 << 20, 4096
#: N-grams of the texts that are packed together, and of one bucket, on average.
FLUSH, PER_BUCKET = 500_000, 500_000
#: Rows up to which the members of candidate components (about 80 bytes each) are broadcast to the
#: second scan of the texts; with more, the scan's rows are shuffled to them.
BROADCAST_ROWS = 400_000
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted hashes of a text's distinct n-grams."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n_ = min(n, len(words))
    total = np.full(len(own) - n_ + 1, n_, np.uint64)
    for k in range(n_):
        total += _mix(own[k : len(own) - n_ + 1 + k] * _K[k % len(_K)] + np.uint64(k + 1))
    return np.unique(_mix(total))


class Bounds:
    """What sizes allow, for a threshold of num/den."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.low = num, den, [1]

    def first(self, n: np.ndarray) -> np.ndarray:
        """N-grams, rarest first, among which a set of n meets any partner."""
        return n + 1 + (-self.num * n) // self.den

    def first_small(self, n: np.ndarray) -> np.ndarray:
        """Those among which it meets a partner that is not smaller."""
        return n + 1 + (-2 * self.num * n) // (self.num + self.den)

    def step(self, n: np.ndarray) -> np.ndarray:
        """Size steps: partners are of the same or of neighbouring steps."""
        while len(n) and self.low[-1] <= n.max():
            self.low.append(max(self.low[-1] + 1, -(-self.low[-1] * self.den // self.num)))
        return np.searchsorted(np.array(self.low), n, side="right") - 1

    def meets_below(self, n: np.ndarray, step: np.ndarray) -> np.ndarray:
        """Whether the step below has partners for a set of n."""
        return (step > 0) & (-((-self.num * n) // self.den) < np.array(self.low)[step])


def _pack(n: int, bits: int):
    """(at, id, text) to one row for each flush: its documents, and their n-grams as positions in the
    flush's sorted distinct tokens (the first ``bits`` bits of their hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        node = TaskContext.get().partitionId() << 33
        held, sets, size = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal node
            at, id_ = (pa.concat_arrays([b.column(c) for b in held]) for c in ("at", "id"))
            sizes = np.array([len(x) for x in sets], np.int64)
            classes = pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets], pa.binary())
            nodes = np.arange(node, node + len(sets))
            each = pa.StructArray.from_arrays([at, id_, pa.array(sizes), classes, pa.array(nodes)], names=["at", "id", "n", "cls", "node"])
            tokens, index, counts = np.unique(np.concatenate(sets) >> np.uint64(64 - bits), return_inverse=True, return_counts=True)
            packed = [squeeze(np.diff(index.astype(np.int32), prepend=np.int32(0))), squeeze(np.diff(tokens.view(np.int64), prepend=0)), squeeze(counts.astype(np.int64))]
            node += len(sets)
            docs_ = pa.ListArray.from_arrays(pa.array([0, len(sets)], pa.int32()), each)
            return pa.RecordBatch.from_arrays([pa.array([int(nodes[0])]), docs_, *(pa.array([x], pa.binary()) for x in (squeeze(sizes), *packed))], names=["flush", "docs", "sizes", "index", "tokens", "counts"])

        for batch in batches:
            start = 0
            for row, cell in enumerate(batch.column("text")):
                sets.append(shingles(cell.as_py(), n))
                size += len(sets[-1]) + 16  # a document costs something even without n-grams
                if size >= FLUSH:
                    held.append(batch.slice(start, row + 1 - start))
                    yield flush()
                    held, sets, size, start = [], [], 0, row + 1
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if sets:
            yield flush()

    return run


def _ask(buckets: int, bits: int):
    """(flush, tokens, counts) to one row for each bucket that the flush has tokens of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for flush, tokens, counts in zip(*(batch.column(c).to_pylist() for c in ("flush", "tokens", "counts")), strict=True):
                tokens, counts = np.cumsum(expand(tokens, np.int64)), expand(counts, np.int64)
                first, size = _runs((tokens >> (bits - 32)) * buckets >> 32)
                bucket = ((tokens[first] >> (bits - 32)) * buckets >> 32).tolist()
                parts = [slice(s, s + k) for s, k in zip(first.tolist(), size.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array(bucket, pa.int64()), "flush": pa.array([flush] * len(parts), pa.int64()),
                    "tokens": pa.array([squeeze(np.diff(tokens[p], prepend=0)) for p in parts], pa.binary()),
                    "counts": pa.array([squeeze(counts[p]) for p in parts], pa.binary()),
                })

    return run


def _answer(group: pa.Table) -> pa.Table:
    """Each flush's tokens of one bucket by frequency over all rows; tokens with more than one are named."""
    tokens = [np.cumsum(expand(x, np.int64)) for x in group.column("tokens").to_pylist()]
    lengths = [len(x) for x in tokens]
    every = np.concatenate(tokens)
    order = np.argsort(every, kind="stable")
    first, size = _runs(every[order])
    counts = np.concatenate([expand(x, np.int64) for x in group.column("counts").to_pylist()])[order]
    frequency = np.empty(len(every), np.int64)
    frequency[order] = np.repeat(np.add.reduceat(counts, first), size)
    ends = np.cumsum(lengths)
    own = [slice(e - k, e) for e, k in zip(ends.tolist(), lengths, strict=True)]
    named = [squeeze(np.diff(every[s][frequency[s] > 1], prepend=0)) for s in own]
    return pa.table({"flush": group.column("flush"), "bucket": group.column("bucket"), "frequency": pa.array([squeeze(frequency[s]) for s in own], pa.binary()), "named": pa.array(named, pa.binary())})


def _prefixes(num: int, den: int):
    """A flush and its answers to the first n-grams of its classes: rows (token, step, node, n, small, own)."""

    def run(flush: pa.Table, answers: pa.Table) -> pa.Table:
        bounds = Bounds(num, den)
        out = {k: np.zeros(0, np.int64) for k in ("token", "step", "node", "n")} | {"small": np.zeros(0, bool)}
        if flush.num_rows and answers.num_rows:
            answers = answers.sort_by("bucket")
            frequency = np.concatenate([expand(x, np.int64) for x in answers.column("frequency").to_pylist()])
            token = np.zeros(len(frequency), np.int64)
            token[frequency > 1] = np.concatenate([np.cumsum(expand(x, np.int64)) for x in answers.column("named").to_pylist()])
            sizes = expand(flush["sizes"][0].as_py(), np.int64)
            index = np.cumsum(expand(flush["index"][0].as_py(), np.int32))
            copies = np.zeros(len(sizes), np.int64)  # 0: another row stands for this one's class
            start = flush["flush"][0].as_py()
            for x in flush["reps"][0].as_py():
                copies[x["node"] - start] = x["copies"]
            doc = np.repeat(np.arange(len(sizes)), sizes)
            alone = np.bincount(doc, weights=frequency[index] == copies[doc], minlength=len(sizes))
            first = bounds.first(sizes)
            keep = ((copies > 0) & (alone < first))[doc]
            doc, index = doc[keep], index[keep]
            order = np.lexsort((token[index], frequency[index], doc))
            doc, index = doc[order], index[order]
            begin, size = _runs(doc)
            at = np.arange(len(doc)) - np.repeat(begin, size)
            keep = (at < first[doc]) & (frequency[index] > copies[doc])
            doc, index, at = doc[keep], index[keep], at[keep]
            n = sizes[doc]
            step = bounds.step(n)
            below = bounds.meets_below(n, step) if len(n) else np.zeros(0, bool)
            small = at < bounds.first_small(n)
            out = {
                "token": np.concatenate([token[index], token[index[below]]]), "step": np.concatenate([step, step[below] - 1]),
                "node": np.concatenate([doc, doc[below]]) + start, "n": np.concatenate([n, n[below]]),
                "small": np.concatenate([small, np.zeros(below.sum(), bool)]),
            }
        return pa.table(out)

    return run


def _sets(n: int, keep: list[str]):
    """(text, ...) to (..., own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                own = [shingles(t.as_py(), n).tobytes() for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(own, pa.binary())], names=[*keep, "own"])

    return run


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Overlap counts of two lists of sets: the product of their incidence matrices.

    Columns with few entries are outer products of their row lists; the others are multiplied as
    blocks of ``COLUMNS``."""
    out = np.zeros((len(a), len(b)), np.int64)
    every = np.concatenate([*a, *b]) if a and b else np.zeros(0, np.uint64)
    if not len(every):
        return out
    row_a, row_b = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    columns, index = np.unique(every, return_inverse=True)
    at_a, at_b = index[: len(row_a)], index[len(row_a) :]
    count_a, count_b = np.bincount(at_a, minlength=len(columns)), np.bincount(at_b, minlength=len(columns))
    entries = count_a * count_b
    sparse, full = (entries > 0) & (entries * 50 < len(a) * len(b)), entries * 50 >= len(a) * len(b)
    if sparse.any():
        in_a, in_b = np.flatnonzero(sparse[at_a]), np.flatnonzero(sparse[at_b])
        in_a, in_b = in_a[np.argsort(at_a[in_a], kind="stable")], in_b[np.argsort(at_b[in_b], kind="stable")]
        ends_b = np.cumsum(np.where(sparse, count_b, 0))
        upto = np.cumsum(count_b[at_a[in_a]])
        cuts = np.searchsorted(upto, np.arange(PRODUCTS, upto[-1] + PRODUCTS, PRODUCTS), side="left") + 1
        for low, high in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
            part = in_a[low:high]
            times = count_b[at_a[part]]
            within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            y = row_b[in_b][np.repeat(ends_b[at_a[part]] - times, times) + within]
            out += np.bincount(np.repeat(row_a[part], times) * len(b) + y, minlength=out.size).reshape(out.shape)
    number = np.cumsum(full) - 1
    keep_a, keep_b = full[at_a], full[at_b]
    row_a, at_a, row_b, at_b = row_a[keep_a], number[at_a[keep_a]], row_b[keep_b], number[at_b[keep_b]]
    for low in range(0, int(full.sum()), COLUMNS):
        in_a, in_b = (at_a >= low) & (at_a < low + COLUMNS), (at_b >= low) & (at_b < low + COLUMNS)
        x, y = np.zeros((len(a), COLUMNS), np.float32), np.zeros((len(b), COLUMNS), np.float32)
        x[row_a[in_a], at_a[in_a] - low] = 1
        y[row_b[in_b], at_b[in_b] - low] = 1
        out += (x @ y.T).astype(np.int64)
    return out


def _tile(num: int, den: int):
    """Links of one tile: rows (a, b, links). A row with b null counts a's links."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("node", "ascending")])
        one = {c: group[c][0].as_py() for c in ("lu", "li", "ru", "ri")}
        unit, side = group["unit"].to_numpy(), group["side"].to_numpy()
        nodes, copies = group["node"].to_numpy(), group["copies"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in group["own"].to_pylist()]
        sizes = np.array([len(x) for x in sets], np.int64)
        same = (one["lu"], one["li"]) == (one["ru"], one["ri"])
        rows_a = np.flatnonzero((unit == one["lu"]) & (side == one["li"]))
        rows_b = rows_a if same else np.flatnonzero((unit == one["ru"]) & (side == one["ri"]))
        links, ends = np.zeros(len(nodes), np.int64), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for s in range(0, len(rows_a), ROWS):
            for u in range(s if same else 0, len(rows_b), ROWS):
                ra, rb = rows_a[s : s + ROWS], rows_b[u : u + ROWS]
                na, nb = sizes[ra][:, None], sizes[rb][None, :]
                possible = np.minimum(na, nb) * den >= num * np.maximum(na, nb)
                if same:
                    possible &= ra[:, None] < rb[None, :]
                ka, kb = possible.any(axis=1), possible.any(axis=0)
                if not ka.any():
                    continue
                ra, rb, possible = ra[ka], rb[kb], possible[np.ix_(ka, kb)]
                counts = overlaps([sets[i] for i in ra], [sets[i] for i in rb])
                linked = possible & (counts * (den + num) >= num * (sizes[ra][:, None] + sizes[rb][None, :]))
                i, j = np.nonzero(linked)
                links[ra] += np.bincount(i, weights=copies[rb[j]], minlength=len(ra)).astype(np.int64)
                links[rb] += np.bincount(j, weights=copies[ra[i]], minlength=len(rb)).astype(np.int64)
                label = least_linked(ra[i], rb[j], len(nodes))
                some = np.flatnonzero(label != np.arange(len(nodes)))
                ends.append((some, label[some]))
        a, b = (np.concatenate(x) for x in zip(*ends, strict=True))
        some = np.flatnonzero(links)
        return pa.table({
            "a": pa.array(np.concatenate([nodes[a], nodes[some]])), "b": pa.array([*nodes[b].tolist(), *[None] * len(some)], pa.int64()),
            "links": pa.array(np.concatenate([np.zeros(len(a), np.int64), links[some]])),
        })

    return run


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row a document: ``at`` (locator), ``id``, ``n_shingles``, ``component`` (a number, null
    without n-grams), ``component_id`` (smallest id) and ``n_links`` (other rows linked directly),
    for J >= num/den."""
    return _join(_columns(located(docs), docs.columns, key, text), n, num, den)


def _columns(rows: DataFrame, columns: list[str], key: str, text: str) -> DataFrame:
    return rows.select(F.col("saltern_at").alias("at"), F.col(position(columns, key)).alias("id"), F.col(position(columns, text)).alias("text"))


def _candidates(flushes: DataFrame, reps: DataFrame, buckets: int, bits: int, num: int, den: int) -> DataFrame:
    """(node, n, component, unit) of the classes that may have partners."""
    asks = flushes.select("flush", "tokens", "counts").mapInArrow(_ask(buckets, bits), "bucket long, flush long, tokens binary, counts binary")
    answers = asks.groupBy("bucket").applyInArrow(_answer, "flush long, bucket long, frequency binary, named binary")
    held = reps.groupBy("flush").agg(F.collect_list(F.struct("node", "copies")).alias("reps"))  # as many as a flush has documents
    whole = flushes.select("flush", "sizes", "index").join(held, "flush")
    found = whole.groupBy("flush").cogroup(answers.groupBy("flush")).applyInArrow(_prefixes(num, den), "token long, step long, node long, n long, small boolean")
    found = written(found, "join-first")
    met = found.groupBy("token", "step").agg(F.min("node").alias("pivot"), F.max("node").alias("last"), F.max("small").alias("small"))
    met = met.filter("small AND pivot <> last").select("token", "step", "pivot")
    near = components(found.join(met, ["token", "step"]).select("node", "pivot").distinct(), "node", "pivot")
    sizes = found.groupBy("node").agg(F.min("n").alias("n"), F.max("step").alias("unit"))
    near = written(near.join(sizes, "node"), "join-near")
    drop_written(found)
    return near


def _tiles(near: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``near`` with each node's row block (unit, side) and the numbers of row blocks of its step and both neighbours.

    A component that fits into one row block has one unit, -1. Also the table of components that do not."""
    cuts = F.greatest(F.ceil(F.sum("n") * 8 / TILE_BYTES), F.ceil(F.count("*") / TILE_ROWS)).cast("int").alias("cut")
    totals = near.groupBy("component").agg(cuts)
    large = written(totals.filter("cut > 1").select("component"), "join-large")
    units = spread_join(near, large, "component").groupBy("component", "unit").agg(cuts)
    units = units.groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("unit", "cut"))).alias("cuts"))  # few: sizes differ by a factor
    near = spread_join(near, units, "component", "left")
    cut = lambda k: F.when(F.col("cuts").isNull(), F.lit(k == 0).cast("int")).otherwise(F.coalesce(F.try_element_at("cuts", F.col("unit") + k), F.lit(0)))
    near = near.select("node", "component", F.when(F.col("cuts").isNull(), F.lit(-1)).otherwise(F.col("unit")).cast("long").alias("unit"), *[cut(k).alias(name) for k, name in ((-1, "below"), (0, "level"), (1, "above"))])
    return near.withColumn("side", F.pmod(F.xxhash64("node"), F.col("level")).cast("int")), large


def _join(rows: DataFrame, n: int, num: int, den: int) -> DataFrame:
    small_batches(rows.sparkSession)
    kinds = rows.schema
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = min(56, max(32, int(size // 6 + 1).bit_length() + 10))  # about one n-gram in a thousand meets another's token
    each = f"array<struct<at:struct<file:string,row:long>,id:{kinds['id'].dataType.simpleString()},n:long,cls:binary,node:long>>"
    flushes = written(rows.mapInArrow(_pack(n, bits), f"flush long, docs {each}, sizes binary, index binary, tokens binary, counts binary"), "join-flushes", compression="uncompressed")  # packed rows of megabytes: again, they only cost buffers
    base = flushes.select("flush", F.explode("docs").alias("d")).select("flush", "d.*")
    own = base.filter("cls IS NOT NULL").groupBy("cls").agg(F.min(F.struct("node", "flush", "n", spot("at").alias("spot"), F.col("at.row").alias("row"))).alias("x"), F.count("*").alias("copies"), F.min("id").alias("least"))
    classes = written(own.select("x.*", "copies", "cls", "least"), "join-classes")

    total = base.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    near = _candidates(flushes, classes.select("flush", "node", "copies"), max(8, -(-total // PER_BUCKET)), bits, num, den)
    placed, large = _tiles(near)
    wanted = written(placed.join(classes.select("node", "spot", "row", "copies"), "node"), "join-wanted")
    listed = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    keep = ["node", "copies", "component", "unit", "side", "below", "level", "above"]
    sets = rows.select(spot("at").alias("spot"), F.col("at.row").alias("row"), "text").join(listed, ["spot", "row"]).select("text", *keep)
    sets = sets.mapInArrow(_sets(n, keep), "node long, copies long, component long, unit long, side int, below int, level int, above int, own binary")
    tile = lambda lu, li, ru, ri: F.struct(lu.alias("lu"), li.cast("int").alias("li"), ru.alias("ru"), ri.cast("int").alias("ri"))
    unit, side = F.col("unit"), F.col("side")
    blocks = lambda c, f: F.when(F.col(c) > 0, F.transform(F.sequence(F.lit(0), F.col(c) - 1), f)).otherwise(F.array())
    tiles = F.concat(
        blocks("level", lambda j: tile(unit, F.least(side, j), unit, F.greatest(side, j))),
        blocks("above", lambda j: tile(unit, side, unit + 1, j)),
        blocks("below", lambda j: tile(unit - 1, j, unit, side)),
    )
    work = sets.select("component", "unit", "side", "node", "copies", "own", F.explode(tiles).alias("t")).select("t.*", "component", "unit", "side", "node", "copies", "own")
    links = written(work.groupBy("component", "lu", "li", "ru", "ri").applyInArrow(_tile(num, den), "a long, b long, links long"), "join-links")
    drop_written(near, large, wanted)

    joined = components(links.filter("b IS NOT NULL"))
    counted = links.filter("b IS NULL").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "node")
    linked = kept = written(classes.select("cls", "node", "copies", "least").join(joined, "node").join(counted, "node", "left"), "join-linked")
    drop_written(links)
    ids = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = spread_join(linked, ids, "component").select("cls", "component", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    alone = classes.filter("copies > 1").join(linked.select("cls"), "cls", "left_anti").select("cls", F.col("node").alias("component"), F.col("least").alias("component_id"), (F.col("copies") - 1).alias("n_links"))
    out = base.select("at", "id", "n", "cls", "node").join(linked.unionByName(alone), "cls", "left")
    component, component_id = (F.when(F.col("n_links").isNull(), F.col(single)).otherwise(F.col(found)) for single, found in (("node", "component"), ("id", "component_id")))
    out = out.select("at", "id", F.col("n").alias("n_shingles"), F.when(F.col("cls").isNotNull(), component).alias("component"), component_id.alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "node")
    out.saltern_tables = [flushes, classes, kept]
    return out


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each component: the smallest id, then the first row. Rows without
    n-grams stay."""
    rows = located(docs)
    every = _join(_columns(rows, docs.columns, key, text), n, num, den)
    found = written(every.filter("n_links > 0").select("at", "id", "component", "node"), "join-found")
    drop_written(*every.saltern_tables)
    first = found.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "node", "at")).alias("x"))
    gone = spread_join(found, first, "component").filter(F.col("at") != F.col("x.at")).select("at")
    out = without(rows, gone, docs.columns)
    drop_written(found)
    return out
