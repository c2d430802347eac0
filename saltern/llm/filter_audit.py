"""Audit of filters and their interaction: what each order of five filters keeps, removes and loses.

Texts are measured in Arrow buffers: byte classes by table, words as spans between white space,
prefix sums for words, capitals, symbols and code points by document. A word's hash is a difference
of prefix sums of byte times power, brought to the same power; a document's hashes are sorted, and
neighbours with equal hashes compared byte by byte, so the numbers of distinct words are exact (a
document with a collision counts by its words themselves). Buffers are measured ``SLICE_BYTES`` at a time;
one longer text is measured alone.

Each document becomes a mask of the filters that it fails. Whether a text also stands in a row
of smaller id is found by aggregations on its digest, which combine in each task before they are
shuffled, so a hot text is a few rows; no row is joined to its copies. Counts by part and mask, at
most 32 a part, then give every order's steps.

Filters: A under ``min_words`` words; B distinct words under half of the words; C capitals A-Z over 3 % of code
points; D any of ``#$%&*|``; E a text that also stands in a row of smaller id.

Defined results: a null text is empty; a null language is the part "". Rows without an id fail E
never and make no other row fail it. Of a document's several labels, any 1 counts; rows without an
id have none. Repeated rows count each. Without rows there are no parts. Other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saltern.llm.common import small_batches

FILTERS = "ABCDE"
MIN_WORDS = 200
#: Bytes of text that are measured at once; prefix sums take about thirty times as much.
SLICE_BYTES = 1 << 20
_ODD = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_ODD, -1, 1 << 64)

SPACE, CAPITAL, SYMBOL, FIRST = range(4)


def _classes() -> np.ndarray:
    """By class and byte: white space, A-Z, symbols, first bytes of code points."""
    out = np.zeros((4, 256), bool)
    out[SPACE, [32, 9, 10, 11, 12, 13]] = True
    out[CAPITAL, 65:91] = True
    out[SYMBOL, list(b"#$%&*|")] = True
    out[FIRST] = (np.arange(256) & 0xC0) != 0x80
    return out


def _powers(n: int, base: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


class Measures:
    """Counts of texts in Arrow's layout: their bytes, one after the other, and offsets."""

    def __init__(self):
        self.classes = _classes()
        self.power = self.inverse = np.ones(0, np.uint64)

    def _per_text(self, found: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(found) + 1, np.int64)
        np.cumsum(found, out=sums[1:])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of words; no word crosses from one text to the next."""
        inside = ~self.classes[SPACE][data]
        new = np.ones(len(data) + 1, bool)  # whether the byte before is of another text or white space
        new[1:-1] = ~inside[:-1]
        new[offsets] = True
        last = np.ones(len(data), bool)
        last[:-1] = ~inside[1:]
        last[offsets[(offsets > 0)] - 1] = True
        return np.flatnonzero(inside & new[:-1]), np.flatnonzero(inside & last) + 1

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.power) < len(data):
            self.power, self.inverse = _powers(len(data), _ODD), _powers(len(data), _INVERSE)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], out=sums[1:])
        return (sums[ends] - sums[starts]) * self.inverse[starts]

    def distinct(self, data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        text = np.searchsorted(offsets, starts, side="right") - 1
        hashes = self.hashes(data, starts, ends)
        order = np.lexsort((hashes, text))
        t, h, s, n = text[order], hashes[order], starts[order], (ends - starts)[order]
        same = np.flatnonzero((t[1:] == t[:-1]) & (h[1:] == h[:-1]))
        out = np.bincount(text, minlength=len(offsets) - 1) - np.bincount(t[same], minlength=len(offsets) - 1)
        wrong = n[same] != n[same + 1]
        pairs = same[~wrong]
        for low in range(0, len(pairs), 1 << 16):
            some = pairs[low : low + (1 << 16)]
            size = n[some]
            first = np.cumsum(size) - size
            step = np.arange(size.sum()) - np.repeat(first, size)
            differs = data[np.repeat(s[some], size) + step] != data[np.repeat(s[some + 1], size) + step]
            wrong[np.flatnonzero(~wrong)[low : low + (1 << 16)][np.add.reduceat(differs, first) > 0]] = True
        for k in np.unique(t[same[wrong]]).tolist():  # two words of one hash
            mine = text == k
            out[k] = len({bytes(data[a:b]) for a, b in zip(starts[mine].tolist(), ends[mine].tolist(), strict=True)})
        return out

    def measure(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        starts, ends = self.spans(data, offsets)
        place = np.searchsorted(starts, offsets)
        found = {"words": place[1:] - place[:-1], "distinct": self.distinct(data, offsets, starts, ends)}
        return found | {name: self._per_text(self.classes[k][data], offsets) for name, k in (("capitals", CAPITAL), ("symbols", SYMBOL), ("points", FIRST))}


COUNTS = ["words", "distinct", "capitals", "symbols", "points"]


def _slices(column: pa.Array, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and offsets of runs of texts, views of the column's buffers; null texts are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    if not len(column):
        return
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, side="right")) - 1)
        yield data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def _run(at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measures = Measures()
        for batch in batches:
            parts = [measures.measure(*x) for x in _slices(batch.column(at), SLICE_BYTES)]
            counts = [pa.array(np.concatenate([p[c] for p in parts]) if parts else [], pa.int64()) for c in COUNTS]
            yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(batch.columns) if k != at), *counts], names=[*names, *COUNTS])

    return run


def measured(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with `COUNTS` of each text in place of the text."""
    small_batches(rows.sparkSession)
    at = rows.columns.index(text)
    rest = [f for k, f in enumerate(rows.schema.fields) if k != at]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + [f"{c} long" for c in COUNTS])
    return rows.mapInArrow(_run(at, [f.name for f in rest]), schema)


def masks(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang", min_words: int = MIN_WORDS) -> DataFrame:
    """Counts by ``part`` and ``mask`` (bit k: the k-th filter fails): ``n``, ``good`` (quality 1) and ``toxic``."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(body.cast("binary"), 256)).alias("digest"), body.alias("text"))
    fails = [F.col("words") < min_words, 100 * F.col("distinct") < 50 * F.col("words"), 100 * F.col("capitals") > 3 * F.col("points"), F.col("symbols") > 0]
    bits = F.lit(0)
    for k, failed in enumerate(fails):
        bits = bits + F.when(failed, 1 << k).otherwise(0)
    rows = measured(rows).select("id", "part", "digest", bits.alias("mask"))
    rows = rows.groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n"))  # repeated rows

    labels = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = rows.join(labels, "id", "left").fillna(False, ["good", "toxic"])

    own = ["digest", "part", "mask", "good", "toxic"]
    texts = rows.groupBy(*own).agg(F.sum("n").alias("n"), F.min("id").alias("least"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), F.min_by("n", "id").alias("first"))
    # A row of the least id, in whichever part it stands, has no smaller one beside it.
    least = F.min("least").over(Window.partitionBy("digest"))
    texts = texts.withColumn("stay", F.col("nameless") + F.when(F.col("least") == least, F.col("first")).otherwise(0))
    each = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("stay").alias("n")), F.struct((F.col("mask") + (1 << 4)).alias("mask"), (F.col("n") - F.col("stay")).alias("n"))))
    texts = texts.select("part", "good", "toxic", each.alias("x")).select("part", "good", "toxic", "x.mask", "x.n").filter("n > 0")
    return texts.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Every order's steps from counts of `masks`: ``part``, ``filter_order``, ``step``, ``kept``, ``removed``,
    ``redundant``, ``unique_fails``, ``good_lost``, ``toxic_lost`` and ``shapley``, zeros included."""
    orders = ["".join(x) for x in permutations(filters)]
    total = len(orders)
    steps = F.explode(F.sequence(F.lit(0), F.lit(total * len(filters) - 1)))
    rows = counts.select("*", steps.alias("k")).withColumn("filter_order", F.get(F.array(*map(F.lit, orders)), F.floor(F.col("k") / len(filters)).cast("int")))
    step = (F.col("k") % len(filters)).alias("step")
    bits = F.create_map(*[F.lit(x) for k, f in enumerate(filters) for x in (f, 1 << k)])
    own = F.try_element_at(bits, F.substring("filter_order", step + 1, F.lit(1)))
    before = F.aggregate(F.transform(F.split(F.substring("filter_order", F.lit(1), step), ""), lambda f: F.coalesce(F.try_element_at(bits, f), F.lit(0))), F.lit(0), lambda a, b: a + b)
    rows = rows.select("part", "filter_order", (step + 1).cast("int").alias("step"), own.alias("own"), before.alias("before"), "mask", "n", "good", "toxic")
    gone, fails = (F.col("mask").bitwiseAND(F.col("before")) != 0), F.col("mask").bitwiseAND(F.col("own")) != 0
    here = fails & ~gone
    of = lambda condition, n="n": F.sum(F.when(condition, F.col(n)).otherwise(F.lit(0))).cast("long")
    first = F.when(fails, F.col("n") * F.floor(F.lit(total) / F.bit_count("mask"))).otherwise(F.lit(0))  # orders in which this failure comes first
    return rows.groupBy("part", "filter_order", "step").agg(
        of(~gone & ~fails).alias("kept"), of(here).alias("removed"), of(fails & gone).alias("redundant"), of(F.col("mask") == F.col("own")).alias("unique_fails"),
        of(here, "good").alias("good_lost"), of(here, "toxic").alias("toxic_lost"), F.sum(first).cast("long").alias("shapley"),
    )
