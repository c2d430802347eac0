"""Which texts hold which heads (short passages), by winnowed fingerprints and a check of what meets.

A text and a head are cut into grams of k characters, and of each run of w hashed grams the smallest hash
is selected. A head of k + w - 1 characters or more has a whole run; a text that holds it has the same run,
so whatever the head's runs select, the text selects too. A text keeps about 2 / (w + 1) of its hashes, and only those that a
head asks for are shuffled. Each head then meets texts through the one of its fingerprints that the fewest
texts have, and what meets is verified with ``contains``. One word, or one line, that is in all texts is
therefore no meeting place, unless a head is nothing else.

Defined results: null or empty texts and heads hold nothing and are held by nothing; repeated rows count
once; rows with a null key, or a null in a column of ``by``, are left out. Texts of any length are hashed
in strides of `STRIDE` characters that overlap by a run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltern.sources.shared import written

#: (k, w), the first that a head is long enough for; below the third, every gram is selected.
LEVELS = [(16, 13), (8, 9), (4, 5), (4, 1), (1, 1)]
STRIDE = 1 << 18
_ROWS = 1 << 16
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _level(head: Column) -> Column:
    out = F
    for at, (k, w) in enumerate(LEVELS):
        out = out.when(F.char_length(head) >= k + w - 1, at)
    return out


def selected(text: str, level: int) -> np.ndarray:
    """The distinct fingerprints of a text, ascending; none if it is shorter than one run."""
    k, w = LEVELS[level]
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    found = []
    for start in range(0, max(1, len(codes) - k - w + 2), STRIDE):
        part = codes[start : start + STRIDE + k + w - 2].astype(np.uint64)
        n = len(part) - k + 1
        if n < w:
            continue
        h = np.full(n, level + 1, np.uint64)
        for j in range(k):
            h = h * _BASE + part[j : j + n]
        h ^= h >> np.uint64(32)
        h *= _MIX
        h ^= h >> np.uint64(29)
        size = 1
        while size < w:  # smallest of runs of twice the size, until they are w long
            step = min(size, w - size)
            h, size = np.minimum(h[:-step], h[step:]), size + step
        found.append(np.unique(h))
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)


def _fingerprints(text: str, levels: list[int] | None, schema: pa.Schema):
    """Rows of ``schema`` but ``fp``, once for each fingerprint; ``levels`` None: each row's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [n for n in schema.names if n != "fp"]
            rows, prints, size = [], [], 0
            own = batch.column("level").to_pylist() if levels is None else None
            for at in range(batch.num_rows):
                value = batch.column(text)[at].as_py()
                for level in [own[at]] if levels is None else levels:
                    got = selected(value, level)
                    rows.append(np.full(len(got), at))
                    prints.append(got)
                    size += len(got)
                if size and (size >= _ROWS or at == batch.num_rows - 1):
                    taken = batch.select(kept).take(pa.array(np.concatenate(rows)))
                    fp = pa.array(np.concatenate(prints).view(np.int64))
                    yield pa.RecordBatch.from_arrays([*[taken.column(n) for n in kept], fp], schema=schema)
                    rows, prints, size = [], [], 0
            if size:
                taken = batch.select(kept).take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([*[taken.column(n) for n in kept], pa.array(np.concatenate(prints).view(np.int64))], schema=schema)

    return run


def _with_prints(rows: DataFrame, text: str, kept: list[str], levels: list[int] | None) -> DataFrame:
    spark = rows.sparkSession
    empty = spark.createDataFrame([], rows.select(*kept).schema).withColumn("fp", F.lit(0).cast("long"))
    return rows.mapInArrow(_fingerprints(text, levels, empty.toArrow().schema), empty.schema)


def holding(texts: DataFrame, heads: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Distinct (*by, key, head): texts (key, text, *by) that hold a head (head, *by) of equal ``by``."""
    by = by or []
    heads = written(heads.select(*by, "head").filter("head <> ''").dropna(subset=by or None).distinct().withColumn("level", _level(F.col("head"))), "heads")
    levels = sorted(r["level"] for r in heads.select("level").distinct().collect())  # at most five numbers
    texts = texts.select(*by, "key", "text").filter("text <> ''").dropna(subset=["key", *by]).withColumn("at", F.xxhash64("text"))
    if not levels:
        return texts.join(heads.select(*by, "head"), by).select(*by, "key", "head") if by else texts.select("key", F.col("text").alias("head")).limit(0)
    asked = written(_with_prints(heads, "head", [*by, "head"], None), "head-prints")
    held = _with_prints(texts, "text", [*by, "key", "at"], levels)
    held = written(held.join(asked.select(*by, "fp").distinct(), [*by, "fp"], "left_semi"), "text-prints")
    known = held.groupBy(*by, "fp").agg(F.count("*").alias("n"))
    rarest = asked.join(known, [*by, "fp"], "left").groupBy(*by, "head").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "fp")).alias("x"))
    rarest = rarest.filter("x.n > 0").select(*by, "head", F.col("x.fp").alias("fp"))
    pairs = held.join(rarest, [*by, "fp"]).select(*by, "key", "at", "head").distinct()
    met = texts.join(pairs, [*by, "key", "at"]).filter(F.col("text").contains(F.col("head")))
    return met.select(*by, "key", "head").distinct()
