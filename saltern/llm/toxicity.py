"""Toxicity classifier that is regularised with counterfactual identity swaps.

A text is a set of features: its lower-cased words, and the first four letters of longer ones. A
logistic regression is fitted on a bounded sample of labelled rows. For each sampled text with
terms of a group, other terms of the same group are put in their place, and the squared change of
the logit is added to the loss with weight ``SWAP_WEIGHT``: what a score owes to the mention of
one group rather than another is penalised, so that neutral mentions do not raise it.

Groups are the given ``IDENTITY_GROUPS``, in four languages, and groups that the training rows
tell: mentions, that is words of many texts (``MENTION_ROWS``, or a twentieth of a small sample) but
of no more than a quarter of them, without association with the label (|z| under ``NEUTRAL_Z``),
belong together when they most often follow the same word. So swaps act also where
a corpus names groups in words that no list has. A text swaps at most ``SWAP_TERMS`` of its terms
(in the order of a hash), each for ``SWAP_OTHERS`` others.

Bounds: ``MAX_SAMPLE`` labelled rows in the order of a hash of the id, ``MAX_FEATURES`` features,
``MAX_MENTIONS`` learned terms. Only the sample's hashed features and the learned terms reach the
driver. Every text is scored whole.

Defined results: a null or empty text has the score of a text without features. Rows whose id,
text or label is null are not learned from; an id with several labels counts as toxic if one of
them says so, and of an id with several texts the greatest is learned from, once. Without both
labels in the sample, the score is the share of toxic rows (0 without rows). Repeated rows each get
a row.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saltern.llm.common import drop_written, in_training, small_batches, written

# Identity terms in groups, each term a counterfactual of the others of its group.
IDENTITY_GROUPS = [
    ["women", "men", "transgender", "nonbinary"],
    ["woman", "man", "girl", "boy"],
    ["gay", "lesbian", "straight", "bisexual", "queer"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "latino", "indigenous"],
    ["immigrant", "refugee", "foreigner", "citizen"],
    ["disabled", "blind", "deaf", "autistic"],
    ["old", "young", "elderly"],
    ["frauen", "männer"],
    ["frau", "mann", "mädchen", "junge"],
    ["schwul", "lesbisch", "bisexuell", "queer"],
    ["muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"],
    ["ausländer", "flüchtlinge", "migranten", "einheimische"],
    ["behinderte", "blinde", "gehörlose"],
    ["femmes", "hommes"],
    ["femme", "homme", "fille", "garçon"],
    ["gay", "lesbienne", "bisexuel", "hétéro"],
    ["musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"],
    ["immigrés", "réfugiés", "étrangers", "citoyens"],
    ["mujeres", "hombres"],
    ["mujer", "hombre", "niña", "niño"],
    ["gay", "lesbiana", "bisexual", "heterosexual"],
    ["musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"],
    ["inmigrantes", "refugiados", "extranjeros", "ciudadanos"],
]

MAX_SAMPLE, MAX_FEATURES, LEAST_ROWS, LEAST_Z = 8000, 6000, 4, 3.0
MAX_MENTIONS, NEUTRAL_Z, MENTION_ROWS, SWAP_TERMS, SWAP_OTHERS = 300, 1.0, 20, 6, 3
L2, SWAP_WEIGHT, ROUNDS = 2e-4, 1.0, 200
_WORD = re.compile(r"[^\W\d_]+")
_MEMO_ROWS = 200_000


def word_features(word: str) -> tuple[int, ...]:
    own = zlib.crc32(b"w" + word.encode("utf-8", "surrogatepass"))
    return (own, zlib.crc32(b"p" + word[:4].encode("utf-8", "surrogatepass"))) if len(word) > 4 else (own,)


def features(words: set[str]) -> set[int]:
    return {f for w in words for f in word_features(w)}


def others_of(groups: list[list[str]]) -> dict[str, list[str]]:
    """For each term the terms that may stand in its place; a term of several groups has those of all."""
    out: dict[str, list[str]] = {}
    for group in groups:
        for term in group:
            out.setdefault(term, []).extend(x for x in group if x != term and x not in out.get(term, []))
    return out


def swaps(words: set[str], others: dict[str, list[str]]) -> list[tuple[list[int], list[int]]]:
    """Features that each counterfactual of a text loses and gains."""
    terms = sorted(words & others.keys(), key=lambda t: (zlib.crc32(t.encode("utf-8", "surrogatepass")), t))[:SWAP_TERMS]
    if not terms:
        return []
    held = Counter(f for w in words for f in word_features(w))
    out = []
    for term in terms:
        for other in [x for x in others[term] if x not in words][:SWAP_OTHERS]:
            old, new = word_features(term), word_features(other)
            lost = [f for f in old if held[f] == 1 and f not in new]
            gained = [f for f in new if f not in held]
            if lost or gained:
                out.append((lost, gained))
    return out


class Model:
    """Weights by hashed feature; ``swaps`` is the number of counterfactuals that bear on them."""

    def __init__(self, rows: list[tuple[list[int], list[tuple[list[int], list[int]]], int]], swap_weight: float = SWAP_WEIGHT, terms: set[str] = frozenset()):
        """rows: features, what each counterfactual loses and gains, label. ``terms`` are of groups."""
        y = np.array([r[2] for r in rows], float)
        self.bias, self.weights, self.swaps = 0.0, {}, 0
        self.flat = float(y.mean()) if len(y) else 0.0
        if not len(y) or y.min() == y.max():
            return
        self.flat = None
        each = np.concatenate([np.asarray(r[0], np.int64) for r in rows])
        row_of = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        names, at = np.unique(each, return_inverse=True)
        n = np.bincount(at, minlength=len(names)).astype(float)
        pos = np.bincount(at, weights=y[row_of], minlength=len(names))
        rate = y.mean()
        z = np.abs(pos - n * rate) / np.sqrt(np.maximum(n * rate * (1 - rate), 1e-9))
        identity = np.isin(names, [f for t in sorted(terms) for f in word_features(t)])
        good = np.flatnonzero((n >= min(LEAST_ROWS, max(1, len(y) // 10))) & ((z >= LEAST_Z) | identity))
        good = good[np.lexsort((names[good], -z[good], ~identity[good]))][:MAX_FEATURES]
        column = np.full(len(names), -1)
        column[good] = np.arange(len(good))
        used = column[at] >= 0
        r, c = row_of[used], column[at[used]]
        index = {int(names[g]): k for k, g in enumerate(good)}
        swaps = []
        for _, others, _ in rows:
            for lost, gained in others:
                d = [(index[f], 1.0) for f in lost if f in index] + [(index[f], -1.0) for f in gained if f in index]
                if d:
                    swaps.append(d)
        self.swaps = len(swaps)
        sr = np.repeat(np.arange(len(swaps)), [len(d) for d in swaps])
        sc = np.array([k for d in swaps for k, _ in d], np.int64)
        sv = np.array([v for d in swaps for _, v in d])
        w, b = np.zeros(len(good)), float(np.log(rate / (1 - rate)))
        first, second, at_step = np.zeros(len(w) + 1), np.zeros(len(w) + 1), 0
        for at_step in range(1, ROUNDS + 1):
            p = 1 / (1 + np.exp(-(np.bincount(r, weights=w[c], minlength=len(y)) + b)))
            e = (p - y) / len(y)
            g = np.bincount(c, weights=e[r], minlength=len(w)) + L2 * w
            if swaps:
                change = np.bincount(sr, weights=sv * w[sc], minlength=len(swaps))
                g += 2 * swap_weight / len(swaps) * np.bincount(sc, weights=sv * change[sr], minlength=len(w))
            full = np.append(g, e.sum())
            first = 0.9 * first + 0.1 * full
            second = 0.99 * second + 0.01 * full**2
            step = 0.1 * (first / (1 - 0.9**at_step)) / (np.sqrt(second / (1 - 0.99**at_step)) + 1e-8)
            w, b = w - step[:-1], b - step[-1]
        self.bias, self.weights = float(b), {int(names[g]): float(x) for g, x in zip(good, w, strict=True)}

    def score(self, words: set[str], memo: dict[str, tuple[int, ...]] | None = None) -> float:
        if self.flat is not None:
            return self.flat
        memo = {} if memo is None else memo
        found: set[int] = set()
        for word in words:
            own = memo.get(word)
            if own is None:
                own = memo[word] = tuple(f for f in word_features(word) if f in self.weights)
            if own:
                found.update(own)
        z = self.bias + sum(self.weights[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-z))) if z > -700 else 0.0


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def _mentions(sample: DataFrame) -> list[list[str]]:
    """Groups of words without association with the label that most often follow the same word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], list[int]] = {}
        for batch in batches:
            for y, t in zip(batch.column("y").to_pylist(), batch.column("t").to_pylist(), strict=True):
                words = _WORD.findall((t or "").lower())
                first = dict(reversed([(w, before) for before, w in zip(["", *words[:-1]], words, strict=True)]))
                for w, before in first.items():
                    own = counts.setdefault((w, before), [0, 0])
                    own[0] += 1
                    own[1] += y
        keys, sums = list(counts), list(counts.values())
        yield pa.RecordBatch.from_pydict(
            {"w": [k[0] for k in keys], "before": [k[1] for k in keys], "n": [v[0] for v in sums], "p": [v[1] for v in sums]},
            pa.schema([("w", pa.string()), ("before", pa.string()), ("n", pa.int64()), ("p", pa.int64())]),
        )

    found = sample.select("y", "t").mapInArrow(run, "w string, before string, n long, p long").groupBy("w", "before").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    n, p = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < p < n:
        return []
    rate = p / n
    words = found.groupBy("w").agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.max(F.struct("n", "before")).getField("before").alias("before"))
    z = F.abs(F.col("p") - F.col("n") * rate) / F.sqrt(F.col("n") * (rate * (1 - rate)))
    words = words.filter((F.col("n") >= min(MENTION_ROWS, max(3, n / 20))) & (F.col("n") <= n / 4) & (z < NEUTRAL_Z)).orderBy(F.desc("n"), "w").limit(MAX_MENTIONS)
    groups: dict[str, list[str]] = {}
    for r in words.collect():
        groups.setdefault(r["before"], []).append(r["w"])
    return [g for _, g in sorted(groups.items()) if len(g) > 1]


def fit(df: DataFrame, labels: DataFrame, fold: tuple[int, int] | None = (4, 2), text: str = "text", key: str = "doc_id", label: str = "toxic", max_sample: int = MAX_SAMPLE, swap_weight: float = SWAP_WEIGHT) -> Model:
    """A model of the labelled rows outside the fold.

    The labels are counted first; a bound on the hash of the id, 1.3 times the wanted share, then
    keeps the join to about the sample's size. The sample is cut to its size where it lies, and
    written, as the groups and the features are taken from it in turn.
    """
    small_batches(df.sparkSession)
    marks = labels.select(F.col(key).alias("k"), F.col(label).alias("y")).filter(F.col("y").isin(0, 1))
    marks = marks.filter(in_training(F.col("k"), *fold) if fold else F.col("k").isNotNull())
    n = marks.select("k").distinct().count()
    hashed = F.xxhash64(F.col("k").cast("string"), F.lit("toxic")) / F.lit(2.0**64) + F.lit(0.5)
    under = min(1.0, (1.3 * max_sample + 50) / max(1, n))
    marks = marks.withColumn("h", hashed).filter(F.col("h") <= under).groupBy("k", "h").agg(F.max("y").cast("int").alias("y"))
    texts = df.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.col("t").isNotNull() & F.col("k").isNotNull()).filter(hashed <= under)
    sample = written(texts.groupBy("k").agg(F.max("t").alias("t")).join(marks, "k").select("h", "y", "t"), "toxicity-sample")
    places = sorted(sample.select("h").toArrow()["h"].to_pylist())  # about 1.3 times the sample's numbers
    if len(places) > max_sample:
        sample = sample.filter(F.col("h") <= places[max_sample - 1])
    others = others_of([*IDENTITY_GROUPS, *_mentions(sample)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, y, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(t)
                out.append({"h": h, "y": y, "f": sorted(features(words)), "s": [{"lost": a, "gained": b} for a, b in swaps(words, others)]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("h", pa.float64()), ("y", pa.int32()), ("f", pa.list_(pa.int64())), ("s", pa.list_(pa.struct([("lost", pa.list_(pa.int64())), ("gained", pa.list_(pa.int64()))])))]))

    frame = sample.mapInArrow(run, "h double, y int, f array<long>, s array<struct<lost:array<long>,gained:array<long>>>").toArrow().sort_by([("h", "ascending"), ("y", "ascending")])
    drop_written(sample)
    f, s = (frame[c].combine_chunks() if frame.num_rows else [] for c in ("f", "s"))
    rows = [(f[i].values.to_numpy(), [(x["lost"], x["gained"]) for x in s[i].as_py()], y) for i, y in enumerate(frame["y"].to_pylist())]
    return Model(rows, swap_weight, set(others))


def score(df: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """``df`` with the probability that each whole text is toxic; a column of that name is replaced."""
    small_batches(df.sparkSession)
    keep = [c for c in df.columns if c != score]
    df = df.select(*[F.col(f"`{c}`") for c in keep])
    at, names = keep.index(text), [*keep, score]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[int, ...]] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch, out = whole.slice(start, 1024), []
                for cell in batch.column(at):
                    if len(memo) > _MEMO_ROWS:
                        memo = {}
                    out.append(model.score(words_of(cell.as_py()), memo))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=names)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(score, T.DoubleType())]))
