"""Language ID with blended-spectrum string kernels.

k(x, y) is the number of distinct character n-grams, n = 1 to ``MAX_N``, that both lower-cased
texts have, over the geometric mean of their own counts. Landmarks are a stratified part of a
bounded training sample; the Nystrom map of the landmarks' kernel matrix gives features, and a
ridge regression for each language (one against the rest) gives scores. As the kernel counts
common n-grams, the landmarks' weights fold into one matrix of n-gram by language, so a batch of
texts is scored by one product of its presence matrix with that matrix.

Bounds: the sample holds at most ``PER_LANG`` texts a language and ``MAX_SAMPLE`` in all, taken in
the order of a hash of the id; their distinct n-grams are all that reaches the driver. Presence
matrices, of the sample as of texts to score, are made in blocks of ``CELLS`` cells. Every text is
scored whole.

Defined results: a null text, or one without a letter, is ``und`` with score 0. Rows whose id or
lang is null are not learned from; of an id with several texts in one language, the greatest is
learned from, once. Without anything to learn from, every text is ``und``. Of
equally likely languages, the first in alphabetical order is taken. Repeated rows each get a row.
Letters are `\\p{L}`; numerals of any kind are none. A language may itself be called ``und``:
``determined`` of `predict` tells its texts from undetermined ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saltern.llm.common import in_training, small_batches

MAX_N = 3
PER_LANG, MAX_SAMPLE, LANDMARKS, RIDGE, SHARPNESS = 300, 3000, 256, 1e-2, 6.0
CELLS = 8 << 20
UNDETERMINED = "und"
#: As Java writes it.
LETTER = r"\p{L}"


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _distinct_grams(points: np.ndarray) -> int:
    """The number of distinct n-grams, n = 1 to MAX_N."""
    alphabet, codes = np.unique(points, return_inverse=True)
    total, size, grams = len(alphabet), len(alphabet), codes
    for n in range(2, MAX_N + 1):
        if len(points) < n:
            break
        grams = grams[:-1] * size + codes[n - 1 :]
        if size**n <= 1 << 21:
            seen = np.zeros(size**n, bool)
            seen[grams] = True
            total += int(np.count_nonzero(seen))
        else:
            total += len(np.unique(grams))
    return total


def presence(text: str) -> np.ndarray:
    """A text's distinct n-grams, n = 1 to MAX_N: characters of 21 bits, the first lowest, from 1 on."""
    points = _points(text) + 1
    out, grams = [np.unique(points)], points
    for n in range(2, MAX_N + 1):
        grams = grams[:-1] | (points[n - 1 :] << (21 * (n - 1)))
        out.append(np.unique(grams))
    return np.concatenate(out)


class Model:
    """Weights by n-gram and language, and the alphabet that codes n-grams."""

    def __init__(self, samples: list, langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        """samples: texts, or what `presence` gives for them."""
        samples = [presence(x) if isinstance(x, str) else x for x in samples]
        self.langs = sorted(set(langs))
        rank: dict[str, int] = {}
        order = []
        for i, lang in enumerate(langs):
            rank[lang] = rank.get(lang, 0) + 1
            order.append((rank[lang], lang, i))
        chosen = [i for _, _, i in sorted(order)[:landmarks]]  # round robin over languages
        held = np.unique(np.concatenate([samples[i] for i in chosen])) if chosen else np.zeros(0, np.int64)
        self.alphabet = held[held < 1 << 21] - 1
        self.size = len(self.alphabet) + 1
        codes = self._codes(held)
        by_code = np.argsort(codes)
        self.columns, column_of = codes[by_code], np.argsort(by_code)
        own = np.array([max(1, len(x)) for x in samples], float)
        at = []
        for x in samples:
            k = np.minimum(np.searchsorted(held, x), max(0, len(held) - 1))
            at.append(column_of[k[held[k] == x]] if len(held) else k[:0])
        kernel, m = np.zeros((len(samples), len(chosen))), np.zeros((len(chosen), len(held)), bool)
        for row, i in enumerate(chosen):
            m[row, at[i]] = True
        width = max(1, CELLS // max(1, len(samples)))
        for low in range(0, len(held), width):
            x = np.zeros((len(samples), min(width, len(held) - low)), np.float32)
            for row, c in enumerate(at):
                x[row, c[(c >= low) & (c < low + width)] - low] = 1
            kernel += x @ m[:, low : low + width].T.astype(np.float32)
        kernel /= np.sqrt(own[:, None] * own[chosen][None, :])
        values, vectors = np.linalg.eigh(kernel[chosen])
        good = values > 1e-8 * max(values.max(initial=0), 1e-300)
        to_feature = vectors[:, good] / np.sqrt(values[good])
        features = kernel @ to_feature
        target = np.where(np.array(langs)[:, None] == np.array(self.langs)[None, :], 1.0, -1.0)
        count = {lang: langs.count(lang) for lang in self.langs}
        weight = np.array([1.0 / count[lang] for lang in langs]) * len(langs) / max(1, len(self.langs))
        mean = np.average(features, axis=0, weights=weight)
        self.bias = np.average(target, axis=0, weights=weight)
        centred = features - mean
        a = (centred * weight[:, None]).T @ centred + ridge * len(samples) * np.eye(centred.shape[1]) / max(1, centred.shape[1])
        w = np.linalg.solve(a, (centred * weight[:, None]).T @ (target - self.bias))
        self.bias = self.bias - mean @ w
        beta = to_feature @ w
        beta = (beta / np.sqrt(own[chosen])[:, None]).astype(np.float32)
        step = max(1, CELLS // max(1, len(chosen)))
        self.weights = np.concatenate([np.zeros((0, len(self.langs)), np.float32), *[m[:, low : low + step].T.astype(np.float32) @ beta for low in range(0, len(held), step)]])

    def _codes(self, held: np.ndarray) -> np.ndarray:
        """The model's codes of n-grams that `presence` gives, all of whose characters are known."""
        mask = (1 << 21) - 1
        first = np.searchsorted(self.alphabet, (held & mask) - 1) + 1
        out, n = first.astype(np.int64), np.ones(len(held), np.int64)
        for k in range(1, MAX_N):
            point = held >> (21 * k) & mask
            more = point > 0
            out = np.where(more, out * self.size + np.searchsorted(self.alphabet, point - 1) + 1, out)
            n += more
        return out + np.where(n > 1, (n - 1) * self.size**MAX_N, 0)

    def _grams(self, points: np.ndarray) -> np.ndarray:
        """Codes of n-grams whose characters are all in the alphabet, with repeats."""
        at = np.searchsorted(self.alphabet, points)
        at[at == len(self.alphabet)] = 0
        codes = np.where(self.alphabet[at] == points, at + 1, 0) if len(self.alphabet) else np.zeros(len(points), np.int64)
        grams, known, out = codes, codes > 0, [codes[codes > 0]]
        for n in range(2, MAX_N + 1):
            if len(points) < n:
                break
            grams = grams[:-1] * self.size + codes[n - 1 :]
            known = known[:-1] & (codes[n - 1 :] > 0)
            out.append(grams[known] + (n - 1) * self.size**MAX_N)
        return np.concatenate(out)

    def _columns_of(self, grams: np.ndarray) -> np.ndarray:
        if not len(self.columns) or not len(grams):
            return np.zeros(0, np.int64)
        at = np.searchsorted(self.columns, grams)
        at[at == len(self.columns)] = 0
        return at[self.columns[at] == grams]

    def lookup(self) -> np.ndarray | None:
        """Column by n-gram code, or -1; None where the alphabet makes it too large."""
        if MAX_N * self.size**MAX_N > 1 << 23:
            return None
        out = np.full(MAX_N * self.size**MAX_N + 1, -1, np.int32)
        out[self.columns] = np.arange(len(self.columns), dtype=np.int32)
        return out

    def score(self, texts: list[str], lookup: np.ndarray | None = None) -> np.ndarray:
        """Texts by languages."""
        rows = max(1, CELLS // (len(self.columns) + 1))
        parts = [self._score(texts[k : k + rows], lookup) for k in range(0, len(texts), rows)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.langs)))

    def _score(self, texts: list[str], lookup: np.ndarray | None) -> np.ndarray:
        x = np.zeros((len(texts), len(self.columns) + 1), np.float32)
        own = np.ones(len(texts))
        for k, text in enumerate(texts):
            points = _points(text)
            grams = self._grams(points)
            x[k, lookup[grams] if lookup is not None else self._columns_of(grams)] = 1
            own[k] = max(1, _distinct_grams(points))
        return (x[:, :-1] @ self.weights) / np.sqrt(own)[:, None] + self.bias


def fit(df: DataFrame, fold: tuple[int, int] | None = (4, 2), text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = PER_LANG, max_sample: int = MAX_SAMPLE) -> Model | None:
    """A model of the rows outside the fold that have a text and a lang; None if there are none.

    Counts by language cover all rows. They give, for each language, a bound on the hash of the id
    under which about 1.5 times the wanted rows lie, so one scan brings the sample; it is cut to size
    by that hash before anything reaches the driver.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("l"))
    rows = rows.filter(F.col("t").isNotNull() & F.col("l").isNotNull() & F.col("t").rlike(LETTER))
    rows = rows.filter(in_training(F.col("k"), *fold) if fold else F.col("k").isNotNull())
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(max_sample).collect()}
    if not counts:
        return None
    want = max(1, min(per_lang, max_sample // len(counts)))
    rows = rows.withColumn("h", F.xxhash64(F.col("k").cast("string"), F.lit("language")) / F.lit(2.0**64) + F.lit(0.5))
    under = F.lit(None).cast("double")
    limits = F.create_map(*[F.lit(x) for lang_, n in counts.items() for x in (lang_, min(1.0, (1.5 * want + 20) / n))])
    under = F.try_element_at(limits, F.col("l"))
    chosen = rows.filter(F.col("h") <= under).groupBy("k", "l").agg(F.max("t").alias("t"), F.first("h").alias("h"))
    chosen = chosen.withColumn("rank", F.row_number().over(Window.partitionBy("l").orderBy("h", "k"))).filter(F.col("rank") <= want)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("t").to_pylist()
            good = pa.array([k for k, t in enumerate(texts) if has_letter(t)], pa.int64())
            grams = [presence(texts[k]) for k in good.to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(good) for c in ("l", "h")), pa.array(grams, pa.list_(pa.int64()))], names=["l", "h", "grams"])

    found = chosen.select("l", "h", "t").mapInArrow(run, "l string, h double, grams array<long>").toArrow().sort_by([("l", "ascending"), ("h", "ascending")])
    samples, langs, taken, column = [], [], {}, found["grams"]
    for k, lang_ in enumerate(found["l"].to_pylist()):
        if taken.get(lang_, 0) < want:
            taken[lang_] = taken.get(lang_, 0) + 1
            samples.append(column[k].values.to_numpy())
            langs.append(lang_)
    return Model(samples, langs) if samples else None


def predict(df: DataFrame, model: Model | None, text: str = "text", lang_pred: str = "lang_pred", score: str = "score", determined: str | None = None) -> DataFrame:
    """``df`` with the predicted language and its score, and under the name ``determined`` whether the
    text has a letter; columns of those names are replaced."""
    small_batches(df.sparkSession)
    keep = [c for c in df.columns if c not in (lang_pred, score, determined)]
    df = df.select(*[F.col(f"`{c}`") for c in keep])
    if model is None:
        return df.withColumns({lang_pred: F.lit(UNDETERMINED), score: F.lit(0.0)} | ({determined: F.coalesce(F.col(f"`{text}`").rlike(LETTER), F.lit(False))} if determined else {}))
    more = [determined] if determined else []
    at, names = keep.index(text), [*keep, lang_pred, score, *more]
    inner = [f"c{k}" for k in range(len(names))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = model.lookup()
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                texts = batch.column(at).to_pylist()
                some = [k for k, t in enumerate(texts) if t and has_letter(t)]
                langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
                if some:
                    z = SHARPNESS * model.score([texts[k] for k in some], lookup)
                    z = np.exp(z - z.max(axis=1, keepdims=True))
                    z /= z.sum(axis=1, keepdims=True)
                    for k, best, row in zip(some, z.argmax(axis=1), z, strict=True):
                        langs[k], scores[k] = model.langs[best], float(row[best])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *[pa.array(np.isin(np.arange(len(texts)), some)) for _ in more]], names=inner)

    schema = T.StructType([*df.schema.fields, T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType()), *[T.StructField(c, T.BooleanType()) for c in more]])
    return df.toDF(*[f"c{k}" for k in range(len(keep))]).mapInArrow(run, T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(schema)])).toDF(*names)
