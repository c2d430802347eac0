"""Language-model scoring by deleted interpolation.

P(w | h) mixes the maximum-likelihood estimates of all orders up to ``order`` and a uniform share
for unseen words. The weights depend on the frequency bucket (power of two) of the longest
context. The training documents of one block in ``DELETED`` are held out of the counts, and
expectation-maximisation on their events, with the counts of the other blocks, gives the weights;
the scores then use the counts of all training documents. Counts come from every training token.

Documents belong to blocks by a hash of their place, so repeated rows are dealt like any. One pass hashes every n-gram and sends, for each bucket of
hashes, the distinct (n-gram, block) pairs with their training counts as packed bytes. A bucket
adds up counts and answers each block with the counts of the block's n-grams, in hash order; the
block's documents, brought together by a second shuffle, have the same n-grams in the same order,
so counts alone travel back. Words keep enough hash bits that two of them hardly ever share a
hash in a corpus of that size; longer n-grams keep 24 bits more than the logarithm of the number
of tokens, so about one lookup in 17 million meets another n-gram's count. Blocks and buckets grow in
number with the corpus and not in size; repeated n-grams are merged before the shuffle.

Only the events' histogram (bucket by quantised estimates, bounded by its cells) and a few totals
reach the driver.

Defined results: a null text counts as empty: one token, the end. Without training documents the
words are unknown and the score is that of the uniform share. Rows without an id are scored, not
learned from. Repeated rows each get a row and each count. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltern.llm.common import drop_written, fold_is, in_training, small_batches, written
from saltern.llm.exact_dedup import located, position, spot
from saltern.llm.packing import expand, mix, squeeze

BLOCK_BYTES, BATCH_BYTES, PER_BUCKET, DELETED = 8 << 20, 6 << 20, 1_000_000, 16
CONTEXT_BUCKETS, STEPS, ROUNDS = 32, 8, 60
_ORDER_KEY = np.uint64(0x9FB21C651E98DF25)
_START = 0x51ED270B7A5C1E33


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's words and its end, and the number of each text's."""
    import xxhash

    end = xxhash.xxh64_intdigest(b"")
    words, sizes = [], np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        own = text.encode("utf-8", "surrogatepass").lower().split()
        sizes[k] = len(own) + 1
        words.append(np.fromiter(map(xxhash.xxh64_intdigest, own), np.uint64, len(own)))
        words.append(np.array([end], np.uint64))
    return (np.concatenate(words) if words else np.zeros(0, np.uint64)), sizes


def _grams(tokens: np.ndarray, sizes: np.ndarray, order: int) -> list[np.ndarray]:
    """For each order, the hash of the n-gram that ends at each token."""
    first = np.cumsum(sizes) - sizes
    grams = [mix(tokens)]
    for k in range(2, order + 1):
        before = np.empty_like(tokens)
        before[1:] = grams[-1][:-1]
        before[first] = np.uint64(_START + k)
        grams.append(mix(before * _ORDER_KEY + tokens))
    return grams


def _bits(tokens: int, order: int) -> int:
    need = math.log2(max(2, tokens))
    return max(40, min(64, math.ceil(2 * need + 2 if order == 1 else need + 24)))


def _bucket_of(grams: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Buckets in the order of the hashes, of which the top ``bits`` are given."""
    top = grams >> np.uint64(bits - 32)
    return ((top * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _batches(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about BATCH_BYTES of text."""
    start, size = 0, 0
    for k, cell in enumerate(batch.column("text")):
        size += len(cell.as_buffer()) if cell.is_valid else 0
        if size >= BATCH_BYTES or k == batch.num_rows - 1:
            yield batch.slice(start, k + 1 - start)
            start, size = k + 1, 0


def _ask(order: int, bits: list[int], buckets: int):
    """(block, train, text) to (level, bucket, grams, blocks, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _batches(whole):
                tokens, sizes = _tokens([x or "" for x in batch.column("text").to_pylist()])
                block = np.repeat(batch.column("block").to_numpy().astype(np.uint64), sizes)
                train = np.repeat(batch.column("train").to_numpy(zero_copy_only=False).astype(np.uint64), sizes)
                out = {c: [] for c in ("level", "bucket", "grams", "blocks", "counts")}
                for level, grams in enumerate(_grams(tokens, sizes, order)):
                    own, rank = np.unique(grams >> np.uint64(64 - bits[level]), return_inverse=True)
                    both, n = np.unique((rank.astype(np.uint64) << np.uint64(33)) | (block << np.uint64(1)) | train, return_counts=True)
                    pair = both >> np.uint64(1)
                    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
                    counts = np.add.reduceat(n * (both & np.uint64(1)).astype(np.int64), first).astype(np.uint32)
                    pair = pair[first]
                    gram, owner = own[(pair >> np.uint64(32)).astype(np.int64)], (pair & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                    bucket = _bucket_of(gram, bits[level], buckets)
                    edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist()
                    for s, e in zip(edges, [*edges[1:], len(bucket)], strict=True):
                        out["level"].append(level)
                        out["bucket"].append(int(bucket[s]))
                        out["grams"].append(squeeze(np.diff(gram[s:e], prepend=np.uint64(0))))
                        out["blocks"].append(squeeze(owner[s:e]))
                        out["counts"].append(squeeze(counts[s:e]))
                yield pa.RecordBatch.from_pydict(out, pa.schema([("level", pa.int32()), ("bucket", pa.int64()), ("grams", pa.binary()), ("blocks", pa.binary()), ("counts", pa.binary())]))

    return run


def _answer(group: pa.Table) -> pa.Table:
    """One bucket's answers: (block, level, bucket, counts, retained). Block -1 has the totals:
    tokens, distinct words, and tokens without the deleted blocks."""
    level, bucket = group["level"][0].as_py(), group["bucket"][0].as_py()
    grams = np.concatenate([np.cumsum(expand(x, np.uint64), dtype=np.uint64) for x in group["grams"].to_pylist()])
    blocks = np.concatenate([expand(x, np.uint32) for x in group["blocks"].to_pylist()])
    counts = np.concatenate([expand(x, np.uint32) for x in group["counts"].to_pylist()]).astype(np.float64)
    own, rank = np.unique(grams, return_inverse=True)
    total = np.bincount(rank, weights=counts, minlength=len(own)).astype(np.uint64)
    kept = np.bincount(rank, weights=counts * (blocks % DELETED != 0), minlength=len(own)).astype(np.uint64)
    pair = np.unique((blocks.astype(np.uint64) << np.uint64(32)) | rank.astype(np.uint64))
    block, rank = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
    edges = np.flatnonzero(np.append(True, block[1:] != block[:-1])).tolist()
    out = {"block": [-1], "level": [level], "bucket": [bucket], "counts": [None], "retained": [None], "tokens": [int(total.sum())], "words": [int((total > 0).sum())], "kept": [int(kept.sum())]}
    for s, e in zip(edges, [*edges[1:], len(block)], strict=True):
        at = rank[s:e]
        out["block"].append(int(block[s]))
        out["level"].append(level)
        out["bucket"].append(bucket)
        out["counts"].append(squeeze(total[at]))
        out["retained"].append(squeeze(kept[at]) if block[s] % DELETED == 0 else None)
        for c in ("tokens", "words", "kept"):
            out[c].append(None)
    return pa.table(out, schema=pa.schema([("block", pa.int64()), ("level", pa.int32()), ("bucket", pa.int64()), ("counts", pa.binary()), ("retained", pa.binary()), *((c, pa.int64()) for c in ("tokens", "words", "kept"))]))


def _counts(docs: pa.Table, answers: pa.Table, order: int, bits: list[int], column: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """The texts' sizes and, for each order, the count of the n-gram that ends at each token."""
    tokens, sizes = _tokens([x or "" for x in docs["text"].to_pylist()])
    answers = answers.sort_by([("level", "ascending"), ("bucket", "ascending")])
    levels, out = answers["level"].to_numpy(), []
    blobs = answers[column].to_pylist()
    for level, grams in enumerate(_grams(tokens, sizes, order)):
        own, rank = np.unique(grams >> np.uint64(64 - bits[level]), return_inverse=True)
        counts = [expand(blobs[i], np.uint64) for i in np.flatnonzero(levels == level)]
        counts = np.concatenate(counts) if counts else np.zeros(0, np.uint64)
        if len(counts) != len(own):
            raise ValueError(f"a block has {len(own)} n-grams of order {level + 1} and answers for {len(counts)}")
        out.append(counts[rank].astype(np.float64))
    return sizes, out


def _estimates(sizes: np.ndarray, counts: list[np.ndarray], tokens: float, starts: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """The context bucket of each token and its maximum-likelihood estimates by order."""
    first = np.cumsum(sizes) - sizes
    out, context = [counts[0] / max(1.0, tokens)], np.full(len(counts[0]), tokens)
    for level in range(1, len(counts)):
        context = np.empty_like(counts[0])
        context[1:] = counts[level - 1][:-1]
        context[first] = starts
        out.append(counts[level] / np.maximum(context, 1.0))
    bucket = np.minimum(np.floor(np.log2(np.maximum(context, 0.5))).astype(np.int64) + 1, CONTEXT_BUCKETS - 1)
    return bucket, [np.minimum(p, 1.0) for p in out]


_LEVELS = 64 * STEPS


def _events(order: int, bits: list[int], tokens: float, starts: float):
    """The histogram of a deleted block's training tokens: (cell, n)."""

    def run(_key, docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({"cell": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        sizes, counts = _counts(docs, answers, order, bits, "retained")
        cell, estimates = _estimates(sizes, counts, tokens, starts)
        learn = np.repeat(docs["train"].to_numpy(), sizes)
        cell, estimates = cell[learn], [p[learn] for p in estimates]
        for p in estimates:
            level = np.where(p > 0, np.round(-STEPS * np.log2(np.maximum(p, 1e-18))).astype(np.int64), _LEVELS - 1)
            cell = cell * _LEVELS + np.clip(level, 0, _LEVELS - 1)
        cell, n = np.unique(cell, return_counts=True)
        return pa.table({"cell": cell, "n": n.astype(np.int64)})

    return run


def weights(cells: np.ndarray, n: np.ndarray, order: int, unseen: float) -> np.ndarray:
    """Mixture weights (bucket by: uniform, order 1, 2 ...) by expectation-maximisation."""
    out = np.full((CONTEXT_BUCKETS, order + 1), 1.0 / (order + 1))
    levels, rest = [], cells.copy()
    for _ in range(order):
        levels.append(rest % _LEVELS)
        rest //= _LEVELS
    p = np.stack([np.full(len(cells), unseen), *[np.where(x == _LEVELS - 1, 0.0, 2.0 ** (-x / STEPS)) for x in reversed(levels)]], axis=1)
    pooled = None
    for bucket in [None, *range(CONTEXT_BUCKETS)]:
        at = slice(None) if bucket is None else rest == bucket
        own, count = p[at], n[at].astype(float)
        w = np.full(order + 1, 1.0 / (order + 1)) if pooled is None else pooled.copy()
        if count.sum() < 1:
            out[bucket if bucket is not None else slice(None)] = w
            pooled = w if bucket is None else pooled
            continue
        for _ in range(ROUNDS):
            share = own * w
            share /= share.sum(axis=1, keepdims=True)
            w = (share * count[:, None]).sum(axis=0) / count.sum()
            w = np.maximum(w, 1e-9)
            w /= w.sum()
        if bucket is None:
            pooled = w
            out[:] = w
        else:
            out[bucket] = w
    return out


def _score(order: int, bits: list[int], tokens: float, distinct: float, starts: float, shares: np.ndarray):
    def run(_key, docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({"id": docs["id"], "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
        sizes, counts = _counts(docs, answers, order, bits, "counts")
        bucket, estimates = _estimates(sizes, counts, tokens, starts)
        p = shares[bucket, 0] / (distinct + 1)
        for level, estimate in enumerate(estimates):
            p = p + shares[bucket, level + 1] * estimate
        first = np.cumsum(sizes) - sizes
        base = np.log10((counts[0] + 1) / (tokens + distinct + 1))
        known = np.add.reduceat((counts[0] > 0).astype(np.int64), first)
        return pa.table({"id": docs["id"], "n_tokens": sizes, "n_known": known, "base_score": np.add.reduceat(base, first), "score": np.add.reduceat(np.log10(p), first)})

    return run


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", fold: tuple[int, int] | None = (7, 2), order: int = 2) -> DataFrame:
    """One row a document: ``id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` (add-one unigrams) and ``score`` (the mixture), both log10 of the whole text."""
    small_batches(docs.sparkSession)
    rows = located(docs)
    id_, body = F.col(position(docs.columns, key)), F.col(position(docs.columns, text))
    train: Column = in_training(id_, *fold) if fold else id_.isNotNull()
    size = rows.agg(F.coalesce(F.sum(F.octet_length(body)), F.lit(0)), F.count("*"), F.count_if(train)).first()
    blocks = DELETED * max(2, -(-int(size[0]) // (BLOCK_BYTES * DELETED)))
    about = max(1, int(size[0]) // 6 + size[1])
    buckets, bits = max(8, -(-about // PER_BUCKET)), [_bits(about, k + 1) for k in range(order)]
    rows = rows.select(id_.alias("id"), body.alias("text"), train.alias("train"), F.pmod(spot(), F.lit(blocks)).alias("block"))

    asked = rows.select("block", "train", "text").mapInArrow(_ask(order, bits, buckets), "level int, bucket long, grams binary, blocks binary, counts binary")
    answers = written(asked.groupBy("level", "bucket").applyInArrow(_answer, "block long, level int, bucket long, counts binary, retained binary, tokens long, words long, kept long"), "lm-answers")
    totals = answers.filter("block = -1 AND level = 0").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "words", "kept")]).first()
    tokens, distinct, kept = map(float, totals)
    answers = answers.filter("block >= 0").drop("tokens", "words", "kept")
    starts = float(size[2])

    deleted = rows.filter(F.col("block") % DELETED == 0)
    kept_starts = starts - float(deleted.filter("train").count())
    if kept > 0:
        events = deleted.groupBy("block").cogroup(answers.filter(F.col("block") % DELETED == 0).groupBy("block")).applyInArrow(_events(order, bits, kept, kept_starts), "cell long, n long")
        found = events.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        cells, n = found["cell"].to_numpy(), found["n"].to_numpy()
    else:
        cells = n = np.zeros(0, np.int64)
    shares = weights(cells, n, order, 1 / (distinct + 1))
    out = rows.drop("train").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(order, bits, tokens, distinct, starts, shares), f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, n_known long, base_score double, score double")
    held_out = fold_is(F.col("id"), *fold) if fold else F.lit(False)
    return out.select("id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"), "base_score", "score")
