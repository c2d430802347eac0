"""Clusters of near copies: all links counted, within bounded memory."""

import tracemalloc

import numpy as np
import pyarrow as pa

from saltern.llm import embedding_dedup


def cluster(n, dims=32):
    rng = np.random.default_rng(1)
    x = rng.normal(size=dims) + 1e-3 * rng.normal(size=(n, dims))
    return x.astype(np.float32)


def test_tiles_keep_no_list_of_pairs():
    n = 1000
    hashes, x = embedding_dedup.plan(n, 32, 0.93), cluster(n)
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    codes = hashes.table(unit, 0)
    bucket = int(np.bincount(np.unique(codes[:, 0], return_inverse=True)[1]).argmax())
    code = int(np.unique(codes[:, 0])[bucket])
    rows = {"tbl": np.zeros(n, np.int32), "code": np.full(n, code), "left": np.zeros(n, np.int32), "right": np.zeros(n, np.int32), "side": np.zeros(n, np.int32), "node": np.arange(n), "copies": np.ones(n, np.int64), "home": codes[:, 0] == code}
    group = pa.table(rows | {"label": np.zeros(n, np.int64), "vec": pa.array([v.tobytes() for v in x], pa.binary())})
    tracemalloc.start()
    out = embedding_dedup._tiles(hashes, 0.93, False)(group)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    counted = {a: k for a, b, k in zip(*[out[c].to_pylist() for c in ("a", "b", "links")], strict=True) if b is None}
    home = codes[:, 0] == code
    assert home.sum() > n / 2 and all(counted[k] == n - 1 for k in np.flatnonzero(home).tolist())
    assert peak < 120 << 20, peak  # half a million pairs; a list of them with their codes takes several times as much


def test_dense_label_is_one_component(spark):
    x = cluster(400)
    rows = [(k, [float(v) for v in vec], 1 if k % 2 else 2) for k, vec in enumerate(x)]
    out = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert {(r["id"] % 2, r["n_links"], r["component_id"]) for r in out} == {(0, 199, 0), (1, 199, 1)}
