"""Hard negatives against all pairs in plain numpy, with clusters, copies, odd rows and large numbers."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadmill.llm import hardneg

SCHEMA = "vec_id long, embedding array<float>, label int, no int, ID2 string"


def brute(rows: list[tuple]) -> list[tuple]:
    """All pairs; scores are Python integers."""
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v], y) for i, v, y in rows if i is not None and v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v, y) in enumerate(ok):
        if i % 50:
            continue
        scored = [(max(hardneg._LOW, min(hardneg._HIGH, sum(p * q for p, q in zip(v, w, strict=True)))), j, z) for b, (j, w, z) in enumerate(ok) if b != a and len(w) == len(v)]
        scored.sort(key=lambda x: (-x[0], x[1]))
        for p, j, _ in [x for x in scored if x[2] == y][:5]:
            band = [x for x in scored if x[2] != y and 50 * p <= 100 * x[0] <= 95 * p][:3]
            out += [(i, j, r, n, p, s) for r, (s, n, _) in enumerate(band, 1)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    found = hardneg.mine(df, F.col("vec_id") % 50 == 0, **more)
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in found.collect())


def clusters(n: int, dim: int, seed: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    x = centres[rng.integers(0, 12, n)] * rng.choice([0.2, 1, 3], n)[:, None] + rng.normal(size=(n, dim)) * 0.1
    return [(int(i), [float(np.float32(c)) for c in x[i]], int(rng.integers(0, 3))) for i in range(n)]


@pytest.mark.parametrize(("bucket", "group"), [(4096, 65536), (64, 4)])
def test_equals_all_pairs(spark, bucket, group):
    rows = clusters(700, 8, 1)
    rows += [(1000 + i, rows[0][1], 1) for i in range(300)]  # a common vector, anchors among its rows
    assert mined(spark, rows, bucket=bucket, group=group) == brute(rows)


def test_odd_rows(spark):
    rows = clusters(150, 4, 2)
    nan, inf = float("nan"), float("inf")
    rows += [(None, [1.0] * 4, 1), (200, None, 1), (250, [1.0] * 4, None), (300, [1.0, nan, 0.0, 0.0], 1), (350, [inf, 0.0, 0.0, 0.0], 1), (400, [None, 0.0, 0.0, 0.0], 1)]
    rows += [rows[50], rows[50], rows[51]]  # repeated rows, an anchor among them
    rows += [(50, [0.5] * 4, 0), (450, [], 1), (451, [], 1), (452, [], 2), (500, [0.0] * 4, 1), (501, [0.0] * 4, 2)]
    rows += [(550, [2.0, 1.0], 0), (551, [2.0, 1.5], 0), (552, [1.5, 1.0], 1)]  # another dimension
    assert mined(spark, rows, bucket=32) == brute(rows)


def test_large_numbers_stay_exact(spark):
    rows = [(50 * i, [float(2**k), float(3 * i), 1.0], i % 2) for i, k in enumerate([3, 9, 20, 21, 22, 23, 40, 41, 60, 61])]
    rows += [(50 * i + 1, [float(2**k), float(i), -1.0], 1 - i % 2) for i, k in enumerate([3, 9, 20, 21, 22, 23, 40, 41, 60, 61])]
    assert mined(spark, rows) == brute(rows)


def test_no_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []  # no anchor
    assert mined(spark, [(50, [1.0], 1), (2, [1.0], 2)]) == []  # no positive


def test_coordinates_prune_and_keep_all():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 6))
    x = (centres[rng.integers(0, 30, 2000)] + rng.normal(size=(2000, 6)) * 0.05) * 256
    import pyarrow as pa

    q = [hardneg._pack(v.astype(np.int64)) for v in x]
    table = pa.table({"label": np.zeros(2000, np.int64), "q": pa.array(q, pa.binary()), "ids": pa.array([[i] for i in range(2000)], pa.list_(pa.int64()))})
    bucket = hardneg.Bucket(hardneg._frame({c: table.column(c) for c in table.column_names}), 6)
    pruned = 0
    for i in range(0, 2000, 100):
        cosines = bucket.unit @ bucket.unit[i]
        for least in (0.6, 0.9, 0.99):
            focus = np.argsort(-np.abs(bucket.unit[i]))[: hardneg.FOCUS]
            rows = hardneg.candidates(bucket.unit[i], focus, least, bucket)
            if rows is not None:
                pruned += 1
                assert set(np.flatnonzero(cosines >= least).tolist()) <= set(rows.tolist())
                assert len(rows) < 2000
    assert pruned > 20
