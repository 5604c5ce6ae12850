"""k-means for all k at once against a plain version."""

import hashlib

import numpy as np
import pytest

from skein.operators.cluster_number import cluster_numbers


def plain(rows, most, rounds):
    """{k: silhouette}, from all pairs of squared distances."""
    first = sorted(rows, key=lambda r: (hashlib.md5(f"43|{r[0]}".encode()).hexdigest(), r[0]))
    x = np.array([v for _, v in rows])
    away = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    out = {}
    for k in range(2, min(most, len(rows) - 1) + 1):
        c = np.array([v for _, v in first[:k]])
        for _ in range(rounds):
            own = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            c = np.array([x[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(k)])
        own = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        scores = []
        for i in range(len(x)):
            same = (own == own[i]) & (np.arange(len(x)) != i)
            others = [away[i, own == j].mean() for j in range(k) if j != own[i] and (own == j).any()]
            if not same.any() or not others:
                scores.append(0.0)
                continue
            a, b = away[i, same].mean(), min(others)
            scores.append((b - a) / max(a, b) if max(a, b) else 0.0)
        out[k] = np.mean(scores)
    return out


def test_all_numbers_equal_a_plain_version(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(4, 5)) * 4
    rows = [(i, (base[i % 4] + rng.normal(0, 0.4, 5)).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    found = cluster_numbers(df, "id", "v", 7, 6).collect()
    want = plain(rows, 7, 6)
    assert {r.k: r.silhouette for r in found} == pytest.approx(want, abs=1e-9)
    best = max(want, key=lambda k: (round(want[k], 12), -k))
    assert [r.k for r in found if r.chosen] == [best]


def test_odd_vectors(spark):
    odd = [(1, [0.0, 0.0]), (2, [0.0, 0.1]), (3, [9.0, 9.0]), (4, None), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (None, [1.0, 1.0]), (7, [])]
    df = spark.createDataFrame(odd, "id long, v array<double>")
    found = cluster_numbers(df, "id", "v").collect()
    assert [(r.k, r.chosen) for r in found] == [(2, True)]
    assert found[0].silhouette == pytest.approx(plain([(i, v) for i, v in odd[:3]], 19, 10)[2])
    assert cluster_numbers(df.limit(2), "id", "v").collect() == [] and cluster_numbers(df.where("false"), "id", "v").collect() == []
    same = spark.createDataFrame([(i, [1.0]) for i in range(5)], "id long, v array<double>")
    assert all(r.silhouette == 0 for r in cluster_numbers(same, "id", "v").collect())
