"""Distances of pairs of trips by blocks: the same rows as from a row for each pair of points, of which there is none."""

import re

import numpy as np
import pytest

from waymark import catalogue, plans
from waymark.operators import pairs

SF = "/root/testdata/sf0.001"
BY_PAIR = re.compile(r"(Aggregate\(key=|Aggregate\(keys=|hashpartitioning\()\[?u1|percentile|SortMergeJoin .*(src|dst)")


def unexploded(df):
    """No row for each pair of points, and nothing dealt out by pairs of trips."""
    return not BY_PAIR.search(df._jdf.queryExecution().executedPlan().toString())


@pytest.fixture(scope="module")
def made(spark):
    """Trips of 1 to 40 points, some of the same place, one without a user; every fifth is asked for."""
    rng = np.random.default_rng(4)
    rows = [(None if k == 7 else k // 3, k % 3, *(rng.integers(0, 400, n).astype(float).tolist() for _ in "xyt")) for k, n in enumerate([1, 40, *rng.integers(1, 12, 38).tolist()])]
    trips = spark.createDataFrame(rows, "uid long, seg long, x array<double>, y array<double>, t array<double>")
    return rows, trips


def asked(made):
    return made[1].where("uid is not null and (uid * 3 + seg) % 5 = 0")


def brute(rows, f):
    out = {}
    for u, s, *p in rows:
        if u is None or (u * 3 + s) % 5:
            continue
        for v, r, *q in rows:
            if r != s or v is not None and v != u:
                out[u, s, v, r] = f(np.array(p), np.array(q))
    return out


def grid(p, q):
    return np.hypot(p[0][:, None] - q[0], p[1][:, None] - q[1])


def test_dita(spark, made, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", (5, 60))
    monkeypatch.setattr(pairs, "ASKED", (3, 30))
    want = {k: v for k, v in brute(made[0], lambda p, q: (grid(p, q).min(1).mean() + grid(p, q).min(0).mean()) / 2).items() if k[2] is not None}
    got = {tuple(r)[:4]: r["cost"] for r in pairs.dita_distance(asked(made), made[1]).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in want)
    assert unexploded(catalogue.queries()["dita_distance"](spark, SF))


def recurrence(c, hit):
    """LCS and edit distance by the plain recurrences."""
    a, b = c.shape
    lcs, erp, gap = np.zeros((a + 1, b + 1)), np.zeros((a + 1, b + 1)), c.mean()
    erp[:, 0], erp[0] = np.arange(a + 1) * gap, np.arange(b + 1) * gap
    for i in range(a):
        for j in range(b):
            lcs[i + 1, j + 1] = lcs[i, j] + 1 if c[i, j] <= hit else max(lcs[i, j + 1], lcs[i + 1, j])
            erp[i + 1, j + 1] = min(erp[i, j] + c[i, j], erp[i, j + 1] + gap, erp[i + 1, j] + gap)
    return 1 - lcs[a, b] / min(a, b), erp[a, b] / (a + b)


@pytest.mark.parametrize("held", [1 << 22, 10])
def test_sequence_costs(spark, made, monkeypatch, held):
    monkeypatch.setattr(pairs, "BLOCK", (5, 60))
    monkeypatch.setattr(pairs, "HELD", held)
    want = brute(made[0], lambda p, q: recurrence(grid(p, q), 120.0))
    got = {tuple(r)[:4]: tuple(r)[4:] for r in pairs.sequence_costs(asked(made), made[1], 120.0).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-4) for k in want)
    assert unexploded(catalogue.queries()["sequence_costs"](spark, SF))


@pytest.mark.parametrize("few", [1 << 16, 0])
def test_blended_truth(spark, made, monkeypatch, few):
    """The bounds are the exact order statistics, however many values are left to count one by one."""
    monkeypatch.setattr(pairs, "BLOCK", (5, 60))
    monkeypatch.setattr(pairs, "FEW", few)

    def means(p, q):
        m = min(len(p[0]), len(q[0]))
        i, j = (np.linspace(0, len(z[0]) - 1, m).astype(int) for z in (p, q))
        return np.hypot(p[0][i] - q[0][j], p[1][i] - q[1][j]).mean(), np.abs(p[2][i] - q[2][j]).mean()

    raw = brute(made[0], means)
    scaled = [np.clip((v - v.min()) / (np.percentile(v, 99) - v.min()), 0, 1) for v in np.array(list(raw.values())).T]
    want = dict(zip(raw, (scaled[0] + scaled[1]) / 2))
    got = {tuple(r)[:4]: r["cost"] for r in pairs.blended_truth(asked(made), made[1]).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_blended_truth_is_unexploded(spark):
    assert unexploded(catalogue.queries()["blended_truth"](spark, SF))


def test_network_costs(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", (5, 60))
    monkeypatch.setattr(pairs, "WIDE", 100)
    rng = np.random.default_rng(6)
    table = rng.integers(0, 50, (9, 9)).astype(float)
    rows = [(k // 2, k % 2, rng.integers(0, 9, n).tolist()) for k, n in enumerate(rng.integers(1, 9, 30).tolist())]
    trips = spark.createDataFrame(rows, "uid long, seg long, id array<long>")
    queries = spark.createDataFrame([(*r, table[r[2]].ravel().tolist()) for r in rows[::4]], "uid long, seg long, id array<long>, row array<double>")
    got = {tuple(r)[:4]: tuple(r)[4:] for r in pairs.network_costs(queries, trips).collect()}
    assert len(got) == len(rows[::4]) * (len(rows) - 1)
    for u, s, p in rows[::4]:
        for v, r, q in rows:
            if (u, s) != (v, r):
                c = table[np.ix_(p, q)]
                m = min(c.shape)
                i, j = (np.linspace(0, n - 1, m).astype(int) for n in c.shape)
                assert np.allclose(got[u, s, v, r], (*recurrence(c, 1.0), c[i, j].mean(), (c.min(1).mean() + c.min(0).mean()) / 2), atol=1e-4)
    assert unexploded(catalogue.queries()["network_trip_costs"](spark, SF))
