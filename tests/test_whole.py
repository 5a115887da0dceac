"""Operators against brute force: nothing of the whole job is left out."""

import numpy as np
import pytest

from waymark import catalogue, plans

SF = "/root/testdata/sf0.001"


def test_every_trip_is_compared(spark):
    points = plans.run("placed", spark, SF).toPandas().sort_values(["uid", "seg", "i"])
    trips = {k: g[["x", "y", "t"]].to_numpy() for k, g in points.groupby(["uid", "seg"])}
    asked = sorted(trips)[::100]
    want = {}
    for q in asked:
        for o in trips.keys() - {q}:
            a, b = trips[q], trips[o]
            n = min(len(a), len(b))
            i, j = (np.linspace(0, len(x) - 1, n).astype(int) for x in (a, b))
            m = np.hypot(*(a[:, None, :2] - b[None, :, :2]).transpose(2, 0, 1))
            h = np.abs(a[:, None, 2] - b[None, :, 2])
            want[(*q, *o)] = m[i, j].mean(), (m.min(1).mean() + m.min(0).mean()) / 2, h[i, j].mean(), m
    assert len({k[2] for k in want}) > 1 and len(want) == len(asked) * (len(trips) - 1)
    got = {n: {(r["u1"], r["s1"], r["u2"], r["s2"]): r for r in catalogue.queries()[n](spark, SF).collect()} for n in ("tp_distance", "dita_distance", "cyclic_time_cost", "blended_truth", "sequence_costs")}
    scale = lambda x: np.clip((x - x.min()) / (np.percentile(x, 99) - x.min()), 0, 1)
    keys = sorted(want)
    blend = 0.5 * scale(np.array([want[k][0] for k in keys])) + 0.5 * scale(np.array([want[k][2] for k in keys]))
    for k, w in zip(keys, blend):
        tp, dita, hours, m = want[k]
        assert np.allclose([got["tp_distance"][k]["cost"], got["dita_distance"][k]["cost"]], [tp, dita], atol=1e-3)
        assert np.isclose(got["cyclic_time_cost"][k]["absolute"], hours) and np.isclose(got["blended_truth"][k]["cost"], w, atol=1e-5)
        lcs, erp = np.zeros((len(m) + 1, len(m[0]) + 1)), np.add.outer(np.arange(len(m) + 1), np.arange(len(m[0]) + 1)) * m.mean()
        for i in range(len(m)):
            for j in range(len(m[0])):
                lcs[i + 1, j + 1] = lcs[i, j] + 1 if m[i, j] <= 200 else max(lcs[i, j + 1], lcs[i + 1, j])
                erp[i + 1, j + 1] = min(erp[i, j] + m[i, j], erp[i, j + 1] + m.mean(), erp[i + 1, j] + m.mean())
        row = got["sequence_costs"][k]
        assert np.allclose([row["lcrs"], row["neterp"]], [1 - lcs[-1, -1] / min(m.shape), erp[-1, -1] / sum(m.shape)], atol=1e-3)
    assert all(len(x) == len(want) for x in got.values())


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_every_fix_is_in_a_window(spark, size):
    sf = f"/root/testdata/{size}"
    windows = plans.run("trip_windows", spark, sf).toPandas()
    held = {(u, s, i) for u, s, a, n in zip(windows["uid"], windows["seg"], windows["start_i"], windows["n"]) for i in range(a, a + n)}
    trips = plans.run("trips", spark, sf).select("uid", "seg", "i").toPandas()
    assert held == {*zip(trips["uid"], trips["seg"], trips["i"])}
    assert windows["n"].between(5, 6).all() and not windows.duplicated(["uid", "seg", "start_i"]).any()


def test_paths_of_any_length(spark):
    from waymark.operators import sequential

    chain = [(k, k + 1, 1.0) for k in range(70)] + [(100, 101, 3.0)]
    edges = spark.createDataFrame(chain + [(b, a, w) for a, b, w in chain], "src long, dst long, w double")
    got = {r["dst"]: r["cost"] for r in sequential.shortest_paths(edges, spark.createDataFrame([(0,)], "id long")).collect()}
    assert got == {k: float(k) for k in range(71)} | {100: 140.0, 101: 140.0}
    capped = sequential.shortest_paths(edges.where("src > 60"), spark.createDataFrame([(70,)], "id long"), cap=15.0).where("dst = 100").first()
    assert capped["cost"] == 15.0
    with pytest.raises(ValueError):
        sequential.shortest_paths(edges, spark.createDataFrame([(0,)], "id long"), rounds=3)


def test_network_costs_of_trips(spark):
    e = plans.run("induced_edges", spark, SF).toPandas()
    n = plans.run("network_vertices", spark, SF).count()
    d = np.where(np.eye(n, dtype=bool), 0.0, np.inf)
    d[e["src"], e["dst"]] = e["w"]
    for k in range(n):
        d = np.minimum(d, d[:, k, None] + d[k])
    d[np.isinf(d)] = 2 * d[np.isfinite(d)].max()
    paths = catalogue.queries()["network_paths"](spark, SF).toPandas()
    assert len(paths) == n * n and np.allclose(paths["cost"], d[paths["src"], paths["dst"]])
    trips = {k: g.sort_values("i")["id"].to_numpy() for k, g in plans.run("passed", spark, SF).toPandas().groupby(["uid", "seg"])}
    rows = catalogue.queries()["network_trip_costs"](spark, SF).collect()
    assert len(rows) == len(sorted(trips)[::100]) * (len(trips) - 1)
    for r in rows:
        m = d[np.ix_(trips[r["u1"], r["s1"]], trips[r["u2"], r["s2"]])]
        k = min(m.shape)
        i, j = (np.linspace(0, x - 1, k).astype(int) for x in m.shape)
        assert np.isclose(r["tp"], m[i, j].mean(), atol=1e-3) and np.isclose(r["dita"], (m.min(1).mean() + m.min(0).mean()) / 2, atol=1e-3)
        gap = m.mean()
        erp = np.add.outer(np.arange(m.shape[0] + 1), np.arange(m.shape[1] + 1)) * gap
        for x in range(m.shape[0]):
            for y in range(m.shape[1]):
                erp[x + 1, y + 1] = min(erp[x, y] + m[x, y], erp[x, y + 1] + gap, erp[x + 1, y] + gap)
        assert np.isclose(r["neterp"], erp[-1, -1] / sum(m.shape), atol=1e-3)


def test_far_fixes_find_a_vertex(spark, tmp_path):
    rows = [(0, k) for k in range(50)] + [(u, 100 + u) for u in range(1, 30)]
    spark.createDataFrame(rows, "user_id long, event_id long").selectExpr("*", "'view' AS event_type", "timestamp_seconds(3600 * event_id) AS ts").write.parquet(str(tmp_path / "events.parquet"))
    fixes = plans.run("centred", spark, str(tmp_path)).toPandas().sort_values("seq")
    v = plans.run("network_vertices", spark, str(tmp_path)).toPandas().sort_values("id")
    dd = (fixes[["x"]].to_numpy() - v["x"].to_numpy()) ** 2 + (fixes[["y"]].to_numpy() - v["y"].to_numpy()) ** 2
    assert np.sqrt(dd.min(1)).max() > 4500 and len(v) > 1
    own = {(a, b): k for k, a, b in zip(v["id"], v["cx"], v["cy"])}
    want = [own.get((int(x // 1000), int(y // 1000)), int(v["id"].iloc[near])) for x, y, near in zip(fixes["x"], fixes["y"], dd.argmin(1))]
    got = {r["seq"]: r["id"] for r in plans.run("snap_nodes", spark, str(tmp_path)).collect()}
    assert [got[s] for s in fixes["seq"]] == want
