"""Functions on DataFrames, fits and loaders against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.operators import fits, segments
from waymark.sources import loaders


def fixes(spark, trips):
    """trips: {uid: list of hours}"""
    return spark.createDataFrame([(u, float(h), 116.0 + k / 1000, 40.0) for u, hs in trips.items() for k, h in enumerate(hs)], "uid string, t double, lon double, lat double")


def test_gaps_and_windows(spark):
    hours = {"a": [k / 60 for k in range(450)], "b": [k / 60 for k in range(19)], "c": [k / 60 for k in range(20)], "d": [0, 0.5, 1.0, 1.0 + 0.5, 2.1, *[2.2 + k / 60 for k in range(30)]], "e": [k / 60 for k in range(201)]}
    cut = segments.cut(fixes(spark, hours), 0.5)
    d = [r["seg"] for r in cut.where("uid = 'd'").orderBy("t").collect()]
    assert d[:5] == [0, 0, 0, 0, 1] and set(d[5:]) == {1}  # a gap of exactly the bound cuts nothing
    spans = segments.spans_of(segments.windows(cut, 20, 200, 100)).collect()
    by = {}
    for r in spans:
        by.setdefault(r["uid"], []).append((r["start"], r["n"]))
    assert sorted(by["a"]) == [(0, 200), (100, 200), (200, 200), (300, 150), (400, 50)]
    assert "b" not in by and by["c"] == [(0, 20)] and sorted(by["e"]) == [(0, 200), (100, 101)]


@pytest.mark.parametrize(("lo", "hi", "over"), [(5, 6, 2), (3, 10, 0), (20, 30, 1)])
def test_no_fix_is_lost(spark, lo, hi, over):
    rng = random.Random(1)
    trips = {f"u{k}": [j / 60 for j in range(rng.randrange(1, 90))] for k in range(40)}
    rows = segments.windows(segments.cut(fixes(spark, trips), 1.0), lo, hi, over).collect()
    seen = {(r["uid"], r["start"] + r["i"]) for r in rows}
    assert seen == {(u, j) for u, hs in trips.items() if len(hs) >= lo for j in range(len(hs))}
    sizes = {}
    for r in rows:
        sizes[r["uid"], r["start"]] = sizes.get((r["uid"], r["start"]), 0) + 1
    assert all(lo <= n <= hi for n in sizes.values()) and len(rows) == sum(sizes.values())


def test_speed_quota_box_and_labels(spark):
    df = spark.createDataFrame([("a", k / 60, 116.0 + (1.0 if k >= 5 else 0.0) + k * 1e-4, 40.0) for k in range(10)], "uid string, t double, lon double, lat double")
    assert segments.cut(df, 1.0, 250.0).select("seg").distinct().count() == 2 and segments.cut(df, 1.0).select("seg").distinct().count() == 1
    assert segments.within(segments.cut(df, 1.0, 250.0), (115.9, 39, 116.5, 41)).count() == 5 and segments.within(df, (115.9, 39, 116.5, 41), 0.5).count() == 10
    twice = df.union(df.withColumn("lon", F.col("lon") + 1))
    assert segments.one_of_an_instant(twice).count() == 10
    spans = spark.createDataFrame([("a", k, 5, float(k), k + 1.0) for k in range(6)] + [("b", 0, 5, 0.0, 1.0)], "uid string, seg long, n long, t0 double, t1 double")
    assert {r["uid"]: r["n"] for r in segments.even_quota(spans, 4).groupBy("uid").agg(F.count("*").alias("n")).collect()} == {"a": 2, "b": 1}
    labels = spark.createDataFrame([("a", 0.0, 0.4, "walk", 1), ("a", 0.3, 1.0, "bus", 2), ("a", 1.0, 1.6, "car", 3), ("a", 1.0, 1.6, "rail", 4), ("a", 2.0, 2.5, "bike", 5)], "uid string, t0 double, t1 double, mode string, ord long")
    got = {(r["uid"], r["seg"]): r["mode"] for r in segments.labelled(spans, labels).collect()}
    assert got == {("a", 0): "bus", ("a", 1): "car", ("a", 2): None, ("a", 3): None, ("a", 4): None, ("a", 5): None, ("b", 0): None}


def test_loaded_trips_carry_labels(spark, tmp_path):
    d = tmp_path / "g" / "007" / "Trajectory"
    d.mkdir(parents=True)
    lines = [f"39.9,{116.3 + k / 1e4},0,492,{39744 + k / 1440},2008-10-23,06:00:00" for k in range(50)]
    (d / "a.plt").write_text("x\n" * 6 + "\n".join(lines) + "\n")
    (tmp_path / "g" / "007" / "labels.txt").write_text("Start Time\tEnd Time\tTransportation Mode\n2008/10/23 00:00:00\t2008/10/23 00:55:00\trailway\n")
    rows = loaders.trips(loaders.geolife(spark, str(tmp_path / "g")).select("uid", "t", "lon", "lat"), loaders.GAPS_H["geolife"], 20, 30, 10, max_trips=2, labels=loaders.geolife_labels(spark, str(tmp_path / "g")))
    assert {r["mode"] for r in rows.select("mode").distinct().collect()} == {"rail"} and rows.select("start").distinct().count() == 2
    assert loaders.MODES["motorcycle"] == "other"
    (tmp_path / "c.csv").write_text("lat,lng,datetime,user\n" + "".join(f"40,{116 + k / 1e4},2020-01-01 00:{k:02}:00,u\n" for k in range(30)))
    df, skipped = loaders.load_available(spark, {"geolife": str(tmp_path / "g"), "csv": str(tmp_path / "c.csv"), "ais": str(tmp_path / "none")}, required=2)
    assert {r["dataset"] for r in df.select("dataset").distinct().collect()} == {"geolife", "csv"} and list(skipped) == ["ais"]
    with pytest.raises(ValueError):
        loaders.load_available(spark, {"ais": str(tmp_path / "none")})


def test_kmeans(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.1, (30, 2)) for c in ((0, 0), (5, 5), (0, 9))])
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, e array<double>")
    first = np.array([r["e"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(3).collect()])
    for _ in range(40):
        at = ((x[:, None] - first[None]) ** 2).sum(2).argmin(1)
        first = np.array([x[at == k].mean(0) if (at == k).any() else first[k] for k in range(3)])
    assert np.allclose(fits.kmeans(rows, "e", "id", 3), first)


def test_ridge_and_orthogonal_map(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    y = x @ [1.0, -2.0, 0.5] + rng.normal(0, 0.3, 300)
    rows = spark.createDataFrame([(k, *map(float, v), float(t)) for k, (v, t) in enumerate(zip(x, y))], "id long, a double, b double, c double, y double")
    got = fits.ridge_r2(rows, ["a", "b", "c"], "y", F.col("id") < 200)
    tr, te = x[:200], x[200:]
    mu, sd = tr.mean(0), tr.std(0) + 1e-9
    z = lambda v: np.c_[(v - mu) / sd, np.ones(len(v))]
    t = (y - y[:200].mean()) / (y[:200].std() + 1e-9)
    w = np.linalg.solve(z(tr).T @ z(tr) + np.eye(4), z(tr).T @ t[:200])
    want = 1 - ((t[200:] - z(te) @ w) ** 2).sum() / ((t[200:] - t[200:].mean()) ** 2).sum()
    assert math.isclose(got, want, abs_tol=1e-6) and fits.ridge_r2(rows.withColumn("y", F.lit(3.0)), ["a"], "y", F.col("id") < 200) is None
    s, c = math.sin(0.7), math.cos(0.7)
    src, dst = [F.col("a"), F.col("b")], [c * F.col("a") - s * F.col("b"), s * F.col("a") + c * F.col("b")]
    by = fits.orthogonal_map(rows, src, dst)
    assert np.allclose(by, [[c, -s], [s, c]]) and fits.map_error(rows, src, dst, by) < 1e-9


def test_warp(spark):
    rng = np.random.default_rng(2)
    p = np.concatenate([rng.normal(0, 300, (800, 2)), rng.normal(2000, 1500, (400, 2))])
    rows = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(p)], "id long, x double, y double")
    w = fits.Warp.fitted(rows)
    assert all((np.diff(f) > 0).all() for f in w.phases)
    got = {r["id"]: r["e"] for r in w.encode(rows, "id").collect()}
    for k in (0, 500, 1100):
        a = [2 * math.pi * np.interp(v, g, f) for v, g, f in zip(p[k], w.grids, w.phases)]
        assert np.allclose(got[k], [math.sin(a[0]), math.cos(a[0]), math.sin(a[1]), math.cos(a[1])])
    curve = w.gauge_defect(rows, "id", [(v, 0.0) for v in (20.0, 40.0, 80.0)])
    assert curve[0][1] < curve[-1][1] and 1.2 < fits.loglog_slope(curve) < 2.6


def test_t_tail_and_paired_tests(spark):
    for t, df, p in ((2.0, 10, 0.073388), (0.0, 5, 1.0), (12.7062, 1, 0.05), (-3.5, 30, 0.0014768)):
        assert math.isclose(fits.t_tail(t, df), p, abs_tol=2e-6)
    rows = [("ours", b, 1.0 + b % 3) for b in range(9)] + [("x", b, 0.5 + b % 3 + 0.1 * (b % 2)) for b in range(9)] + [("y", b, 1.0 + (b + 1) % 3) for b in range(9)]
    got = {r["method"]: r for r in fits.paired_tests(spark.createDataFrame(rows, "m string, b long, v double"), "m", "b", "v", "ours").collect()}
    assert got["x"]["p"] < 1e-6 < 0.9 < got["y"]["p"] and math.isclose(got["x"]["p_holm"], min(1, 2 * got["x"]["p"])) and got["y"]["p_holm"] == got["y"]["p"]


def test_codes_as_arrays(spark):
    rows = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 4.0)], "k long, v double").withColumn("e", segments.code(F.col("v"), [2.0, 8.0]))
    got = rows.where("v = 1.0").first()["e"]
    assert np.allclose(got, [math.sin(math.pi), math.cos(math.pi), math.sin(math.pi / 4), math.cos(math.pi / 4)])
    pooled = {r["k"]: r["e"] for r in segments.pooled(rows, ["k"], "e", 4).collect()}
    e = np.array([r["e"] for r in rows.where("k = 1").collect()])
    assert np.allclose(pooled[1], [*e.mean(0), *e.std(0)])
    steps = segments.steps(segments.local(spark.createDataFrame([(1, i, 116.0 + i / 1000, 40.0, i / 60) for i in range(3)], "k long, i long, lon double, lat double, t double"), ["k"]), ["k"])
    assert steps.where("r is null").count() == 1 and all(85 < r["r"] < 86 for r in steps.where("r is not null").collect())
