"""Ladders, loaders and sequential operators on small inputs."""

import math

import pytest

from waymark.functions.ladders import gpe_frequencies
from waymark.operators import sequential
from waymark.sources import loaders
from waymark.streaming import sessions


@pytest.mark.parametrize(("h", "top"), [(32, 128), (64, 32768), (128, 1048576), (256, 5764801)])
def test_ladder(h, top):
    assert max(gpe_frequencies(h)) == top and len(gpe_frequencies(h)) == h // 4


def test_schema_inference():
    assert loaders.infer_schema(["Lat", "LNG", "datetime", "user"]) == {"lat": "Lat", "lon": "LNG", "time": "datetime", "uid": "user"}
    with pytest.raises(ValueError):
        loaders.infer_schema(["a", "b"])


def test_porto(spark, tmp_path):
    line = lambda n: "[" + ",".join(f"[{-8.6 + k / 1000},{41.1}]" for k in range(n)) + "]"
    (tmp_path / "p.csv").write_text("TAXI_ID,TIMESTAMP,POLYLINE\n" + "".join(f'{i},3600,"{line(n)}"\n' for i, n in enumerate((0, 19, 20, 201))))
    got = {r["uid"]: r["n"] for r in loaders.porto(spark, str(tmp_path / "p.csv")).groupBy("uid").count().withColumnRenamed("count", "n").collect()}
    assert got == {"2": 20, "3": 200}


def test_roma_and_tdrive(spark, tmp_path):
    (tmp_path / "r.csv").write_text("7;2014-02-01 00:00:00.739166+01;POINT(41.88 12.48)\n8;bad;POINT(x y)\n")
    (row,) = loaders.roma(spark, str(tmp_path / "r.csv")).collect()
    assert (row["uid"], row["lon"], row["lat"]) == ("7", 12.48, 41.88)
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "42.txt").write_text("42,2008-02-02 15:36:08,116.5,39.9\n42,oops,1,2\n")
    (row,) = loaders.tdrive(spark, str(tmp_path / "t")).collect()
    assert row["uid"] == "42" and math.isclose(row["t"] % 24, 15 + 36 / 60 + 8 / 3600, abs_tol=1e-6)


def test_geolife_and_csv(spark, tmp_path):
    d = tmp_path / "g" / "003" / "Trajectory"
    d.mkdir(parents=True)
    (d / "a.plt").write_text("Geolife trajectory\nWGS 84\nAltitude\nReserved\n0,2,255\n0\n39.9,116.3,0,492,39744.25,2008-10-23,06:00:00\n")
    (row,) = loaders.geolife(spark, str(tmp_path / "g")).collect()
    assert row["uid"] == "003" and row["t"] % 24 == 14
    (tmp_path / "c.csv").write_text("lat,lng,datetime,user,QUALITY\n1,2,2020-01-01 00:00:00,u,5\n1,2,2020-01-01 00:00:00,u,5\n,2,2020-01-01 00:00:01,u,5\n")
    assert loaders.load(spark, "csv", str(tmp_path / "c.csv")).count() == 1


def test_stays_and_costs(spark):
    pts = spark.createDataFrame([(1, 1, i, float(x), 0.0) for i, x in enumerate([0, 10, 20, 500, 510, 520, 900])], "uid long, seg long, i long, x double, y double")
    assert sequential.stay_points(pts).first()["stays"] == 2
    grid = spark.createDataFrame([(1, 0, 1, i, j, 0.0 if i == j else 900.0) for i in range(3) for j in range(3)], "uid long, s1 long, s2 long, i long, j long, c double")
    row = sequential.sequence_costs(grid).first()
    assert (row["lcrs"], row["neterp"]) == (0.0, 0.0)
    assert sequential.sequence_costs(grid.where("i < 2"), gap_m=500.0).first()["neterp"] == 100.0


def test_shortest_paths(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 5.0)], "src long, dst long, w double")
    got = {(r["src"], r["dst"]): r["cost"] for r in sequential.shortest_paths(edges, spark.createDataFrame([(0,)], "id long")).collect()}
    assert got == {(0, 0): 0.0, (0, 1): 1.0, (0, 2): 2.0}


def test_streamed_sessions(spark, tmp_path):
    rows = [(1, h) for h in (0, 1, 20, 21, 60)]
    df = spark.createDataFrame(rows, "uid long, h long").selectExpr("uid", "timestamp_seconds(h * 3600) AS ts")
    df.write.parquet(str(tmp_path / "in"))
    assert sessions.sessions(df).count() == 3
    stream = sessions.sessions(sessions.from_files(spark, str(tmp_path / "in"), "uid long, ts timestamp"))
    got = sessions.run_available(stream, "held", str(tmp_path / "cp"))
    assert {r["n"] for r in got.collect()} == {2}


def test_representations(spark):
    import numpy as np

    from waymark import plans
    from waymark.functions import representations as rho
    from waymark.operators import fits, geo, segments

    assert math.isclose(rho.finest_wavelength_m(128), 38.18, abs_tol=0.01) and math.isclose(rho.finest_wavelength_m(256), 6.94, abs_tol=0.01)
    code = lambda v, w: np.concatenate([[math.sin(v * f), math.cos(v * f)] for f in w])
    torus = lambda x, y: np.concatenate([code(x, [2 * math.pi / s for s in geo.TORUS]), code(y, [2 * math.pi / s for s in geo.TORUS])])
    assert np.allclose(rho.torus_rho(geo.TORUS, 30.0, -70.0) @ torus(12.0, 900.0), torus(42.0, 830.0))
    lon, lat = math.radians(116.0), math.radians(40.0)
    w = gpe_frequencies(64)
    moved = np.concatenate([code(lon + 500 / (plans.EARTH_M * math.cos(lat)), w), code(lat, w)])
    assert np.allclose(rho.gpe_rho(64, 500.0, 0.0, 40.0) @ np.concatenate([code(lon, w), code(lat, w)]), moved, atol=1e-7)
    hour = lambda t: np.concatenate([f(2 * math.pi * np.array(ms) * x / n) for x, n, ms in ((t % 24, 24, (1, 2, 3, 4)), (math.floor(t / 24) % 7, 7, (1, 2, 3))) for f in (np.sin, np.cos)])
    assert np.allclose(rho.hours_rho(48.0) @ hour(100.5), hour(148.5)) and np.allclose((rho.hours_rho(5.0) @ hour(30.0))[:8], hour(35.0)[:8])
    turned = rho.displacement_rho(2, (1, 2), 0.3)
    assert math.isclose(rho.norm(turned), 1.0) and np.allclose(turned @ np.array([7, 8, 0, 1, 0, 1.0]), [7, 8, math.sin(0.3), math.cos(0.3), math.sin(0.6), math.cos(0.6)])
    assert rho.circulant([1, 2, 3]).tolist() == [[1, 3, 2], [2, 1, 3], [3, 2, 1]] and rho.lipschitz([3, 4]) == 5.0
    a, b = rho.random_features(4000, 300.0, 1)
    f = lambda p: math.sqrt(2 / 4000) * np.cos(a @ p + b)
    assert math.isclose(f(np.array([0, 0])) @ f(np.array([200, 100])), math.exp(-(200**2 + 100**2) / (2 * 300**2)), abs_tol=0.06)
    # the map fitted by Spark from codes and shifted codes is the analytic one
    from pyspark.sql import functions as F

    rows = plans.run("points", spark, "/root/testdata/sf0.001")
    at = lambda s: [F.element_at(segments.code(v, geo.TORUS), k + 1) for v in (F.col("x") + s, F.col("y")) for k in range(8)]
    assert fits.map_error(rows, at(0.0), at(100.0), rho.torus_rho(geo.TORUS, 100.0, 0.0)) < 1e-9
    assert np.allclose(fits.orthogonal_map(rows, at(0.0), at(100.0)), rho.torus_rho(geo.TORUS, 100.0, 0.0), atol=1e-6)
