"""Settings, layouts, trials, results and the example table."""

import json
import tomllib

import numpy as np
import pytest

from waymark.runs import results, settings
from waymark.sources import example, loaders


def test_settings(tmp_path):
    (tmp_path / "a.toml").write_text('[encoders]\nh = 64\nloc_lam_min_m = 80\n[filters]\ncsv = [1, 2, 3, 4]\n')
    given = settings.read(str(tmp_path / "a.toml"))
    got = settings.checked(given)
    assert got["encoders"]["h"] == 64 and got["encoders"]["loc_lam_min_m"] == 80.0 and settings.KNOWN["encoders"]["h"] == 128
    for bad, hint in (({"encoder": {}}, "encoders"), ({"model": {"hiden": 1}}, "hidden"), ({"model": {"aggregate": "x"}}, "worst"), ({"model": {"hidden": "x"}}, "int"), ({"model": {"hidden": [1]}}, "one value")):
        with pytest.raises(ValueError, match=hint):
            settings.checked(bad)
    assert settings.filters(given, [("geolife", "1,2,3,4"), ("csv", "off")]) == {"geolife": (1.0, 2.0, 3.0, 4.0)}
    for bad in ((3, 2, 1, 4), (1, 2, 3), "a,b"):
        with pytest.raises(ValueError):
            settings.box(bad)
    with settings.scoped(got, encoders__h=32) as s:
        assert s["encoders"]["h"] == 32 and got["encoders"]["h"] == 64
    assert settings.sweeps([1, 2], [], ["5:30"]) == {"translation": [(1.0, 0.0), (2.0, 0.0)], "combined": [(5.0, 30.0)]}
    assert settings.label((5.0, 30.0)) == "5 km 30 deg" and settings.label((0.0, 0.0)) == "in place"
    assert settings.pairs(["a=b", "c=d=e"]) == {"a": "b", "c": "d=e"} and "speed" not in settings.channels("eta")


def test_layout():
    e = settings.KNOWN["encoders"]
    assert settings.layout(128, e) == {"place": 64, "radial": 60, "angular": 4, "total": 128}
    assert settings.layout(128, e | {"loc_dims": 100}) == {"place": 100, "radial": 24, "angular": 4, "total": 128}
    assert settings.layout(64, e | {"loc_dims": 64})["place"] == 32
    for bad in ({"loc_dims": 126}, {"loc_dims": 128}, {"loc_dims": 8, "loc_scales": 2}, {"harmonics": []}):
        with pytest.raises(ValueError):
            settings.layout(128, e | bad)


def test_trials():
    space = {"encoders.h": [64, 100, 128], "encoders.loc_lam_min_m": [60.0, 20000.0], "model.heads": [4, 5]}
    grid = settings.trials(space)
    assert grid == [{"encoders.h": h, "encoders.loc_lam_min_m": 60.0, "model.heads": 4} for h in (64, 128)]
    some = settings.trials({"encoders.h": [8 * k for k in range(4, 20)]}, method="random", most=5)
    assert len(some) == 5 and some == settings.trials({"encoders.h": [8 * k for k in range(4, 20)]}, method="random", most=5)


def test_results(spark, tmp_path):
    run = results.record("audit", {"seed": np.int64(3), "names": {"b", "a"}})
    results.save({"x": np.array([1.0, np.nan])}, str(tmp_path / "out" / "r.json"), run, settings.KNOWN)
    got = json.loads((tmp_path / "out" / "r.json").read_text())
    assert got["x"] == [1.0, None] and got["_run"]["options"] == {"seed": 3, "names": ["a", "b"]}
    assert tomllib.loads((tmp_path / "out" / "r.toml").read_text()) == settings.KNOWN and not tomllib.loads(results.template())["model"]
    assert tomllib.loads(results.toml({"a b": 'x"y\n', "s": {"t": True, "f": [1.5, 2], "n": None}})) == {"a b": 'x"y\n', "s": {"t": True, "f": [1.5, 2]}}


def test_trial_log(spark, tmp_path):
    log = str(tmp_path / "log")
    params = [settings.signature(p) for p in settings.trials({"encoders.h": [64, 128, 256]})]
    wanted = spark.createDataFrame([("s", p) for p in params], "signature string, params string")
    assert results.unfinished(spark, wanted, log).count() == 3
    results.append_trials(spark.createDataFrame([("s", params[0], 0.5), ("s", params[1], 0.9)], "signature string, params string, value double"), log)
    assert [r["params"] for r in results.unfinished(spark, wanted, log).collect()] == [params[2]]
    done = spark.read.parquet(log)
    assert results.best(done, settings.KNOWN, str(tmp_path / "b.toml"))["encoders"]["h"] == 128 and tomllib.loads((tmp_path / "b.toml").read_text())["encoders"]["h"] == 128
    table = {r["rank"]: r for r in results.search_table(done, ["encoders.h", "model.heads"], {"model.heads": 4}).collect()}
    assert table[1]["encoders.h"] == "128" and table[2]["model.heads"] == "4"
    assert {(r["at"], r["mean"], r["n"]) for r in results.marginals(done, ["encoders.h"]).collect()} == {("64", 0.5, 1), ("128", 0.9, 1)}
    rows = spark.createDataFrame([("f", "d", "t", "b", "m", "x", s, v) for s, v in ((0, 1.0), (1, 3.0), (2, float("nan")))], "family string, dataset string, task string, backbone string, metric string, method string, seed int, value double")
    assert results.over_seeds(rows, "method").first()["mean"] == 2.0
    results.overview(rows, str(tmp_path / "o"))
    assert spark.read.option("header", True).csv(str(tmp_path / "o")).count() == 3


def test_example_table(spark, tmp_path):
    example.write(spark, str(tmp_path / "c"), users=2, days=2)
    fixes = loaders.commute_csv(spark, str(tmp_path / "c"))
    assert 8 * 40 <= fixes.count() <= 8 * 90 and fixes.select("trip").distinct().count() == 8
    trips = loaders.trips(fixes, loaders.GAPS_H["csv"], 20, 60, 20)
    assert trips.select("trip").distinct().count() == 8
    assert loaders.commute_csv(spark, str(tmp_path / "c"), min_quality=6).count() == 0


def test_commands(spark, tmp_path, capsys, monkeypatch):
    from waymark import __main__ as cli
    from waymark import catalogue
    from waymark.runs import commands

    sf, out = "/root/testdata/sf0.001", str(tmp_path / "out")
    known = catalogue.queries()
    assert all(q in known for names in commands.COMMANDS.values() for q in names)
    monkeypatch.setitem(commands.COMMANDS, "tokens", ("lattice_period", "no_such_query"))
    assert commands.run_all(spark, sf, out, ("tokens", "compare")) == {"tokens": "failed: no_such_query", "compare": "done"}
    got = json.loads((tmp_path / "out" / "tokens.json").read_text())
    assert len(got["lattice_period"]) == 5 and "KeyError" in got["_run"]["failed"]["no_such_query"]
    assert cli.main(["tidy", "--out", out, "--csv", str(tmp_path / "t.csv")]) == 0 and (tmp_path / "t.csv").read_text().count("lattice_period") == 15
    assert commands.latex(out, "tokens", "lattice_period").count(r"\\") == 6
    cli.main(["query", "hour_histogram", "--data", sf, "--out", str(tmp_path / "q"), "--format", "csv"], spark)
    assert spark.read.option("header", True).csv(str(tmp_path / "q")).count() == known["hour_histogram"](spark, sf).count()
    cli.main(["list"])
    assert "command audit" in capsys.readouterr().out
    with pytest.raises(ValueError, match="audit"):
        commands.run(spark, "audt", sf, out)
