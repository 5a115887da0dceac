"""Sinks: results with the record of their run, settings as TOML, tidy CSV tables, a log of trials that can be resumed."""

from __future__ import annotations

import datetime
import json
import math
import os
import platform
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import settings as _settings


def plain(x):
    """What JSON has no word for: numpy values, sets, paths, dates; a number that is none is null."""
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set, frozenset)):
        return [plain(v) for v in (sorted(x, key=str) if isinstance(x, (set, frozenset)) else x)]
    if isinstance(x, np.ndarray):
        return plain(x.tolist())
    if isinstance(x, np.generic):
        return plain(x.item())
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    return x if x is None or isinstance(x, (str, int, bool)) else str(x)


def toml(values: dict) -> str:
    """Sections of plain values and lists of them; None is left out."""

    def one(v):
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(map(one, v)) + "]"
        if isinstance(v, float):
            return repr(v) if math.isfinite(v) else {math.inf: "inf", -math.inf: "-inf"}.get(v, "nan")
        return str(v) if isinstance(v, int) else json.dumps(str(v), ensure_ascii=False)

    key = lambda k: k if re.fullmatch(r"[A-Za-z0-9_-]+", k) else json.dumps(k, ensure_ascii=False)
    lines = [f"{key(k)} = {one(v)}" for k, v in values.items() if not isinstance(v, dict) and v is not None]
    for name, section in values.items():
        if isinstance(section, dict):
            lines += ["", f"[{key(name)}]", *(f"{key(k)} = {one(v)}" for k, v in section.items() if v is not None)]
    return "\n".join(lines).strip() + "\n"


def template(known: dict = _settings.KNOWN) -> str:
    """All settings with their values, as comments to be taken up."""
    return "\n".join(x if x.startswith("[") or not x else f"# {x}" for x in toml(known).splitlines()) + "\n"


def record(command: str, options: dict) -> dict:
    """What a run was: command, options, time and versions."""
    import pyspark

    return {"command": command, "options": plain(options), "started": datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds"), "versions": {"python": platform.python_version(), "pyspark": pyspark.__version__, "numpy": np.__version__}}


def save(results: dict, path: str, run: dict, settings: dict | None = None) -> None:
    """results and `_run` as JSON, and beside it the settings as TOML from which the run can be repeated."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w") as f:
        json.dump(plain(results) | {"_run": plain(run)}, f, indent=1)
    if settings is not None:
        with open(re.sub(r"(\.json)?$", ".toml", path, count=1), "w") as f:
            f.write(toml(settings))


def overview(results: DataFrame, path: str) -> None:
    """The long table of results, one row a value, as CSV with a header."""
    results.select("family", "dataset", "task", "backbone", "metric", "method", "seed", "value").write.mode("overwrite").option("header", True).csv(path)


def paired(tests: DataFrame, path: str) -> None:
    tests.orderBy("p_holm", "method").write.mode("overwrite").option("header", True).csv(path)


def append_trials(trials: DataFrame, path: str) -> None:
    """Finished trials (signature, params, value) at the end of the log."""
    trials.select("signature", "params", "value").write.mode("append").parquet(path)


def unfinished(spark: SparkSession, wanted: DataFrame, path: str) -> DataFrame:
    """The wanted trials (signature, params) that the log lacks."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return wanted
    return wanted.join(spark.read.parquet(path).select("signature", "params").distinct(), ["signature", "params"], "left_anti")


def search_table(log: DataFrame, keys: list[str], base: dict, higher: bool = True) -> DataFrame:
    """One row a trial: rank, value and each searched setting, its base value where a trial doesn't set it."""
    value = F.desc("value") if higher else F.asc("value")
    get = [F.coalesce(F.get_json_object("params", f"$['{k}']"), F.lit(str(base.get(k)))).alias(k) for k in keys]
    from pyspark.sql import Window

    return log.select(F.row_number().over(Window.orderBy(value, "params")).alias("rank"), "value", *get)


def best(log: DataFrame, base: dict, path: str, higher: bool = True) -> dict:
    """The settings with the best trial's put in, written as TOML."""
    top = log.orderBy(F.desc("value") if higher else F.asc("value"), "params").first()
    out = {k: dict(v) for k, v in base.items()}
    for name, value in json.loads(top["params"]).items():
        section, key = name.split(".")
        out[section][key] = value
    with open(path, "w") as f:
        f.write(toml(out))
    return out


def marginals(log: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, best and number of trials for each value of each setting."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.get_json_object("params", f"$['{k}']").alias("at")) for k in keys)))
    return log.select(pairs.alias("x"), "value").where("x.at is not null").groupBy("x.key", "x.at").agg(F.avg("value").alias("mean"), F.max("value").alias("best"), F.count(F.lit(1)).alias("n"))


def over_seeds(results: DataFrame, *keys: str) -> DataFrame:
    """Mean, deviation and number of values over seeds; values that are none are left out."""
    return results.where("value is not null and not isnan(value)").groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.count(F.lit(1)).alias("n"))
