"""Operators whose recurrence is sequential within a trip or a pair: Arrow-based grouped functions.

Each group is one trip, one pair of trips or one source vertex, so what a task gathers is bounded by a trip's
points; everything before and after is a declarative plan.
"""

from __future__ import annotations

import re
import tempfile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAY_RADIUS_M, STAY_MIN = 100.0, 3


def stay_points(points: DataFrame, radius_m: float = STAY_RADIUS_M, least: int = STAY_MIN) -> DataFrame:
    """uid, seg, stays: greedy runs of points within radius of their first point."""

    def run(key, p: pd.DataFrame) -> pd.DataFrame:
        xy = p.sort_values("i")[["x", "y"]].to_numpy()
        stays = begin = 0
        for k in range(1, len(xy) + 1):
            if k == len(xy) or np.hypot(*(xy[k] - xy[begin])) >= radius_m:
                stays += k - begin >= least
                begin = k
        return pd.DataFrame({"uid": [key[0]], "seg": [key[1]], "stays": [stays]})

    return points.select("uid", "seg", "i", "x", "y").groupBy("uid", "seg").applyInPandas(run, "uid long, seg long, stays long")


def _recurrences(m: np.ndarray, hit_m: float, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """LCS lengths and edit distances of a stack of equal-shaped grids, one step of both recurrences for all grids at once."""
    n, a, b = m.shape
    lcs, erp = np.zeros((n, b + 1)), np.arange(b + 1) * gap[:, None]
    for i in range(a):
        up, old = lcs.copy(), erp.copy()
        erp[:, 0] = (i + 1) * gap
        for j in range(b):
            lcs[:, j + 1] = np.where(m[:, i, j] <= hit_m, up[:, j] + 1, np.maximum(up[:, j + 1], lcs[:, j]))
            erp[:, j + 1] = np.minimum(np.minimum(old[:, j] + m[:, i, j], old[:, j + 1] + gap), erp[:, j] + gap)
    return lcs[:, b], erp[:, b]


def _alignments(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mean cost of index-aligned points, and half the sum of the mean row and column minima, of a stack of grids."""
    n = min(m.shape[1:])
    i, j = (np.linspace(0, k - 1, n).astype(int) for k in m.shape[1:])
    return m[:, i, j].mean(1), (m.min(2).mean(1) + m.min(1).mean(1)) / 2


def sequence_costs(pairs: DataFrame, hit_m: float = 200.0, gap_m: float | None = None, aligned: bool = False) -> DataFrame:
    """The keys of each pair, lcrs, neterp of its grid of point costs: 1 - LCS / min length, and edit distance with real penalties (the mean cost without gap_m); with `aligned` also tp and dita."""
    names = ["lcrs", "neterp", *["tp", "dita"][: 2 * aligned]]
    keys = [x for x in pairs.columns if x not in ("i", "j", "c")]

    def run(batches):
        for r in batches:
            a, b, g = r.column("a").to_numpy(), r.column("b").to_numpy(), r.column("g")
            values, start = g.values.to_numpy(), g.offsets.to_numpy()[:-1]
            out = np.empty((len(names), len(a)))
            for x, y in {*zip(a.tolist(), b.tolist())}:
                at = np.flatnonzero((a == x) & (b == y))
                m = values[start[at][:, None] + np.arange(x * y)].reshape(-1, x, y)
                lcs, erp = _recurrences(m, hit_m, np.full(len(at), gap_m) if gap_m is not None else m.mean((1, 2)))
                out[:2, at] = np.round(1 - lcs / min(x, y), 6), np.round(erp / (x + y), 4)
                if aligned:
                    out[2:, at] = np.round(_alignments(m), 4)
            yield pa.RecordBatch.from_arrays([*(r.column(k) for k in keys), *map(pa.array, out)], names=[*keys, *names])

    grids = pairs.groupBy(*keys).agg((F.max("i") + 1).cast("long").alias("a"), (F.max("j") + 1).cast("long").alias("b"), F.expr("transform(array_sort(collect_list(struct(i, j, c))), x -> x.c)").alias("g"))
    return grids.mapInArrow(run, ", ".join([f"{k} long" for k in keys] + [f"{x} double" for x in names]))


def _cut(df: DataFrame) -> DataFrame:
    """df checkpointed; where no folder is set, in one of this machine in local mode, and an error on a cluster."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not found and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="waymark-"))
    return df.checkpoint()


def shortest_paths(edges: DataFrame, sources: DataFrame, rounds: int | None = None, cap: float = float("inf")) -> DataFrame:
    """src, dst, cost from each source to every vertex: rounds of min-plus joins on the costs that fell in the round before, until none falls.

    A vertex out of reach costs the lesser of cap and twice the largest finite cost. Without `rounds` the bound is the
    number of vertices, which only a negative cycle passes; at the bound it raises.
    """
    e = _cut(edges.select(F.col("src").alias("dst"), F.col("dst").alias("next"), "w"))
    ids = _cut(e.select("dst").union(e.select("next")).union(sources.select("id")).distinct())
    rounds = ids.count() if rounds is None else rounds
    best = fell = _cut(sources.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("cost"), F.lit(0).alias("round")))
    for n in range(1, rounds + 2):
        step = fell.join(e, "dst").select("src", F.col("next").alias("dst"), (F.col("cost") + F.col("w")).alias("cost"), F.lit(n).alias("round"))
        best = _cut(best.unionByName(step).groupBy("src", "dst").agg(F.min(F.struct("cost", "round")).alias("m")).select("src", "dst", "m.cost", "m.round"))
        fell = best.where(F.col("round") == n)
        if fell.isEmpty():
            break
    else:
        raise ValueError(f"costs still fall after {rounds} rounds")
    most = best.agg(F.least(F.max("cost") * 2, F.lit(cap)).alias("fill"))
    every = sources.select(F.col("id").alias("src")).distinct().crossJoin(ids)
    return every.join(best.drop("round"), ["src", "dst"], "left").crossJoin(F.broadcast(most)).select("src", "dst", F.coalesce("cost", "fill").alias("cost"))


def synthetic(spark: SparkSession, n: int = 200, n_steps: int = 40, seed: int = 7, step_m: float = 180.0, bias: float = 0.35) -> DataFrame:
    """Hub-biased walks on a turned grid; each trip's numbers follow from its own seed."""

    def run(frames):
        hubs = np.random.default_rng(seed).normal(0, 4000, (6, 2))
        for f in frames:
            for trip in f["id"]:
                rng = np.random.default_rng([seed, int(trip)])
                at, goal = hubs[rng.integers(6)].copy(), hubs[rng.integers(6)]
                psi, out = rng.uniform(-np.pi, np.pi), []
                for k in range(n_steps):
                    out.append((trip, k, k / 60, *at))
                    to = np.arctan2(*(goal - at)[::-1])
                    psi += bias * np.angle(np.exp(1j * (to - psi))) + rng.normal(0, 0.3)
                    turned = np.round((psi - np.radians(20)) / (np.pi / 2)) * np.pi / 2 + np.radians(20)
                    at = at + step_m * np.array([np.cos(turned), np.sin(turned)]) + rng.normal(0, 8, 2)
                yield pd.DataFrame(out, columns=["traj_id", "i", "t", "x", "y"])

    return spark.range(n).mapInPandas(run, "traj_id long, i long, t double, x double, y double")


def geometric_median(points: DataFrame, rounds: int = 1000, tol_m: float = 1e-5) -> tuple[float, float]:
    """Weiszfeld's iteration; each round is one aggregation, only two numbers come back. Where the rounds don't suffice it raises."""
    p = points.select("x", "y").persist()
    x, y = p.agg(F.avg("x"), F.avg("y")).first()
    for _ in range(rounds):
        d = F.greatest(F.hypot(F.col("x") - x, F.col("y") - y), F.lit(1e-6))
        sx, sy, s = p.agg(F.sum(F.col("x") / d), F.sum(F.col("y") / d), F.sum(1 / d)).first()
        moved = abs(sx / s - x) + abs(sy / s - y)
        x, y = sx / s, sy / s
        if moved < tol_m:
            p.unpersist()
            return x, y
    raise ValueError(f"the median still moves by {moved} m after {rounds} rounds")
