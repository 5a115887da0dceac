"""Fits that take rounds or a small solve: k-means, ridge, orthogonal maps, separable warps, paired tests.

Rounds are aggregations; what comes to the driver is moments, centres or histograms of a fixed size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def nearest(column: str, centres: np.ndarray) -> Column:
    """The number of the nearest centre, the lowest at ties."""
    dist = [F.aggregate(F.zip_with(F.col(column), F.array(*map(F.lit, c.tolist())), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda a, x: a + x) for c in centres]
    at = F.array(*dist)
    return (F.array_position(at, F.array_min(at)) - 1).cast("int")


def kmeans(rows: DataFrame, column: str, key: str, k: int, rounds: int = 40) -> np.ndarray:
    """k centres: at first the rows least by a hash of key, then `rounds` rounds of means; an empty cluster keeps its centre."""
    centres = np.array([r[0] for r in rows.select(column).orderBy(F.xxhash64(key), key).limit(k).collect()], float)
    dims = centres.shape[1]
    for _ in range(rounds):
        got = rows.withColumn("_c", nearest(column, centres)).groupBy("_c").agg(F.array(*(F.avg(F.col(column)[j]) for j in range(dims))).alias("m")).collect()
        new = centres.copy()
        for r in got:
            new[r["_c"]] = r["m"]
        if np.allclose(new, centres, rtol=0, atol=1e-12):
            break
        centres = new
    return centres


def _moments(rows: DataFrame, left: list[Column], right: list[Column]) -> np.ndarray:
    """The sums of products of all pairs: each partition sums its own in numpy, and the sums of cells come to the driver."""
    n, m = len(left), len(right)

    def run(batches):
        total = np.zeros((n, m))
        for b in batches:
            x = [b.column(k).to_numpy(zero_copy_only=False).astype(float) for k in range(n + m)]
            total += np.stack(x[:n]) @ np.stack(x[n:]).T
        yield pa.RecordBatch.from_pydict({"cell": pa.array(range(n * m), pa.int32()), "v": pa.array(total.ravel())})

    cols = [c.cast("double").alias(f"c{k}") for k, c in enumerate([*left, *right])]
    out = np.zeros(n * m)
    for r in rows.select(*cols).mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():
        out[r["cell"]] = r["v"]
    return out.reshape(n, m)


def ridge_r2(rows: DataFrame, features: list[str], target: str, train: Column, alpha: float = 1.0, least_cv: float = 1e-3) -> float | None:
    """R squared of a ridge probe on the rows that are not train; features and target by the training part's mean and deviation, the constant is penalised too. None for a target that hardly varies."""
    names = [*features, target]
    rows = rows.select(*names, train.alias("_train"))
    train = F.col("_train")
    stats = rows.agg(*(f(n) for n in names for f in (lambda n: F.avg(F.when(train, F.col(n))), lambda n: F.stddev_pop(F.when(train, F.col(n))))), F.stddev_pop(target), F.avg(F.abs(target))).first()
    if stats[-2] is None or stats[-2] / (stats[-1] + 1e-12) < least_cv:
        return None
    z = [(F.col(n) - stats[2 * i]) / (stats[2 * i + 1] + 1e-9) for i, n in enumerate(names)]
    x, y = [*z[:-1], F.lit(1.0)], z[-1]
    a = _moments(rows.where(train), x, [*x, y])
    w = np.linalg.solve(a[:, :-1] + alpha * np.eye(len(x)), a[:, -1])
    pred = F.aggregate(F.zip_with(F.array(*x), F.array(*(F.lit(float(b)) for b in w)), lambda c, b: c * b), F.lit(0.0), lambda s, v: s + v)
    e = rows.where(~train).agg(F.sum((y - pred) * (y - pred)), F.var_pop(y) * F.count(F.lit(1))).first()
    return 1 - e[0] / (e[1] + 1e-12)


def orthogonal_map(rows: DataFrame, source: list[Column], target: list[Column]) -> np.ndarray:
    """The orthogonal matrix that takes source nearest to target (Procrustes), from their moments."""
    u, _, v = np.linalg.svd(_moments(rows, target, source), full_matrices=False)
    return u @ v


def map_error(rows: DataFrame, source: list[Column], target: list[Column], by: np.ndarray) -> float:
    """The mean distance of target from the mapped source over the latter's root mean square norm."""
    mapped = [sum((c * float(m) for c, m in zip(source, row)), F.lit(0.0)) for row in by]
    gap = sum(((t - m) * (t - m) for t, m in zip(target, mapped)), F.lit(0.0))
    norm = sum((m * m for m in mapped), F.lit(0.0))
    got = rows.agg(F.avg(F.sqrt(gap)), F.sqrt(F.avg(norm))).first()
    return got[0] / (got[1] + 1e-12)


def smoothed(x: np.ndarray, sigma: float) -> np.ndarray:
    """x under a normal kernel, ends repeated."""
    half = int(math.ceil(4 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    return np.convolve(np.pad(x, half, mode="edge"), kernel / kernel.sum(), mode="valid")


class Warp:
    """A coordinate in wavelengths that are short where there are many fixes: a grid and the phase on it, for each axis."""

    def __init__(self, grids: list[np.ndarray], phases: list[np.ndarray]):
        self.grids, self.phases = grids, phases
        self.rates = [np.gradient(p, g) for g, p in zip(grids, phases)]

    @classmethod
    def fitted(cls, rows: DataFrame, least: float = 60.0, most: float = 5000.0, bins: int = 512, sigma: float = 12.0) -> "Warp":
        """From x and y of all rows; two histograms of `bins` come to the driver."""
        grids, phases = [], []
        for axis in ("x", "y"):
            lo, hi = rows.agg(F.percentile(axis, F.array(F.lit(0.001), F.lit(0.999)))).first()[0]
            pad = 0.25 * (hi - lo) + 1.0
            grid = np.linspace(lo - pad, hi + pad, bins)
            width = grid[1] - grid[0]
            place = F.floor((F.col(axis) - float(grid[0])) / float(width)).cast("int")
            hist = np.zeros(bins)
            for r in rows.select(place.alias("b")).where((F.col("b") >= 0) & (F.col("b") < bins)).groupBy("b").count().collect():
                hist[r["b"]] = r["count"]
            dense = smoothed(hist, sigma) + 1e-9
            inverse = 1 / np.clip(least / np.sqrt(dense / dense.max()), least, most)
            grids.append(grid)
            phases.append(np.concatenate(([0.0], np.cumsum(0.5 * (inverse[1:] + inverse[:-1]) * width))))
        return cls(grids, phases)

    def encode(self, rows: DataFrame, *keys: str) -> DataFrame:
        """keys, e: sin and cos of the phase on both axes; and rate_x, rate_y: how fast it grows there."""
        sent = rows.sparkSession.sparkContext.broadcast(self)

        def run(batches):
            for b in batches:
                w = sent.value
                v = [b.column(c).to_numpy() for c in ("x", "y")]
                a = [2 * np.pi * (np.interp(x, g, p) % 1.0) for x, g, p in zip(v, w.grids, w.phases)]
                e = np.stack([np.sin(a[0]), np.cos(a[0]), np.sin(a[1]), np.cos(a[1])], 1)
                out = b.drop_columns(["x", "y"]).append_column("e", pa.FixedSizeListArray.from_arrays(e.ravel(), 4).cast(pa.list_(pa.float64())))
                for n, x, g, r in zip(("rate_x", "rate_y"), v, w.grids, w.rates):
                    out = out.append_column(n, pa.array(np.interp(x, g, r)))
                yield out

        rows = rows.select(*keys, "x", "y")
        return rows.mapInArrow(run, rows.drop("x", "y").schema.add("e", ArrayType(DoubleType())).add("rate_x", "double").add("rate_y", "double"))

    def gauge_defect(self, rows: DataFrame, key: str, shifts: list[tuple[float, float]]) -> list[tuple[float, float]]:
        """For each shift its length and the mean distance of the shifted points' codes from codes turned by rate times shift."""
        out = []
        here = self.encode(rows, key)
        for vx, vy in shifts:
            there = self.encode(rows.withColumns({"x": F.col("x") + vx, "y": F.col("y") + vy}), key).select(key, F.col("e").alias("f"))
            want = []
            for axis, v in enumerate((vx, vy)):
                turn = 2 * math.pi * F.col("rate_x" if axis == 0 else "rate_y") * v
                s, c = F.col("e")[2 * axis], F.col("e")[2 * axis + 1]
                want += [s * F.cos(turn) + c * F.sin(turn), c * F.cos(turn) - s * F.sin(turn)]
            gap = F.sqrt(sum(((F.col("f")[k] - w) * (F.col("f")[k] - w) for k, w in enumerate(want)), F.lit(0.0)))
            out.append((math.hypot(vx, vy), here.join(there, key).agg(F.avg(gap)).first()[0]))
        return out


def loglog_slope(curve: list[tuple[float, float]], least: float = 0.0) -> float:
    x, y = zip(*((math.log(v), math.log(e + 1e-15)) for v, e in curve if v > least))
    return float(np.polyfit(x, y, 1)[0])


def t_tail(t: float, df: int) -> float:
    """The two-sided p of Student's t, by the continued fraction of the incomplete beta function."""
    if math.isnan(t):
        return math.nan
    a, b, x = df / 2, 0.5, df / (df + t * t)
    if x >= 1:
        return 1.0
    if x <= 0:
        return 0.0
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        a, b, x = b, a, 1 - x
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > 1e-300 else 1e-300)
    h = d
    for m in range(1, 500):
        for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + n * d
            d = 1 / (d if abs(d) > 1e-300 else 1e-300)
            c = 1 + n / c
            c = c if abs(c) > 1e-300 else 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) * h / a
    return 1 - front if flip else front


def paired_tests(results: DataFrame, method: str, block: str, value: str, ours: str) -> DataFrame:
    """ours against each other method over shared blocks: n, mean difference, t, p, and p after Holm's step-down. The number of rows is that of the methods."""
    r = results.select(F.col(method).alias("m"), F.col(block).alias("b"), F.col(value).alias("v"))
    pairs = r.where(F.col("m") != ours).join(r.where(F.col("m") == ours).select("b", F.col("v").alias("o")), "b")
    d = F.col("o") - F.col("v")
    got = pairs.groupBy("m").agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd")).where("n > 1").orderBy("m").collect()
    rows = []
    for x in got:
        t = x["mean"] / (x["sd"] / math.sqrt(x["n"])) if x["sd"] else (0.0 if not x["mean"] else math.copysign(math.inf, x["mean"]))
        rows.append([x["m"], x["n"], x["mean"], t, t_tail(t, x["n"] - 1)])
    worst = 0.0
    for k, x in enumerate(sorted(rows, key=lambda x: (x[4], x[0]))):
        worst = max(worst, min(1.0, (len(rows) - k) * x[4]))
        x.append(worst)
    return results.sparkSession.createDataFrame([(str(m), n, mean, t, p, h) for m, n, mean, t, p, h in rows], "method string, n long, mean_diff double, t double, p double, p_holm double")
