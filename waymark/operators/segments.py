"""Trips from fixes, as functions of a DataFrame and parameters: cuts, windows, labels, quotas, splits, features.

fixes: uid, t (hours), lon, lat and perhaps trip (a group that is never joined with another). Every function is one
declarative plan; windows are partitioned by user or trip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import EARTH_M


def _groups(fixes: DataFrame) -> list[str]:
    return [c for c in ("dataset", "uid", "trip") if c in fixes.columns]


def metres(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """East and north of a reference point."""
    return EARTH_M * F.radians(lon - lon0) * F.cos(F.radians(lat0)), EARTH_M * F.radians(lat - lat0)


def one_of_an_instant(fixes: DataFrame) -> DataFrame:
    """The first fix of each instant, by place."""
    w = Window.partitionBy(*_groups(fixes)).orderBy("t", "lon", "lat")
    return fixes.withColumn("_p", F.lag("t").over(w)).where("_p is null or t > _p").drop("_p")


def cut(fixes: DataFrame, gap_h: float, max_speed_kmh: float | None = None) -> DataFrame:
    """fixes with seg: a step of more than gap_h hours, or faster than max_speed_kmh, begins another one."""
    keys = _groups(fixes)
    w = Window.partitionBy(*keys).orderBy("t", "lon", "lat")
    gap = F.col("t") - F.lag("t").over(w)
    new = gap > gap_h
    if max_speed_kmh is not None:
        whole = Window.partitionBy(*keys)
        x, y = metres(F.col("lon"), F.col("lat"), F.avg("lon").over(whole), F.avg("lat").over(whole))
        fixes = fixes.withColumns({"_x": x, "_y": y})
        km = F.hypot(F.col("_x") - F.lag("_x").over(w), F.col("_y") - F.lag("_y").over(w)) / 1000
        new = new | (km / F.greatest(gap, F.lit(1e-9)) > max_speed_kmh)
    out = fixes.withColumn("_new", F.coalesce(new.cast("int"), F.lit(0)))
    out = out.withColumn("seg", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return out.drop("_new", "_x", "_y")


def windows(segments: DataFrame, min_len: int = 20, max_len: int = 200, overlap: int = 0) -> DataFrame:
    """Rows of overlapping windows of each segment: start (its first fix's number) and i within it.

    Windows begin every max_len - overlap fixes while min_len are left. A last one that ends with the segment is added
    where these would leave fixes at its end out. Segments of fewer than min_len fixes give none.
    """
    keys = [*_groups(segments), "seg"]
    stride = max(max_len - overlap, 1)
    rows = segments.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where(F.col("_n") >= min_len)
    rows = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy("t", "lon", "lat")) - 1)
    last = F.floor((F.col("_n") - min_len) / stride) * stride  # the last start in strides
    first = F.greatest(F.lit(0), F.ceil((F.col("_i") - max_len + 1) / stride) * stride)
    until = F.least(last, F.floor(F.col("_i") / stride) * stride)
    starts = F.when(first <= until, F.sequence(first.cast("long"), until.cast("long"), F.lit(stride).cast("long"))).otherwise(F.array().cast("array<long>"))
    tail = F.col("_n") - max_len
    starts = F.when((last + max_len < F.col("_n")) & (F.col("_i") >= tail), F.array_union(starts, F.array(tail.cast("long")))).otherwise(starts)
    rows = rows.withColumn("start", F.explode(starts))
    return rows.withColumn("i", (F.col("_i") - F.col("start")).cast("int")).drop("_n", "_i")


def spans_of(windowed: DataFrame) -> DataFrame:
    """One row for each window: its keys, n, t0 and t1."""
    keys = [*_groups(windowed), *(c for c in ("seg", "start") if c in windowed.columns)]
    return windowed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"))


def labelled(spans: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """spans with mode: the label of the same user that overlaps most, if by more than `least` of the span; the first (by ord) at ties, else null. labels: uid, t0, t1, mode, ord."""
    keys = [c for c in spans.columns if c not in ("n", "t0", "t1")]
    l = labels.select(F.col("uid").alias("_u"), F.col("t0").alias("_a"), F.col("t1").alias("_b"), "mode", "ord")
    overlap = F.least("t1", "_b") - F.greatest("t0", "_a")
    met = spans.join(l, (F.col("uid") == F.col("_u")) & (F.col("_a") < F.col("t1")) & (F.col("_b") > F.col("t0"))).withColumn("_o", overlap)
    best = met.groupBy(*keys).agg(F.max_by(F.struct("mode", "_o"), F.struct("_o", -F.col("ord"))).alias("_m"))
    found = spans.join(best, keys, "left")
    keep = F.col("_m._o") > least * F.greatest(F.col("t1") - F.col("t0"), F.lit(1e-9))
    return found.withColumn("mode", F.when(keep, F.col("_m.mode"))).drop("_m")


def even_quota(spans: DataFrame, most: int) -> DataFrame:
    """At most `most` spans in all, evenly many of each user: the first max(most // users, 1) by start."""
    users = spans.agg(F.count_distinct("uid").alias("_users"))
    w = Window.partitionBy("uid").orderBy("t0", *(c for c in ("trip", "seg", "start") if c in spans.columns))
    ranked = spans.withColumn("_k", F.row_number().over(w)).crossJoin(F.broadcast(users))
    return ranked.where(F.col("_k") <= F.greatest(F.floor(F.lit(most) / F.col("_users")), F.lit(1))).drop("_k", "_users")


def within(fixes: DataFrame, box: tuple[float, float, float, float], least: float = 1.0) -> DataFrame:
    """The trips of which a share of at least `least` of the fixes is in the box (lon0, lat0, lon1, lat1)."""
    keys = [*_groups(fixes), *(c for c in ("seg", "start") if c in fixes.columns)]
    inside = F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3])
    w = Window.partitionBy(*keys)
    return fixes.withColumn("_in", F.avg(inside.cast("double")).over(w)).where(F.col("_in") >= least).drop("_in")


def local(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with x, y: metres from their group's mean."""
    w = Window.partitionBy(*keys)
    x, y = metres(F.col("lon"), F.col("lat"), F.avg("lon").over(w), F.avg("lat").over(w))
    return rows.withColumns({"x": x, "y": y})


def steps(rows: DataFrame, keys: list[str], order: str = "i") -> DataFrame:
    """rows (x, y, t) with dx, dy, r, dt (hours) and v (m/s) of the step to each; null in a group's first row."""
    w = Window.partitionBy(*keys).orderBy(order)
    out = rows.withColumns({"dx": F.col("x") - F.lag("x").over(w), "dy": F.col("y") - F.lag("y").over(w), "dt": F.col("t") - F.lag("t").over(w)})
    return out.withColumn("r", F.hypot("dx", "dy")).withColumn("v", F.col("r") / F.greatest(F.col("dt") * 3600, F.lit(1e-6)))


def code(value: Column, scales: list[float], frequencies: bool = False) -> Column:
    """sin and cos at each scale (a wavelength, or a frequency), interleaved, as one array."""
    at = F.array(*(F.lit(w if frequencies else 6.283185307179586 / w) for w in scales))
    return F.flatten(F.transform(at, lambda w: F.array(F.sin(w * value), F.cos(w * value))))


def pooled(rows: DataFrame, keys: list[str], column: str, dims: int) -> DataFrame:
    """Mean and deviation of each dimension of an array column over each group, as one array of 2 * dims."""
    mean = [F.avg(F.col(column)[k]) for k in range(dims)]
    dev = [F.stddev_pop(F.col(column)[k]) for k in range(dims)]
    return rows.groupBy(*keys).agg(F.array(*mean, *dev).alias(column))


def by_hash(rows: DataFrame, key: Column, share: float, seed: int = 0) -> Column:
    """True for a share of all keys, the same on every machine and in every retry."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_003)) < share * 1_000_003
