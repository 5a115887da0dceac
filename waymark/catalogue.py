"""All queries of the trajectory operators, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import plans
from .operators import anomalies, audits, codebooks, fits, geo, graph, moves, pairs, rank, segments, sequential, stats, trips  # noqa: F401  they register their steps
from .streaming import sessions as streaming


def _stay_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequential.stay_points(plans.run("points", spark, sf_dir))


def _packed(spark: SparkSession, sf_dir: str, *names: str) -> tuple[DataFrame, DataFrame]:
    """The query set and all trips, a row for each, with arrays of the columns of placed."""
    trips = sequential._cut(pairs.packed(plans.run("placed", spark, sf_dir), *names))
    return trips.join(F.broadcast(plans.run("asked", spark, sf_dir)), ["uid", "seg"]), trips


def _sequence_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.sequence_costs(*_packed(spark, sf_dir, "x", "y"))


def _dita_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.dita_distance(*_packed(spark, sf_dir, "x", "y"))


def _blended_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.blended_truth(*_packed(spark, sf_dir, "x", "y", "t"))


def _network_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cost of every pair of vertices over the induced edges."""
    return sequential.shortest_paths(plans.run("induced_edges", spark, sf_dir), plans.run("network_vertices", spark, sf_dir))


def _network_trip_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four distances of each trip of the query set to all others over network costs: points are shared at the same vertex, and a gap costs a pair's mean."""
    paths, b, k = _network_paths(spark, sf_dir), sequential._cut(plans.run("passed", spark, sf_dir)), plans.run("asked", spark, sf_dir)
    rows = paths.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dst", "cost"))).alias("p")).select(F.col("src").alias("id"), F.col("p.cost").alias("row"))
    asked = pairs.packed(b.join(F.broadcast(k), ["uid", "seg"]).join(rows, "id"), "id", "row")
    return pairs.network_costs(asked.withColumn("row", F.flatten("row")), pairs.packed(b, "id"))


def _synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequential.synthetic(spark)


def _geometric_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = sequential.geometric_median(plans.run("centred", spark, sf_dir))
    return spark.createDataFrame([(round(x, 3), round(y, 3))], "x double, y double")


def _trip_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions that loaders use, on the events as fixes."""
    rows = segments.windows(_cut(spark, sf_dir), trips.MIN_LEN, trips.MAX_LEN, trips.OVERLAP)
    out = segments.spans_of(rows)
    return out.select("uid", "seg", F.col("start").alias("start_i"), "n", *(F.round(c, 6).alias(c) for c in ("t0", "t1")))


def _cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.cut(plans.run("fixes", spark, sf_dir).select("uid", "t", "lon", "lat"), trips.GAP_H)


def _label_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = segments.spans_of(_cut(spark, sf_dir)).where(F.col("n") >= trips.MIN_LEN)
    fixes = plans.run("fixes", spark, sf_dir).where("label in ('view', 'click')")
    labels = fixes.select("uid", F.col("t").alias("t0"), (F.col("t") + 6.0).alias("t1"), F.col("label").alias("mode"), F.col("seq").alias("ord"))
    return segments.labelled(spans, labels).select("uid", "seg", F.col("mode").alias("lab"))


def _kmeans_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen centres fitted in up to forty rounds, the size of each cluster and its mean squared distance."""
    rows = plans.run("vectors", spark, sf_dir)
    centres = fits.kmeans(rows, "e", "id", 16)
    held = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "centre int, c array<double>")
    gap = F.aggregate(F.zip_with("e", "c", lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda a, x: a + x)
    near = rows.withColumn("centre", fits.nearest("e", centres)).join(F.broadcast(held), "centre")
    return near.groupBy("centre").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(gap), 6).alias("spread"))


def _ridge_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out R squared of each mobility statistic from pooled tokens."""
    pooled = plans.run("pooled_tokens", spark, sf_dir)
    rows = pooled.join(plans.run("mobility_stats", spark, sf_dir), ["uid", "seg"]).persist()
    train = segments.by_hash(rows, F.struct("uid", "seg"), 0.7)
    names = [c for c in pooled.columns if c not in ("uid", "seg")]
    targets = ("radius_of_gyration", "entropy", "total_distance", "mean_step", "centroid_dist", "heading_cos", "heading_sin")
    found = [(t, fits.ridge_r2(rows, names, t, train)) for t in targets]
    rows.unpersist()
    return spark.createDataFrame(found, "target string, r2 double")


def _procrustes_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of shifted points against the best orthogonal map of the codes, fitted on half of the points: exact for the torus, not for frequencies of degrees."""
    p = plans.run("points", spark, sf_dir)
    fit, out = segments.by_hash(p, F.col("seq"), 0.5), []
    for name, scales, at in (("torus", geo.TORUS, lambda s: (F.col("x") + s, F.col("y"))), ("place", [50.0, 90.0], lambda s: (F.exp((F.col("x") + s) / 1000.0) * 1000.0, F.col("y")))):
        codes = [[F.element_at(segments.code(v, list(scales)), k + 1) for v in at(s) for k in range(2 * len(scales))] for s in (0.0, 100.0)]
        by = fits.orthogonal_map(p.where(fit), *codes)
        out.append((name, round(fits.map_error(p.where(~fit), *codes, by), 6)))
    return spark.createDataFrame(out, "code string, error double")


def _gauge_defect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a separable warp's codes are from the gauge's prediction, by the length of the shift, and the slope of the curve."""
    rows = plans.run("centred", spark, sf_dir).select("seq", "x", "y")
    curve = fits.Warp.fitted(rows).gauge_defect(rows, "seq", [(v, 0.0) for v in (5.0, 10.0, 20.0, 40.0)])
    slope = round(fits.loglog_slope(curve), 4)
    return spark.createDataFrame([(v, round(e, 9), slope) for v, e in curve], "shift_m double, defect double, slope double")


def _paired_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fits.paired_tests(plans.run("contest", spark, sf_dir), "method", "block", "value", "Brand#1")


def _session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixes = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("uid"), F.col("ts").cast("timestamp").alias("ts"))
    return streaming.sessions(fixes).select("uid", "n", F.date_format("t0", "yyyy-MM-dd HH:mm:ss").alias("t0"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: partial(plans.run, name) for name in plans.names()}
    return found | {"stay_points": _stay_points, "sequence_costs": _sequence_costs, "network_paths": _network_paths, "network_trip_costs": _network_trip_costs, "synthetic_corpus": _synthetic, "geometric_median": _geometric_median, "session_windows": _session_windows, "trip_windows": _trip_windows, "label_overlap_join": _label_overlap_join, "kmeans_fit": _kmeans_fit, "ridge_probe": _ridge_probe, "procrustes_error": _procrustes_error, "gauge_defect": _gauge_defect, "paired_tests": _paired_tests, "dita_distance": _dita_distance, "blended_truth": _blended_truth}


def oracle_sql() -> dict[str, str]:
    return {name: plans.text(name, plans.Duck()) for name in plans.names()}
