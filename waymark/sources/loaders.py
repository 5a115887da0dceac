"""File layouts of trajectory corpora as DataFrames of fixes (uid, t hours of wall clock, lon, lat).

Parsing is declarative (column pruning and splitting stay with the reader); malformed rows become null and are
filtered. Offsets of naive clocks are dropped, never converted.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import segments

HOURS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {0}) / 3.6e9"
# Column names that stand for one meaning, the first match wins.
SYNONYMS = {
    "lat": ("lat", "latitude", "y"),
    "lon": ("lng", "lon", "long", "longitude", "x"),
    "time": ("datetime", "timestamp", "time", "ts"),
    "trip": ("trip_id_segment", "trip_id", "tid", "segment_id"),
    "uid": ("user", "uid", "user_id"),
    "quality": ("quality", "accuracy", "hdop"),
    "speed": ("speed",),
    "heading": ("heading", "bearing", "course"),
}


def infer_schema(columns: Iterable[str]) -> dict[str, str]:
    """Meaning to column name, whatever its case; lat and lon must be there."""
    by_name = {c.lower(): c for c in columns}
    found = {k: next(by_name[n] for n in names if n in by_name) for k, names in SYNONYMS.items() if any(n in by_name for n in names)}
    if missing := {"lat", "lon"} - found.keys():
        raise ValueError(f"no column for {sorted(missing)} among {sorted(by_name)}")
    return found


def _valid(df: DataFrame) -> DataFrame:
    return df.where("lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90 AND t IS NOT NULL")


def porto(spark: SparkSession, path: str, min_len: int = 20, max_len: int = 200) -> DataFrame:
    """One row per trip with a JSON polyline, 15 s between points; the first max_len points stay. The clock is UTC."""
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    rows = rows.select(F.col("TAXI_ID").alias("uid"), F.col("TIMESTAMP").cast("double").alias("t0"), F.from_json("POLYLINE", "array<array<double>>").alias("p"), F.monotonically_increasing_id().alias("trip"))
    rows = rows.where(F.size("p") >= min_len).select("uid", "trip", "t0", F.posexplode(F.slice("p", 1, max_len)).alias("i", "q"))
    return _valid(rows.select("uid", "trip", (F.col("t0") / 3600 + F.col("i") * 15 / 3600).alias("t"), F.col("q")[0].alias("lon"), F.col("q")[1].alias("lat")))


def tdrive(spark: SparkSession, root: str) -> DataFrame:
    """Headerless text files `id,datetime,lon,lat`; the user is the file's stem."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").schema("id string, at string, lon double, lat double").csv(root)
    uid = F.regexp_extract("_metadata.file_name", r"^(.*)\.txt$", 1)
    return _valid(rows.select(uid.alias("uid"), F.expr(HOURS.format("try_to_timestamp(at, 'yyyy-MM-dd HH:mm:ss')::timestamp_ntz")).alias("t"), "lon", "lat"))


def geolife(spark: SparkSession, root: str, utc_offset_h: float = 8) -> DataFrame:
    """.plt files; header lines have no five numeric fields. Days since 1899-12-30 to hours of the local clock."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.plt").text(root)
    parts = F.split("value", ",")
    number = lambda k: F.expr(f"try_cast(parts[{k}] AS DOUBLE)")
    uid = F.regexp_extract("_metadata.file_path", r"([^/]+)/(?:Trajectory/)?[^/]+\.plt$", 1)
    rows = rows.select(uid.alias("uid"), F.regexp_extract("_metadata.file_path", r"([^/]+)\.plt$", 1).alias("trip"), parts.alias("parts")).where(F.size("parts") >= 7)
    return _valid(rows.select("uid", "trip", ((number(4) - 25569) * 24 + utc_offset_h).alias("t"), number(1).alias("lon"), number(0).alias("lat")))


# Travel modes of the labels by the class they count as.
MODES = {"walk": "walk", "run": "walk", "bike": "bike", "bus": "bus", "taxi": "car", "car": "car", "subway": "rail", "train": "rail", "railway": "rail", "airplane": "other", "boat": "other", "motorcycle": "other"}


def geolife_labels(spark: SparkSession, root: str, utc_offset_h: float = 8) -> DataFrame:
    """Labelled spans uid, t0, t1, mode, ord of tab-separated labels.txt files."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "labels.txt").option("sep", "\t").option("header", True).schema("start string, end string, mode string").csv(root)
    at = lambda c: F.expr(HOURS.format(f"try_to_timestamp(`{c}`, 'yyyy/MM/dd HH:mm:ss')::timestamp_ntz")) + utc_offset_h
    mode = F.create_map(*(F.lit(x) for kv in MODES.items() for x in kv))[F.lower("mode")]
    return rows.select(F.regexp_extract("_metadata.file_path", r"([^/]+)/labels\.txt$", 1).alias("uid"), at("start").alias("t0"), at("end").alias("t1"), F.coalesce(mode, F.lit("other")).alias("mode"), F.monotonically_increasing_id().alias("ord")).where("t0 IS NOT NULL AND t1 IS NOT NULL")


def roma(spark: SparkSession, path: str, latitude_first: bool = True) -> DataFrame:
    """`id;timestamp with fraction and offset;POINT(a b)`; the offset is dropped."""
    rows = spark.read.option("sep", ";").schema("uid string, at string, point string").csv(path)
    part = lambda k: F.expr(f"try_cast(regexp_extract(point, 'POINT\\\\s*\\\\(\\\\s*(\\\\S+)\\\\s+([^)\\\\s]+)', {k}) AS DOUBLE)")
    clock = F.regexp_extract("at", r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(?:\.\d{1,6})?)", 1)
    rows = rows.select("uid", clock.alias("clock"), part(2 if latitude_first else 1).alias("lon"), part(1 if latitude_first else 2).alias("lat"))
    return _valid(rows.select("uid", F.expr(HOURS.format("try_cast(clock AS timestamp_ntz)")).alias("t"), "lon", "lat"))


def ais(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("header", True).csv(path)
    return _valid(rows.select(F.col("MMSI").alias("uid"), F.expr(HOURS.format("try_cast(BaseDateTime AS timestamp_ntz)")).alias("t"), F.expr("try_cast(LON AS DOUBLE)").alias("lon"), F.expr("try_cast(LAT AS DOUBLE)").alias("lat")))


def commute_csv(spark: SparkSession, path: str, schema: dict[str, str] | None = None, min_quality: float | None = None) -> DataFrame:
    """A CSV with a header whose columns' meanings are inferred; one fix of an instant stays."""
    rows = spark.read.option("header", True).csv(path)
    s = schema or infer_schema(rows.columns)
    group = s.get("trip") or s.get("uid")
    if group is None or "time" not in s:
        raise ValueError("a column for trips or users and one for time are needed")
    number = lambda k: F.expr(f"try_cast(`{s[k]}` AS DOUBLE)")
    if min_quality is not None and "quality" in s:
        rows = rows.where(number("quality") >= min_quality)
    fixes = _valid(rows.select(F.col(s.get("uid", group)).alias("uid"), F.col(group).alias("trip"), F.expr(HOURS.format(f"try_cast(`{s['time']}` AS timestamp_ntz)")).alias("t"), number("lon").alias("lon"), number("lat").alias("lat")))
    return fixes.groupBy("uid", "trip", "t").agg(F.min(F.struct("lon", "lat")).alias("p")).select("uid", "trip", "t", "p.lon", "p.lat")


def trips(fixes: DataFrame, gap_h: float, min_len: int = 20, max_len: int = 200, overlap: int = 100, max_trips: int | None = None, max_speed_kmh: float | None = None, labels: DataFrame | None = None) -> DataFrame:
    """Windows of a loader's fixes: uid, seg, start, i, t, lon, lat, and mode where labels are given; of at most max_trips windows evenly many of each user."""
    rows = segments.windows(segments.cut(segments.one_of_an_instant(fixes), gap_h, max_speed_kmh), min_len, max_len, overlap)
    if max_trips is None and labels is None:
        return rows
    spans = segments.spans_of(rows)
    if labels is not None:
        spans = segments.labelled(spans, labels)
    if max_trips is not None:
        spans = segments.even_quota(spans, max_trips)
    keys = [c for c in spans.columns if c not in ("n", "t0", "t1", "mode")]
    return rows.join(spans.drop("n", "t0", "t1"), keys)


#: Hours without a fix that end a trip, by layout.
GAPS_H = {"tdrive": 0.5, "geolife": 20 / 60, "roma": 1 / 60, "ais": 1.0, "csv": 10 / 60}
LOADERS = {"porto": porto, "tdrive": tdrive, "geolife": geolife, "roma": roma, "ais": ais, "csv": commute_csv}


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def status(spark: SparkSession, name: str, path: str | None) -> str:
    """ready, or why a corpus can't be read."""
    if name not in LOADERS:
        return "unknown"
    return "no path" if not path else "ready" if exists(spark, path) else f"nothing at {path}"


def load_available(spark: SparkSession, paths: dict[str, str], required: int = 1, **options) -> tuple[DataFrame, dict[str, str]]:
    """The fixes of all corpora that are there, with a column dataset, and why the others are not; fewer than `required` are an error."""
    found, skipped = [], {}
    for name, path in paths.items():
        why = status(spark, name, path)
        if why == "ready":
            try:
                df = load(spark, name, path, **options)
                found.append(df.select(F.lit(name).alias("dataset"), F.col("uid").cast("string").alias("uid"), "t", "lon", "lat"))
                continue
            except ValueError as e:
                why = str(e)
        skipped[name] = why
    if len(found) < required:
        raise ValueError(f"{len(found)} corpora of {required}: {skipped}")
    return reduce(DataFrame.unionByName, found), skipped


def load(spark: SparkSession, name: str, path: str, box: tuple[float, float, float, float] | None = None, **options) -> DataFrame:
    """The named corpus within a box (lon0, lat0, lon1, lat1); an empty one is an error."""
    if name not in LOADERS:
        raise ValueError(f"{name} is none of {sorted(LOADERS)}")
    df = LOADERS[name](spark, path, **options)
    if box:
        df = df.where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))
    if df.isEmpty():
        raise ValueError(f"{name}: no fixes under {path}")
    return df
