"""A commute table made up from hashes: the same rows on any number of machines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _uniform(seed: int, *keys) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1_000_003)) / 1_000_003.0


def _normal(seed: int, *keys) -> Column:
    return F.sqrt(-2 * F.log(F.greatest(_uniform(seed, *keys), F.lit(1e-9)))) * F.cos(6.283185307179586 * _uniform(seed + 1, *keys))


def commutes(spark: SparkSession, users: int = 12, days: int = 14, centre: tuple[float, float] = (10.204, 56.162), seed: int = 0) -> DataFrame:
    """Two trips a day between a user's home and work, 15 s between fixes, in the columns that commute_csv reads."""
    trips = spark.range(users).withColumnRenamed("id", "u").crossJoin(spark.range(days).withColumnRenamed("id", "day")).withColumn("back", F.explode(F.array(F.lit(0), F.lit(1))))
    n = (40 + F.floor(50 * _uniform(seed, "u", "day", "back"))).cast("int")
    rows = trips.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    share = F.when(F.col("back") == 0, F.col("i")).otherwise(F.col("n") - 1 - F.col("i")) / (F.col("n") - 1)
    place = lambda at, k, home, work: F.lit(at) + home * _normal(seed + 10 + k, "u") * (1 - share) + work * _normal(seed + 20 + k, "u") * share + 3e-4 * _normal(seed + 30 + k, "u", "day", "back", "i")
    start = F.lit(1740960000) + F.col("day") * 86400 + F.when(F.col("back") == 0, 8).otherwise(17) * 3600 + F.floor(40 * _uniform(seed + 40, "u", "day", "back")) * 60
    at = F.timestamp_seconds(start + 15 * F.col("i"))
    trip = F.format_string("U%03d_%d", "u", F.col("day") * 2 + F.col("back") + 1)
    return rows.select(F.format_string("U%03d", "u").alias("uid"), F.date_format(at, "yyyy-MM-dd").alias("DAY"), F.hour(at).alias("HH24"), place(centre[1], 2, 0.015, 0.02).alias("lat"), place(centre[0], 4, 0.02, 0.03).alias("lng"), (60 * _uniform(seed + 50, "u", "day", "back", "i")).alias("SPEED"), (360 * _uniform(seed + 51, "u", "day", "back", "i")).alias("HEADING"), (1 + F.floor(5 * _uniform(seed + 52, "u", "day", "back", "i"))).alias("QUALITY"), F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("datetime"), trip.alias("tid"), trip.alias("trip_id"), F.concat(trip, F.lit("_0")).alias("trip_id_segment"), F.format_string("user_%d", "u").alias("user"))


def write(spark: SparkSession, path: str, **options) -> None:
    commutes(spark, **options).write.mode("overwrite").option("header", True).csv(path)
