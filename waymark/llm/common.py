"""What the text operators share: reading tables, written cuts in the shared folder, Arrow helpers."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes between which a word stands: blank and tab to carriage return.
SPACES = b" \t\n\x0b\x0c\r"
_written: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, a folder of this machine in local mode, as in tests, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='waymark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed when Python ends, or by drop()."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def stored(df: DataFrame, name: str = "cut") -> DataFrame:
    """df as a table written to the shared folder: the lineage is cut there, and a lost executor loses none of it."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df_or_path: DataFrame | str) -> None:
    """Remove what stored() or shared_path() wrote, once nothing reads it any more."""
    paths = [df_or_path] if isinstance(df_or_path, str) else [f.rsplit("/", 1)[0] for f in df_or_path.inputFiles()[:1]]
    for path in paths:
        key = next((k for k in _written if k.split(":")[-1].lstrip("/") == path.split(":")[-1].lstrip("/")), None)
        if key:
            spark = _written.pop(key)
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(key)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, row_bytes: int, most_mb: int = 64) -> DataFrame:
    """df with a broadcast hint if its counted rows, of row_bytes each, stay within most_mb; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes <= most_mb << 20 else df


def joined(rows: DataFrame, groups: DataFrame, on: list[str], size: str, parts: int = 1024) -> DataFrame:
    """rows joined with groups (one row for each `on`, with its number of rows as `size`), without the column `size`.

    A group that holds over a parts-th of all rows would make one task long. There are under `parts` of them, whatever
    the data, so these are broadcast; all others meet by a shuffle.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.where(F.col(size) > total / parts).drop(size)
    rest = groups.where(F.col(size) <= total / parts).drop(size)
    keys = F.broadcast(hot.select(*on))
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(keys, on, "left_anti").join(rest, on))


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with as many underscores behind it as make it unlike any column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def nested(df: DataFrame) -> Column:
    """All columns of df as one, so that columns made beside it can't clash with them."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns))


@atexit.register
def _drop_all() -> None:
    for path in list(_written):
        try:
            drop(path)
        except Exception:  # the JVM may have gone first; the folder is scratch space
            return


def remainder(of: str, by: int):
    """crc32 of a column's value as text, modulo by; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(of).cast("string"), F.lit("")).cast("binary")) % by


def texts(df: DataFrame, *more, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Key and text (null: empty) alone, so that columns of any other name can't clash."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *more)


def each_batch(f: Callable[[pa.RecordBatch], pa.RecordBatch | list[pa.RecordBatch]]) -> Callable:
    """f over the batches of a partition, as mapInArrow takes it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                got = f(batch)
                yield from got if isinstance(got, list) else [got]

    return run


def as_bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.large_binary()).to_pylist()


def mixed(x: np.ndarray, by: int) -> np.ndarray:
    """A 64-bit mix of x under the seed by (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(by * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of byte words, the same on every machine; a bounded memory of words met before."""

    def __init__(self, most: int = 400_000):
        import xxhash

        self.hash, self.most, self.known = xxhash.xxh3_64_intdigest, most, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known, n = self.known, len(words)
        if len(known) > self.most:
            known.clear()
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, n)
        except KeyError:
            for w in set(words):
                if w not in known:
                    known[w] = self.hash(w)
            return np.fromiter(map(known.__getitem__, words), np.uint64, n)
