"""Named relational steps, written once for two SQL dialects.

A step is a function of a dialect that returns SELECT text; the steps it reads are named in `needs`. A query is
the WITH chain of its steps. Spark runs it as one declarative plan, which Catalyst prunes and pushes down; the
other dialect gives the oracle text for the same rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
EARTH_M = 6371008.8


class Dialect:
    def floor(self, x):
        return f"CAST(floor({x}) AS BIGINT)"

    def mod(self, a, b):
        """a modulo b, never negative."""
        return f"((({a}) % ({b}) + ({b})) % ({b}))"

    def dist(self, x, y):
        return f"sqrt(({x}) * ({x}) + ({y}) * ({y}))"

    def r(self, x, n=6):
        """A rounded double without a negative zero."""
        return f"(round(CAST({x} AS DOUBLE), {n}) + 0e0)"

    def clip(self, x, a, b):
        return f"least(greatest({x}, {a}), {b})"

    def values(self, name, xs):
        return "(" + " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS {name}_i, CAST({x!r} AS DOUBLE) AS {name}" for i, x in enumerate(xs)) + ")"


class Spark(Dialect):
    def hours(self, ts):
        return f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', CAST({ts} AS timestamp_ntz)) / 3.6e9"

    def pct(self, x, p):
        return f"percentile({x}, {p})"

    def half_even(self, x):
        return f"CAST(bround({x}, 0) AS BIGINT)"

    def series(self, a, b, step=1):
        return f"explode(sequence(CAST({a} AS BIGINT), CAST({b} AS BIGINT), CAST({step} AS BIGINT)))"

    def position(self, xs):
        return f"posexplode({xs})"

    def trunc(self, x):
        return f"CAST({x} AS BIGINT)"

    def dot(self, a, b):
        return f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0e0, (s, x) -> s + x)"


class Duck(Dialect):
    def hours(self, ts):
        return f"epoch_us({ts}) / 3.6e9"

    def pct(self, x, p):
        return f"quantile_cont({x}, {p})"

    def half_even(self, x):
        return f"CAST(round_even({x}, 0) AS BIGINT)"

    def series(self, a, b, step=1):
        return f"unnest(range(CAST({a} AS BIGINT), CAST({b} AS BIGINT) + 1, CAST({step} AS BIGINT)))"

    def trunc(self, x):
        return f"CAST(trunc({x}) AS BIGINT)"

    def dot(self, a, b):
        return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"


_steps: dict[str, tuple[Callable[[Dialect], str], tuple[str, ...]]] = {}
_queries: list[str] = []


def step(*needs: str, query: bool = False):
    def add(f):
        _steps[f.__name__] = (f, needs)
        if query:
            _queries.append(f.__name__)
        return f

    return add


def query(*needs: str):
    return step(*needs, query=True)


def text(name: str, d: Dialect, prefix: str = "") -> str:
    """The SQL of a step with all that it reads; views that are tables keep their names."""
    order: list[str] = []

    def visit(n):
        for x in _steps[n][1]:
            visit(x)
        if n not in order:
            order.append(n)

    visit(name)
    ctes = ", ".join(f"{n} AS ({_steps[n][0](d)})" for n in order[:-1])
    return (f"WITH {ctes} " if ctes else "") + _steps[name][0](d)


_READ = re.compile(r"\b(FROM|JOIN) (" + "|".join(TABLES) + r")\b")


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The step over the tables of a folder; views go by table and folder, so that two folders in one session don't meet."""
    views = {}

    def view(m: re.Match) -> str:
        t = m[2]
        if t not in views:
            views[t] = f"waymark_{t}_{zlib.crc32(sf_dir.encode()):08x}"
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(views[t])
        return f"{m[1]} {views[t]} AS {t}" if m.string[m.end() : m.end() + 4].upper() != " AS " else f"{m[1]} {views[t]}"

    return spark.sql(_READ.sub(view, text(name, Spark())))


def names() -> list[str]:
    return list(_queries)
