"""Distances of the trips of a query set to all trips, without a row for each pair of points.

Trips are packed into blocks of arrays, blocks meet blocks of the query set, and each pair of blocks is worked out
in numpy: what is written and shuffled grows with the trips, only the result with the pairs. Blocks are cut by
points, so what a task holds is bounded by them and by one pair of trips.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequential import _cut

#: Trips and points of a block, of a block of the query set; values in the wide column of a block; rows of a batch of results; grid cells held at once; MB of query blocks that are broadcast; values that are counted one by one.
BLOCK, ASKED, WIDE, BATCH, HELD, SENT_MB, FEW = (2048, 16384), (128, 4096), 1 << 18, 1 << 16, 1 << 22, 64, 1 << 16
KEYS = ["u1", "s1", "u2", "s2"]


def packed(points: DataFrame, *names: str) -> DataFrame:
    """uid, seg and an array of each of names in the order of i, one row for each trip."""
    rows = points.groupBy("uid", "seg").agg(F.array_sort(F.collect_list(F.struct("i", *names))).alias("p"))
    return rows.select("uid", "seg", *(F.col(f"p.{x}").alias(x) for x in names))


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of arrays, nulls as NaN, and where each array begins and the last ends."""
    at = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]], at - at[0]


def blocks(trips: DataFrame, names: list[str], most: tuple[int, int], prefix: str = "", wide: str = "") -> DataFrame:
    """Packed trips in blocks of at most so many trips and points, with each trip as long as the longest (one trip at least); `wide` names a further column of arrays, as of rows of costs."""
    cols = [*names, *([wide] if wide else [])]
    out = ["uid", "seg", "n", *cols, *(["width"] if wide else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            size = np.diff(r.column(names[0]).offsets.to_numpy())
            order = np.argsort(size, kind="stable")
            width = np.diff(r.column(wide).offsets.to_numpy())[order] if wide else np.zeros(len(order), np.int64)
            first = 0
            while first < len(order):
                full = size[order[first : first + most[0]]] * np.arange(1, min(most[0], len(order) - first) + 1)
                last = first + max(1, min(int(np.searchsorted(full, most[1], "right")), int(np.searchsorted(np.cumsum(width[first : first + most[0]]), WIDE, "right"))))
                part = r.take(pa.array(order[first:last]))
                found = [part.column("uid"), part.column("seg"), pa.array(size[order[first:last]], pa.int64()), *(part.column(c).flatten() for c in cols)]
                if wide:
                    found.append(pa.array(np.diff(part.column(wide).offsets.to_numpy()), pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in found], names=[prefix + c for c in out])
                first = last

    kind = {c: t.replace("bigint", "long") for c, t in trips.dtypes}
    schema = [f"{prefix}{c} {kind[c] if c in cols else 'array<long>'}" for c in out]
    return trips.mapInArrow(run, ", ".join(schema))


class Block:
    """The trips of a block: keys, lengths, where each begins, and its columns of points end to end."""

    def __init__(self, row: dict[str, np.ndarray], prefix: str, names: list[str], wide: str = ""):
        self.uid, self.seg = row[f"{prefix}uid"], row[f"{prefix}seg"].to_numpy()
        self.ids = np.asarray(self.uid.fill_null(0))
        self.known = ~np.asarray(self.uid.is_null())
        self.n = row[f"{prefix}n"].to_numpy()
        self.end = np.cumsum(self.n)
        self.start = self.end - self.n
        self.of = {c: row[f"{prefix}{c}"].to_numpy(zero_copy_only=False) for c in names}
        if wide:
            self.width = row[f"{prefix}width"].to_numpy()
            self.wide, self.wide_end = row[f"{prefix}{wide}"].to_numpy(), np.cumsum(self.width)
        self._at: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        self._pad: np.ndarray | None = None

    def trip(self, k: int) -> dict[str, np.ndarray]:
        return {c: x[self.start[k] : self.end[k]] for c, x in self.of.items()}

    def rows_of(self, k: int) -> np.ndarray:
        """The wide column of a trip, a row for each point."""
        return self.wide[self.wide_end[k] - self.width[k] : self.wide_end[k]].reshape(self.n[k], -1)

    def aligned(self, a: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Index-aligned points of a trip of a points and each of the block: indices in either, where each trip's begin, how many."""
        if a not in self._at:
            i, j = [], []
            for n, start in zip(self.n.tolist(), self.start.tolist()):
                m = min(a, n)
                i.append(np.linspace(0, a - 1, m).astype(int))
                j.append(start + np.linspace(0, n - 1, m).astype(int))
            m = np.minimum(a, self.n)
            self._at[a] = np.concatenate(i), np.concatenate(j), np.cumsum(m) - m, m
        return self._at[a]

    def padded(self) -> np.ndarray:
        """For each place and trip the index of the point; the last one again behind a trip's end."""
        if self._pad is None:
            self._pad = self.start + np.minimum(np.arange(self.n.max())[:, None], self.n - 1)
        return self._pad


def meeting(queries: DataFrame, trips: DataFrame, names: list[str], wide: str = "") -> DataFrame:
    """A row for each block of the query set and each block of the trips, in as many tasks as the trips have blocks."""
    q = _cut(blocks(queries, names, ASKED, "q_", wide))
    b = _cut(blocks(trips, names, BLOCK))
    size = q.agg(F.sum(8 * (F.size("q_uid") * 3 + F.size(f"q_{names[0]}") * len(names) + (F.size(f"q_{wide}") if wide else 0)))).first()[0] or 0
    b = b.repartition(max(1, min(b.count(), 4096)))
    return b.crossJoin(F.broadcast(q) if size <= SENT_MB << 20 else q)


def over(met: DataFrame, names: list[str], task: Callable, schema: str, wide: str = "") -> DataFrame:
    """`task` over an iterator of the pairs of blocks of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for r in batches:
                for k in range(r.num_rows):
                    row = {c: r.column(c)[k].values for c in r.schema.names}
                    yield Block(row, "q_", names, wide), Block(row, "", names)

        yield from task(each())

    return met.mapInArrow(run, schema)


def _others(q: Block, k: int, b: Block) -> np.ndarray:
    """The trips of a block that are not the k-th of the query set."""
    return np.flatnonzero((b.seg != q.seg[k]) | b.known & (b.ids != q.ids[k]))


def distances(kernel: Callable, out: list[str]) -> tuple[Callable, str]:
    """The task and schema of a result for each pair of different trips: kernel gives for a trip of the query set (block, number) and a block an array for each of out."""

    def task(met) -> Iterator[pa.RecordBatch]:
        for q, b in met:
            held: list[tuple] = []
            rows = 0
            for k in range(len(q.n)):
                u, s = q.ids[k], q.seg[k]
                found = kernel(q, k, b)
                keep = _others(q, k, b)
                held.append((np.full(len(keep), u), np.full(len(keep), s), keep, *(x[keep] for x in found)))
                rows += len(keep)
                if rows >= BATCH or k == len(q.n) - 1:
                    u1, s1, at, *got = (np.concatenate(x) for x in zip(*held))
                    held, rows = [], 0
                    yield pa.RecordBatch.from_arrays([pa.array(u1), pa.array(s1), b.uid.take(pa.array(at)), pa.array(b.seg[at]), *map(pa.array, got)], names=[*KEYS, *out])

    return task, ", ".join([f"{k} long" for k in KEYS] + [f"{x} double" for x in out])


def rounded(x: np.ndarray, places: int) -> np.ndarray:
    """Halves up, as SQL rounds what is not negative."""
    return np.floor(x * 10.0**places + 0.5) / 10.0**places


def dita(q: Block, k: int, b: Block) -> list[np.ndarray]:
    """Half the sum of the mean row minimum and the mean column minimum; squares are compared, roots taken of the least alone."""
    p, x, y = q.trip(k), b.of["x"], b.of["y"]
    low, rows = np.full(len(x), np.inf), np.zeros(len(b.n))
    by = max(1, (1 << 17) // len(x))
    for i in range(0, len(p["x"]), by):
        d = x - p["x"][i : i + by, None]
        d *= d
        e = y - p["y"][i : i + by, None]
        e *= e
        d += e
        np.minimum(low, d.min(0), out=low)
        rows += np.sqrt(np.minimum.reduceat(d, b.start, axis=1)).sum(0)
    return [rounded(0.5 * (rows / q.n[k] + np.add.reduceat(np.sqrt(low), b.start) / b.n), 4)]


def dita_distance(queries: DataFrame, trips: DataFrame) -> DataFrame:
    """u1, s1, u2, s2, cost of packed trips with x and y."""
    names = ["x", "y"]
    return over(meeting(queries, trips.where("uid is not null"), names), names, *distances(dita, ["cost"]))


def recurrences(cost: Callable[[int], np.ndarray], a: int, b: Block, hit_m: float, gap_m: float | None) -> list[np.ndarray]:
    """1 - LCS / min length and the edit distance with real penalties, of a trip of a points and each of the block; cost(i) has the costs of point i by place and trip."""
    wide, many = b.padded().shape
    if a * wide * many <= HELD:
        cost = [cost(i) for i in range(a)].__getitem__
    if gap_m is None:
        inside = np.arange(wide)[:, None] < b.n
        gap = sum(np.where(inside, cost(i), 0.0).sum(0) for i in range(a)) / (a * b.n)
    else:
        gap = np.full(many, gap_m)
    lcs, erp = np.zeros((wide + 1, many), np.int32), np.arange(wide + 1)[:, None] * gap
    for i in range(a):
        c = cost(i)
        np.maximum.accumulate(np.where(c <= hit_m, lcs[:-1] + 1, lcs[1:]), axis=0, out=lcs[1:])
        least = np.minimum(erp[:-1] + c, erp[1:] + gap)
        erp[0] = (i + 1) * gap
        for j in range(wide):
            np.minimum(least[j], erp[j] + gap, out=erp[j + 1])
    at = (b.n, np.arange(many))
    return [np.round(1 - lcs[at] / np.minimum(a, b.n), 6), np.round(erp[at] / (a + b.n), 4)]


def sequence_costs(queries: DataFrame, trips: DataFrame, hit_m: float = 200.0, gap_m: float | None = None) -> DataFrame:
    """u1, s1, u2, s2, lcrs, neterp of packed trips with x and y, as sequential.sequence_costs has them."""
    names = ["x", "y"]

    def kernel(q: Block, k: int, b: Block) -> list[np.ndarray]:
        p, x, y = q.trip(k), b.of["x"][b.padded()], b.of["y"][b.padded()]

        def cost(i: int) -> np.ndarray:
            dx, dy = x - p["x"][i], y - p["y"][i]
            return np.sqrt(dx * dx + dy * dy)

        return recurrences(cost, int(q.n[k]), b, hit_m, gap_m)

    return over(meeting(queries, trips, names), names, *distances(kernel, ["lcrs", "neterp"]))


def network_costs(queries: DataFrame, trips: DataFrame, hit_m: float = 1.0) -> DataFrame:
    """u1, s1, u2, s2, lcrs, neterp, tp, dita of packed trips with id; queries also have `row`, the costs from each of their points to every vertex by id."""

    def kernel(q: Block, k: int, b: Block) -> list[np.ndarray]:
        table, ids, a = q.rows_of(k), b.of["id"], int(q.n[k])
        pad = ids[b.padded()]
        i, j, start, m = b.aligned(a)
        low, rows = np.full(len(ids), np.inf), np.zeros(len(b.n))
        for r in table:
            c = r[ids]
            np.minimum(low, c, out=low)
            rows += np.minimum.reduceat(c, b.start)
        tp = np.add.reduceat(table[i, ids[j]], start) / m
        dita = (rows / a + np.add.reduceat(low, b.start) / b.n) / 2
        return [*recurrences(lambda i: table[i][pad], a, b, hit_m, None), np.round(tp, 4), np.round(dita, 4)]

    return over(meeting(queries, trips, ["id"], "row"), ["id"], *distances(kernel, ["lcrs", "neterp", "tp", "dita"]), "row")


def aligned_means(q: Block, k: int, b: Block) -> list[np.ndarray]:
    """The mean distance and the mean hours apart of index-aligned points, NaN where unknown."""
    p, (i, j, start, m) = q.trip(k), b.aligned(int(q.n[k]))
    dx, dy, h = p["x"][i] - b.of["x"][j], p["y"][i] - b.of["y"][j], np.abs(p["t"][i] - b.of["t"][j])
    known = ~np.isnan(h)
    if not known.all():
        with np.errstate(invalid="ignore"):
            h = np.add.reduceat(np.where(known, h, 0.0), start) / np.add.reduceat(known.astype(np.int64), start)
    else:
        h = np.add.reduceat(h, start) / m
    return [np.add.reduceat(np.sqrt(dx * dx + dy * dy), start) / m, h]


def order_statistics(met: DataFrame, names: list[str], kernel: Callable, kinds: int, p: float) -> list[tuple[float, float]]:
    """The least of each of the values of kernel over all pairs, and their exact percentile p, interpolated.

    The bits of the values are counted, sixteen at a time, under the bits already known, and the rest at once where
    FEW values are left; so no more than that many, or 65,536 counts, are held for each bound.
    """
    found: list[list[int]] = [[] for _ in range(kinds)]  # bits known of the least value and of those around the percentile
    left: list[list[int]] = [[] for _ in range(kinds)]  # their ranks among the values with those bits
    share, known, most = [0.0] * kinds, 63, FEW + 1  # the sign is known
    while known:
        shift = 0 if most <= FEW else max(0, known - 16 if known < 63 else 48)
        wanted = [sorted({*x}) if known < 63 else [0] for x in found]

        def task(met, known=known, shift=shift, wanted=wanted) -> Iterator[pa.RecordBatch]:
            size = 1 << (known - shift)
            counts = {(z, x): np.zeros(size if known - shift <= 16 else 0, np.int64) for z in range(kinds) for x in wanted[z]}
            single: dict[tuple[int, int], list[np.ndarray]] = {k: [] for k in counts}
            for q, b in met:
                held = [[x[keep] for x in kernel(q, k, b)] for k in range(len(q.n)) for keep in (_others(q, k, b),)]
                for z in range(kinds):
                    values = np.concatenate([x[z] for x in held])
                    bits = values[~np.isnan(values)].view(np.int64)
                    for x in wanted[z]:
                        here = (bits[bits >> known == x] >> shift) & (size - 1)
                        if known - shift <= 16:
                            counts[z, x] += np.bincount(here, minlength=size)
                        elif len(here):
                            single[z, x].append(here)
            rows = [(z, x, int(key), int(n[key])) for (z, x), n in counts.items() for key in np.flatnonzero(n)]
            rows += [(*k, int(key), int(n)) for k, v in single.items() if v for key, n in zip(*np.unique(np.concatenate(v), return_counts=True))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*rows)) or [()] * 4)], names=["z", "x", "key", "n"])

        counted: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for r in over(met, names, task, "z long, x long, key long, n long").groupBy("z", "x", "key").agg(F.sum("n").alias("n")).orderBy("z", "x", "key").collect():
            counted.setdefault((r["z"], r["x"]), []).append((r["key"], r["n"]))
        most = 0
        for z in range(kinds):
            if known == 63:
                total = sum(n for _, n in counted.get((z, 0), []))
                at = (total - 1) * p
                found[z], left[z], share[z] = ([0] * 3, [0, int(at), min(int(at) + 1, total - 1)], at - int(at)) if total else ([], [], 0.0)
            for k, x in enumerate(found[z]):
                for key, n in counted[z, x]:
                    if left[z][k] < n:
                        found[z][k], most = x << (known - shift) | key, max(most, n)
                        break
                    left[z][k] -= n
        known = shift
    out = []
    for x, f in zip(found, share):
        least, low, high = np.array(x, np.int64).view(np.float64).tolist() if x else [float("nan")] * 3
        out.append((least, low if low == high else (1 - f) * low + f * high))
    return out


def blended_truth(queries: DataFrame, trips: DataFrame) -> DataFrame:
    """u1, s1, u2, s2, cost of packed trips with x, y and t: half spatial, half temporal, each scaled from its minimum to its 99th percentile over all pairs."""
    names = ["x", "y", "t"]
    met = meeting(queries, trips, names)
    (s0, s9), (h0, h9) = order_statistics(met, names, aligned_means, 2, 0.99)

    def kernel(q: Block, k: int, b: Block) -> list[np.ndarray]:
        s, h = aligned_means(q, k, b)
        s, h = (np.fmin(np.fmax((v - lo) / max(hi - lo, 1e-9), 0.0), 1.0) for v, lo, hi in ((s, s0, s9), (h, h0, h9)))
        return [rounded(0.5 * s + 0.5 * h, 6)]

    return over(met, names, *distances(kernel, ["cost"]))
