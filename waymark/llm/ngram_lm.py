"""Language-model scoring: an interpolated modified Kneser-Ney bigram model, counted in Spark over all training texts.

Files of the model, in the shared folder (all sorted arrays or arrays by word id, memory-mapped by the workers;
no worker holds the whole model):
  words-S.h, words-S.n   sorted 64-bit hashes of the distinct tokens of one hash range, and their counts; a
                         token's id is its place in all ranges together
  pairs-S.k, pairs-S.n   sorted keys (first id << 32 | second id) of one share of the bigrams, and their counts
  heads-S.k, heads-S.n   first ids of that share, with the sum of counts and the numbers of counts 1, 2 and 3+
  before-S               for a range of ids, the number of distinct tokens that stand before each
  hot.k, hot.n           the ids of the hot first tokens, and their sums
Bigrams are dealt by their first token; hot first tokens, which hold over half a share's bigrams ("the"), are dealt
by both, and their sums are merged. Each partition counts its own bigrams before anything is shuffled, and keys
travel as compressed differences. Vocabulary, counts and discounts cover every training text. The driver and the
broadcast hold sizes, discounts and one number for each 2^19 distinct tokens; all else is in the files.

P(w | v) = (c(v w) - D(c)) / c(v .) + g(v) P1(w), P1(w) = (b(w) - D1(b)) / B + g1 / (V + 1), b(w) the distinct
tokens before w, B their sum; D has three values by the counts of counts, as in Chen and Goodman. A text ends
with one end token and starts after a start sign that is never predicted. Tokens that training lacks share
the uniform part g1 / (V + 1).

Null and empty texts hold the end token alone. Without training texts, V = N = 0 and every probability is 1.
Rows that repeat count as often as they stand there. Equality of tokens is that of 64-bit hashes.
"""

from __future__ import annotations

import io
import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, as_bytes, drop, each_batch, mixed, remainder, shared_path, stored, texts

END = 32  # the end token goes by the hash of a blank, which no word holds
RANGE_WORDS = 1 << 19
SHARE_TOKENS = 1 << 22
BLOCK_IDS = 1 << 20
#: Bytes of text that a worker handles at once, distinct tokens or bigrams that it holds before it sends their counts on, and places in a word for which it holds its numbers.
SLICE_BYTES, HELD, PLACES = 1 << 22, 1 << 21, 64
_open: dict[str, object] = {}
_tables: list[np.ndarray] = []


def write_array(path: str, x: np.ndarray) -> None:
    """Whole or not at all: another attempt writes the same bytes."""
    store, at = fs.FileSystem.from_uri(path)
    part = f"{at}.{uuid.uuid4().hex}"
    buffer = io.BytesIO()
    np.save(buffer, x)
    store.create_dir(at.rsplit("/", 1)[0])
    with store.open_output_stream(part) as f:
        f.write(buffer.getvalue())
    store.move(part, at)


def read_array(path: str) -> np.ndarray | None:
    """The array memory-mapped; from a remote store by way of a local file that is unlinked at once, so nothing of it is left to others. None if there is none."""
    import os
    import tempfile

    store, at = fs.FileSystem.from_uri(path)
    if store.get_file_info(at).type == fs.FileType.NotFound:
        return None
    if isinstance(store, fs.LocalFileSystem):
        return np.load(at, mmap_mode="r")
    f, local = tempfile.mkstemp()
    os.close(f)
    with store.open_input_stream(at) as source, open(local, "wb") as target:
        while chunk := source.read(1 << 22):
            target.write(chunk)
    out = np.load(local, mmap_mode="r")
    os.unlink(local)
    return out


def packed(x: np.ndarray) -> bytes:
    """Sorted or small numbers as compressed byte planes of their differences."""
    d = np.diff(x.astype(np.uint64), prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _blobs(column) -> np.ndarray:
    return np.concatenate([unpacked(x) for x in column.to_pylist()]) if len(column) else np.empty(0, np.uint64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Shards:
    """Sorted arrays cut into shards, opened when first met."""

    def __init__(self, folder: str):
        self.folder, self.open = folder, {}

    def __getitem__(self, name: str) -> np.ndarray | None:
        """The array of this name; None for a share that nothing was dealt to."""
        if name not in self.open:
            self.open[name] = read_array(f"{self.folder}/{name}.npy")
        return self.open[name]


class Words:
    """Ids of tokens, -1 for those that training lacks."""

    def __init__(self, folder: str, shift: int, ranges: list[tuple[int, int, int]]):
        self.shards, self.shift = Shards(folder), shift
        self.ranges = {s: (start, n) for s, start, n in ranges}
        self.names, self.starts = [s for s, _, _ in ranges], np.array([start for _, start, _ in ranges], np.int64)

    def ids(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the distinct hashes, in order, and where each of h is among them."""
        h, back = np.unique(h, return_inverse=True)
        out = np.full(len(h), -1, np.int64)
        shard = h >> self.shift
        cuts = np.flatnonzero(np.diff(shard, prepend=shard[0] - 1 if len(h) else 0))
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(h)]):
            s = int(shard[lo])
            if s in self.ranges:
                have = self.shards[f"words{s}.h"]
                hit = np.minimum(np.searchsorted(have, h[lo:hi]), len(have) - 1)
                out[lo:hi] = np.where(have[hit] == h[lo:hi], self.ranges[s][0] + hit, -1)
        return out, back

    def counts(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        of = np.searchsorted(self.starts, ids, "right") - 1
        for k in np.unique(of[ids >= 0]).tolist():
            at = np.flatnonzero((of == k) & (ids >= 0))
            out[at] = self.shards[f"words{self.names[k]}.n"][ids[at] - self.starts[k]]
        return out


def hashed(texts_: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of all tokens of texts, end tokens among them, the text of each, and whether it is the first of its text.

    A word's hash is the sum of random numbers for its bytes and their places, worked out for all words at once.
    """
    if not _tables:
        space = np.zeros(256, bool)
        space[list(SPACES)] = True
        _tables.extend((space, mixed(np.arange(PLACES * 256), 41)))
    space, numbers = _tables
    k = len(texts_)
    c = np.frombuffer(b"\n".join(texts_).lower(), np.uint8)
    word = ~space[c]
    begin = np.flatnonzero(word & ~np.concatenate(([False], word[:-1])))
    size = np.flatnonzero(word & ~np.concatenate((word[1:], [False]))) + 1 - begin
    heads = np.cumsum(size) - size
    at = np.arange(int(size.sum())) - np.repeat(heads, size)
    at = (at << 8) + c[word]
    far = np.flatnonzero(at >= PLACES << 8)
    values = numbers[np.where(at < PLACES << 8, at, 0)] if len(far) else numbers[at]
    values[far] = mixed(at[far], 41)
    h = np.add.reduceat(values, heads).view(np.int64) if len(begin) else np.empty(0, np.int64)
    offset = np.cumsum([0, *(len(t) + 1 for t in texts_[:-1])]) if k else np.empty(0, np.int64)
    of = np.searchsorted(offset, begin, "right") - 1
    sizes = np.bincount(of, minlength=k) + 1
    out = np.empty(len(h) + k, np.int64)
    out[np.arange(len(h)) + of] = h
    out[np.cumsum(sizes) - 1] = numbers.view(np.int64)[END]
    first = np.zeros(len(out), bool)
    first[np.cumsum(sizes) - sizes] = True
    return out, np.repeat(np.arange(k), sizes), first


def _slices(batch: list[bytes]):
    """Texts of a batch, SLICE_BYTES or so at once."""
    held, n = [], 0
    for raw in batch:
        held.append(raw)
        n += len(raw) + 1
        if n >= SLICE_BYTES:
            yield held
            held, n = [], 0
    if held:
        yield held


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2 and D3+ from the numbers of counts 1 to 4; usual values where these are lacking."""
    if not all(n):
        return 0.5, 0.75, 0.9
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.01), k - 0.01) for k in (1, 2, 3))


class Model:
    """What all workers need to know of the files: where they are, sizes and discounts."""

    def __init__(self, **known):
        self.__dict__ |= known

    def shards(self) -> Shards:
        return _open.setdefault(f"{self.folder} pairs", Shards(self.folder))

    @property
    def hot(self) -> np.ndarray:
        return self.shards()["hot.k"]

    def words(self) -> Words:
        return _open.setdefault(f"{self.folder} words", Words(self.folder, self.shift, self.ranges))

    def share(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The share that a bigram is dealt to."""
        hot = np.isin(first, self.hot)
        return (mixed(np.where(hot, first * 0x9E3779B1 + second, first).astype(np.uint64), 21) % np.uint64(self.shares)).astype(np.int64)

    def first_part(self, ids: np.ndarray, shards: Shards) -> np.ndarray:
        """P1 of each id, and of -1."""
        b = np.zeros(len(ids), np.int64)
        block = ids // BLOCK_IDS
        for k in np.unique(block[ids >= 0]).tolist():
            at = np.flatnonzero((block == k) & (ids >= 0))
            b[at] = shards[f"before{k}"][ids[at] - k * BLOCK_IDS]
        d = np.array([0.0, *self.d1])
        return (np.maximum(b - d[np.minimum(b, 3)], 0) + self.left1 / (self.v + 1)) / max(1, self.types)

    def log_p(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """log10 P(second | first) by ids; distinct bigrams are looked up once, in order."""
        if not self.v:
            return np.zeros(len(first))
        shards = self.shards()
        p = self.first_part(second, shards)
        known = np.flatnonzero(first >= 0)
        if len(known):
            f, s = first[known], second[known]
            c, total, left = np.zeros(len(f), np.int64), np.zeros(len(f)), np.ones(len(f))
            shares, heads = self.share(f, s), None
            keys = f.astype(np.uint64) << np.uint64(32) | np.where(s < 0, 0xFFFFFFFF, s).astype(np.uint64)
            d = np.array(self.d2)
            for k in np.unique(shares).tolist():
                at, have = np.flatnonzero(shares == k), shards[f"pairs{k}.k"]
                if have is None:
                    continue
                place = np.minimum(np.searchsorted(have, keys[at]), len(have) - 1)
                c[at] = np.where(have[place] == keys[at], shards[f"pairs{k}.n"][place], 0)
                heads = shards[f"heads{k}.k"]
                if len(heads):
                    place = np.minimum(np.searchsorted(heads, f[at]), len(heads) - 1)
                    row = np.where((heads[place] == f[at])[:, None], shards[f"heads{k}.n"][place], 0)
                    total[at], left[at] = row[:, 0], row[:, 1:] @ d
            at = np.flatnonzero(np.isin(f, self.hot))
            if len(at):
                rows = shards["hot.n"][np.searchsorted(self.hot, f[at])]
                total[at], left[at] = rows[:, 0], rows[:, 1:] @ d
            seen = total > 0
            d0 = np.array([0.0, *self.d2])
            total = np.maximum(total, 1)
            p[known] = np.where(seen, (np.maximum(c - d0[np.minimum(c, 3)], 0) + left * p[known]) / total, p[known])
        return np.log10(p)


def train(docs: DataFrame) -> Model:
    """From every row of docs."""
    spark, rows = docs.sparkSession, texts(docs).select("text")
    folder = shared_path(spark, "lm")

    def count_words(batches):
        h, n = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in batches:
            for part in _slices(as_bytes(b.column("text"))):
                new, count = np.unique(hashed(part)[0], return_counts=True)
                h, n = summed(np.concatenate((h, new)), np.concatenate((n, count)))
                if len(h) > HELD:
                    yield pa.RecordBatch.from_pydict({"h": pa.array(h), "n": pa.array(n)})
                    h, n = h[:0], n[:0]
        if len(h):
            yield pa.RecordBatch.from_pydict({"h": pa.array(h), "n": pa.array(n)})

    words = stored(rows.mapInArrow(count_words, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "words")
    v, n = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = max(0, math.ceil(math.log2(max(1, v) / RANGE_WORDS)))
    shift = 64 - bits if bits else 63

    def write_words(t: pa.Table) -> pa.Table:
        t = t.sort_by("h")
        s = t.column("s")[0].as_py()
        write_array(f"{folder}/words{s}.h.npy", t.column("h").to_numpy())
        write_array(f"{folder}/words{s}.n.npy", t.column("n").to_numpy())
        return pa.table({"s": pa.array([s], pa.int64()), "m": pa.array([t.num_rows], pa.int64())})

    cut = F.shiftright("h", shift)
    got = sorted((x["s"], x["m"]) for x in words.withColumn("s", cut.cast("long")).groupBy("s").applyInArrow(write_words, "s long, m long").collect())
    starts = np.cumsum([0, *(m for _, m in got)])
    m = Model(folder=folder, v=v, n=n, shift=shift, ranges=[(s, int(a), c) for (s, c), a in zip(got, starts)], shares=max(1, math.ceil(n / SHARE_TOKENS)), d1=(0.5, 0.75, 0.9), d2=(0.5, 0.75, 0.9), types=0, left1=0.0)
    if not v:
        return m
    sent = spark.sparkContext.broadcast(m)

    def write_hot(batches):
        lookup, found = sent.value.words(), [v]  # v: the start sign
        for b in batches:
            for h in b.column("h").drop_null().to_pylist():
                start, _ = lookup.ranges[h >> shift]
                found.append(start + int(np.searchsorted(lookup.shards[f"words{h >> shift}.h"], h)))
        write_array(f"{folder}/hot.k.npy", np.array(sorted(found), np.int64))
        yield pa.RecordBatch.from_pydict({"m": pa.array([len(found)], pa.int64())})

    none = spark.range(1).select(F.lit(None).cast("long"))  # so that the task runs even where no token is hot
    words.where(F.col("n") > max(n / m.shares / 2, 1)).select("h").unionAll(none).repartition(1).mapInArrow(write_hot, "m long").collect()
    drop(words)

    def count_pairs(batches):
        model, held, counts, size = sent.value, [], [], 0

        def dealt():
            keys, c = summed(np.concatenate(held), np.concatenate(counts))
            share = model.share((keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64))
            order = np.argsort(share, kind="stable")
            cuts = np.flatnonzero(np.diff(share[order], prepend=-1))
            parts = np.split(order, cuts[1:])
            return pa.RecordBatch.from_pydict({"share": pa.array(share[order][cuts], pa.int64()), "keys": pa.array([packed(keys[p]) for p in parts], pa.binary()), "counts": pa.array([packed(c[p]) for p in parts], pa.binary())})

        for b in batches:
            for part in _slices(as_bytes(b.column("text"))):
                h, _, first = hashed(part)
                ids, back = model.words().ids(h)
                ids = ids[back]
                before = np.where(first, model.v, np.concatenate(([0], ids[:-1])))
                keys, c = np.unique(before.astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64), return_counts=True)
                held.append(keys)
                counts.append(c)
                size += len(keys)
                if size > HELD:
                    yield dealt()
                    held, counts, size = [], [], 0
        if held:
            yield dealt()

    def write_pairs(t: pa.Table) -> pa.Table:
        model, s = sent.value, t.column("share")[0].as_py()
        keys, c = summed(_blobs(t.column("keys")), _blobs(t.column("counts")).astype(np.int64))
        write_array(f"{folder}/pairs{s}.k.npy", keys)
        write_array(f"{folder}/pairs{s}.n.npy", c.astype(np.uint32) if c.max() < 1 << 32 else c)
        first, second = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        at = np.flatnonzero(np.diff(first, prepend=-1))
        sums = np.stack([np.add.reduceat(x.astype(np.int64), at) for x in (c, c == 1, c == 2, c > 2)], 1)
        heads = first[at]
        is_hot = np.isin(heads, model.hot)
        write_array(f"{folder}/heads{s}.k.npy", heads[~is_hot])
        write_array(f"{folder}/heads{s}.n.npy", sums[~is_hot])
        out = [(0, s, 0, [int((c == k).sum()) for k in (1, 2, 3, 4)], None, None)]
        out += [(1, s, int(h), row.tolist(), None, None) for h, row in zip(heads[is_hot], sums[is_hot])]
        ids, b = np.unique(second, return_counts=True)
        for k in np.unique(ids // BLOCK_IDS).tolist():
            here = ids // BLOCK_IDS == k
            out.append((2, s, k, [], packed(ids[here]), packed(b[here])))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary())
        return pa.table({name: pa.array(col, kind) for name, kind, col in zip(("kind", "share", "at", "sums", "ids", "counts"), kinds, zip(*out))})

    got = stored(rows.mapInArrow(count_pairs, "share long, keys binary, counts binary").groupBy("share").applyInArrow(write_pairs, "kind int, share long, at long, sums array<long>, ids binary, counts binary"), "shares")

    def write_before(t: pa.Table) -> pa.Table:
        k = t.column("at")[0].as_py()
        ids, b = _blobs(t.column("ids")), _blobs(t.column("counts"))
        out = np.zeros(min(BLOCK_IDS, v - k * BLOCK_IDS), np.int64)
        np.add.at(out, ids.astype(np.int64) - k * BLOCK_IDS, b.astype(np.int64))
        write_array(f"{folder}/before{k}.npy", out.astype(np.uint32))
        return pa.table({"sums": pa.array([[int((out == c).sum()) for c in (1, 2, 3, 4)] + [int(out.sum()), int((out > 2).sum())]], pa.list_(pa.int64()))})

    def write_hot_sums(batches):
        hot = sent.value.hot
        out = np.zeros((len(hot), 4))
        for b in batches:
            at = np.searchsorted(hot, b.column("at").to_numpy())
            out[at] = np.array(b.column("sums").to_pylist(), float).reshape(-1, 4)
        write_array(f"{folder}/hot.n.npy", out)
        yield pa.RecordBatch.from_pydict({"m": pa.array([len(hot)], pa.int64())})

    add = lambda k: F.array(*(F.sum(F.col("sums")[i]) for i in range(k))).alias("sums")
    m.d2 = _discounts(got.where("kind = 0").agg(add(4)).first()[0])
    got.where("kind = 1").groupBy("at").agg(add(4)).repartition(1).mapInArrow(write_hot_sums, "m long").collect()
    ones = got.where("kind = 2").groupBy("at").applyInArrow(write_before, "sums array<long>").agg(add(6)).first()[0]
    m.d1, m.types = _discounts(ones[:4]), ones[4]
    m.left1 = m.d1[0] * ones[0] + m.d1[1] * ones[1] + m.d1[2] * ones[5]
    return m


def score(docs: DataFrame, model: Model, *more) -> DataFrame:
    """doc_id and `more`, n_tokens, n_known, train_tokens, base_score (add-one unigrams), score (log10 probability), perplexity."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        m, parts = sent.value, []
        words = m.words()
        for part in _slices(as_bytes(b.column("text"))):
            h, of, first = hashed(part)
            distinct, back = words.ids(h)
            ids, c = distinct[back], words.counts(distinct)
            base = np.log10((c + 1) / (m.n + m.v + 1))[back]
            before = np.where(first, m.v, np.concatenate(([-1], ids[:-1])))
            keys, where = np.unique(before << 32 | ids & 0xFFFFFFFF, return_inverse=True)
            second = keys & 0xFFFFFFFF
            p = m.log_p(keys >> 32, np.where(second == 0xFFFFFFFF, -1, second))[where]
            total = lambda x: np.bincount(of, x, len(part))
            n, log = np.bincount(of, minlength=len(part)), total(p)
            parts.append((n, total((c > 0)[back]).astype(np.int64), np.full(len(part), m.n), total(base), log, 10 ** np.minimum(-log / n, 300)))
        out = b.drop_columns(["text"])
        for name, col in zip(names, map(np.concatenate, zip(*parts))):
            out = out.append_column(name, pa.array(col, pa.float64() if col.dtype.kind == "f" else pa.int64()))
        return out

    rows = texts(docs, *more)
    schema = rows.drop("text").schema
    for name in names:
        schema = schema.add(name, "long" if name[0] in "nt" else "double")
    return rows.mapInArrow(each_batch(run), schema)


def scored(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    fold = remainder("doc_id", folds)
    return score(docs, train(docs.where(fold != held)), (fold == held).alias("held_out"))
