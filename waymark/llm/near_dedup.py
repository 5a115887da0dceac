"""MinHash near-dedup by tensored banding, with exact verification.

A document's set holds its distinct shingles of `words` words (lower-cased A-Z; with fewer words the whole
sequence as one). Two collections of TABLES bands of ROWS minhashes each are computed, 2 * TABLES * ROWS in all;
every pair of a band of the first and a band of the second collection keys one of TABLES^2 tables. A pair of
similarity s collides unless one of the collections misses: at s = 0.85 that is 2 in 100,000 (at 0.8, with
TABLES = 16, 3 in 100,000); as many tables from independent bands would need TABLES times the minhashes.

1. Equal word sequences are one class; only classes go on, so exact copies cost one row each.
2. A band that no other class shares is dropped before the tables' keys are formed.
3. In each table's bucket, every member is paired with the bucket's least member; verified links join classes
   into components. Buckets whose members then lie in one component hold no further information. What is still
   apart in the others is joined by prefix: with each set ordered from its rarest shingle on, two sets of
   sufficient overlap share a shingle so early that enough of both is left from it on. So no link within a bucket
   is lost, while texts that share a common passage alone meet in no rare shingle and form no pairs.
4. Candidates are verified on full sets of shingles (not hashes of them).
5. Components come from repeated rounds of joining each node to its least neighbour and pointer jumping.

Every step is a written table in the shared folder; hot buckets, bands and shingles are counted by partial
aggregation and joined back, the few largest by a broadcast, and pairs of the classes that share a hot shingle are
formed in SALTS tasks; nothing is gathered. Null and empty texts have empty sets and no links. Each row is judged
by its own text, so rows that repeat get one answer, and a doc_id with several texts is in the component of each of
them, kept where it is that one's least. Rows with a null doc_id are not linked and are kept under a null component.
Columns of other names are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, as_bytes, drop, each_batch, joined, mixed, small, stored, texts

TABLES, ROWS, SALTS = 12, 3, 16
_state: dict[str, object] = {}


def _parameters(n: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(n, dtype=np.uint64)
    return mixed(at, 11) | np.uint64(1), mixed(at, 12)


def shingle_hashes(words: list[bytes], width: int, hashes: WordHashes) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles of a text."""
    if not words:
        return np.empty(0, np.uint64)
    h = hashes(words)
    width = min(width, len(words))
    out = h[: len(h) - width + 1]
    with np.errstate(over="ignore"):
        for k in range(1, width):
            out = mixed(out, 3) * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k]
    return np.unique(mixed(out, width))


def bands(shingles: np.ndarray, tables: int, rows: int) -> np.ndarray:
    """2 * tables 64-bit keys, each of `rows` minhashes."""
    a, b = _parameters(2 * tables * rows)
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 4096):
            least = np.minimum(least, (shingles[None, at : at + 4096] * a[:, None] + b[:, None]).min(1))
        out = np.zeros(2 * tables, np.uint64)
        for k in range(rows):
            out = mixed(out, 5) * np.uint64(0xC2B2AE3D27D4EB4F) + least[k::rows]
    return mixed(out, 6)


def _node(words: list[bytes]) -> int:
    return int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "little", signed=True)


def signatures(docs: DataFrame, width: int, tables: int, rows: int) -> DataFrame:
    """doc_id, node (names the word sequence), n_shingles, keys, h (of the text as it is)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        hashes = _state.setdefault("hashes", WordHashes())
        node, n, keys = [], [], []
        for raw in as_bytes(b.column("text")):
            words = raw.lower().split()
            x = shingle_hashes(words, width, hashes)
            node.append(_node(words))
            n.append(len(x))
            keys.append(bands(x, tables, rows).astype(np.int64) if len(x) else None)
        return pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "node": pa.array(node, pa.int64()), "n_shingles": pa.array(n, pa.int64()), "keys": pa.array(keys, pa.list_(pa.int64())), "h": b.column("h")})

    return texts(docs, F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).mapInArrow(each_batch(run), "doc_id long, node long, n_shingles long, keys array<long>, h long")


def _buckets(classes: DataFrame, tables: int) -> DataFrame:
    """bucket, node, n of all table buckets with two classes or more."""
    slots = classes.select("node", F.posexplode("keys").alias("slot", "key"))
    shared = stored(slots.groupBy("slot", "key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "shared")
    kept = stored(joined(slots, shared, ["slot", "key"], "m").groupBy("node").agg(F.collect_list(F.struct("slot", "key")).alias("bands")), "bands")
    one = F.filter("bands", lambda x: x["slot"] < tables)
    two = F.filter("bands", lambda x: x["slot"] >= tables)
    keys = F.flatten(F.transform(one, lambda x: F.transform(two, lambda y: F.xxhash64(x["slot"], x["key"], y["slot"], y["key"]))))
    rows = stored(kept.select("node", F.explode(keys).alias("bucket")), "keys")
    held = stored(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("hub")).where("m > 1").withColumn("size", F.col("m")), "held")
    return stored(joined(rows, held, ["bucket"], "size").join(classes.select("node", F.col("n_shingles").alias("n")), "node"), "buckets")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, least: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= least * union."""
    pairs = stored(pairs, "pairs")
    needed = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes.select("node", "rep"), "node"), "needed")

    def named(b: pa.RecordBatch) -> pa.RecordBatch:
        words = [raw.lower().split() for raw in as_bytes(b.column("text"))]
        return pa.RecordBatch.from_pydict({"node": pa.array(map(_node, words), pa.int64()), "words": pa.array([b" ".join(w) for w in words], pa.binary())})

    found = texts(docs).join(small(needed.select(F.col("rep").alias("doc_id")).distinct(), 16), "doc_id", "left_semi").mapInArrow(each_batch(named), "node long, words binary").dropDuplicates(["node"])
    found = stored(found, "texts")

    def compare(b: pa.RecordBatch) -> pa.RecordBatch:
        same, last, held = [], None, None
        for a, y, x, z in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), as_bytes(b.column("wa")), as_bytes(b.column("wb"))):
            if y != last:
                last, held = y, _set(z, width)
            mine = _set(x, width)
            both = len(mine & held)
            if 100 * both >= least * (len(mine) + len(held) - both):
                same.append((a, y))
        return pa.RecordBatch.from_pydict({"a": pa.array([s[0] for s in same], pa.int64()), "b": pa.array([s[1] for s in same], pa.int64())})

    both = pairs.join(found.select(F.col("node").alias("a"), F.col("words").alias("wa")), "a").join(found.select(F.col("node").alias("b"), F.col("words").alias("wb")), "b")
    out = stored(both.select("a", "b", "wa", "wb").mapInArrow(each_batch(compare), "a long, b long"), "links")
    drop(found)
    return out


def _set(joined: bytes, width: int) -> set:
    words = joined.split(b" ")
    width = min(width, len(words))
    return {*zip(*(words[k:] for k in range(width)))}


def components(links: DataFrame) -> DataFrame:
    """node, root: of each connected component of the links (a, b), for nodes of links alone."""
    edges = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        parents = stored(edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionAll(edges.select(F.col("a"), F.col("a"))).groupBy("node").agg(F.min("root").alias("root")), "parents")
        while True:  # every parent is smaller, so jumping ends
            jumped = stored(parents.join(parents.select(F.col("node").alias("root"), F.col("root").alias("next")), "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "jumped")
            moved = not jumped.where("moved").isEmpty()
            drop(parents)
            parents = jumped.select("node", "root")
            if not moved:
                break
        if labels is None:
            labels = parents
        else:
            labels = stored(labels.join(parents.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root")), "labels")
        up = lambda c: parents.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        edges = stored(edges.join(up("a"), "a").join(up("b"), "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a <> b").distinct(), "edges")
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)


def _apart(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Buckets of three classes or more whose members are in different components, with each member's component."""
    rows = buckets.where("m > 2").join(labels, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    mixed_ = rows.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("bucket")
    return stored(rows.join(mixed_, "bucket"), "apart")


def _by_prefix(apart: DataFrame, classes: DataFrame, docs: DataFrame, width: int, least: int) -> DataFrame:
    """Pairs (a, b) of the classes, of different components, whose prefixes allow 100 * intersection >= least * union."""
    nodes = stored(apart.select("node", "comp", "n").distinct().join(classes.select("node", "rep"), "node"), "needed")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        hashes = _state.setdefault("hashes", WordHashes())
        words = [raw.lower().split() for raw in as_bytes(b.column("text"))]
        tokens = [shingle_hashes(w, width, hashes).astype(np.int64) for w in words]
        return pa.RecordBatch.from_pydict({"node": pa.array(map(_node, words), pa.int64()), "tokens": pa.array(tokens, pa.list_(pa.int64()))})

    sets = texts(docs).join(small(nodes.select(F.col("rep").alias("doc_id")).distinct(), 16), "doc_id", "left_semi").mapInArrow(each_batch(run), "node long, tokens array<long>").dropDuplicates(["node"])
    tokens = stored(sets.join(small(nodes.select("node"), 16), "node", "left_semi").select("node", F.explode("tokens").alias("token")), "tokens")
    held = stored(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("f")).where("f > 1").withColumn("size", F.col("f")), "held")  # what a set holds alone comes first in it and joins nothing
    ordered = joined(tokens, held, ["token"], "size").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("f", "token"))).alias("rare")).join(nodes, "node")
    left = lambda n, p, m: (n - p) * (100 + least) >= (n + m) * least  # noqa: E731  enough is left of n from position p on
    rows = ordered.select("node", "comp", "n", F.posexplode("rare").alias("k", "x"), (F.col("n") - F.size("rare")).alias("alone"))
    rows = rows.select("node", "comp", "n", (F.col("k") + F.col("alone")).alias("p"), F.col("x")["token"].alias("token"))
    rows = stored(rows.where(left(F.col("n"), F.col("p"), F.ceil(F.col("n") * least / 100))), "prefixes")
    shared = stored(rows.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("size")).where("x <> y").select("token", "size"), "shared")
    rows = stored(joined(rows, shared, ["token"], "size"), "prefixes")
    drop(tokens)
    hot = F.broadcast(shared.where(F.col("size") > (shared.agg(F.sum("size")).first()[0] or 0) / 1024).select("token", F.lit(SALTS).alias("salts")))  # under 1,024 of them
    rows = rows.join(hot, "token", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    one = rows.where(left(F.col("n"), F.col("p"), F.col("n"))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).alias("s")  # the set that isn't the larger
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("node"), "salts").cast("int"))
    c = lambda x: F.col(x)
    after = (c("s.n") < c("l.n")) | ((c("s.n") == c("l.n")) & (c("s.node") < c("l.node")))
    fits = (c("s.n") * 100 >= c("l.n") * least) & left(c("s.n"), c("s.p"), c("l.n")) & left(c("l.n"), c("l.p"), c("s.n"))
    both = one.join(rows.alias("l"), (c("s.token") == c("l.token")) & (c("s.salt") == c("l.salt")) & (c("s.comp") != c("l.comp")) & after & fits)
    return both.select(F.least("s.node", "l.node").alias("a"), F.greatest("s.node", "l.node").alias("b")).distinct()


def cluster(docs: DataFrame, width: int = 3, least: int = 85, tables: int = TABLES, rows: int = ROWS, hashes: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: links of at least `least` hundredths; with hashes also h, xxhash64 of each row's text (null: empty)."""
    sig = stored(signatures(docs, width, tables, rows), "signatures")
    classes = stored(sig.where("n_shingles > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("keys").alias("keys")), "classes")
    buckets = _buckets(classes, tables)
    near = lambda x, y: F.least(x, y) * 100 >= least * F.greatest(x, y)  # noqa: E731  else no sets of these sizes are similar
    sizes = classes.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"))
    star = buckets.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"), "n").distinct().join(sizes, "b").where(near(F.col("n"), F.col("nb")))
    tried = stored(star.select("a", "b"), "tried")
    links = verified(tried, classes, docs, width, least)
    labels = components(links)
    apart = _apart(buckets, labels)
    if not apart.isEmpty():
        tried = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = _by_prefix(apart, classes, docs, width, least).join(tried, ["a", "b"], "left_anti")
        labels = components(links.unionAll(verified(pairs, classes, docs, width, least)))
    names = classes.select("node", "rep").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least_of = stored(names.groupBy("root").agg(F.min("rep").alias("component")), "components")
    named = stored(names.join(least_of, "root").select("node", "component"), "named")
    out = sig.select("doc_id", "node", "n_shingles", "h").join(named, "node", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), *["h"][: int(hashes)])
