"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may differ from a passage of a text by k = m * ERROR_RATE edits. Split into k + 1
pieces, it leaves one piece untouched in any such passage. One automaton finds all exact hits of all pieces in
a single pass over each whole text, and Myers' bit-parallel distance verifies the passage around each hit.
Items and texts are compared in lower case with every run of white space as one blank.

The items are a stated query set: they are sent to all texts in blocks of BLOCK_CHARS characters, so what the
driver, the broadcast and the workers hold stays bounded however many items there are; with more than one block,
each block's finds are a written table and its broadcast goes before the next one comes. Null and empty texts
match nothing; null and blank items are left out, items equal in folded form are one, named by the least item_id
(an item of one piece must occur exactly). Rows that repeat are each answered; other columns of docs are kept by
without() and left out by scan().
"""

from __future__ import annotations

import uuid
from functools import reduce
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_batch, nested, stored, texts

ERROR_RATE = 0.08
BLOCK_CHARS = 4_000_000
_built: dict[str, "Matcher"] = {}


def folded(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, rate: float = ERROR_RATE) -> tuple[int, list[tuple[int, str]]]:
    """The error budget, and its budget + 1 pieces with their offsets."""
    k = int(len(item) * rate)
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return k, [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def distance_within(peq: dict[str, int], m: int, text: str, most: int) -> int | None:
    """The least edit distance of the item from any substring of text, if at most `most` (Myers 1999)."""
    ones, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, left = ones, 0, m, m, len(text)
    get = peq.get
    for c in text:
        eq = get(c, 0)
        x = eq | down
        d0 = (((eq & up) + up) ^ up) | x
        right_up, right_down = down | ~(d0 | up) & ones, up & d0
        if right_up & top:
            score += 1
        elif right_down & top:
            score -= 1
            best = min(best, score)
        left -= 1
        if score - left > most and best > most:
            return None
        right_up, right_down = right_up << 1 & ones, right_down << 1 & ones
        up, down = right_down | ~(d0 | right_up) & ones, right_up & d0
    return best if best <= most else None


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE):
        import ahocorasick

        self.items = []
        where: dict[str, list[tuple[int, int]]] = {}
        for key, item in items:
            k, cut = pieces(item, rate)
            self.items.append((key, item, k, masks(item)))
            for at, piece in cut:
                where.setdefault(piece, []).append((len(self.items) - 1, at + len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, places)
        self.automaton.make_automaton()

    def match(self, text: str) -> list[tuple[int, int]]:
        """(item key, distance) of each item within its budget of a passage."""
        text = folded(text)
        if not self.items or not text:
            return []
        spots: dict[int, set[int]] = {}
        for end, places in self.automaton.iter(text):
            for i, after in places:
                spots.setdefault(i, set()).add(end + 1 - after)
        out = []
        for i, starts in spots.items():
            key, item, k, peq = self.items[i]
            best, done = None, -1
            for s in sorted(starts):
                begin, end = max(0, s - k, done - len(item) - 2 * k), min(len(text), s + len(item) + k)
                if end <= done:
                    continue
                if text[s : s + len(item)] == item and s >= 0:
                    best = 0
                    break
                d = distance_within(peq, len(item), text[begin:end], k if best is None else best - 1)
                best, done = d if d is not None else best, end
                if best == 0:
                    break
            if best is not None:
                out.append((key, best))
        return sorted(out)


def blocks(benchmark: DataFrame, most: int = BLOCK_CHARS):
    """Distinct folded items, keyed by their least item_id, in blocks of bounded size."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"item_id": b.column("item_id"), "item": pa.array(map(folded, b.column("text").to_pylist()), pa.string())})

    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(each_batch(run), "item_id long, item string")
    block, size = [], 0
    for row in items.where("item <> ''").groupBy("item").agg(F.min("item_id").alias("item_id")).orderBy("item_id", "item").toLocalIterator():
        block.append((row["item_id"], row["item"]))
        size += len(row["item"])
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def _found(rows: DataFrame, block: list[tuple[int, str]], rate: float):
    """rows with `found`: `id:distance` of the block's items in the column text; and the broadcast to be removed in the end."""
    sent, key = rows.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        if key not in _built:
            _built.clear()
            _built[key] = Matcher(sent.value, rate)
        found = [",".join(f"{k}:{d}" for k, d in _built[key].match(t)) for t in b.column("text").to_pylist()]
        return b.drop_columns(["text"]).append_column("found", pa.array(found, pa.string()))

    return rows.mapInArrow(each_batch(run), rows.drop("text").schema.add("found", "string")), sent


def _marked(docs: DataFrame, benchmark: DataFrame, rate: float, text: str = "text") -> DataFrame:
    """row (all columns of docs) and found: `id:distance` of the items in its text, in order of id."""
    rows = docs.select(nested(docs).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    each = blocks(benchmark)
    first, second = next(each, None), next(each, None)
    if second is None:
        return _found(rows, first, rate)[0] if first else rows.select("row", F.lit("").alias("found"))
    key = F.xxhash64("text"), F.length("text").alias("n")
    distinct = stored(rows.select("text", key[0].alias("h"), key[1]).dropDuplicates(["h", "n", "text"]), "texts")
    parts = []
    for block in chain((first, second), each):
        found, sent = _found(distinct.select("h", "n", "text"), block, rate)
        parts.append(stored(found.where("found <> ''"), "items"))
        sent.destroy()
    found = reduce(DataFrame.unionAll, parts).groupBy("h", "n").agg(F.array_join(F.transform(F.array_sort(F.transform(F.flatten(F.collect_list(F.split("found", ","))), lambda x: F.struct(F.split(x, ":")[0].cast("long").alias("k"), x.alias("x")))), lambda x: x["x"]), ",").alias("found"))
    return rows.withColumns({"h": key[0], "n": key[1]}).join(found, ["h", "n"], "left").select("row", F.coalesce("found", F.lit("")).alias("found"))


def scan(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """doc_id, contaminated, n_items, items: `id:distance` in order of id, comma-joined."""
    rows = _marked(texts(docs), benchmark, rate)
    n = F.when(F.col("found") == "", 0).otherwise(F.size(F.split("found", ","))).cast("long")
    return rows.select("row.doc_id", (F.col("found") != "").alias("contaminated"), n.alias("n_items"), F.col("found").alias("items"))


def without(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """The rows of docs that hold no item."""
    return _marked(docs, benchmark, rate).where(F.col("found") == "").select("row.*")
