"""Line dedup: repeated runs of lines found by a suffix array over line IDs, built by distributed prefix doubling.

A line is deleted if some run of consecutive lines that holds it has MIN_WORDS words or more and stands
earlier too (in order of doc_id, then place). Nothing else is deleted, so the first copy of every run stays.

1. Lines (trimmed; blank ones take no part) become 128-bit hashes; only lines that occur twice matter, and
   of them only stretches of MIN_WORDS words. Their hashes in sorted order give the ranks of length 1.
2. Prefix doubling: the ranks of length 2h are the sorted pairs of ranks of length h at i and i + h. Suffixes
   whose pair is unique are discarded: their longest common prefix with any other is shorter than 2h. As every
   line has a word, no order beyond MIN_WORDS lines is needed.
3. The least run from i with MIN_WORDS words, and the least that ends at i, of l lines, is named by l and two
   overlapping ranks. Suffixes with one name are an interval of the suffix array with a common prefix of l
   lines; all but the first of an interval are later copies. The union of these least runs is exactly the
   union of all maximal repeated runs that are long enough and not first.

DataFrame operations only. Each round is cut by a table written to the shared folder. Intervals are counted
by partial aggregation and joined back, the few that hold over a thousandth of the rows by a broadcast, so no
task gathers a group. A document's lines are handled in one task, in linear time. Null and empty texts stay;
rows that repeat (equal doc_id and text) are one document and get one answer; a null doc_id comes last.
Equality of lines is that of 128-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, fresh, joined, nested, stored

MIN_WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"
_LAST = (1 << 63) - 1


def _named(key: str, text: str):
    """d, t: what a document goes by."""
    return F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("d"), F.xxhash64(F.col(text)).alias("t")


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """d, t: the document; i: the line's place among lines with a word; pos: among all; h1, h2, words."""
    numbered = F.filter(F.transform(F.split(F.col(text), "\n", -1), lambda x, i: F.struct(i.alias("pos"), F.btrim(x, F.lit(" \t\r\f\u000b")).alias("line"))), lambda x: x["line"] != "")
    rows = docs.select(*_named(key, text), F.posexplode(numbered).alias("i", "x"))
    line = F.col("x.line")
    return rows.select("d", "t", "i", F.col("x.pos").alias("pos"), F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"), F.regexp_count(line, F.lit(WORD)).alias("words"))


def _ranked(groups: DataFrame, *by: str) -> DataFrame:
    """groups with r, a number in the order of `by`; written, so that a retry can't number anew."""
    return stored(groups.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("r", F.monotonically_increasing_id()), "ranks")


def _least_runs(rows: DataFrame, min_words: int) -> DataFrame:
    """d, t, i, n: the least run of min_words words from each place, and the least to each place. All frames grow from one end, so a stretch takes linear time."""
    w = Window.partitionBy("d", "t", "stretch")
    before = F.sum("words").over(w.orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("c", F.coalesce(before, F.lit(0)).cast("long")).withColumn("e", (F.col("c") + F.col("words")).cast("long"))
    next_ = F.min("i").over(w.orderBy(F.desc("c")).rangeBetween(Window.unboundedPreceding, -min_words))
    ends = F.max("i").over(w) + 1
    total = F.max("e").over(w)
    stop = F.coalesce(next_, F.when(total - F.col("c") >= min_words, ends))
    last = F.max("i").over(w.orderBy("e").rangeBetween(Window.unboundedPreceding, -min_words))
    start = F.coalesce(last + 1, F.when(F.col("e") >= min_words, F.min("i").over(w)))
    found = rows.withColumns({"stop": stop, "start": start})
    runs = F.array(F.struct(F.col("i").alias("i"), (F.col("stop") - F.col("i")).alias("n")), F.struct(F.col("start").alias("i"), (F.col("i") + 1 - F.col("start")).alias("n")))
    return found.select("d", "t", F.explode(runs).alias("x")).select("d", "t", "x.i", "x.n").where("n is not null and i is not null").distinct()


def _covered(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """The rows that some run covers: a run counts up where it begins and down where it has ended."""
    ends = runs.select("d", "t", "i", F.lit(1).alias("more")).unionAll(runs.select("d", "t", F.col("i") + F.col("n"), F.lit(-1)))
    ends = ends.groupBy("d", "t", "i").agg(F.sum("more").alias("more")).select("d", "t", "i", F.lit(None).cast("int").alias("pos"), "more")
    both = rows.select("d", "t", "i", "pos", F.lit(0).cast("long").alias("more")).unionAll(ends)
    over = F.sum("more").over(Window.partitionBy("d", "t").orderBy("i").rangeBetween(Window.unboundedPreceding, 0))
    return both.withColumn("over", over).where("pos is not null and over > 0").select("d", "t", "pos")


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """d, t, deleted: sorted numbers of the lines to delete, for each document that has any."""
    lines = stored(_lines(docs, key, text), "lines")
    ids = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    ids = _ranked(ids, "h1", "h2")
    of_doc = Window.partitionBy("d", "t")
    rows = joined(lines, ids, ["h1", "h2"], "m").select("d", "t", "i", "pos", "words", "r").distinct()
    rows = rows.withColumn("stretch", F.col("i") - F.row_number().over(of_doc.orderBy("i")))
    rows = rows.withColumn("sum", F.sum("words").over(Window.partitionBy("d", "t", "stretch"))).where(F.col("sum") >= min_words).drop("sum")
    rows = stored(rows, "places")
    levels, level, h = [rows.select("d", "t", "i", "r", F.lit(0).alias("level"))], rows.select("d", "t", "i", "r"), 1
    while 2 * h <= min_words:
        ahead = F.first("r").over(of_doc.orderBy("i").rangeBetween(h, h))
        pairs = stored(level.withColumn("r2", ahead).where("r2 is not null").withColumnRenamed("r", "r1"), "pairs")
        groups = _ranked(pairs.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "r1", "r2")
        level = stored(joined(pairs, groups, ["r1", "r2"], "m").select("d", "t", "i", "r"), "level")
        drop(pairs)
        if level.isEmpty():
            break
        h *= 2
        levels.append(level.withColumn("level", F.lit(len(levels))))
    table = levels[0]
    for x in levels[1:]:
        table = table.unionByName(x)
    runs = _least_runs(rows, min_words).withColumn("level", F.floor(F.log2("n")).cast("int"))
    runs = runs.withColumn("j", F.col("i") + F.col("n") - F.expr("shiftleft(1, level)"))
    named = runs.join(table.withColumnRenamed("r", "ra"), ["d", "t", "i", "level"]).join(table.select("d", "t", F.col("i").alias("j"), F.col("r").alias("rb"), "level"), ["d", "t", "j", "level"])
    named = stored(named.select("d", "t", "i", "n", "ra", "rb"), "runs")
    first = stored(named.groupBy("n", "ra", "rb").agg(F.min(F.struct("d", "t", "i")).alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1"), "first")
    later = joined(named, first, ["n", "ra", "rb"], "m").where(F.struct("d", "t", "i") != F.col("first"))
    return stored(_covered(rows, later).groupBy("d", "t").agg(F.array_sort(F.collect_set("pos")).alias("deleted")), "deleted")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, name: str | None = None) -> DataFrame:
    """All columns of docs, `text` freed of later copies, and beside them `name` (deleted_lines, with underscores where docs has that column): numbers from 0 of the deleted lines, empty if none."""
    name = name or fresh(docs, "deleted_lines")
    gone = repeated(docs, key, text, min_words)
    n, cells = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("deleted")), F.lit(0))).first()
    rows = docs.select(nested(docs).alias("row"), *_named(key, text)).join(F.broadcast(gone) if 64 * n + 8 * cells <= 64 << 20 else gone, ["d", "t"], "left")
    lines = F.split(F.col(f"row.{text}"), "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("deleted"))
    held = F.array(F.struct(lines.alias("lines"), kept.alias("kept")))  # a variable of one value, so that the text is split once and not for each line
    left = F.transform(held, lambda x: F.array_join(F.transform(x["kept"], lambda i: F.get(x["lines"], i)), "\n"))[0]
    new = F.when(F.col("deleted").isNull(), F.col(f"row.{text}")).otherwise(left)
    return rows.select(*(new.alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns), F.coalesce("deleted", F.array().cast("array<int>")).alias(name))
