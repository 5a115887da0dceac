"""Language identification by multinomial naive Bayes over hashed character n-grams.

Counting: each partition counts the n-gram buckets of its labelled texts per language in numpy and sends
on at most languages x BUCKETS rows; Spark sums them. The log-probability matrix (languages x BUCKETS
doubles, a size that does not grow with the texts) is broadcast, and batches of texts are scored as sparse
matrices of counts.

Texts are lower-cased; runs of what is no letter become one blank. Null texts, empty ones and those
without any letter give `und` with score 0; so does every text if no labelled text holds a letter.
Rows that repeat are answered each; columns of other names are left out. Ties go to the language first in alphabetical order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_batch, remainder, texts

BUCKETS = 1 << 16
ORDERS = (2, 3)
#: N-grams that are scored at once, and cells of their product with the weights that are held at once.
BATCH_GRAMS, SLICE_CELLS = 1 << 20, 1 << 22
_IS_LETTER: list[np.ndarray] = []


def _codes(text: str) -> np.ndarray | None:
    """Code points with every run of non-letters as one blank; None without a letter."""
    if not _IS_LETTER:
        _IS_LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _IS_LETTER[0][c]
    if not letter.any():
        return None
    c = np.where(letter, c, 32)
    c = np.concatenate(([32], c, [32])).astype(np.uint32)
    return c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]


def buckets(text: str) -> np.ndarray | None:
    """The hashed n-grams of a text; None without a letter."""
    c = _codes(text)
    if c is None:
        return None
    out, h = [], c * np.uint32(0x9E3779B1)
    for n in range(2, max(ORDERS) + 1):
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + c[n - 1 :] * np.uint32(0x9E3779B1)
        if n in ORDERS:
            out.append((h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> np.uint32(16))
    return np.concatenate(out)


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in alphabetical order and log probabilities (languages x BUCKETS + 1; last: the prior), from all rows (doc_id, text, lang)."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                if (x := buckets(text)) is not None:
                    if lang not in sums:
                        sums[lang] = np.zeros(BUCKETS + 1, np.int64)
                    sums[lang][:BUCKETS] += np.bincount(x, minlength=BUCKETS)
                    sums[lang][BUCKETS] += 1
        for lang, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(s[at], pa.int64())})

    summed = labelled.where(F.col("lang").isNotNull()).select("text", "lang").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(summed["lang"].unique())
    counts = np.zeros((len(langs), BUCKETS + 1))
    counts[np.searchsorted(langs, summed["lang"].to_numpy(str)) if langs else [], summed["bucket"].to_numpy()] = summed["n"].to_numpy()
    if not langs:
        return [], counts
    grams = counts[:, :BUCKETS] + 0.5
    return langs, np.hstack([np.log(grams / grams.sum(1, keepdims=True)), np.log(counts[:, BUCKETS:] / counts[:, BUCKETS:].sum())])


def batch_scores(grams: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """Log joint probabilities (texts x languages): the batch's sparse counts (text, bucket, n), row by row, times the weights; a slice of entries at a time."""
    of = np.repeat(np.arange(len(grams), dtype=np.int64), [len(x) for x in grams])
    keys, n = np.unique(of * BUCKETS + np.concatenate(grams), return_counts=True)
    of, bucket = keys // BUCKETS, keys % BUCKETS
    out = np.tile(weights[BUCKETS].astype(np.float64), (len(grams), 1))
    step = max(1, SLICE_CELLS // weights.shape[1])
    for at in range(0, len(keys), step):
        part = of[at : at + step]
        first = np.flatnonzero(np.diff(part, prepend=-1))
        out[part[first]] += np.add.reduceat(weights[bucket[at : at + step]] * n[at : at + step, None].astype(np.float64), first)
    return out


def predict(docs: DataFrame, langs: list[str], weights: np.ndarray) -> DataFrame:
    """docs (doc_id, text, any more) with lang_pred and score, the posterior of that language."""
    sent = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(weights.T.astype(np.float32)))

    def score(b: pa.RecordBatch) -> pa.RecordBatch:
        pred, conf, held, n = ["und"] * b.num_rows, [0.0] * b.num_rows, [], 0
        for i, text in enumerate(b.column("text").to_pylist()) if langs else ():
            if (x := buckets(text)) is not None:
                held.append((i, x))
                n += len(x)
            if n >= BATCH_GRAMS or held and i + 1 == len(pred):
                s = batch_scores([x for _, x in held], sent.value)
                best = s.argmax(1)
                sure = 1 / np.exp(s - s.max(1, keepdims=True)).sum(1)
                for (at, _), k, p in zip(held, best.tolist(), sure.tolist()):
                    pred[at], conf[at] = langs[k], p
                held, n = [], 0
        out = b.drop_columns(["text"])
        return out.append_column("lang_pred", pa.array(pred, pa.string())).append_column("score", pa.array(conf, pa.float64()))

    schema = docs.drop("text").schema.add("lang_pred", "string").add("score", "double")
    return docs.mapInArrow(each_batch(score), schema)


def identify(docs: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows of all folds but the held one."""
    fold = remainder("doc_id", folds)
    langs, weights = train(texts(docs, F.col("lang")).where(fold != held))
    return predict(texts(docs, (fold == held).alias("held_out")), langs, weights)
