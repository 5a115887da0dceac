"""Toxicity by maximum-scoring segments over token log-odds.

Learning: from a bounded sample of the labelled rows (LABELLED of them, the least by a hash of doc_id), each
token, counted once for each pair of neighbours, gets the log-odds of toxic against other texts under a
Dirichlet prior proportional to its frequency in both, shrunk by its standard error; tokens that don't stand
out score BACKGROUND.
Scoring: a linear-time scan finds every maximal segment of positive sum (all disjoint ones, none of them
extensible); a segment of sum s in n tokens has the normalised score x = lambda * s - ln(K n), where lambda is
the root of E[exp(lambda x)] = 1 over clean tokens. Over clean text the largest of them follows the standard
extreme-value law, so x is significant from SIGNIFICANT on, where that law leaves 1 in 150. All segments of a
text add to its evidence: the r largest, of sum T, are as unlikely in clean text as exp(-T) T^(r-1) / (r! (r-1)!)
(the law of sums of the largest scores), and the evidence is the negative logarithm of the least of these over
r, each r weighed by 2^(1-r). The score is the posterior of a toxic text given the evidence, calibrated on the
labelled texts.

Null and empty texts hold no segment: their score is that of a text without evidence. Tokens are runs of
letters of the lower-cased text. If the sample lacks toxic or clean texts, every score is 0. Rows that repeat
are answered each; a doc_id with several labels counts as toxic if one says so; labels without a doc_id or a
label are left out. Columns of other names are kept by with_score() and left out by detect().
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import each_batch, remainder, stored, texts

#: Labelled rows that are learned from, at most.
LABELLED = 20_000
PRIOR_SHARE = 0.1
BACKGROUND = -0.35
LEAST_Z = 3.0
LEAST_ODDS = 1.0
SIGNIFICANT = 5.0
#: Normalised scores beyond these say no more.
RANGE = (-5.0, 30.0)
TOKEN = re.compile(r"[^\W\d_]+")


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """Every maximal-scoring segment (sum, begin, end), in linear time: only positive scores are visited one by one."""
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    stack: list[tuple[float, float, int, int, int]] = []  # left sum, right sum, begin, end, the nearest earlier one with a smaller left sum
    for i in at.tolist():
        left, right, begin = float(sums[i]), float(sums[i + 1]), i
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][0] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= right:
                stack.append((left, right, begin, i + 1, j))
                break
            left, begin = stack[j][0], stack[j][2]
            del stack[j:]
            j = len(stack) - 1
    return [(r - l, b, e) for l, r, b, e, _ in stack]


def contexts(words: list[str]) -> list[tuple[int, str]]:
    """Each token with a hash of its neighbours: with them it counts once, so neither copies of a text nor endless repeats add to it."""
    join = "\n".join
    return [(xxhash.xxh3_64_intdigest(join(c)) - (1 << 63), c[1]) for c in zip(["", *words], words, [*words[1:], ""])]


class Model:
    """Token scores, lambda, ln K and the calibration."""

    def __init__(self, rows: list[tuple[str, int]] = ()):
        self.scores: dict[str, float] = {}
        self.scale, self.log_k, self.law = 1.0, 0.0, None
        split = [(TOKEN.findall((t or "").lower()), y) for t, y in rows]
        seen = [{c for words, y in split if y == k for c in contexts(words)} for k in (0, 1)]
        counts = [Counter(w for _, w in c) for c in seen]
        if self.learn([(w, counts[0][w], n) for w, n in counts[1].items()], [len(c) for c in seen]):
            self.calibrate([self.evidence(words) for words, _ in split], [y for _, y in split])

    def learn(self, counts, totals: list[int]) -> bool:
        """From (token, count in clean, count in toxic text) and the sums of all tokens' counts; False if either sum is 0."""
        if not all(totals):
            return False
        both, share = sum(totals), []
        for w, *n in counts:
            prior = PRIOR_SHARE * sum(n)
            odds = [math.log((n[y] + prior) / (totals[y] + PRIOR_SHARE * both - n[y] - prior)) for y in (0, 1)]
            error = math.sqrt(sum(1 / (n[y] + prior) for y in (0, 1)))
            if odds[1] - odds[0] >= max(LEAST_ODDS, LEAST_Z * error):
                self.scores[w] = odds[1] - odds[0] - error
                share.append((self.scores[w], (n[0] + 0.5) / totals[0]))
        rest = 1 - sum(p for _, p in share)
        low, high = 1e-6, 50.0
        for _ in range(80):  # the mean step is negative, so the root is single
            mid = (low + high) / 2
            grown = sum(p * math.exp(min(700, mid * s)) for s, p in share) + rest * math.exp(mid * BACKGROUND)
            low, high = (low, mid) if grown > 1 else (mid, high)
        self.scale = low
        self.log_k = math.log(max(1e-9, sum(p for _, p in share)))
        return True

    def calibrate(self, evidence: list[float], toxic: list[int]) -> None:
        self.law = self._calibrated(np.clip(evidence, *RANGE), np.array(toxic, float))

    def evidence(self, words: list[str], found=None) -> float:
        """Of all segments together; without any segment that of a sum of 0, and never above 0."""
        x = sorted((s for s, _, _ in (self.found(words) if found is None else found)), reverse=True)
        if not x:
            return min(0.0, -self.log_k - math.log(max(1, len(words))))
        best = total = x[0]
        for r, more in enumerate(x[1:], 2):
            if more < 1 or best > RANGE[1]:  # the law of sums holds for large scores, and beyond RANGE no more is said
                break
            total += more
            best = max(best, total - (r - 1) * math.log(2 * total) + math.lgamma(r + 1) + math.lgamma(r))
        return best

    def found(self, words: list[str]) -> list[tuple[float, int, int]]:
        get = self.scores.get
        x = np.fromiter((get(w, BACKGROUND) for w in words), np.float64, len(words))
        off = self.log_k + math.log(max(1, len(words)))
        return [(self.scale * s - off, b, e) for s, b, e in segments(x)]

    @staticmethod
    def _calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        """Slope and middle of the posterior's log-odds in x, by Newton steps under a weak normal prior; each class weighs the same."""
        weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        rows, beta, ridge = np.stack([x, np.ones_like(x)], 1), np.zeros(2), np.array([1.0, 0.01])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(rows @ beta, -30, 30)))
            hessian = (rows * (weight * p * (1 - p))[:, None]).T @ rows + np.diag(ridge)
            beta = beta + np.linalg.solve(hessian, rows.T @ (weight * (y - p)) - ridge * beta)
        slope = max(1e-3, float(beta[0]))
        return slope, -float(beta[1]) / slope

    def score(self, evidence: float) -> float:
        if self.law is None:
            return 0.0
        slope, middle = self.law
        return 1 / (1 + math.exp(-slope * (min(max(evidence, RANGE[0]), RANGE[1]) - middle)))


def train(labelled: DataFrame) -> Model:
    """From the rows of a sample (text, toxic). Contexts are counted and evidence is summed where the rows are; the driver gets the tokens that stand out and one number for each row."""
    rows = stored(labelled.select("text", F.col("toxic").cast("int").alias("toxic")), "labelled")

    def count(batches):
        for b in batches:
            found = {(y, *c) for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()) for c in contexts(TOKEN.findall((t or "").lower()))}
            y, context, token = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_pydict({"y": pa.array(y, pa.int32()), "context": pa.array(context, pa.int64()), "token": pa.array(token, pa.string())})

    once = rows.mapInArrow(count, "y int, context long, token string").dropDuplicates(["y", "context", "token"])
    counts = stored(once.groupBy("token").agg(F.sum(1 - F.col("y")).alias("clean"), F.sum("y").alias("toxic")), "contexts")
    totals = [x or 0 for x in counts.agg(F.sum("clean"), F.sum("toxic")).first()]
    model = Model()
    apart = F.col("toxic") * totals[0] > F.col("clean") * totals[1] * math.e ** LEAST_ODDS  # what learn() asks for before it looks at the error
    if not model.learn(((x["token"], x["clean"], x["toxic"]) for x in counts.where(apart & (F.col("toxic") > 1)).toLocalIterator()), totals):
        return model
    sent = labelled.sparkSession.sparkContext.broadcast(model)

    def evidence(b: pa.RecordBatch) -> pa.RecordBatch:
        x = [sent.value.evidence(TOKEN.findall((t or "").lower())) for t in b.column("text").to_pylist()]
        return pa.RecordBatch.from_pydict({"evidence": pa.array(x, pa.float64()), "toxic": b.column("toxic")})

    got = rows.mapInArrow(each_batch(evidence), "evidence double, toxic int").toPandas()
    model.calibrate(got["evidence"].to_numpy(), got["toxic"].to_numpy())
    return model


def sample(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """doc_id, text, toxic of at most `most` labelled rows: those least by a hash of doc_id, whatever their order."""
    chosen = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return texts(docs).join(F.broadcast(chosen), "doc_id")


def detect(docs: DataFrame, model: Model, *more) -> DataFrame:
    """docs' doc_id and `more` columns with score, and passages: significant segments as begin:end in tokens."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        m, score, spans = sent.value, [], []
        for text in b.column("text").to_pylist():
            words = TOKEN.findall(text.lower())
            found = m.found(words)
            score.append(m.score(m.evidence(words, found)))
            spans.append(",".join(f"{x}:{y}" for s, x, y in found if s >= SIGNIFICANT))
        return b.drop_columns(["text"]).append_column("score", pa.array(score, pa.float64())).append_column("passages", pa.array(spans, pa.string()))

    rows = texts(docs, *more)
    return rows.mapInArrow(each_batch(run), rows.drop("text").schema.add("score", "double").add("passages", "string"))


def with_score(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """All columns of docs, and the score of its text under a name that docs has not."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        m = sent.value
        return b.append_column(name, pa.array([m.score(m.evidence(TOKEN.findall((t or "").lower()))) for t in b.column("text").to_pylist()], pa.float64()))

    return docs.mapInArrow(each_batch(run), StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def fitted(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> Model:
    return train(sample(docs, labels.where(remainder("doc_id", folds) != held)))
