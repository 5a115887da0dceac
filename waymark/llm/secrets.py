"""Secret scans: base patterns, and a linear-chain conditional random field decoded by Viterbi.

Base kinds, leftmost non-overlapping per kind: assign (a keyword, a separator and a value of 6 characters or
more), access (AKIA and capitals or digits, 20 or more), hex (24 or more). The field tags tokens (runs of
ASCII letters and digits, or one other character) as begin, inside or outside of a secret by shape,
neighbouring words and features of the whole text. It is trained on a bounded sample of texts (TRAINING of
either sort, least by a hash), of which each gives up to STRETCHES + PLAIN windows of tokens spread over its
whole length; labels are the base spans. Keywords are hidden from half of the texts, so shape alone must do.

A secret can begin at any token, of any length; it goes on only to a token that touches the one before. Every
token of every text is scored, a batch of texts at once in numpy, by sums held for each distinct word. A run
of touching tokens none of which gains more over outside than transitions can cost is outside on the best
path, so that path falls apart exactly into stretches around the other runs, and only these are decoded.
What the best path tags is returned as it is; no threshold follows it.

Spans are in code points, end exclusive; the field's (kind crf) come beside base ones and never overlap
them. Null and empty texts have no spans. Without any training text the field adds nothing. Rows that repeat
are answered each; all columns but the key and the text are left out, so no name can clash.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_batch, mixed, stored, texts

#: Texts with and without base spans that are learned from, at most, and windows around candidates in each.
TRAINING, STRETCHES = 400, 20
LONG = 30
KINDS = ("assign", "access", "hex", "crf")
CONTEXT = 3
#: Windows of plain tokens that a text gives for training, tokens in each, and tokens in any window at most; words of which a worker holds the sums; characters that are tagged at once; tokens of a stretch that is decoded together with others.
PLAIN, PLAIN_TOKENS, WINDOW_TOKENS, HELD, SLICE_CHARS, SHORT = 4, 12, 96, 400_000, 1 << 20, 128

_cased = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = re.compile("(" + "|".join(map(_cased, KEYWORDS)) + r")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]")
#: What training looks at first beside base spans: a token with a digit and 6 characters, or of LONG letters.
START = re.compile(r"(?<![A-Za-z0-9])(?:(?=[A-Za-z]*[0-9])[A-Za-z0-9]{6,}|[A-Za-z]{%d,})" % LONG)
_STARTS = ("password", "passwd", "secret", "token", "api")


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {"assign": [], "access": [], "hex": []}
    if not text:
        return out
    low = text.lower()
    if any(w in low for w in _STARTS):
        out["assign"] = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out["access"] = [m.span() for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out["hex"] = [m.span() for m in HEX.finditer(text)]
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{b}:{e}" for k, b, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def stretches(text: str, base: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """All token spans, and the ranges of them to learn from: around base spans and START matches, and plain ones; of more than there is room for, those at even distances."""
    spans = [x.span() for x in TOKEN.finditer(text)]
    starts = np.array([x for x, _ in spans])
    found, done = [], 0
    for at, end in sorted({*base, *(m.span() for m in START.finditer(text))}):
        k = int(np.searchsorted(starts, at, "right")) - 1
        j = k + 1
        while j < len(spans) and j < k + WINDOW_TOKENS and (spans[j - 1][1] == spans[j][0] or spans[j][0] < end):
            j += 1
        if k >= done:
            found.append((max(0, k - CONTEXT), min(len(spans), j + CONTEXT)))
            done = j
    n = len(spans)
    out = [found[p * len(found) // STRETCHES] for p in range(STRETCHES)] if len(found) > STRETCHES else found
    out += [(k, min(n, k + PLAIN_TOKENS)) for k in sorted({p * n // PLAIN for p in range(PLAIN)}) if k < n]
    return spans, out


def _bits(word: str) -> float:
    n = len(word)
    return -sum(c / n * math.log2(c / n) for c in map(word.count, {*word}))


def lowered(w: str) -> str:
    return w.lower() if len(w) < 20 and not any(c.isdigit() for c in w) else "#"


def own_features(w: str) -> tuple[str, list[str]]:
    """The shape of a token, and the features that it has by itself."""
    if w.isascii() and w.isalpha() and w.islower():
        shape = "a"
    else:
        kinds = (any(c.islower() for c in w), any(c.isupper() for c in w), any(c.isdigit() for c in w))
        shape = "".join(c for c, has in zip("aA0", kinds) if has) or "."
    size = min(len(w), 48) // 4
    found = [f"shape {shape}", f"size {size}", f"shape {shape} size {size}"]
    if len(w) > 5:
        found += [f"bits {int(2 * _bits(w))}", f"hex {not w.strip('0123456789abcdef')}", f"digits {4 * sum(c.isdigit() for c in w) // len(w)}"]
    elif not w.isalnum():
        found.append(f"mark {w if w.isascii() else 'x'}")
    return shape, found


def token_features(text: str, spans: list[tuple[int, int]], of_file: tuple[str, ...], hide: bool = False) -> list[list[str]]:
    words = [text[b:e] for b, e in spans]
    low = [lowered(w) for w in words]
    if hide:
        low = [w if not w.isalpha() else "*" for w in low]
    out = []
    for k, w in enumerate(words):
        shape, found = own_features(w)
        out.append([*found, f"before {low[k - 1] if k else ''}", f"before2 {low[k - 2] if k > 1 else ''}", f"after {low[k + 1] if k + 1 < len(low) else ''}", f"touches {k > 0 and spans[k - 1][1] == spans[k][0]}"] + [f"{f} {shape}" for f in of_file])
    return out


def file_features(text: str) -> tuple[str, ...]:
    """What the whole text tells: how much of it the sign of a setting stands in, and how long it is."""
    e, n = file_numbers(text)
    return (f"equals {e}", f"file {n}")


def file_numbers(text: str) -> tuple[int, int]:
    return min(3, text.count("=") * 1000 // (len(text) + 1)), min(6, len(text).bit_length() // 3)


OUTSIDE, BEGIN, INSIDE = 0, 1, 2
BUCKETS = 1 << 14
SHAPES = ("0", ".", "A", "A0", "a", "a0", "aA", "aA0")
_allowed_next = np.array([[0, 0, -1e9], [0, 0, 0], [0, 0, 0]])
_kinds: list[np.ndarray] = []


def kinds_of(codes: np.ndarray) -> np.ndarray:
    """For each code point 0 for white space, 1 for an ASCII letter or digit, 2 for any other."""
    if not _kinds:
        table = np.full(0x110000, 2, np.uint8)
        table[[c for c in range(0x3001) if chr(c).isspace()]] = 0  # none lies beyond
        for lo, hi in ("09", "AZ", "az"):
            table[ord(lo) : ord(hi) + 1] = 1
        _kinds.append(table)
    return _kinds[0][codes]


def allowed(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """0 or -1e9 for each token and label, by the hard constraints."""
    out = np.zeros((len(spans), 3))
    for k, (b, e) in enumerate(spans):
        if not k or spans[k - 1][1] != b:
            out[k, INSIDE] = -1e9
    return out


def feature_ids(found: list[list[str]]) -> list[list[int]]:
    return [[zlib.crc32(f.encode()) % BUCKETS for f in x] for x in found]


class Tokens:
    """The tokens of several texts, as TOKEN finds them: where they begin and end in all texts joined, each one's text, whether it touches the one before, and a hash of its word."""

    def __init__(self, batch: list[str]):
        self.joined = "\n".join(batch)
        sizes = np.fromiter(map(len, batch), np.int64, len(batch))
        self.offset = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
        codes = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = kinds_of(codes)
        word = kind == 1
        first = (kind == 2) | word & ~np.concatenate(([False], word[:-1]))
        self.begin = np.flatnonzero(first)
        self.end = np.flatnonzero((kind == 2) | word & ~np.concatenate((word[1:], [False]))) + 1
        self.of = np.searchsorted(self.offset, self.begin, "right") - 1
        self.touch = np.concatenate(([False], self.begin[1:] == self.end[:-1]))[: len(self.begin)]
        at = np.flatnonzero(kind)
        size = self.end - self.begin
        heads = np.cumsum(size) - size
        place = np.arange(len(at)) - np.repeat(heads, size)
        self.hash = np.add.reduceat(mixed(codes[at].astype(np.uint64) | place.astype(np.uint64) << np.uint64(32), 31), heads) if len(at) else np.empty(0, np.uint64)


class Field:
    """Weights of features by label, and of transitions."""

    def __init__(self, weights: np.ndarray, steps: np.ndarray):
        self.weights, self.steps = weights, steps
        self.hashes, self.sums, self.shapes, self.files = np.empty(0, np.uint64), np.empty((0, 12)), np.empty(0, np.int64), None

    def weight(self, found: list[str]) -> np.ndarray:
        return self.weights[[zlib.crc32(f.encode()) % BUCKETS for f in found]].sum(0)

    def _learned(self, hashes: np.ndarray, words: list[str]) -> None:
        """Hold what each of these words adds to itself and its neighbours."""
        own, sizes, around, shapes, crc = [], [], [], np.empty(len(words), np.int64), zlib.crc32
        for k, w in enumerate(words):
            shape, found = own_features(w)
            low = lowered(w)
            own += [crc(x.encode()) for x in found]
            sizes.append(len(found))
            around += [crc(f"{x} {low}".encode()) for x in ("before", "before2", "after")]
            shapes[k] = SHAPES.index(shape)
        first = np.cumsum([0, *sizes[:-1]])
        rows = np.hstack((np.add.reduceat(self.weights[np.array(own) % BUCKETS], first), self.weights[np.array(around) % BUCKETS].reshape(-1, 9)))
        if len(self.hashes) + len(hashes) > HELD:
            self.hashes, self.sums, self.shapes = np.empty(0, np.uint64), np.empty((0, 12)), np.empty(0, np.int64)
        self.hashes = np.concatenate((self.hashes, hashes))
        order = np.argsort(self.hashes)
        self.hashes, self.sums, self.shapes = self.hashes[order], np.concatenate((self.sums, rows))[order], np.concatenate((self.shapes, shapes))[order]

    def text_scores(self, t: Tokens, batch: list[str]) -> np.ndarray:
        """The scores of all tokens of a batch of texts, as scores() of their features."""
        if self.files is None:
            self.files = np.array([[[self.weight([f"equals {e} {x}", f"file {n} {x}"]) for x in SHAPES] for n in range(7)] for e in range(4)])
        distinct, at, back = np.unique(t.hash, return_index=True, return_inverse=True)
        for again in (0, 1):  # a full memory may have forgotten some of what it held
            new = np.flatnonzero(~np.isin(distinct, self.hashes, assume_unique=True))
            if len(new):
                self._learned(distinct[new], [t.joined[b:e] for b, e in zip(t.begin[at[new]].tolist(), t.end[at[new]].tolist())])
        row = np.searchsorted(self.hashes, distinct)[back]
        out = self.sums[row, :3]
        first = np.concatenate(([True], t.of[1:] != t.of[:-1]))
        last = np.concatenate((first[1:], [True]))
        second = np.concatenate(([False], first[:-1])) | first
        out[1:] += np.where(first[1:, None], self.weight(["before "]), self.sums[row[:-1], 3:6])
        out[:1] += self.weight(["before "])
        out[2:] += np.where(second[2:, None], self.weight(["before2 "]), self.sums[row[:-2], 6:9])
        out[:2] += self.weight(["before2 "])
        out[:-1] += np.where(last[:-1, None], self.weight(["after "]), self.sums[row[1:], 9:])
        out[-1:] += self.weight(["after "])
        out += np.where(t.touch[:, None], self.weight(["touches True"]), self.weight(["touches False"]))
        of_text = np.array([file_numbers(x) for x in batch], np.int64).reshape(-1, 2)[t.of]
        out += self.files[of_text[:, 0], of_text[:, 1], self.shapes[row]]
        out[~t.touch, INSIDE] -= 1e9
        return out

    def scores(self, ids: list[list[int]], limits: np.ndarray) -> np.ndarray:
        return np.stack([self.weights[x].sum(0) for x in ids]) + limits

    def forward(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        t = self.steps + _allowed_next
        a, b = np.zeros_like(s), np.zeros_like(s)
        a[0] = s[0]
        for k in range(1, len(s)):
            a[k] = s[k] + np.logaddexp.reduce(a[k - 1][:, None] + t, axis=0)
        for k in range(len(s) - 2, -1, -1):
            b[k] = np.logaddexp.reduce(t + (s[k + 1] + b[k + 1])[None], axis=1)
        return a, b, float(np.logaddexp.reduce(a[-1]))

    def viterbi(self, s: np.ndarray) -> list[int]:
        (t00, t01, t02), (t10, t11, t12), (t20, t21, t22) = (self.steps + _allowed_next).tolist()
        rows = s.tolist()
        x, y, z = rows[0]
        back = []
        for p, q, r in rows[1:]:  # three labels: plain numbers are faster than arrays
            to_out, to_begin, to_inside = (x + t00, y + t10, z + t20), (x + t01, y + t11, z + t21), (x + t02, y + t12, z + t22)
            x, y, z = max(to_out), max(to_begin), max(to_inside)
            back.append((to_out.index(x), to_begin.index(y), to_inside.index(z)))
            x, y, z = x + p, y + q, z + r
        path = [(x, y, z).index(max(x, y, z))]
        for at in reversed(back):
            path.append(at[path[-1]])
        return path[::-1]

    def decoded(self, batch: list[str]) -> list[list[tuple[int, int]]]:
        """Begin and end of each secret on the best path of each text."""
        out: list[list[tuple[int, int]]] = [[] for _ in batch]
        t = Tokens(batch)
        n = len(t.begin)
        if not n:
            return out
        s = self.text_scores(t, batch)
        steps = self.steps + _allowed_next
        slack = 2 * max(0.0, steps.max() - min(steps[:, OUTSIDE].min(), steps[OUTSIDE, BEGIN]))
        runs = np.flatnonzero(~t.touch)
        hot = np.flatnonzero(np.maximum.reduceat(s[:, BEGIN:].max(1) - s[:, OUTSIDE], runs) + slack > 0)
        ends = np.append(runs[1:], n)
        lo, hi = runs[hot], ends[hot]
        before = (lo > 0) & (t.of[lo - 1] == t.of[lo])  # a token on either side that is known to be outside
        after = (hi < n) & (t.of[np.minimum(hi, n - 1)] == t.of[lo])
        lo, hi = lo - before, hi + after
        fresh = np.concatenate(([True], lo[1:] >= hi[:-1])) if len(lo) else np.empty(0, bool)
        heads, tails = np.flatnonzero(fresh), np.flatnonzero(np.append(fresh[1:], True))
        lo, hi, before, after = lo[heads], hi[tails], before[heads], after[tails]
        s[lo, INSIDE] = -1e9
        s[lo[before], BEGIN] = -1e9
        s[hi[after] - 1, BEGIN:] = -1e9
        tags = np.zeros(n, np.int8)
        short = hi - lo <= SHORT
        self._decode_many(s, lo[short], (hi - lo)[short], steps, tags)
        for a, b in zip(lo[~short].tolist(), hi[~short].tolist()):
            tags[a:b] = self.viterbi(s[a:b])
        begins, rest = np.flatnonzero(tags == BEGIN), np.append(np.flatnonzero(tags != INSIDE), n)
        ends = rest[np.searchsorted(rest, begins, "right")] - 1
        for k, b, e in zip(t.of[begins].tolist(), (t.begin[begins] - t.offset[t.of[begins]]).tolist(), (t.end[ends] - t.offset[t.of[begins]]).tolist()):
            out[k].append((b, e))
        return out

    @staticmethod
    def _decode_many(s: np.ndarray, lo: np.ndarray, size: np.ndarray, steps: np.ndarray, tags: np.ndarray) -> None:
        """Viterbi over many stretches of s at once, the k-th tokens of all in one step; the labels go to tags."""
        if not len(lo):
            return
        order = np.argsort(-size, kind="stable")
        lo, size = lo[order], size[order]
        left = [int(np.searchsorted(-size, -k, "left")) for k in range(int(size[0]) + 1)]  # stretches of more than k tokens
        best, back = s[lo], [None]
        for k in range(1, int(size[0])):
            m = left[k]
            to = best[:m, :, None] + steps
            back.append(to.argmax(1).astype(np.int8))
            best[:m] = to.max(1) + s[lo[:m] + k]
        at = best.argmax(1)
        for k in range(int(size[0]) - 1, -1, -1):
            m = left[k]
            tags[lo[:m] + k] = at[:m]
            if k:
                at[:m] = back[k][np.arange(m), at[:m]]

    @classmethod
    def trained(cls, examples: list[tuple[list[list[int]], np.ndarray, list[int]]], rounds: int = 12, rate: float = 0.3, decay: float = 1e-4) -> "Field":
        """By stochastic gradient of the log-likelihood, examples in a fixed order."""
        f = cls(np.zeros((BUCKETS, 3)), np.zeros((3, 3)))
        order = np.random.default_rng(7).permutation(len(examples))
        for r in range(rounds):
            step = rate / (1 + r)
            for i in order:
                ids, limits, y = examples[i]
                s = f.scores(ids, limits)
                a, b, z = f.forward(s)
                p = np.exp(np.clip(a + b - z, -700, 0))
                p[np.arange(len(y)), y] -= 1
                for k, x in enumerate(ids):
                    f.weights[x] -= step * (p[k] + decay * f.weights[x])
                t = f.steps + _allowed_next
                for k in range(1, len(y)):
                    q = np.exp(np.clip(a[k - 1][:, None] + t + (s[k] + b[k])[None] - z, -700, 0))
                    q[y[k - 1], y[k]] -= 1
                    f.steps -= step * q
        return f


def examples_of(text: str, hide: bool) -> list[tuple[list[list[int]], np.ndarray, list[int]]]:
    """Feature ids, constraints and labels of each window of a text."""
    out, base = [], [x for v in base_spans(text).values() for x in v]
    spans, ranges = stretches(text, base)
    of_file = file_features(text)
    for lo, hi in ranges:
        first = max(0, lo - 2)
        here = spans[lo:hi]
        y = [OUTSIDE] * len(here)
        limits = allowed(text, here)
        for k, (b, e) in enumerate(here):
            if any(s <= b and e <= t for s, t in base):
                same = k and y[k - 1] != OUTSIDE and limits[k, INSIDE] == 0
                y[k] = INSIDE if same else BEGIN
        found = token_features(text, spans[first : hi + 1], of_file, hide)[lo - first : hi - first]
        out.append((feature_ids(found), limits, y))
    return out


def examples(texts_: list[str]) -> list[tuple[list[list[int]], np.ndarray, list[int]]]:
    return [x for n, text in enumerate(texts_) for x in examples_of(text, bool(n % 2))]


def free_of(found: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of found that overlap nothing taken."""
    if not taken or not found:
        return found
    starts, ends = np.array(sorted(taken)).T
    reach = np.maximum.accumulate(ends)
    k = np.searchsorted(starts, [e for _, e in found], "left")
    return [x for x, n in zip(found, k.tolist()) if not n or reach[n - 1] <= x[0]]


def crf_spans(field: Field, text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Begin and end of each secret on the best path that overlaps nothing taken."""
    return free_of(field.decoded([text or ""])[0], taken)


def train(docs: DataFrame, most: int = TRAINING) -> Field | None:
    """From `most` texts with base spans and as many without; their windows are cut where the texts are, and only these come to the driver."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        positive = [int(any(base_spans(t).values())) for t in b.column("text").to_pylist()]
        return b.drop_columns(["text"]).append_column("positive", pa.array(positive, pa.int32()))

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for h, text in zip(b.column("h").to_pylist(), b.column("text").to_pylist()):
            for k, (ids, limits, y) in enumerate(examples_of(text, bool(h % 2))):
                rows.append((h, k, ids, (limits[:, INSIDE] == 0).tolist(), y))
        kinds = (pa.int64(), pa.int32(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.bool_()), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(list(zip(*rows)) or [()] * 5, kinds)], names=["h", "k", "ids", "touch", "y"])

    rows = texts(docs, F.xxhash64("doc_id", "text").alias("h")).where("doc_id is not null").select("h", "text")
    sorts = stored(rows.mapInArrow(each_batch(run), "h long, positive int"), "secrets")
    by_sort = [sorts.where(F.col("positive") == k).select("h").distinct().orderBy("h").limit(most) for k in (1, 0)]
    chosen = rows.join(F.broadcast(by_sort[0].unionAll(by_sort[1])), "h", "left_semi").dropDuplicates(["h"])
    data = []
    for x in chosen.mapInArrow(each_batch(cut), "h long, k int, ids array<array<int>>, touch array<boolean>, y array<int>").orderBy("h", "k").toLocalIterator():
        limits = np.zeros((len(x["y"]), 3))
        limits[~np.array(x["touch"], bool), INSIDE] = -1e9
        data.append((x["ids"], limits, x["y"]))
    return Field.trained(data) if any(BEGIN in y for _, _, y in data) else None


def _slices(batch: list[str]):
    """Runs of a batch of SLICE_CHARS or so."""
    start = size = 0
    for i, t in enumerate(batch):
        if size and size + len(t) > SLICE_CHARS:
            yield batch[start:i]
            start, size = i, 0
        size += len(t)
    yield batch[start:]


def scan(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf."""
    sent = docs.sparkSession.sparkContext.broadcast(field or train(docs))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for part in _slices(b.column("text").to_pylist()):
            for text, more in zip(part, sent.value.decoded(part) if sent.value else [[]] * len(part)):
                base = base_spans(text)
                listed = [(k, x, y) for k, v in base.items() for x, y in v]
                more = free_of(more, [x[1:] for x in listed])
                all_spans = joined(listed + [("crf", x, y) for x, y in more])
                rows.append((*(len(base[k]) for k in KINDS[:3]), hashlib.sha256(joined(listed).encode()).hexdigest(), all_spans, len(more)))
        cols = list(zip(*rows))
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"])

    return texts(docs).mapInArrow(each_batch(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long")
