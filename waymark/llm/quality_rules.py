"""Quality rules by distribution divergence: histograms of character classes and common words against language references.

References: for each language, the histogram of byte classes and the words that hold a COMMON_SHARE of its
words, at most 1 / COMMON_SHARE of them by counting, so what is collected and sent does not grow with the
texts. They are counted over every document that passes the base rules. A document is compared with the
reference nearest to it by Jensen-Shannon distance (base 2, 0 to 1), whatever its own lang says; the
class distance counts only from MIN_BYTES bytes on, the word distance from MIN_WORDS words on.

Null and empty texts have no words, fail the base rule of ten words and get null distances. Rows that
repeat are judged each; with no reference at all (an empty table, no lang) only the base rules decide.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, as_bytes, each_batch, stored, texts

MIN_BYTES, MIN_WORDS = 300, 50
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.22, 0.5
COMMON_SHARE = 1 / 1000
#: Words that a counting task holds before it sends their counts on.
HELD_WORDS = 200_000

_SYMBOLS = b"#*$%&|<>"
_NOT_IN_WORDS = SPACES + bytes(range(0x80, 0xC0))
#: Byte classes: lower case, capital, digit, blank, end of line, sentence mark, other mark, symbol, control, first byte of a longer character (by length); continuation bytes aren't counted.
_CLASS = np.full(256, 8)
for _k, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:!?'", b"\"()[]{}-_/=+@~^`\\", _SYMBOLS)):
    _CLASS[list(_bytes)] = _k
_CLASS[0xC0:0xE0], _CLASS[0xE0:0xF0], _CLASS[0xF0:], _CLASS[0x80:0xC0] = 9, 10, 11, 12
CLASSES = 12
_TO_CLASS = np.eye(13)[_CLASS][:, :CLASSES]


def class_counts(raw: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _TO_CLASS


def base_counts(raw: bytes) -> tuple[list[bytes], int, int, int, int]:
    """Words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return words, len(raw.translate(None, _NOT_IN_WORDS)), len(raw) - len(raw.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """How many words stand in windows found twice or more."""
    if len(words) <= window:
        return 0
    first: dict[bytes, int] = {}
    ids = np.fromiter((first.setdefault(w, len(first)) for w in words), np.int64, len(words))
    n, bits = len(ids) - window + 1, len(first).bit_length()
    key, used = ids[:n], bits
    for k in range(1, window):  # exact: where the bits don't suffice, ranks take the place of what is packed so far
        if used + bits > 62:
            key, used = np.unique(key, return_inverse=True)[1], n.bit_length()
        key, used = key << bits | ids[k : n + k], used + bits
    key = np.unique(key, return_inverse=True)[1]
    hit = np.bincount(key)[key] > 1
    if not hit.any():
        return 0
    inside = np.zeros(len(ids) + 1, np.int64)
    np.add.at(inside, np.flatnonzero(hit), 1)
    np.add.at(inside, np.flatnonzero(hit) + window, -1)
    return int((np.cumsum(inside[:-1]) > 0).sum())


def fails_base(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of each row of p from q, all of sum 1."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda x: np.nansum(np.where(x > 0, x * np.log2(x / m), 0), axis=-1)
        return np.sqrt(np.clip((part(p) + part(q)) / 2, 0, 1))


def references(docs: DataFrame) -> list[tuple[str, np.ndarray, list[bytes], np.ndarray]]:
    """For each language: name, class shares, common words, their shares and last that of all others."""

    def count(batches):
        words, classes, total = {}, {}, {}

        def sent():
            for lang in list(words):
                rows = [*words.pop(lang).items()]
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(rows), pa.string()), "word": pa.array([w for w, _ in rows], pa.binary()), "class": pa.array([-1] * len(rows), pa.int32()), "n": pa.array([n for _, n in rows], pa.int64())})

        for b in batches:
            for raw, lang in zip(as_bytes(b.column("text")), b.column("lang").to_pylist()):
                split = raw.split()
                if len(split) < 10 or fails_base(len(split), repeated_words(split)):
                    continue
                words.setdefault(lang, Counter()).update(raw.lower().split())
                classes[lang] = classes.get(lang, 0) + class_counts(raw)
                total[lang] = total.get(lang, 0) + len(split)
                if sum(map(len, words.values())) > HELD_WORDS:
                    yield from sent()
        yield from sent()
        for lang, c in classes.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * (CLASSES + 1), "word": pa.array([None] * (CLASSES + 1), pa.binary()), "class": pa.array(range(CLASSES + 1), pa.int32()), "n": pa.array([*map(int, c), total[lang]], pa.int64())})

    counts = texts(docs, "lang").where(F.col("lang").isNotNull()).select("text", "lang").mapInArrow(count, "lang string, word binary, class int, n long").groupBy("lang", "class", "word").agg(F.sum("n").alias("n"))
    counts = stored(counts, "words")
    classes = counts.where("class >= 0").toPandas()
    out = []
    totals = {x["lang"]: x["n"] for _, x in classes[classes["class"] == CLASSES].iterrows()}
    if not totals:
        return out
    least = F.element_at(F.create_map(*(F.lit(x) for lang, n in totals.items() for x in (lang, int(n)))), F.col("lang")) * COMMON_SHARE
    common = counts.where((F.col("class") == -1) & (F.col("n") >= least)).toPandas()
    for lang in sorted(totals):
        mine = classes[(classes["lang"] == lang) & (classes["class"] < CLASSES)].sort_values("class")["n"].to_numpy(float)
        rows = sorted((bytes(w), n) for w, n in common[common["lang"] == lang][["word", "n"]].itertuples(index=False))
        shares = np.array([n for _, n in rows] + [totals[lang] - sum(n for _, n in rows)], float) / totals[lang]
        out.append((lang, mine / mine.sum(), [w for w, _ in rows], shares))
    return out


def lookup(refs) -> tuple[dict[bytes, int], list[np.ndarray]]:
    """A bin for each word that is common in any language, and each language's bins."""
    bins = {w: i for i, w in enumerate(sorted({w for r in refs for w in r[2]}))}
    return bins, [np.array([bins[w] for w in r[2]], np.int64) for r in refs]


def distances(raw: bytes, refs, table) -> tuple[float | None, float | None]:
    """The class and word distances from the reference whose words are nearest, or whose classes are in short texts."""
    bins, own = table
    low = raw.lower().split()
    by_class = by_word = None
    if len(raw) >= MIN_BYTES:
        c = class_counts(raw)
        by_class = distance(np.stack([r[1] for r in refs]), c / c.sum())
    if len(low) >= MIN_WORDS:
        h = np.bincount([bins.get(w, len(bins)) for w in low], minlength=len(bins) + 1) / len(low)
        by_word = [float(distance(r[3], np.append(mine := h[at], max(0.0, 1 - mine.sum())))) for r, at in zip(refs, own)]
    k = int(np.argmin(by_word if by_word is not None else by_class)) if by_word or by_class is not None else 0
    return None if by_class is None else float(by_class[k]), None if by_word is None else by_word[k]


def assess(docs: DataFrame, refs=None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance, word_distance."""
    refs = references(docs) if refs is None else refs
    sent = docs.sparkSession.sparkContext.broadcast((refs, lookup(refs)))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        refs, table = sent.value
        rows = []
        for raw in as_bytes(b.column("text")):
            words, chars, symbols, dup, repeat = base_counts(raw)
            failed = fails_base(len(words), repeat)
            by_class, by_word = distances(raw, refs, table) if refs and words else (None, None)
            kept = not failed and (by_class is None or by_class <= MAX_CLASS_DISTANCE) and (by_word is None or by_word <= MAX_WORD_DISTANCE)
            rows.append((len(words), chars, symbols, dup, repeat, failed, kept, by_class, by_word))
        cols = list(zip(*rows))
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=SCHEMA_NAMES)

    return texts(docs).mapInArrow(each_batch(run), SCHEMA)


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"
SCHEMA_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
