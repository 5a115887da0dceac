"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The vocabulary is read from a file of ranks (base64 of a token's bytes, rank); the path is a parameter.
Merges follow from the ranks: a token of two bytes or more comes from the pair that merging its bytes
by lower ranks leaves. Every byte is written as one printable character (the fixed byte-to-character
table of byte-level BPE), texts are split by the pattern, and each match is encoded separately. The ids
are those that repeated merging of the lowest-ranked adjacent pair gives. Decoding turns each id's
characters back into bytes through the reversed table; only joined bytes are read as UTF-8, so a
character split between tokens comes back whole. Offsets are in characters of the text; the tokens of a
split character share its span.

Null and empty texts give no ids and empty bytes. Strings of special tokens are ordinary text. Rows that
repeat are answered each; columns of other names are left out.
"""

from __future__ import annotations

import base64
import hashlib
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from .common import each_batch, texts

_loaded: dict[tuple[str, str], "ByteBpe"] = {}
#: Characters that are encoded at once.
SLICE_CHARS = 1 << 20
#: Distinct matches whose ids a worker remembers, and their characters, give or take a slice.
KNOWN_MATCHES, KNOWN_CHARS = 300_000, 1 << 23


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else the next free one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class ByteBpe:
    def __init__(self, ranks_path: str, pattern: str):
        from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        to = byte_characters()
        shown = lambda raw: "".join(map(to.__getitem__, raw))
        merges = [tuple(map(shown, self._pair(t, r, ranks))) for t, r in sorted(ranks.items(), key=lambda x: x[1]) if len(t) > 1]
        self.tokenizer = Tokenizer(models.BPE(vocab={shown(t): r for t, r in ranks.items()}, merges=merges))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.tokenizer.decoder = decoders.ByteLevel()
        self.matches = regex.compile(pattern).findall
        self.merger = Tokenizer(self.tokenizer.model)
        self.merger.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.forget()
        back = {c: b for b, c in enumerate(to)}
        by_id = {i: bytes(map(back.__getitem__, s)) for s, i in self.tokenizer.get_vocab().items()}
        self.bytes_of = [by_id.get(i) for i in range(max(by_id) + 1)]
        self.text_of = [*map(str, range(len(self.bytes_of)))]

    def forget(self) -> None:
        """No match is known: what is held of one is its number, and the ids of all one after another."""
        self.known: dict[str, int] = {}
        self.chars, self.ids, self.size = 0, np.empty(0, np.int32), np.empty(0, np.int64)

    @staticmethod
    def _pair(token: bytes, rank: int, ranks: dict[bytes, int]) -> list[bytes]:
        parts = [bytes([b]) for b in token]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: r if (r := ranks.get(parts[i] + parts[i + 1], rank)) < rank else len(ranks) + rank)
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def encode(self, batch: list[str], offsets: bool = False) -> list:
        """The ids of each text, or with offsets pairs of ids and character spans. Without them, each distinct match is merged once."""
        if offsets:
            return [(e.ids, e.offsets) for e in self.tokenizer.encode_batch(batch, add_special_tokens=False)]
        ids, counts = self.encode_flat(batch)
        return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] if batch else []

    def encode_flat(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has."""
        if len(self.known) > KNOWN_MATCHES or self.chars > KNOWN_CHARS:
            self.forget()
        split = [self.matches(t) for t in batch]
        new = [x for x in set().union(*split) if x not in self.known]
        merged = [e.ids for e in self.merger.encode_batch_fast(new, add_special_tokens=False)]
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.chars += sum(map(len, new))
        self.ids = np.concatenate((self.ids, np.fromiter(chain.from_iterable(merged), np.int32)))
        self.size = np.concatenate((self.size, np.fromiter(map(len, merged), np.int64, len(merged))))
        n = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, int(n.sum()))
        size = self.size[at]
        ends = np.concatenate(([0], np.cumsum(size)))
        start = (np.cumsum(self.size) - self.size)[at]
        ids = self.ids[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
        return ids, np.diff(ends[np.concatenate(([0], np.cumsum(n)))])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def send(spark: SparkSession, ranks_path: str) -> None:
    """Have every executor fetch the file of ranks from the driver, as other machines need not hold it."""
    if os.path.exists(ranks_path):
        spark.sparkContext.addFile(ranks_path)


def loaded(ranks_path: str, pattern: str) -> ByteBpe:
    """One tokenizer for each Python worker, from the copy that Spark has sent, or else this machine's file."""
    if (ranks_path, pattern) not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        sent = SparkFiles.get(os.path.basename(ranks_path))
        _loaded[ranks_path, pattern] = ByteBpe(sent if os.path.exists(sent) else ranks_path, pattern)
    return _loaded[ranks_path, pattern]


def slices(batch: list[str]):
    """Runs of a batch of SLICE_CHARS or so."""
    start = size = 0
    for i, t in enumerate(batch):
        if size and size + len(t) > SLICE_CHARS:
            yield batch[start:i]
            start, size = i, 0
        size += len(t)
    yield batch[start:]


def encode(docs: DataFrame, ranks_path: str, pattern: str, offsets: bool = False) -> DataFrame:
    """doc_id, ids array<int>, and with offsets begins and ends array<int> of each token's characters."""

    def run(b: pa.RecordBatch) -> list[pa.RecordBatch]:
        bpe, out, at = loaded(ranks_path, pattern), [], 0
        for part in slices(b.column("text").to_pylist()):
            got = bpe.encode(part, offsets)
            cols = {"doc_id": b.column("doc_id").slice(at, len(part)), "ids": pa.array([x[0] for x in got] if offsets else got, pa.list_(pa.int32()))}
            if offsets:
                cols |= {n: pa.array([[o[k] for o in x[1]] for x in got], pa.list_(pa.int32())) for k, n in enumerate(("begins", "ends"))}
            at += len(part)
            out.append(pa.RecordBatch.from_pydict(cols))
        return out

    send(docs.sparkSession, ranks_path)
    return texts(docs).mapInArrow(each_batch(run), "doc_id long, ids array<int>" + ", begins array<int>, ends array<int>" * offsets)


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and the decoded bytes of ids (null: none)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        bpe = loaded(ranks_path, pattern)
        return pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "decoded": pa.array([bpe.decode(x or []) for x in b.column("ids").to_pylist()], pa.binary())})

    send(encoded.sparkSession, ranks_path)
    return encoded.select("doc_id", "ids").mapInArrow(each_batch(run), "doc_id long, decoded binary")


def digest(docs: DataFrame, ranks_path: str, pattern: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and perhaps ids in one pass: the ids are decoded where they were made."""

    def run(b: pa.RecordBatch) -> list[pa.RecordBatch]:
        bpe, out, at = loaded(ranks_path, pattern), [], 0
        for part in slices(b.column("text").to_pylist()):
            flat, counts = bpe.encode_flat(part)
            ends, ids_sha, decoded_sha = np.cumsum(counts), [], []
            for x, y in zip((ends - counts).tolist(), ends.tolist()):
                own = flat[x:y].tolist()
                ids_sha.append(hashlib.sha256(" ".join(map(bpe.text_of.__getitem__, own)).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(bpe.decode(own)).hexdigest())
            cols = {"doc_id": b.column("doc_id").slice(at, len(part)), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": ids_sha, "decoded_sha256": decoded_sha}
            if ids:
                cols["ids"] = pa.ListArray.from_arrays(np.concatenate(([0], ends)).astype(np.int32), pa.array(flat, pa.int32()))
            at += len(part)
            out.append(pa.RecordBatch.from_pydict(cols))
        return out

    send(docs.sparkSession, ranks_path)
    return texts(docs).mapInArrow(each_batch(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)
