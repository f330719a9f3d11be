"""Byte-level BPE by an index of pair occurrences, and its decoding."""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_counts import byte_chars

#: The pattern that cuts text into words before the merges, as the byte-level pre-tokenizer has it (a fixed value).
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_SPACE = "\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space and what follows it up to the next: a word never reaches over the end of such a stretch.
_STRETCH = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")


#: Bytes of texts that a task encodes at a time.
_BYTES = 2_000_000


class PairIndex:
    """A byte-level BPE of a ``tokenizers`` file, applied to many words at once.

    All words of a block lie side by side as one row of symbols. An index maps
    each pair's rank to the places where the pair stands. The active ranks are
    applied in ascending order, each to all its places from left to right; a merge
    enters the two pairs that it makes into the lists of their ranks. Places whose
    pair has gone meanwhile are known by their symbols and passed over. As a pair
    that holds a merged symbol ranks after the merge that makes it (checked when
    the file is read), each word gets its merges in the order of the rule.
    """

    def __init__(self, path: str, most_kept: int = 200_000, block: int = 500_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = not any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges", "dropout"))
        if spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex") or not plain:
            raise ValueError(f"{path}: not a plain byte-level BPE")
        vocab, chars = model["vocab"], byte_chars()
        self.byte_ids = np.array([vocab[chars[b]] for b in range(256)], np.int32)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.left = [vocab[a] for a, _ in merges]
        self.right = [vocab[b] for _, b in merges]
        self.made = [vocab[a + b] for a, b in merges]
        self.ranks = {a << 32 | b: i for i, (a, b) in enumerate(zip(self.left, self.right))}
        born = {c: i for i, c in reversed(list(enumerate(self.made)))}
        if len(born) < len(merges) or any(max(born.get(a, -1), born.get(b, -1)) >= i for i, (a, b) in enumerate(zip(self.left, self.right))):
            raise ValueError(f"{path}: a merge uses a token that a later one makes")
        first = np.full((256, 256), -1, np.int32)
        at = {int(x): b for b, x in enumerate(self.byte_ids)}
        for i, (a, b) in enumerate(zip(self.left, self.right)):
            if a in at and b in at:
                first[at[a], at[b]] = i
        self.first = first
        back = {c: b for b, c in chars.items()}
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in spec.get("added_tokens", [])}
        self.bytes_of |= {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.kept: dict[str, bytes] = {}  # stretch -> ids
        self.words: dict[str, bytes] = {}
        self.most_kept, self.block = most_kept, block

    def merged(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word (not empty), as little-endian unsigned 32-bit integers."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = len(raw)
        nxt_, prv_ = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        nxt_[ends - 1] = -1
        prv_[np.r_[0, ends[:-1]]] = -1
        sym, nxt, prv = (array("i", x.astype(np.int32).tobytes()) for x in (self.byte_ids[raw], nxt_, prv_))
        rank = np.full(n, -1, np.int32)
        rank[:-1] = self.first[raw[:-1], raw[1:]]
        rank[ends - 1] = -1
        where = np.flatnonzero(rank >= 0)
        where = where[np.argsort(rank[where], kind="stable")]
        found, starts = np.unique(rank[where], return_index=True)
        places = {int(r): p.tolist() for r, p in zip(found, np.split(where, starts[1:]))}
        active = [int(r) for r in found]  # sorted, so a heap
        ranks, left, right, made = self.ranks.get, self.left, self.right, self.made
        while active:
            r = heapq.heappop(active)
            a, b, c = left[r], right[r], made[r]
            at = places.pop(r)
            if a == b:
                at.sort()
            for p in at:
                if sym[p] != a:
                    continue
                q = nxt[p]
                if q < 0 or sym[q] != b:
                    continue
                sym[p], sym[q] = c, -1
                nxt[p] = f = nxt[q]
                if f >= 0:
                    prv[f] = p
                    new = ranks(c << 32 | sym[f])
                    if new is not None:
                        if new in places:
                            places[new].append(p)
                        else:
                            places[new] = [p]
                            heapq.heappush(active, new)
                e = prv[p]
                if e >= 0:
                    new = ranks(sym[e] << 32 | c)
                    if new is not None:
                        if new in places:
                            places[new].append(e)
                        else:
                            places[new] = [e]
                            heapq.heappush(active, new)
        left_over = np.frombuffer(sym, np.int32)
        alive = left_over >= 0
        upto = np.cumsum(alive)[ends - 1]
        ids = left_over[alive].astype("<u4").tobytes()
        return [ids[4 * i : 4 * j] for i, j in zip([0, *upto[:-1].tolist()], upto.tolist())]

    def _learn(self, stretches: set[str]) -> None:
        """Keep the ids of new stretches; all their new words go through one index, block by block."""
        if len(self.kept) > self.most_kept:
            self.kept.clear()
        if len(self.words) > self.most_kept:
            self.words.clear()
        cut = {s: _WORDS.findall(s) for s in stretches if s not in self.kept}
        new = list({w for ws in cut.values() for w in ws}.difference(self.words))
        raw, size, begin = [w.encode() for w in new], 0, 0
        for i, w in enumerate(raw):
            size += len(w)
            if size >= self.block or i == len(raw) - 1:
                self.words.update(zip(new[begin : i + 1], self.merged(raw[begin : i + 1])))
                size, begin = 0, i + 1
        known = self.words
        for s, ws in cut.items():
            self.kept[s] = known[ws[0]] if len(ws) == 1 else b"".join([known[w] for w in ws])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; strings of special tokens give their ids, as the library's default has it."""
        parts = [self.split.split(t) if t and self.split and "<" in t else [t or ""] for t in texts]
        cut = [[[p] if i % 2 else _STRETCH.findall(p) for i, p in enumerate(ps)] for ps in parts]
        self._learn({s for ps in cut for i, p in enumerate(ps) if not i % 2 for s in p})
        kept, special = self.kept, self.special
        return [b"".join([b"".join([kept[s] for s in p]) if not i % 2 else special[p[0]] for i, p in enumerate(ps)]) for ps in cut]

    def decode(self, ids: bytes | memoryview) -> str:
        """The text of ``ids``; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


_INDEXES: dict[str, PairIndex] = {}


def index_for(path: str) -> PairIndex:
    """The index of this Python process, whose kept words serve all its tasks."""
    if path not in _INDEXES:
        _INDEXES[path] = PairIndex(path)
    return _INDEXES[path]


def _runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive rows of about ``most`` in sum."""
    begin = size = 0
    for i, n in enumerate(sizes):
        size += n
        if size >= most or i == len(sizes) - 1:
            yield begin, i + 1
            begin, size = i + 1, 0


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) of every whole text under the byte-level BPE at ``path``.

    Nothing is added, truncated or padded. Null and empty texts have no ids. Rows
    with null or repeated doc_ids are encoded as they are; other columns are not
    read. A task holds a few MB of texts at a time, and about 200,000 stretches and words with their ids.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_for(path)
        for batch in batches:
            for a, b in _runs(pa.compute.binary_length(batch.column(1)).fill_null(0).to_pylist(), _BYTES):
                some = batch.slice(a, b - a)
                ids = pa.array(index.encode(some.column(1).to_pylist()), pa.binary())
                yield pa.RecordBatch.from_arrays([some.column(0), ids], names=["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(encoded, f"doc_id {kind}, ids binary")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and text of the rows of :func:`encode_documents`; special tokens give their strings. Null ids give an empty text."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_for(path)
        for batch in batches:
            for a, b in _runs(pa.compute.binary_length(batch.column(1)).fill_null(0).to_pylist(), _BYTES):
                some = batch.slice(a, b - a)
                texts = pa.array([index.decode(x.as_buffer() if x.is_valid else b"") for x in some.column(1)], pa.string())
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), texts], names=["doc_id", "ids", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(decoded, f"doc_id {kind}, ids binary, text string")


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document: encoded and decoded again where it lies, so that neither ids nor texts leave the task."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_for(path)
        for batch in batches:
            for a, b in _runs(pa.compute.binary_length(batch.column(1)).fill_null(0).to_pylist(), _BYTES):
                some = batch.slice(a, b - a)
                ids = index.encode(some.column(1).to_pylist())
                n = pa.array([len(x) // 4 for x in ids], pa.int64())
                hashes = (pa.array([sha256(x).hexdigest() for x in xs], pa.string()) for xs in (ids, (index.decode(x).encode() for x in ids)))
                yield pa.RecordBatch.from_arrays([some.column(0), n, *hashes], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(digests, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
