"""Benchmark items inside documents: size-partitioned MinHash containment search."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, mix, shingles, signed, small, word_hashes, words


def sketch_length(n_shingles: int, threshold: float) -> int:
    """Signature length of the size partition of an item with so many distinct shingles.

    Partitions are powers of two. A document that holds ``threshold`` of an item's
    shingles misses at most ``floor((1 - threshold) * n)`` of them, so one more
    minimum than that, at the partition's upper size, cannot all be missed.
    """
    top = 1 << max(n_shingles - 1, 0).bit_length()
    return math.floor((1 - threshold) * top + 1e-9) + 1


def sized_shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words; of a text of fewer words, that of all its words, which differs from any of ``k``."""
    n = min(k, len(hashes))
    s = shingles(hashes, n) if n else np.empty(0, np.uint64)
    return s if n == k else mix(s + np.uint64(n))


def item_sketches(items: DataFrame, k: int, threshold: float) -> DataFrame:
    """(item_id, need, h, n): the minima of each item's shingle hashes, as many as its size partition asks for; n: words of a shingle."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, need, out, size = [], [], [], []
            for item, text in zip(*(c.to_pylist() for c in batch.columns)):
                w = word_hashes(words(text or ""))
                s = np.unique(sized_shingles(w, k))
                low = s[: sketch_length(len(s), threshold)]
                missed = math.floor((1 - threshold) * len(s) + 1e-9)
                ids += [item] * len(low)
                need += [max(1, len(low) - missed)] * len(low)
                size += [min(k, len(w))] * len(low)
                out.append(low)
            h = signed(np.concatenate(out)) if out else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(need, pa.int32()), pa.array(h), pa.array(size, pa.int32())], names=["item_id", "need", "h", "n"])

    return items.select(F.col("item_id").cast("long"), "text").where("item_id is not null").mapInArrow(sketch, "item_id long, need int, h long, n int")


def document_shingles(docs: DataFrame, k: int, short: list[int], rows: int = 400_000) -> DataFrame:
    """(doc_id, h): all ``k``-word shingle hashes of all documents, repeated ones too, and the different ones of each length in ``short``."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: list[int] = []
            parts: list[np.ndarray] = []
            n = 0

            def done() -> pa.RecordBatch:
                at = np.repeat(np.array(ids, np.int64), [len(p) for p in parts])
                h = signed(np.concatenate(parts)) if parts else np.empty(0, np.int64)
                return pa.RecordBatch.from_arrays([pa.array(at), pa.array(h)], names=["doc_id", "h"])

            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                w = word_hashes(words(text.as_py() or ""))
                s = np.concatenate([shingles(w, k), *(np.unique(mix(shingles(w, n) + np.uint64(n))) for n in short)])
                ids.append(doc)
                parts.append(s)
                n += len(s)
                if n >= rows:
                    yield done()
                    ids, parts, n = [], [], 0
            if n:
                yield done()

    return docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null").mapInArrow(emit, "doc_id long, h long")


def contaminated_pairs(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8, most_broadcast: int = 200_000) -> DataFrame:
    """Pairs (doc_id, item_id, n_item_shingles, n_shared, containment) with containment >= ``threshold``.

    Containment is the share of an item's distinct ``k``-word shingles (lower-cased
    words) that the document has. Items fall into partitions by size, each with a
    MinHash signature long enough that no pair over the threshold can miss it;
    documents whose shingles meet too few of an item's minima are dropped, and the
    rest are compared by their exact shingles. The signatures are broadcast only
    if they are at most ``most_broadcast`` rows, else both sides shuffle by hash.

    An item of fewer than ``k`` words has one shingle, all its words: documents that
    hold them side by side are found. Null and empty texts and those without words
    hold and are held by nothing; null ids give no row; repeated doc_ids or item_ids give one row a pair, with
    the greatest containment. Other columns are not read.
    """
    sketches = checkpoint(item_sketches(items, k, threshold))
    short = sorted(r["n"] for r in sketches.select("n").where(F.col("n") < k).distinct().collect())  # at most k - 1 numbers
    sketches = sketches.drop("n")
    hits = document_shingles(docs, k, short).join(small(sketches, most_broadcast), "h").groupBy("doc_id", "item_id", "h").agg(F.max("need").alias("need"))
    near = checkpoint(hits.groupBy("doc_id", "item_id").agg(F.count("*").alias("n"), F.min("need").alias("need")).where("n >= need").select("doc_id", "item_id"))
    ids = small(checkpoint(near.select("doc_id").distinct()), 1_000_000)
    found = docs.select(F.col("doc_id").cast("long"), F.col("text").alias("doc_text")).join(ids, "doc_id")
    questions = items.select(F.col("item_id").cast("long"), F.col("text").alias("item_text"))
    pairs = found.join(near, "doc_id").join(questions, "item_id")

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        exact: dict[str, tuple[int, set]] = {}

        def of(ws: list[bytes], n: int) -> set:
            return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if n else set()

        for f in frames:
            rows, last, ws, have = [], None, [], {}
            for doc, item, text, question in zip(f["doc_id"], f["item_id"], f["doc_text"], f["item_text"]):
                if question not in exact:
                    if len(exact) > 10_000:
                        exact.clear()
                    asked = words(question or "")
                    exact[question] = min(k, len(asked)), of(asked, min(k, len(asked)))
                if last is not text:
                    last, ws, have = text, words(text or ""), {}
                size, want = exact[question]
                if size not in have:
                    have[size] = of(ws, size)
                n = len(want & have[size])
                if want and n >= threshold * len(want) - 1e-9:
                    rows.append((doc, item, len(want), n, n / len(want)))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "n_item_shingles", "n_shared", "containment"])

    schema = "doc_id long, item_id long, n_item_shingles long, n_shared long, containment double"
    exact = pairs.select("doc_id", "item_id", "doc_text", "item_text").mapInPandas(verify, schema)
    best = F.max(F.struct("containment", "n_shared", "n_item_shingles")).alias("best")
    return exact.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.n_item_shingles", "best.n_shared", "best.containment")


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item.

    A text decides by itself: rows are told apart by a 64-bit hash of their texts,
    so repeated and null doc_ids take no other text along. Null texts stay.
    """
    text, key = F.col("text"), "_text_hash"
    while key in docs.columns:
        key += "_"
    texts = docs.where("text is not null").select(F.xxhash64(text).alias("doc_id"), "text")
    found = checkpoint(contaminated_pairs(texts, items, **options).select(F.col("doc_id").alias(key)).distinct())
    return docs.withColumn(key, F.when(text.isNotNull(), F.xxhash64(text))).join(small(found, 1_000_000), key, "left_anti").select(*docs.columns)
