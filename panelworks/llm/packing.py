"""Packing of tokenised documents into fixed-length sequences by linear grouping."""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

_SPECIAL = "<|endoftext|>"


class Encoder:
    """Ids of the byte-level BPE in a tokenizer file; Latin text goes through the quicker library.

    Both libraries hold the same vocabulary and pattern. A text with special
    strings, or with characters on whose class they might differ, is encoded by
    ``tokenizers`` itself.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(json_path)
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.quick = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if "<|" in text or (not text.isascii() and max(text) >= "ɐ"):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.quick.encode_ordinary(text)


_ENCODERS: dict[str, Encoder] = {}


def pieces(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, end_id: int, length: int, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every document's ids followed by ``end_id``."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if json_path not in _ENCODERS:
            _ENCODERS[json_path] = Encoder(json_path, ranks_path, pattern)
        encoder = _ENCODERS[json_path]
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.ids(text.as_py() or "")
                ids.append(end_id)
                raw = np.array(ids, dtype="<u4")
                at, first = 0, len(ids) % length or length
                for i in range(math.ceil(len(ids) / length)):
                    to = first + i * length
                    out.append((doc, i, at, to - at, crc32(raw[at:to].tobytes()), *([raw[at:to].tolist()] if keep_ids else ())))
                    at = to
            cols = list(zip(*out)) or [()] * (5 + keep_ids)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names[: 5 + keep_ids])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


def linear_groups(counts: dict[int, int], groups: int) -> dict[int, int]:
    """Length -> rounded length: runs of lengths with near-equal numbers of pieces, rounded up to the largest of the run."""
    total, out, done, top, group = sum(counts.values()), {}, 0, 0, -1
    for size in sorted(counts, reverse=True):
        if done * groups // max(total, 1) != group:
            group, top = done * groups // max(total, 1), size
        out[size] = top
        done += counts[size]
    return out


def _best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of greatest worth that fits: a knapsack over capacities, one more piece at a time."""
    best = np.zeros(capacity + 1)
    took: list[np.ndarray] = []
    levels = [best]
    for _ in range(capacity // int(sizes.min())):
        now, arg = levels[-1].copy(), np.full(capacity + 1, -1)
        for i, (s, w) in enumerate(zip(sizes, worth)):
            better = levels[-1][: capacity + 1 - s] + w > now[s:] + 1e-12
            now[s:][better] = (levels[-1][: capacity + 1 - s] + w)[better]
            arg[s:][better] = i
        took.append(arg)
        levels.append(now)
        if (arg < 0).all():
            break
    pattern, room = np.zeros(len(sizes), int), capacity
    for arg in reversed(took):
        if arg[room] >= 0:
            pattern[arg[room]] += 1
            room -= sizes[arg[room]]
    return float(levels[-1][capacity]), pattern


def configurations(sizes: list[int], counts: list[int], capacity: int, most_steps: int = 400) -> list[tuple[tuple[int, ...], int]]:
    """(pieces of each size, times) that cover ``counts`` exactly with few bins.

    Column generation on the linear programme over configurations; its rounded-down
    solution is taken and the few pieces left over are placed best-fit, largest first.
    """
    if not sizes:
        return []
    s, n = np.array(sizes), np.array(counts, dtype=float)
    basis = np.diag(capacity // s).astype(float)
    times = n / np.diag(basis)
    for _ in range(most_steps):
        worth = np.linalg.solve(basis.T, np.ones(len(s)))
        value, pattern = _best_pattern(s, np.maximum(worth, 0), capacity)
        if value <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, pattern.astype(float))
        ratio = np.where(step > 1e-9, times / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        times = np.maximum(times - ratio[out] * step, 0)
        times[out] = ratio[out]
        basis[:, out] = pattern
    left, plan = np.array(counts, dtype=np.int64), []
    for j in range(len(s)):
        col = basis[:, j].astype(np.int64)
        used = col > 0
        t = min(int(times[j] + 1e-6), int((left[used] // col[used]).min()) if used.any() else 0)
        if t > 0:
            plan.append((tuple(map(int, col)), t))
            left -= t * col
    bins: list[list] = []  # room, pattern
    for i in sorted(range(len(s)), key=lambda i: -sizes[i]):
        for _ in range(int(left[i])):
            fit = [b for b in bins if b[0] >= sizes[i]]
            b = min(fit, key=lambda b: b[0]) if fit else None
            if b is None:
                bins.append(b := [capacity, [0] * len(s)])
            b[0] -= sizes[i]
            b[1][i] += 1
    return plan + [(tuple(b[1]), 1) for b in bins]


def best_fit(rooms: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Index of the bin for each length, longest first into the tightest room; from len(rooms) on, new bins."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i, r in enumerate(rooms):
        by_room[int(r)].append(i)
    filled = sum(1 << r for r in range(capacity + 1) if by_room[r])
    out, bins = np.empty(len(lengths), np.int64), len(rooms)
    for k in np.argsort(-lengths, kind="stable"):
        size = int(lengths[k])
        over = filled >> size
        if over:
            room = size + (over & -over).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                filled &= ~(1 << room)
        else:
            room, b, bins = capacity, bins, bins + 1
        out[k] = b
        by_room[room - size].append(b)
        filled |= 1 << (room - size)
    return out


def pack(cut: DataFrame, length: int = 1024, small: int = 128, groups: int = 96, block: int = 20_000) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ...) of 1 to ``length`` tokens.

    Pieces of more than ``small`` tokens are rounded up within ``groups`` groups of
    near-equal cardinality; configurations of the few rounded sizes are optimised
    on the driver from the histogram of lengths (at most ``length`` numbers); the
    r-th actual piece of a group takes the r-th place that the configurations have
    for it. Small pieces then go best-fit into the room that is left, in blocks of
    about ``block`` sequences, so no task's share grows with the corpus.
    """
    cut = checkpoint(cut)
    spark = cut.sparkSession
    hist = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    large = {s: n for s, n in hist.items() if small < s < length}
    rounded = linear_groups(large, groups) | ({length: length} if length in hist else {})
    sizes = sorted({s for s in rounded.values() if s < length}, reverse=True)
    counts = [sum(large[s] for s in large if rounded[s] == size) for size in sizes]
    plan = configurations(sizes, counts, length)
    places, base = [], 0  # size, first and last rank, pieces a sequence, first sequence, place of the first piece
    done = dict.fromkeys(sizes, 0)
    for pattern, times in plan:
        for size, n in zip(sizes, pattern):
            if n:
                places.append((size, done[size], done[size] + n * times, n, base))
                done[size] += n * times
        base += times
    if length in hist:
        places.append((length, 0, hist[length], 1, base))
        base += hist[length]
    total_small = sum(n for s, n in hist.items() if s <= small)

    spread = int(spark.conf.get("spark.sql.shuffle.partitions")) * 2
    grouped = F.create_map(*[F.lit(x) for kv in rounded.items() for x in kv])[F.col("length")] if rounded else F.lit(None)
    big = cut.where(F.col("length") > small).withColumn("size", grouped.cast("long"))
    big = big.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(spread)))
    rows = Window.partitionBy("size", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    # A count for each (size, bucket): a few thousand rows at any size.
    ahead = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = big.groupBy("size", "bucket").agg(F.count("*").alias("n"))
    before = before.select("size", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    ranked = big.withColumn("rank", F.row_number().over(rows) - 1).join(before, ["size", "bucket"])
    table = spark.createDataFrame(places or [(0, 0, 0, 1, 0)], "size long, lo long, hi long, each long, base long")
    at = F.col("rank") + F.col("ahead")
    placed = (
        ranked.join(F.broadcast(table), "size")  # at most sizes x configurations rows
        .where((at >= F.col("lo")) & (at < F.col("hi")))
        .withColumn("sequence_id", F.expr("base + (rank + ahead - lo) div each"))
        .select(*cut.columns, "sequence_id")
    )
    if total_small:
        placed = checkpoint(placed)
        blocks = max(1, math.ceil(max(base, total_small) / block))
        rooms = placed.where(F.col("length") < length).groupBy("sequence_id").agg((length - F.sum("length")).alias("room"))
        rooms = rooms.where("room > 0").withColumn("block", F.pmod(F.xxhash64("sequence_id"), F.lit(blocks)))
        little = cut.where(F.col("length") <= small).withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", F.lit(7)), F.lit(blocks)))

        def fill(key: tuple, bins: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
            number = int((key[0] if key else 0) or 0)
            bins = bins.sort_values("sequence_id")
            items = items.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable")
            where = best_fit(bins["room"].to_numpy(), items["length"].to_numpy(), length)
            known = bins["sequence_id"].to_numpy(dtype=np.int64)
            new = base + (np.int64(number) << 32) + where - len(known)
            seq = np.where(where < len(known), known[np.minimum(where, len(known) - 1)], new) if len(known) else new
            return items.drop(columns="block").assign(sequence_id=seq.astype(np.int64))

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema)
        rest = rooms.groupBy("block").cogroup(little.groupBy("block")).applyInPandas(fill, schema)
        placed = placed.unionByName(rest)
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "piece", "ids_crc32")
    return placed.withColumn(
        "offset", F.coalesce(F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    )


def pack_documents(
    docs: DataFrame, json_path: str, ranks_path: str, pattern: str, end_id: int = 2, length: int = 1024, keep_ids: bool = False
) -> DataFrame:
    """Tokenise, cut and pack ``docs``: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset.

    A null text is empty and gives the one id ``end_id``. Only documents longer
    than ``length`` are cut, the first piece being the shorter one. Every row
    gives its pieces, repeated rows and null doc_ids too; other columns are not read.
    """
    return pack(pieces(docs, json_path, ranks_path, pattern, end_id, length, keep_ids), length)
