"""Near-duplicate embeddings by E8 lattice hashing, verified by cosine."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, connected_components, join_on_hot, mix, signed


def e8_points(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two nearest E8 lattice points of each row, as doubled integer coordinates, nearest first.

    E8 is D8 and D8 shifted by a half. In each of them the nearest point rounds
    every coordinate and, for an even sum, moves the one that costs least; the
    next one moves the next cheapest, or the two cheapest.
    """
    found, cost = [], []
    for shift in (0.0, 0.5):
        y = x - shift
        r = np.rint(y)
        rest = y - r
        price = 1 - 2 * np.abs(rest)
        order = np.argsort(price, axis=1)
        rows = np.arange(len(x))
        odd = (r.sum(1).astype(np.int64) & 1).astype(bool)
        way = np.where(rest >= 0, 1.0, -1.0)
        base = (rest**2).sum(1)
        c1, c2 = order[:, 0], order[:, 1]
        p1, p2 = price[rows, c1], price[rows, c2]
        near, far = r.copy(), r.copy()
        near[rows[odd], c1[odd]] += way[rows[odd], c1[odd]]
        far[rows[odd], c2[odd]] += way[rows[odd], c2[odd]]
        even = ~odd
        for c in (c1, c2):
            far[rows[even], c[even]] += way[rows[even], c[even]]
        found += [2 * (near + shift), 2 * (far + shift)]
        cost += [base + np.where(odd, p1, 0), base + np.where(odd, p2, p1 + p2)]
    best = np.argsort(np.stack(cost, 1), axis=1, kind="stable")[:, :2]
    points = np.stack(found, 1)
    rows = np.arange(len(x))
    return points[rows, best[:, 0]].astype(np.int64), points[rows, best[:, 1]].astype(np.int64)


def projections(dim: int, tables: int, blocks: int, seed: int = 7) -> np.ndarray:
    """(tables, blocks * 8, dim) random directions, orthonormal within a table where ``dim`` allows."""
    rng = np.random.default_rng([seed, dim])
    out = []
    for _ in range(tables):
        g = rng.standard_normal((max(blocks * 8, 1), dim))
        if blocks * 8 <= dim:
            g = np.linalg.qr(g.T)[0].T
        out.append(g * np.sqrt(dim) if blocks * 8 <= dim else g)
    return np.stack(out)


def cells(unit: np.ndarray, tables: int, blocks: int, scale: float) -> np.ndarray:
    """(rows, tables, 1 + probes) cell numbers: a vector's own cell first, then those with one block at its second point."""
    n, dim = unit.shape
    out = np.empty((n, tables, 1 + blocks), np.uint64)
    for t, p in enumerate(projections(dim, tables, blocks)):
        z = (unit @ p.T) * scale
        near, far = zip(*(e8_points(z[:, 8 * b : 8 * b + 8]) for b in range(blocks)))

        def number(points: list[np.ndarray], t: int = t) -> np.ndarray:
            h = np.full(n, np.uint64(t * 1_000_003 + dim))
            for c in np.concatenate(points, 1).T:
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.int64).view(np.uint64))
            return h

        out[:, t, 0] = number(list(near))
        for b in range(blocks):
            out[:, t, 1 + b] = number([far[i] if i == b else near[i] for i in range(blocks)])
    return out


def prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, key, unit): a digest of the vector's values and its unit vector as doubles; null if it can't link."""

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, units = [], []
            for v in batch.column(1):
                values = v.as_py()
                x = np.array([np.nan if e is None else e for e in values], np.float64) + 0.0 if values else np.empty(0)
                norm = np.linalg.norm(x) if len(x) and np.isfinite(x).all() else 0.0
                ok = 0 < norm < np.inf
                keys.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if ok else None)
                units.append((x / norm).tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(units, pa.binary())], names=["vec_id", "key", "unit"])

    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where("vec_id is not null")
    return rows.mapInArrow(prepare, "vec_id long, key binary, unit binary")


def placed(units: DataFrame, tables: int, blocks: int, scale: float) -> DataFrame:
    """(id, n, unit, cells): every vector's cells, table by table, its own one before those that it probes."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(2).to_pylist()
            sizes = np.array([len(u) for u in raw])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                for part in np.array_split(at, max(1, len(at) * tables * (1 + blocks) // 100_000)):
                    unit = np.stack([np.frombuffer(raw[i], np.float64) for i in part])
                    c = signed(cells(unit, tables, blocks, scale).reshape(-1))
                    ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * (tables * (1 + blocks)))
                    some = batch.take(pa.array(part))
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.ListArray.from_arrays(ends, pa.array(c))], names=["id", "n", "unit", "cells"])

    return units.select("id", "n", "unit").mapInArrow(place, "id long, n long, unit binary, cells array<long>")


def group_links(ids: np.ndarray, n: np.ndarray, own: np.ndarray, part: np.ndarray | None, x: np.ndarray, c: np.ndarray, cell: int, cosine: float) -> tuple[np.ndarray, ...]:
    """(ids, others, roots) of the vectors of a cell that link here: the vectors linked, copies included, and the smallest id reached.

    A pair meets here if one's own cell is this one. It counts only in the first
    cell, in the order of the tables, in which it meets, and, if the rows are of
    two parts of a large cell (``part``), only across them. c: each vector's cells, (rows, tables, 1 + probes).
    """
    home = np.flatnonzero(own)
    i, j = np.nonzero(x[home] @ x.T >= cosine)
    i = home[i]
    keep = (i != j) & ~(own[j] & (i > j))  # of two own ones, one order
    if part is not None:
        keep &= part[i] != part[j]
    i, j = i[keep], j[keep]
    a, b = np.where(ids[i] < ids[j], i, j), np.where(ids[i] < ids[j], j, i)
    here = np.zeros(len(a), bool)
    for k in range(0, len(a), 20_000):
        p, q = c[a[k : k + 20_000]], c[b[k : k + 20_000]]
        mine = (p[:, :, :1] == q).any(2)  # the first one's own cell is one of the other's
        meet = mine | (q[:, :, :1] == p[:, :, 1:]).any(2)
        rows, first = np.arange(len(p)), meet.argmax(1)
        here[k : k + 20_000] = np.where(mine[rows, first], p[rows, first, 0], q[rows, first, 0]) == cell
    a, b = a[here], b[here]
    root = ids.copy()
    while len(a):
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        if (low == root).all():
            break
        root = low
    others = np.zeros(len(ids), np.int64)
    np.add.at(others, a, n[b])
    np.add.at(others, b, n[a])
    linked = others > 0
    return ids[linked], others[linked], root[linked]


def linked(units: DataFrame, cosine: float, tables: int, blocks: int, scale: float, block: int = 1500) -> DataFrame:
    """(id, others, root) of vectors (id, n, unit) with a cosine of ``cosine`` or more that share a cell, or one's cell with the other's probe.

    A row for every cell in which a vector has links: how many vectors it links
    to there, copies included, and the smallest id that these links reach there.
    Every pair counts in one cell, so sums are exact and no pair leaves its task.
    """
    rows = checkpoint(placed(units, tables, blocks, scale))
    thin = rows.select("id", F.posexplode("cells").alias("pos", "cell")).select("id", "cell", (F.col("pos") % (1 + blocks) == 0).alias("own"))
    many = thin.groupBy("cell").agg(F.count("*").alias("size"), F.count_if("own").alias("homes")).where("size > 1 and homes > 0")
    met = thin.join(many, "cell").withColumn("parts", F.ceil(F.col("size") / block).cast("int"))
    met = met.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    # A large cell is compared part by part: each row meets every part once, in a task of its own.
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("id", "cell", "own", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; the last group of a batch waits for the next one."""
        rest: pa.Table | None = None

        def links(t: pa.Table, ends: np.ndarray) -> pa.RecordBatch:
            own, ids, n, part, cell, lo, hi = (t.column(c).to_numpy() for c in ("own", "id", "n", "part", "cell", "lo", "hi"))
            units = t.column("unit").combine_chunks()
            at = np.frombuffer(units.buffers()[1], np.int32)[units.offset : units.offset + len(units) + 1] // 8
            data = np.frombuffer(units.buffers()[2], np.float64)
            placed = np.asarray(t.column("cells").combine_chunks().flatten()).reshape(len(ids), tables, 1 + blocks)
            found, start = [[np.empty(0, np.int64)] * 3], 0
            for end in ends:
                s = slice(start, end)
                if end - start > 1 and own[s].any():
                    x = data[at[start] : at[end]].reshape(end - start, -1)
                    found.append(group_links(ids[s], n[s], own[s], part[s] if lo[start] != hi[start] else None, x, placed[s], cell[start], cosine))
                start = end
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["id", "others", "root"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
            key = np.stack([t.column(c).to_numpy() for c in ("cell", "lo", "hi")])
            ends = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            if len(ends):
                yield links(t.slice(0, int(ends[-1])).combine_chunks(), ends)
                t = t.slice(int(ends[-1]))
            rest = t
        if rest is not None and len(rest):
            yield links(rest.combine_chunks(), np.array([len(rest)]))

    full = met.join(rows, "id").select("cell", "lo", "hi", "part", "own", "id", "n", "unit", "cells")
    return full.repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi").mapInArrow(compare, "id long, others long, root long")


def vector_duplicates(vectors: DataFrame, cosine: float = 0.95, tables: int = 10, blocks: int = 2, scale: float = 0.45, block: int = 1500) -> DataFrame:
    """Links of near-equal vectors: vec_id, n_links, component_id, kept.

    Vectors of equal values form a class and are compared once. Unit vectors are
    projected, per table, on ``blocks`` x 8 random directions, and each 8 numbers
    are decoded to a point of the E8 lattice scaled by ``scale``; the points name
    the cell. A vector also looks into the cells with one block at its second
    nearest point. Vectors that meet are compared by cosine in double precision,
    large cells ``block`` by ``block``, and linked from ``cosine`` on. n_links
    counts the other vectors linked, copies one by one; a component is named by
    its smallest vec_id, and that one is kept.

    Null, zero or empty vectors, and those with null or non-finite components,
    link with nothing; vectors of different lengths do not link. Rows with null
    vec_ids give no row. Repeated vec_ids give one: of their vectors that can link,
    the one of the smallest key stands for the id, and the others are not compared.
    """
    one = F.min_by(F.struct("key", "unit"), "key").alias("v")
    each = checkpoint(prepared(vectors).groupBy("vec_id").agg(one).select("vec_id", "v.key", "v.unit"))
    valid = each.where("key is not null")
    classes = checkpoint(valid.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("unit").alias("unit")))
    found = checkpoint(linked(classes.select(F.col("rep").alias("id"), "n", "unit"), cosine, tables, blocks, scale, block))
    links = found.groupBy(F.col("id").alias("rep")).agg(F.sum("others").alias("others"))
    component = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("rep"), "component")
    named = classes.select("key", "rep", "n").join(links, "rep", "left").join(component, "rep", "left")
    named = checkpoint(named.select("key", "n", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    out = join_on_hot(valid.select("vec_id", "key"), named, "key", "n").select("vec_id", "n_links", "component_id")
    out = out.union(each.where("key is null").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
