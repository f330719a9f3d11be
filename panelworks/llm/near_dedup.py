"""Near duplicates by Order MinHash, verified by banded alignment."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, compact, compacted, connected_components, counted, join_on_hot, mix, parts_of, shingles, signed, small, spread, word_hashes, words

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Bins of a text's words, and the count that stands for all larger ones.
_BITS, _MOST = 10, 65_535
_BINS = 1 << _BITS
#: Pairs that one task aligns.
_PAIRS = 2_000


def labelled(s: np.ndarray) -> np.ndarray:
    """Shingle hashes made distinct by the number of their earlier occurrences."""
    order = np.argsort(s, kind="stable")
    same = np.r_[False, s[order][1:] == s[order][:-1]] if len(s) else np.empty(0, bool)
    if not same.any():
        return s
    n = np.arange(len(s))
    start = np.maximum.accumulate(np.where(same, 0, n))
    times = np.empty(len(s), np.uint64)
    times[order] = n - start
    return np.where(times > 0, mix(s + times * _GOLDEN), s)


def order_minhash(s: np.ndarray, samples: int, seeds: np.ndarray) -> np.ndarray:
    """For each sample, a hash of its two minimum labelled k-mers in the order of the text."""
    x = labelled(s)
    if len(x) == 1:
        return mix(x[0] + seeds)
    out = np.empty(samples, np.uint64)
    step = max(1, 4_000_000 // (8 * max(len(x), 1)))
    for i in range(0, samples, step):
        h = (x[None, :] ^ seeds[i : i + step, None]) * _GOLDEN
        h ^= h >> np.uint64(29)
        row = np.arange(len(h))
        first = h.argmin(1)
        h[row, first] = np.uint64(0xFFFFFFFFFFFFFFFF)
        second = h.argmin(1)
        a, b = x[np.minimum(first, second)], x[np.maximum(first, second)]
        out[i : i + step] = mix(a * _GOLDEN + b + seeds[i : i + step])
    return out


def banded_distance(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Edits (words put in, left out or exchanged) that turn ``a`` into ``b``; None if over ``most``.

    For each number of edits, the furthest word reached on each diagonal of the
    band from which the end is still in reach: from the neighbouring diagonals
    with one edit less, then along equal words. A whole band is one array.
    """
    n, m = len(a), len(b)
    end = m - n
    if abs(end) > most:
        return None
    pad = 128
    x = np.concatenate([a.astype(np.int64), np.full(pad + 1, -1)])
    y = np.concatenate([b.astype(np.int64), np.full(pad + 1, -2)])
    ahead = np.arange(pad)

    def slide(i: np.ndarray, d: np.ndarray) -> np.ndarray:
        on = np.flatnonzero(x[i] == y[i + d])
        while len(on):
            width = pad if len(on) < 16 else 16
            same = x[i[on, None] + ahead[:width]] == y[(i + d)[on, None] + ahead[:width]]
            run = np.where(same.all(1), width, same.argmin(1))
            i[on] += run
            on = on[run == width]
        return i

    low, reach = 0, slide(np.zeros(1, np.int64), np.zeros(1, np.int64))  # reach[k]: on diagonal low + k
    edits = 0
    while not (low <= end < low + len(reach)) or reach[end - low] < n:
        edits += 1
        if edits > most:
            return None
        first = max(-edits, end - (most - edits), -n)
        last = min(edits, end + (most - edits), m)
        wide = np.full(last - first + 3, -2, np.int64)  # diagonals first - 1 .. last + 1 of the step before
        lo, hi = max(low, first - 1), min(low + len(reach) - 1, last + 1)
        if lo <= hi:
            wide[lo - first + 1 : hi - first + 2] = reach[lo - low : hi - low + 1]
        d = np.arange(first, last + 1)
        i = np.maximum(np.maximum(wide[1:-1] + 1, wide[:-2]), wide[2:] + 1)
        i = np.minimum(np.minimum(i, n), m - d)
        ok = (i >= 0) & (i + d >= 0)
        i[ok] = slide(i[ok], d[ok])
        i[~ok] = -2
        low, reach = first, i
    return edits


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = 0.8) -> float:
    """1 - edits / length of the longer text, by a banded alignment of two word sequences; 0 if under ``threshold``.

    The threshold bounds the edits and so the band. Words that two texts have in
    common, in any order, bound the similarity too: texts that share too few are
    not aligned. Common ends are cut first. Two texts without words are equal.
    """
    longer = max(len(a), len(b))
    if not longer:
        return 1.0
    most = math.floor((1 - threshold) * longer + 1e-9)
    if longer - min(len(a), len(b)) > most:
        return 0.0
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    differ = np.flatnonzero(a[::-1][: n - head] != b[::-1][: n - head])
    tail = int(differ[0]) if len(differ) else n - head
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    if max(len(x), len(y)) > most:
        (u, nu), (v, nv) = (np.unique(w, return_counts=True) for w in (x, y))
        _, iu, iv = np.intersect1d(u, v, assume_unique=True, return_indices=True)
        if max(len(x), len(y)) - int(np.minimum(nu[iu], nv[iv]).sum()) > most:
            return 0.0
    edits = banded_distance(x, y, most)
    return 0.0 if edits is None else 1 - edits / longer


def histogram(w: np.ndarray) -> np.ndarray:
    """Words in each bin, ``_MOST`` standing for all larger counts. Two texts share at most the sum of the lesser counts."""
    return np.minimum(np.bincount((w >> np.uint32(32 - _BITS)).astype(np.intp), minlength=_BINS), _MOST).astype(np.uint16)


def may_reach(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    """Whether texts of histograms ``a`` and ``b`` and ``n`` and ``m`` words, row by row, can have a similarity of ``threshold``."""
    longer, shorter = np.maximum(n, m), np.minimum(n, m)
    shared = np.minimum(np.minimum(a, b).sum(1, dtype=np.int64), shorter)
    return (shared >= threshold * longer - 1e-9) | (shorter >= threshold * longer - 1e-9) & ((a == _MOST).any(1) | (b == _MOST).any(1))


def text_key(text: Column, doc_id: Column) -> Column:
    """Equal for equal texts; a null text has a key of its own doc_id."""
    return F.coalesce(F.unhex(F.md5(text.cast("binary"))), F.concat(F.lit("null ").cast("binary"), doc_id.cast("string").cast("binary")))


def sketches(docs: DataFrame, k: int, samples: int) -> DataFrame:
    """(doc_id, text_key, n_words, sketch): Order MinHash of every document; texts with equal keys are equal."""
    seeds = mix(np.arange(1, samples + 1, dtype=np.uint64) * _GOLDEN)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, out = [], []
            for text in batch.column(2):
                h = word_hashes(words(text.as_py() or ""))
                s = shingles(h, min(k, len(h))) if len(h) else h
                n.append(len(h))
                out.append(signed(order_minhash(s, samples, seeds)) if len(h) else None)
            cols = [batch.column(0), batch.column(1), pa.array(n, pa.int32()), pa.array(out, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_key", "n_words", "sketch"])

    doc_id = F.col("doc_id").cast("long")
    rows = docs.where("doc_id is not null").select(doc_id.alias("doc_id"), text_key(F.col("text"), doc_id).alias("text_key"), "text")
    return rows.mapInArrow(emit, "doc_id long, text_key binary, n_words int, sketch array<long>")


def _hashed_texts(docs: DataFrame, wanted: DataFrame, repeated: bool) -> DataFrame:
    """(node, n, w, bins) of the texts of the classes in ``wanted`` (node, text_key, doc_id): 4-byte word hashes and their histograms."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [word_hashes(words(t.as_py() or "")) for t in batch.column(1)]
            cols = [pa.array([len(w) for w in out], pa.int32()), pa.array([w.tobytes() for w in out], pa.binary()), pa.array([histogram(w).tobytes() for w in out], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["node", "n", "w", "bins"])

    doc_id = F.col("doc_id").cast("long")
    texts = docs.select(doc_id.alias("doc_id"), "text").join(small(wanted, 500_000), "doc_id")
    texts = texts.where(text_key(F.col("text"), F.col("doc_id")) == F.col("text_key")).select("node", "text")
    out = texts.mapInArrow(hashed, "node long, n int, w binary, bins binary")
    return checkpoint(out.dropDuplicates(["node"]) if repeated else out)


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts align."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                similarity(np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32), threshold) >= threshold - 1e-9
                for x, y in zip(batch.column(2), batch.column(3))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # Whole texts: never broadcast, so only a partition's of them are in memory.
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("w").alias("wa")).hint("merge"), "a")
    both = both.join(texts.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("w").alias("wb")).hint("merge"), "b")
    both = both.where(F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9)
    return both.select("a", "b", "wa", "wb").mapInArrow(check, "a long, b long")


def _joined(clusters: DataFrame, links: DataFrame) -> DataFrame:
    """(node, cluster) after ``links`` (a, b) between nodes, which join whole clusters: only links between two of them count."""
    ca, cb = clusters.toDF("a", "ca"), clusters.toDF("b", "cb")
    edges = links.join(ca, "a").join(cb, "b").where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"))
    found = connected_components(edges.coalesce(parts_of(links)).distinct()).select(F.col("node").alias("cluster"), F.col("component").alias("now"))
    named = clusters.join(found, "cluster", "left").coalesce(parts_of(clusters))
    return compact(named.select("node", F.coalesce("now", "cluster").alias("cluster")))


def _named_cells(shared: DataFrame, clusters: DataFrame, *more: str) -> DataFrame:
    """(node, cluster, h): the buckets of every node, with ``more`` columns."""
    parts = parts_of(shared)
    return shared.join(clusters, "node").coalesce(parts).select("node", "cluster", *more, F.explode("cells").alias("h"))


def _across(shared: DataFrame, sketched: DataFrame, clusters: DataFrame, least: int, threshold: float, block: int = 128) -> DataFrame:
    """(a, b): every two nodes of different clusters that share at least ``least`` samples and may reach ``threshold``.

    A bucket is split by text length, in bands so wide that two texts over the
    threshold lie in the same or neighbouring ones, and each band into blocks;
    blocks are compared two by two, each a row. A pair comes from the bucket of
    the first sample that it shares.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def plain(x: pa.StructScalar) -> tuple[np.ndarray, ...]:
            rows = x.values
            ids, of, n = (np.asarray(rows.field(c)) for c in ("node", "cluster", "n"))
            bins = np.frombuffer(b"".join(rows.field("bins").to_pylist()), np.uint16)
            return ids, of, n, np.asarray(rows.field("sketch").flatten()).reshape(len(ids), -1), bins.reshape(len(ids), -1)

        for batch in batches:
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for h, one, xs, ys in zip(*(batch.column(i) for i in range(4))):
                (ia, ca, na, sa, ha), (ib, cb, nb, sb, hb) = plain(xs), plain(ys)
                here = int((sa[0] == h.as_py()).argmax())  # the sample whose bucket this is
                same = np.zeros((len(ia), len(ib)), np.uint16)
                for k, (u, v) in enumerate(zip(sa.T, sb.T)):
                    equal = u[:, None] == v[None, :]
                    if k == here:
                        keep = equal & (same == 0)
                    same += equal
                keep &= (same >= least) & (ca[:, None] != cb[None, :])
                if one.as_py():
                    keep = np.triu(keep, 1)
                i, j = np.nonzero(keep)
                near = may_reach(ha[i], hb[j], na[i], nb[j], threshold)
                i, j = i[near], j[near]
                a.append(np.minimum(ia[i], ib[j]))
                b.append(np.maximum(ia[i], ib[j]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    band = F.floor(F.log(F.col("n")) / -math.log(threshold)).cast("int")
    named = checkpoint(_named_cells(shared, clusters, band.alias("band")))
    parts = parts_of(named)
    sizes = named.groupBy("h", "band").agg(F.count("*").alias("size"), F.min("cluster").alias("x"), F.max("cluster").alias("y"))
    sizes = compact(sizes.coalesce(parts))
    mixed = sizes.groupBy("h").agg(F.min("x").alias("x"), F.max("y").alias("y")).where("x < y").select("h")
    wide = sizes.select("h", "band", "size").join(mixed, "h").coalesce(parts)
    rows = named.join(wide, ["h", "band"]).coalesce(parts).join(sketched, "node").coalesce(parts)
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / block)).cast("int").alias("part")
    blocks = compact(rows.groupBy("h", "band", part).agg(F.collect_list(F.struct("node", "cluster", "n", "sketch", "bins")).alias("rows")).coalesce(parts), 2_000)
    left = blocks.select("h", F.struct("band", "part").alias("p"), F.col("rows").alias("xs"))
    right = blocks.select("h", F.struct("band", "part").alias("q"), F.col("rows").alias("ys"))
    both = left.join(right, "h").where("q.band <= p.band + 1 and (p < q or (p = q and size(xs) > 1))")
    return both.select("h", F.expr("p = q").alias("one"), "xs", "ys").mapInArrow(compare, "a long, b long")


def _classes(docs: DataFrame, k: int, samples: int) -> tuple[DataFrame, DataFrame]:
    """Members (text_key, doc_id, copies) and classes (node, text_key, doc_id, size, n, sketch) of equal texts.

    ``node`` numbers a class, whatever the doc_ids; doc_id is the class's smallest.
    """
    keys = checkpoint(sketches(docs, k, samples))
    members = checkpoint(keys.groupBy("text_key", "doc_id").agg(F.count("*").alias("copies")))
    first = F.min_by(F.struct("doc_id", F.col("n_words").alias("n"), "sketch"), "doc_id").alias("s")
    classes = keys.groupBy("text_key").agg(first, F.count("*").alias("size"))
    return members, checkpoint(classes.select(F.monotonically_increasing_id().alias("node"), "text_key", "size", "s.*"))


def _clusters(docs: DataFrame, classes: DataFrame, repeated: bool, threshold: float, least: int, rounds: int) -> DataFrame | None:
    """(node, cluster) of all classes that share a bucket with another one; None if there are none."""
    one = classes.where("sketch is not null")
    cells = one.select("node", F.explode("sketch").alias("h"))  # samples have seeds of their own: h tells them apart
    full = cells.groupBy("h").agg(F.count("*").alias("size")).where("size > 1")
    shared = cells.join(full, "h").groupBy("node").agg(F.collect_list("h").alias("cells"), F.sum("size").alias("weight"))
    shared, n = compacted(shared.join(one.select("node", "n"), "node"), 10_000)  # at most a row a sample in a group
    if not n:
        return None
    wanted = shared.select("node").join(classes.select("node", "text_key", "doc_id"), "node")
    texts = _hashed_texts(docs, checkpoint(wanted), repeated)
    clusters = shared.select("node", F.col("node").alias("cluster"))
    clusters._parts = parts_of(shared)
    tried = seen = None

    def add(pairs: DataFrame, n: int) -> None:
        nonlocal clusters
        good, n = compacted(_verified(spread(pairs, n, _PAIRS), texts, threshold))
        if n:
            clusters = _joined(clusters, good)

    for _ in range(rounds):
        named = checkpoint(_named_cells(shared, clusters, "weight"))
        parts = parts_of(named)
        free = named
        if tried is not None:
            done = tried.join(clusters, "node").coalesce(parts).select("h", "cluster").distinct()
            free = named.join(done, ["h", "cluster"], "left_anti").coalesce(parts)
        centre = free.groupBy("h").agg(F.max_by(F.struct("node", "cluster"), F.struct("weight", -F.col("node"))).alias("c")).coalesce(parts)
        centre = compact(centre.select("h", F.col("c.node").alias("a"), F.col("c.cluster").alias("of")))
        pairs = named.join(centre, "h").where("cluster <> of").coalesce(parts).select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
        if seen is not None:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        pairs, n = counted(pairs.coalesce(parts))
        if not n:
            break
        seen = pairs if seen is None else seen.union(pairs)
        add(pairs, n)
        now = centre.select("h", F.col("a").alias("node"))
        tried = now if tried is None else tried.union(now)
    sketched = texts.select("node", "n", "bins").join(one.select("node", "sketch"), "node")
    rest = _across(shared, sketched, clusters, least, threshold)
    rest = compact(rest if seen is None else rest.join(seen, ["a", "b"], "left_anti"))
    turn = F.pmod(F.xxhash64("a", "b"), F.lit(100))
    for low, high in ((0, 2), (2, 20), (20, 100)):  # a few of a dense group's pairs join it, and its others drop out
        ca, cb = clusters.toDF("a", "ca"), clusters.toDF("b", "cb")
        wave = rest.where(turn.between(low, high - 1)).join(ca, "a").join(cb, "b").where("ca <> cb")
        wave, n = counted(wave.select("a", "b").coalesce(parts_of(rest)))
        if n:
            add(wave, n)
    return clusters


def _grouped(docs: DataFrame, k: int = 5, threshold: float = 0.8, samples: int = 32, least: int = 2, rounds: int = 2) -> DataFrame:
    """(doc_id, text_key, copies, class_id, cluster_id, kept) of every different (doc_id, text)."""
    members, classes = _classes(docs, k, samples)
    repeated = members.where("copies > 1").limit(1).count() > 0
    clusters = _clusters(docs, classes, repeated, threshold, least, rounds)
    named = classes.select("node", "text_key", "size", F.col("doc_id").alias("class_id"))
    first = F.struct(F.col("class_id").alias("cluster_id"), F.col("text_key").alias("cluster_key"))
    if clusters is None:
        named = named.select("text_key", "size", "class_id", first.alias("first"))
    else:
        inside = compact(named.join(clusters, "node"))
        firsts = inside.groupBy("cluster").agg(F.min(first).alias("first"))
        inside = inside.join(firsts, "cluster").select("node", "first")
        named = named.join(inside, "node", "left").select("text_key", "size", "class_id", F.coalesce("first", first).alias("first"))
    out = join_on_hot(members, checkpoint(named), "text_key", "size")
    kept = (F.col("doc_id") == F.col("first.cluster_id")) & (F.col("text_key") == F.col("first.cluster_key"))
    return out.select("doc_id", "text_key", "copies", "class_id", "first.cluster_id", kept.alias("kept"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """Groups of near-duplicate documents: doc_id, class_id, cluster_id, kept.

    Options: k (5), threshold (0.8), samples (32), least (2), rounds (2).

    Equal texts form a class, named by its smallest doc_id, of which one goes
    on. Each of ``samples`` Order MinHash samples (two minimum labelled ``k``-word
    shingles in text order) puts it into a bucket. A bucket's members are aligned
    with its centre, the member that shares most of its samples with others; a
    second round aligns those that are not of its cluster with a centre of their
    own. Linked classes are joined into clusters, named by their smallest doc_id.
    After the rounds, which give one pair a member and bucket, every remaining
    pair that shares ``least`` samples and lies in two clusters is aligned too,
    unless the lengths or word histograms show that it cannot reach the
    threshold, in three waves, between which clusters grow and pairs inside one
    drop out: no candidate is left untested but those whose link could join nothing.

    Similarity: 1 - word edits / words of the longer text, by a banded alignment
    of both whole texts. Texts of fewer than ``k`` words link with texts of the
    same words. Empty texts are equal to each other; null texts and texts without
    words link with nothing else. Rows with null doc_ids give no row; each
    different (doc_id, text) gives one row, and one row of a cluster is kept: that
    of the smallest doc_id, of its texts that with the smallest key. Other columns
    are not read.
    """
    return _grouped(docs, **options).drop("text_key", "copies")


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with exactly one row of each cluster of :func:`near_duplicates`.

    Rows are told apart by doc_id and text, so a repeated doc_id takes no other
    text along; of rows with the same doc_id and text one stays. Rows with null
    doc_ids stay.
    """
    rows = _grouped(docs, **options).where("not kept or copies > 1")
    rows = checkpoint(rows.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "kept"))
    doc_id, key = F.col("doc_id").cast("long"), "_text_key"
    while key in docs.columns:
        key += "_"
    keyed = docs.withColumn(key, F.when(doc_id.isNotNull(), text_key(F.col("text"), doc_id)))

    def same(rows: DataFrame) -> Column:
        return (keyed["doc_id"].cast("long") == rows["id"]) & (keyed[key] == rows["key"])

    gone = small(rows, 500_000)
    out = keyed.join(gone, same(gone), "left_anti")
    twice = checkpoint(rows.where("kept"))  # kept, but more than one row of it
    if twice.limit(1).count():
        twice = small(twice, 500_000)
        out = out.unionByName(keyed.join(twice, same(twice), "left_semi").dropDuplicates(["doc_id", key]))
    return out.select(*docs.columns)
