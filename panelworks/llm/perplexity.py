"""Quality by perplexity under an interpolated modified Kneser-Ney character n-gram model."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, mix, small

ORDER = 5
_BITS = 12
_CLASSES = 1 << _BITS


def codes(text: str) -> np.ndarray:
    """Characters as classes 1..4095: code points below 2048 are their own, others share by remainder."""
    cp = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    return np.where(cp < 2048, np.maximum(cp, 1), 2048 + cp % 2047)


def ngrams(text: str) -> np.ndarray:
    """The 5-gram of every character of a text, packed 12 bits a class; before the text stand zeros."""
    c = np.concatenate([np.zeros(ORDER - 1, np.int64), codes(text)])
    n = len(c) - ORDER + 1
    out = c[:n].copy()
    for i in range(1, ORDER):
        out = (out << _BITS) | c[i : i + n]
    return out


class _Lookup:
    """Places of 64-bit keys, all of them known: an open-addressing table that is read for whole arrays.

    ``columns`` hold the values at the places.
    """

    def __init__(self, keys: np.ndarray, *columns: np.ndarray):
        self.mask = np.uint64((1 << max(4, int(2 * len(keys) + 1).bit_length())) - 1)
        self.keys = np.full(int(self.mask) + 1, -1, np.int64)
        self.columns = [np.zeros(int(self.mask) + 1, c.dtype) for c in columns]
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[left[free]]  # the last of those that want a place gets it
            done = self.keys[at] == keys[left]
            for own, c in zip(self.columns, columns):
                own[at[done]] = c[left[done]]
            at, left = (at[~done] + np.uint64(1)) & self.mask, left[~done]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return mix(keys.view(np.uint64)) & self.mask

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of ``keys``, and whether each is known."""
        out = self._slot(keys)
        there = self.keys[out]
        known = there == keys
        left = np.flatnonzero(~known & (there != -1))
        at = out[left]
        while len(left):
            at = (at + np.uint64(1)) & self.mask
            there = self.keys[at]
            hit = there == keys[left]
            out[left[hit]], known[left[hit]] = at[hit], True
            on = ~hit & (there != -1)
            left, at = left[on], at[on]
        return out, known


_Table = tuple[np.ndarray, np.ndarray, np.ndarray]


def _counted(parts: list[np.ndarray], trusted: bool) -> _Table:
    keys, m = np.unique(np.concatenate(parts) if parts else np.empty(0, np.int64), return_counts=True)
    return keys, m if trusted else np.zeros_like(m), m


def _merge(tables: list[_Table]) -> _Table:
    if len(tables) == 1:
        return tables[0]
    keys, at = np.unique(np.concatenate([t[0] for t in tables]), return_inverse=True)
    return keys, *(np.bincount(at, np.concatenate([t[i] for t in tables]), len(keys)).astype(np.int64) for i in (1, 2))


def block_counts(texts: pa.Array, trusted: list[bool], chunk: int = 1_000_000) -> _Table:
    """The distinct n-grams of some texts, how often each stands in trusted ones and in all."""
    parts: dict[bool, list[np.ndarray]] = {True: [], False: []}
    done: list[_Table] = []
    sizes = {True: 0, False: 0}
    for text, good in zip(texts, trusted):
        if text.as_py():
            parts[good].append(g := ngrams(text.as_py()))
            sizes[good] += len(g)
            if sizes[good] > chunk:
                done.append(_counted(parts[good], good))
                parts[good].clear()
                sizes[good] = 0
                if len(done) > 8:
                    done[:] = [_merge(done)]
    return _merge([*done, *(_counted(rest, good) for good, rest in parts.items())])


def _low(g: Column, order: int) -> Column:
    return g.bitwiseAND(F.lit((1 << (_BITS * order)) - 1))


def _discount(i: int, n1: Column, n2: Column, n3: Column, n4: Column) -> Column:
    """Modified Kneser-Ney discount for a count of i (3: or more), from the numbers of n-grams seen once to four times."""
    n = [n1, n2, n3, n4]
    d = i - (i + 1) * F.try_divide(n1.cast("double"), n1 + 2 * n2) * F.try_divide(n[i].cast("double"), n[i - 1])
    return F.when((n1 > 0) & (d > 0) & (d < i), d).otherwise(F.lit(0.25 + 0.25 * i))


def _discounts(counts: DataFrame) -> DataFrame:
    """lang, d1, d2, d3 of a table of counts."""
    ones = counts.groupBy("lang").agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)])
    return ones.select("lang", *[_discount(i, *[F.col(f"n{j}") for j in (1, 2, 3, 4)]).alias(f"d{i}") for i in (1, 2, 3)])


def _short_orders(raw: DataFrame) -> DataFrame:
    """lang, low, p2: probabilities of the wanted 2-grams, by joins of the 1- and 2-gram tables."""
    threes = raw.where("n > 0").select("lang", _low(F.col("g"), 3).alias("g")).distinct()
    twos = checkpoint(threes.groupBy("lang", _low(F.col("g"), 2).alias("g")).agg(F.count("*").alias("n")))
    ones = twos.groupBy("lang", _low(F.col("g"), 1).alias("g")).agg(F.count("*").alias("n"))
    p: DataFrame | None = None
    for order, c in ((1, ones), (2, twos)):
        context = c.groupBy("lang", F.shiftright("g", _BITS).alias("ctx")).agg(
            F.sum("n").alias("total"), F.count_if(F.col("n") == 1).alias("c1"), F.count_if(F.col("n") == 2).alias("c2"), F.count_if(F.col("n") > 2).alias("c3")
        )
        want = raw.select("lang", _low(F.col("g"), order).alias("g")).distinct()
        want = want.withColumn("ctx", F.shiftright("g", _BITS)).withColumn("low", _low(F.col("g"), order - 1))
        rows = want.join(c, ["lang", "g"], "left").join(context, ["lang", "ctx"], "left").join(_discounts(c), "lang", "left")
        n = F.coalesce(F.col("n"), F.lit(0))
        d1, d2, d3 = (F.coalesce(F.col(f"d{i}"), F.lit(v)) for i, v in ((1, 0.5), (2, 0.75), (3, 1.0)))
        cut = F.when(n == 0, 0.0).when(n == 1, d1).when(n == 2, d2).otherwise(d3)
        kept = d1 * F.col("c1") + d2 * F.col("c2") + d3 * F.col("c3")
        lower = F.lit(1.0 / _CLASSES)
        if p is not None:
            rows = rows.join(p.select("lang", F.col("g").alias("low"), F.col("p").alias("lower")), ["lang", "low"], "left")
            lower = F.col("lower")
        value = F.when(F.col("total").isNull(), lower).otherwise((n - cut) / F.col("total") + kept / F.col("total") * lower)
        p = checkpoint(rows.select("lang", "g", value.alias("p")))
    return p.select("lang", F.col("g").alias("two"), F.col("p").alias("p2"))


def _local_tables(g: np.ndarray, n: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Order -> sorted n-grams and their counts, for orders 5 (as given), 4 and 3 (different characters before)."""
    seen = n > 0
    order = np.argsort(g[seen])
    tables = {ORDER: (g[seen][order], n[seen][order])}
    for k in (4, 3):
        tables[k] = np.unique(tables[k + 1][0] & ((1 << _BITS * k) - 1), return_counts=True)
    return tables


_GROUP = ["lang", "mid"]


def _grouped(raw: DataFrame, shards: int) -> DataFrame:
    """Rows with a shard number from the third- and second-last characters of the
    n-gram: its suffixes of 3 and 4, and the contexts of all three, have the same two."""
    return raw.withColumn("mid", F.pmod(F.xxhash64(F.shiftright("g", _BITS).bitwiseAND(F.lit((1 << 2 * _BITS) - 1))), F.lit(shards)))


def kneser_ney(raw: DataFrame) -> DataFrame:
    """lang, g, n, m, logp, back: the log probability of each n-gram's last character, and what it is without the n-gram's own count.

    raw: lang, g, n (times in trusted texts), m (times in all) over all n-grams to
    score; the model is estimated from those with n > 0. The highest order has counts, each lower one the number of
    different characters before an n-gram. Orders 1 and 2 are joined tables; the
    counts of orders 3 to 5 meet in shards by language and the two characters
    that an n-gram, its suffixes and their contexts share, so one shuffle brings
    together all that these orders need.
    """

    def tally(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        out = []
        for k, (_, n) in _local_tables(f["g"].to_numpy(), f["n"].to_numpy()).items():
            out.append((key[0], k, *((n == i).sum() for i in (1, 2, 3, 4))))
        return pd.DataFrame(out, columns=["lang", "k", "n1", "n2", "n3", "n4"])

    shards = 16 + raw.count() // 50_000
    counted = raw.where("n > 0")
    tallies = _grouped(counted, shards).groupBy(*_GROUP).applyInPandas(tally, "lang string, k int, n1 long, n2 long, n3 long, n4 long")
    sums = tallies.groupBy("lang").agg(*[F.sum(F.when(F.col("k") == k, F.col(f"n{i}"))).alias(f"n{i}_{k}") for k in (3, 4, 5) for i in (1, 2, 3, 4)])
    cuts = sums.select("lang", *[_discount(i, *[F.col(f"n{j}_{k}") for j in (1, 2, 3, 4)]).alias(f"d{i}_{k}") for k in (3, 4, 5) for i in (1, 2, 3)])
    # One row a language and one a pair of characters: broadcast behind a count.
    rows = raw.withColumn("two", _low(F.col("g"), 2)).join(small(_short_orders(raw), 500_000), ["lang", "two"]).drop("two")
    rows = rows.join(small(checkpoint(cuts), 10_000), "lang", "left")

    def score(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        g, n = f["g"].to_numpy(), f["n"].to_numpy()
        p = f["p2"].to_numpy(dtype=float)
        back, tables = p, _local_tables(g, n)
        for k in (3, 4, 5):
            keys, counts = tables[k]
            d = np.array([0.0, *(f[f"d{i}_{k}"].iloc[0] for i in (1, 2, 3))])
            d = np.where(np.isnan(d), [0.0, 0.5, 0.75, 1.0], d)
            contexts, at = np.unique(keys >> _BITS, return_inverse=True)
            total = np.bincount(at, counts, len(contexts))
            kept = np.bincount(at, d[np.minimum(counts, 3)], len(contexts))
            own = g & ((1 << _BITS * k) - 1)
            c = _find(keys, counts, own)
            i = np.searchsorted(contexts, own >> _BITS)
            known = (i < len(contexts)) & (contexts[np.minimum(i, len(contexts) - 1)] == own >> _BITS) if len(contexts) else np.zeros(len(g), bool)
            i = np.where(known, i, 0)
            back = np.where(known, kept[i] / total[i] * p, p) if len(contexts) else p
            p = np.where(known, (c - d[np.minimum(c, 3)]) / total[i], 0.0) + back if len(contexts) else p
        return pd.DataFrame({"lang": f["lang"], "g": g, "n": n, "m": f["m"], "logp": np.log(p).astype(np.float32), "back": np.log(back).astype(np.float32)})

    return _grouped(rows, shards).groupBy(*_GROUP).applyInPandas(score, "lang string, g long, n long, m long, logp float, back float")


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values of the wanted keys, 0 where there are none; ``keys`` are sorted."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[i] == wanted, values[i], 0)


def _keyed(docs: DataFrame) -> DataFrame:
    """_row (all columns), _id, _lang ('' if null), _key (of the text, null as empty)."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("_lang"), F.unhex(F.md5(text)).alias("_key"),
    )


def _flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, text_key, text, trusted (labelled with quality 1)."""
    rows = _keyed(docs).select(F.col("_id").alias("doc_id"), F.col("_lang").alias("lang"), F.col("_key").alias("text_key"), F.coalesce("_row.text", F.lit("")).alias("text"))
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long")).distinct()
    good = small(checkpoint(good.withColumn("trusted", F.lit(True))), 1_000_000)
    return rows.join(good, "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))


def gathered(rows: DataFrame) -> DataFrame:
    """lang, g, n, m: every n-gram of the texts, with its count in the trusted ones and in all; summed in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, list] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                at = pa.array(np.flatnonzero(langs == lang))
                part = batch.take(at)
                table = block_counts(part.column(1), part.column(2).to_pylist())
                tables[lang] = [_merge([*tables.get(lang, []), table])]
        for lang, [table] in tables.items():
            for i in range(0, len(table[0]), 500_000):
                cols = [pa.array(c[i : i + 500_000]) for c in table]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cols[0])), *cols], names=["lang", "g", "n", "m"])

    each = rows.select("lang", "text", "trusted").mapInArrow(count, "lang string, g long, n long, m long")
    return each.groupBy("lang", "g").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def _by_language(table: pa.Table) -> dict[str, list[np.ndarray]]:
    """lang -> n-grams, their counts, log probabilities and those without the own count."""
    lang = table.column("lang").combine_chunks().dictionary_encode()
    if isinstance(lang, pa.ChunkedArray):
        lang = lang.combine_chunks()
    at = lang.indices.to_numpy(zero_copy_only=False)
    cols = [table.column("g").to_numpy(), np.minimum(table.column("n").to_numpy(), 1 << 30).astype(np.int32), table.column("logp").to_numpy(), table.column("back").to_numpy()]
    return {name: [c[at == i] for c in cols] for i, name in enumerate(lang.dictionary.to_pylist())}


def _value(n: Column, times: Column, trusted: Column, logp: Column, back: Column) -> Column:
    return times * F.when(trusted & (n <= times), back).otherwise(logp).cast("double")


def _head(model: DataFrame, most: int) -> tuple[dict[str, list[np.ndarray]], int]:
    """The commonest n-grams of the model by language, at most ``most``, and the least number of occurrences that they have."""
    sizes = model.groupBy(F.floor(F.log2(F.col("m").cast("double"))).cast("int").alias("e")).count().collect()  # at most 64 rows
    least, n = 64, 0
    for e, count in sorted(((r["e"], r["count"]) for r in sizes), reverse=True):
        n += count
        if n > most:
            break
        least = e
    head = model.where(F.col("m") >= F.lit(float(2**least))).select("lang", "g", "n", "logp", "back")
    return _by_language(head.toArrow()), least


def text_scores(rows: DataFrame, model: DataFrame, most_shared: int = 500_000) -> DataFrame:
    """doc_id, lang, trusted, text_key, n_chars, logp of every row: the log probability of its whole text.

    The texts are read once and never shuffle. The commonest n-grams, at most
    ``most_shared``, are broadcast to the tasks that read the texts; each text's
    other n-grams, which are rare by that choice and so never a hot key, are
    joined to the model and summed by text.

    A trusted text is part of the model's counts: n-grams that stand nowhere else
    are scored without their own count, as in a text that the model has not seen.
    """
    head, least = _head(model, most_shared)
    shared: Broadcast = rows.sparkSession.sparkContext.broadcast(head)
    del head
    pa.default_memory_pool().release_unused()
    empty = np.empty(0, np.int64)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, _Lookup] = {}
        for batch in batches:
            sums, rest_g, rest_n = [], [], []
            for lang, text, own in zip(batch.column(1).to_pylist(), batch.column(5), batch.column(2).to_pylist()):
                if lang not in tables:
                    tables[lang] = _Lookup(*shared.value.get(lang, [empty, empty, empty.astype(np.float32), empty.astype(np.float32)]))
                g, times = np.unique(ngrams(text.as_py()), return_counts=True)
                at, known = tables[lang](g)
                n, logp, back = (c[at[known]] for c in tables[lang].columns)
                few = times[known]
                v = np.where(n > few, logp, back) if own else logp
                sums.append(float((v.astype(np.float64) * few).sum()))
                rest_g.append(g[~known])
                rest_n.append(times[~known])
            ends = np.cumsum([0, *map(len, rest_g)]).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(np.concatenate([empty, *c])) for c in (rest_g, rest_n)], names=["g", "times"])
            cols = [*batch.columns[:5], pa.array(sums, pa.float64()), pa.ListArray.from_arrays(pa.array(ends), pairs)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "lang", "trusted", "text_key", "n_chars", "logp", "rest"])

    found = rows.select("doc_id", "lang", "trusted", "text_key", F.length("text").cast("long").alias("n_chars"), "text")
    found = found.mapInArrow(score, "doc_id long, lang string, trusted boolean, text_key binary, n_chars long, logp double, rest array<struct<g:long,times:long>>")
    found = checkpoint(found.withColumn("row", F.monotonically_increasing_id()))
    shared.destroy()
    tail = found.where(F.size("rest") > 0).select("row", "lang", "trusted", F.inline("rest"))
    tail = tail.join(model.where(F.col("m") < F.lit(float(2**least))), ["lang", "g"])
    more = tail.groupBy("row").agg(F.sum(_value(F.col("n"), F.col("times"), F.col("trusted"), F.col("logp"), F.col("back"))).alias("more"))
    whole = found.drop("rest").join(more, "row", "left")
    return whole.select("doc_id", "lang", "trusted", "text_key", "n_chars", (F.col("logp") + F.coalesce("more", F.lit(0.0))).alias("logp"))


def perplexities(docs: DataFrame, labels: DataFrame, prior: float = 40.0, **options) -> DataFrame:
    """doc_id, lang, trusted, text_key, n_chars, perplexity of every row under the model of the trusted ones in its language.

    The mean is drawn to the language's own by ``prior`` characters, so that a
    text of a few words is not judged by chance.
    """
    rows = _flagged(docs, labels)
    model = checkpoint(kneser_ney(checkpoint(gathered(rows))))
    whole = checkpoint(text_scores(rows, model, **options))
    mean = whole.groupBy("lang").agg((F.sum(F.when(F.col("trusted"), F.col("logp"))) / F.sum(F.when(F.col("trusted"), F.col("n_chars")))).alias("mean"))
    drawn = (F.col("logp") + prior * F.coalesce("mean", F.lit(-math.log(_CLASSES)))) / (F.col("n_chars") + prior)
    return whole.join(small(checkpoint(mean), 10_000), "lang", "left").select("doc_id", "lang", "trusted", "text_key", "n_chars", F.exp(-drawn).alias("perplexity"))


def _judged(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, margin: float = 1.2, **options) -> DataFrame:
    scored = checkpoint(perplexities(docs, labels, **options))
    limits = scored.where("trusted").groupBy("lang").agg((margin * F.percentile_approx("perplexity", quantile, 10_000)).alias("threshold"))
    kept = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return scored.join(small(checkpoint(limits), 10_000), "lang", "left").withColumn("kept", kept)


def quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, lang, n_chars, perplexity, threshold, kept of every document.

    Options: quantile (0.99), margin (1.2), prior (40), most_shared (500,000).

    A document is rejected if its perplexity exceeds ``margin`` times the
    ``quantile`` of the trusted documents' perplexities in its language, which
    leave out n-grams that a document alone has put into the model. A language
    without trusted documents has no model and no threshold: its documents are
    kept. Null and empty texts have the mean perplexity and are kept. A null
    language is one of its own. Repeated rows each give a row; null doc_ids are
    scored. labels: doc_id, quality (1: trusted).
    """
    return _judged(docs, labels, **options).select("doc_id", "lang", "n_chars", "perplexity", "threshold", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that :func:`quality` rejects; rows are told apart by doc_id, language and text."""
    bad = checkpoint(_judged(docs, labels, **options).where("not kept").select("doc_id", "lang", "text_key").distinct())
    bad = small(bad, 1_000_000)
    rows = _keyed(docs)
    same = rows["_id"].eqNullSafe(bad["doc_id"]) & (rows["_lang"] == bad["lang"]) & (rows["_key"] == bad["text_key"])
    return rows.join(bad, same, "left_anti").select("_row.*")
