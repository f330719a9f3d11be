"""Toxicity classifier with a counterfactual penalty on identity terms."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, words

#: Neutral names of groups whose exchange must not move a score; only names of one language and class stand for each other.
IDENTITY_TERMS = (
    ("women", "men"), ("muslims", "christians", "jews", "hindus"), ("gay", "straight"), ("black", "white"), ("immigrants", "locals"), ("disabled", "elderly"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)


def word_features(word: bytes) -> list[int]:
    """Hashed features of a word: itself and its beginnings of 3 to 8 characters, so that inflected forms share some."""
    text = word.decode("utf-8", "replace")
    return [crc32(word), *(crc32(b"^" + text[:k].encode()) for k in range(3, min(8, len(text) - 1) + 1))]


def again(feature: int, times: int) -> int:
    """The feature that ``feature`` stands in two or three different words or more."""
    return (feature * 2654435761 + times * 40503) & 0xFFFFFFFF


def features(ws: set[bytes]) -> set[int]:
    """Features of a text's different words, and of being in several of them."""
    n = Counter(f for w in ws for f in word_features(w))
    return {*n, *(again(f, t) for t in (2, 3) for f, k in n.items() if k >= t)}


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of hashed features, a bias and the number of labelled rows that they were fitted on."""

    weights: dict[int, float]
    bias: float
    rows: int = 0

    def scorer(self):
        """A function text -> score that keeps what it has found of words."""
        kept: dict[bytes, tuple[int, ...]] = {}
        weights, bias = self.weights, self.bias

        def score(text: str | None) -> float:
            found: list[int] = []
            for w in set(words(text or "")):
                f = kept.get(w)
                if f is None:
                    f = tuple(i for i in word_features(w) if i in weights or again(i, 2) in weights or again(i, 3) in weights)
                    if len(kept) < 500_000:
                        kept[w] = f
                if f:
                    found += f
            n = Counter(found)
            used = {*n, *(again(i, t) for t in (2, 3) for i, k in n.items() if k >= t)}
            z = bias + sum(weights[i] for i in sorted(used) if i in weights)
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return score


def fit_logistic(
    rows: list[np.ndarray], swapped: list[np.ndarray], labels: np.ndarray, n: int, ridge: float, penalty: float, weight: float = 3.0, steps: int = 250
) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise log loss + ridge |w|^2 / 2 + penalty x mean squared score change under swaps.

    Toxic rows count ``weight`` times, as missing one costs more than a false alarm.
    rows, swapped: each row's feature numbers below ``n``, as they are and with identity terms exchanged.
    """
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    f = np.concatenate(rows) if rows else np.empty(0, int)
    changed = [i for i in range(len(rows)) if len(rows[i]) != len(swapped[i]) or (rows[i] != swapped[i]).any()]
    d_at = np.concatenate([np.full(len(rows[i]) + len(swapped[i]), k) for k, i in enumerate(changed)]) if changed else np.empty(0, int)
    d_f = np.concatenate([np.concatenate([rows[i], swapped[i]]) for i in changed]) if changed else np.empty(0, int)
    d_sign = np.concatenate([np.r_[np.ones(len(rows[i])), -np.ones(len(swapped[i]))] for i in changed]) if changed else np.empty(0)
    m = max(len(rows), 1)
    share = np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3)
    w, b = np.zeros(n), float(np.log(share / (1 - share)))
    first, second = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):  # Adam on the whole sample: no dependence on an order
        z = b + np.bincount(at, w[f], m)[: len(labels)] if len(f) else np.full(len(labels), b)
        gap = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * np.where(labels > 0, weight, 1.0) / m
        grad = np.r_[np.bincount(f, gap[at], n) + ridge * w, gap.sum()]
        if changed:
            move = np.bincount(d_at, w[d_f] * d_sign, len(changed))
            grad[:-1] += np.bincount(d_f, 2 * penalty * move[d_at] * d_sign / len(changed), n)
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        step = 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def _rows(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a column as arrays; null lists are empty."""
    out: list[np.ndarray] = []
    for chunk in column.chunks:
        lengths = np.where(chunk.is_valid(), chunk.value_lengths().fill_null(0), 0)
        out += np.split(chunk.flatten().to_numpy().astype(np.int64), np.cumsum(lengths)[:-1]) if len(lengths) else []
    return out


def train_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    identity_terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS,
    most_rows: int = 12_000,
    least_rows: int = 4,
    least_z: float = 6.0,
    ridge: float = 1e-4,
    penalty: float = 1.0,
) -> ToxicityModel:
    """Fit on at most ``most_rows`` labelled documents, those with the smallest hashes of their doc_ids.

    labels: doc_id and toxic (0/1; null: unlabelled; of several labels of a doc_id the greatest counts). Features are found on the
    executors; those kept stand in at least ``least_rows`` documents of the sample
    and have a share of toxic ones that lies ``least_z`` standard errors or more
    from the sample's, so that words that stand in few documents by chance weigh
    nothing. All of these are kept; the sample bounds their number. Only numbers
    reach the driver. Texts that name a group also give a copy in which each
    identity term is exchanged for the next one of its language and class, whose
    score must not differ: the mean squared change costs ``penalty``. Without
    labels every score is 0.5; with one class, that class's prior.
    """
    marked = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").alias("doc_id"), F.col("toxic").cast("int"))
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id")  # at most most_rows rows of 12 bytes
    groups = [[t.lower().encode() for t in group] for group in identity_terms]
    swap = {a: b for group in groups for a, b in zip(group, group[1:] + group[:1])}

    @F.pandas_udf("struct<own:array<long>,swapped:array<long>>")
    def extract(texts: pd.Series) -> pd.DataFrame:
        own, other = [], []
        for t in texts:
            ws = set(words(t or ""))
            own.append(sorted(features(ws)))
            named = ws & swap.keys()
            other.append(sorted(features((ws - named) | {swap[w] for w in named})) if named else None)
        return pd.DataFrame({"own": own, "swapped": other})

    sample = checkpoint(rows.select("doc_id", "toxic", extract("text").alias("f")).select("doc_id", "toxic", "f.*"))
    n, positive = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n:
        return ToxicityModel({}, 0.0)
    each = sample.select("toxic", F.explode("own").alias("f")).groupBy("f").agg(F.count("*").alias("n"), F.sum("toxic").alias("t"))
    share = F.lit(positive / n)
    gap = (F.col("t") / F.col("n") - share) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-6)) / F.col("n"))
    forced = [i for t in swap for i in word_features(t)]
    chosen = [r["f"] for r in each.where((F.col("n") >= least_rows) & (F.abs(gap) >= least_z) | F.col("f").isin(forced)).orderBy("f").collect()]
    number = {f: i for i, f in enumerate(chosen)}

    @F.pandas_udf("array<int>")
    def numbered(lists: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else [number[f] for f in x if f in number] for x in lists])

    got = sample.select("doc_id", "toxic", numbered("own").alias("own"), numbered("swapped").alias("swapped")).toArrow().sort_by("doc_id")
    own = _rows(got.column("own"))
    named = got.column("swapped").is_valid().to_numpy()
    swapped = [s if has else o for o, s, has in zip(own, _rows(got.column("swapped")), named)]
    w, b = fit_logistic(own, swapped, got.column("toxic").to_numpy().astype(float), max(len(chosen), 1), ridge, penalty)
    return ToxicityModel({f: float(w[i]) for f, i in number.items() if abs(w[i]) > 1e-6}, b, n)


def toxicity_score(text: Column, model: ToxicityModel) -> Column:
    """Score in 0..1 of a text column; a null text scores as an empty one."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = model.scorer()
        for texts in batches:
            yield pd.Series([score(t) for t in texts], dtype="float64")

    return scored(text)


def in_training_fold(doc_id: Column) -> Column:
    """Documents whose labels may be learnt: crc32 of the doc_id as text is not 2 modulo 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= ``threshold``) of every document.

    Learns labels of the training fold only. Null and empty texts get the score
    of a text without features; rows with null doc_ids are scored (held_out
    false), repeated rows each give a row. Only doc_id and text are read.
    """
    model = train_toxicity(docs, labels.where(in_training_fold(F.col("doc_id"))), **options)
    return docs.select(
        "doc_id", F.coalesce(~in_training_fold(F.col("doc_id")), F.lit(False)).alias("held_out"), toxicity_score(F.col("text"), model).alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_civil(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """``docs`` without the documents that score ``threshold`` or more; learns as :func:`toxicity` does.

    Repeated rows and rows with null ids or texts are scored like others. Without
    labels nothing is learnt and all documents stay.
    """
    model = train_toxicity(docs, labels.where(in_training_fold(F.col("doc_id"))), **options)
    return docs.where(toxicity_score(F.col("text"), model) < threshold) if model.rows else docs
