"""Spelling variants by composing the vocabulary acceptor with a one-edit transducer and itself."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations, groupby
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, small

_LETTERS = "a-zÀ-ÿ"
#: Different words that a task counts before it sends them on.
_COUNTED = 400_000


class Acceptor:
    """The minimal acyclic automaton of sorted, different strings.

    ``kids[s]`` maps a character to the next state, ``final[s]`` tells whether a
    string ends there; equal right languages share one state.
    """

    def __init__(self, words: list[str]):
        self.kids: list[dict[str, int]] = []
        self.final: list[bool] = []
        known: dict[tuple, int] = {}
        path: list[tuple[dict[str, int], list[bool]]] = [({}, [False])]  # states that may still grow
        last = ""

        def close(depth: int) -> int:
            kids, end = path.pop()
            key = (end[0], *kids.items())
            state = known.get(key)
            if state is None:
                state = known[key] = len(self.kids)
                self.kids.append(kids)
                self.final.append(end[0])
            if path:
                path[-1][0][last[depth - 1]] = state
            return state

        for word in words:
            same = 0
            while same < len(last) and same < len(word) and last[same] == word[same]:
                same += 1
            for depth in range(len(last), same, -1):
                close(depth)
            path.extend(({}, [False]) for _ in word[same:])
            path[-1][1][0] = True
            last = word
        for depth in range(len(last), 0, -1):
            close(depth)
        self.start = close(0)
        self.met: dict[tuple[int, int], list[str]] = {}
        self.edited: dict[int, list[tuple[str, str]]] = {}

    def common(self, p: int, q: int) -> list[str]:
        """Strings that lead from both states to an end: both tapes read alike after the edit."""
        key = (p, q) if p < q else (q, p)
        out = self.met.get(key)
        if out is None:
            out, stack, kids, final = [], [(p, q, "")], self.kids, self.final
            while stack:
                a, b, y = stack.pop()
                if final[a] and final[b]:
                    out.append(y)
                ka, kb = kids[a], kids[b]
                if len(kb) < len(ka):
                    ka, kb = kb, ka
                stack += [(t, kb[c], y + c) for c, t in ka.items() if c in kb]
            self.met[key] = out
        return out

    def edits(self, s: int) -> list[tuple[str, str]]:
        """Pairs of strings from state ``s`` on that differ by one edit in their first character.

        A replaced character is a pair of different next characters; a deleted
        one is read by the first tape alone, and what follows it starts otherwise,
        so that each pair has one place.
        """
        out = self.edited.get(s)
        if out is None:
            kids, final, out = self.kids, self.final, []
            own = kids[s]
            for (c, p), (d, q) in combinations(own.items(), 2):
                out += [(c + y, d + y) for y in self.common(p, q)]
            for c, p in own.items():
                if final[p] and final[s]:
                    out.append((c, ""))
                out += [(c + d + y, d + y) for d, q in kids[p].items() if d != c and d in own for y in self.common(q, own[d])]
            self.edited[s] = out
        return out

    def near(self, depth: int | None) -> Iterator[tuple[str, str]]:
        """All pairs of accepted strings that are one edit apart, those with fewer than ``depth`` equal characters before it (all, if None)."""
        stack = [(self.start, "")]
        while stack:
            s, x = stack.pop()
            for u, v in self.edits(s):
                yield x + u, x + v
            if depth is None or len(x) + 1 < depth:
                stack += [(t, x + c) for c, t in self.kids[s].items()]


def near_in(words: dict[str, int], left: int, right: int, under: int | None, shorter: int | None) -> dict[str, list]:
    """Of words (with counts) that share ``left`` characters before and ``right`` after: [near words, largest count, that word].

    Pairs count that agree in fewer than ``under`` characters before the edit and
    whose shorter word has ``shorter`` (each unless None).
    """
    inner = {w[left : len(w) - right]: w for w in words}
    out: dict[str, list] = {}
    for a, b in Acceptor(sorted(inner)).near(None if under is None else under - left):
        u, v = inner[a], inner[b]
        if (under is None or u[:under] != v[:under]) and (shorter is None or min(len(u), len(v)) == shorter):
            for w, o in ((u, v), (v, u)):
                x = out.setdefault(w, [0, 0, ""])
                x[0] += 1
                n = words[o]
                if n > x[1] or (n == x[1] and o < x[2]):
                    x[1:] = n, o
    return out


def vocabulary(docs: DataFrame, min_length: int = 6, min_count: int = 5, every: int = 199) -> DataFrame:
    """(word, n): the words of the texts that have ``min_length`` code points and occur ``min_count`` times at least.

    A word is a maximal run of letters (A-Z, a-z, U+00C0 to U+00FF), A-Z in lower
    case. With h the CRC-32 of ``<doc_id>:<run>``, a run whose h is divisible by
    ``every`` loses its character h % length: planted misspellings. Tasks send
    sums, not runs.
    """
    find = re.compile(f"[{_LETTERS}]{{{min_length},}}").findall

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                raw = text.as_py()
                if not raw:
                    continue
                seed = crc32(f"{'' if (i := doc_id.as_py()) is None else i}:".encode())
                for run, n in Counter(find(raw.lower().decode())).items():
                    h = crc32(run.encode(), seed)
                    if h % every == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < min_length:
                            continue
                    total[run] += n
                if len(total) > _COUNTED:
                    yield rows()
                    total.clear()
        yield rows()

    texts = docs.where("text is not null").select("doc_id", F.col("text").cast("binary").alias("text"))
    counts = texts.mapInArrow(count, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _partitions(words: DataFrame, min_length: int, most: int) -> DataFrame:
    """(key, word, n, left, right, under, shorter): the words of each partition of initial states.

    A pair that is one edit apart shares its first ``k`` characters or, with
    the edit before them, its last ones. So the composition starts from the
    states that both tapes reach together by ``k`` characters, read forwards or
    backwards. A partition of over ``most`` words is cut again in the same way, at
    half of what is left of the pairs' shorter word, until it is small or one
    character is left, where the alphabet bounds it.
    """
    half = min_length // 2
    k = (min_length + 1) // 2
    state = F.col("state")

    def keyed(df: DataFrame, states) -> DataFrame:
        df = df.select("word", "n", F.explode(states).alias("state"))
        length = F.char_length("word")
        key = F.struct("state.shorter", "state.under", F.substring("word", F.lit(1), state["left"]).alias("x"), F.substring("word", length - state["right"] + 1, state["right"]).alias("y"), "state.left")
        return checkpoint(df.withColumn("key", F.xxhash64(F.to_json(key))).select("key", "word", "n", "state.*"))

    def state_of(left, right, under, shorter):
        return F.struct(*(x.cast("int").alias(c) for x, c in ((left, "left"), (right, "right"), (under, "under"), (shorter, "shorter"))))

    none, zero = F.lit(None), F.lit(0)
    rows = keyed(words, F.array(state_of(F.lit(half), zero, none, none), state_of(zero, F.lit(k), F.lit(half), none)))
    done = None
    while True:
        sizes = rows.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > most)
        left, right, under = F.col("left"), F.col("right"), F.col("under")
        length = F.char_length("word")
        whole = F.coalesce("shorter", length)
        sizes = checkpoint(sizes.select("key"))
        hot = checkpoint(rows.join(small(sizes, 500_000), "key", "left_semi").where(F.coalesce("shorter", F.lit(min_length + 2)) - left - right > 1))
        if not hot.limit(1).count():
            return rows if done is None else done.unionByName(rows)
        cold = rows.join(small(checkpoint(hot.select("key").distinct()), 500_000), "key", "left_anti")
        done = cold if done is None else done.unionByName(cold)
        lengths = F.when(F.col("shorter").isNotNull(), F.array("shorter")).otherwise(F.filter(F.array(length, length - 1), lambda m: m >= F.greatest(F.lit(min_length), left + right)))
        hot = hot.withColumn("m", F.explode(lengths))
        m = F.col("m")
        a = F.ceil((m - left - right) / 2)
        deeper = state_of(left + a, right, under, m)
        before = state_of(left, m - left - a, F.least("under", left + a), m)
        # An edit may lie only where the partition lets it: forward parts beyond `under` have none.
        rows = keyed(hot, F.when(under.isNotNull() & (left + a >= under), F.array(before)).otherwise(F.array(deeper, before)))


def near_words(words: DataFrame, min_length: int = 6, most: int = 4_000) -> DataFrame:
    """(word, n, n_near, best, best_n) of every row of ``words`` (word, n): how many words are one edit away, and the commonest of them."""

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        def made(found: list[tuple]) -> pa.RecordBatch:
            kinds = (("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(list(zip(*found)) or [()] * 4, kinds)], names=[c for c, _ in kinds])

        found: list[tuple] = []
        for _, part in groupby(rows(), key=lambda r: (r[0], *r[3:])):
            contexts: dict[tuple[str, str], dict[str, int]] = {}  # one, unless keys collide
            for _, w, n, *state in part:
                contexts.setdefault((w[: state[0]], w[len(w) - state[1] :]), {})[w] = n
            for group in contexts.values():
                if len(group) > 1:
                    found += [(w, *x) for w, x in near_in(group, *state).items()]
            if len(found) > 50_000:
                yield made(found)
                found = []
        yield made(found)

    parts = _partitions(words, min_length, most).select("key", "word", "n", "left", "right", "under", "shorter")
    parts = parts.repartition("key").sortWithinPartitions("key", "left", "right", "under", "shorter")
    found = parts.mapInArrow(compose, "word string, n_near long, best_n long, best string")
    order = F.struct((-F.col("best_n")).alias("least"), "best")
    both = found.select("word", F.lit(None).cast("long").alias("n"), "n_near", order.alias("b")).unionByName(
        words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<least:long,best:string>").alias("b"))
    )
    out = both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("b").alias("b"))
    return out.select("word", "n", "n_near", "b.best", (-F.col("b.least")).alias("best_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): the end of each chain, whose reach doubles a round. Counts grow along a chain, so it has no cycle."""
    up = checkpoint(forms.select("word", F.col("form").alias("root")))
    while True:
        next_ = up.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        joined = checkpoint(up.join(next_, "root", "left"))
        if not joined.where("beyond is not null").limit(1).count():
            return up
        up = joined.select("word", F.coalesce("beyond", "root").alias("root"))


def spelling_variants(docs: DataFrame, min_length: int = 6, min_count: int = 5, ratio: int = 5, every: int = 199, most: int = 4_000) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the texts' :func:`vocabulary`.

    Two words are near if one code point put in, left out or replaced turns one
    into the other. A word's form is its near word of largest n (of equal ones the
    smallest) if that has ``ratio`` times the word's n, else null; its root is
    where its forms lead, or itself. The minimal acceptor of each partition is
    composed with the one-edit transducer and with itself (:class:`Acceptor`), and
    tasks send a row a word, never pairs. Null texts have no words; a null doc_id
    counts as an empty string; repeated rows count as often as they occur. Without
    words the result has no rows. Other columns are not read.
    """
    words = checkpoint(vocabulary(docs, min_length, min_count, every))
    near = near_words(words, min_length, most)
    is_form = F.col("best_n") >= ratio * F.col("n")
    near = checkpoint(near.select("word", "n", "n_near", F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")))
    roots = _roots(near.where("form is not null"))
    out = near.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
