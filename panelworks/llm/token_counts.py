"""Exact BPE token counts of texts and of all their prefixes, without re-encoding."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Below this code point, letters and digits are classed from unicodedata and
#: texts are lower-cased here; other texts go through the tokenizer's own normaliser.
_LATIN = 0x250
#: Text without the white space of Unicode, which a tokenizer's ``\\s`` stands for.
_STRETCH = re.compile("[^\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def byte_chars() -> dict[int, str]:
    """The byte-to-character table of byte-level BPE: printable bytes stand for
    themselves, the others for the characters from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PrefixCounter:
    """Token counts of every prefix of a word under a BPE with word-end tokens.

    BPE has one valid last token for each prefix: the one whose predecessor, the
    last token of the remaining prefix, does not merge with it differently. So
    ``count[i] = count[i - len(last)] + 1`` is a dynamic programme over prefixes.
    Whether two tokens may stand side by side is found once and kept.
    """

    def __init__(self, path: str, most_kept: int = 700_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.end = spec["model"]["end_of_word_suffix"] or ""
        vocab = spec["model"]["vocab"]
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {tuple(m): i for i, m in enumerate(merges)}
        self.made = {a + b: (i, (a, b)) for (a, b), i in self.ranks.items()}
        self.inner = frozenset(v for v in vocab if not self.end or not v.endswith(self.end))
        self.final = frozenset(v.removesuffix(self.end) for v in vocab if self.end and v.endswith(self.end))
        self.suffixes = frozenset(v[i:] for v in self.inner | self.final for i in range(len(v)))
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split_special = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        kinds = {c: unicodedata.category(chr(c))[0] for c in range(_LATIN)}
        letters, numbers = ("".join(re.escape(chr(c)) for c, k in kinds.items() if k == kind) for kind in "LN")
        # The pre-tokenizer's pattern, for Latin text without white space.
        self.pieces = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{letters}{numbers}]+")
        self.plain = re.compile(f"[\\t-\\r\\x20-\\x7e\\x80-{chr(_LATIN - 1)}]*\\Z")
        self.chars = byte_chars()
        self.fits: dict[tuple[str, str], bool] = {}
        self.kept: dict[str, int] = {}  # of chunks
        self.words: dict[str, int] = {}
        self.most_kept = most_kept

    def _fit(self, a: str, b: str) -> bool:
        """Whether BPE leaves token ``b`` after token ``a`` as they are.

        Goes back in time from the finished tokens: the one that was made last is
        undone, and its part at the border takes its place. If two parts that
        stood at the border together could merge before then, they would have.
        """
        ranks, made, left, right = self.ranks, self.made, a, b
        before = 1 << 60
        while True:
            if ranks.get((left, right), 1 << 60) < before:
                return False
            at, bt = made.get(left), made.get(right)
            if at is None and bt is None:
                return True
            if bt is None or (at is not None and at[0] > bt[0]):
                before, left = at[0], at[1][1]
            else:  # of equal merges the left one comes first
                before, right = bt[0] + 1, bt[1][0]

    def prefix_counts(self, word: str, ends: range | None = None) -> list[int]:
        """Token counts of the prefixes of a byte-level word of the lengths in ``ends`` (all, if None)."""
        n, fits, end, suffixes = len(word), self.fits, self.end, self.suffixes
        inner, final = self.inner, self.final
        last: list[str] = [""] * (n + 1)
        count = [0] * (n + 1)
        closed = [0] * (n + 1)
        wanted = ends or range(1, n + 1)
        for i in range(1, n + 1):
            for tokens, suffix, out in ((inner, "", count), (final, end, closed)):
                if (tokens is inner and end and i == n) or (tokens is final and i not in wanted):
                    continue
                for j in range(i - 1, -1, -1):
                    part = word[j:i]
                    if part in tokens:
                        token = part + suffix
                        fit = j == 0
                        if not fit and (before := last[j]):
                            fit = fits.get((before, token))
                            if fit is None:
                                fit = fits[before, token] = self._fit(before, token)
                        if fit:
                            out[i] = count[j] + 1
                            if tokens is inner:
                                last[i] = token
                            break
                    elif part not in suffixes:
                        break
        return [(closed if end else count)[i] for i in wanted]

    def word(self, word: str) -> int:
        """Tokens of a whole byte-level word: the last entry of its prefixes' counts."""
        n = self.words.get(word)
        if n is None:
            n = self.prefix_counts(word, range(len(word), len(word) + 1))[0]
            if len(self.words) < self.most_kept:
                self.words[word] = n
        return n

    def _bytes(self, piece: str) -> str:
        return piece if piece.isascii() else "".join(map(self.chars.__getitem__, piece.encode()))

    def chunk(self, chunk: str) -> int:
        """Tokens of a lower-cased stretch of Latin text without white space."""
        n = sum(self.word(self._bytes(p)) for p in self.pieces.findall(chunk))
        if len(self.kept) < self.most_kept:
            self.kept[chunk] = n
        return n

    def _plain_count(self, text: str) -> int:
        if self.plain.match(text) and unicodedata.is_normalized("NFC", text):
            get, chunk = self.kept.get, self.chunk
            return sum([get(c) or chunk(c) for c in text.lower().split()])
        normal = self.tokenizer.normalizer.normalize_str(text)
        return sum(self.word(w) for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal))

    def count(self, text: str | None) -> int:
        """Tokens of a text; each special string inside it is one token."""
        if not text:
            return 0
        if self.split_special and "<|" in text:
            parts = self.split_special.split(text)
            return len(parts) - 1 + sum(map(self._plain_count, parts))
        return self._plain_count(text)

    def _piece_counts(self, piece: str, word: str) -> list[int]:
        """Token counts of the prefixes of a pre-tokenizer's piece, character by character; ``word`` is the piece as byte-level characters."""
        counts, at, out = self.prefix_counts(word), 0, []
        for c in piece:
            at += 1 if c.isascii() else len(c.encode())
            out.append(counts[at - 1])
        if piece in ("'re", "'ve", "'ll"):  # of a contraction's first two characters each is a word
            out[1] = self.word(self._bytes(piece[0])) + self.word(self._bytes(piece[1]))
        return out

    def _normal_counts(self, text: str) -> list[int]:
        """Token counts of all prefixes of a normalised stretch without white space."""
        out, done = [], 0
        for word, (start, stop) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text):
            out += [done + n for n in self._piece_counts(text[start:stop], word)]
            done = out[-1]
        return out

    def _stretch_counts(self, stretch: str) -> list[int]:
        """Token counts of all prefixes of a stretch without white space.

        Where normalising works character by character, an original prefix is a
        prefix of the normalised stretch; where characters are composed or put in
        order, each prefix is normalised and counted by itself.
        """
        if self.plain.match(stretch) and unicodedata.is_normalized("NFC", stretch) and len(low := stretch.lower()) == len(stretch):
            out, done = [], 0
            for p in self.pieces.findall(low):
                out += [done + n for n in self._piece_counts(p, self._bytes(p))]
                done = out[-1]
            return out
        normal = self.tokenizer.normalizer.normalize_str
        parts = [normal(c) for c in stretch]
        whole = normal(stretch)
        if "".join(parts) == whole:
            counts, at, out = [0, *self._normal_counts(whole)], 0, []
            for part in parts:
                at += len(part)
                out.append(counts[at])
            return out
        return [self._plain_count(stretch[: i + 1]) for i in range(len(stretch))]

    def steps(self, text: str | None) -> list[tuple[int, int]]:
        """(characters, tokens) at every prefix of the text where the count may change.

        Between two entries the count is that of the former: a prefix that ends in
        white space counts as the one before it. A special string counts one when
        complete; a part of it counts as the text that it is.
        """
        out, done, at = [(0, 0)], 0, 0
        text = text or ""
        spans = [(m.start(), m.end()) for m in self.split_special.finditer(text)] if self.split_special else []
        for start, stop in [*spans, (len(text), len(text))]:
            open_at, before = start, done  # the stretch that a special string's beginning would go on
            for m in _STRETCH.finditer(text, at, start):
                open_at, before = (m.start(), done) if m.end() == start else (start, done)
                counts = self._stretch_counts(m[0])
                out += [(m.start() + i + 1, done + n) for i, n in enumerate(counts)]
                done += counts[-1]
            if open_at == start:
                before = done
            if stop > start:
                out += [(i, before + self._plain_count(text[open_at:i])) for i in range(start + 1, stop)]
                done += 1
                out.append((stop, done))
            at = stop
        return out


_COUNTERS: dict[str, PrefixCounter] = {}


def counter_for(path: str) -> PrefixCounter:
    """The counter of this Python process, whose tables serve all its tasks."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    counter = _COUNTERS[path]
    if len(counter.fits) > 2_000_000:
        counter.fits.clear()
    return counter


def token_count(text: Column, path: str) -> Column:
    """Exact token count of a text column under the tokenizer file at ``path`` (null: 0)."""

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = counter_for(path)
        for texts in batches:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    return counted(text)


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``) of every document.

    The count is that of the longest prefix, the whole text, under the prefix
    dynamic programme; nothing is truncated. Null and empty texts have none.
    Rows with null or repeated doc_ids are counted as they are.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), token_count(text, path).alias("n_tokens")
    ).withColumn("over_limit", F.col("n_tokens") > limit)


def token_prefixes(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ``steps``: array of (chars, tokens), the exact token count at every prefix."""

    @F.pandas_udf("array<struct<chars:int,tokens:int>>")
    def steps(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = counter_for(path)
        for texts in batches:
            yield pd.Series([[{"chars": c, "tokens": n} for c, n in counter.steps(t)] for t in texts])

    return docs.select("doc_id", steps(F.col("text")).alias("steps"))


def truncated_length(steps: Column, budget: int) -> Column:
    """Characters of the longest prefix, in ``steps``, all of whose shorter ones also fit into ``budget`` tokens."""
    over = F.filter(steps, lambda s: s["tokens"] > budget)
    fit = F.filter(steps, lambda s: s["tokens"] <= budget)
    first = F.array_min(F.transform(over, lambda s: s["chars"]))
    return F.array_max(F.transform(F.filter(fit, lambda s: first.isNull() | (s["chars"] < first)), lambda s: s["chars"]))
