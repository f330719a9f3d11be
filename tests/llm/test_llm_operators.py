"""Corpus operators against brute force, exact round trips and held-out accuracy, with odd rows."""

from __future__ import annotations

import random
import time
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import oracle
import public_tokenizers as tokenizers
import pytest
from panelworks.llm import common, decontamination, html_text, licenses, near_dedup, packing, perplexity, sharding, token_counts, toxicity, vector_dedup
from panelworks.llm.queries import ORACLE_SQL, QUERIES
from pyspark.sql import functions as F
from tokenizers import Tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Null, empty and blank texts, repeated rows, null and repeated ids, other scripts, a very long word.
ODD = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "a"), (4, "a"), (5, "Σίσυφος ſ İ 你好 🙂 café"), (6, "x" * 30_000), (None, "no id here"), (7, "<|endoftext|> and <|startoftext|>"),
    (8, "MIT license, mit license; the Apache License."), (8, "the same id, another text"), (9, "a\x00b\x1cc \x85 ퟿"),
]


def table(spark, rows, extra=True):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    return df.withColumns({c: F.lit(1) for c in ("piece", "shard", "n", "score", "key", "part")}) if extra else df


def prose(seed: int, n: int, words: int = 300) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice("abcdefghij") + str(rng.randrange(words)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


# Sharding


def test_shards_are_contiguous_balanced_and_whole(spark, odd, empty):
    rows = [(i, prose(i, 1 + (i * 7) % 400)) for i in range(300)]
    got = sorted(sharding.shard_by_bytes(table(spark, rows)).collect(), key=lambda r: r["doc_id"])
    assert [r["doc_id"] for r in got] == list(range(300))
    assert all(a["shard"] <= b["shard"] for a, b in zip(got, got[1:]))
    total, sizes = sum(r["size"] for r in got), Counter()
    for r in got:
        text = dict(rows)[r["doc_id"]]
        assert r["size"] == len(text.encode()) + 1 and r["text_crc32"] == crc32(text.encode()) and r["law"] == "bytes" and r["grown_shard"] is None
        assert r["slot"] == sum(1 for q in got if q["shard"] == r["shard"] and q["doc_id"] < r["doc_id"])
        sizes[r["shard"]] += r["size"]
    assert max(abs(s - total / 16) for s in sizes.values()) <= max(r["size"] for r in got)
    assert Counter((r["doc_id"], r["size"]) for r in sharding.shard_by_bytes(odd).collect()) == Counter((i, len((t or "").encode()) + 1) for i, t in ODD)
    assert sharding.shard_by_bytes(empty).count() == 0


# Packing


def packed(docs):
    path = tokenizers.path
    return packing.pack_documents(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN, length=64, keep_ids=True)


def check_pack(rows, got, length=64):
    reference = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in rows:
        ids = [*reference.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % length or length
        cuts = [0, *range(first, len(ids) + 1, length)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(i, k, a, b - a, crc32(np.array(ids[a:b], "<u4").tobytes()), tuple(ids[a:b]))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= length
    return len(places), sum(r["length"] for r in got)


def test_packing_is_whole_gapless_and_tight(spark, odd, empty):
    rows = [(i, prose(i, (i * 13) % 90)) for i in range(250)]
    n, tokens = check_pack(rows, packed(table(spark, rows)).collect())
    assert n <= 1.06 * tokens / 64 + 3
    check_pack(ODD, packed(odd.drop("piece")).collect())
    assert packed(empty).count() == 0


def test_linear_groups_and_configurations():
    counts = {s: 10 + s % 7 for s in range(130, 1000, 3)}
    groups = packing.linear_groups(counts, 20)
    assert all(groups[s] >= s for s in counts) and len(set(groups.values())) <= 20
    sizes = sorted(set(groups.values()), reverse=True)
    need = [sum(counts[s] for s in counts if groups[s] == g) for g in sizes]
    plan = packing.configurations(sizes, need, 1024)
    assert all(sum(n * s for n, s in zip(p, sizes)) <= 1024 for p, _ in plan)
    assert [sum(p[i] * t for p, t in plan) for i in range(len(sizes))] == need
    assert sum(t for _, t in plan) <= 1.08 * sum(n * s for n, s in zip(need, sizes)) / 1024


# Token counts


def test_token_counts_are_the_librarys(spark, odd, empty):
    path = tokenizers.path("word_bpe_49k.json")
    reference = Tokenizer.from_file(path)
    rows = [*ODD, (20, "Don't STOP, it's 42 dogs'll café's über-ñandú!!! " * 20), (21, prose(1, 500))]
    got = token_counts.token_counts(table(spark, rows), path).collect()
    want = Counter((i, len((t or "").encode()), len(reference.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in got)
    assert token_counts.token_counts(empty, path).count() == 0


def test_every_prefix_has_its_exact_count(spark):
    path = tokenizers.path("word_bpe_49k.json")
    reference = Tokenizer.from_file(path)
    text = "Unbelievable dogs' antidisestablishment, über 42 <|endoftext|> naïve ok"
    steps = dict(token_counts.counter_for(path).steps(text))
    for i, n in steps.items():
        assert n == len(reference.encode(text[:i], add_special_tokens=False).ids), text[:i]
    df = token_counts.token_prefixes(table(spark, [(1, text), (2, None)]), path)
    cut = {r["doc_id"]: r["n"] for r in df.select("doc_id", token_counts.truncated_length(F.col("steps"), 5).alias("n")).collect()}
    assert cut[2] == 0 and len(reference.encode(text[: cut[1]], add_special_tokens=False).ids) <= 5


def test_steps_are_exact_for_odd_text():
    path = tokenizers.path("word_bpe_49k.json")
    reference, counter = Tokenizer.from_file(path), token_counts.counter_for(path)
    rng = random.Random(9)
    alphabet = ["a", "B", "é", "e\u0301", "\u0301", "İ", "ß", "ſ", "ΣΑΣ", "σς", "ǅ", "한", "\u1112\u1161\u11ab", "漢字", "q\u0323\u0307", "q\u0307\u0323", "'ll", "'re", "'", "'!!", "'s", "don't",
                "12", "½", "٣", " ", "\t", "\u2003", "\x1c", "\x85", "\x00", "🙂", "👩‍👩‍👧", "<|endoftext|>", "<|endof", "<|", "!?", "ing", "The", "\ud7ff", "ﬁ", "Å", "\u212b", "य़"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 9))) for _ in range(1500)] + ["İstanbul", "x<|endoftext|>y <|startoftext|>", "a<|endof b"]
    for text in texts:
        steps = dict(counter.steps(text))
        n = 0
        for i in range(len(text) + 1):
            n = steps.get(i, n)
            assert n == len(reference.encode(text[:i], add_special_tokens=False).ids), (text, i)
        assert n == counter.count(text)


# Near duplicates


def edits(a, b):
    """Edit distance of two word lists, a row of the whole table at a time."""
    row = np.arange(len(b) + 1)
    other = np.array([hash(x) for x in b])
    for i, x in enumerate(a, 1):
        new = np.r_[i, np.minimum(row[1:] + 1, row[:-1] + (other != hash(x)))]
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return int(row[-1])


def edit_links(rows, threshold=0.8):
    texts = [(i, common.words(t or "")) for i, t in rows]
    bags = {i: Counter(w) for i, w in texts}
    out = set()
    for n, (i, a) in enumerate(texts):
        for j, b in texts[n + 1 :]:
            longer = max(len(a), len(b))
            if a and b and (bags[i] & bags[j]).total() >= threshold * longer and longer - edits(a, b) >= threshold * longer:
                out.add((i, j))
    return out


def closure(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(5)
    rows, n = [], 0
    for g in range(12):
        base = prose(g, 120 + 40 * g, 5000).split()
        for changes in (0, 0, 1, 2, 60 + 20 * g, 5 + g):  # the fifth is another text
            words = list(base)
            for at in rng.sample(range(len(words)), min(changes, len(words))):
                words[at] = rng.choice(["", f"new{rng.randrange(10**6)}", f"{words[at]} new{rng.randrange(10**6)}"])
            rows.append((n, " ".join(words)))
            n += 1
    shared = prose(99, 60, 5000)
    rows += [(n + i, f"{prose(1000 + i, 150, 5000)} {shared}") for i in range(20)]
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(table(spark, rows)).collect()}
    want = closure(dict(rows), edit_links(rows))
    assert {i: r["cluster_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["cluster_id"]) for i, r in got.items())
    assert sum(r["kept"] for r in got.values()) == near_dedup.deduplicate(table(spark, rows)).count()


def test_near_duplicates_find_the_pairs_of_the_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r["cluster_id"] for r in near_dedup.near_duplicates(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    texts = {i: common.words(t or "") for i, t in rows}
    having = defaultdict(set)  # pairs over the threshold share a run of five words, or are very short
    for i, w in texts.items():
        for k in range(len(w) - 4):
            having[tuple(w[k : k + 5])].add(i)
    near = {(a, b) for ids in having.values() if len(ids) < 100 for a in ids for b in ids if a < b}
    links = {(a, b) for a, b in near if (Counter(texts[a]) & Counter(texts[b])).total() >= 0.8 * (n := max(len(texts[a]), len(texts[b]))) and n - edits(texts[a], texts[b]) >= 0.8 * n}
    assert len(links) > 60
    assert sum(got[a] == got[b] for a, b in links) >= 0.95 * len(links)
    want = closure(texts, links | {p for ids in by_text(rows) for p in zip(ids, ids[1:])})
    assert all(want[i] == want[c] for i, c in got.items())  # nothing is joined that brute force leaves apart


def by_text(rows):
    same = defaultdict(list)
    for i, t in rows:
        if t is not None:
            same[t].append(i)
    return same.values()


def test_copies_around_the_threshold_inside_a_shared_passage(spark):
    rng = random.Random(8)
    passage = prose(77, 40, 5000)
    rows = []
    for g in range(20):  # families on both sides of 0.8 that all hold one passage
        base = prose(500 + g, 110, 5000).split()
        for _ in range(12):
            words = list(base)
            for at in rng.sample(range(len(words)), rng.choice((4, 10, 14, 18))):
                words[at] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows), f"{passage} {' '.join(words)}"))
    got = {r["doc_id"]: r["cluster_id"] for r in near_dedup.near_duplicates(table(spark, rows)).collect()}
    assert got == closure(dict(rows), edit_links(rows))


def test_histograms_never_rule_out_a_similar_pair():
    rng = random.Random(2)
    for _ in range(300):
        a = prose(rng.randrange(9), rng.randrange(2, 400), 50).split()
        b = [w if rng.random() > 0.15 else "new" for w in a] if rng.random() < 0.8 else prose(rng.randrange(9), 50, 50).split()
        x, y = (common.word_hashes([w.encode() for w in ws]) for ws in (a, b))
        if near_dedup.similarity(x, y) >= 0.8:
            bins = (near_dedup.histogram(w)[None] for w in (x, y))
            assert near_dedup.may_reach(*bins, np.array([len(x)]), np.array([len(y)]), 0.8).all()


def test_near_duplicates_of_odd_rows(spark, odd, empty):
    got = sorted((r["doc_id"], r["cluster_id"], r["kept"]) for r in near_dedup.near_duplicates(odd).collect())
    assert got == sorted((i, i, True) for i, _ in {r for r in ODD if r[0] is not None})
    assert near_dedup.near_duplicates(empty).count() == 0 and near_dedup.deduplicate(empty).count() == 0
    out = near_dedup.deduplicate(odd)
    assert out.columns == odd.columns and out.where("doc_id is null").count() == 1
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter(set(ODD))  # (4, 'a') stands there twice


def test_a_repeated_doc_id_takes_no_other_text_along(spark):
    a, b = prose(1, 80), prose(2, 80)
    out = near_dedup.deduplicate(table(spark, [(3, a), (8, a), (8, b), (9, b), (9, b), (3, a)]).withColumn("_text_key", F.lit("mine")))
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(3, a), (8, b)]
    assert {r["_text_key"] for r in out.collect()} == {"mine"}


def test_alignment_is_an_edit_distance():
    rng = random.Random(1)
    for _ in range(400):
        a = [rng.randrange(4) for _ in range(rng.randrange(40))]
        b = [x for x in a if rng.random() > 0.1] + [7] * rng.randrange(3)
        d = edits(a, b)
        x, y = np.array(a, np.uint32), np.array(b, np.uint32)
        assert near_dedup.banded_distance(x, y, d) == d == near_dedup.banded_distance(x, y, d + 5)
        assert d == 0 or near_dedup.banded_distance(x, y, d - 1) is None
        n = max(len(a), len(b), 1)
        assert near_dedup.similarity(x, y, 0.8) == pytest.approx(1 - d / n if d <= 0.2 * n + 1e-9 else 0)


def test_alignment_of_long_texts_is_quick():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 5000, 20_000).astype(np.uint32)
    b = a.copy()
    b[rng.choice(len(a), 1500, replace=False)] = rng.integers(0, 5000, 1500)
    began = time.time()
    assert 0.92 < near_dedup.similarity(a, b) < 0.94 and time.time() - began < 5


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = closure({x for e in edges for x in e}, edges)
    assert got == {i: c for i, c in want.items() if any(i in e and e[0] != e[1] for e in edges)}


def test_components_of_stars_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(1000, 1400)] + [(9000, i) for i in range(2000, 2300)] + [(5, i) for i in range(3000, 3200)] + [(3000, 2000), (7, 7)]
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: c for i, c in closure({x for e in edges for x in e}, edges).items() if i != 7}


# Decontamination


def test_contamination_is_exact_containment(spark, odd, empty):
    items = [(i, prose(500 + i, 12 + 9 * i, 5000)) for i in range(8)] + [(90, None), (91, "too short"), (3, prose(77, 40, 5000)), (92, "..."), (93, "Paris is nice."), (94, "zzyzx"), (95, "one two three four")]
    rng = random.Random(8)
    rows = [*ODD, (60, "They say PARIS is: nice every day"), (61, "paris is not nice"), (62, "ab zzyzx"), (63, "one two three four"), (64, "two three four one"), (65, "paris is")]
    for i in range(40):
        words = prose(i, rng.choice([20, 300, 6000]), 5000).split()
        quote = (items[i % 8][1]).split()
        for _ in range(i % 5):
            quote[rng.randrange(len(quote))] = "changed"
        at = rng.randrange(len(words))
        rows.append((100 + i, " ".join(words[:at] + quote + words[at:])))
    bench = spark.createDataFrame(items, "item_id long, text string")

    def sets(t):
        w = common.words(t or "")
        return {tuple(w[k : k + n]) for n in range(1, 6) for k in range(len(w) - n + 1)}

    def asked(q):
        n = min(5, len(common.words(q or "")))
        return {x for x in sets(q) if len(x) == n}

    want = {(d, i) for d, t in rows if d is not None for i, q in items if asked(q) and len(asked(q) & sets(t)) >= 0.8 * len(asked(q))}
    assert {(60, 93), (62, 94), (63, 95)} <= want and not {(61, 93), (64, 95)} & want
    got = decontamination.contaminated_pairs(table(spark, rows), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want) > 15
    shuffled = decontamination.contaminated_pairs(table(spark, rows), bench, most_broadcast=0).collect()
    assert {(r["doc_id"], r["item_id"]) for r in shuffled} == want
    assert decontamination.contaminated_pairs(empty, bench).count() == 0 and decontamination.contaminated_pairs(odd, bench.limit(0)).count() == 0
    bad = {t for d, t in rows if d in {p[0] for p in want} and d >= 60}
    again = [*rows, (None, sorted(bad)[0]), (101, "an innocent text of the same doc_id"), (8, sorted(bad)[1])]
    left = decontamination.decontaminate(table(spark, again).withColumn("_text_hash", F.lit(3)), bench)
    assert Counter((r["doc_id"], r["text"], r["_text_hash"]) for r in left.collect()) == Counter((i, t, 3) for i, t in again if t not in bad)


# Quality


class DirectModel:
    """Interpolated modified Kneser-Ney by its definition, from the 5-grams of trusted texts and how often each stands there."""

    def __init__(self, counts):
        self.counts = {5: dict(counts)}
        for order in range(4, 0, -1):
            self.counts[order] = Counter(k & ((1 << 12 * order) - 1) for k in self.counts[order + 1])
        self.cuts, self.after = {}, {}
        for order, c in self.counts.items():
            of = Counter(c.values())
            y = of[1] / (of[1] + 2 * of[2]) if of[1] + 2 * of[2] else None
            d = {0: 0.0}
            for i, default in ((1, 0.5), (2, 0.75), (3, 1.0)):
                v = i - (i + 1) * y * of[i + 1] / of[i] if y is not None and of[i] and of[1] else -1
                d[i] = v if 0 < v < i else default
            self.cuts[order] = d
            self.after[order] = defaultdict(list)
            for k, n in c.items():
                self.after[order][k >> 12].append(n)

    def p(self, k, order=5, own=True):
        """Of the last character after those before it; without the n-gram's own count if not ``own``."""
        if not order:
            return 1 / 4096
        c, d, k = self.counts[order], self.cuts[order], k & ((1 << 12 * order) - 1)
        same, low = self.after[order].get(k >> 12), self.p(k, order - 1)
        if not same:
            return low
        n = c.get(k, 0) if own else 0
        return (n - d[min(n, 3)] + sum(d[min(v, 3)] for v in same) * low) / sum(same)


def test_kneser_ney_sums_to_one_and_matches_a_direct_model(spark):
    texts = ["abracadabra abra cadabra", "the cat sat on the mat the cat", "abab cdcd abab"]
    g = np.concatenate([perplexity.ngrams(t) for t in texts])
    keys, n = np.unique(g, return_counts=True)
    context = int(keys[3]) >> 12
    wanted = {int(k): int(c) for k, c in zip(keys, n)}
    for c in range(4096):
        wanted.setdefault((context << 12) | c, 0)
    raw = spark.createDataFrame([("en", k, c, max(c, 1)) for k, c in wanted.items()], "lang string, g long, n long, m long")
    got = {r["g"]: np.exp(r["logp"]) for r in perplexity.kneser_ney(raw).collect()}
    assert abs(sum(p for k, p in got.items() if k >> 12 == context) - 1) < 1e-4
    direct = DirectModel(zip(map(int, keys), map(int, n)))
    for k in [*map(int, keys[:40]), (context << 12) | 77]:
        assert got[k] == pytest.approx(direct.p(k), rel=1e-4)


@pytest.mark.parametrize("most_shared", [500_000, 60, 0])
def test_perplexity_of_every_document_by_hand(spark, most_shared):
    rng = random.Random(11)
    syllables = {"en": "ba ce di fo gu".split(), "xx": "漢 字 仮 名 交 い".split(), "": "zi zo".split()}
    rows = [(i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(rng.randrange(0, 30))), lang or None) for i, lang in enumerate(["en", "xx", ""] * 25)]
    rows += [(75, None, "en"), (0, "another text with the id of a trusted one", "en"), (0, "another text with the id of a trusted one", "en"), (None, "ba ce di", "en")]
    docs = spark.createDataFrame([(i, t, g, "s", 0) for i, t, g in rows], DOCS)
    trusted = {i for i in range(0, 60, 2)}
    labels = spark.createDataFrame([(i, 1) for i in trusted] + [(1, 0), (61, None)], "doc_id long, quality int")
    got = Counter((r["doc_id"], r["lang"], r["n_chars"], round(r["perplexity"], 2), r["kept"]) for r in perplexity.quality(docs, labels, most_shared=most_shared).collect())
    want = Counter()
    for lang in ("en", "xx", ""):
        mine = [(i, t or "", i in trusted) for i, t, g in rows if (g or "") == lang]
        counts = Counter(k for _, t, good in mine if good for k in map(int, perplexity.ngrams(t)))
        direct = DirectModel(counts)
        sums = []
        for _, t, good in mine:
            own = Counter(map(int, perplexity.ngrams(t)))
            sums.append(sum(n * np.log(direct.p(k, own=not good or counts[k] > n)) for k, n in own.items()))
        mean = sum(s for s, (_, _, good) in zip(sums, mine) if good) / sum(len(t) for _, t, good in mine if good)
        values = [np.exp(-(s + 40 * mean) / (len(t) + 40)) for s, (_, t, _) in zip(sums, mine)]
        best = sorted(v for v, (_, _, good) in zip(values, mine) if good)
        limit = 1.2 * best[int(np.ceil(0.99 * len(best))) - 1]
        want.update((i, lang, len(t), round(v, 2), bool(v <= limit)) for v, (i, t, _) in zip(values, mine))
    near = lambda c: Counter((i, g, n, k) for i, g, n, _, k in c.elements())
    assert near(got) == near(want)
    assert all(abs(a[3] - b[3]) <= 0.02 + 1e-3 * b[3] for a, b in zip(sorted(got.elements(), key=str), sorted(want.elements(), key=str)))


def test_quality_rejects_other_text_and_keeps_odd_rows(spark, odd, empty):
    rng = random.Random(4)
    syllables = "ba ce di fo gu la me ni ro su".split()
    clean = [(i, " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(2, 80)))) for i in range(300)]
    junk = [(1000 + i, " ".join("".join(rng.choice("xqz#$%!") for _ in range(6)) for _ in range(40))) for i in range(20)]
    docs = table(spark, [*clean, *junk], extra=False)
    labels = spark.createDataFrame([(i, 1) for i in range(0, 300, 2)] + [(1000, 0), (None, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in perplexity.quality(docs, labels).collect()}
    assert len(got) == 320 and not any(got[i]["kept"] for i, _ in junk)
    assert sum(got[i]["kept"] for i, _ in clean) >= 297
    clash = docs.withColumns({c: F.lit(7) for c in ("trusted", "kept", "text_key", "threshold", "_row", "_lang", "n", "g")})
    kept = perplexity.keep_good(clash, labels)
    assert kept.columns == clash.columns and kept.count() == sum(r["kept"] for r in got.values()) and kept.where("_row <> 7").count() == 0
    twice = perplexity.keep_good(docs.union(docs.where("doc_id = 3").withColumn("text", F.lit(junk[0][1]))), labels)
    assert [r["text"] for r in twice.where("doc_id = 3").collect()] == [clean[3][1]]  # the other text of the same doc_id goes alone
    assert perplexity.quality(odd, labels.limit(0)).count() == len(ODD) and all(r["kept"] for r in perplexity.quality(odd, labels.limit(0)).collect())
    assert perplexity.keep_good(odd, labels).count() >= 1
    assert perplexity.quality(empty, labels).count() == 0 and perplexity.keep_good(empty, labels).count() == 0


# Toxicity


def tox_rows(n=600):
    rng = random.Random(6)
    bad = ["vilestuff", "hatefulness", "cruelling"]
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(5, 60))]
        toxic = rng.random() < 0.2
        if toxic:
            words.insert(0, rng.choice(bad) + rng.choice(["", "er", "ish"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic), 1))
    return rows, labels


def test_toxicity_generalises_to_held_out_rows(spark, odd, empty):
    rows, marks = tox_rows()
    labels = spark.createDataFrame(marks, "doc_id long, toxic int, quality int")
    got = toxicity.toxicity(table(spark, rows), labels).collect()
    truth = {i: t for i, t, _ in marks}
    held = [r for r in got if r["held_out"]]
    assert len(got) == 600 and all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.toxicity(odd, labels).count() == len(ODD) and toxicity.toxicity(empty, labels).count() == 0
    assert {r["score"] for r in toxicity.toxicity(odd, labels.limit(0)).collect()} == {0.5}
    flipped = labels.withColumn("toxic", F.when(toxicity.in_training_fold(F.col("doc_id")), F.col("toxic")).otherwise(1 - F.col("toxic")))
    assert sorted(r["score"] for r in toxicity.toxicity(table(spark, rows), flipped).collect()) == sorted(r["score"] for r in got)


def test_swaps_bring_scores_of_groups_together():
    rng = np.random.default_rng(0)
    rows, swapped, y = [], [], []
    for _ in range(800):
        named = rng.random() < 0.5
        toxic = rng.random() < (0.6 if named else 0.1)
        own = [2 if toxic and rng.random() < 0.7 else 3] + ([0] if named else [])
        rows.append(np.array(sorted(own)))
        swapped.append(np.array(sorted([1 if f == 0 else f for f in own])))
        y.append(float(toxic))
    free, _ = toxicity.fit_logistic(rows, swapped, np.array(y), 4, 1e-4, 0.0)
    held, _ = toxicity.fit_logistic(rows, swapped, np.array(y), 4, 1e-4, 50.0)
    assert abs(held[0] - held[1]) < 0.3 * abs(free[0] - free[1])


def test_neutral_mentions_of_a_group_are_less_often_false_positives(spark):
    rng = random.Random(3)
    rows, marks = [], []
    for i in range(900):  # one group's name stands mostly in toxic texts, the other's in none
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(8, 30))]
        toxic = i < 700 and rng.random() < 0.3
        if toxic:
            words.insert(0, "vilestuff" if rng.random() < 0.6 else "plainword")
        if i >= 700:
            words.append("muslims")  # neutral mentions, not labelled
        elif toxic and rng.random() < 0.8:
            words.append("muslims")
        elif not toxic and rng.random() < 0.3:
            words.append(rng.choice(["christians", "jews", "hindus"]))
        rows.append((i, " ".join(words)))
        if i < 700:
            marks.append((i, int(toxic), 1))
    docs, labels = table(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int, quality int")

    def alarms(penalty):
        got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels, penalty=penalty).collect()}
        caught = [got[i]["predicted"] for i, t in rows if "vilestuff" in t and got[i]["held_out"]]
        return sum(got[i]["predicted"] for i in range(700, 900)), sum(caught) / len(caught)

    (free, _), (held, caught) = alarms(0.0), alarms(20.0)
    assert free > 150 and held < free / 4 and caught > 0.9


def test_civil_rows_stay_as_they_are(spark, odd, empty):
    rows, marks = tox_rows(300)
    labels = spark.createDataFrame([*marks, (None, 1, 1), (5000, None, 1), (0, 1, 1)], "doc_id long, toxic int, quality int")
    docs = table(spark, [*rows, *ODD, (6000, "vilestuff hatefulness " + rows[0][1]), (None, "vilestuff hatefulness cruelling")])
    kept = toxicity.keep_civil(docs, labels)
    left = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert kept.columns == docs.columns and not any("vilestuff" in (t or "") for _, t in left)
    assert all(left[r] == n for r, n in Counter(ODD).items())
    assert toxicity.keep_civil(empty, labels).count() == 0 and toxicity.keep_civil(odd, labels.limit(0)).count() == len(ODD)


# Licences


def naive_licenses(text):
    ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = "".join(c if c.isdigit() and c.isascii() or "a" <= c <= "z" or ord(c) >= 128 else " " for c in ws).split(" ")
    ws = [w for w in ws if w]
    at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
    return len(ws), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_licenses_match_a_naive_scan(spark, odd, empty):
    rows = [*ODD, (30, "GNU General Public License. " * 3 + "MIT  LICENSE"), (31, "x " * 5000 + "Licensed under CC BY-NC 4.0."), (32, "licensed under the new apache license, version 2.0")]
    got = licenses.scan_licenses(table(spark, rows)).collect()
    want = Counter((i, *naive_licenses(t)) for i, t in rows)
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == want
    by = {r["doc_id"]: r for r in got}
    assert by[31]["labels"] == "cc-by-nc" and by[30]["labels"] == "gpl,mit" and by[32]["labels"] == "apache" and all(0 <= r["score"] <= 1 for r in got)
    assert licenses.scan_licenses(empty).count() == 0


def voted(text, k=3, drift=3, cover=0.7):
    """Labels and best cover of a text by diagonal voting, without keys, joins or windows."""
    ws = common.words(text or "", lower=False)
    spans = []
    for name, template in licenses.TEMPLATES.items():
        told = common.words(template)
        votes = sorted((i - j, i, j) for i in range(len(ws) - k + 1) for j in range(len(told) - k + 1) if ws[i : i + k] == told[j : j + k])
        groups = []
        for v in votes:
            if not groups or v[0] - groups[-1][-1][0] > drift:
                groups.append([])
            groups[-1].append(v)
        for g in groups:
            matched = len({j + n for _, _, j in g for n in range(k)})
            first, last = min(i for _, i, _ in g), max(i for _, i, _ in g) + k - 1
            if matched / len(told) >= cover and last - first < len(told) + 2 * drift:
                spans.append((name.split("/")[0], first, last, matched, matched / len(told)))

    def beaten(a):
        return any(b[0] != a[0] and b[3] > a[3] and 2 * (min(a[2], b[2]) - max(a[1], b[1]) + 1) > a[2] - a[1] + 1 for b in spans)

    left = [s for s in spans if not beaten(s)]
    return {s[0] for s in left}, max((s[4] for s in left), default=0.0), Counter(s[:3] for s in left)


def test_labels_and_scores_match_voting_by_hand(spark):
    rng = random.Random(12)
    rows = []
    for i in range(60):
        parts = []
        for name in rng.sample(sorted(licenses.TEMPLATES), rng.randrange(4)):
            ws = licenses.TEMPLATES[name].split()
            for _ in range(rng.choice([0, 0, 1, 4, 12])):
                at = rng.randrange(len(ws))
                ws[at : at + 1] = rng.choice([[], ["other"], [ws[at], "the"]])
            parts += [" ".join(ws), prose(i, rng.randrange(8)), "of the software and the license"][: rng.randrange(1, 4)]
        rows.append((i, ". ".join(parts)))
    got = {r["doc_id"]: r for r in licenses.scan_licenses(table(spark, rows)).collect()}
    for i, text in rows:
        labels, score, _ = voted(text)
        base = set(naive_licenses(text)[4].split(",")) - {""}
        assert got[i]["labels"] == ",".join(sorted(labels | base)) and got[i]["score"] == pytest.approx(1.0 if base else score), text
    spans = Counter()
    for _, text in rows:
        spans.update(voted(text)[2])
    assert Counter((r["label"], r["first"], r["last"]) for r in licenses.license_spans(table(spark, rows)).collect()) == spans and len(spans) > 60


def test_a_changed_notice_is_found_on_neighbouring_diagonals(spark):
    text = "Some words. " + licenses.TEMPLATES["mit/opening"].replace("any person", "any kind person").replace("software", "program") + " and more."
    sharealike = "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."
    rows = {r["doc_id"]: r for r in licenses.scan_licenses(table(spark, [(1, text), (2, sharealike)])).collect()}
    assert rows[1]["labels"] == "mit" and 0.7 <= rows[1]["score"] < 1 and rows[2]["labels"] == "cc-by-sa"


# Pages


def test_main_text():
    page = """<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href=/a>Home</a></li></ul></nav><div class="ad">Buy &amp; save</div>
<article><h1>Head  &eacute;</h1><p><b>First <i>para</i>&nbsp;graph.<br><p>Ti.</p><aside>Side</aside><div class="comments"><p>I disagree strongly.</p></div><p>Last &lt;b&gt; 1 < 2</p></article><footer>&copy; all</footer>"""
    assert html_text.main_text(page) == "Head é\nFirst para graph.\nTi.\nLast <b> 1 < 2"
    plain = "<body><div><a href=/>Menu</a> <a href=/b>More</a></div>" + "".join(f"<p>{'Sentence number %d is long enough to be text. ' % i * 3}</p>" for i in range(6)) + "<div id='footer'>Imprint</div></body>"
    assert html_text.main_text(plain).count("\n") == 5 and "Menu" not in html_text.main_text(plain)
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>a</nav>") == ""
    assert html_text.main_text("<div class=ad>x<main><p>Text</p></main>") == "Text"
    assert html_text.main_text("just words") == "just words"
    assert html_text.main_text("<p title='a>" * 2000) is not None


@pytest.mark.parametrize("around", ["article", "main", "div", "section"])
def test_text_lies_between_surge_and_dive_whatever_the_markup(around):
    paragraphs = [f"Paragraph {i} {'with words that make it text. ' * (1 + i % 3)}".strip() for i in range(9)] + ["Short.", "See the source of it"]
    body = "".join(f"<p>{p}</p>" for p in paragraphs[:-1]) + f"<p><a href=/s>{paragraphs[-1]}</a></p><p>And a last paragraph that is long enough.</p>"
    links = "<div><a href=/>Home</a> <a href=/b>News</a></div>" * 3
    page = f"<body>{links}<div class='cookie-notice'>{'We use cookies. ' * 20}</div><{around}><h1>The headline</h1>{body}</{around}>{links}<div id=footer>Imprint</div></body>"
    assert html_text.main_text(page).split("\n") == ["The headline", *paragraphs, "And a last paragraph that is long enough."]


def test_runs_match_a_scan_of_all_windows():
    def scan(weight, window, surge):
        inside, out = False, []
        need = surge if any(sum(weight[i : i + window]) >= surge for i in range(len(weight))) else max(1, max((sum(weight[i : i + window]) for i in range(len(weight))), default=0) / 2)
        for i in range(len(weight)):
            ahead = sum(weight[i : i + window])
            inside = ahead > 0 if inside else weight[i] > 0 and ahead >= need
            out.append(inside)
        return out

    rng = random.Random(2)
    for _ in range(500):
        weight = [rng.choice([0, 0, 0, 5, 30, 90, 400]) for _ in range(rng.randrange(30))]
        runs = html_text.text_runs(weight, 3, 80)
        assert [any(a <= i < b for a, b in runs) for i in range(len(weight))] == scan(weight, 3, 80)


def test_long_and_deep_pages(spark):
    page = "<article>" + "<div>" * 3000 + "".join(f"<p>Line {i} of a very long page</p>" for i in range(20_000)) + "</div>" * 3000 + "</article><footer>x</footer>"
    assert html_text.main_text(page).count("\n") == 19_999
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize(
    "tag",
    ["<audio-player src=x></audio-player>", "<video-js>", "<button-group></button-group>", "<select-menu/>", "<math-field>", "<object-x>",
     "<svg viewBox='0 0 1 1'/>", "<math/>", "<iframe src=x />", "<object data=x />", "<video src=x>", "<svg><path/></svg>", "<select><option>No</select>", "<video src=x><p>Between</p><video>no</video>"],
)
def test_pages_keep_the_text_after_any_element(tag):
    text = html_text.main_text(f"<p>a</p>{tag}<article><p>Text of the article.</p>{tag}<p>Its <math><mi>x</mi></math> end.</p></article>")
    inside = ["Between"] if "Between" in tag else []
    assert text.split("\n") == ["Text of the article.", *inside, "Its x end."]
    assert html_text.main_text("<article><p>Text</p><script>var x = '<p>no</p>'") == "Text"


def test_sections_on_both_sides_of_adverts_are_kept():
    def section(name, chars):
        return "".join(f"<p>{name} {i} {'has a sentence that is text. ' * 5}</p>" for i in range(chars // 150))

    adverts = "<div class=ad>Buy now and save</div>" * 2 + "<p><a href=/x>Read more about it</a></p>" * 3
    text = html_text.main_text(f"<body>{section('First', 3000)}{adverts}{section('Last', 500)}</body>")
    assert text.count("First") == 20 and text.count("Last") == 3 and "Buy" not in text and "Read" not in text


def test_pages_keep_every_row(spark):
    rows = [(1, "u", None), (2, None, "<p>Hello there</p>"), (2, None, "<p>Hello there</p>"), (None, "v", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert Counter((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in html_text.extract_text(df).collect()) == {(1, "u", "", 0): 1, (2, None, "Hello there", 11): 2, (None, "v", "", 0): 1}


# Vectors


def test_vector_links_match_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(150, 64))
    near = np.concatenate([base[:30] + rng.normal(size=(30, 64)) * s for s in (0.05, 0.1, 0.25, 0.3)])
    x = np.concatenate([base, near, base[:5], np.repeat(base[7:8], 40, 0) + rng.normal(size=(40, 64)) * 0.02]).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(9001, None), (9002, [0.0] * 64), (9003, [float("nan")] * 64), (9004, [float("inf")] + [1.0] * 63), (9005, []), (9006, [1.0, None]), (None, [1.0] * 64)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("n", F.lit(1))
    got = {r["vec_id"]: r for r in vector_dedup.vector_duplicates(df).collect()}
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    a, b = np.nonzero(np.triu(u @ u.T >= 0.95, 1))
    want = closure(range(len(x)), list(zip(a.tolist(), b.tolist())))
    n = np.bincount(np.concatenate([a, b]), minlength=len(x))
    assert {i: (r["n_links"], r["component_id"]) for i, r in got.items() if i < 9000} == {i: (n[i], want[i]) for i in range(len(x))}
    assert {(i, got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) for i in range(9001, 9007)} == {(i, 0, i, True) for i in range(9001, 9007)}
    assert vector_dedup.vector_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [1, 7, 1500])
def test_large_cells_are_compared_part_by_part(spark, block):
    rng = np.random.default_rng(3)
    x = rng.normal(size=64) + rng.normal(size=(60, 64)) * 0.02
    units = [(i, 1 + i % 3, (v / np.linalg.norm(v)).tobytes()) for i, v in enumerate(x)]
    df = spark.createDataFrame(units, "id long, n long, unit binary")
    got = vector_dedup.linked(df, 0.95, 4, 2, 0.45, block=block).groupBy("id").agg(F.sum("others").alias("others")).collect()
    copies = sum(1 + i % 3 for i in range(60))
    assert {r["id"]: r["others"] for r in got} == {i: copies - 1 - i % 3 for i in range(60)}


def test_sql_of_the_vector_query_links_as_the_operator(spark, tmp_path):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base, base[:10] + rng.normal(size=(10, 16)) * 0.1, base[:10] + rng.normal(size=(10, 16)) * 0.3, base[:3]])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(100, None), (101, [0.0] * 16), (102, [float("nan"), 1.0]), (103, [])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert oracle.compare(spark, QUERIES["op6_vector_dedup"], ORACLE_SQL["op6_vector_dedup"], str(tmp_path)) == ""


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_with_sql_give_its_rows(spark, name):
    assert oracle.compare(spark, QUERIES[name], ORACLE_SQL[name], "/root/testdata/sf0.01") == ""


def test_e8_points_are_lattice_points_and_nearest():
    rng = np.random.default_rng(0)
    z = rng.normal(size=(300, 8)) * 2
    near, far = vector_dedup.e8_points(z)
    for p in (near, far):
        assert ((p % 2 == p[:, :1] % 2).all(1)).all() and (p.sum(1) % 4 == 0).all()
    step = np.concatenate([np.eye(8)[i] * a + np.eye(8)[j] * b for i in range(8) for j in range(i) for a in (2, -2) for b in (2, -2)]).reshape(-1, 8)
    d0 = ((z - near / 2) ** 2).sum(1)
    for s in step:
        assert (((z - (near + s) / 2) ** 2).sum(1) >= d0 - 1e-9).all()
