"""Byte-level BPE, fill-in-the-middle and spelling variants against the library, round trips and brute force."""

from __future__ import annotations

import random
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
import oracle
import public_tokenizers as tokenizers
import pytest
from panelworks.llm import bpe, fill_middle, spelling
from panelworks.llm.queries import ORACLE_SQL, QUERIES
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from test_llm_operators import ODD, prose, table

PATH = tokenizers.path("byte_bpe_50k.json")
STRANGE = [
    "a  b", "a \n b", " \n", "\n\n x", "x \t\t y  ", "don't we'll I'VE 'tis", "a b　 c", "<|endoftext|>", "x<|endoftext|> <|endoftext|>y", "<|endoftext", "aaaaaaaaaaaaaaa" * 9,
    "漢字かな交じり文 🙂🙂 é", "\x00\x1c\x1d\x85 ", "1234567 12.5% --- ___", "ſ İ ß Σίσυφος", "а б в", "�﻿",
]


# BPE


def test_ids_and_texts_are_the_librarys(spark):
    library = Tokenizer.from_file(PATH)
    rng = random.Random(3)
    mixed = ["".join(rng.choice([" ", "  ", "\n", "the", "ing", "'s", "é", "漢", "1", ".", "\t", "<|endoftext|>", "ab", "Z"]) for _ in range(rng.randrange(60))) for _ in range(400)]
    rows = [*ODD, *((100 + i, t) for i, t in enumerate([*STRANGE, *mixed, prose(1, 3000)]))]
    docs = table(spark, rows).withColumns({c: F.lit(2) for c in ("ids", "n_tokens")})
    encoded = bpe.encode_documents(docs, PATH)
    decoded = bpe.decode_documents(encoded, PATH).collect()
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r["doc_id"], bytes(r["ids"]), r["text"]) for r in decoded) == want
    got = Counter(tuple(r) for r in bpe.token_digests(docs, PATH).collect())
    assert got == Counter({(i, len(b) // 4, sha256(b).hexdigest(), sha256(t.encode()).hexdigest()): n for (i, b, t), n in want.items()})
    assert bpe.token_digests(docs.limit(0), PATH).count() == 0


def test_decoding_takes_any_ids(spark):
    library = Tokenizer.from_file(PATH)
    rng = random.Random(5)
    rows = [(i, [rng.randrange(50_257) if rng.random() < 0.5 else rng.randrange(256) for _ in range(30)]) for i in range(200)]
    df = spark.createDataFrame([(i, bytearray(np.array(x, "<u4").tobytes())) for i, x in rows] + [(999, None)], "doc_id long, ids binary")
    got = {r["doc_id"]: r["text"] for r in bpe.decode_documents(df, PATH).collect()}
    assert got.pop(999) == ""
    assert got == {i: library.decode(x, skip_special_tokens=False) for i, x in rows}


def test_kept_words_and_blocks_do_not_matter():
    library = Tokenizer.from_file(PATH)
    texts = [prose(i, 60) for i in range(40)]
    index = bpe.PairIndex(PATH, most_kept=50, block=40)
    assert [np.frombuffer(x, "<u4").tolist() for t in texts for x in index.encode([t])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_bpe_query_over_a_table(spark, sf_dir):
    library = Tokenizer.from_file(PATH)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for i, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i] = (len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r[0]: tuple(r[1:]) for r in QUERIES["op11_bpe"](spark, sf_dir).collect()} == want


# Fill in the middle


def by_hand(doc_id, text, plan):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digits = sha256(f"{plan.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[i : i + 8], 16) for i in (0, 8, 16, 24)]
    low, high = sorted(x % (len(lines) + 1) for x in h[:2])
    a, b, c = ("".join(x) for x in (lines[:low], lines[low:high], lines[high:]))
    p, s, m = plan.marks
    if not text or any(x in text for x in plan.marks) or h[2] % 100 >= plan.percent:
        return (doc_id, len(lines), "plain", None, None, text)
    spm = h[3] % 100 < plan.suffix_first
    return (doc_id, len(lines), "spm" if spm else "psm", len(a), len(b), f"{s}{c}{p}{a}{m}{b}" if spm else f"{p}{a}{s}{c}{m}{b}")


@pytest.mark.parametrize("plan", [fill_middle.Plan(), fill_middle.Plan(11, 60, 30, ("[[é]", "[[S]", "[[M]"))])
def test_fill_in_middle_by_hand_and_back(spark, plan):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a\n", "bé\n", "\n", "漢字", " x", "\r\n", "<", "<P", "S>", ">"]) for _ in range(rng.randrange(25))) for _ in range(300)]
    rows = [*ODD, *enumerate([*texts, "a<P>b\n", "<S>", "x\n<M>\n", "[[é]", "line\n" * 5000, "<\n" * 9, "no newline"], 100)]
    docs = table(spark, rows).withColumns({c: F.lit(1) for c in ("form", "output", "n", "_form", "_output")})
    made = fill_middle.fill_in_middle(docs, plan)
    want = [by_hand(i, t, plan) for i, t in rows]
    assert Counter(tuple(r)[:6] for r in made.collect()) == Counter(want)
    back = fill_middle.restore(made, plan).collect()
    assert Counter((r["doc_id"], r["text"], r["restored_sha256"]) for r in back) == Counter((i, t or "", sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert all(r["output_sha256"] == sha256(r["output"].encode()).hexdigest() for r in back)
    assert {r["form"] for r in back} == {"plain", "psm", "spm"}
    digests = fill_middle.fill_in_middle_digests(docs, plan)
    assert digests.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"] and digests.count() == len(rows)
    assert fill_middle.fill_in_middle_digests(docs.limit(0), plan).count() == 0


def test_piece_tables_split_permute_and_read():
    table_ = fill_middle.PieceTable.of(memoryview(b"abcdef"), memoryview(b""))
    for k in (4, 1, 6, 0):
        table_.cut(k)
    assert table_.read() == b"abcdef" and sorted(p[2] for p in table_.pieces) == [0, 0, 1, 2, 3]
    assert table_.arranged((4, 3, 2, 1, 0)).digest() == sha256(table_.arranged((4, 3, 2, 1, 0)).read()).hexdigest()
    with pytest.raises(ValueError):
        table_.cut(7)


# Spelling variants


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def variants_by_hand(n: dict[str, int], ratio: int = 5):
    out = {}
    for w in n:
        others = [o for o in n if o != w and near(w, o)]
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form = best if best and n[best] >= ratio * n[w] else None
        out[w] = (form, n[w], len(others), n[form] if form else None)
    roots = {}
    for w in n:
        r = w
        while out[r][0]:
            r = out[r][0]
        roots[w] = r
    return {w: (f, roots[w], c, k, fn) for w, (f, c, k, fn) in out.items()}


def words_of(rows, every=199, low=6, least=5):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= low and k >= least}


def test_acceptor_is_minimal_and_finds_each_pair_once():
    rng = random.Random(2)
    for size in (0, 1, 5, 60, 300):
        ws = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(1, 9))) for _ in range(size)})
        acceptor = spelling.Acceptor(ws)
        got = Counter(tuple(sorted(p)) for p in acceptor.near(None))
        assert got == Counter({(a, b): 1 for a in ws for b in ws if a < b and near(a, b)})
        states = {(f, *k.items()) for f, k in zip(acceptor.final, acceptor.kids)}
        assert len(states) == len(acceptor.kids)


@pytest.mark.parametrize("most", [4000, 40, 2])
def test_near_words_are_whole_whatever_the_partitions(spark, most):
    rng = random.Random(7)
    ws = {"".join(rng.choice("ab") for _ in range(rng.randrange(6, 11))) for _ in range(500)}  # crowded
    ws |= {"prefix" + "".join(rng.choice("abcd") for _ in range(4)) for _ in range(150)} | {"".join(rng.choice("abcd") for _ in range(4)) + "suffix" for _ in range(150)}
    ws |= {"abcdef" + c for c in "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿ"} | {"abcdef", "x" * 3000, "x" * 2999, "x" * 2998 + "y"}
    n = {w: rng.choice([5, 6, 30, 200, 5000]) for w in sorted(ws)}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    got = {r["word"]: (r["n"], r["n_near"], r["best"], r["best_n"]) for r in spelling.near_words(words, most=most).collect()}
    want = {}
    for w in n:
        others = [o for o in n if o != w and abs(len(o) - len(w)) < 2 and near(w, o)]
        best = min(others, key=lambda o: (-n[o], o), default=None)
        want[w] = (n[w], len(others), best, n.get(best))
    assert got == want


def test_spelling_variants_by_hand(spark):
    rng = random.Random(9)
    base = ["building", "readers", "collection", "façadé", "Straßen", "NATURAL", "naturel", "ordinary", "ordinarily", "weather", "whether", "aaaaaaa", "aaaaaa"]
    rows = []
    for i in range(400):
        ws = [w if rng.random() < 0.8 else (w[:k] + rng.choice("eiou") + w[k + rng.randrange(2) :]) for w in rng.choices(base, [60, 9, 30, 8, 20, 40, 7, 9, 9, 30, 6, 9, 30], k=12) for k in [rng.randrange(len(w))]]
        rows.append((i, rng.choice([" ", "-", "1", "\n"]).join(ws)))
    rows += [*ODD, (None, "collectiom " * 47), (900, "collectiomm " * 5), (None, None)]
    docs = table(spark, rows).withColumns({c: F.lit(1) for c in ("word", "n", "key", "left", "best")})
    for every in (199, 3):
        want = variants_by_hand(words_of(rows, every))
        got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.spelling_variants(docs, every=every).collect()}
        assert got == want
        assert every == 3 or got["collectiomm"][:2] == ("collectiom", "collection")
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


def test_chains_of_forms_end_at_their_roots(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(13)] + [("x", "w5")], "word string, form string")
    assert {r["word"]: r["root"] for r in spelling._roots(forms).collect()} == {"x": "w13"} | {f"w{i}": "w13" for i in range(13)}


@pytest.mark.parametrize("name", ["op12_fill_in_middle", "op13_spelling"])
def test_queries_give_the_sqls_rows(spark, sf_dir, name):
    assert oracle.compare(spark, QUERIES[name], ORACLE_SQL[name], sf_dir) == ""
