"""License phrases and texts in documents: exact phrases, and templates by diagonal voting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, words

#: Phrase -> label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Well-known license notices by "label/part"; a document that has one part has the label.
TEMPLATES = {
    "mit/opening": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit/grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"
    ),
    "mit/warranty": (
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
        "merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any "
        "claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software "
        "or the use or other dealings in the software"
    ),
    "apache/opening": "licensed under the apache license version 2 0",
    "apache/header": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a "
        "copy of the license at"
    ),
    "apache/warranty": (
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without "
        "warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and "
        "limitations under the license"
    ),
    "gpl/opening": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "gpl/notice": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by "
        "the free software foundation either version 3 of the license or at your option any later version"
    ),
    "gpl/warranty": (
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
        "merchantability or fitness for a particular purpose see the gnu general public license for more details"
    ),
    "lgpl/notice": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as "
        "published by the free software foundation either version 2 1 of the license or at your option any later version"
    ),
    "agpl/notice": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as "
        "published by the free software foundation either version 3 of the license or at your option any later version"
    ),
    "bsd/opening": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd/conditions": (
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions "
        "in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or "
        "other materials provided with the distribution"
    ),
    "bsd/endorsement": (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission"
    ),
    "bsd/warranty": (
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited "
        "to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or "
        "contributors be liable for any direct indirect incidental special exemplary or consequential damages"
    ),
    "isc/grant": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the "
        "above copyright notice and this permission notice appear in all copies"
    ),
    "isc/opening": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mpl/notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl/copy": "if a copy of the mpl was not distributed with this file you can obtain one at",
    "unlicense/notice": "this is free and unencumbered software released into the public domain",
    "cc-by/deed": "this work is licensed under the creative commons attribution 4 0 international license",
    "cc-by-sa/deed": "this work is licensed under the creative commons attribution sharealike 4 0 international license",
    "cc-by-nc/deed": "this work is licensed under the creative commons attribution noncommercial 4 0 international license",
    "cc-by-nd/deed": "this work is licensed under the creative commons attribution noderivatives 4 0 international license",
    "cc-by/short": "licensed under cc by 4 0",
    "cc-by-nc/short": "licensed under cc by nc 4 0",
    "cc-by-sa/short": "licensed under cc by sa 4 0",
    "cc0/waiver": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "proprietary/notice": "all rights reserved no part of this document may be reproduced without written permission",
}


def _scanned(docs: DataFrame, templates: dict[str, str], phrases: dict[str, str], k: int) -> tuple[DataFrame, DataFrame]:
    """Documents (row, doc_id, n_words, n_base, first_word, last_word, base_labels, hits) and template positions (h, name, tpos, tlen).

    hits: position and key of every run of ``k`` words that templates or phrases use.
    """
    told = {name: words(t) for name, t in templates.items()}
    said = [(p.encode().split(), label) for p, label in phrases.items()]
    number = {w: i + 1 for i, w in enumerate(sorted({w for ws in told.values() for w in ws} | {w for ws, _ in said for w in ws}))}
    base = len(number) + 1
    if base**k >= 1 << 62:
        raise ValueError("too many template words for keys of k words")

    def keys(ids: np.ndarray) -> np.ndarray:
        n = len(ids) - k + 1
        if n <= 0:
            return np.empty(0, np.int64)
        out, ok = np.zeros(n, np.int64), np.ones(n, bool)
        for i in range(k):
            out = out * base + ids[i : i + n]
            ok &= ids[i : i + n] > 0
        return np.where(ok, out, -1)

    positions = []
    for name, ws in told.items():
        own = keys(np.array([number[w] for w in ws], np.int64))
        positions += [(int(h), name, i, len(ws)) for i, h in enumerate(own)]
    runs = [(np.array([number[w] for w in ws]), label) for ws, label in said]

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, hits array<struct<pos:int,h:long>>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
        cut = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
        get = number.get
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            at_hits, key_hits, ends = [np.empty(0, np.int32)], [np.empty(0, np.int64)], [0]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ws = (text.as_py() or "").encode("utf-8", "replace").translate(lower).translate(cut).split()
                ids = np.fromiter((get(w, 0) for w in ws), np.int64, len(ws))
                places, labels = [], set()
                known = np.flatnonzero(ids)
                if len(known):
                    for run, label in runs:
                        start = known[ids[known] == run[0]]
                        start = start[start <= len(ids) - len(run)]
                        for i in range(1, len(run)):
                            start = start[ids[start + i] == run[i]]
                        if len(start):
                            labels.add(label)
                            places.append(start)
                at = np.sort(np.concatenate(places)) if places else np.empty(0, int)
                h = keys(ids) if len(known) >= k else np.empty(0, np.int64)
                hit = np.flatnonzero(h >= 0)
                at_hits.append(hit.astype(np.int32))
                key_hits.append(h[hit])
                ends.append(ends[-1] + len(hit))
                row = (doc, len(ws), len(at), int(at[0]) if len(at) else None, int(at[-1]) if len(at) else None, sorted(labels))
                for c, v in zip(out, row):
                    c.append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())]
            hits = pa.StructArray.from_arrays([pa.array(np.concatenate(at_hits)), pa.array(np.concatenate(key_hits))], names=["pos", "h"])
            cols = [*(pa.array(c, t) for c, t in zip(out, types)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), hits)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "hits"])

    scanned = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, schema)
    scanned = checkpoint(scanned.withColumn("row", F.monotonically_increasing_id()))
    return scanned, docs.sparkSession.createDataFrame(positions, "h long, name string, tpos int, tlen int")


def _spans(scanned: DataFrame, table: DataFrame, k: int, drift: int, cover: float) -> DataFrame:
    """(row, name, label, first, last, matched, cover) of the spans that diagonal voting finds."""
    votes = (
        scanned.where(F.size("hits") > 0)
        .select("row", F.inline("hits"))
        .join(F.broadcast(table), "h")  # the templates' positions, fixed by the parameter
        .withColumn("diagonal", F.col("pos") - F.col("tpos"))
    )
    lines = votes.groupBy("row", "name", "diagonal").agg(
        F.first("tlen").alias("tlen"), F.collect_set("tpos").alias("seen"), F.min("pos").alias("lo"), F.max("pos").alias("hi")
    )  # a diagonal has at most one vote a template position
    near = Window.partitionBy("row", "name").orderBy("diagonal")
    gap = (F.col("diagonal") - F.lag("diagonal").over(near) > drift).cast("int")
    lines = lines.withColumn("span", F.sum(F.coalesce(gap, F.lit(0))).over(near.rowsBetween(Window.unboundedPreceding, 0)))
    spans = lines.groupBy("row", "name", "span").agg(
        F.first("tlen").alias("tlen"), F.array_distinct(F.flatten(F.collect_list("seen"))).alias("seen"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    matched = F.size(F.array_distinct(F.flatten(F.transform("seen", lambda p: F.sequence(p, p + F.lit(k - 1))))))
    spans = spans.select(
        "row", "name", F.substring_index("name", "/", 1).alias("label"), F.col("lo").alias("first"), (F.col("hi") + k - 1).alias("last"), "tlen", matched.alias("matched")
    ).withColumn("cover", F.col("matched") / F.col("tlen"))
    spans = spans.where((F.col("cover") >= cover) & (F.col("last") - F.col("first") < F.col("tlen") + 2 * drift)).drop("tlen")
    spans = checkpoint(spans)
    # Verify: a span of which another label explains more words is that label's.
    a, b = spans.alias("a"), spans.alias("b")
    shared = F.least("a.last", "b.last") - F.greatest("a.first", "b.first") + 1
    better = (F.col("a.row") == F.col("b.row")) & (F.col("a.label") != F.col("b.label")) & (F.col("b.matched") > F.col("a.matched"))
    return a.join(b, better & (2 * shared > F.col("a.last") - F.col("a.first") + 1), "left_anti")


def scan_licenses(
    docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, k: int = 3, drift: int = 3, cover: float = 0.7
) -> DataFrame:
    """License labels of every document.

    Lower-cases A-Z; words are runs of digits, letters and non-ASCII characters.
    Base: every place where a phrase's words stand consecutively. Templates: all
    rolling ``k``-word keys of a document are joined to the templates' positions,
    votes are summed by diagonal (document position - template position), the
    diagonals of a template within ``drift`` of the one before merge, and a merged
    span counts if its votes cover ``cover`` of the template's words in a stretch
    of the document not longer than the template plus ``drift`` words a side, and
    if no other label's span over more than half of it covers more words.

    Returns doc_id, n_words, n_base, first_word, last_word (of base places, else
    null), base_labels, labels (sorted, comma-joined, '' if none), score (best
    cover of a template, 1 with a base place). Null and empty texts have no words;
    repeated rows and null doc_ids each give a row. Only words of the templates
    can be part of a match, so other words are one symbol that matches nothing.
    """
    scanned, table = _scanned(docs, templates, phrases, k)
    found = _spans(scanned, table, k, drift, cover).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("cover").alias("cover"))
    none = F.array().cast("array<string>")
    return scanned.drop("hits").join(found, "row", "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_labels", F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("cover", F.lit(0.0))).alias("score"),
    )


def license_spans(docs: DataFrame, templates: dict[str, str] = TEMPLATES, k: int = 3, drift: int = 3, cover: float = 0.7) -> DataFrame:
    """(doc_id, name, label, first, last, matched, cover): where in a document each license notice stands, in words from 0."""
    scanned, table = _scanned(docs, templates, {}, k)
    return _spans(scanned, table, k, drift, cover).join(scanned.select("row", "doc_id"), "row").drop("row")
