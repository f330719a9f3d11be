"""DuckDB SQL of the corpus queries that SQL can express, from the operators' definitions and not their methods."""

from __future__ import annotations

from .licenses import PHRASES, TEMPLATES

_WORDS = r"'[0-9a-z\x{80}-\x{10FFFF}]+'"


def _shingled(name: str, table: str, key: str, sizes: str) -> str:
    """CTEs up to ``name``: (key, n, s) of the different n-word shingles of a table's texts, n from ``sizes``."""
    return f"""{name} AS (SELECT DISTINCT {key}, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS s FROM {table}_w, {sizes} WHERE len(w) >= n)"""


def _worded(table: str, key: str) -> str:
    return f"{table}_w AS (SELECT {key}, regexp_extract_all(lower(text), {_WORDS}) AS w FROM {table} WHERE text IS NOT NULL AND {key} IS NOT NULL)"


DECONTAMINATION = f"""WITH {_worded("documents", "doc_id")}, {_worded("benchmark", "item_id")}, sizes AS (SELECT DISTINCT least(5, len(w)) AS n FROM benchmark_w WHERE len(w) > 0),
{_shingled("ds", "documents", "doc_id", "sizes")}, {_shingled("all_qs", "benchmark", "item_id", "sizes")}, qs AS (SELECT q.* FROM all_qs q JOIN benchmark_w b ON q.item_id = b.item_id AND q.n = least(5, len(b.w))),
size AS (SELECT item_id, count(*) AS m FROM qs GROUP BY item_id)
SELECT doc_id, item_id, any_value(m) AS n_item_shingles, count(*) AS n_shared, count(*) / any_value(m) AS containment
FROM qs JOIN ds USING (n, s) JOIN size USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(m) - 1e-9"""

#: CRC-32 byte by byte: the table of the 256 remainders, then a fold over the text's bytes.
_CRC = """remainders AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i::UBIGINT], list_transform(range(8), lambda k: 0::UBIGINT)),
  lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v FROM range(256) r(i)))"""

SHARDS = f"""WITH {_CRC}, bytes AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::UBIGINT) AS b FROM documents),
summed AS (SELECT doc_id, size, CAST(xor(list_reduce(list_concat([4294967295::UBIGINT], b), lambda c, x: xor(c >> 8, t[xor(c, x) & 255 + 1])), 4294967295::UBIGINT) AS BIGINT) AS text_crc32 FROM bytes, remainders),
placed AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM summed),
cut AS (SELECT *, CAST(least(15, (2 * upto - size) * 16 // (2 * total)) AS INT) AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY upto) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM cut"""
SHARDS = SHARDS.replace("t[xor(c, x) & 255 + 1]", "t[CAST((xor(c, x) & 255) + 1 AS BIGINT)]")

VECTORS = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL),
ok AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reached AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
component AS (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a), counts AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM component LEFT JOIN counts USING (vec_id)"""

_TOLD = ", ".join(f"('{name}', string_split('{text}', ' '))" for name, text in TEMPLATES.items())
_SAID = ", ".join(f"('{label}', string_split('{phrase}', ' '))" for phrase, label in PHRASES.items())
_UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

LICENSES = f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_UP.lower()}'), {_WORDS}) AS w FROM documents),
said(label, p) AS (VALUES {_SAID}), told(name, t) AS (VALUES {_TOLD}),
place AS (SELECT row, w, unnest(range(1, len(w) + 1)) AS i FROM d),
base AS (SELECT row, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels, list(DISTINCT label) AS bl
  FROM place JOIN said ON w[i] = p[1] AND w[i:i + len(p) - 1] = p GROUP BY row),
tk AS (SELECT name, len(t) AS tlen, j - 1 AS tpos, array_to_string(t[j:j + 2], ' ') AS g FROM (SELECT name, t, unnest(range(1, len(t) - 1)) AS j FROM told)),
dk AS (SELECT row, i - 1 AS pos, array_to_string(w[i:i + 2], ' ') AS g FROM place WHERE i <= len(w) - 2),
votes AS MATERIALIZED (SELECT row, name, tlen, pos, tpos, pos - tpos AS diagonal FROM dk JOIN tk USING (g)),
steps AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY row, name ORDER BY diagonal) > 3 THEN 1 ELSE 0 END AS gap FROM (SELECT DISTINCT row, name, diagonal FROM votes)),
spans AS (SELECT row, name, diagonal, sum(gap) OVER (PARTITION BY row, name ORDER BY diagonal) AS span FROM steps),
covered AS (SELECT row, name, span, any_value(tlen) AS tlen, count(DISTINCT word) AS matched, min(pos) AS first, max(pos) + 2 AS last
  FROM (SELECT *, unnest([tpos, tpos + 1, tpos + 2]) AS word FROM votes JOIN spans USING (row, name, diagonal)) GROUP BY row, name, span),
good AS MATERIALIZED (SELECT row, split_part(name, '/', 1) AS label, first, last, matched, matched / tlen AS cover FROM covered WHERE matched / tlen >= 0.7 AND last - first < tlen + 6),
best AS (SELECT * FROM good a WHERE NOT EXISTS (SELECT 1 FROM good b WHERE b.row = a.row AND b.label <> a.label AND b.matched > a.matched AND 2 * (least(a.last, b.last) - greatest(a.first, b.first) + 1) > a.last - a.first + 1)),
more AS (SELECT row, list(DISTINCT label) AS ml, max(cover) AS cover FROM best GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(bl, []), coalesce(ml, [])))), ',') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(cover, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN base USING (row) LEFT JOIN more USING (row)"""

FILL_IN_MIDDLE = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS s FROM documents),
h AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS l, ('0x' || s[1:8])::UBIGINT AS h1, ('0x' || s[9:16])::UBIGINT AS h2, ('0x' || s[17:24])::UBIGINT AS h3, ('0x' || s[25:32])::UBIGINT AS h4 FROM d),
c AS (SELECT *, CAST(least(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS BIGINT) AS a, CAST(greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS BIGINT) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(l[1:a], '') AS prefix, array_to_string(l[a + 1:b], '') AS middle, array_to_string(l[b + 1:], '') AS suffix FROM c)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p"""

SPELLING = f"""WITH RECURSIVE {_CRC}, runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UP}', '{_UP.lower()}'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents WHERE text IS NOT NULL),
each_run AS (SELECT doc_id, run, count(*) AS k, list_transform(regexp_extract_all(hex(encode(doc_id || ':' || run)), '..'), lambda h: ('0x' || h)::UBIGINT) AS b FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run),
hashed AS (SELECT run, k, CAST(xor(list_reduce(list_concat([4294967295::UBIGINT], b), lambda c, x: xor(c >> 8, t[CAST((xor(c, x) & 255) + 1 AS BIGINT)])), 4294967295::UBIGINT) AS BIGINT) AS h FROM each_run, remainders),
spelt AS (SELECT CASE WHEN h % 199 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, k FROM hashed),
v AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
cuts AS MATERIALIZED (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS MATERIALIZED (SELECT DISTINCT a, b, nb FROM (SELECT c.word AS a, v.word AS b, v.n AS nb FROM cuts c JOIN v ON c.rest = v.word UNION ALL SELECT v.word, c.word, c.n FROM cuts c JOIN v ON c.rest = v.word
  UNION ALL SELECT x.word, y.word, y.n FROM cuts x JOIN cuts y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word)),
best AS (SELECT a AS word, count(*) AS n_near, arg_min(b, {{'n': -nb, 'w': encode(b)}}) AS b, max(nb) AS nb FROM near GROUP BY a),
forms AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN nb >= 5 * n THEN b END AS form, CASE WHEN nb >= 5 * n THEN nb END AS form_n FROM v LEFT JOIN best USING (word)),
up AS (SELECT word, word AS root, form FROM forms UNION ALL SELECT u.word, f.word, f.form FROM up u JOIN forms f ON u.form = f.word)
SELECT f.word, f.form, u.root, f.n, f.n_near, f.form_n FROM forms f JOIN up u ON u.word = f.word AND u.form IS NULL"""
