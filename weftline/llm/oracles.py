"""DuckDB SQL for the registered queries that SQL can express.

SQL has no XXH64, min-wise or piece-merging functions, no models and no HTML parser, so the other queries are held
against brute force in the tests.
"""

from __future__ import annotations

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Words of a text: what is between runs of other characters than ASCII letters and digits and non-ASCII ones.
_WORDS = "list_filter(regexp_split_to_array(" + _LOWER + ", '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"

OP8 = f"""WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
win AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(8, len(w)) AS n, unnest([array_to_string(w[i:i + least(8, len(w)) - 1], ' ') FOR i IN range(1, len(w) - least(8, len(w)) + 2)]) AS t FROM b WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, unnest([{{'p': i, 't': array_to_string(w[i:i + n - 1], ' ')}} FOR i IN range(1, len(w) - n + 2)]) AS x FROM d, lens WHERE len(w) >= n),
hit AS (SELECT doc_id, dw.n, x.p AS p, item FROM dw JOIN win ON dw.n = win.n AND x.t = win.t),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id"""

_DIGITS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
#: Ten hexadecimal digits, forty bits, as eight base-32 digits.
_PART = "array_to_string([substr(" + _DIGITS + ", CAST((x // (1 << (35 - 5 * i))) % 32 AS INTEGER) + 1, 1) FOR i IN range(0, 8)], '')"

OP6 = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), s AS (SELECT page_id, h, sha1(h) AS hex, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, strlen(h) AS payload_bytes, array_to_string([{_PART} FOR x IN [CAST('0x' || substr(hex, 1 + 10 * k, 10) AS BIGINT) FOR k IN range(0, 4)]], '') AS payload_digest,
CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM s"""

_SPLIT = "list_filter(regexp_split_to_array({0}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

OP5 = f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, {_SPLIT.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, unnest([{{'p': i, 't': array_to_string(w[i:i + 4], ' ')}} FOR i IN range(1, len(w) - 3)]) AS x FROM d WHERE len(w) >= 5),
r AS (SELECT doc_id, x.p AS p, count(*) OVER (PARTITION BY doc_id, x.t) AS c FROM g),
rep AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT DISTINCT doc_id, unnest(range(p, p + 5)) AS q FROM r WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS line FROM d),
ln AS (SELECT doc_id, source, line, {_SPLIT.format("regexp_replace(" + _LOWER.format("line") + ", '[0-9]', '0', 'g')")} AS lw FROM l),
lw AS (SELECT doc_id, source, line, array_to_string(lw, ' ') AS nl, len(lw) AS n FROM ln WHERE len(lw) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lw GROUP BY doc_id),
dl AS (SELECT doc_id, source, nl, sum(n) AS words FROM lw GROUP BY doc_id, source, nl),
bad AS (SELECT source, nl FROM dl JOIN d USING (doc_id, source) GROUP BY source, nl HAVING count(DISTINCT t) > 20),
lost AS (SELECT doc_id, sum(words) AS n FROM dl JOIN bad USING (source, nl) GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum([length(x) FOR x IN w]), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS removed_words
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN lost USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND n_words - removed_words >= 5 AND n_words - removed_words >= 0.3 * n_words AS kept FROM f"""



def _half(x: int) -> int:
    for _ in range(4):
        x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
    return x


#: The CRC-32 of each half byte, and one step of a CRC over a byte.
_HALVES = str([_half(x) for x in range(16)])
_HALF = "xor(({0}) >> 4, " + _HALVES + "[(({0}) & 15) + 1])"
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || substr(x, 2 * i + 1, 2))::BIGINT FOR i IN range(0, len(x) // 2)]), lambda c, b: " + _HALF.format(_HALF.format("xor(c, b)")) + "), 4294967295::BIGINT)"

OP12 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
df AS (SELECT r, unnest(flatten([[array_to_string(w[i:i + k], ' ') FOR i IN range(1, len(w) - k + 1)] FOR k IN range(0, 3)])) AS f FROM d),
bf AS (SELECT unnest(flatten([[array_to_string(w[i:i + k], ' ') FOR i IN range(1, len(w) - k + 1)] FOR k IN range(0, 3)])) AS f FROM b),
fx AS (SELECT f, hex(f) AS x FROM (SELECT f FROM df UNION SELECT f FROM bf)),
k AS MATERIALIZED (SELECT f, {_CRC} % 10000 AS bucket FROM fx),
dk AS MATERIALIZED (SELECT r, bucket, count(*) AS n FROM df JOIN k USING (f) GROUP BY r, bucket),
s AS (SELECT bucket, sum(n) AS s FROM dk GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM bf JOIN k USING (f) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket)),
wt AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM dk JOIN g USING (bucket) GROUP BY r),
h AS (SELECT r, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN wt USING (r)),
sc AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM h),
rk AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS place, 5 * count(*) OVER () // 100 AS drawn FROM sc WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CAST(CASE WHEN place <= drawn THEN place END AS BIGINT) AS rank FROM sc LEFT JOIN rk USING (r)"""


def _rounds(n: int) -> str:
    """CTEs of the clusters: a0 to an assign vectors to the centroids c0 to cn, each the floors of the means before."""
    out = []
    for i in range(n + 1):
        out.append(f"p{i} AS MATERIALIZED (SELECT r, c, list_sum([(x[j] - y[j]) * (x[j] - y[j]) FOR j IN range(1, 65)])::BIGINT AS d FROM v, c{i}), a{i} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM p{i} GROUP BY r)")
        if i < n:
            out.append(f"m{i} AS (SELECT c, j, sum(x[j]) AS s, count(*)::HUGEINT AS k FROM a{i} JOIN v USING (r), range(1, 65) AS u(j) GROUP BY c, j), n{i} AS (SELECT c, list(CAST((s - ((s % k) + k) % k) // k AS BIGINT) ORDER BY j) AS y FROM m{i} GROUP BY c), c{i + 1} AS MATERIALIZED (SELECT c, coalesce(n{i}.y, c{i}.y) AS y FROM c{i} LEFT JOIN n{i} USING (c))")
    return ",\n".join(out)


OP13 = f"""WITH e AS (SELECT row_number() OVER () AS r, vec_id, embedding AS q FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z) OR abs(z) > 2097152)) = 0),
v AS MATERIALIZED (SELECT r, vec_id, [CAST(floor(64 * z::DOUBLE) AS BIGINT) FOR z IN q] AS x FROM e),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) - 1 AS c, x AS y FROM v ORDER BY c LIMIT 16),
{_rounds(3)},
i AS (SELECT c, CAST(sum(d) AS BIGINT) AS s FROM a3 GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, i.s AS cluster_inertia, CAST((SELECT sum(s) FROM i) AS BIGINT) AS inertia, sha256(array_to_string(y, ',')) AS centroid_sha256
FROM a3 JOIN v USING (r) JOIN i USING (c) JOIN c3 USING (c)"""

ORACLES: dict[str, str] = {"op5_line_rules": OP5, "op6_warc": OP6, "op8_winnowing": OP8, "op12_importance": OP12, "op13_centroids": OP13}
