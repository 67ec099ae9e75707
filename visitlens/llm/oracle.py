"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op2_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER own AS keep_id, count(*) OVER own AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER own AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW own AS (PARTITION BY coalesce(text, ''))
"""


def _time(share: str, knots: list[tuple[float, float]]) -> str:
    """Where the integral of a line through knots reaches a share of its whole."""
    whole = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))
    cases, begin = "", 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        end = begin + (t1 - t0) * (w0 + w1) / 2
        rest = f"greatest({share} * {whole}::DOUBLE - {begin}::DOUBLE, 0::DOUBLE)"
        root = f"({w0}::DOUBLE + sqrt(greatest({w0 * w0}::DOUBLE + {rest} * {2 * (w1 - w0) / (t1 - t0)}::DOUBLE, 0::DOUBLE)))"
        cases += f" WHEN {share} * {whole}::DOUBLE < {end}::DOUBLE THEN {t0}::DOUBLE + least(2 * {rest} / {root}, {t1 - t0}::DOUBLE)"
        begin = end
    return f"CASE{cases} ELSE {knots[-1][0]}::DOUBLE END"


# The schedules of the query.
_KNOTS = ([(0.0, 1.0), (1.0, 1.0)], [(0.0, 0.5), (1.0, 1.5)], [(0.0, 1.5), (0.5, 1.0), (1.0, 0.5)])
_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"

ORACLES["op3_curriculum"] = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
  FROM documents
),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::DOUBLE AS weight, 3 * source_size AS cap FROM p),
l AS (SELECT *, cap / weight AS level FROM w),
f AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY level, place {_BEFORE}), 0) AS full_before, sum(source_size) OVER () AS words,
    sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY level, place {_BEFORE}), 0) AS weight_left
  FROM l
),
g AS (SELECT *, level <= (words - full_before) / weight_left AS filled FROM f),
h AS (
  SELECT *, words - sum(CASE WHEN filled THEN cap ELSE 0 END) OVER () AS rest,
    sum(CASE WHEN filled THEN 0::DOUBLE ELSE weight END) OVER () AS shared
  FROM g
),
t AS (SELECT source, source_size, place, CASE WHEN filled THEN cap::DOUBLE ELSE weight * (rest / shared) END AS target FROM h),
m AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.place, 2 * coalesce(sum(d.size) OVER (
      PARTITION BY d.source ORDER BY d.digest, d.doc_id, d.size {_BEFORE}), 0) + d.size AS middle
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
),
c AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE (middle <= 2 * target)::INT + (middle + 2 * source_size <= 2 * target)::INT
      + (middle + 4 * source_size <= 2 * target)::INT END AS copies, middle / (2 * target) AS share
  FROM m
)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS INT) AS copies,
  CASE WHEN copies > 0 THEN CASE place % 3 WHEN 0 THEN {_time('share', _KNOTS[0])} WHEN 1 THEN {_time('share', _KNOTS[1])}
    ELSE {_time('share', _KNOTS[2])} END END AS position
FROM c
"""

ORACLES["op13_divergence"] = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found, row_number() OVER () AS row_no
  FROM documents
),
w AS (SELECT lang, source, row_no, unnest(found) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT row_no) >= 30),
l AS (SELECT lang, count(*) AS kept, sum(lang_n) AS lang_all FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (
  SELECT s.lang, s.source, coalesce(l.kept, 0) AS kept, l.lang_all, coalesce(sum(c.n), 0) AS all_n
  FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN l USING (lang) LEFT JOIN c USING (lang, source) GROUP BY ALL
),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.all_n + 5 * g.kept) AS p,
    1 + (1000000000::HUGEINT * (k.lang_n + 5)) // (g.lang_all + 5 * g.kept) AS q
  FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
    coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term
      WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM o WHERE part = 'pair' OR rank <= 50
"""

ORACLES["op12_prefix_trie"] = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      md5(concat(octet_length(encode(coalesce(role, ''))), ':', coalesce(role, ''), coalesce(text, '')))) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL
),
h AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(
      list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda x, i: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
),
b AS (
  SELECT h.conv_id, 0 AS own, t.place, t.role, t.text FROM h JOIN t ON t.conv_id = h.base WHERE t.place < h.h
  UNION ALL
  SELECT h.conv_id, 1, t.place, t.role, t.text FROM h JOIN t USING (conv_id) WHERE t.place >= h.h
),
p AS (SELECT conv_id, text, row_number() OVER o AS depth, list({'r': role, 't': text}) OVER o AS path FROM b WINDOW o AS (PARTITION BY conv_id ORDER BY own, place)),
q AS (
  SELECT conv_id, depth, length(text) AS chars, path FROM p
  UNION ALL
  SELECT conv_id, 0, 0, CAST([] AS STRUCT(r VARCHAR, t VARCHAR)[]) FROM h
),
l AS (SELECT conv_id, max(depth) AS ends FROM q GROUP BY conv_id),
n AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM q GROUP BY depth, path),
c AS (SELECT n.conv_id, n.depth, n.n_convs, n.chars, n.path, o.conv_id AS parent_conv_id FROM n
  LEFT JOIN q ON q.conv_id = n.conv_id AND q.depth = n.depth - 1 LEFT JOIN n o ON o.depth = q.depth AND o.path = q.path),
k AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM c WHERE depth > 0 GROUP BY ALL),
d AS (SELECT c.*, coalesce(k.n_children, 0) AS n_children FROM c LEFT JOIN k USING (conv_id, depth)),
s AS (
  SELECT q.depth, q.path, count(*) FILTER (d.n_children = 0) AS n_leaves, sum((d.n_convs - 1) * d.chars) AS saved_tokens
  FROM d JOIN q ON q.conv_id = d.conv_id AND q.depth <= d.depth GROUP BY q.depth, q.path
),
e AS (SELECT q.depth, q.path, string_agg(q.conv_id, ',' ORDER BY q.conv_id) AS ids FROM q JOIN l ON l.conv_id = q.conv_id AND l.ends = q.depth GROUP BY q.depth, q.path)
SELECT d.conv_id, CAST(d.depth AS BIGINT) AS depth, d.parent_conv_id, d.n_convs, d.n_children, s.n_leaves,
  CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM d JOIN s ON s.depth = d.depth AND s.path = d.path LEFT JOIN e ON e.depth = d.depth AND e.path = d.path
"""

ORACLES["op11_earlier_passages"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM d),
s AS (SELECT doc_id, words, unnest(generate_series(1, len(words) - 19)) AS place FROM d WHERE len(words) >= 20),
r AS (
  SELECT doc_id, place, row_number() OVER (PARTITION BY array_to_string(words[place : place + 19], ' ') ORDER BY doc_id, place) > 1 AS again FROM s
),
c AS (
  SELECT w.doc_id, w.word, w.place,
    coalesce(bool_or(r.again) OVER (PARTITION BY w.doc_id ORDER BY w.place ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone
  FROM w LEFT JOIN r ON r.doc_id = w.doc_id AND r.place = w.place
),
k AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY place) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
