"""DuckDB SQL with the results of the queries that SQL can express."""

WORD = r"[^\x20\x09-\x0D]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
base AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols FROM d),
wins AS (SELECT doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS c FROM wins) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, i + j AS p FROM again, range(3) r(j)) GROUP BY doc_id),
ls AS (SELECT doc_id, i, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(t, chr(10)) AS l FROM d))),
lw AS (SELECT doc_id, i, line, len(regexp_extract_all(line, '{WORD}')) AS n,
              row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS dup,
              len(list_filter(regexp_extract_all(line, '{WORD}'), lambda w: w IN ('|', '>', '/', '-', '·', '•', '»', '›'))) AS bare,
              len(regexp_extract_all(line, '[#*$%&|<>]')) AS sym,
              len(regexp_extract_all(line, '[A-Z]')) AS up, len(regexp_extract_all(line, '[a-z]')) AS lo,
              regexp_matches(line, '[.!?:;]([\x20\x09-\x0D]|$)') AS stop,
              regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                'all rights reserved|terms of|privacy policy|cookie|subscribe|sign up|log in|click here|read more|copyright|license|javascript') AS phrase
       FROM ls),
lf AS (SELECT doc_id, n, dup, dup OR (n >= 3 AND 4 * bare >= n) OR sym > 2 * n OR (up >= 10 AND up > lo) OR (n >= 20 AND NOT stop) OR (phrase AND n < 30) AS failed FROM lw WHERE n > 0),
la AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dup) AS n_dup_lines, count(*) FILTER (failed) AS n_failed_lines,
              coalesce(sum(n) FILTER (failed), 0)::BIGINT AS lost_words FROM lf GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
       (n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words) AS base_failed,
       coalesce(n_lines, 0) AS n_lines, coalesce(n_failed_lines, 0) AS n_failed_lines, coalesce(lost_words, 0) AS lost_words,
       NOT (n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words) AND 2 * coalesce(lost_words, 0) <= n_words AS kept
FROM base LEFT JOIN rep USING (doc_id) LEFT JOIN la USING (doc_id)
"""

OP10 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '{WORD}') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)
  UNION SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
reach(id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT link.b, reach.r FROM reach JOIN link ON link.a = reach.id)
SELECT doc_id, coalesce(max(n), 0) AS n_shingles, min(r) AS component_id
FROM documents JOIN reach ON id = doc_id LEFT JOIN size USING (doc_id) GROUP BY doc_id
"""

OP7 = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(id, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT link.b, reach.r FROM reach JOIN link ON link.a = reach.id),
low AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN low ON id = vec_id LEFT JOIN n ON a = vec_id
"""


def _field(c: str) -> str:
    v = f"CAST({c} AS VARCHAR)"
    return f"coalesce(strlen({v}) || ':' || {v}, '-')"


#: The crc32 of decimal ids is computed bit by bit, as there is no such function.
OP11 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, lang, n_chars, text,
    list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ord(c)::BIGINT)),
      lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], range(8)), lambda a, step: xor(a >> 1, 3988292384 * (a & 1)))) AS inverse
  FROM documents),
l AS (
  SELECT doc_id, lang, sha256(concat({_field('doc_id')}, {_field('source')}, {_field('lang')}, {_field('n_chars')}, {_field('text')})) AS leaf,
    CASE WHEN xor(inverse, 4294967295) % 7 = 0 THEN sha256(concat({_field('doc_id')}, {_field('source')}, {_field('lang')}, {_field('n_chars + 1')}, {_field('text')})) END AS told
  FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM l),
t(lvl, lang, i, n, h) AS (
  SELECT 0, lang, i, n, leaf FROM p
  UNION ALL SELECT lvl + 1, lang, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY lvl, lang, i // 2, (n + 1) // 2),
s AS (SELECT lang, lvl AS depth, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u(lvl, i, n, h) AS (
  SELECT 0, i, n, subroot FROM s
  UNION ALL SELECT lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY lvl, i // 2, (n + 1) // 2),
root AS (SELECT lvl AS upper, h AS root FROM u WHERE n = 1),
a AS (SELECT row_number() OVER () AS k, p.doc_id, p.leaf, p.told, p.lang, p.i, s.subroot, s.depth, s.i AS j, root.root, root.upper FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang CROSS JOIN root),
step AS (
  SELECT k, x.lvl, (x.i >> x.lvl) & 1 AS side, sib.h FROM (SELECT k, i, lang, unnest(range(depth)) AS lvl FROM a) x
    LEFT JOIN t sib ON sib.lvl = x.lvl AND sib.lang IS NOT DISTINCT FROM x.lang AND sib.i = xor(x.i >> x.lvl, 1)
  UNION ALL SELECT k, depth + x.lv, (j >> x.lv) & 1, sib.h FROM (SELECT k, j, depth, unnest(range(upper)) AS lv FROM a) x
    LEFT JOIN u sib ON sib.lvl = x.lv AND sib.i = xor(x.j >> x.lv, 1)),
proof AS (SELECT k, sha256(coalesce(string_agg(h, '' ORDER BY lvl), '')) AS proof_sha256 FROM a LEFT JOIN step USING (k) GROUP BY k),
f(k, lvl, h) AS (
  SELECT k, 0, coalesce(told, leaf) FROM a
  UNION ALL SELECT f.k, f.lvl + 1, sha256(CASE WHEN side = 1 THEN concat(step.h, f.h) ELSE concat(f.h, step.h) END) FROM f JOIN step ON step.k = f.k AND step.lvl = f.lvl)
SELECT doc_id, leaf, subroot, root, proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM a JOIN proof USING (k) JOIN f ON f.k = a.k AND f.lvl = a.depth + a.upper
"""

ORACLES = {"op5_line_quality": OP5, "op7_pca_tiled_cosine": OP7, "op10_ngram_jaccard_groups": OP10, "op11_merkle_manifest": OP11}
