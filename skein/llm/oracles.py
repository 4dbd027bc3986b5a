"""DuckDB SQL for the queries of the training-data operators that SQL can express.

Each compares whole tables; op7's and op3's joins and op4's are quadratic in the worst case, which
small tables bear.
"""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"
_LOW = "translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str) -> str:
    return f"regexp_extract_all({text}, '{_WORD}')"


OP1 = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (SELECT *, regexp_replace(replace(text, chr(92), chr(92) || chr(92)), '([<[])([|]im_start[|]>|[|]im_end[|]>|[|]endoftext[|]>|s>|/s>|<SYS>>|</SYS>>|INST[]]|/INST[]])', chr(92) || '1' || chr(92) || chr(92) || '_' || chr(92) || '2', 'g') AS safe FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>') + length(role) + 1 + length(safe) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""

OP3 = f"""
WITH RECURSIVE l AS (SELECT doc_id, generate_subscripts(ls, 1) AS line, unnest(ls) AS body FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
s AS MATERIALIZED (SELECT doc_id, line, body, list_sort(list_distinct({_words(_LOW.format(t='body'))})) AS w FROM l),
sets AS MATERIALIZED (SELECT w, len(w) AS n, min((doc_id, line)) AS f, row_number() OVER () AS id FROM s WHERE len(w) > 0 GROUP BY w),
tok AS MATERIALIZED (SELECT id, n, unnest(w) AS t FROM sets),
df AS (SELECT t, count(*) AS c FROM tok GROUP BY t),
ranked AS (SELECT id, n, tok.t, row_number() OVER (PARTITION BY id ORDER BY c, tok.t) AS p FROM tok JOIN df ON df.t = tok.t),
pre AS MATERIALIZED (SELECT id, n, t FROM ranked WHERE p <= n - (4 * n + 4) // 5 + 1),
cand AS MATERIALIZED (SELECT DISTINCT a.id AS x, b.id AS y FROM pre a JOIN pre b ON a.t = b.t AND a.id < b.id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
hit AS MATERIALIZED (SELECT a.f AS fa, b.f AS fb, a.id AS ia, b.id AS ib FROM (SELECT x, y, len(list_intersect(a.w, b.w)) AS shared FROM cand JOIN sets a ON a.id = x JOIN sets b ON b.id = y) JOIN sets a ON a.id = x JOIN sets b ON b.id = y WHERE 5 * shared >= 4 * (a.n + b.n - shared)),
late AS (SELECT DISTINCT CASE WHEN fa < fb THEN ib ELSE ia END AS id FROM hit),
judged AS (SELECT s.doc_id, s.line, s.body, len(s.w) > 0 AND (sets.f <> (s.doc_id, s.line) OR sets.id IN (SELECT id FROM late)) AS gone FROM s LEFT JOIN sets ON sets.w = s.w),
kept AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(body, chr(10) ORDER BY line) FILTER (WHERE NOT gone), '') AS body FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

_CLOSURE = """
reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
"""

OP4 = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
ok AS MATERIALIZED (SELECT vec_id, label, v, len(v) AS n, list_reduce(list_transform(v, lambda x: abs(x)), lambda a, b: greatest(a, b)) AS top FROM v
  WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
unit AS MATERIALIZED (SELECT vec_id, label, n, list_transform(v, lambda x: x / top) AS v FROM ok WHERE top > 0),
normed AS MATERIALIZED (SELECT vec_id, label, n, v, sqrt(list_dot_product(v, v)) AS len FROM unit),
link AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM normed x JOIN normed y ON x.label = y.label AND x.n = y.n AND x.vec_id <> y.vec_id WHERE list_dot_product(x.v, y.v) / (x.len * y.len) >= 0.93),
low(id, root) AS (SELECT a, least(a, min(b)) FROM link GROUP BY a),
""" + "\n".join(
    f"r{i} AS MATERIALIZED (SELECT l.id, least(min(p.root), min(l.root)) AS root FROM {'low' if i == 0 else f'r{i - 1}'} l JOIN link ON link.a = l.id JOIN {'low' if i == 0 else f'r{i - 1}'} p ON p.id = link.b GROUP BY l.id),"
    for i in range(24)
) + """
n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(root, e.vec_id) AS component_id, coalesce(root, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN r23 ON r23.id = e.vec_id
"""

OP7 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_words(_LOW.format(t='text'))} AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
sets AS MATERIALIZED (SELECT s, len(s) AS n, min(doc_id) AS id FROM s WHERE len(s) > 0 GROUP BY s),
tok AS MATERIALIZED (SELECT id, n, unnest(s) AS t FROM sets),
df AS (SELECT t, count(*) AS c FROM tok GROUP BY t),
ranked AS (SELECT id, n, tok.t, row_number() OVER (PARTITION BY id ORDER BY c, tok.t) AS p FROM tok JOIN df ON df.t = tok.t),
pre AS MATERIALIZED (SELECT id, n, t FROM ranked WHERE p <= n - (85 * n + 99) // 100 + 1),
cand AS MATERIALIZED (SELECT DISTINCT a.id AS x, b.id AS y FROM pre a JOIN pre b ON a.t = b.t AND a.id < b.id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
near AS MATERIALIZED (SELECT x, y FROM (SELECT x, y, a.n + b.n AS n, len(list_intersect(a.s, b.s)) AS shared FROM cand JOIN sets a ON a.id = x JOIN sets b ON b.id = y) WHERE 100 * shared >= 85 * (n - shared)),
link AS MATERIALIZED (SELECT x AS a, y AS b FROM near UNION SELECT y, x FROM near),
{_CLOSURE.strip()},
root AS (SELECT a, least(a, min(b)) AS r FROM reach GROUP BY a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(r, sets.id, s.doc_id) AS component_id FROM s LEFT JOIN sets ON sets.s = s.s LEFT JOIN root ON root.a = sets.id
"""

OP8 = f"""
WITH w AS MATERIALIZED (SELECT doc_id, {_words("coalesce(text, '')")} AS w FROM documents),
win AS MATERIALIZED (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
first AS (SELECT t, min(doc_id) AS d FROM win GROUP BY t HAVING count(DISTINCT doc_id) > 1),
starts AS MATERIALIZED (SELECT win.doc_id, i FROM win JOIN first ON first.t = win.t AND win.doc_id > first.d),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM starts),
each AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS t FROM w),
kept AS (SELECT e.doc_id, string_agg(t, ' ' ORDER BY e.i) FILTER (WHERE g.i IS NULL) AS t, count(g.i) AS n FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i GROUP BY e.doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(kept.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

SQL = {"op1_chat_format": OP1, "op3_line_dedup": OP3, "op4_embedding_dedup": OP4, "op7_ngram_join": OP7, "op8_substring_dedup": OP8}
