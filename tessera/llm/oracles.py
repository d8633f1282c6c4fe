"""DuckDB statements for the operators that SQL can express, over whole tables and texts."""

from __future__ import annotations

from tessera.llm import chat, licenses

#: Words of a text (nulls and wordless texts give none).
_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP3 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
     b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
     w AS (SELECT item_id, least(len(ws), 10) AS n, unnest(list_transform(range(1, len(ws) - least(len(ws), 10) + 2),
              lambda i: array_to_string(list_slice(ws, i, i + least(len(ws), 10) - 1), ' '))) AS g FROM b WHERE len(ws) > 0),
     wins AS (SELECT DISTINCT item_id, n, g FROM w),
     lens AS (SELECT DISTINCT n FROM wins),
     dw AS (SELECT r, n, unnest(range(1, len(ws) - n + 2)) AS i, ws FROM d, lens WHERE len(ws) >= n),
     dg AS (SELECT r, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS g FROM dw),
     hit AS (SELECT dg.r, dg.n, dg.i, wins.item_id FROM dg JOIN wins ON dg.n = wins.n AND dg.g = wins.g),
     words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
     items AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
               FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(words.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items.ids, '')) AS items_sha256,
       coalesce(words.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

_TEMPLATE_ROWS = ", ".join(
    f"({number}, '{t.label}', {str(t.base).lower()}, {t.words.split()!r})" for number, t in enumerate(licenses.TEMPLATES))

OP1 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
     t(template, label, base, tw) AS (VALUES {_TEMPLATE_ROWS}),
     tp AS (SELECT template, label, base, len(tw) - 1 AS pairs, unnest(range(0, len(tw) - 1)) AS place,
                   unnest(list_transform(range(1, len(tw)), lambda i: tw[i] || ' ' || tw[i + 1])) AS g FROM t),
     dp AS (SELECT r, unnest(range(0, len(ws) - 1)) AS place,
                   unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS g FROM d WHERE len(ws) > 1),
     votes AS (SELECT r, template, label, base, pairs, dp.place - tp.place AS diagonal, count(*) AS votes,
                      min(dp.place) AS low, max(dp.place) AS high
               FROM dp JOIN tp USING (g) GROUP BY r, template, label, base, pairs, dp.place - tp.place),
     marked AS (SELECT *, CASE WHEN base OR lag(diagonal) OVER o IS NULL OR diagonal - lag(diagonal) OVER o > {licenses.DRIFT} THEN 1 ELSE 0 END AS apart
                FROM votes WINDOW o AS (PARTITION BY r, template ORDER BY diagonal)),
     spans AS (SELECT r, template, label, base, pairs, span, least(1.0, CAST(sum(votes) AS DOUBLE) / pairs) AS coverage,
                      max(votes) = pairs AS exact, min(low) AS start, max(high) + 2 - min(low) AS n_span
               FROM (SELECT *, sum(apart) OVER (PARTITION BY r, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS span FROM marked)
               GROUP BY r, template, label, base, pairs, span),
     judged AS (SELECT *, base AND exact AS is_base, NOT base AND n_span <= {licenses.STRETCH} * (pairs + 1) AS close FROM spans),
     found AS (SELECT r, count(*) FILTER (is_base) AS n_base, min(start) FILTER (is_base) AS first_word, max(start) FILTER (is_base) AS last_word,
                      string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base) AS base_labels,
                      string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base OR (close AND coverage >= {licenses.COVERAGE})) AS labels,
                      max(coverage) FILTER (is_base OR close) AS score
               FROM judged GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN found USING (r)
"""

OP5 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_sum(list_transform(list_zip(q.e, x.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
           FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 100 = 0),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 10
"""

OP7 = """
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
     q AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
     rules(h, t, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
     f AS (SELECT host, path, max_by(h || t, length(h || t)) AS rule, max_by(v, length(h || t)) AS v
           FROM (SELECT DISTINCT host, path FROM q) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, t)
           GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM q LEFT JOIN f USING (host, path)
"""

OP12 = r"""
WITH p AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
              translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
     pieces AS (SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
     ws AS (SELECT id, lang, unnest(w) AS w1, unnest(range(len(w))) AS place FROM pieces),
     t AS (SELECT lang, w1, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM ws WINDOW o AS (PARTITION BY id ORDER BY place)),
     f AS (SELECT lang, 1 AS k, w1 AS phrase, CAST(count(*) AS HUGEINT) AS f FROM t GROUP BY lang, w1
           UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM t WHERE w2 IS NOT NULL GROUP BY lang, w1, w2
           UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM t WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3),
     n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
     c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
     cuts AS (SELECT lang, k, phrase, a, w, unnest(range(1, k)) AS cut FROM c),
     s AS (SELECT cuts.lang, cuts.k, cuts.phrase, a, cut, x.f AS l, y.f AS r, 1000000 * a * a // (x.f * y.f) AS score
           FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(list_slice(w, 1, cut), ' ')
                     JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(list_slice(w, cut + 1, cuts.k), ' ')),
     best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM s),
     gone AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN
                (SELECT lang, a, unnest([array_to_string(list_slice(w, 1, 2), ' '), array_to_string(list_slice(w, 2, 3), ' ')]) AS part FROM c WHERE k = 3) t
                ON t.lang = c.lang AND t.part = c.phrase AND 100 * t.a >= 50 * c.a),
     ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
                FROM best ANTI JOIN gone USING (lang, phrase) WHERE nth = 1)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

_PROBE_ROWS = ", ".join(f"({c}, {t}, '{role}', '{text}')" for c, t, role, text in chat.PROBE)
_ESCAPED = f"""replace(replace(replace(%s, '\\', '\\\\'), '{chat.OPENER}', '\\{chat.OPENER}'), '{chat.CLOSER}', '\\{chat.CLOSER}')"""
_ESCAPED_ROLE = f"replace({_ESCAPED % 'role'}, '{chat.DIVIDER}', '\\{chat.DIVIDER}')"

OP13 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
           FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES {_PROBE_ROWS}))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = '{chat.LEARNT}'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = '{chat.LEARNT}'), '')) AS loss_sha256,
       CAST(sum({len(chat.OPENER + chat.DIVIDER + chat.CLOSER) + 1} + length({_ESCAPED_ROLE}) + length({_ESCAPED % 'text'})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_licenses": OP1, "op3_decontamination": OP3, "op5_topk": OP5, "op7_url_rules": OP7, "op12_collocations": OP12, "op13_chat": OP13}
