"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

from folio.llm.secrets import PARTS, REACH

OP9 = r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
win AS (
  SELECT rid, i, list_slice(ws, i, i + 4) AS five FROM w, unnest(range(1, len(ws) - 3)) AS u(i)),
twice AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, five) > 1),
hit AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM twice, unnest([0, 1, 2, 3, 4]) AS s(k) GROUP BY rid),
ten AS (SELECT rid, i, list_slice(ws, i, i + 9) AS ten FROM w, unnest(range(1, len(ws) - 8)) AS u(i)),
ten_twice AS (SELECT rid, i FROM ten QUALIFY count(*) OVER (PARTITION BY rid, ten) > 1),
long AS (SELECT rid, count(DISTINCT i + k) AS n_long FROM ten_twice, unnest(range(10)) AS s(k) GROUP BY rid),
pair AS (SELECT rid, list_slice(ws, i, i + 1) AS two, count(*) AS n FROM w, unnest(range(1, len(ws))) AS u(i) GROUP BY 1, 2),
top_pair AS (SELECT rid, max(n) AS n_pair FROM pair GROUP BY rid),
lines AS (
  SELECT rid, count(*) AS n_lines, count(DISTINCT line) AS n_distinct,
         count(*) FILTER (regexp_matches(line, '^[\x20\x09-\x0D]*(- |\* |•)')) AS n_bullets,
         count(*) FILTER (regexp_matches(line, '(\.\.\.|…)[\x20\x09-\x0D]*$')) AS n_broken
  FROM w, unnest(string_split(text, chr(10))) AS u(line)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
f AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (coalesce(n_lines, 0) - coalesce(n_distinct, 0))::BIGINT AS n_dup_lines,
         coalesce(hit.n, 0)::BIGINT AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_bullets, 0) AS n_bullets, coalesce(n_broken, 0) AS n_broken,
         coalesce(n_long, 0) AS n_long, coalesce(n_pair, 0) AS n_pair,
         length(text) - length(replace(text, '!', '')) AS n_calls, length(regexp_replace(text, '[^{}]', '', 'g')) AS n_braces,
         len(list_filter(ws, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS n_upper,
         len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_letter_words
  FROM w LEFT JOIN hit USING (rid) LEFT JOIN lines USING (rid) LEFT JOIN long USING (rid) LEFT JOIN top_pair USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (10 * n_symbols > n_words OR 5 * n_dup_lines > 2 * n_lines
         OR word_chars < 2 * n_words OR word_chars > 30 * n_words OR 2 * n_letter_words < n_words
         OR 10 * n_bullets > 9 * greatest(1, n_lines) OR 10 * n_broken > 3 * n_lines
         OR 5 * n_calls > n_words OR 2 * n_upper > n_words OR 10 * n_braces > n_words
         OR (n_pair > 2 AND 10 * n_pair > n_words) OR 20 * n_long > 3 * n_words) AS kept
FROM b
"""

OP10 = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT rid, list_slice(ws, i, i + 4) AS five
  FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) AS u(i) WHERE len(ws) > 0),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
shared AS (SELECT a.rid AS x, b.rid AS y, count(*) AS n_both FROM s a JOIN s b USING (five) WHERE a.rid < b.rid GROUP BY 1, 2),
link AS (
  SELECT x, y FROM shared JOIN n nx ON nx.rid = x JOIN n ny ON ny.rid = y
  WHERE 100 * n_both >= 85 * (nx.n + ny.n - n_both)),
either AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(x, y) AS (SELECT x, y FROM either UNION SELECT r.x, e.y FROM reach r JOIN either e ON e.x = r.y),
least_doc AS (SELECT r.x AS rid, min(w.doc_id) AS m FROM reach r JOIN w ON w.rid = r.y GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id,
       doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
FROM w LEFT JOIN n USING (rid) LEFT JOIN least_doc USING (rid)
"""

OP7 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""

OP5 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         coalesce(doc_id, -9223372036854775808) AS id FROM documents),
u AS (SELECT *, (('0x' || substr(md5(concat_ws(':', id, size, '1')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM d),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM src),
w AS (SELECT *, [5.0::DOUBLE, 2, 1][((place - 1) % 3) + 1] AS weight, 3 * source_size AS lim FROM p),
l AS (
  SELECT *, row_number() OVER f AS turn,
         (sum(source_size) OVER () - coalesce(sum(lim) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS lvl
  FROM w WINDOW f AS (ORDER BY lim / weight, place), b AS (ORDER BY lim / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
per AS (SELECT coalesce(min_by(lvl, turn), 0) AS per_weight FROM l WHERE lim >= lvl * weight),
t AS (SELECT source, source_size, least(lim::DOUBLE, per_weight * weight) AS target FROM l, per),
g AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
hist AS (
  SELECT source, floor(log2(sqrt(size)) * 64) AS step, sum(size) AS words, sum(size * sqrt(size)) AS weighed FROM d WHERE size > 0 GROUP BY ALL),
edge AS (
  SELECT hist.source, step, target - whole * source_size AS rest, pow(2::DOUBLE, -(step + 1) / 64) AS m0, pow(2::DOUBLE, -step / 64) AS m1,
         words, weighed, sum(words) OVER a - words AS sure, sum(weighed) OVER z AS upto
  FROM hist JOIN g ON hist.source IS NOT DISTINCT FROM g.source
  WINDOW a AS (PARTITION BY hist.source ORDER BY step DESC), z AS (PARTITION BY hist.source ORDER BY step)),
both_ends AS (SELECT *, sure + m0 * upto AS e0, sure + words + m1 * (upto - weighed) AS e1 FROM edge WHERE rest > 0),
mult AS (
  SELECT source, max_by(CASE WHEN e0 >= rest THEN (rest - sure) / upto ELSE m0 + (m1 - m0) * (rest - e0) / (e1 - e0) END, step) AS m
  FROM both_ends WHERE e1 >= rest GROUP BY source),
o AS (
  SELECT u.doc_id, id, size, source_size, target, whole, u.source, u, target - whole * source_size AS rest,
         CASE WHEN target - whole * source_size > 0 THEN least(1, coalesce(pow(2::DOUBLE, round(log2(m), 9)), 1e300) * sqrt(greatest(size, 1))) ELSE 0 END AS incl
  FROM u JOIN g ON u.source IS NOT DISTINCT FROM g.source LEFT JOIN mult ON u.source IS NOT DISTINCT FROM mult.source),
q AS (SELECT *, CASE WHEN incl >= 1 THEN 0 WHEN incl > 0 THEN (u / (1 - u)) / (incl / (1 - incl)) END AS q FROM o),
r AS (SELECT *, coalesce(q / (1 + q), 1) AS rnk FROM q),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rnk, id, size ROWS UNBOUNDED PRECEDING) AS upto FROM r),
k AS (
  SELECT source, max(ROW(rnk, id, size)) AS last FROM c
  WHERE rest > 0 AND (upto <= rest OR upto - rest < rest - (upto - size)) GROUP BY source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN last IS NOT NULL AND ROW(rnk, id, size) <= last THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r LEFT JOIN k ON r.source IS NOT DISTINCT FROM k.source
"""

OP3 = r"""
WITH t0 AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
a AS (
  SELECT conv_id, max(pos) AS last_pos, CASE WHEN count(*) > 1 THEN min_by(text, pos) ELSE '' END AS stale
  FROM t0 WHERE role = 'assistant' GROUP BY 1),
t AS (
  SELECT * FROM t0 UNION ALL
  SELECT -1 - conv_id, role, CASE WHEN pos = last_pos THEN stale ELSE text END, pos FROM t0 JOIN a USING (conv_id)),
o AS (SELECT conv_id, min(conv_id) OVER (PARTITION BY role, text) AS chosen_id FROM t0 WHERE pos = 1),
p AS (
  SELECT chosen_id, conv_id AS rejected_id FROM o WHERE conv_id <> chosen_id
  UNION ALL SELECT conv_id, -1 - conv_id FROM a),
eq AS (
  SELECT p.*, c.pos, c.role = r.role AND c.text = r.text AS same
  FROM p JOIN t c ON c.conv_id = chosen_id JOIN t r ON r.conv_id = rejected_id AND r.pos = c.pos),
s AS (
  SELECT chosen_id, rejected_id, least(coalesce(min(pos) FILTER (NOT same) - 1, max(pos)), max(pos))::INTEGER AS n_shared
  FROM eq GROUP BY 1, 2),
x AS (
  SELECT conv_id, pos, role, text, '<|' || role || '|>' || chr(10) || text || chr(10) AS turn,
         length('<|' || role || '|>' || chr(10)) AS head FROM t),
y AS (
  SELECT s.*, w.side, x.pos, x.turn, x.role, x.head, length(x.text) AS len, x.pos <= n_shared AS shared,
         coalesce(sum(length(x.turn)) FILTER (x.pos > n_shared) OVER (
           PARTITION BY chosen_id, rejected_id, side ORDER BY x.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM s, (VALUES ('c'), ('r')) w(side) JOIN x ON x.conv_id = CASE WHEN side = 'c' THEN chosen_id ELSE rejected_id END),
g AS (
  SELECT chosen_id, rejected_id, n_shared, side,
         coalesce(string_agg(turn, '' ORDER BY pos) FILTER (shared), '') AS prompt,
         coalesce(string_agg(turn, '' ORDER BY pos) FILTER (NOT shared), '') AS completion,
         coalesce(string_agg((before + head)::BIGINT || ':' || (before + head + len)::BIGINT, ',' ORDER BY pos)
           FILTER (NOT shared AND role = 'assistant'), '') AS mask
  FROM y GROUP BY 1, 2, 3, 4)
SELECT c.chosen_id, c.rejected_id, c.n_shared, c.prompt, c.completion AS chosen, r.completion AS rejected,
       c.mask AS chosen_mask, r.mask AS rejected_mask, c.completion <> r.completion AS differs
FROM g c JOIN g r ON c.chosen_id = r.chosen_id AND c.rejected_id = r.rejected_id AND c.side = 'c' AND r.side = 'r'
"""



def _parts_sql() -> str:
    """Rows of gap and match lengths per kind of part.

    Hosts are found in another way than in the library: whole runs first, then the host at a run's beginning.
    """
    quoted = {p.kind: p.pattern.replace("'", "''").replace("++", "+") for p in PARTS}
    found = []
    for place, p in enumerate(PARTS):
        pattern = r"[A-Za-z0-9.@/-]+(?::[0-9]+)?" if p.kind == "host" else quoted[p.kind]
        more = f" AND (regexp_matches(t, '{quoted['access']}') OR regexp_matches(t, '{quoted['id']}'))" if p.kind in ("key", "url", "host") else ""
        keep, counts = "length(m[u.i])", f"length(v[u.i]) >= {p.least}"
        if p.kind == "host":
            name = r"regexp_extract(m[u.i], '^(?:[A-Za-z0-9-]|\.[A-Za-z0-9-])+')"
            keep = rf"CASE WHEN regexp_matches(substr(m[u.i], length({name}) + 1), '^:[0-9]+$') THEN length(m[u.i]) ELSE length({name}) END"
            counts = rf"regexp_matches({name}, '\.(?i:amazonaws|internal|local|com|net|org|io)$')"
        found.append(
            f"""SELECT rid, {place} AS place, u.i AS nth, length(g[u.i]) AS gap, length(m[u.i]) AS len, {keep} AS keep, {counts} AS counts
  FROM (SELECT rid, string_split_regex(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {p.group}) AS v
        FROM d WHERE regexp_matches(t, '{pattern}'){more}), unnest(range(1, len(m) + 1)) AS u(i)"""
        )
    return " UNION ALL ".join(found)


def _places(role: str) -> str:
    return ", ".join(str(k) for k, p in enumerate(PARTS) if p.role == role)


OP1 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({_parts_sql()}),
e AS (SELECT *, sum(gap + len) OVER (PARTITION BY rid, place ORDER BY nth)::BIGINT AS fin FROM m),
p AS (SELECT rid, place, fin - len AS start, fin - len + keep AS fin, ['{"', '".join(p.kind for p in PARTS)}'][place + 1] || ':' || (fin - len) || ':' || (fin - len + keep) AS span, place > 2 AS weak FROM e WHERE counts),
q AS (
  SELECT * FROM p WHERE NOT (place = 4 AND EXISTS (
    SELECT 1 FROM p s WHERE s.rid = p.rid AND s.place IN (0, 2) AND p.start < s.fin AND s.start < p.fin))),
i AS (SELECT * FROM q WHERE place IN ({_places("identifier")})),
s AS (SELECT * FROM q WHERE place IN ({_places("secret")})),
n AS (SELECT * FROM q WHERE place IN ({_places("endpoint")})),
pair AS (
  SELECT i.rid, i.start AS i_start, i.place AS i_place, i.span AS i_span, i.weak AS i_weak, s.start AS s_start, s.place AS s_place, s.span AS s_span, s.weak AS s_weak
  FROM i JOIN s ON i.rid = s.rid AND abs(i.start - s.start) <= {REACH}),
link AS (
  SELECT pair.*, n.start AS n_start, n.place AS n_place, n.span AS n_span
  FROM pair LEFT JOIN n ON n.rid = pair.rid AND abs(n.start - i_start) <= {REACH}
  WHERE NOT (i_weak AND s_weak) OR n.span IS NOT NULL),
every AS (
  SELECT rid, start, place, span FROM p WHERE NOT weak
  UNION SELECT rid, i_start, i_place, i_span FROM link WHERE i_weak
  UNION SELECT rid, s_start, s_place, s_span FROM link WHERE s_weak
  UNION SELECT rid, n_start, n_place, n_span FROM link WHERE n_span IS NOT NULL),
a AS (
  SELECT rid, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex,
         string_agg(span, ',' ORDER BY start, place) FILTER (place < 3) AS base, string_agg(span, ',' ORDER BY start, place) AS spans
  FROM every GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (rid)
"""

OP8 = r"""
WITH d AS (SELECT row_number() OVER () AS tid, t FROM (SELECT DISTINCT coalesce(text, '') AS t FROM documents)),
l AS (SELECT tid, u.i AS pos, string_split(t, chr(10))[u.i] AS line FROM d, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS u(i)),
k AS (SELECT *, trim(regexp_replace(regexp_replace(line, '[0-9]+', '#', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS form FROM l),
y AS (
  SELECT tid, pos, form, string_split(form, ' ') AS tokens, len(string_split(form, ' ')) AS n,
         len(string_split(form, ' ')) || ':' || array_to_string(string_split(form, ' ')[1:3], ' ') AS leaf
  FROM k WHERE regexp_matches(form, '\p{L}')),
f AS (SELECT leaf, form, any_value(tokens) AS tokens, any_value(n) AS n, count(DISTINCT tid) AS texts FROM y GROUP BY 1, 2),
many AS (SELECT leaf FROM f WHERE n > 3 GROUP BY 1 HAVING count(*) > 1 AND sum(texts) > 2),
b AS (
  SELECT leaf, form, n - 3 AS m, least(n - 3, 10) AS parts, greatest(1, least(4, (2 * least(n, 13)) // 5, least(n, 13) - 4)) AS fields,
         [[tokens[4 + t] FOR t IN range(0, n - 3) IF (t * least(n - 3, 10)) // (n - 3) = p] FOR p IN range(0, least(n - 3, 10))] AS stretch
  FROM f JOIN many USING (leaf)),
template AS (
  SELECT leaf, form, -1 AS mask, [form] AS words FROM f
  UNION ALL
  SELECT leaf, form, c.i, [array_to_string(stretch[p + 1], ' ') FOR p IN range(0, parts) IF (c.i // (2 ** p)::BIGINT) % 2 = 1]
  FROM b, range(0, 1024) AS c(i) WHERE c.i < 2 ** parts AND bit_count(c.i) = parts - fields),
recurring AS (SELECT leaf, mask, words FROM template JOIN y USING (leaf, form) GROUP BY 1, 2, 3 HAVING count(DISTINCT tid) >= 3),
gone AS (SELECT DISTINCT leaf, form FROM template JOIN recurring USING (leaf, mask, words)),
r AS (SELECT k.tid, k.pos, k.line, gone.form IS NOT NULL AS gone FROM k LEFT JOIN y USING (tid, pos) LEFT JOIN gone ON gone.leaf = y.leaf AND gone.form = y.form),
o AS (
  SELECT tid, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
         coalesce(string_agg((pos - 1)::VARCHAR, ',' ORDER BY pos) FILTER (gone), '') AS dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS rest
  FROM r GROUP BY tid)
SELECT doc_id, n_lines, n_dropped, dropped, sha256(rest) AS text_sha256
FROM documents JOIN d ON d.t = coalesce(text, '') JOIN o USING (tid)
"""

OP12 = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
least AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
lab AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         [len(ws) < 100, 100 * len(list_distinct(ws)) < 80 * len(ws),
          100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
          regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first_id, false)] AS fails
  FROM d JOIN least USING (t) LEFT JOIN lab USING (doc_id)),
m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest([1, 2, 3, 4, 5]) AS k),
o AS (
  SELECT [a.k, b.k, c.k, d.k, e.k] AS ks FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (
  SELECT array_to_string([substr('ABCDE', k, 1) for k in ks], '') AS filter_order, step, ks[step] AS k, list_slice(ks, 1, step - 1) AS earlier
  FROM o, unnest([1, 2, 3, 4, 5]) AS u(step)),
r AS (
  SELECT part, filter_order, step, k, fails[k] AS hit, len([1 for i in earlier if fails[i]]) > 0 AS gone,
         len([1 for y in fails if y]) = 1 AS alone, n, good, toxic
  FROM s, m),
c AS (
  SELECT part, filter_order, step, k,
         coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (hit AND NOT gone), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (hit AND gone), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (hit AND alone), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (hit AND NOT gone), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (hit AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM r GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, k)::BIGINT AS shapley
FROM c"""

ORACLE_SQL: dict[str, str] = {"op12_filter_audit": OP12, "op1_secret_scan": OP1, "op8_line_templates": OP8, "op3_preferences": OP3, "op5_mix_sources": OP5, "op7_top_k": OP7, "op9_quality_rules": OP9, "op10_minhash": OP10}
