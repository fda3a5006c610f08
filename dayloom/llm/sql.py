"""SQL of the queries of this package."""

SUBSTRING_DEDUP = r"""
WITH w AS MATERIALIZED (
    SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS word
    FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)),
g AS MATERIALIZED (
    SELECT doc_id, i, hash(list(word) OVER win) AS h, count(*) OVER win AS n
    FROM w WINDOW win AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
f AS (SELECT h, min(doc_id) AS first_doc FROM g WHERE n = 13 GROUP BY h HAVING min(doc_id) < max(doc_id)),
s AS (SELECT g.doc_id, g.i FROM g JOIN f USING (h) WHERE g.n = 13 AND f.first_doc < g.doc_id),
gone AS (SELECT DISTINCT doc_id, i + o AS i FROM s, (SELECT unnest(range(13)) AS o)),
kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept_text, count(*) AS n_kept
    FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_words FROM w GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, (coalesce(n_words, 0) - coalesce(n_kept, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept_text, '')) AS kept_sha256
FROM documents AS d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

LINE_DEDUP = r"""
WITH a AS MATERIALIZED (
    SELECT doc_id, generate_subscripts(ls, 1) AS r, unnest(ls) AS line
    FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
l AS MATERIALIZED (
    SELECT doc_id, r, line, row_number() OVER (PARTITION BY doc_id ORDER BY r) AS i
    FROM a WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
g AS MATERIALIZED (
    SELECT doc_id, i, list(line) OVER win AS h, count(*) OVER win AS n
    FROM l WINDOW win AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
f AS (
    SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first_doc, min(i) OVER (PARTITION BY h, doc_id) AS first_i
    FROM g WHERE n = 3),
s AS (SELECT doc_id, i FROM f WHERE first_doc < doc_id OR first_i + 3 <= i),
gone AS (SELECT DISTINCT doc_id, i + o AS i FROM s, (SELECT unnest(range(3)) AS o)),
kept AS (
    SELECT a.doc_id, string_agg(a.line, chr(10) ORDER BY a.r) AS kept_text
    FROM a LEFT JOIN l USING (doc_id, r) LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i
    WHERE gone.i IS NULL GROUP BY a.doc_id),
n AS (SELECT doc_id, count(*) AS n_lines FROM l GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept_text, '')) AS kept_sha256
FROM documents AS d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

SHORT_LINE_DEDUP = r"""
WITH a AS MATERIALIZED (
    SELECT doc_id, generate_subscripts(ls, 1) AS r, unnest(ls) AS line
    FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
l AS MATERIALIZED (
    SELECT doc_id, r, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY r) AS i
    FROM a WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n_lines FROM l GROUP BY doc_id),
g AS MATERIALIZED (
    SELECT x.doc_id, x.i, k, list(y.line ORDER BY y.i) AS h, sum(y.w) AS words
    FROM l AS x, (SELECT unnest([1, 2, 3]) AS k) JOIN l AS y ON y.doc_id = x.doc_id AND y.i >= x.i AND y.i < x.i + k
    GROUP BY ALL HAVING count(*) = k),
f AS (SELECT *, min(doc_id) OVER (PARTITION BY h) AS first_doc, min(i) OVER (PARTITION BY h, doc_id) AS first_i FROM g),
s AS (
    SELECT doc_id, i, k FROM f JOIN n USING (doc_id)
    WHERE (first_doc < doc_id OR first_i + k <= i) AND (k = 3 OR words > 50 OR n_lines = k)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS i FROM s),
kept AS (
    SELECT a.doc_id, string_agg(a.line, chr(10) ORDER BY a.r) AS kept_text
    FROM a LEFT JOIN l USING (doc_id, r) LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i
    WHERE gone.i IS NULL GROUP BY a.doc_id),
m AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept_text, '')) AS kept_sha256
FROM documents AS d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

DECONTAMINATION = r"""
WITH w AS MATERIALIZED (
    SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS word
    FROM (SELECT doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]', ' ', 'g'), '[^ ]+') AS ws
        FROM documents)),
b AS MATERIALIZED (
    SELECT item_id, len(ws) AS n, generate_subscripts(ws, 1) AS i, unnest(ws) AS word
    FROM (SELECT item_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]', ' ', 'g'), '[^ ]+') AS ws
        FROM benchmark WHERE item_id IS NOT NULL)),
items AS (
    SELECT DISTINCT item_id, least(n, 10) AS n, h
    FROM (SELECT item_id, n, list(word) OVER win AS h
          FROM b WINDOW win AS (PARTITION BY item_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING))
    WHERE len(h) = least(n, 10)),
g AS MATERIALIZED (
    SELECT doc_id, i, list(word) OVER win AS h
    FROM w WINDOW win AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
m AS (
    SELECT g.doc_id, g.i, t.n, t.item_id
    FROM (SELECT DISTINCT n FROM items) AS s JOIN g ON len(g.h) >= s.n JOIN items AS t ON t.n = s.n AND t.h = g.h[1:s.n]),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM m) GROUP BY doc_id),
item AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_words FROM w GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM documents AS d LEFT JOIN n USING (doc_id) LEFT JOIN hit USING (doc_id) LEFT JOIN item USING (doc_id)
"""

MIXING = r"""
WITH d AS MATERIALIZED (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
           ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[1:15])::BIGINT AS key
    FROM documents),
s AS (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
    FROM d GROUP BY source),
r AS (SELECT *, [5, 2, 1][rank % 3 + 1]::BIGINT AS weight, source_size * 3 AS most FROM s),
l AS (
    SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER before, 0))::DOUBLE
              / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
    FROM r WINDOW before AS (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT arg_min(level, most / weight) AS common FROM l WHERE level * weight <= most),
t AS MATERIALIZED (SELECT source, source_size, least(common * weight, most::DOUBLE) AS target FROM l, c),
e AS MATERIALIZED (
    SELECT d.doc_id, d.size, d.key, t.source_size, t.target,
           (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING))::BIGINT AS stop
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (
    SELECT doc_id, size, (sum(size) OVER (ORDER BY finish, key, doc_id, copy ROWS UNBOUNDED PRECEDING))::BIGINT AS running
    FROM (SELECT *, (copy * source_size + stop)::DOUBLE / target AS finish FROM e, (SELECT unnest(range(3)) AS copy) WHERE size > 0)),
n AS (SELECT doc_id, count(*) AS copies FROM k WHERE running <= (SELECT sum(source_size) FROM s) GROUP BY doc_id)
SELECT e.doc_id, e.size, e.source_size, e.target, (e.size * coalesce(copies, 0))::BIGINT AS taken
FROM e LEFT JOIN n USING (doc_id)
"""

JACCARD = r"""
WITH RECURSIVE d AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (
    SELECT DISTINCT doc_id, hash(ws[i:i + 4]) AS h
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS MATERIALIZED (
    SELECT p.a, p.b FROM (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
                          FROM s AS a JOIN s AS b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL) AS p
    JOIN n AS x ON x.doc_id = p.a JOIN n AS y ON y.doc_id = p.b WHERE 100 * p.c >= 80 * (x.n + y.n - p.c)),
r AS (SELECT doc_id, doc_id AS seen FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.seen)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, coalesce(min(r.seen), d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY d.doc_id
"""

FILTER_AUDIT = r"""
WITH d AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
           (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT
           + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
           + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask
    FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x AS a, x AS b, x AS c, x AS d, x AS e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (
    SELECT filter_order, step::INT AS step, filter_order[step] AS letter, 1 << (ascii(filter_order[step]) - 65) AS bit,
           list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65)))::INT AS earlier
    FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (
    SELECT part, filter_order, step, letter,
           coalesce(sum(n) FILTER (mask & coalesce(earlier, 0) = 0 AND mask & bit = 0), 0) AS kept,
           coalesce(sum(n) FILTER (mask & coalesce(earlier, 0) = 0 AND mask & bit <> 0), 0) AS removed,
           coalesce(sum(n) FILTER (mask & coalesce(earlier, 0) <> 0 AND mask & bit <> 0), 0) AS redundant,
           coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
           coalesce(sum(good) FILTER (mask & coalesce(earlier, 0) = 0 AND mask & bit <> 0), 0) AS good_lost,
           coalesce(sum(toxic) FILTER (mask & coalesce(earlier, 0) = 0 AND mask & bit <> 0), 0) AS toxic_lost
    FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM r
"""

QUALITY_RULES = r"""
WITH d AS MATERIALIZED (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
g AS MATERIALIZED (SELECT doc_id, i, hash(ws[i:i + 4]) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)),
r AS (
    SELECT doc_id, count(DISTINCT j) AS n_repeat_words
    FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, h) AS n FROM g) WHERE n > 1) GROUP BY doc_id),
c AS (
    SELECT doc_id, t, ws, ls, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
           len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
           coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
    FROM d LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > n_words
            OR 100 * len(list_filter(ws, lambda w: regexp_matches(w, '[A-Za-z]|[^\x00-\x7F]'))) < 80 * n_words
            OR 100 * len(regexp_extract_all(t, '[A-Z]')) > 40 * word_chars OR 100 * len(regexp_extract_all(t, '[0-9]')) > 20 * word_chars
            OR 100 * n_dup_lines > 30 * len(ls) OR 100 * len(list_filter(ls, lambda x: x[1] IN ('*', '-'))) > 90 * len(ls)
            OR 100 * len(list_filter(ls, lambda x: suffix(x, '...'))) > 30 * len(ls)) AS kept
FROM b
"""

CONVERSATION_REPAIR = r"""
WITH k AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           xor(list_reduce([4294967295]::BIGINT[] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT),
               lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))),
               4294967295) % 20 AS kind
    FROM conversations),
w AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM k, (SELECT unnest([1, 2]) AS copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM w),
f AS MATERIALIZED (
    SELECT *, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before,
           CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
    FROM n),
c AS (
    SELECT conv_id, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || role[1] NOT IN ('su', 'ua', 'au')) AS illegal,
           coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, list({'role': role[1], 'fault': fault} ORDER BY i) AS marks
    FROM f GROUP BY conv_id),
-- states: 0 nothing, 1 system, 2 user last, 3 assistant last
ins AS (
    SELECT * FROM (VALUES (0, 0, '', 0), (1, 1, '', 0), (2, 2, '', 0), (3, 3, '', 0), (0, 2, 'I', 2), (1, 2, 'I', 2), (2, 3, 'I', 2),
                          (3, 2, 'I', 2), (0, 3, 'II', 4), (1, 3, 'II', 4), (2, 2, 'II', 4), (3, 3, 'II', 4)) AS t(q, r, a, c)),
edit AS (
    SELECT * FROM (VALUES (0, 0, 'D', 3, ''), (1, 1, 'D', 3, ''), (2, 2, 'D', 3, ''), (3, 3, 'D', 3, ''), (0, 2, 'R', 2, ''),
                          (1, 2, 'R', 2, ''), (2, 3, 'R', 2, ''), (3, 2, 'R', 2, ''), (0, 1, 'K', 0, 's'), (0, 2, 'K', 0, 'u'),
                          (1, 2, 'K', 0, 'u'), (2, 3, 'K', 0, 'a'), (3, 2, 'K', 0, 'u')) AS t(q, r, a, c, role)),
ways AS (
    SELECT list({'q': ins.q, 'r': edit.r, 'a': ins.a || edit.a, 'edit': edit.a, 'c': ins.c + edit.c, 'role': edit.role}) AS ways
    FROM ins JOIN edit ON edit.q = ins.r),
s AS (
    SELECT conv_id, list_reduce([{'role': '', 'fault': '', 's': [{'c': 0, 'a': ''}, {'c': 1000000, 'a': ''}, {'c': 1000000, 'a': ''}, {'c': 1000000, 'a': ''}]}]
        || list_transform(marks, lambda m: {'role': coalesce(m.role, ''), 'fault': m.fault, 's': [{'c': 0, 'a': ''}]}),
        lambda p, m: {'role': '', 'fault': '', 's': list_transform([0, 1, 2, 3], lambda r: list_min(list_transform(
            list_filter(ways, lambda w: w.r = r AND (w.edit = 'D' OR m.fault NOT IN ('blank', 'duplicate')) AND (w.edit <> 'K' OR w.role = m.role)),
            lambda w: {'c': p.s[w.q + 1].c + w.c + CASE WHEN w.edit <> 'D' AND m.fault = 'truncated' THEN 1 ELSE 0 END, 'a': p.s[w.q + 1].a || w.a}
        ) || [{'c': 1000000, 'a': ''}]))}).s AS s
    FROM c, ways),
b AS (
    SELECT conv_id, list_min([s[1], {'c': s[2].c + 4, 'a': s[2].a || 'II'}, {'c': s[3].c + 2, 'a': s[3].a || 'I'}, s[4]]) AS best FROM s),
e AS (
    SELECT conv_id, p, letter, sum((letter <> 'I')::INT) OVER win AS i, sum((letter <> 'D')::INT) OVER win AS o
    FROM (SELECT conv_id, generate_subscripts(string_split(best.a, ''), 1) AS p, unnest(string_split(best.a, '')) AS letter FROM b WHERE best.a <> '')
    WINDOW win AS (PARTITION BY conv_id ORDER BY p)),
t AS (
    SELECT e.conv_id, e.p, letter, o, role, text, max((letter = 'K' AND role[1] = 's')::INT) OVER (PARTITION BY e.conv_id) AS system
    FROM e LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.i = e.i AND letter <> 'I' WHERE letter <> 'D'),
h AS (
    SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (o - system) % 2 = 1 THEN 'user' ELSE 'assistant' END
                               || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS whole
    FROM t GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
       coalesce(best.a, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM a.conv_id
"""
