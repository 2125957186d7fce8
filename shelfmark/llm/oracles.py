"""SQL twins of the queries that SQL can express."""

SQL: dict[str, str] = {}

SQL["op8_chat_format"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
parts AS (
  SELECT *, replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') AS role_out,
         replace(replace(text, '\', '\\'), '<|', '<\|') AS text_out FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|turn|>') + length(role_out) + 1 + length(text_out) + length('<|end|>') + 1) AS BIGINT) AS formatted_chars
FROM parts GROUP BY conv_id
"""

SQL["op2_quality_rules"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT *, list_filter(string_split_regex(text, '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\x0c\r]')) AS lines FROM docs),
word AS (
  SELECT k, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM split),
hashed AS (
  SELECT k, i, word, CAST('0x' || substr(md5(word), 1, 15) AS BIGINT) AS h,
         unicode(right(word, 3)) * 7919::BIGINT + unicode(right(word, 2)) * 6425::BIGINT + unicode(right(word, 1)) * 5373::BIGINT AS e FROM word),
paired AS (
  SELECT *, lag(h) OVER (PARTITION BY k ORDER BY i) AS before FROM hashed),
places AS (
  SELECT k, h % 16384 AS place FROM paired
  UNION ALL SELECT k, e % 16384 FROM paired
  UNION ALL SELECT k, ((before % 4294967296) * 31 + h % 4294967296) % 16384 FROM paired WHERE before IS NOT NULL),
trusted AS (
  SELECT k FROM docs WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
counts AS (
  SELECT place, count(*) AS r, count(t.k) AS t FROM places p LEFT JOIN trusted t ON p.k = t.k GROUP BY place),
total AS (
  SELECT sum(r) AS r, sum(t) AS t FROM counts),
ratio AS (
  SELECT place, CASE WHEN total.t = 0 THEN 0 ELSE CAST(round((ln((counts.t + 1.0::DOUBLE) / (total.t + 16384.0::DOUBLE))
         - ln((counts.r + 1.0::DOUBLE) / (total.r + 16384.0::DOUBLE))) * 1e6::DOUBLE) AS BIGINT) END AS weight FROM counts, total),
scored AS (
  SELECT k, sum(weight) AS total, count(*) AS n FROM places JOIN ratio USING (place) GROUP BY k),
window5 AS (
  SELECT k, i, [word, lead(word) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o] AS five,
         lead(word, 4) OVER o AS fifth FROM word WINDOW o AS (PARTITION BY k ORDER BY i)),
again AS (
  SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, five) AS n FROM window5 WHERE fifth IS NOT NULL) WHERE n > 1),
covered AS (
  SELECT k, count(DISTINCT i + d) AS n FROM again, (SELECT unnest([0, 1, 2, 3, 4]) AS d) GROUP BY k),
base AS (
  SELECT split.k, doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM split LEFT JOIN covered ON split.k = covered.k),
failed AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       coalesce(CAST(total AS DOUBLE) / (n * 1e6::DOUBLE), 0) AS score,
       NOT base_failed AND coalesce(total >= n * -150000, TRUE) AS kept
FROM failed LEFT JOIN scored ON failed.k = scored.k
"""

SQL["op11_fill_in_middle"] = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
units AS (
  SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1,
         CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3,
         CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM docs),
cuts AS (
  SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM units),
parts AS (
  SELECT *, array_to_string(list_slice(u, 1, a), '') AS prefix, array_to_string(list_slice(u, a + 1, b), '') AS middle,
         array_to_string(list_slice(u, b + 1, n), '') AS suffix FROM cuts)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM parts
"""

SQL["op12_decontaminate"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
parts AS (
  SELECT item, least(len(w), 10) AS size, unnest(w) AS word, generate_subscripts(w, 1) AS i, r FROM (SELECT *, row_number() OVER () AS r FROM items)),
tens AS (
  SELECT item, size, list(word) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ten FROM parts),
windows AS (
  SELECT DISTINCT item, size, array_to_string(list_slice(ten, 1, size), ' ') AS words FROM tens WHERE len(ten) >= size),
sizes AS (
  SELECT DISTINCT size FROM windows),
word AS (
  SELECT k, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs),
places AS (
  SELECT k, i, list(word) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ten FROM word),
found AS (
  SELECT k, i, p.size, item FROM (
    SELECT k, i, size, array_to_string(list_slice(ten, 1, size), ' ') AS words FROM places, sizes WHERE size <= len(ten)) p
  JOIN windows ON windows.size = p.size AND windows.words = p.words),
hit AS (
  SELECT k, count(DISTINCT i + d) AS n FROM (SELECT k, i, unnest(generate_series(0, size - 1)) AS d FROM (SELECT DISTINCT k, i, size FROM found)) GROUP BY k),
named AS (
  SELECT k, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM found) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit ON hit.k = docs.k LEFT JOIN named ON named.k = docs.k
"""
