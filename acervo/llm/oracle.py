"""DuckDB SQL that returns the rows of the queries which SQL can express."""

from acervo.llm import licenses

UPPER, LOWER = licenses.UPPER, licenses.LOWER

MIX = """
WITH size AS (SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS size FROM documents GROUP BY source),
rate AS (SELECT source, (SELECT sum(size) FROM size) / (SELECT count(*) FROM size WHERE size > 0) / size AS rate FROM size WHERE size > 0),
split AS (SELECT source, ceil(rate / 32)::BIGINT AS pieces, rate / ceil(rate / 32) AS rate FROM rate),
cdf AS (SELECT source, pieces, sum(exp(k * ln(rate) - rate - CASE WHEN k < 2 THEN 0 ELSE lgamma(k + 1) END)) OVER (PARTITION BY source ORDER BY k) AS c
  FROM split, range(0, 128) t(k) WHERE k <= ceil(rate + 12 * sqrt(rate) + 20)),
all_of AS (SELECT source, any_value(pieces) AS pieces, list(c) AS cdf FROM cdf GROUP BY source),
own AS (SELECT doc_id, source, text, coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, '')) AS own FROM documents),
piece AS (SELECT o.*, a.cdf, unnest(range(1, a.pieces + 1)) AS piece FROM own o JOIN all_of a ON o.source IS NOT DISTINCT FROM a.source),
drawn AS (SELECT *, ('0x' || substr(md5('mix|' || own || '|' || piece), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM piece),
copies AS (SELECT doc_id, source, text, own, unnest(range(1, len([c for c in cdf if c <= u]) + 1)) + (piece - 1) * 128 AS copy FROM drawn)
SELECT doc_id, source, copy::BIGINT AS copy, md5('mix-order|' || own || '|' || copy) AS shuffle_key, text FROM copies
"""

DECONTAM = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
item AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM item),
place AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
hit AS (SELECT p.doc_id, p.i, p.n, item.item_id FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM place) p JOIN item USING (n, gram)),
covered AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(i.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(i.items, '')) AS items_sha256, c.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN items i USING (doc_id)
"""

CHAT = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, k, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, role)),
sized AS (SELECT *, role = 'assistant' AS target, length('<s>[INST] ') + length(' [/INST] ') + length('</s>')
    + length(regexp_replace(role, '([<\[])(\\*/?(?:s>|INST\]))', '\1\\\2', 'g')) + length(regexp_replace(text, '([<\[])(\\*/?(?:s>|INST\]))', '\1\\\2', 'g')) AS size FROM t),
placed AS (SELECT *, sum(size) OVER w AS upto, lead(turn) OVER w IS NULL AS final
  FROM sized WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (target), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (target), '')) AS loss_sha256,
  sum(upto) FILTER (target OR final)::BIGINT AS formatted_chars
FROM placed GROUP BY conv_id
"""

# crc32 byte by byte with the usual table; near words share what is left when one letter goes
VARIANTS = r"""
WITH RECURSIVE crc AS (SELECT list(list_reduce(list_prepend(k, range(8)), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY k) AS t FROM range(256) r(k)),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'UPPER', 'LOWER'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
bytes AS (SELECT run, count(*) AS n, hex(encode(any_value(doc_id)::VARCHAR || ':' || run)) AS h FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(h), 2), lambda i: ('0x' || h[i:i + 1])::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h
  FROM bytes, crc),
bent AS (SELECT CASE WHEN h % 199 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM bent WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less AS MATERIALIZED (SELECT word, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
pair AS (SELECT DISTINCT a.word AS a, b.word AS b FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT word, rest FROM less SEMI JOIN w ON rest = w.word UNION SELECT rest, word FROM less SEMI JOIN w ON rest = w.word),
best AS (SELECT a AS word, count(*) AS n_near, first(b ORDER BY w.n DESC, encode(b)) AS near, max(w.n) AS near_n FROM pair JOIN w ON b = w.word GROUP BY a),
known AS MATERIALIZED (SELECT w.word, CASE WHEN near_n >= 5 * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root, form AS next FROM known UNION ALL SELECT walk.word, walk.next, known.form FROM walk JOIN known ON walk.next = known.word)
SELECT known.word, form, walk.root, n, n_near, form_n FROM known JOIN walk ON walk.word = known.word AND walk.next IS NULL
""".replace("UPPER", UPPER).replace("LOWER", LOWER)

SQL: dict[str, str] = {
    "op2_license_scan": licenses.oracle(),
    "op4_poisson_mix": MIX,
    "op10_benchmark_decontamination": DECONTAM,
    "op11_spelling_variants": VARIANTS,
    "op12_chat_format": CHAT,
}
