"""DuckDB SQL for the corpus queries that SQL can express. The others are tested against plain versions."""

from __future__ import annotations

# Candidates at distance one agree in the first or in the second half; the distance itself is checked place by place.
LINE_DEDUP = """
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN text IS NULL THEN 0 ELSE 1 END AS known FROM documents),
lines AS (
  SELECT doc_id, i - 1 AS line_no, parts[i] AS raw, lower(trim(parts[i], ' ' || chr(9) || chr(13))) AS line
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM docs))
),
firsts AS (
  SELECT line, length(line) AS n, min({'d': doc_id, 'l': line_no}) AS pos FROM lines WHERE length(line) >= 20 GROUP BY line
),
halves AS (SELECT *, left(line, n // 2) AS a, right(line, n - n // 2) AS b FROM firsts),
shorter AS (SELECT *, left(line, (n - 1) // 2) AS a, right(line, n - 1 - (n - 1) // 2) AS b FROM firsts),
pairs AS (
  SELECT x.line AS p, y.line AS q, x.pos AS pp, y.pos AS qp FROM halves x JOIN halves y ON x.n = y.n AND x.a = y.a AND x.line <> y.line
  UNION SELECT x.line, y.line, x.pos, y.pos FROM halves x JOIN halves y ON x.n = y.n AND x.b = y.b AND x.line <> y.line
  UNION SELECT x.line, y.line, x.pos, y.pos FROM halves x JOIN shorter y ON x.n = y.n - 1 AND x.a = y.a
  UNION SELECT x.line, y.line, x.pos, y.pos FROM halves x JOIN shorter y ON x.n = y.n - 1 AND x.b = y.b
),
near AS (
  SELECT * FROM pairs WHERE CASE WHEN length(p) = length(q)
    THEN len(list_filter(range(1, length(p) + 1), lambda i: p[i] <> q[i])) <= 1
    ELSE len(list_filter(range(0, length(p) + 1), lambda i: left(p, i) = left(q, i) AND substr(p, i + 1) = substr(q, i + 2))) > 0 END
),
late AS (SELECT p AS line FROM near WHERE qp < pp UNION SELECT q FROM near WHERE pp < qp),
judged AS (
  SELECT l.doc_id, l.line_no, l.raw,
    f.line IS NOT NULL AND (t.line IS NOT NULL OR {'d': l.doc_id, 'l': l.line_no} <> f.pos) AS gone
  FROM lines l LEFT JOIN firsts f ON l.line = f.line LEFT JOIN late t ON l.line = t.line
)
SELECT doc_id, CASE WHEN known = 0 THEN 0 ELSE count(*) END AS n_lines, count(*) FILTER (gone) AS n_removed,
  coalesce(string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) FILTER (gone), '') AS removed,
  sha256(coalesce(string_agg(raw, chr(10) ORDER BY line_no) FILTER (NOT gone), '')) AS kept_sha256
FROM judged JOIN docs USING (doc_id) GROUP BY doc_id, known
"""

# Texts that repeat keep their first copy, whose words are recounted with the punctuation.
TOKEN_COUNTS = """
WITH counted AS (
  SELECT doc_id, source, lang,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words,
    len(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{M}\\p{N}_]+|[^\\p{L}\\p{M}\\p{N}_\\x20\\x09-\\x0D]')) AS pieces,
    min(doc_id) OVER same AS head, count(*) OVER same AS copies
  FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
),
kept AS (SELECT *, CASE WHEN copies > 1 THEN pieces ELSE words END AS recounted FROM counted WHERE doc_id = head),
long AS (
  SELECT source, lang, 'words-1' AS version, recounted AS tokens FROM kept
  UNION ALL SELECT source, lang, 'pieces-1', pieces FROM kept
)
SELECT source, lang, version, count(*) AS documents, CAST(sum(tokens) AS BIGINT) AS tokens FROM long GROUP BY ALL
"""

_WORDS = "regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+')"
# Shingles are compared as texts; the pairs that share enough of them are followed to the smallest reachable document.
NEAR_COPIES = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words
  FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM docs WHERE len(words) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL
),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)
),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS d, doc_id AS r FROM docs UNION SELECT d, b FROM reach JOIN ways ON a = r),
least AS (SELECT d AS doc_id, min(r) AS component_id FROM reach GROUP BY d),
classes AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY words) END AS class_id FROM docs)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = doc_id AS kept, class_id
FROM least JOIN classes USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""

PASSAGES = f"""
WITH docs AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS words FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS content
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM docs WHERE len(words) >= 50)
),
owned AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY content) AS owner FROM windows) WHERE owner < doc_id),
each AS (SELECT doc_id, words[i] AS word, i FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM docs)),
covered AS (
  SELECT e.doc_id, e.word, e.i, max(o.i) OVER (PARTITION BY e.doc_id ORDER BY e.i) AS last FROM each e LEFT JOIN owned o ON o.doc_id = e.doc_id AND o.i = e.i
),
left_over AS (
  SELECT doc_id, count(*) FILTER (i - last <= 49) AS n_removed,
    string_agg(word, ' ' ORDER BY i) FILTER (last IS NULL OR i - last > 49) AS kept
  FROM covered GROUP BY doc_id
)
SELECT doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN left_over USING (doc_id)
"""


# CRC-32 of ``{text}``: the table of 256 remainders follows from the polynomial, bytes come from the hexadecimal form.
CRC_TABLE = """crc AS (
  SELECT list(list_reduce(range(0, 9), lambda c, k: CASE WHEN k = 0 THEN c WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS steps
  FROM range(0, 256) bytes(i)
)"""
CRC = """xor(4294967295, list_reduce(list_transform(range(1, 2 * strlen({text}), 2), lambda k: ('0x' || substr(hex(encode({text})), k, 2))::BIGINT),
  lambda c, b: xor(c // 256, crc.steps[1 + xor(c % 256, b)]), 4294967295))"""

_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(concat(" + ", ".join(_FIELD.format(x) for x in ("doc_id", "source", "lang", "{n}", "text")) + "))"
# Levels are built bottom up for all languages at once, then for their roots; a second recursion climbs them.
MERKLE = f"""
WITH RECURSIVE {CRC_TABLE},
docs AS (
  SELECT doc_id, lang, {_LEAF.format(n="n_chars")} AS leaf,
    CASE WHEN {CRC.format(text="doc_id::VARCHAR")} % 7 = 0 THEN {_LEAF.format(n="(n_chars + 1)")} ELSE {_LEAF.format(n="n_chars")} END AS altered
  FROM documents, crc
),
groups AS (SELECT lang, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) AS tree, count(*) AS n FROM docs GROUP BY lang),
leaves AS (
  SELECT d.*, g.tree, row_number() OVER (PARTITION BY g.tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, g.n
  FROM docs d JOIN groups g ON g.lang IS NOT DISTINCT FROM d.lang
),
lower_levels(tree, level, pos, h, n) AS (
  SELECT tree, 0, pos, leaf, n FROM leaves
  UNION ALL SELECT tree, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM lower_levels WHERE n > 1 GROUP BY tree, level, pos // 2, n
),
subroots AS (SELECT tree, h FROM lower_levels WHERE n = 1),
upper_levels(tree, level, pos, h, n) AS (
  SELECT 0::BIGINT, 0, tree - 1, h, count(*) OVER () FROM subroots
  UNION ALL SELECT tree, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM upper_levels WHERE n > 1 GROUP BY tree, level, pos // 2, n
),
levels AS (SELECT * FROM lower_levels UNION ALL SELECT * FROM upper_levels),
climb(doc_id, leaf, own, tree, level, pos, n, h, proof) AS (
  SELECT doc_id, leaf, tree, tree, 0, pos, n, altered, '' FROM leaves
  UNION ALL SELECT c.doc_id, c.leaf, c.own,
    CASE WHEN c.n > 1 THEN c.tree ELSE 0 END, CASE WHEN c.n > 1 THEN c.level + 1 ELSE 0 END, CASE WHEN c.n > 1 THEN c.pos // 2 ELSE c.own - 1 END,
    CASE WHEN c.n > 1 THEN (c.n + 1) // 2 ELSE (SELECT count(*) FROM subroots) END,
    CASE WHEN c.n = 1 THEN c.h WHEN c.pos % 2 = 1 THEN sha256(l.h || c.h) ELSE sha256(c.h || coalesce(l.h, '')) END,
    c.proof || CASE WHEN c.n > 1 THEN coalesce(l.h, '') ELSE '' END
  FROM climb c LEFT JOIN levels l ON l.tree = c.tree AND l.level = c.level AND l.pos = xor(c.pos, 1::BIGINT) WHERE c.n > 1 OR c.tree > 0
)
SELECT c.doc_id, c.leaf, s.h AS subroot, r.h AS root, sha256(c.proof) AS proof_sha256, c.h AS folded_root, c.h = r.h AS verified
FROM climb c JOIN subroots s ON s.tree = c.own JOIN upper_levels r ON r.n = 1 WHERE c.tree = 0 AND c.n = 1
"""


# Words that agree after losing a letter at the same place differ in that letter only.
SPELLING = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents
),
counted AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS keyed, run, count(*) AS c FROM runs WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (SELECT run, c, {CRC.format(text="keyed")} AS h FROM counted, crc),
seen AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM hashed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM seen WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
variants AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS v FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM variants a JOIN variants b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM variants a JOIN words b ON a.v = b.word
  UNION SELECT b.word, a.word, a.n FROM variants a JOIN words b ON a.v = b.word
),
near AS (SELECT word, count(*) AS n_near, max(other_n) AS most FROM pairs GROUP BY word),
best AS (SELECT p.word, min(other) AS form, any_value(most) AS most FROM pairs p JOIN near USING (word) WHERE other_n = most GROUP BY p.word),
forms AS (
  SELECT w.word, CASE WHEN near.most >= 5 * n THEN form END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN near.most >= 5 * n THEN near.most END AS form_n
  FROM words w LEFT JOIN near USING (word) LEFT JOIN best USING (word)
),
way(word, reached) AS (SELECT word, word FROM forms UNION ALL SELECT way.word, forms.form FROM way JOIN forms ON forms.word = way.reached WHERE forms.form IS NOT NULL)
SELECT f.word, f.form, w.reached AS root, f.n, f.n_near, f.form_n FROM forms f JOIN way w USING (word) JOIN forms l ON l.word = w.reached WHERE l.form IS NULL
"""


# Texts in hexadecimal form: two characters a byte.
BYTE_STRINGS = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS code FROM documents),
places AS (SELECT r, code, unnest(range(0, greatest(length(code) // 2 - 199, 0))) AS p FROM docs),
windows AS (SELECT r, p, md5_number(substr(code, 2 * p + 1, 400)) AS content FROM places),
repeated AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY content) AS n FROM windows) WHERE n > 1),
marked AS (SELECT r, p, p - lag(p) OVER (PARTITION BY r ORDER BY p) AS gap FROM repeated),
runs AS (SELECT r, p, count(*) FILTER (gap IS NULL OR gap > 200) OVER (PARTITION BY r ORDER BY p) AS run FROM marked),
spans AS (SELECT r, min(p) AS low, max(p) + 200 AS high FROM runs GROUP BY r, run),
gaps AS (SELECT r, high AS low, lead(low) OVER (PARTITION BY r ORDER BY low) AS high FROM spans UNION ALL SELECT r, 0, min(low) FROM spans GROUP BY r),
kept AS (
  SELECT g.r, string_agg(substr(code, 2 * low + 1, 2 * (coalesce(high, length(code) // 2) - low)), '' ORDER BY low) AS code
  FROM gaps g JOIN docs USING (r) GROUP BY g.r
),
lost AS (SELECT r, sum(high - low)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY r)
SELECT doc_id, length(d.code) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k.code, d.code))) AS kept_sha256
FROM docs d LEFT JOIN lost USING (r) LEFT JOIN kept k USING (r)
"""


def all_statements() -> dict[str, str]:
    return {"op1_token_counts": TOKEN_COUNTS, "op4_line_dedup": LINE_DEDUP, "op5_near_dedup": NEAR_COPIES, "op8_substring_dedup": PASSAGES, "op11_spelling_variants": SPELLING, "op12_suffix_dedup": BYTE_STRINGS, "op13_merkle_manifest": MERKLE}
