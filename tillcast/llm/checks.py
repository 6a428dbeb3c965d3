"""SQL that gives the rows of the queries that SQL can express."""

from __future__ import annotations

from .quality import (
    COMMON_WORDS, LEAST_CHARS, LEAST_COMPARED_WORDS, LEAST_WORDS, MOST_CLASS_DISTANCE, MOST_REPEATED, MOST_WORD_DISTANCE,
)

SPACED = r"[^\x20\x09-\x0D]+"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = rf"""WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '{SPACED}') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') || CASE WHEN len(w) < 5 THEN ' short' ELSE '' END AS gram
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM texts WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM shared JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * m >= 75 * (s.n + t.n - m)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (SELECT x AS doc_id, x AS other FROM ways UNION SELECT doc_id, y FROM reached JOIN ways ON other = x),
labels AS (SELECT doc_id, min(other) AS label FROM reached GROUP BY doc_id)
SELECT t.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(l.label, t.doc_id) AS component_id
FROM texts t LEFT JOIN sizes s ON s.doc_id = t.doc_id LEFT JOIN labels l ON l.doc_id = t.doc_id"""

DECONTAMINATE = rf"""WITH words_of AS (
  SELECT 'd' AS kind, CAST(doc_id AS VARCHAR) AS id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', CAST(item_id AS VARCHAR), regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
windows AS (
  SELECT DISTINCT id AS item, least(len(w), 10) AS size, array_to_string(list_slice(w, i, i + 9), ' ') AS text
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM words_of WHERE kind = 'b' AND len(w) > 0)),
spots AS (
  SELECT id, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS text
  FROM (SELECT id, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM words_of, (SELECT DISTINCT size FROM windows) WHERE kind = 'd' AND len(w) >= size)),
met AS (SELECT id, item, size, i FROM spots JOIN windows USING (size, text)),
covered AS (SELECT id, count(DISTINCT place) AS n_hit FROM (SELECT id, unnest(range(i, i + size)) AS place FROM met) GROUP BY id),
items AS (SELECT id, count(item) AS n, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT id, item FROM met) GROUP BY id)
SELECT CAST(d.id AS BIGINT) AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words_of d LEFT JOIN covered c ON c.id = d.id LEFT JOIN items i ON i.id = d.id WHERE kind = 'd'"""


def _listed() -> str:
    lists = {lang: "[" + ", ".join(f"'{w}'" for w in words) + "]" for lang, words in COMMON_WORDS.items()}
    everything = "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(sum(COMMON_WORDS.values(), []))) + "]"
    return f"CASE lang {' '.join(f'WHEN {chr(39)}{lang}{chr(39)} THEN {words}' for lang, words in lists.items())} ELSE {everything} END"


def _distance(name: str) -> str:
    return f"""{name}_parts AS (
  SELECT doc_id, lang, generate_subscripts({name}, 1) AS k, unnest({name}) AS x FROM counts),
{name}_reference AS (SELECT lang, k, sum(x) AS x FROM {name}_parts GROUP BY lang, k),
{name}_shares AS (
  SELECT p.doc_id, p.x / nullif(sum(p.x) OVER (PARTITION BY p.doc_id), 0) AS p,
    r.x / nullif(sum(r.x) OVER (PARTITION BY p.doc_id), 0) AS q
  FROM {name}_parts p JOIN {name}_reference r ON r.k = p.k AND r.lang IS NOT DISTINCT FROM p.lang),
{name}_distance AS (
  SELECT doc_id, sqrt(greatest(sum(((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END)
    + (CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END)) / 2), 0)) AS distance
  FROM {name}_shares GROUP BY doc_id)"""


QUALITY = rf"""WITH texts AS (
  SELECT doc_id, lang, text, w, {_listed()} AS listed,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents)),
spots AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS part
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM texts WHERE len(w) >= 8)),
again AS (SELECT doc_id, i FROM spots QUALIFY count(*) OVER (PARTITION BY doc_id, part) > 1),
repeated AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM again) GROUP BY doc_id),
counts AS (
  SELECT t.doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, length(text) AS chars,
    [len(regexp_extract_all(text, '[A-Z]')), len(regexp_extract_all(text, '[0-9]')), length(text) - length(array_to_string(w, '')),
     len(regexp_extract_all(text, '[!"''()+,\-./:;=?@\[\\\]^_`{{}}~]')), len(regexp_extract_all(text, '[#*$%&|<>]'))] AS most,
    [length(text) - list_sum(most)] || most AS classes,
    list_transform(listed, lambda c: len(list_filter(w, lambda x: lower(x) = c))) AS hits,
    [len(w) - list_sum(hits)] || hits AS common
  FROM texts t LEFT JOIN repeated r ON r.doc_id = t.doc_id),
{_distance('classes')},
{_distance('common')},
judged AS (
  SELECT c.*, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
    CASE WHEN chars >= {LEAST_CHARS} THEN a.distance END AS class_distance,
    CASE WHEN n_words >= {LEAST_COMPARED_WORDS} THEN b.distance END AS word_distance
  FROM counts c LEFT JOIN classes_distance a ON a.doc_id = c.doc_id LEFT JOIN common_distance b ON b.doc_id = c.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(class_distance, 0) <= {MOST_CLASS_DISTANCE} AND coalesce(word_distance, 0) <= {MOST_WORD_DISTANCE} AS kept,
  round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance
FROM judged"""


FILL_MIDDLE = r"""WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
    list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), i, 8) AS BIGINT)) AS h
  FROM documents),
placed AS (
  SELECT doc_id, text, units, len(units) AS n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS low,
    greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS high,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 THEN 'plain'
      WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT *, array_to_string(list_slice(units, 1, low), '') AS prefix, array_to_string(list_slice(units, low + 1, high), '') AS middle,
    array_to_string(list_slice(units, high + 1, n), '') AS suffix
  FROM placed)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts"""

LINE_DEDUP = r"""WITH rows_of AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT r, doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS line FROM (SELECT r, doc_id, string_split(text, chr(10)) AS x FROM rows_of)),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
shared AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT k.*, coalesce(k.doc_id <> s.last, false) AS gone FROM keyed k LEFT JOIN shared s ON s.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r, doc_id"""

SQL = {"op2_jaccard": JACCARD, "op6_decontaminate": DECONTAMINATE, "op9_quality_rules": QUALITY, "op11_fill_middle": FILL_MIDDLE,
       "op13_line_dedup": LINE_DEDUP}
