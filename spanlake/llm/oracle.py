"""The SQL for DuckDB of the queries that SQL can express, the direct way."""

from __future__ import annotations

OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, max(page_id) AS first_id FROM p WHERE strlen(html) >= 1000 GROUP BY html)
SELECT p.page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
 CASE WHEN f.first_id IS NULL OR f.first_id = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN f.first_id IS NULL OR f.first_id = p.page_id THEN NULL ELSE f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.html = f.html
"""


def _term(p: str, q: str) -> str:
    """What one bin adds to twice the Jensen-Shannon divergence."""
    return f"(CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2(2 * {q} / ({p} + {q})) ELSE 0 END)"


def _without(chars: str) -> str:
    return f"(length(text) - length(regexp_replace(text, '[{chars}]', '', 'g')))"


_KINDS = {0: "a-z", 1: "A-Z", 2: "0-9", 3: r"\x20\x09-\x0D", 4: r".,;:?''\"()\-", 5: r"#*$%&|<>!", 7: r"^\x00-\x7F"}
_BINS = range(8)


def _references(k: int, good: str) -> str:
    """Blocks with references number k over the documents ``good``, and distances of all documents to them."""
    shares = ", ".join(f"sum(c{i})::DOUBLE / sum(chars) AS q{i}" for i in _BINS)
    of_class = " + ".join(_term(f"(d.c{i} / greatest(d.chars, 1)::DOUBLE)", f"r.q{i}") for i in _BINS)
    p, other = "(h.n / greatest(d.n_words, 1)::DOUBLE)", "(1 - coalesce(b.p, 0))"
    return f"""
langs{k} AS (SELECT lang, sum(n_words) AS words, {shares} FROM {good} GROUP BY lang HAVING sum(n_words) > 0),
refs{k} AS (SELECT * FROM langs{k} WHERE words >= 0.01 * (SELECT sum(words) FROM langs{k})),
common{k} AS (SELECT lang, word, n / words::DOUBLE AS q FROM (
  SELECT s.lang, s.word, sum(s.n) AS n, any_value(r.words) AS words FROM short s JOIN {good} g ON g.rid = s.rid JOIN refs{k} r ON r.lang = s.lang GROUP BY 1, 2)
 WHERE n >= 0.0002 * words QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= 64),
rest{k} AS (SELECT lang, greatest(0, 1 - sum(q)) AS other, sum(q) AS known FROM common{k} GROUP BY lang),
both{k} AS (SELECT h.rid, c.lang, sum({_term(p, "c.q")}) AS t, sum(c.q) AS q, sum({p}) AS p
 FROM short h JOIN common{k} c ON c.word = h.word JOIN base d ON d.rid = h.rid GROUP BY 1, 2),
near{k} AS (SELECT d.*, r.lang AS ref, sqrt(least(1, greatest(0, ({of_class}) / 2))) AS of_class,
  sqrt(least(1, greatest(0, (coalesce(b.t, 0) + (x.known - coalesce(b.q, 0)) + CASE WHEN d.n_words > 0 THEN {_term(other, "x.other")} ELSE x.other END) / 2))) AS of_word
 FROM base d CROSS JOIN refs{k} r JOIN rest{k} x ON x.lang = r.lang LEFT JOIN both{k} b ON b.rid = d.rid AND b.lang = r.lang),
best{k} AS (SELECT rid, bool_or((of_class <= 0.19 OR chars < 200) AND (of_word <= 0.52 OR n_words < 60)) AS close,
  arg_min(struct_pack(of_class, of_word, ref), (of_class + of_word, ref)) AS nearest FROM near{k} GROUP BY rid),
good{k} AS (SELECT d.* FROM base d JOIN best{k} b ON b.rid = d.rid WHERE d.n_words >= 10 AND b.close)"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_COUNTED = ", ".join(f"{_without(chars)} AS c{i}" for i, chars in _KINDS.items())
_KNOWN = " + ".join(f"c{i}" for i in _KINDS)

OP1 = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(lang, 'und') AS lang FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, length(text) AS chars FROM t),
counted AS (SELECT rid, doc_id, lang, words, chars, len(words)::BIGINT AS n_words, {_COUNTED}, {_without("#*$%&|<>")} AS n_symbols FROM w),
lines AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM t)
 WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
windows AS (SELECT rid, i, words[i:i + 4] AS five FROM (SELECT rid, words, unnest(range(1, n_words - 3)) AS i FROM counted WHERE n_words >= 5)),
repeated AS (SELECT rid, count(DISTINCT place) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + 5)) AS place FROM (
 SELECT *, count(*) OVER (PARTITION BY rid, five) AS n FROM windows) WHERE n > 1) GROUP BY rid),
base AS (SELECT c.* EXCLUDE (words), chars - ({_KNOWN}) AS c6, chars - c3 AS word_chars, coalesce(l.n_dup_lines, 0) AS n_dup_lines,
 coalesce(r.n_repeat_words, 0) AS n_repeat_words FROM counted c LEFT JOIN lines l USING (rid) LEFT JOIN repeated r USING (rid)),
short AS (SELECT rid, lang, translate(word, '{_UPPER}', '{_LOWER}') AS word, count(*) AS n FROM (SELECT rid, lang, unnest(words) AS word FROM counted)
 WHERE length(word) <= 5 GROUP BY ALL),
good0 AS (SELECT * FROM base WHERE n_words >= 10),{_references(1, "good0")},{_references(2, "good1")}
SELECT d.doc_id, d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words,
 d.n_words < 10 OR 100 * d.n_repeat_words > 20 * d.n_words AS base_failed,
 NOT (d.n_words < 10 OR 100 * d.n_repeat_words > 20 * d.n_words) AND coalesce(b.close, true) AS kept,
 round(b.nearest.of_class, 6) AS class_distance, round(b.nearest.of_word, 6) AS word_distance, b.nearest.ref AS nearest
FROM base d LEFT JOIN best2 b USING (rid)
"""

# Sources that are filled to their limit have the lowest levels (limit * size / weight); the water
# line is where the rest of the budget meets the weights of the others.
OP10 = r"""
WITH m AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  0.05 + 0.95 * pow(1 - (strlen(coalesce(text, '')) - strlen(regexp_replace(coalesce(text, ''), '[#*$%&|<>!{}\[\]\\^~_=+@]', '', 'g')))
   / greatest(strlen(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')), 1)::DOUBLE, 2) AS weight,
  (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT + 0.5) / 281474976710656.0 AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, list_extract([5.0, 2.0, 1.0], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER)::DOUBLE AS w FROM m GROUP BY source),
l AS (SELECT *, 2 * source_size / w AS level, (1.5 * sum(source_size) OVER ())::DOUBLE AS total,
  (sum(2 * source_size) OVER (ORDER BY 2 * source_size / w RANGE UNBOUNDED PRECEDING EXCLUDE GROUP))::DOUBLE AS filled,
  sum(w) OVER (ORDER BY 2 * source_size / w RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w FROM s),
line AS (SELECT coalesce(arg_min((total - coalesce(filled, 0)) / open_w, level) FILTER ((total - coalesce(filled, 0)) / open_w <= level), max(level)) AS t FROM l),
g AS (SELECT source, source_size, least(2.0 * source_size, (SELECT t FROM line) * w) AS target FROM l),
r AS (SELECT m.*, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END AS epochs,
  sum(size) OVER (PARTITION BY m.source ORDER BY -ln(u) / weight, doc_id) - size AS ahead FROM m JOIN g ON m.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, source, size, source_size, target,
 (size * (epochs + CASE WHEN target > epochs * source_size AND target - epochs * source_size - ahead >= size / 2.0 THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""

#: Cosine of all pairs of a label, then the smallest id over the links. Vectors without a direction take no part.
OP12 = """
WITH RECURSIVE usable AS MATERIALIZED (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
    AND len(list_filter(embedding, lambda v: v <> 0)) > 0
), pairs AS MATERIALIZED (
  SELECT p.vec_id AS a, q.vec_id AS b FROM usable p JOIN usable q USING (label)
  WHERE p.vec_id <> q.vec_id AND len(p.x) = len(q.x)
    AND list_inner_product(p.x, q.x) / sqrt(list_inner_product(p.x, p.x) * list_inner_product(q.x, q.x)) >= 0.98
), reach AS (
  SELECT a, b FROM pairs
  UNION
  SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a
), least AS (SELECT a, min(b) AS b FROM reach GROUP BY a
), n AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(l.b, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(l.b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN least l ON l.a = e.vec_id
ORDER BY ALL
"""
