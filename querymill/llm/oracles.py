"""The queries of this subpackage in plain SQL, where SQL can express them.

Where a rule allows it the SQL goes another way than the operator: all pairs instead of MinHash, levels tried one by one
instead of prefixes, one recursive row instead of a fold. Missing are language labels, token counts and token
alignments, which need a trained model or a vocabulary.
"""

from __future__ import annotations

from querymill.llm import decontam, mixing, quality, secrets, sketches, spelling

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


MIX = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size,
    greatest(CAST(0.01 AS DOUBLE), coalesce(length(regexp_replace(text, '[^\p{{L}}]+', '', 'g')) / nullif(length(text), 0), CAST(0 AS DOUBLE))) AS quality,
    (CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '~') || '|' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) + 1) / CAST(4503599627370496 AS DOUBLE) AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS place FROM d GROUP BY source),
w AS (SELECT source, source_size, CAST(CASE place % 3 WHEN 1 THEN {mixing.CYCLE[0]} WHEN 2 THEN {mixing.CYCLE[1]} ELSE {mixing.CYCLE[2]} END AS DOUBLE) AS share, CAST(2 AS DOUBLE) * source_size AS cap FROM s),
-- a source is full if all sources together take no more than the budget at the level where it fills up
f AS (SELECT a.source, a.source_size, a.share, a.cap, (SELECT sum(least(b.cap, b.share * (a.cap / a.share))) <= CAST(1.5 AS DOUBLE) * sum(b.source_size) FROM w b) AS full_up FROM w a),
o AS (SELECT CAST(1.5 AS DOUBLE) * sum(source_size) - sum(CASE WHEN full_up THEN cap ELSE 0 END) AS open_words, sum(CASE WHEN full_up THEN 0 ELSE share END) AS open_shares FROM f),
t AS (SELECT source, source_size, CASE WHEN full_up THEN cap ELSE least(cap, share * open_words / nullif(open_shares, 0)) END AS target FROM f, o),
p AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
k AS (
  SELECT d.doc_id, d.size, d.source, p.source_size, p.target, p.epochs, CAST(round(p.target - p.epochs * p.source_size) AS BIGINT) AS rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(d.u) / d.quality, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + least(size, greatest(0, rest - before)) AS BIGINT) AS taken, source FROM k"""

ARCHIVE = rf"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, lower(url) AS u, sha1(coalesce(html, '')) AS h,
    strftime(make_timestamp((CAST(1700000000 AS BIGINT) + coalesce(page_id, 0)) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured FROM pages),
o AS (SELECT payload, min(page_id) AS origin FROM p GROUP BY payload),
k AS (
  SELECT *, string_split(regexp_extract(u, '^[a-z]+://([^/?#:]*)', 1), '.') AS host, regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS way, regexp_extract(u, '^[^?#]*(\?[^#]*)', 1) AS query
  FROM p JOIN o USING (payload))
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('{DIGITS}', CAST(((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = origin THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> origin THEN origin END AS refers_to,
  array_to_string(list_reverse(host), ',') || ')' || CASE way WHEN '' THEN '/' ELSE way END || CASE query WHEN '?' THEN '' ELSE query END AS urlkey, captured
FROM k"""


def _secrets() -> str:
    #: The base patterns as stated; short matches are dropped by length.
    stated = {"access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}
    parts = []
    for order, rule in enumerate(secrets.BASE + secrets.ADDED):
        pattern = quoted(stated.get(rule.kind, rule.pattern))
        parts.append(
            f"SELECT doc_id, {order} AS o, '{rule.kind}' AS kind, {rule.least} AS least, regexp_extract_all(text, {pattern}) AS m, regexp_extract_all(text, {pattern}, {rule.group}) AS g, string_split_regex(text, {pattern}) AS p FROM d"
        )
    base = ", ".join(f"'{r.kind}'" for r in secrets.BASE)
    spelled = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o)"
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
r AS ({" UNION ALL ".join(parts)}),
e AS (SELECT doc_id, o, kind, least, generate_subscripts(m, 1) AS i, unnest(m) AS hit, unnest(g) AS inner_part, unnest(p[:len(m)]) AS gap FROM r WHERE len(m) > 0),
f AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, o ORDER BY i) AS stop FROM e),
s AS (SELECT doc_id, o, kind, CAST(stop - length(hit) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM f WHERE length(inner_part) >= least),
a AS (SELECT doc_id, {counts}, {spelled} AS spans, {spelled} FILTER (kind IN ({base})) AS based FROM s GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"CAST(coalesce(n_{r.kind}, 0) AS BIGINT) AS n_{r.kind}" for r in secrets.BASE)}, sha256(coalesce(based, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a ON d.doc_id = a.doc_id"""


def _quality() -> str:
    symbols = quality.SYMBOLS
    rules = ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END" for bad, good in quality.RULES.values())
    j, q = len(quality.RULES), quality
    rates = lambda start: f"[{', '.join(f'CAST({x} AS DOUBLE)' for x in start * j)}]"
    # rates of vote i % 3 - 1 by rule i // 3, of all documents in proportion to their share in the class
    seen = lambda share, start: (
        f"list_transform(range(0, {3 * j}), lambda i: (list_sum(list_transform(post, lambda r: CASE WHEN r.v[i // 3 + 1] = i % 3 - 1 THEN {share} * r.n ELSE 0 END)) + {q.PSEUDO} * ({rates(start)})[i + 1]) "
        f"/ (list_sum(list_transform(post, lambda r: {share} * r.n)) + {q.PSEUDO}))"
    )
    return rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT row_no, generate_subscripts(w, 1) AS i, unnest(w) AS x FROM (SELECT row_no, {WORDS} AS w FROM d)),
g AS (SELECT row_no, i, count(*) OVER o AS width, string_agg(x, ' ') OVER o AS gram FROM w WINDOW o AS (PARTITION BY row_no ORDER BY i ROWS BETWEEN CURRENT ROW AND {q.WINDOW - 1} FOLLOWING)),
twice AS (SELECT row_no, i, count(*) OVER (PARTITION BY row_no, gram) AS seen FROM g WHERE width = {q.WINDOW}),
covered AS (SELECT row_no, count(*) AS n FROM (SELECT DISTINCT row_no, unnest(range(i, i + {q.WINDOW})) FROM twice WHERE seen > 1) GROUP BY row_no),
lines AS (SELECT row_no, count(*) AS n, count(DISTINCT x) AS n_different FROM (SELECT row_no, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY row_no),
f AS (
  SELECT d.row_no, d.doc_id, CAST(len({WORDS}) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^{symbols}]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(lines.n - lines.n_different, 0) AS BIGINT) AS n_dup_lines, coalesce(lines.n, 0) AS n_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, length(regexp_replace(text, '[^\p{{L}}]+', '', 'g')) AS n_letters, length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS n_capitals
  FROM d LEFT JOIN covered ON d.row_no = covered.row_no LEFT JOIN lines ON d.row_no = lines.row_no),
v AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, [{rules}] AS votes FROM f),
pats AS (SELECT list({{'v': votes, 'f': base_failed, 'n': n}} ORDER BY votes, base_failed) AS ps FROM (SELECT votes, base_failed, CAST(count(*) AS DOUBLE) AS n FROM v GROUP BY votes, base_failed)),
em(step, prior, good, bad, post) AS (
  SELECT 0, CAST({q.PRIOR} AS DOUBLE), {rates(q.ON_GOOD)}, {rates(q.ON_BAD)}, list_transform(ps, lambda r: {{'v': r.v, 'f': r.f, 'n': r.n, 'q': CAST(NULL AS DOUBLE)}}) FROM pats
  UNION ALL
  SELECT step + 1,
    CASE WHEN step % 2 = 0 THEN prior ELSE (list_sum(list_transform(post, lambda r: r.q * r.n)) + {q.PSEUDO * q.PRIOR}) / (list_sum(list_transform(post, lambda r: r.n)) + {q.PSEUDO}) END,
    CASE WHEN step % 2 = 0 THEN good ELSE {seen("r.q", q.ON_GOOD)} END,
    CASE WHEN step % 2 = 0 THEN bad ELSE {seen("(1 - r.q)", q.ON_BAD)} END,
    CASE WHEN step % 2 = 1 THEN post ELSE list_transform(post, lambda r: {{'v': r.v, 'f': r.f, 'n': r.n, 'q': CASE WHEN r.f THEN 0 ELSE
      1 / (1 + exp(-(ln(prior / (1 - prior)) + list_sum(list_transform(r.v, lambda x, i: ln(good[3 * i + x - 1] / bad[3 * i + x - 1])))))) END}}) END
  FROM em WHERE step < {2 * q.STEPS + 1}),
done AS (SELECT r.v AS votes, r.f AS failed, r.q AS p_good FROM (SELECT unnest(post) AS r FROM em WHERE step = {2 * q.STEPS + 1}))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND p_good >= 0.5 AS kept, round(p_good, 6) AS p_good FROM v JOIN done ON v.votes = done.votes AND v.base_failed = done.failed"""


JACCARD = rf"""
WITH RECURSIVE r AS (SELECT doc_id, {WORDS} AS w FROM documents),
t AS (SELECT array_to_string(w, ' ') AS k, any_value(w) AS w, min(doc_id) AS first_id, count(*) AS copies FROM r WHERE len(w) > 0 GROUP BY 1),
g AS (SELECT first_id, CASE WHEN len(w) < 5 THEN [k] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS grams FROM t),
e AS (SELECT first_id, len(grams) AS n, unnest(grams) AS gram FROM g),
pairs AS (SELECT a.first_id AS a, b.first_id AS b FROM e a JOIN e b ON a.gram = b.gram AND a.first_id <> b.first_id GROUP BY 1, 2 HAVING count(*) >= 0.8 * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9),
reach AS (SELECT a AS node, a AS root FROM pairs UNION SELECT p.b, x.root FROM reach x JOIN pairs p ON p.a = x.node WHERE x.root < p.b),
known AS (
  SELECT t.k, t.first_id, t.copies, coalesce((SELECT min(root) FROM reach WHERE node = t.first_id), t.first_id) AS class_id, (SELECT count(*) FROM pairs WHERE a = t.first_id) AS n_links FROM t)
SELECT r.doc_id, coalesce(known.class_id, r.doc_id) AS class_id, CAST(coalesce(known.copies, 1) AS BIGINT) AS copies, CAST(coalesce(known.n_links, 0) AS BIGINT) AS n_links
FROM r LEFT JOIN known ON array_to_string(r.w, ' ') = known.k"""

CALLS = """
WITH RECURSIVE t AS (SELECT conv_id, turn, text, role, coalesce(role = 'assistant', false) AS is_answer FROM conversations),
c AS (SELECT *, 'call-' || conv_id || '-' || turn AS call_id, length(text) AS chars FROM t WHERE NOT is_answer),
a AS (SELECT *, 'call-' || conv_id || '-' || (turn - 1) AS call_id FROM t WHERE is_answer),
-- every length of a way to a call
ways AS (SELECT DISTINCT conv_id, turn, 0 AS steps FROM c UNION SELECT n.conv_id, n.turn, steps + 1 FROM ways w JOIN c n ON n.conv_id = w.conv_id AND n.turn IN (w.turn + 1, w.turn + 2)),
deep AS (SELECT conv_id, turn, max(steps) AS level FROM ways GROUP BY 1, 2),
b AS (
  SELECT coalesce(c.conv_id, a.conv_id) AS conv_id, coalesce(c.call_id, a.call_id) AS call_id, coalesce(c.turn, a.turn) AS position, c.call_id IS NOT NULL AS is_call, a.call_id IS NOT NULL AS answered,
    CASE WHEN c.call_id IS NOT NULL THEN CASE WHEN coalesce(c.role = 'system', false) THEN 'instruct' ELSE 'ask' END END AS name, c.turn, c.text, c.chars, a.text AS content
  FROM c FULL JOIN a ON c.conv_id = a.conv_id AND c.call_id = a.call_id),
p AS (SELECT *, CASE WHEN NOT is_call THEN '' WHEN chars % 11 = 0 THEN 'no JSON object' ELSE concat_ws('; ', CASE WHEN name = 'instruct' THEN 'missing scope' END, CASE WHEN chars % 7 = 0 THEN 'missing text' END,
    CASE WHEN name = 'ask' AND chars % 5 = 0 THEN 'type of chars' END, CASE WHEN name = 'instruct' THEN 'unknown chars' END) END AS problems FROM b)
SELECT p.conv_id, call_id, position, coalesce(level, 0) AS level, CASE WHEN NOT is_call THEN 'orphan' WHEN answered THEN 'linked' ELSE 'unanswered' END AS status, problems, is_call AND problems = '' AS valid,
  '{"arguments":' || CASE WHEN NOT is_call THEN 'null' WHEN chars % 11 = 0 THEN '[' || p.turn || ']'
    ELSE '{"chars":' || CASE WHEN chars % 5 = 0 THEN '"' || chars || '"' ELSE CAST(chars AS VARCHAR) END || CASE WHEN chars % 7 = 0 THEN '' ELSE ',"text":' || CAST(to_json(text) AS VARCHAR) END || ',"turn":' || p.turn || '}' END
  || ',"id":' || CAST(to_json(call_id) AS VARCHAR) || ',"name":' || coalesce('"' || name || '"', 'null') || ',"result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || '}' AS json
FROM p LEFT JOIN deep ON is_call AND p.conv_id = deep.conv_id AND p.turn = deep.turn"""

LINES = r"""
WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line FROM d),
k AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w, array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' ') AS k FROM l),
f AS (SELECT k, min(row(doc_id, pos)) AS place, any_value(w) AS w, len(any_value(w)) AS n FROM k WHERE len(w) > 0 GROUP BY k),
h AS (
  SELECT k, place, w, n, unnest(list_distinct(['head ' || array_to_string(w[1:n // 2], ' '), 'tail ' || array_to_string(w[n - n // 2 + 1:n], ' '), 'head ' || array_to_string(w[1:(n - 1) // 2], ' '), 'tail ' || array_to_string(w[n - (n - 1) // 2 + 1:n], ' ')])) AS half
  FROM f WHERE n >= 8),
c AS (SELECT DISTINCT a.k, a.place, a.w AS x, b.w AS y, a.n AS nx, b.n AS ny, least(a.n, b.n) AS m FROM h a JOIN h b ON a.half = b.half AND b.place < a.place AND abs(a.n - b.n) <= 1),
-- one word apart: the equal words at both ends are all but one
near AS (
  SELECT DISTINCT k FROM c WHERE coalesce(list_position(list_transform(range(1, m + 1), lambda i: x[i] = y[i]), false) - 1, m)
    + coalesce(list_position(list_transform(range(0, m), lambda i: x[nx - i] = y[ny - i]), false) - 1, m) >= greatest(nx, ny) - 1),
v AS (
  SELECT k.doc_id, k.pos, k.line, len(k.w) > 0 AND row(k.doc_id, k.pos) > f.place AS equal, len(k.w) > 0 AND row(k.doc_id, k.pos) = f.place AND near.k IS NOT NULL AS close
  FROM k LEFT JOIN f ON k.k = f.k AND len(k.w) > 0 LEFT JOIN near ON near.k = f.k),
o AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (coalesce(equal, false)) AS n_exact, count(*) FILTER (coalesce(close, false)) AS n_near,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT coalesce(equal, false) AND NOT coalesce(close, false)), '') AS clean FROM v GROUP BY doc_id),
z AS (SELECT o.doc_id, n_lines, n_exact, n_near, CASE WHEN d.text IS NOT NULL THEN clean END AS clean FROM o JOIN d ON o.doc_id = d.doc_id)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_exact AS BIGINT) AS n_exact, CAST(n_near AS BIGINT) AS n_near, CAST(length(clean) AS BIGINT) AS clean_chars, md5(clean) AS clean_md5 FROM z"""


def _leaks() -> str:
    def seed(mask: str) -> str:
        picked = ", ".join(f"t[i + {k}]" for k, c in enumerate(mask) if c == "1")
        return f"array_to_string(['{mask}', {picked}], ' ')"

    span, over, misses = decontam.SPAN, decontam.OVERLAP, decontam.MISSES
    masks = ", ".join(seed(m) for m in decontam.MASKS)
    seeds = f"list_transform(range(1, len(t) - {span} + 2), lambda i: {{'at': i, 's': [{masks}]}})"
    token = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
    return rf"""
WITH d AS (SELECT doc_id, {token} AS t FROM documents),
b AS (SELECT item_id, {token} AS t FROM benchmark),
ds AS (SELECT doc_id, x.at AS at, unnest(x.s) AS seed FROM (SELECT doc_id, unnest({seeds}) AS x FROM d WHERE len(t) >= {span})),
bs AS (SELECT item_id, x.at AS at, unnest(x.s) AS seed FROM (SELECT item_id, unnest({seeds}) AS x FROM b WHERE len(t) >= {span})),
h AS (SELECT DISTINCT ds.doc_id, bs.item_id, ds.at - bs.at AS shift FROM ds JOIN bs ON ds.seed = bs.seed),
s AS (
  SELECT h.doc_id, h.item_id, least({over}, len(b.t)) AS size, list_transform(b.t, lambda x, j: CASE WHEN shift + j >= 1 AND d.t[shift + j] = x THEN 1 ELSE 0 END) AS same
  FROM h JOIN d ON h.doc_id = d.doc_id JOIN b ON h.item_id = b.item_id),
f AS (
  SELECT DISTINCT doc_id, item_id FROM s
  WHERE len(list_filter(range(1, len(same) - size + 2), lambda i: list_sum(same[i:i + size - 1]) >= size - size * {misses} // {over})) > 0),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM f GROUP BY doc_id)
SELECT d.doc_id, n.doc_id IS NOT NULL AS leaked, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items, '') AS items FROM d LEFT JOIN n ON d.doc_id = n.doc_id"""


LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# the checksum's table from its rule: eight steps of the polynomial 0xEDB88320 for each byte
SPELLING = rf"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(0, 8)), lambda v, k: CASE WHEN (v & 1) = 1 THEN xor(v >> 1, CAST(3988292384 AS BIGINT)) ELSE v >> 1 END) AS v FROM range(0, 256) r(i))),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all({LOWERED}, '{spelling.LETTERS}')) AS run FROM documents),
keyed AS (SELECT run, k, hex(encode(id || ':' || run)) AS x FROM (SELECT id, run, count(*) AS k FROM runs GROUP BY 1, 2)),
hashed AS (
  SELECT run, k, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, len(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), CAST(4294967295 AS BIGINT)) AS h FROM keyed, crc),
w AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT CASE WHEN h % {spelling.DROP} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed)
  WHERE length(word) >= {spelling.LEAST_CHARS} GROUP BY 1 HAVING sum(k) >= {spelling.LEAST_COUNT}),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
longer AS (SELECT DISTINCT a.word AS long_word, a.n AS long_n, w.word, w.n FROM cut a JOIN w ON a.rest = w.word),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION ALL SELECT word, long_word, long_n FROM longer UNION ALL SELECT long_word, word, n FROM longer),
best AS (SELECT word, other, m, n_near FROM (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS rn FROM near) WHERE rn = 1),
f AS (SELECT w.word, w.n, CASE WHEN m >= {spelling.RATIO} * w.n THEN other END AS form, CASE WHEN m >= {spelling.RATIO} * w.n THEN m END AS form_n, coalesce(n_near, 0) AS n_near FROM w LEFT JOIN best ON w.word = best.word),
walk AS (SELECT word, form AS place FROM f WHERE form IS NOT NULL UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.place WHERE f.form IS NOT NULL),
ends AS (SELECT walk.word, place AS root FROM walk JOIN f ON f.word = walk.place WHERE f.form IS NULL)
SELECT f.word, form, coalesce(root, f.word) AS root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM f LEFT JOIN ends ON f.word = ends.word"""

SKETCHES = rf"""
WITH RECURSIVE r AS (SELECT doc_id, regexp_extract_all(coalesce({LOWERED}, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT array_to_string(w, ' ') AS k, any_value(w) AS w, min(doc_id) AS first_id FROM r WHERE len(w) > 0 GROUP BY 1),
g AS (SELECT k, first_id, CASE WHEN len(w) < {sketches.N} THEN [k] ELSE list_distinct(list_transform(range(1, len(w) - {sketches.N - 2}), lambda i: array_to_string(w[i:i + {sketches.N - 1}], ' '))) END AS grams FROM t),
e AS (SELECT first_id, len(grams) AS n, unnest(grams) AS gram FROM g),
pairs AS (SELECT a.first_id AS a, b.first_id AS b FROM e a JOIN e b ON a.gram = b.gram AND a.first_id <> b.first_id GROUP BY 1, 2 HAVING 100 * count(*) >= {sketches.PERCENT} * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT a AS node, a AS root FROM pairs UNION SELECT p.b, x.root FROM reach x JOIN pairs p ON p.a = x.node WHERE x.root < p.b),
least AS (SELECT node, min(root) AS root FROM reach GROUP BY 1),
known AS (SELECT k, len(grams) AS n, coalesce(root, first_id) AS component_id FROM g LEFT JOIN least ON node = first_id),
z AS (SELECT doc_id, coalesce(n, 0) AS n, coalesce(component_id, doc_id) AS component_id FROM r LEFT JOIN known ON len(r.w) > 0 AND array_to_string(r.w, ' ') = known.k)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM z"""

ORACLES: dict[str, str] = {
    "op1_mix_sources": MIX,
    "op2_warc_index": ARCHIVE,
    "op3_secret_scan": _secrets(),
    "op4_quality_rules": _quality(),
    "op5_ngram_jaccard": JACCARD,
    "op7_tool_calls": CALLS,
    "op9_line_dedup": LINES,
    "op10_decontaminate": _leaks(),
    "op11_spelling_variants": SPELLING,
    "op13_bottom_k_dedup": SKETCHES,
}
