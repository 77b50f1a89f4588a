"""DuckDB SQL of the operators' queries, where SQL can express them. Models, keyed hashes,
surrogates and merge tables have none; tests hold those against brute force."""

AZ = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACES = r"'[\x20\x09-\x0D]+'"

VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
w AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT w.vec_id, l.y FROM w JOIN l ON w.other = l.x),
c AS (SELECT vec_id, min(other) AS component_id FROM w GROUP BY 1),
n AS (SELECT x AS vec_id, count(*) AS n_links FROM l GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)"""

MINHASH = f"""
WITH RECURSIVE w AS (SELECT doc_id, [x FOR x IN string_split_regex({AZ}, {SPACES}) IF x <> ''] AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE [array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
k AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM k JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.other = l.x),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""

#: A ratio's bucket, in steps: fixed up to 4,096, then a 4,096th of the value wide.
_B = "({q} - {q} % (CASE WHEN {q} < 4096 THEN 1 ELSE 1 << CAST(length(bin({q})) - 12 AS INT) END))"
_RATIOS = {"symbols": "10000 * n_symbols // greatest(word_chars, 1)", "doubled": "1000 * n_dup_lines // greatest(n_lines, 1)", "length": "100 * word_chars // greatest(n_words, 1)"}
_Q = "list_sort(list({c}))[CAST((count(*) * {p} + 99) // 100 AS INT)]"


def _bars(c: str) -> str:
    q = {p: _Q.format(c=c, p=p) for p in (25, 50, 75, 90)}
    tail = f"{q[75]} - {q[25]}" if c == "length" else f"greatest({q[75]} - {q[25]}, {q[90]} - {q[50]})"
    return f"{q[25]} - 4 * ({q[75]} - {q[25]}) AS {c}_lo, {q[75]} + 4 * ({tail}) AS {c}_hi"


_BARS = ", ".join(map(_bars, _RATIOS))
_PICK = ", ".join(f"CASE WHEN o.n >= 100 THEN o.{c}_{n} WHEN h.n >= 100 THEN h.{c}_{n} ELSE g.{c}_{n} END AS {c}_{n}" for c in _RATIOS for n in ("lo", "hi"))
_IN = """10000 * n_symbols <= symbols_hi * word_chars + 30000 AND 1000 * n_dup_lines <= doubled_hi * n_lines + 3000
  AND 100 * word_chars // greatest(n_words, 1) BETWEEN length_lo - 300 / sqrt(greatest(n_words, 1)) AND length_hi + 300 / sqrt(greatest(n_words, 1))"""

RULES = rf"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, [x FOR x IN string_split_regex(coalesce(text, ''), {SPACES}) IF x <> ''] AS w,
  [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM documents),
g8 AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t WHERE len(w) >= 8)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g8) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY 1),
f AS (SELECT t.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words FROM t LEFT JOIN cov USING (doc_id)),
m AS (SELECT *, {", ".join(_B.format(q=f"({x})") + f" AS {c}" for c, x in _RATIOS.items())} FROM f),
u AS (SELECT * FROM m WHERE n_words >= 20),
o AS (SELECT lang, source, count(*) AS n, {_BARS} FROM u GROUP BY 1, 2), h AS (SELECT lang, count(*) AS n, {_BARS} FROM u GROUP BY 1), g AS (SELECT {_BARS} FROM u),
b AS (SELECT o.lang, o.source, {_PICK} FROM o JOIN h ON o.lang IS NOT DISTINCT FROM h.lang CROSS JOIN g)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND coalesce({_IN}, true) AS kept
FROM m LEFT JOIN b ON m.lang IS NOT DISTINCT FROM b.lang AND m.source IS NOT DISTINCT FROM b.source"""

CHAT = rf"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i,
  len([x FOR x IN string_split_regex(text, {SPACES}) IF x <> '']) + 4 AS cost,
  6 + length(role) + length(text) + (length(role || text) - length(translate(role || text, '\[]<', ''))) AS len FROM c),
p AS (SELECT *, sum(cost) OVER w AS upto, sum(cost) OVER w - cost AS before, count(*) OVER (PARTITION BY conv_id) AS n FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
g AS (SELECT conv_id, max(n) AS n, max(CASE WHEN i = 0 AND role = 'system' THEN 1 ELSE 0 END) AS head, max(CASE WHEN i = 0 AND role = 'system' THEN cost ELSE 0 END) AS top,
  max(CASE WHEN i = 0 AND role = 'system' THEN len ELSE 0 END) AS top_len FROM p GROUP BY 1),
st AS (SELECT conv_id, head AS a FROM g UNION ALL
  SELECT st.conv_id, min(q.i) FROM st JOIN g ON g.conv_id = st.conv_id JOIN p s ON s.conv_id = st.conv_id AND s.i = st.a
  JOIN p q ON q.conv_id = st.conv_id AND q.i > st.a AND q.upto - s.before > greatest(384 - g.top, 1) GROUP BY st.conv_id, st.a),
w AS (SELECT st.conv_id, a, coalesce(lead(a) OVER (PARTITION BY st.conv_id ORDER BY a), n) AS b, head, top_len FROM st JOIN g ON g.conv_id = st.conv_id),
h AS (SELECT w.conv_id, w.a, w.b, w.top_len, w.a - count(j.i) AS h FROM w LEFT JOIN p s ON s.conv_id = w.conv_id AND s.i = w.a
  LEFT JOIN p j ON j.conv_id = w.conv_id AND j.i >= w.head AND j.i < w.a AND s.before - j.before <= 128 GROUP BY w.conv_id, w.a, w.b, w.top_len),
f AS (SELECT conv_id, sum(chars) AS formatted_chars FROM (SELECT h.conv_id, h.a, 3 + h.top_len + coalesce(sum(p.len), 0) AS chars
  FROM h LEFT JOIN p ON p.conv_id = h.conv_id AND p.i >= h.h AND p.i < h.b GROUP BY h.conv_id, h.a, h.top_len) GROUP BY 1),
d AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS said, coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '') AS loss FROM t GROUP BY 1)
SELECT d.conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM d JOIN f USING (conv_id)"""

#: Bytes of an ASCII id and a run of letters, the checksum's table, and the run without a letter.
_BYTES = "flatten([CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [195, unicode(x) - 64] END FOR x IN string_split(doc_id || ':' || run, '')])"
_CRC = f"xor(4294967295, list_reduce(list_prepend(4294967295, [CAST(x AS BIGINT) FOR x IN {_BYTES}]), lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1])))"
#: Letters as ASCII, so that distances count code points.
_LATIN = "".join(map(chr, range(0xC0, 0x100)))
_ASCII = "".join(c for c in map(chr, range(33, 127)) if not c.islower() and c != "'")[: len(_LATIN)]
_NEAR = f"levenshtein(translate(a.word, '{_LATIN}', '{_ASCII}'), translate(b.word, '{_LATIN}', '{_ASCII}')) = 1"

VARIANTS = f"""
WITH RECURSIVE bits AS (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i)),
crcs AS (SELECT list(c ORDER BY i) AS crc FROM bits),
runs AS (SELECT doc_id, run, count(*) AS k FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id,
  unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY 1, 2),
sums AS MATERIALIZED (SELECT run, k, {_CRC} AS h FROM runs, crcs WHERE length(run) >= 6),
words AS (SELECT CASE WHEN h % 199 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, k FROM sums),
v AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM words WHERE length(word) >= 6 GROUP BY 1 HAVING sum(k) >= 5),
d AS (SELECT DISTINCT word, n, unnest(list_append([word[:i] || word[i + 2:] FOR i IN range(length(word))], word)) AS s FROM v),
near AS MATERIALIZED (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS m FROM d a JOIN d b ON a.s = b.s AND a.word <> b.word WHERE {_NEAR}),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, encode(other))) AS form, max(m) AS form_n FROM near GROUP BY 1),
f AS MATERIALIZED (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n FROM v LEFT JOIN best USING (word)),
up AS (SELECT word, word AS at FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, up.at AS root, f.n, f.n_near, f.form_n FROM f JOIN up ON up.word = f.word JOIN f AS t ON t.word = up.at WHERE t.form IS NULL"""

SUBSTRINGS = f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS id, [x FOR x IN string_split_regex(coalesce(text, ''), {SPACES}) IF x <> ''] AS w FROM documents),
g AS MATERIALIZED (SELECT r, id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT r, id, w, unnest(range(1, len(w) - 11)) AS i FROM w)),
first AS (SELECT g, min(id) AS id FROM g GROUP BY 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM g JOIN first USING (g) WHERE first.id < g.id),
n AS (SELECT r, count(*) AS n_removed, list(p) AS gone FROM gone GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN n.r IS NULL THEN array_to_string(w, ' ') ELSE coalesce(array_to_string([w[p] FOR p IN range(1, len(w) + 1) IF NOT list_contains(gone, p)], ' '), '') END) AS kept_sha256
FROM w LEFT JOIN n USING (r)"""


def _codes(rounds: int = 6) -> str:
    """The rounds one after the other: nearest entries, then their parts' floored means."""
    far = "list_sum([(x[j] - c[j]) * (x[j] - c[j]) FOR j IN range(1, len(x) + 1)])"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, p, any_value(x) AS x, arg_min(k, (far, k)) AS k, min(far) AS far FROM (SELECT r, x.p, k, x, {far} AS far FROM x JOIN b{i} b ON b.p = x.p) GROUP BY 1, 2)")
        if i < rounds:
            steps.append(f"""m{i} AS (SELECT p, k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM
  (SELECT p, k, j, CAST(sum(x[j]) AS BIGINT) AS s, count(*) AS n FROM (SELECT p, k, x, unnest(range(1, len(x) + 1)) AS j FROM a{i}) GROUP BY 1, 2, 3) GROUP BY 1, 2),
b{i + 1} AS MATERIALIZED (SELECT b.p, b.k, coalesce(m.c, b.c) AS c FROM b{i} b LEFT JOIN m{i} m ON m.p = b.p AND m.k = b.k)""")
    return f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, [CAST(floor(4096 * CAST(y AS DOUBLE)) AS BIGINT) FOR y IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([y FOR y IN embedding IF y IS NULL OR NOT isfinite(y)]) = 0),
x AS MATERIALIZED (SELECT r, p, e[p * (len(e) // 8) + 1:(p + 1) * (len(e) // 8)] AS x FROM (SELECT r, e, unnest(range(8)) AS p FROM v)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS k, x AS c FROM x WHERE r <= 16),
{", ".join(steps)},
sha AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM b{rounds}),
o AS (SELECT r, string_agg(format('{{:02x}}', k), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error FROM a{rounds} GROUP BY 1)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN o USING (r) CROSS JOIN sha"""


ORACLES = {"op11_variants": VARIANTS, "op12_substrings": SUBSTRINGS, "op13_codes": _codes(), "op6_chat": CHAT, "op4_vectors": VECTORS, "op5_minhash": MINHASH, "op8_rules": RULES}
