"""The SQL statements, for DuckDB, that the queries are held against."""

_WORDS = "CASE WHEN text IS NULL THEN []::VARCHAR[] ELSE regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') END"

QUALITY = rf"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
pos AS (SELECT rid, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8),
win AS (SELECT p.rid, p.i, md5(array_to_string(words[p.i:p.i + 7], ' ')) AS h FROM pos p JOIN w USING (rid)),
rep AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, h) > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, range(0, 8) r(k) GROUP BY rid),
ln AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM w),
dup AS (SELECT rid, count(*) AS lines, count(*) - count(DISTINCT line) AS n FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (
  SELECT doc_id, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
    coalesce(dup.lines, 0) AS n_lines
  FROM w LEFT JOIN dup USING (rid) LEFT JOIN cov USING (rid)),
j AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
f AS (
  SELECT source, rule, count(*) AS n, sum(bad::INT) AS f FROM (
    SELECT source, unnest([1, 2, 3, 4]) AS rule,
      unnest([n_words < 20, 100 * n_repeat_words > 30 * n_words, 10 * n_symbols > n_words, 100 * n_dup_lines > 30 * n_lines]) AS bad FROM j) GROUP BY ALL),
s AS (SELECT rule, count(*) AS hosts, sum(n)::DOUBLE AS n, sum(n::DOUBLE * n) AS nn, sum(f)::DOUBLE AS f, sum(f::DOUBLE * f / n) AS q FROM f GROUP BY rule),
p AS (SELECT rule, f / n AS mean, CASE WHEN f > 0 AND f < n THEN
    CASE WHEN n - nn / n - (hosts - 1) > 0 THEN ((q - f * f / n) / ((f / n) * (1 - f / n)) - (hosts - 1)) / (n - nn / n - (hosts - 1)) ELSE 0 END END AS r0 FROM s),
pr AS (SELECT rule, mean, CASE WHEN r0 IS NULL THEN 1.0 ELSE (1 - least(greatest(r0, 1e-6), 0.5)) / least(greatest(r0, 1e-6), 0.5) END AS strength FROM p),
h AS (SELECT source, bool_or((f.f + mean * strength) / (f.n + strength) > 0.7) AS host_failed FROM f JOIN pr USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_failed AS kept, host_failed
FROM j JOIN h ON j.source IS NOT DISTINCT FROM h.source
"""

NEAREST = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = 64),
u AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(e, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score FROM u q JOIN u c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank FROM d) WHERE rank <= 10
"""

SUBSTRINGS = rf"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS words FROM documents),
pos AS (SELECT rid, doc_id, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50),
win AS (SELECT p.rid, p.doc_id, p.i, md5(array_to_string(words[p.i:p.i + 49], ' ')) AS h FROM pos p JOIN w USING (rid)),
least AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT rid, i + k AS i FROM win JOIN least USING (h), range(0, 50) r(k) WHERE m < doc_id),
lists AS (SELECT rid, list(i) AS gone FROM gone GROUP BY rid),
k AS (SELECT doc_id, words, coalesce(gone, []) AS gone FROM w LEFT JOIN lists USING (rid))
SELECT doc_id, len(words)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
  sha256(array_to_string(list_filter(words, lambda x, i: NOT list_contains(gone, i)), ' ')) AS kept_sha256 FROM k
"""

NGRAM_JOIN = r"""
WITH RECURSIVE w AS (SELECT doc_id, CASE WHEN text IS NULL THEN []::VARCHAR[] ELSE
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') END AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS t FROM (SELECT doc_id, words, unnest(range(1, len(words) - 2)) AS i FROM w WHERE len(words) >= 4)
  UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM w WHERE len(words) BETWEEN 1 AND 3),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = w.doc_id
"""

DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT rid) >= 10),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
gn AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY ALL),
cl AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL),
ln AS (SELECT lang, sum(n)::HUGEINT AS total FROM cl GROUP BY lang),
q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (cl.n + 2) // (ln.total + 2 * v.v) AS q FROM cl JOIN ln USING (lang) JOIN v USING (lang)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(gn.total, 0) + 2 * v.v) AS p
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
  UNION ALL
  SELECT a.lang, a.source, 'pair', b.source, coalesce(s.value, 0)::BIGINT FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r QUALIFY part = 'pair' OR rank <= 10
"""

_FATE = """list_reduce([4294967295::BIGINT] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))"""

TURNS = rf"""
WITH RECURSIVE f AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor({_FATE}, 4294967295) % 20 AS fate FROM conversations),
x AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS time FROM f WHERE fate <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM x),
m AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS late, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM o),
r AS (SELECT *, blank OR again AS forced, (late AND NOT blank AND NOT again)::BIGINT AS extra, left(role, 1) AS e FROM m),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::INT) AS blank, sum((again AND NOT blank)::INT) AS duplicate,
    sum(extra) AS truncated, sum((pair NOT IN ('su', 'ua', 'au'))::INT) AS illegal FROM r GROUP BY conv_id),
dp AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS q, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS b FROM n
  UNION ALL
  SELECT conv_id, i, q, min(b) FROM (
    SELECT s.conv_id, s.i + 1 AS i, k.q,
      {{'c': s.b.c + 2 * s.ins + k.cost, 'a': s.b.a || repeat('I', s.ins) || k.edit,
       't': s.b.t || CASE WHEN s.ins = 0 THEN '' WHEN s.q0 = 2 THEN chr(10) || 'assistant:' ELSE chr(10) || 'user:' END
            || CASE WHEN s.ins < 2 THEN '' WHEN s.q0 = 2 THEN chr(10) || 'user:' ELSE chr(10) || 'assistant:' END
            || CASE k.edit WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || r.role || ':' || r.text ELSE chr(10) || CASE s.q WHEN 2 THEN 'assistant:' ELSE 'user:' END || r.text END}} AS b
    FROM (SELECT conv_id, i, b, dp.q AS q0, z.ins, CASE z.ins WHEN 0 THEN dp.q WHEN 1 THEN CASE dp.q WHEN 2 THEN 3 ELSE 2 END ELSE CASE dp.q WHEN 2 THEN 2 ELSE 3 END END AS q
          FROM dp, (VALUES (0), (1), (2)) z(ins)) s
    JOIN r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i + 1,
    LATERAL (SELECT unnest(['D', 'K', 'R']) AS edit, unnest([3, r.extra, 2 + r.extra]) AS cost,
      unnest([s.q, CASE WHEN r.e = 's' AND s.q = 0 THEN 1 WHEN r.e = 'u' AND s.q <> 2 THEN 2 WHEN r.e = 'a' AND s.q = 2 THEN 3 END, CASE s.q WHEN 2 THEN 3 ELSE 2 END]) AS q) k
    WHERE k.q IS NOT NULL AND (k.edit = 'D' OR NOT r.forced)) GROUP BY conv_id, i, q),
fin AS (
  SELECT conv_id, min(b) AS b FROM (
    SELECT dp.conv_id, {{'c': dp.b.c + 2 * z.ins, 'a': dp.b.a || repeat('I', z.ins), 't': dp.b.t || CASE z.ins WHEN 0 THEN '' WHEN 1 THEN chr(10) || 'assistant:' ELSE chr(10) || 'user:' || chr(10) || 'assistant:' END}} AS b
    FROM dp JOIN n ON n.conv_id IS NOT DISTINCT FROM dp.conv_id AND n.n = dp.i, (VALUES (0), (1), (2)) z(ins)
    WHERE z.ins = 0 AND dp.q IN (0, 3) OR z.ins = 1 AND dp.q = 2 OR z.ins = 2 AND dp.q IN (1, 3, 0)) GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(n.gaps, 0)::BIGINT AS gaps, coalesce(n.blank, 0)::BIGINT AS blank, coalesce(n.duplicate, 0)::BIGINT AS duplicate, coalesce(n.truncated, 0)::BIGINT AS truncated,
  coalesce(n.illegal, 0)::BIGINT AS illegal, coalesce(fin.b.c, 0)::BIGINT AS cost, coalesce(fin.b.a, '') AS audit, sha256(coalesce(fin.b.t[2:], '')) AS repaired_sha256
FROM ids LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN fin ON fin.conv_id IS NOT DISTINCT FROM ids.conv_id
"""

# The same join over five-word shingles, and which document of a component stays.
SKETCHED = NGRAM_JOIN.replace("words[i:i + 3]", "words[i:i + 4]").replace("len(words) - 2", "len(words) - 3").replace("len(words) >= 4", "len(words) >= 5").replace("BETWEEN 1 AND 3", "BETWEEN 1 AND 4").replace(
    "AS component_id\nFROM w", "AS component_id, w.doc_id = coalesce(c.component_id, w.doc_id) AS kept\nFROM w")
