"""The DuckDB SQL of the queries that SQL can express."""

from attestor.llm import urlfilter

LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS k, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
owner AS (SELECT key, min(doc_id) AS holder FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT k.*, o.holder IS NOT NULL AND o.holder <> k.doc_id AS gone FROM keyed k LEFT JOIN owner o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

_WORDS = r"""regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS window
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
found AS (
  SELECT p.doc_id, p.i, x.m, x.item_id
  FROM (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS window
        FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i
              FROM d CROSS JOIN (SELECT DISTINCT m FROM windows) WHERE len(w) >= m)) p
  JOIN windows x ON x.m = p.m AND x.window = p.window),
hits AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)"""

WARC = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM r"""

CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<turn ' || role || '>' || text || '</turn>' || chr(10))
    + length(regexp_replace(role || text, '[^<>\\]', '', 'g'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') AS shingle
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y, nx.n AS n_x, ny.n AS n_y, shared FROM o JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id
      WHERE 100 * shared >= 85 * (nx.n + ny.n - shared)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
same AS (SELECT doc_id, md5(string_agg(shingle, chr(10) ORDER BY shingle)) AS set_id FROM s GROUP BY doc_id),
links AS (SELECT e.x AS doc_id, count(DISTINCT b.set_id) AS n_links FROM e JOIN same a ON a.doc_id = e.x JOIN same b ON b.doc_id = e.y
          WHERE a.set_id <> b.set_id GROUP BY 1),
reach AS (SELECT doc_id AS node, doc_id AS root FROM d UNION SELECT e.y, r.root FROM reach r JOIN e ON e.x = r.node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.root) AS component_id, coalesce(max(links.n_links), 0) AS n_links
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN links USING (doc_id) JOIN reach r ON r.node = d.doc_id GROUP BY 1, 2"""


def _level(level: str, above: list[str], weight: str) -> str:
    """One level of the hierarchical budget: b_<level> with the budget of each node."""
    path = ", ".join([*above, level])
    by = ", ".join(above) or "1"
    source = (f"(SELECT n.*, b.budget FROM n_{level} n JOIN b_{above[-1]} b USING ({', '.join(above)}))" if above else
              "(SELECT *, CAST(floor(sum(tokens) OVER () * 0.5) AS DOUBLE) AS budget FROM n_domain)")
    return f"""
n_{level} AS (SELECT {path}, sum(tokens) AS tokens, CAST(sum(tokens) * 3 AS DOUBLE) AS capacity, CAST({weight} AS DOUBLE) AS weight
  FROM leaf GROUP BY {path}),
l_{level} AS (
  SELECT *, (budget - coalesce(sum(capacity) OVER before, 0)) / (sum(weight) OVER whole - coalesce(sum(weight) OVER before, 0)) AS level
  FROM {source}
  WINDOW whole AS (PARTITION BY {by}),
    before AS (PARTITION BY {by} ORDER BY capacity / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r_{level} AS (SELECT *, capacity <= level * weight AS is_full FROM l_{level}),
b_{level} AS (
  SELECT {path}, CASE WHEN is_full THEN capacity
    ELSE first_value(level) OVER (PARTITION BY {by} ORDER BY is_full, capacity / weight, {level}) * weight END AS budget
  FROM r_{level})"""


MIXING = rf"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens,
    TRY_CAST(nullif(regexp_extract(source, '^src([0-9]{{1,4}})$', 1), '') AS INT) // 5 AS k FROM documents),
docs AS (SELECT doc_id, CASE k WHEN 0 THEN 'web' WHEN 1 THEN 'books' WHEN 2 THEN 'code' WHEN 3 THEN 'news' ELSE 'other' END AS domain,
    lang, source, tokens FROM w),
leaf AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens FROM docs GROUP BY ALL),
{_level("domain", [], "CASE domain WHEN 'web' THEN 4 WHEN 'books' THEN 3 WHEN 'code' THEN 2 ELSE 1 END")},
{_level("lang", ["domain"], "CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END")},
{_level("source", ["domain", "lang"], "1")},
t AS (SELECT l.*, CAST(floor(b.budget) AS BIGINT) AS target,
    CASE WHEN tokens > 0 THEN CAST(floor(b.budget) AS BIGINT) // tokens ELSE 0 END AS whole
  FROM leaf l JOIN b_source b USING (domain, lang, source)),
placed AS (SELECT d.*, t.whole, t.target - t.whole * t.tokens AS missing FROM docs d JOIN t USING (domain, lang, source)),
part AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source
    ORDER BY md5('17:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), tokens ROWS UNBOUNDED PRECEDING) AS upto
  FROM placed WHERE missing > 0)
SELECT doc_id, domain, lang, source, tokens, CAST(epoch AS INTEGER) AS epoch
FROM (SELECT *, unnest(range(0, whole)) AS epoch FROM placed WHERE whole > 0)
UNION ALL SELECT doc_id, domain, lang, source, tokens, CAST(whole AS INTEGER) FROM part WHERE upto <= missing"""

RULES = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, w[i:i + 2] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM windows),
repeated AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM again WHERE c > 1) GROUP BY doc_id),
f AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words
  FROM d LEFT JOIN repeated USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR 5 * n_dup_lines > n_words
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM f"""


_A_TO_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_LINK = r"""[\x09-\x0D\x20][hH][rR][eE][fF][\x09-\x0D\x20]*=[\x09-\x0D\x20]*["'']?[\x09-\x0D\x20]*(?:[hH][tT][tT][pP][sS]?:)?//([^/?#"''<>\x09-\x0D\x20]+)"""


def _round(i: int) -> str:
    return f"""
r{i} AS MATERIALIZED (SELECT side, host, CAST(sum(x) AS BIGINT) AS x FROM (
  SELECT side, host, x FROM seed
  UNION ALL SELECT a.side, a.dst, CAST(CAST(x AS HUGEINT) * w * {urlfilter.DAMPING} // (out * 100) AS BIGINT)
  FROM arcs a JOIN r{i - 1} r ON r.side = a.side AND r.host = a.src) GROUP BY ALL)"""


URL_FILTER = rf"""
WITH cut AS (
  SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parted AS (SELECT page_id, html, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM cut),
p AS (SELECT page_id, html, translate(raw, {_A_TO_Z}) AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM parted),
q AS MATERIALIZED (SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM p),
ruled AS MATERIALIZED (SELECT *, CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS verdict FROM q),
shares AS MATERIALIZED (SELECT host, count(*) FILTER (WHERE verdict = 'allow') * {urlfilter.UNIT} // count(*) AS trust,
    count(*) FILTER (WHERE verdict = 'block') * {urlfilter.UNIT} // count(*) AS distrust FROM ruled WHERE host <> '' GROUP BY host),
seed AS MATERIALIZED (SELECT 0 AS side, host, trust AS x FROM shares WHERE trust > 0 UNION ALL SELECT 1, host, distrust FROM shares WHERE distrust > 0),
links AS (SELECT src, dst, count(*) AS w FROM (
    SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(html, '{_LINK}', 1), lambda h: translate(h, {_A_TO_Z})))) AS dst
    FROM ruled WHERE host <> '') WHERE src <> dst GROUP BY ALL),
hosts AS MATERIALIZED (SELECT host FROM shares UNION SELECT dst FROM links),
kin AS (SELECT DISTINCT array_to_string(labels[up:], '.') AS low, array_to_string(labels[up + 1:], '.') AS high
  FROM (SELECT string_split(host, '.') AS labels, unnest(range(1, len(string_split(host, '.')) - 1)) AS up
        FROM hosts WHERE length(host) BETWEEN 1 AND {urlfilter.LONGEST_HOST})),
edges AS (SELECT src, dst, sum(w) AS w FROM (SELECT * FROM links UNION ALL SELECT low, high, {urlfilter.KIN} FROM kin
    UNION ALL SELECT high, low, {urlfilter.KIN} FROM kin) GROUP BY ALL),
sided AS (SELECT 0 AS side, src, dst, w FROM edges UNION ALL SELECT 1, dst, src, w FROM edges),
arcs AS MATERIALIZED (SELECT *, sum(w) OVER (PARTITION BY side, src) AS out FROM sided),
r0 AS (SELECT * FROM seed),{",".join(_round(i) for i in range(1, urlfilter.rounds() + 1))},
scores AS (SELECT host, CAST(coalesce(sum(x) FILTER (WHERE side = 0), 0) AS BIGINT) AS trust,
    CAST(coalesce(sum(x) FILTER (WHERE side = 1), 0) AS BIGINT) AS distrust FROM r{urlfilter.rounds()} GROUP BY host)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN distrust - trust >= {urlfilter.THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
FROM ruled LEFT JOIN scores USING (host)"""

# crc32 of a text by half bytes; the table holds the remainders of the sixteen half bytes
_CRC = """xor(list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c) & 15, ascii(c) >> 4])),
    lambda acc, x: xor(acc >> 4, ([0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
      3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108])[CAST(xor(acc, x) & 15 AS BIGINT) + 1]),
    CAST(4294967295 AS BIGINT)), 4294967295)"""

PERIODIC_RUNS = rf"""
WITH d AS (SELECT doc_id, {_CRC} AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT *, h // 10 AS g, CAST(len(w) AS BIGINT) AS n FROM d),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM g),
t AS MATERIALIZED (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i:
    CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) END AS w FROM a),
f AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i - 3:i + 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(4, n)) AS i FROM t WHERE n > 5)),
m AS (SELECT x.doc_id, x.i, x.i - y.i AS q FROM f x JOIN f y ON x.doc_id = y.doc_id AND x.s = y.s AND x.i > y.i),
island AS (SELECT doc_id, q, min(i) - 4 - q AS start, max(i) + 1 AS stop
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM m) GROUP BY doc_id, q, k),
runs AS MATERIALIZED (SELECT doc_id, start, stop - start AS length, min(q) AS period FROM island
  WHERE stop - start >= greatest(6, 4 * q) GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS k FROM runs) WHERE k = 1),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS l FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS l
  FROM (SELECT doc_id, unnest(range(n)) AS i, unnest(w) AS word FROM t) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
  sha256(coalesce(listed.l, '')) AS runs_sha256, sha256(coalesce(kept.l, '')) AS collapsed_sha256
FROM t LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)"""
