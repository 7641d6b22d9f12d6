"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from waylens.llm.sharding import PRIME, ROUNDS

#: Words of a text; a class of code points written out, as every SQL reads it alike.
WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

MIXING = rf"""
WITH w AS (SELECT doc_id, source, len({WORDS}) AS size, len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>!]')) AS marks FROM documents),
d AS (SELECT doc_id, source, size, greatest(1, CAST(ceil(20 * (1 - CASE WHEN size > 0 THEN least(1.0::DOUBLE, marks::DOUBLE / size) ELSE 1.0::DOUBLE END)) AS INT)) AS level,
  md5('1:' || coalesce(CAST(doc_id AS VARCHAR), '~') || ':' || size) AS key FROM w),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
r AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM s),
f AS (SELECT *, 3 * source_size AS cap, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS free,
  sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, row_number() OVER o AS place FROM r WINDOW o AS (ORDER BY 3 * source_size / weight, i)),
e AS (SELECT min(place) AS place FROM f WHERE free * weight <= cap * rest),
t AS (SELECT f.source, f.source_size, CASE WHEN f.place < e.place THEN f.cap::DOUBLE ELSE CAST(g.free AS DOUBLE) * f.weight / CAST(g.rest AS DOUBLE) END AS target FROM f, e JOIN f g ON g.place = e.place),
k AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS epochs,
  -ln((CAST('0x' || substr(d.key, 1, 13) AS BIGINT) + 0.5) / 4503599627370496) * 20 / level AS draw FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM k),
q AS (SELECT *, CASE WHEN size > 0 AND 2 * prior + size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END AS picked FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST((epochs + picked) * size AS BIGINT) AS taken, epochs, CAST(picked AS BIGINT) AS picked FROM q"""

WARC = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
g AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(h, 1 + 5 * i, 5) AS BIGINT)) AS parts FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_reduce(list_transform(parts, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 15) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 10) & 31) + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v & 31) + 1, 1)), lambda a, b: a || b) AS payload_digest,
  CASE WHEN page_id = first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first OR (page_id IS NULL AND first IS NOT NULL) THEN first END AS refers_to FROM g"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.replace("coalesce(text, '')", f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
  ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS set FROM w),
u AS (SELECT doc_id, unnest(set) AS x FROM s),
n AS (SELECT doc_id, len(set) AS n FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT s.doc_id, CAST(len(set) AS BIGINT) AS n_shingles, m.component_id FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY 1) m ON m.a = s.doc_id"""


def sharding(n_shards: int = 40, seed: int = 20240607) -> str:
    """The permutation's sides follow from the number of rows; a recursion walks the cycles."""
    def round_of(i: int, half: str) -> str:
        factor, add = ROUNDS[i]
        once = f"((({half} + {(seed + i) % PRIME}) * {factor} + {add}) % {PRIME})"
        return f"(({once} * {once} + {add * 7919}) % {PRIME})"

    def step(x: str, source: str) -> str:
        inner = f"SELECT *, {x} // b AS l0, {x} % b AS r0 FROM {source}"
        inner = f"SELECT *, (l0 + {round_of(0, 'r0')}) % a AS l1 FROM ({inner})"
        inner = f"SELECT *, (r0 + {round_of(1, 'l1')}) % b AS r2 FROM ({inner})"
        inner = f"SELECT *, (l1 + {round_of(2, 'r2')}) % a AS l3 FROM ({inner})"
        inner = f"SELECT *, (r2 + {round_of(3, 'l3')}) % b AS r4 FROM ({inner})"
        return f"SELECT row_number, n, a, b, l3 * b + r4 AS p FROM ({inner})"

    return f"""
WITH RECURSIVE size AS (SELECT n, a, greatest(1, (n + a - 1) // a) AS b FROM (SELECT n, CAST(ceil(sqrt(n)) AS BIGINT) AS a FROM (SELECT count(*) AS n FROM documents))),
d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 16 AS size, coalesce(text, '') AS text,
  row_number() OVER (ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '~') || ':' || coalesce(md5(text), '~')), doc_id) - 1 AS row_number FROM documents),
start AS (SELECT row_number, n, a, b FROM d, size),
walk AS ({step("row_number", "start")} UNION ALL {step("p", "(SELECT * FROM walk WHERE p >= n)")}),
{CRC}
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, crc.text_crc32, 'rows' AS law, CAST(w.p % {n_shards} AS INT) AS shard, w.p // {n_shards} AS slot, CAST(NULL AS INT) AS grown_shard, d.row_number, w.p AS place
FROM d JOIN walk w USING (row_number) JOIN crc USING (row_number) WHERE w.p < w.n"""


#: CRC-32 byte by byte over a table made by the usual rule.
CRC = """bits AS (SELECT i, CAST(i AS BIGINT) AS v, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
crc AS (SELECT row_number, xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda v: CAST('0x' || v AS BIGINT)),
  lambda c, x: xor(c >> 8, t[CAST((xor(c, x) & 255) + 1 AS INT)]), 4294967295)) AS text_crc32 FROM d, tab)"""

IMPORTANCE = r"""
WITH RECURSIVE bits AS (SELECT i, CAST(i AS BIGINT) AS v, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'UPPER', 'LOWER'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'UPPER', 'LOWER'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
c AS (SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(w)), '..'), lambda v: CAST('0x' || v AS BIGINT))),
  lambda c, x: xor(c >> 8, t[CAST((xor(c, x) & 255) + 1 AS INT)]))) % 10000 AS bucket FROM (SELECT w FROM d UNION SELECT w FROM b), tab),
s AS (SELECT bucket, count(*) AS s FROM d JOIN c USING (w) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM b JOIN c USING (w) GROUP BY 1),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM d) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM b) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM (SELECT DISTINCT bucket FROM c) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
f AS (SELECT doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM d JOIN c USING (w) JOIN g USING (bucket) GROUP BY 1),
e AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM documents LEFT JOIN f USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, (SELECT count(*) FROM e WHERE n_features >= 20) * 10 // 100 AS most FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= most THEN place END AS rank FROM r""".replace("UPPER", UPPER).replace("LOWER", LOWER)
