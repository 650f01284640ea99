"""Oracle SQL (DuckDB) of the operators that SQL can express over whole tables, written plainly."""

from __future__ import annotations

#: Least label over links by repeated steps: a row (id, label) per node and round until nothing changes.
_COMPONENTS = """
reach(id, label) AS (
  SELECT id, id FROM nodes
  UNION
  SELECT e.b, r.label FROM reach r JOIN edges e ON e.a = r.id),
least_of AS (SELECT id, min(label) AS least FROM reach GROUP BY id)"""

JACCARD = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
distinct_sets AS (SELECT min(doc_id) AS id, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
tokens AS (SELECT id, len(s) AS n, unnest(s) AS t FROM distinct_sets),
pairs AS (SELECT x.id AS a, y.id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS n_both FROM tokens x JOIN tokens y ON x.t = y.t AND x.id < y.id GROUP BY x.id, y.id),
linked AS (SELECT a, b FROM pairs WHERE 100 * n_both >= 75 * (na + nb - n_both)),
edges AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
nodes AS (SELECT id FROM distinct_sets),
{_COMPONENTS}
SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(least, doc_id) AS component_id
FROM sets LEFT JOIN distinct_sets d ON len(sets.s) > 0 AND list_sort(sets.s) = d.s LEFT JOIN least_of ON least_of.id = d.id"""

EMBEDDINGS = f"""
WITH RECURSIVE usable AS (
  SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
linked AS (SELECT x.id AS a, y.id AS b FROM usable x JOIN usable y ON x.id < y.id AND len(x.v) = len(y.v)
  WHERE list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v))) >= 0.9),
edges AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
nodes AS (SELECT vec_id AS id FROM embeddings),
degree AS (SELECT a AS id, count(*) AS n FROM edges GROUP BY a),
{_COMPONENTS}
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least AS component_id, vec_id = least AS kept
FROM embeddings JOIN least_of ON least_of.id = vec_id LEFT JOIN degree ON degree.id = vec_id"""

WARC = """
WITH payloads AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
digests AS (SELECT page_id, payload_bytes, array_to_string(list_transform(generate_series(0, 31), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest FROM payloads),
last AS (SELECT payload_digest, max(page_id) AS top FROM digests GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to
FROM digests JOIN last USING (payload_digest)"""

#: Macros' bodies: the unsigned checksum of a decimal number, bit by bit, and a field with its length.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda c, bit: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)), 4294967295)"""


def _framed(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR)::VARCHAR || ':' || ({value})::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_framed(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


MERKLE = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, row_number() OVER () AS id, source, {_leaf("text")} AS leaf,
    CASE WHEN coalesce({_CRC} % 2 = 0, false) THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS tampered FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM docs),
nodes(level, source, idx, n, h) AS (
  SELECT 0, source, idx, n, leaf FROM placed
  UNION ALL
  SELECT level + 1, source, idx // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY level, source, idx // 3),
subroots AS (SELECT source, h, level, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper_nodes(level, idx, n, h) AS (
  SELECT 0, idx, n, h FROM subroots
  UNION ALL
  SELECT level + 1, idx // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM upper_nodes WHERE n > 1 GROUP BY level, idx // 3),
steps AS (
  SELECT p.id, x.level, string_agg(x.h, '' ORDER BY x.idx) FILTER (x.idx < own) AS before, string_agg(x.h, '' ORDER BY x.idx) FILTER (x.idx > own) AS after
  FROM (SELECT id, source, level, idx // (3 ** level)::BIGINT AS own FROM placed, (SELECT DISTINCT level FROM nodes)) p
  JOIN nodes x ON x.level = p.level AND x.source IS NOT DISTINCT FROM p.source AND x.n > 1 AND x.idx // 3 = own // 3 GROUP BY p.id, x.level
  UNION ALL
  SELECT p.id, 1000 + x.level, string_agg(x.h, '' ORDER BY x.idx) FILTER (x.idx < own), string_agg(x.h, '' ORDER BY x.idx) FILTER (x.idx > own)
  FROM (SELECT placed.id, l.level, subroots.idx // (3 ** l.level)::BIGINT AS own FROM placed JOIN subroots ON subroots.source IS NOT DISTINCT FROM placed.source, (SELECT DISTINCT level FROM upper_nodes) l) p
  JOIN upper_nodes x ON x.level = p.level AND x.n > 1 AND x.idx // 3 = own // 3 GROUP BY p.id, x.level),
proofs AS (SELECT id, list(struct_pack(b := coalesce(before, ''), a := coalesce(after, '')) ORDER BY level) AS path FROM steps GROUP BY id),
folded AS (
  SELECT doc_id, leaf, s.h AS subroot, (SELECT h FROM upper_nodes WHERE n = 1) AS root, sha256(coalesce(array_to_string(list_transform(path, lambda x: x.b || x.a), ''), '')) AS proof_sha256,
    list_reduce(list_concat([tampered], list_transform(coalesce(path, []), lambda x: x.b || '|' || x.a)), lambda h, x: sha256(replace(x, '|', h))) AS folded_root
  FROM placed JOIN subroots s ON s.source IS NOT DISTINCT FROM placed.source LEFT JOIN proofs ON proofs.id = placed.id)
SELECT *, folded_root = root AS verified FROM folded"""

PERIODS = rf"""
WITH texts AS (
  SELECT doc_id, row_number() OVER () AS id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, coalesce({_CRC}, 1) AS h FROM documents),
sized AS (SELECT *, len(w)::BIGINT AS n, h // 10 AS g FROM texts),
planted AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a FROM sized),
tailed AS (SELECT doc_id, id, n, list_transform(generate_series(0, n - 1), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) AS w FROM planted),
words AS (SELECT id, n, unnest(w) AS word, unnest(generate_series(0, n - 1)) AS i FROM tailed),
equal AS (SELECT x.id, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.id = y.id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT id, q, min(i) AS a, max(i) + 1 + q AS e FROM (SELECT id, q, i, i - row_number() OVER (PARTITION BY id, q ORDER BY i) AS island FROM equal) GROUP BY id, q, island),
large AS (SELECT * FROM islands WHERE e - a >= greatest(6, 4 * q)),
runs AS (SELECT * FROM large x WHERE NOT EXISTS (SELECT 1 FROM large y WHERE y.id = x.id AND y.q < x.q AND x.q % y.q = 0 AND y.a <= x.a AND y.e >= x.e)),
per_doc AS (
  SELECT id, count(*) AS n_runs, first(struct_pack(a := a, l := e - a, q := q) ORDER BY e - a DESC, a, q) AS best, string_agg(a || ',' || (e - a) || ',' || q || chr(10), '' ORDER BY a, q) AS said FROM runs GROUP BY id),
dropped AS (SELECT DISTINCT id, unnest(generate_series(a + q, e - 1)) AS i FROM runs),
kept AS (SELECT words.id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN dropped USING (id, i) GROUP BY words.id)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.a::BIGINT AS start, best.l::BIGINT AS length, best.q::BIGINT AS period, (1000 * best.l // best.q)::BIGINT AS exponent_milli,
  sha256(coalesce(said, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM tailed LEFT JOIN per_doc USING (id) LEFT JOIN kept USING (id)"""
