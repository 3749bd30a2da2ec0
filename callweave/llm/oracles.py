"""DuckDB SQL for the training-data queries that SQL can express.

Each is the plain form of the result: all quotients are listed, all pairs compared. Learned
models, tokenizers and files (operators 1 to 6) have none; tests compare them with
brute-force versions and with the tokenizers library.
"""

from __future__ import annotations

from callweave.llm import op07_mixing as mixing
from callweave.llm import op12_vector_codes as codes
from callweave.llm import op13_topk as topk
from callweave.llm.op09_minhash import SIMILARITY
from callweave.llm.op08_embeddings import COSINE

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
B = mixing.BLOCK


def seats(parties: str, group: str, key: str, weight: str, total: str) -> str:
    """Seats won by the highest quotients, listing every quotient that could win one."""
    part = f"PARTITION BY {group} " if group else ""
    return f"""SELECT * EXCLUDE (q, place), count(*) FILTER (WHERE place <= {total} AND {weight} > 0) AS seats FROM (
      SELECT *, row_number() OVER ({part}ORDER BY {weight} > 0 DESC, {weight} / (2 * q + 1) DESC, {key} ASC NULLS LAST) AS place
      FROM (SELECT *, unnest(range(greatest({total}, 1))) AS q FROM {parties})) GROUP BY ALL"""


MIX = rf"""
WITH sizes AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size, md5(coalesce(text, '')) AS print FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
s1 AS (SELECT *, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight,
       {mixing.MOST}::DOUBLE * source_size AS cap, {mixing.SHARE}::DOUBLE * sum(source_size) OVER () AS total FROM s0),
s2 AS (SELECT *, cap / weight AS room, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS nth FROM s1),
s3 AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
       / sum(weight) OVER (ORDER BY nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2),
s4 AS (SELECT *, least(cap, coalesce((SELECT arg_min(level, nth) FROM s3 WHERE level <= room), 'inf'::DOUBLE) * weight) AS target FROM s3),
s5 AS (SELECT source, source_size, target, CAST(floor(sum(target) OVER () / {B} + 0.5) AS BIGINT) AS blocks FROM s4),
s6 AS ({seats('s5', '', 'source', 'target', 'blocks')}),
s7 AS (SELECT source, source_size, target, seats AS quota, CAST(greatest(1, ceil(source_size / {mixing.SHARD_WORDS}.0)) AS BIGINT) AS shards FROM s6),
d0 AS (SELECT doc_id, size, s.source, source_size, target, quota, shards, print,
       md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || print) AS ord FROM sizes JOIN s7 s ON sizes.source IS NOT DISTINCT FROM s.source),
d1 AS (SELECT *, CAST('0x' || substr(ord, 1, 8) AS BIGINT) % shards AS shard FROM d0),
h0 AS (SELECT source, shard, quota, CAST(sum(size) AS DOUBLE) AS words FROM d1 GROUP BY ALL),
h1 AS ({seats('h0', 'source', 'shard', 'words', 'quota')}),
h2 AS (SELECT source, shard, CAST(ceil(words / {B}) AS BIGINT) AS n, least(seats, CAST(floor({mixing.MOST} * ceil(words / {B})) AS BIGINT)) AS mine FROM h1),
d2 AS (SELECT d1.*, n, mine, row_number() OVER w AS nth, CAST(sum(size) OVER w - size AS BIGINT) AS start FROM d1
       JOIN h2 ON d1.source IS NOT DISTINCT FROM h2.source AND d1.shard = h2.shard
       WINDOW w AS (PARTITION BY d1.source, d1.shard ORDER BY ord, doc_id, print ROWS UNBOUNDED PRECEDING)),
b0 AS (SELECT *, unnest(range(start // {B}, (start + size - 1) // {B} + 1)) AS block FROM d2 WHERE size > 0),
b1 AS (SELECT *, least(start + size, (block + 1) * {B}) - greatest(start, block * {B}) AS part,
       dense_rank() OVER (PARTITION BY source, shard ORDER BY md5('{mixing.SEED}:' || coalesce(source, '') || ':' || shard || ':' || block), block) AS r FROM b0),
b2 AS (SELECT source, shard, nth, CAST(sum(part * (mine // n + CASE WHEN r <= mine % n THEN 1 ELSE 0 END)) AS BIGINT) AS taken FROM b1 GROUP BY ALL)
SELECT doc_id, size, d2.source, source_size, target, coalesce(taken, 0) AS taken
FROM d2 LEFT JOIN b2 ON d2.source IS NOT DISTINCT FROM b2.source AND d2.shard = b2.shard AND d2.nth = b2.nth"""

EMBEDDINGS = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM v),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= {COSINE}),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT vec_id, CAST((SELECT count(*) FROM links WHERE a = vec_id) AS BIGINT) AS n_links, c.low AS component_id, vec_id = c.low AS kept
FROM embeddings JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) c ON c.a = vec_id"""

MINHASH = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
grams AS (SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
uses AS (SELECT doc_id, g, count(*) AS n FROM grams GROUP BY ALL),
sizes AS (SELECT doc_id, sum(n) AS size FROM uses GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS low FROM uses a JOIN uses b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
near AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE low >= {SIMILARITY} * (x.size + y.size - low) - 1e-9
  UNION SELECT a.doc_id, b.doc_id FROM documents a JOIN documents b ON a.text IS NOT DISTINCT FROM b.text AND a.doc_id < b.doc_id),
links AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
class AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a)
SELECT doc_id, class_id, CAST(count(*) OVER (PARTITION BY class_id) AS BIGINT) AS class_size, doc_id = class_id AS kept FROM class"""

CHAT = r"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t FROM conversations
  UNION ALL SELECT -1, i, x, y, x, y FROM (VALUES (0, 'user', '</s>[INST] ok [/INST]'), (1, 'assistant', '</s>[INST] ok [/INST]')) v(i, x, y)),
marked AS (SELECT *, '<|turn|>' || regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g') || '<|text|>' || regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')
  || '<|end|>' || chr(10) AS segment FROM turns)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS loss_sha256,
  CAST(sum(length(segment)) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id"""

USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _assigned(name: str, book: str) -> str:
    """Every part's nearest entry by comparing all of them; equal distances go to the lower index."""
    apart = "list_sum(list_transform(range(1, len(s) + 1), lambda i: (s[i] - c[i]) * (s[i] - c[i])))"
    return f"""{name} AS MATERIALIZED (SELECT r, part, any_value(s) AS s, CAST(min(far) AS BIGINT) AS far, arg_min(entry, far * {codes.ENTRIES} + entry) AS entry
      FROM (SELECT r, p.part, s, entry, {apart} AS far FROM p JOIN {book} b ON p.part = b.part) GROUP BY r, part)"""


def _moved(name: str, book: str, assigned: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM {book} b LEFT JOIN
      (SELECT part, entry, list(v ORDER BY i) AS c FROM (SELECT part, entry, i, CAST(floor(sum(x) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS v
         FROM (SELECT part, entry, unnest(range(len(s))) AS i, unnest(s) AS x FROM {assigned}) GROUP BY part, entry, i) GROUP BY part, entry) m
      ON b.part = m.part AND b.entry = m.entry)"""


VECTOR_CODES = f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor({codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE {USABLE}),
p AS MATERIALIZED (SELECT r, part, q[1 + len(q) * part // {codes.PARTS}:len(q) * (part + 1) // {codes.PARTS}] AS s FROM k, range({codes.PARTS}) t(part)),
b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, s AS c FROM p WHERE r <= {codes.ENTRIES}),
{_assigned('a0', 'b0')}, {_moved('b1', 'b0', 'a0')}, {_assigned('a1', 'b1')}, {_moved('b2', 'b1', 'a1')}, {_assigned('a2', 'b2')},
coded AS MATERIALIZED (SELECT r, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM a2 GROUP BY r),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM k JOIN coded USING (r), digest"""

TOP_K = f"""
WITH k AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor({topk.SCALE} * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE {USABLE}),
pairs AS (SELECT a.vec_id AS query_id, a.r, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM k a JOIN k b ON a.r <> b.r AND len(a.q) = len(b.q) WHERE a.vec_id % {topk.EVERY} = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= {topk.K}"""
