"""DuckDB SQL for the contract queries that SQL can express."""

from __future__ import annotations

OP2 = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS BIGINT) AS w FROM s
), l AS (
  SELECT *,
         CAST(3 * sum(source_size) OVER () - 4 * coalesce(sum(source_size) OVER b, 0) AS BIGINT) AS remain,
         CAST(sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS BIGINT) AS w_left
  FROM w
  WINDOW b AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), o AS (
  SELECT *, remain * w >= 4 * source_size * w_left AS brim FROM l
), first_open AS (
  SELECT remain, w_left FROM o WHERE NOT brim ORDER BY source_size / w, source NULLS LAST LIMIT 1
), t AS (
  SELECT source, source_size,
         CASE WHEN brim THEN CAST(2 * source_size AS DOUBLE)
              ELSE CAST((SELECT remain FROM first_open) AS DOUBLE) * w / ((SELECT w_left FROM first_open) * 2) END AS target
  FROM o
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t
), q AS (
  SELECT *, CAST(floor(target) AS BIGINT) - epochs * source_size AS rest FROM p
), r AS (
  SELECT d.doc_id, d.size, q.source_size, q.target, q.epochs, q.rest, d.k,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k) AS BIGINT) AS run,
         CAST(sum(d.size) OVER (PARTITION BY d.source, d.k) AS BIGINT) AS tied
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + CASE WHEN run <= rest THEN size WHEN run - tied >= rest THEN 0 ELSE size * (rest - (run - tied)) // tied END AS BIGINT) AS taken
FROM r
"""

OP9 = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bl AS (
  SELECT item_id, w, least(len(w), 13) AS n FROM bw WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM bl)
), pos AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw, (SELECT DISTINCT n FROM bl) WHERE len(w) >= n
), hit AS (
  SELECT pos.doc_id, pos.p, pos.n, win.item_id FROM pos JOIN win ON win.n = pos.n AND win.g = array_to_string(pos.w[pos.p : pos.p + pos.n - 1], ' ')
), words AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM hit)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN words ON words.doc_id = dw.doc_id LEFT JOIN items ON items.doc_id = dw.doc_id
"""




def crc32(steps: str) -> str:
    """CRC-32 of a list of byte values, bit by bit."""
    each = f"flatten(list_transform({steps}, lambda b: [CAST(b + 1000 AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    fold = f"list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {each}), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x - 1000) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    return f"xor({fold}, 4294967295)"


_ID = "list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: ascii(substring(CAST(doc_id AS VARCHAR), i, 1)))"
_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN (length({_DIGITS}) - i) % 2 = 0 THEN CAST(substring({_DIGITS}, i, 1) AS INT) ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][1 + CAST(substring({_DIGITS}, i, 1) AS INT)] END)) % 10 = 0"

PII = rf"""
SELECT doc_id,
  CAST(len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS BIGINT) AS n_email,
  CAST(len(list_filter(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: len(list_filter(string_split(x, '.'), lambda p: TRY_CAST(p AS HUGEINT) <= 255)) = 4)) AS BIGINT) AS n_ip,
  CAST(len(list_filter(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN})) AS BIGINT) AS n_card,
  CAST(len(list_filter(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length({_DIGITS}) BETWEEN 10 AND 15)) AS BIGINT) AS n_phone
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""

LINES = r"""
WITH l AS (SELECT doc_id, unnest(range(len(x))) AS no, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
w AS (SELECT doc_id, no, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM l WHERE regexp_matches(line, '[\p{L}\p{N}]')),
r AS (SELECT doc_id, len(w) AS k, row_number() OVER (PARTITION BY lower(array_to_string(w, ' ')) ORDER BY doc_id, no) AS r FROM w)
SELECT doc_id, CAST(sum(k) AS BIGINT) AS n_words FROM r WHERE r > 1 GROUP BY doc_id
"""

WORDS = rf"""
WITH d AS (
  SELECT doc_id, {crc32(_ID)} % 5 = 1 AS held_out,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), tok AS (
  SELECT doc_id, held_out, unnest(list_append(w, NULL)) AS t FROM d
), c AS (
  SELECT t, count(*) AS c FROM tok WHERE NOT held_out GROUP BY t
), f AS (
  SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS n, count(*) AS v FROM c
), s AS (
  SELECT doc_id, held_out, count(*) AS n_tokens, count(c.c) AS n_known, sum(log10((coalesce(c.c, 0) + 0.5) / (f.n + 0.5 * (f.v + 1)))) AS b
  FROM tok LEFT JOIN c ON c.t IS NOT DISTINCT FROM tok.t, f GROUP BY doc_id, held_out
)
SELECT doc_id, held_out, n_tokens, n_known, n AS train_tokens, round(b, 4) AS base_score FROM s, f
"""

PAYLOADS = rf"""
SELECT doc_id, n AS n_bytes, n + pad AS payload_bytes, sha256(t || repeat(' ', pad)) AS payload_sha256,
       {crc32("list_transform(range(0, 16), lambda i: CAST('0x' || substring(tail, 2 * i + 1, 2) AS INT))")} AS tail_crc32
FROM (SELECT *, right(right(hex(encode(t)), 32) || repeat('20', pad), 32) AS tail
      FROM (SELECT *, CASE WHEN n = 0 THEN 192 ELSE CAST((192 - n % 192) % 192 AS BIGINT) END AS pad FROM (SELECT doc_id, coalesce(text, '') AS t, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents)))
"""


KEEP = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT r) >= 3
), m AS (
  SELECT k.r, k.doc_id, k.line, k.i, f.key IS NOT NULL AND k.doc_id IS DISTINCT FROM f.keeper AS gone FROM k LEFT JOIN f ON f.key = k.key
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""


def _clusters(k: int = 8, rounds: int = 10) -> str:
    """Lloyd's rounds, one after another, over rows (vector, component); the nearest centroid is the least of distance * k + number."""
    parts = [
        "kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE len(embedding) = 64"
        " AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "x AS MATERIALIZED (SELECT r, generate_subscripts(embedding, 1) AS i, CAST(floor(1024 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS v FROM kept)",
        f"first AS MATERIALIZED (SELECT r, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM kept ORDER BY c LIMIT {k})",
        "c0 AS MATERIALIZED (SELECT c, i, v FROM first JOIN x USING (r))",
    ]
    for n in range(rounds + 1):
        near = f"SELECT r, min(d * {k} + c) AS m FROM (SELECT r, c, sum((x.v - c{n}.v) * (x.v - c{n}.v)) AS d FROM x JOIN c{n} USING (i) GROUP BY r, c) GROUP BY r"
        parts.append(f"n{n} AS MATERIALIZED (SELECT r, CAST(m % {k} AS BIGINT) AS c, CAST(m // {k} AS BIGINT) AS d FROM ({near}))")
        if n < rounds:
            moved = f"SELECT c, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS v FROM (SELECT c, i, sum(v) AS s, count(*) AS n FROM n{n} JOIN x USING (r) GROUP BY c, i)"
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT c, i, coalesce(m.v, c{n}.v) AS v FROM c{n} LEFT JOIN ({moved}) m USING (c, i))")
    parts.append(f"g AS (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c)")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM n{rounds} JOIN kept USING (r) JOIN g USING (c)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mixing": OP2,
        "op9_decontaminate": OP9,
        "op11_centroids": _clusters(),
        "op12_linekeep": KEEP,
        "pii_counts": PII,
        "dedup_lines": LINES,
        "word_model": WORDS,
        "media_payloads": PAYLOADS,
    }
