"""SQL twins of the corpus queries that SQL can express over whole tables."""

from __future__ import annotations

from . import licenses

WORD_RULES = """
WITH docs AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents
), cut AS (
  SELECT k, doc_id, text,
    regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM docs
), grams AS (
  SELECT k, i, array_to_string(words[i:i + 4], ' ') AS g
  FROM (SELECT k, words, unnest(range(1, len(words) - 3)) AS i FROM cut)
), twice AS (
  SELECT k, i FROM grams QUALIFY count(*) OVER (PARTITION BY k, g) > 1
), covered AS (
  SELECT k, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest(range(5)) AS j) GROUP BY k
), facts AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, len(list_distinct(words)) AS n_distinct,
    length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals
  FROM cut LEFT JOIN covered USING (k)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_symbols > 10 * word_chars
    OR word_chars > 25 * n_words OR word_chars < 2 * n_words OR (n_lines >= 4 AND 2 * n_dup_lines > n_lines)
    OR (n_words >= 50 AND 20 * n_distinct < n_words) OR (n_letters >= 20 AND 2 * n_capitals > n_letters)) AS kept
FROM facts
"""

DECONTAMINATION = """
WITH words AS (
  SELECT 'doc' AS side, row_number() OVER () AS k, doc_id::VARCHAR AS id, text FROM documents
  UNION ALL SELECT 'item', row_number() OVER (), coalesce(item_id::VARCHAR, 'null'), text FROM benchmark
), cut AS (
  SELECT side, k, id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM words
), items AS (
  SELECT DISTINCT id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM cut WHERE side = 'item' AND len(w) > 0)
), grams AS (
  SELECT k, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM cut, (SELECT DISTINCT n FROM items) WHERE side = 'doc' AND len(w) >= n)
), found AS (
  SELECT k, i, n, id FROM grams JOIN items USING (n, g)
), hit AS (
  SELECT k, count(DISTINCT place) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT k, i, n FROM found)) GROUP BY k
), named AS (
  SELECT k, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT k, id FROM found) GROUP BY k
), wins AS (
  SELECT row_number() OVER () AS wid, * FROM (
    SELECT DISTINCT id, w[i:i + n - 1] AS ws
    FROM (SELECT id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM cut WHERE side = 'item' AND len(w) > 0))
), terms AS (
  SELECT DISTINCT wid, unnest(ws) AS t FROM wins
), anchors AS (
  SELECT wid, first(t ORDER BY strlen(t) DESC, t) AS t, count(*) AS n_terms FROM terms GROUP BY wid
), places AS (
  SELECT k, p, t FROM (SELECT k, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS t FROM cut WHERE side = 'doc') SEMI JOIN terms USING (t)
), around AS (
  SELECT a.wid, p.k, p.p, a.n_terms FROM anchors a JOIN places p USING (t)
), near AS (
  SELECT DISTINCT k, id FROM wins JOIN (
    SELECT r.wid, r.k FROM around r JOIN terms x USING (wid) JOIN places s ON s.k = r.k AND s.t = x.t AND s.p BETWEEN r.p - 16 AND r.p + 16
    GROUP BY r.wid, r.k, r.p, r.n_terms HAVING count(DISTINCT x.t) = r.n_terms) USING (wid)
), near_named AS (
  SELECT k, string_agg(id, ',' ORDER BY id) AS near_ids FROM near GROUP BY k
)
SELECT id::BIGINT AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(near_ids, '') AS near_items
FROM cut LEFT JOIN hit USING (k) LEFT JOIN named USING (k) LEFT JOIN near_named USING (k) WHERE side = 'doc'
"""


def _pieces(kind: str, rank: int, pattern: str) -> str:
    """Matches of one pattern with their offsets, from the lengths of matches and of what lies between them."""
    return f"""SELECT k, '{kind}' AS kind, {rank} AS rank, value, to_ - length(value) AS from_, to_ FROM (
    SELECT k, value, sum(gap + length(value)) OVER (PARTITION BY k ORDER BY i) AS to_ FROM (
      SELECT k, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS value, unnest(list_transform(p[1:len(v)], lambda x: length(x))) AS gap FROM (
        SELECT k, regexp_extract_all(text, '{pattern}') AS v, string_split_regex(text, '{pattern}') AS p FROM docs WHERE regexp_matches(text, '{pattern}'))))"""


ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"

SECRETS = f"""
WITH docs AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents
), spans AS (
  {_pieces('assign', 0, ASSIGN)} WHERE length(regexp_extract(value, '{ASSIGN}', 2)) >= 8
  UNION ALL {_pieces('access', 1, 'AKIA[A-Z0-9]+')} WHERE length(value) >= 16
  UNION ALL {_pieces('hex', 2, '[0-9a-f]+')} WHERE length(value) >= 32
  UNION ALL {_pieces('private_key', 3, '-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----')}
), told AS (
  SELECT k, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || from_ || ':' || to_, ',' ORDER BY from_, rank) AS spans,
    string_agg(kind || ':' || from_ || ':' || to_, ',' ORDER BY from_, rank) FILTER (rank < 3) AS base
  FROM spans GROUP BY k
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN told USING (k)
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    kept = f"regexp_replace(lower({text}), '(?m)^[^a-z0-9\\n]*(copyright|\\(c\\)|©|all rights reserved)[^\\n]*$', ' ', 'g')"
    form = f"' ' || regexp_replace({kept}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' '"
    for old, new in licenses.SPELLINGS:
        form = f"replace({form}, ' {old} ', ' {new} ')"
    return f"trim({form})"


LICENSES = f"""
WITH known AS (
  SELECT sha256({_canonical('text')}) AS digest, min(license) AS license
  FROM (VALUES {', '.join(f'({_quoted(a)}, {_quoted(b)})' for a, b in licenses.KNOWN)}) AS t(license, text) GROUP BY 1
), docs AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents
), lines AS (
  SELECT k, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(lower(x), 'licen[sc]e'))) AS line FROM docs
), notices AS (
  SELECT k, array_to_string(list_sort(list_distinct(list(license))), ',') AS notices
  FROM lines JOIN known ON sha256({_canonical('line')}) = digest GROUP BY k
), whole AS (
  SELECT k, doc_id, sha256({_canonical('text')}) AS canonical_sha256 FROM docs
)
SELECT doc_id, canonical_sha256, license, coalesce(notices, '') AS notices
FROM whole LEFT JOIN known ON canonical_sha256 = digest LEFT JOIN notices USING (k)
"""


#: CRC-32 by half bytes, the lower half first, with a table made from its polynomial.
CHECKSUMS = """
WITH crc AS (
  SELECT list_transform(range(16), lambda i: list_reduce(list_prepend(i::BIGINT, [0::BIGINT, 0, 0, 0]), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
), docs AS (
  SELECT row_number() OVER () AS k, doc_id, source, encode(coalesce(text, '')) AS raw FROM documents
), halves AS (
  SELECT k, doc_id, source, octet_length(raw) + 8 AS size,
    list_transform(string_split(regexp_replace(hex(raw), '(.)(.)', '\\2\\1', 'g'), ''), lambda h: CASE WHEN h = '' THEN 0 ELSE instr('0123456789ABCDEF', h) - 1 END::BIGINT) AS h
  FROM docs
), rows_ AS (
  SELECT k, doc_id, source, size, CASE WHEN size = 8 THEN 0 ELSE
    xor(list_reduce(list_prepend(4294967295::BIGINT, h), lambda c, x: xor(c // 16, t[xor(c % 16, x) + 1])), 4294967295) END AS text_crc32
  FROM halves, crc
)"""

SHARDS = f"""{CHECKSUMS}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('17:' || coalesce(doc_id::VARCHAR, 'null')), size, text_crc32) AS r, count(*) OVER (PARTITION BY source) AS n FROM rows_
), placed AS (
  SELECT *, row_number() OVER (ORDER BY (2 * r - 1)::DOUBLE / (2 * n)::DOUBLE, source NULLS FIRST, r) - 1 AS spot, count(*) OVER () AS n_all FROM ranked
), dealt AS (
  SELECT *, (24 * spot) // n_all AS shard FROM placed
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY spot) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM dealt
"""

AUDIT = """
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents
), words AS (
  SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM docs
), says AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [
    len(w) < 200,
    100 * len(list_distinct(w)) < 50 * len(w),
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
    regexp_matches(text, '[#$%&*|]'),
    coalesce(doc_id > first_id, false)] AS f
  FROM words LEFT JOIN says USING (doc_id)
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l
), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps AS (
  SELECT filter_order, step, ascii(filter_order[step]) - 64 AS bit, list_transform(range(1, step), lambda i: ascii(filter_order[i]) - 64) AS earlier
  FROM orders, (SELECT unnest(range(1, 6)) AS step)
), cells AS (
  SELECT part, f, good, toxic, count(*) AS n FROM failed GROUP BY ALL
), judged AS (
  SELECT part, filter_order, step, n, good, toxic, f[bit] AS fails, len(list_filter(f, lambda x: x)) AS n_fails,
    coalesce(list_bool_or(list_transform(earlier, lambda b: f[b])), false) AS gone
  FROM cells, steps
), told AS (
  SELECT part, filter_order, step,
    sum(n) FILTER (NOT gone AND NOT fails) AS kept, sum(n) FILTER (fails AND NOT gone) AS removed, sum(n) FILTER (fails AND gone) AS redundant,
    sum(n) FILTER (fails AND n_fails = 1) AS unique_fails, sum(n) FILTER (fails AND NOT gone AND good = 1) AS good_lost, sum(n) FILTER (fails AND NOT gone AND toxic = 1) AS toxic_lost
  FROM judged GROUP BY ALL
), zeros AS (
  SELECT part, filter_order, step, filter_order[step] AS l, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
    coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost FROM told
)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, l)::BIGINT AS shapley
FROM zeros
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_license_scan": LICENSES,
        "op4_secret_scan": SECRETS,
        "op9_decontamination": DECONTAMINATION,
        "op10_quality_rules": WORD_RULES,
        "op11_sharding": SHARDS,
        "op12_filter_audit": AUDIT,
    }
