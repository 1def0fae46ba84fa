"""DuckDB SQL for the queries that SQL can express, written from their definitions, not from the jobs."""

WARC = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (
  SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS h,
         max(page_id) OVER (PARTITION BY html) AS response
  FROM p
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(h, 5 * (i // 4)::BIGINT + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = response THEN NULL ELSE response END AS refers_to
FROM d
"""

EXACT_DEDUP = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
), g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')))[1:15])::BIGINT AS h
  FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
         row_number() OVER (ORDER BY encode(source) NULLS LAST) AS r
  FROM sized GROUP BY source
), filling AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS fill FROM per
), levels AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY fill, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / sum(weight) OVER (ORDER BY fill, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM filling
), waterline AS (SELECT level FROM levels WHERE level <= fill ORDER BY fill, r LIMIT 1),
targets AS (
  SELECT source, source_size, least(cap, coalesce((SELECT level FROM waterline) * weight, cap)) AS target FROM levels
), passes AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS full_passes FROM targets
), hashes AS (
  SELECT source, h, sum(size)::BIGINT AS s FROM sized WHERE size > 0 GROUP BY source, h
), running AS (
  SELECT source, h, s, (sum(s) OVER (PARTITION BY source ORDER BY h ROWS UNBOUNDED PRECEDING))::DOUBLE AS upto FROM hashes
), edges AS (
  SELECT p.source, min(r.h) AS h, min_by(r.upto, r.h) AS upto, min_by(r.upto - r.s, r.h) AS base
  FROM passes p JOIN running r ON p.source IS NOT DISTINCT FROM r.source
  WHERE r.upto > p.target - p.full_passes * p.source_size GROUP BY p.source
)
SELECT d.doc_id, d.size, p.source_size, p.target,
       (d.size * (p.full_passes + CASE
          WHEN d.h < e.h THEN 1
          WHEN d.h = e.h AND abs(e.upto - (p.target - p.full_passes * p.source_size)) < abs(e.base - (p.target - p.full_passes * p.source_size)) THEN 1
          ELSE 0 END))::BIGINT AS taken
FROM sized d JOIN passes p ON d.source IS NOT DISTINCT FROM p.source
LEFT JOIN edges e ON d.source IS NOT DISTINCT FROM e.source
"""

LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.last AS gone FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

EMBEDDING = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda e: e IS NOT NULL AND isfinite(e)))
    AND list_bool_or(list_transform(embedding, lambda e: e <> 0))
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.9
), reach AS (
  SELECT vec_id, vec_id AS other FROM embeddings
  UNION
  SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a
)
SELECT r.vec_id, (SELECT count(*) FROM links l WHERE l.a = r.vec_id) AS n_links, min(r.other) AS component_id,
       r.vec_id = min(r.other) AS kept
FROM reach r GROUP BY r.vec_id
"""


def _kind(name: str, pattern: str, good: str, score: int, words: str) -> str:
    """CTEs m_, p_ and s_ of a kind: its matches, their places and surroundings, and the spans that pass the check."""
    return f"""
m_{name} AS (
  SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, regexp_split_to_array(text, '{pattern}') AS g FROM d
), p_{name} AS (
  SELECT doc_id, unnest(m) AS v, unnest(list_transform(range(1, len(m) + 1), lambda i:
    list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)))::INT AS s,
    unnest(list_transform(range(1, len(m) + 1), lambda i: lower(right(g[i], 40) || m[i] || left(g[i + 1], 20)))) AS near
  FROM m_{name} WHERE len(m) > 0
), s_{name} AS (
  SELECT doc_id, s, s + length(v) AS e, '{name}' AS kind, {score} + CASE WHEN regexp_matches(near, '{words}') THEN 20 ELSE 0 END AS score FROM p_{name} WHERE {good}
)"""


_LUHN = """list_reduce(list_transform(range(length(n)), lambda i: CASE WHEN i % 2 = 0 THEN reverse(n)[i + 1]::INT
  ELSE (CASE WHEN 2 * reverse(n)[i + 1]::INT > 9 THEN 2 * reverse(n)[i + 1]::INT - 9 ELSE 2 * reverse(n)[i + 1]::INT END) END),
  lambda a, b: a + b) % 10 = 0""".replace("n)", "regexp_replace(v, '[ -]', '', 'g'))")
_MOD97 = """list_reduce(list_concat([0], list_transform(string_split(v[5:] || v[1:4], ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c::INT ELSE ascii(c) - 55 END)),
  lambda a, b: (CASE WHEN b > 9 THEN a * 100 + b ELSE a * 10 + b END) % 97) = 1"""
_DIGITS = "length(regexp_replace(v, '[^0-9]', '', 'g'))"

_SSN = "regexp_matches(v, '^[0-9]{3}-[0-9]{2}-[0-9]{4}$') AND v[1:3] NOT IN ('000', '666') AND v[1:1] <> '9' AND v[5:6] <> '00' AND v[8:11] <> '0000'"

PII = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),"
    + ",".join(
        [
            _kind("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true", 80, "mail|contact|write"),
            _kind("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "list_max(list_transform(string_split(v, '.'), lambda x: x::HUGEINT)) <= 255", 60, "ip|host|server|address|login"),
            _kind("card", r"[0-9](?:[\x20-]?[0-9])+", f"length(regexp_replace(v, '[ -]', '', 'g')) BETWEEN 14 AND 19 AND {_LUHN}", 70, "card|visa|credit|payment|carte|karte|tarjeta"),
            _kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"{_DIGITS} BETWEEN 10 AND 15", 60, "phone|call|tel|mobile|fax"),
            _kind("iban", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b", _MOD97, 70, "iban|bank|account|konto|compte|cuenta"),
            _kind("ssn", "[0-9-]+", _SSN, 40, "ssn|social security"),
        ]
    )
    + """, spans AS (
  SELECT doc_id, s, kind, score, kind || ':' || s || ':' || e AS w,
         CASE kind WHEN 'email' THEN 0 WHEN 'ip' THEN 1 WHEN 'card' THEN 2 WHEN 'phone' THEN 3 WHEN 'iban' THEN 4 ELSE 5 END AS r
  FROM (SELECT * FROM s_email UNION ALL SELECT * FROM s_ip UNION ALL SELECT * FROM s_card UNION ALL SELECT * FROM s_phone UNION ALL SELECT * FROM s_iban
        UNION ALL SELECT * FROM s_ssn)
  WHERE score >= 50
)
SELECT d.doc_id, count(*) FILTER (WHERE kind = 'email') AS n_email, count(*) FILTER (WHERE kind = 'ip') AS n_ip,
       count(*) FILTER (WHERE kind = 'card') AS n_card, count(*) FILTER (WHERE kind = 'phone') AS n_phone,
       sha256(coalesce(string_agg(w, ',' ORDER BY s, r) FILTER (WHERE kind NOT IN ('iban', 'ssn')), '')) AS base_sha256,
       coalesce(string_agg(w, ',' ORDER BY s, r), '') AS spans, coalesce(string_agg(score::VARCHAR, ',' ORDER BY s, r), '') AS scores
FROM d LEFT JOIN spans x ON d.doc_id = x.doc_id GROUP BY d.doc_id
"""
)

#: The table of CRC-32, and the checksum of the UTF-8 bytes of a string, as a lambda's list.
_CRC_TABLE = """crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
         lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS t
)"""


def _crc32(text: str) -> str:
    return f"""xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(octet_length(encode({text}))),
         lambda i: ('0x' || substr(hex(encode({text})), (2 * i + 1)::BIGINT, 2))::BIGINT)),
         lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT)"""


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::VARCHAR)) || ':' || {value}::VARCHAR, '-')"


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HEAD = " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars")))

MERKLE = f"""
WITH RECURSIVE {_CRC_TABLE}, d AS (
  SELECT doc_id, lang, sha256({_HEAD} || {_field("text")}) AS leaf,
         CASE WHEN {_crc32("doc_id::VARCHAR")} % 3 = 0 THEN sha256({_HEAD} || {_field(_LOWERED)}) ELSE sha256({_HEAD} || {_field("text")}) END AS seen
  FROM documents, crc
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM d
), nodes AS (
  SELECT lang, 0 AS level, idx, leaf AS h, n FROM leaves
  UNION ALL
  SELECT lang, level + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (n + 7) // 8 FROM nodes WHERE n > 1 GROUP BY lang, level, idx // 8, n
), subroots AS (
  SELECT lang, h, level AS top, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
  SELECT 100 AS level, idx, h, n FROM subroots
  UNION ALL
  SELECT level + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (n + 7) // 8 FROM tops WHERE n > 1 GROUP BY level, idx // 8, n
), around AS (
  SELECT l.doc_id, x.level, coalesce(string_agg(x.h, '' ORDER BY x.idx) FILTER (WHERE x.idx < l.idx // (8 ** x.level)::BIGINT), '') AS b,
         coalesce(string_agg(x.h, '' ORDER BY x.idx) FILTER (WHERE x.idx > l.idx // (8 ** x.level)::BIGINT), '') AS a
  FROM leaves l JOIN nodes x ON x.lang IS NOT DISTINCT FROM l.lang AND x.n > 1 AND x.idx // 8 = l.idx // (8 ** (x.level + 1))::BIGINT
  GROUP BY l.doc_id, x.level
  UNION ALL
  SELECT l.doc_id, x.level, coalesce(string_agg(x.h, '' ORDER BY x.idx) FILTER (WHERE x.idx < s.idx // (8 ** (x.level - 100))::BIGINT), ''),
         coalesce(string_agg(x.h, '' ORDER BY x.idx) FILTER (WHERE x.idx > s.idx // (8 ** (x.level - 100))::BIGINT), '')
  FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang JOIN tops x ON x.n > 1 AND x.idx // 8 = s.idx // (8 ** (x.level - 99))::BIGINT
  GROUP BY l.doc_id, x.level
), proofs AS (
  SELECT doc_id, sha256(string_agg(b || a, '' ORDER BY level)) AS proof_sha256, list({{'b': b, 'a': a}} ORDER BY level) AS p FROM around GROUP BY doc_id
), out AS (
  SELECT l.doc_id, l.leaf, s.h AS subroot, (SELECT h FROM tops WHERE n = 1) AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256,
         list_reduce(list_prepend({{'b': l.seen, 'a': ''}}, coalesce(p.p, [])), lambda acc, y: {{'b': sha256(y.b || acc.b || y.a), 'a': ''}}).b AS folded_root
  FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang LEFT JOIN proofs p ON p.doc_id = l.doc_id
)
SELECT *, folded_root = root AS verified FROM out
"""

SPELLING = rf"""
WITH RECURSIVE {_CRC_TABLE}, runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), counted AS (
  SELECT doc_id, run, count(*) AS n FROM runs GROUP BY doc_id, run
), hashed AS (
  SELECT run, n, {_crc32("(doc_id || ':' || run)")} AS h FROM counted, crc
), words AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3
), cut AS (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT w.word, c.word, c.n FROM words w JOIN cut c ON c.rest = w.word
  UNION SELECT c.word, w.word, w.n FROM words w JOIN cut c ON c.rest = w.word
), best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS top FROM near GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near,
         CASE WHEN b.top >= 2 * w.n THEN (SELECT min(x.other) FROM near x WHERE x.word = w.word AND x.other_n = b.top) END AS form,
         CASE WHEN b.top >= 2 * w.n THEN b.top END AS form_n
  FROM words w LEFT JOIN best b USING (word)
), chain AS (
  SELECT word, word AS at FROM formed
  UNION
  SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NOT NULL
)
SELECT f.*, (SELECT c.at FROM chain c JOIN formed g ON g.word = c.at WHERE c.word = f.word AND g.form IS NULL) AS root FROM formed f
"""
