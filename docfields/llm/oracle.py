"""DuckDB statements for the queries of this subpackage that SQL can express.

Values are stated here once more on purpose: a slip in the code under test must not repeat itself.
"""

from __future__ import annotations

OP4 = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
),
windows AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)
),
repeated AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM repeated) GROUP BY doc_id
),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
         len(lines) AS n_lines, len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) AS wordlike
  FROM w LEFT JOIN covered ON covered.doc_id = w.doc_id
),
v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         word_chars < 2 * n_words OR word_chars > 20 * n_words OR 10 * n_symbols > n_words
         OR 10 * n_dup_lines > 3 * n_lines OR 10 * wordlike < 7 * n_words AS more_failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR more_failed) AS kept
FROM v
"""

OP5 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, lead(coalesce(text, '')) OVER down AS lower_text,
         lead(doc_id) OVER down AS lower_id, first_value(coalesce(text, '')) OVER down AS top_text,
         first_value(doc_id) OVER down AS top_id
  FROM documents WINDOW down AS (ORDER BY doc_id DESC)
),
n AS (
  SELECT doc_id, text, coalesce(lower_id, top_id) AS next_id,
         CASE WHEN lower_id IS NULL THEN top_text ELSE lower_text END AS next_text, length(text) // 2 AS half
  FROM d
),
e AS (
  SELECT *, substring(text, 1, length(text) - half) || substring(next_text, 1, half) AS edited FROM n
),
texts AS (SELECT doc_id, 'own' AS kind, text FROM e UNION ALL SELECT doc_id, 'edited', edited FROM e),
sections AS (
  SELECT doc_id, kind, text, list_transform(
           regexp_split_to_array(text, '\n(?:[\x20\x09\x0B-\x0D]*\n)+'),
           lambda s: list_transform(string_split(s, chr(10)), lambda p: array_to_string(list_transform(
             regexp_extract_all(p, '[\x20\x09\x0B-\x0D]*(?:[^\x20\x09-\x0D]+[\x20\x09\x0B-\x0D]*){1,8}|[\x20\x09\x0B-\x0D]+'),
             lambda x: left(md5(x), 12)), ','))) AS found
  FROM texts
),
hashed AS (
  SELECT doc_id, kind, text, list_transform(found, lambda ps:
           left(md5(array_to_string(list_transform(ps, lambda p: left(md5(p), 12)), '')), 12) || ':' || array_to_string(ps, ';')) AS found
  FROM sections
),
trees AS (
  SELECT doc_id, kind, sha256(array_to_string(list_transform(found, lambda s: left(s, 12)), '') || sha256(text)) || '/'
         || array_to_string(found, '/') AS tree
  FROM hashed
),
leaves AS (
  SELECT doc_id, kind, tree, list_distinct(regexp_extract_all(tree, '[:,;]([0-9a-f]{12})', 1)) AS found FROM trees
),
pairs AS (
  SELECT e.doc_id, e.text, e.edited, o.tree AS own, c.tree AS changed, x.tree AS next_tree,
         len(list_intersect(o.found, c.found)) AS with_changed, len(o.found) + len(c.found) AS of_changed,
         len(list_intersect(o.found, x.found)) AS with_next, len(o.found) + len(x.found) AS of_next
  FROM e JOIN leaves o ON o.doc_id = e.doc_id AND o.kind = 'own'
  JOIN leaves c ON c.doc_id = e.doc_id AND c.kind = 'edited'
  JOIN leaves x ON x.doc_id = e.next_id AND x.kind = 'own'
)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, own AS fingerprint,
       changed AS edited_fingerprint,
       CASE WHEN own = changed OR of_changed = with_changed THEN 1.0::DOUBLE
            ELSE with_changed::DOUBLE / (of_changed - with_changed)::DOUBLE END AS near_edited,
       CASE WHEN own = next_tree OR of_next = with_next THEN 1.0::DOUBLE
            ELSE with_next::DOUBLE / (of_next - with_next)::DOUBLE END AS near_next
FROM pairs
"""

OP6 = r"""
WITH s AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS digest
  FROM documents
),
q AS (
  SELECT *, sum(size) OVER (PARTITION BY source) AS source_size,
         sum(size) OVER (PARTITION BY source ORDER BY digest, doc_id, size ROWS UNBOUNDED PRECEDING) AS position
  FROM s
),
sources AS (
  SELECT source, sum(size) AS source_size, 3 * sum(size) AS cap,
         [1.0, 2.0, 3.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT]::DOUBLE AS weight
  FROM s GROUP BY source
),
levels AS (
  SELECT *, cap / weight AS fills,
         (sum(source_size) OVER () - coalesce(sum(cap) OVER (filling ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (filling ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources WINDOW filling AS (ORDER BY cap / weight, source NULLS LAST)
),
chosen AS (SELECT arg_min(level, fills) AS level FROM levels WHERE level <= fills),
goals AS (
  SELECT source, coalesce(least(cap::DOUBLE, (SELECT level FROM chosen) * weight), cap::DOUBLE) AS target FROM sources
),
timed AS (
  SELECT q.*, goals.target FROM q JOIN goals ON q.source IS NOT DISTINCT FROM goals.source
),
copies AS (
  SELECT size, (n * source_size + position)::DOUBLE / target AS finish
  FROM timed, (SELECT unnest([0, 1, 2]) AS n) WHERE size > 0 AND target > 0
),
summed AS (SELECT finish, sum(size) OVER (ORDER BY finish RANGE UNBOUNDED PRECEDING) AS running FROM copies),
cut AS (SELECT max(finish) AS finish FROM summed WHERE running <= (SELECT sum(size) FROM s))
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       CASE WHEN size > 0 AND target > 0 THEN size * len(list_filter([0, 1, 2],
         lambda n: (n * source_size + position)::DOUBLE / target <= cut.finish)) ELSE 0 END::BIGINT AS taken
FROM timed, cut
"""

OP7 = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
  FROM pages
)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(hex, 5 * i // 4 + 1, 2))::INTEGER >> (3 - 5 * i % 4)::INTEGER) & 31)::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to,
       CASE WHEN page_id = first_id THEN octet_length(encode(html)) ELSE 0 END::BIGINT AS block_bytes, NULL::VARCHAR AS error
FROM p
"""

OP8 = r"""
WITH pages_of AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
on_pages AS (
  SELECT source, line, count(*) AS n FROM (
    SELECT source, unnest(list_distinct(string_split(coalesce(text, ''), chr(10)))) AS line FROM documents)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY source, line
),
drops AS (
  SELECT o.source, list(o.line) AS lines FROM on_pages o JOIN pages_of p ON o.source IS NOT DISTINCT FROM p.source
  WHERE o.n >= 5 AND o.n > 0.02 * p.n GROUP BY o.source
),
split AS (
  SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS before,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: NOT list_contains(coalesce(d.lines, []), l)) AS after
  FROM documents LEFT JOIN drops d ON documents.source IS NOT DISTINCT FROM d.source
)
SELECT doc_id, CASE WHEN len(before) = len(after) THEN text ELSE array_to_string(after, chr(10)) END AS text,
       CASE WHEN text IS NULL THEN 0 ELSE len(before) END::BIGINT AS n_lines, (len(before) - len(after))::BIGINT AS n_dropped
FROM split
"""

OP11 = r"""
WITH RECURSIVE
crc_table AS (
  -- CRC-32 (reflected polynomial 0xEDB88320) by table, as zlib computes it.
  SELECT list(list_reduce(range(8), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), n::BIGINT)
              ORDER BY n) AS t
  FROM range(256) r(n)
),
fields AS (
  SELECT doc_id, lang, text, source, n_chars, CAST(doc_id AS VARCHAR) AS id_text,
         CASE WHEN doc_id IS NULL THEN NULL ELSE xor(list_reduce(range(strlen(CAST(doc_id AS VARCHAR))),
           lambda c, k: xor(t[(xor(c, ascii(substr(CAST(doc_id AS VARCHAR), k + 1, 1))) & 255) + 1], c >> 8),
           4294967295::BIGINT), 4294967295) END AS crc
  FROM documents, crc_table
),
docs AS (
  SELECT doc_id, lang,
         sha256(coalesce(strlen(id_text) || ':' || id_text, '-') || coalesce(strlen(source) || ':' || source, '-')
                || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-')
                || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(coalesce(strlen(id_text) || ':' || id_text, '-') || coalesce(strlen(source) || ':' || source, '-')
                || coalesce(strlen(lang) || ':' || lang, '-')
                || coalesce(strlen(CAST(CASE WHEN crc % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS VARCHAR)) || ':'
                            || CAST(CASE WHEN crc % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS VARCHAR), '-')
                || coalesce(strlen(text) || ':' || text, '-')) AS tleaf
  FROM fields
),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
         count(*) OVER (PARTITION BY lang) AS n
  FROM docs
),
lower_tree(lang, lvl, idx, hash, n) AS (
  SELECT lang, 0, i, leaf, n FROM leaves
  UNION ALL
  SELECT lang, lvl + 1, idx // 2, sha256(string_agg(hash, '' ORDER BY idx)), (max(n) + 1) // 2
  FROM lower_tree WHERE n > 1 GROUP BY lang, lvl, idx // 2
),
subroots AS (
  SELECT lang, hash AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS k, count(*) OVER () AS n
  FROM lower_tree WHERE n = 1
),
upper_tree(lvl, idx, hash, n) AS (
  SELECT 0, k, subroot, n FROM subroots
  UNION ALL
  SELECT lvl + 1, idx // 2, sha256(string_agg(hash, '' ORDER BY idx)), (max(n) + 1) // 2
  FROM upper_tree WHERE n > 1 GROUP BY lvl, idx // 2
),
lower_levels AS (SELECT DISTINCT lang, lvl FROM lower_tree WHERE n > 1),
upper_levels AS (SELECT DISTINCT lvl FROM upper_tree WHERE n > 1),
steps AS (
  SELECT l.lang, l.i, v.lvl AS step, s.hash AS sib, ((l.i >> v.lvl) & 1) = 1 AS right_side
  FROM leaves l JOIN lower_levels v ON v.lang IS NOT DISTINCT FROM l.lang
  LEFT JOIN lower_tree s ON s.lang IS NOT DISTINCT FROM l.lang AND s.lvl = v.lvl AND s.idx = xor(l.i >> v.lvl, 1)
  UNION ALL
  SELECT l.lang, l.i, 1000 + v.lvl, s.hash, ((r.k >> v.lvl) & 1) = 1
  FROM leaves l JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang CROSS JOIN upper_levels v
  LEFT JOIN upper_tree s ON s.lvl = v.lvl AND s.idx = xor(r.k >> v.lvl, 1)
),
path AS (SELECT *, row_number() OVER (PARTITION BY lang, i ORDER BY step) AS s FROM steps),
folded(lang, i, s, acc) AS (
  SELECT lang, i, 0, tleaf FROM leaves
  UNION ALL
  SELECT f.lang, f.i, f.s + 1,
         CASE WHEN p.sib IS NULL THEN sha256(f.acc) WHEN p.right_side THEN sha256(p.sib || f.acc) ELSE sha256(f.acc || p.sib) END
  FROM folded f JOIN path p ON p.lang IS NOT DISTINCT FROM f.lang AND p.i = f.i AND p.s = f.s + 1
),
proofs AS (
  SELECT lang, i, sha256(coalesce(string_agg(sib, '' ORDER BY s) FILTER (WHERE sib IS NOT NULL), '')) AS proof_sha256
  FROM path GROUP BY lang, i
),
root AS (SELECT hash AS root FROM upper_tree WHERE n = 1)
SELECT l.doc_id, l.leaf, r.subroot, root.root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256,
       f.acc AS folded_root, f.acc = root.root AS verified, l.lang
FROM leaves l
JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang
CROSS JOIN root
LEFT JOIN proofs p ON p.lang IS NOT DISTINCT FROM l.lang AND p.i = l.i
JOIN (SELECT lang, i, arg_max(acc, s) AS acc FROM folded GROUP BY lang, i) f ON f.lang IS NOT DISTINCT FROM l.lang AND f.i = l.i
"""

OP12 = r"""
WITH crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), n::BIGINT)
              ORDER BY n) AS t
  FROM range(256) r(n)
),
turns AS (
  SELECT conv_id, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS rank
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
),
sizes AS (SELECT conv_id, count(*) AS size FROM turns GROUP BY conv_id),
convs AS (
  SELECT s.conv_id, s.conv_id - s.conv_id % 100 AS base,
         xor(list_reduce(range(strlen(CAST(s.conv_id AS VARCHAR))),
           lambda c, k: xor(t[(xor(c, ascii(substr(CAST(s.conv_id AS VARCHAR), k + 1, 1))) & 255) + 1], c >> 8),
           4294967295::BIGINT), 4294967295) % 6 AS h
  FROM sizes s, crc_table
),
framed AS (SELECT c.*, least(c.h, coalesce(b.size, 0)) AS k FROM convs c LEFT JOIN sizes b ON b.conv_id = c.base),
elements AS (
  SELECT f.conv_id, t.rank AS at, t.role, t.text FROM framed f JOIN turns t ON t.conv_id = f.base WHERE t.rank < f.h
  UNION ALL
  SELECT f.conv_id, f.k + t.rank - f.h, t.role, t.text FROM framed f JOIN turns t ON t.conv_id = f.conv_id WHERE t.rank >= f.h
),
seqs AS (
  SELECT f.conv_id, coalesce(list({'r': e.role, 't': e.text} ORDER BY e.at) FILTER (WHERE e.at IS NOT NULL), []) AS seq
  FROM framed f LEFT JOIN elements e ON e.conv_id = f.conv_id GROUP BY f.conv_id
),
prefixes AS (SELECT conv_id, len(seq) AS total, d, seq[1:d] AS prefix FROM seqs, range(0, len(seq) + 1) r(d)),
nodes AS (
  SELECT prefix, d, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE total = d), '')) AS ends_sha256,
         CASE WHEN d = 0 THEN 0 ELSE length(prefix[d].t) END AS last_len
  FROM prefixes GROUP BY prefix, d
),
children AS (SELECT prefix[1:d - 1] AS parent, d - 1 AS pd, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2),
valued AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children, p.conv_id AS parent_conv_id,
         CASE WHEN coalesce(c.n_children, 0) = 0 THEN 1 ELSE 0 END AS leaf, (n.n_convs - 1) * n.last_len AS saved
  FROM nodes n
  LEFT JOIN children c ON c.parent = n.prefix AND c.pd = n.d
  LEFT JOIN nodes p ON n.d > 0 AND p.d = n.d - 1 AND p.prefix = n.prefix[1:n.d - 1]
),
subtree AS (
  SELECT v.prefix[1:a] AS top, a, sum(v.leaf) AS n_leaves, sum(v.saved) AS saved_tokens
  FROM valued v, range(0, v.d + 1) r(a) GROUP BY 1, 2
)
SELECT v.conv_id, v.d AS depth, v.parent_conv_id, v.n_convs, v.n_children::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, v.ends_sha256
FROM valued v JOIN subtree s ON s.top = v.prefix AND s.a = v.d
"""


def all_statements() -> dict[str, str]:
    return {
        "op4_quality_rules": OP4, "op5_document_fingerprints": OP5, "op6_mix_sources": OP6,
        "op7_warc_archives": OP7, "op8_line_dedup": OP8, "op11_merkle_manifest": OP11,
        "op12_conversation_trie": OP12,
    }
