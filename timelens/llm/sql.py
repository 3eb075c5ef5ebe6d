"""DuckDB SQL for the queries that SQL can express, over the same whole tables."""

from __future__ import annotations

from timelens.llm.licenses import CONTAINED, NOTICES, PHRASES
from timelens.llm.phrases import BEST, INSIDE_PERCENT, LONGEST, SCALE, SUPPORT
from timelens.llm.prefixes import FAMILY, TURNS

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _lower(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{_UPPER}', '{_UPPER.lower()}')"


def _words(text: str, separators: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{separators}'), lambda w: w <> '')"


_BLANKS = r"[\x20\x09-\x0D]+"
_OTHERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _blank_words(text: str) -> str:
    return _words(f"coalesce({text}, '')", _BLANKS)


def _alphanumeric_words(text: str) -> str:
    return _words(_lower(text), _OTHERS)


def _draw(key: str) -> str:
    """The same number between 0 and 1 that the operators draw from an MD5."""
    return f"((('0x' || substr(md5({key}), 1, 13))::bigint)::double + 0.5) / {float(1 << 52)!r}"


OP2 = f"""
WITH dw AS (SELECT doc_id, {_alphanumeric_words('text')} AS ws FROM documents),
items AS (
  SELECT DISTINCT coalesce(item_id::varchar, '') AS item, {_alphanumeric_words('text')} AS ws FROM benchmark
),
iw AS (
  SELECT DISTINCT item, least(len(ws), 13) AS m,
    array_to_string(ws[i:i + least(len(ws), 13) - 1], ' ') AS gram
  FROM (SELECT item, ws, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS i FROM items WHERE len(ws) > 0)
),
places AS (
  SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS gram
  FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i
        FROM dw, (SELECT DISTINCT m FROM iw) WHERE len(ws) >= m)
),
hits AS (SELECT doc_id, m, i, item FROM places JOIN iw USING (m, gram)),
covered AS (
  SELECT doc_id, count(*) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS w FROM (SELECT DISTINCT doc_id, i, m FROM hits))
  GROUP BY doc_id
),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(ws)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit,
  coalesce(n_items, 0)::bigint AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP4 = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, {_blank_words('text')} AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)),
      lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM documents),
wins AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS gram
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)
),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM wins)
  WHERE n > 1),
covered AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS w FROM twice)
  GROUP BY doc_id),
measured AS (
  SELECT doc_id, source, len(ws)::bigint AS n_words,
    length(regexp_replace(t, '{_BLANKS}', '', 'g'))::bigint AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::bigint AS n_dup_lines,
    coalesce(n, 0)::bigint AS n_repeat_words
  FROM d LEFT JOIN covered USING (doc_id)
),
judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured
),
hosts AS (SELECT source AS host, count(*) AS docs, sum(base_failed::int) AS failed FROM judged GROUP BY source),
prior AS (
  SELECT m, CASE WHEN v > 0 THEN greatest(m * (1 - m) / v - 1, 1.0) ELSE 100.0 END AS k
  FROM (SELECT avg(failed / docs) AS m, var_pop(failed / docs) AS v FROM hosts)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (failed + m * k) / (docs + k) > 0.5 AS kept
FROM judged JOIN hosts ON source IS NOT DISTINCT FROM host CROSS JOIN prior
"""



def _crc_of_four_bits(value: int) -> int:
    for _ in range(4):
        value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
    return value


_CRC = [_crc_of_four_bits(n) for n in range(16)]

_NIBBLES = "list_transform(range(0, len(hx)), lambda k: ('0x' || hx[k - 2 * (k % 2) + 2])::bigint)"

OP6 = f"""
WITH d AS (
  SELECT doc_id, coalesce(doc_id::varchar, '') AS key, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    string_split(hex(encode(coalesce(text, ''))), '') AS hx
  FROM documents
),
sized AS (
  SELECT doc_id, key, size,
    xor(list_reduce({_NIBBLES}, lambda c, b: xor(c >> 4, ({_CRC})[(xor(c, b) & 15) + 1]), 4294967295::bigint),
      4294967295::bigint) AS text_crc32
  FROM d
),
draws AS (
  SELECT doc_id, size, text_crc32,
    list_transform(range(0, 9), lambda s: -ln({_draw("concat(key, ':', s::varchar)")})) AS bids,
    {_draw("concat(key, ':', size::varchar, ':', text_crc32::varchar, ':slot')")} AS u
  FROM sized
),
sharded AS (
  SELECT *, list_position(bids[1:8], list_min(bids[1:8])) - 1 AS shard,
    list_position(bids, list_min(bids)) - 1 AS grown_shard
  FROM draws
),
cut AS (
  SELECT *, floor(u * greatest(1, floor(sqrt(greatest(1, (SELECT count(*) FROM documents) // 8)))))::int AS slice
  FROM sharded
)
SELECT doc_id, size::bigint AS size, text_crc32, 'key' AS law, shard::int AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY slice, doc_id, size, text_crc32) - 1)::bigint AS slot,
  grown_shard::int AS grown_shard
FROM cut
"""

OP10 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len({_blank_words('text')})::bigint AS size,
    {_draw("coalesce(doc_id::varchar, '')")} AS u
  FROM documents
),
sources AS (
  SELECT source, sum(size)::bigint AS s,
    [5.0::double, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::int] AS w,
    ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::int AS turn
  FROM d GROUP BY source
),
rounds AS (
  SELECT 0 AS n, source, s, w, turn, false AS full_ FROM sources
  UNION ALL
  SELECT n + 1, source, s, w, turn, full_ OR 2.0 * s <=
      (1.5 * sum(s) OVER () - sum(CASE WHEN full_ THEN 2.0 * s ELSE 0 END) OVER ())
      * w / nullif(sum(CASE WHEN full_ THEN 0 ELSE w END) OVER (), 0)
  FROM rounds WHERE n < (SELECT count(*) FROM sources)
),
last AS (SELECT * FROM rounds WHERE n = (SELECT max(n) FROM rounds)),
targets AS (
  SELECT source, s, turn, CASE WHEN full_ THEN 2.0 * s ELSE
    (1.5 * sum(s) OVER () - sum(CASE WHEN full_ THEN 2.0 * s ELSE 0 END) OVER ())
    / nullif(sum(CASE WHEN full_ THEN 0 ELSE w END) OVER (), 0) * w END AS target
  FROM last
),
placed AS (
  SELECT doc_id, size, s, target, turn,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY u, doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2 AS middle
  FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
),
parts AS (SELECT *, middle / nullif(target, 0) AS p FROM placed)
SELECT doc_id, size, s AS source_size, target,
  (size * ((middle < target)::int + (middle + s < target)::int))::bigint AS taken,
  CASE WHEN middle < target THEN round(CASE turn
    WHEN 0 THEN CASE WHEN p * 5.0 < 2.75 THEN 2 * p * 5.0 / (6.0 + sqrt(36.0 - 4.0 * p * 5.0))
      ELSE 0.5 + 2 * (p * 5.0 - 2.75) / (5.0 + sqrt(25.0 - 4.0 * (p * 5.0 - 2.75))) END
    WHEN 1 THEN p
    ELSE CASE WHEN p < 0.375 THEN 2 * p / (0.5 + sqrt(0.25 + 2.0 * p))
      ELSE 0.5 + 2 * (p - 0.375) / (1.0 + sqrt(1.0 + 2.0 * (p - 0.375))) END
  END, 9) END AS first_position
FROM parts
"""

OP5 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, octet_length(encode(coalesce(html, ''))) AS size FROM pages
),
d AS (SELECT *, sha1(payload) AS hx, max(page_id) OVER (PARTITION BY payload) AS last_id FROM p)
SELECT page_id, size::bigint AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(hx, (1 + 5 * (k // 4))::bigint, 5))::int >> (15 - 5 * (k % 4))::int) & 31) + 1, 1)), '')
    AS payload_digest,
  CASE WHEN last_id IS NULL OR page_id IS NOT DISTINCT FROM last_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM last_id THEN NULL ELSE last_id END AS refers_to
FROM d
"""


def _license_sql() -> str:
    phrases = ", ".join(f"('{text}', '{label}')" for text, label in PHRASES)
    notices = ", ".join(f"({i}, '{text}', '{label}')" for i, (text, label) in enumerate(NOTICES))
    return f"""
WITH d AS (SELECT doc_id, {_alphanumeric_words('text')} AS ws FROM documents),
phrases AS (SELECT string_split(p, ' ') AS parts, label FROM (VALUES {phrases}) t(p, label)),
notices AS (SELECT id, string_split(p, ' ') AS parts, label FROM (VALUES {notices}) t(id, p, label)),
w AS (SELECT doc_id, generate_subscripts(ws, 1) - 1 AS i, unnest(ws) AS word FROM d),
base AS (
  SELECT w.doc_id, w.i, label FROM w JOIN phrases ON w.word = parts[1] JOIN d ON d.doc_id = w.doc_id
  WHERE d.ws[w.i + 1:w.i + len(parts)] = parts
),
tw AS (
  SELECT DISTINCT id, label, len(parts) AS length, len(list_distinct(parts)) AS size, unnest(parts) AS word FROM notices
),
used AS (SELECT w.doc_id, w.i, w.word, id, label, length, size FROM w JOIN tw ON w.word = tw.word),
enough AS (
  SELECT * FROM used SEMI JOIN (
    SELECT doc_id, id FROM used GROUP BY doc_id, id
    HAVING count(DISTINCT word) >= ceil({CONTAINED} * min(size) - 1e-9)
  ) m ON used.doc_id = m.doc_id AND used.id = m.id
),
blocks AS (
  SELECT a.doc_id, a.id, a.i, any_value(a.label) AS label, any_value(a.size) AS size, count(DISTINCT b.word) AS n
  FROM enough a JOIN enough b ON a.doc_id = b.doc_id AND a.id = b.id AND b.i >= a.i AND b.i < a.i + a.length
  GROUP BY a.doc_id, a.id, a.i
),
met AS (SELECT doc_id, label, n / size AS share FROM blocks WHERE n >= ceil({CONTAINED} * size - 1e-9)),
said AS (
  SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM base GROUP BY doc_id
),
named AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM met) GROUP BY doc_id
),
best AS (SELECT doc_id, max(share) AS score FROM met GROUP BY doc_id)
SELECT doc_id, len(ws)::bigint AS n_words, coalesce(n_base, 0)::bigint AS n_base, first_word::bigint AS first_word,
  last_word::bigint AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(score, 0.0) END::double AS score
FROM d LEFT JOIN said USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN best USING (doc_id)
"""


def _phrase_sql() -> str:
    pieces = f"regexp_split_to_array({_lower('text')}, '[.,;:!?\\x0A-\\x0D]')"
    words = "list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '')"
    cut = "array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:], ' ') AS rest"
    return f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest({pieces}) AS piece FROM documents),
split AS (SELECT lang, {words} AS ws FROM pieces),
totals AS (SELECT lang, sum(len(ws)) AS n FROM split GROUP BY lang),
sizes AS (SELECT unnest(range(1, {LONGEST + 1})) AS m),
f AS (
  SELECT lang, m, ws, count(*)::hugeint AS n
  FROM (SELECT lang, m, ws[i:i + m - 1] AS ws
        FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM split, sizes WHERE len(ws) >= m))
  GROUP BY ALL HAVING count(*) >= {SUPPORT}
),
c AS (SELECT lang, m, ws, array_to_string(ws, ' ') AS phrase, n AS a FROM f WHERE m >= 2),
named AS (SELECT lang, array_to_string(ws, ' ') AS phrase, n FROM f),
cuts AS (
  SELECT lang, phrase, a, k, {cut} FROM (SELECT *, unnest(range(1, m)) AS k FROM c)
),
scores AS (
  SELECT cuts.lang, cuts.phrase, a, k, h.n AS l, r.n AS r, {SCALE} * a // (h.n + r.n) AS score
  FROM cuts JOIN named h ON h.lang = cuts.lang AND h.phrase = head
  JOIN named r ON r.lang = cuts.lang AND r.phrase = rest
),
least AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, phrase, max(a) AS longer
  FROM (SELECT lang, a, array_to_string(ws[i:i + s - 1], ' ') AS phrase
        FROM (SELECT lang, a, ws, s, unnest(range(1, m - s + 2)) AS i
              FROM (SELECT *, unnest(range(2, m)) AS s FROM c)))
  GROUP BY lang, phrase
),
kept AS (
  SELECT least.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM least LEFT JOIN inside USING (lang, phrase) WHERE 100 * coalesce(longer, 0) < {INSIDE_PERCENT} * a
)
SELECT lang, rank, phrase, a::bigint AS a, l::bigint AS l, r::bigint AS r, n::bigint AS n, score::bigint AS score
FROM kept JOIN totals USING (lang) WHERE rank <= {BEST}
"""


def _crc32(text: str) -> str:
    """CRC-32 of a text's bytes, four bits at a time."""
    digits = f"string_split(hex(encode({text})), '')"
    nibbles = f"list_transform(range(0, len({digits})), lambda k: ('0x' || ({digits})[k - 2 * (k % 2) + 2])::bigint)"
    step = f"xor(c >> 4, ({_CRC})[(xor(c, b) & 15) + 1])"
    return f"xor(list_reduce({nibbles}, lambda c, b: {step}, 4294967295::bigint), 4294967295::bigint)"


OP13 = f"""
WITH given AS (
  SELECT conv_id::bigint AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
),
hashed AS (SELECT c, turn, text, md5(length(role)::varchar || ':' || role || text) AS digest FROM given),
placed AS (
  SELECT c, digest, length(text)::bigint AS tokens,
    row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, digest) - 1 AS place
  FROM hashed
),
convs AS (
  SELECT c, c - c % {FAMILY} AS source, {_crc32('c::varchar')} % {TURNS} AS wanted
  FROM (SELECT DISTINCT c FROM placed)
),
rebuilt AS (
  SELECT convs.c, 0 AS part, place, digest, tokens
  FROM convs JOIN placed ON placed.c = source AND place < wanted
  UNION ALL
  SELECT convs.c, 1, place, digest, tokens FROM convs JOIN placed ON placed.c = convs.c AND place >= wanted
),
paths AS (
  SELECT c, tokens, row_number() OVER w AS depth, md5(string_agg(digest, ',') OVER w) AS name,
    count(*) OVER (PARTITION BY c) AS turns
  FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY part, place ROWS UNBOUNDED PRECEDING)
  UNION ALL
  SELECT c, 0, 0, '', (SELECT count(*) FROM rebuilt WHERE rebuilt.c = convs.c) FROM convs
),
nodes AS (
  SELECT depth, name, min(c) AS owner, count(*) AS n_convs, max(tokens) AS tokens FROM paths GROUP BY depth, name
),
edges AS (
  SELECT nodes.*, above.name AS above, parents.owner AS parent_conv_id
  FROM nodes LEFT JOIN paths above ON above.c = nodes.owner AND above.depth = nodes.depth - 1
  LEFT JOIN nodes parents ON parents.depth = above.depth AND parents.name = above.name
),
children AS (SELECT depth - 1 AS depth, above AS name, count(*) AS n_children FROM edges WHERE depth > 0 GROUP BY 1, 2),
worth AS (
  SELECT nodes.depth, owner, (n_convs - 1) * tokens AS saved, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf
  FROM nodes LEFT JOIN children USING (depth, name)
),
below AS (
  SELECT paths.depth, name, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens
  FROM paths JOIN worth ON owner = c AND worth.depth >= paths.depth GROUP BY ALL
),
ended AS (
  SELECT depth, name, string_agg(c::varchar, ',' ORDER BY c) AS ids FROM paths WHERE depth = turns GROUP BY ALL
)
SELECT owner AS conv_id, edges.depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children,
  n_leaves::bigint AS n_leaves, saved_tokens::bigint AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM edges LEFT JOIN children USING (depth, name) LEFT JOIN below USING (depth, name) LEFT JOIN ended USING (depth, name)
"""


ORACLE = {
    "op2_decontaminate": OP2,
    "op4_host_rules": OP4,
    "op5_dictionary_warc": OP5,
    "op6_rendezvous_shards": OP6,
    "op9_license_notices": _license_sql(),
    "op10_curriculum_mix": OP10,
    "op12_phrase_mining": _phrase_sql(),
    "op13_prefix_trie": OP13,
}
