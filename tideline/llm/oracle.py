"""DuckDB SQL of the training-data operators that SQL can express on whole tables."""

from __future__ import annotations

#: One row: the 256 values of a byte-wise CRC-32.
_CRC_TABLE = "crc AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tab)"


def _crc(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a text that is not empty, beside ``crc``."""
    code = lambda k: f"(instr('0123456789ABCDEF', substr(hex({text}), 2 * i + {k}, 1)) - 1)"
    octets = f"list_transform(range(0, length(hex({text})) // 2), lambda i: {code(1)} * 16 + {code(2)})"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {octets}), lambda a, b: xor(a >> 8, tab[xor(a & 255, b) + 1])))"


PREFIX_TRIE = f"""WITH {_CRC_TABLE},
t AS (SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
h AS (SELECT c, own, {_crc("CAST(c AS VARCHAR)")} % 9 AS h FROM t, crc),
b AS (SELECT h.c, list_concat(coalesce(t.own, [])[1:h.h], h.own[h.h + 1:]) AS path FROM h LEFT JOIN t ON t.c = h.c - h.c % 5),
n AS (SELECT list_slice(path, 1, d) AS node, d, min(c) AS conv_id, count(*) AS n, list(c ORDER BY c) FILTER (len(path) = d) AS ends FROM (SELECT c, path, unnest(range(0, len(path) + 1)) AS d FROM b) GROUP BY 1, 2),
k AS (SELECT n.*, p.conv_id AS parent_conv_id, CASE WHEN n.d = 0 THEN 0 ELSE (n.n - 1) * octet_length(encode(n.node[-1].t)) END AS own_saved FROM n LEFT JOIN n p ON n.d > 0 AND p.d = n.d - 1 AND p.node = list_slice(n.node, 1, n.d - 1)),
e AS (SELECT conv_id, d, unnest(range(0, d + 1)) AS up, node, own_saved, NOT EXISTS (SELECT 1 FROM k x WHERE x.parent_conv_id = k.conv_id AND x.d = k.d + 1) AS leaf FROM k),
s AS (SELECT list_slice(node, 1, up) AS node, up AS d, count(*) FILTER (leaf) AS n_leaves, sum(own_saved) AS saved_tokens, count(*) FILTER (d = up + 1) AS n_children FROM e GROUP BY 1, 2)
SELECT k.conv_id, CAST(k.d AS BIGINT) AS depth, k.parent_conv_id, k.n AS n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(array_to_string(ends, ','), '')) AS ends_sha256 FROM k JOIN s ON k.node = s.node AND k.d = s.d"""


def url_filters(rules: list[tuple[str, str, str]]) -> str:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return f"""WITH r(rule_host, rule_path, verdict) AS (VALUES {values}), p AS (SELECT page_id, row_number() OVER () AS row, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, row, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
m AS (SELECT row, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict FROM u JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (row)"""


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

IMPORTANCE = f"""WITH {_CRC_TABLE}, d AS (SELECT doc_id, row_number() OVER () AS row, {_WORDS} AS words FROM documents), w AS (SELECT row, unnest(words) AS word FROM d), v AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
c AS MATERIALIZED (SELECT word, {_crc("word")} % 10000 AS bucket FROM (SELECT word FROM w UNION SELECT word FROM v), crc),
s AS (SELECT bucket, count(*) AS s FROM w JOIN c USING (word) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM v JOIN c USING (word) GROUP BY 1),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(s), 0) FROM s) + 10000.0::DOUBLE) / ((coalesce(s, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000.0::DOUBLE)))) AS BIGINT) AS gain FROM (SELECT DISTINCT bucket FROM c) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
x AS (SELECT row, count(*) AS n, sum(gain) AS weight FROM w JOIN c USING (word) JOIN g USING (bucket) GROUP BY 1),
y AS (SELECT doc_id, row, coalesce(n, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN x USING (row)),
z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score, n_features >= 20 AS able FROM y),
q AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY able) AS n FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= n * 10 // 100 THEN place END AS rank FROM q"""
