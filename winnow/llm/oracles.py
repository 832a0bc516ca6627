"""DuckDB SQL for the queries of this package that it can express."""

# One nibble at a time; the sixteen values are those of the reflected polynomial 0xEDB88320.
_CRC32 = """
    xor(4294967295, list_reduce(
        list_concat([4294967295::BIGINT], flatten(list_transform(
            string_split(conv_id::VARCHAR, ''), lambda s: [(ascii(s) & 15)::BIGINT, (ascii(s) >> 4)::BIGINT]))),
        lambda c, v: xor(c >> 4, [
            0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384,
            4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108
        ][(xor(c, v) & 15) + 1])))
"""

PREFIX_TRIE = f"""
WITH turns AS (
    SELECT conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(t ORDER BY pos) AS ts FROM turns GROUP BY conv_id),
hashed AS (SELECT conv_id, ts, (({_CRC32}) % 4)::BIGINT AS h FROM own),
rebuilt AS (
    SELECT a.conv_id, list_concat(coalesce(b.ts[1:a.h], []), a.ts[a.h + 1:]) AS ts
    FROM hashed a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 20),
prefixes AS (
    SELECT conv_id, len(ts) AS total, d AS depth, md5(to_json(ts[1:d])) AS k,
        CASE WHEN d > 0 THEN md5(to_json(ts[1:d - 1])) END AS pk, CASE WHEN d > 0 THEN ts[d].text ELSE '' END AS last
    FROM rebuilt, unnest(range(len(ts) + 1)) AS r(d)),
nodes AS (
    SELECT depth, k, min(pk) AS pk, min(conv_id) AS conv_id, count(*) AS n_convs,
        len(regexp_extract_all(min(last), '[^\\x20\\x09-\\x0D]+')) AS words,
        coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (total = depth), '') AS ends
    FROM prefixes GROUP BY depth, k),
children AS (SELECT depth - 1 AS depth, pk AS k, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
full_nodes AS (
    SELECT n.*, coalesce(c.n, 0) AS n_children
    FROM nodes n LEFT JOIN children c ON c.depth = n.depth AND c.k = n.k),
-- A node's ancestors are the prefixes of its smallest member.
sums AS (
    SELECT p.depth, p.k, sum((n.n_convs - 1) * n.words)::BIGINT AS saved_tokens,
        count(*) FILTER (n.n_children = 0) AS n_leaves
    FROM full_nodes n JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.depth, p.k)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves,
    s.saved_tokens, sha256(n.ends) AS ends_sha256
FROM full_nodes n JOIN sums s ON s.depth = n.depth AND s.k = n.k
    LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.k = n.pk
"""

_TERMS = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
)

LEXICAL_SEARCH = f"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents WHERE len({_TERMS}) > 0),
totals AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM docs),
asked AS (
    SELECT item_id, term, count(*) AS times
    FROM (SELECT item_id, unnest({_TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark))
    GROUP BY item_id, term),
counted AS (
    SELECT r, doc_id, n, term, count(*)::BIGINT AS tf
    FROM (SELECT r, doc_id, len(ts)::BIGINT AS n, unnest(ts) AS term FROM docs) GROUP BY r, doc_id, n, term),
weights AS (
    SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
    FROM counted, totals GROUP BY term, n_docs),
impacts AS (
    SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms))) AS impact
    FROM counted JOIN weights USING (term), totals),
scores AS (
    SELECT item_id, r, doc_id, sum(times * impact)::BIGINT AS score
    FROM asked JOIN impacts USING (term) GROUP BY item_id, r, doc_id),
ranked AS (
    SELECT item_id, doc_id, score,
        row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
    FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
