"""SQL of the corpus queries that plain SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _reached(nodes: str, links: str) -> str:
    """Recursive tables: `walk` (start, node) over `links` (a, b) both ways, `roots` (node, root) of all `nodes`."""
    return f"""
    both_ways AS (SELECT a, b FROM {links} UNION ALL SELECT b, a FROM {links}),
    walk(start, node) AS (
      SELECT id, id FROM {nodes}
      UNION
      SELECT w.start, e.b FROM walk w JOIN both_ways e ON e.a = w.node
    ),
    roots AS (SELECT start AS node, min(node) AS root FROM walk GROUP BY start)"""


MINHASH = f"""
    WITH RECURSIVE words AS (
      SELECT doc_id AS id, regexp_extract_all({_LOWER}, {_SPACED}) AS w FROM documents
    ), shingles AS (
      SELECT DISTINCT id, array_to_string(w[k : k + 4], ' ') AS s
      FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM words WHERE len(w) > 0)
    ), sizes AS (
      SELECT id, count(s) AS n FROM words LEFT JOIN shingles USING (id) GROUP BY id
    ), links AS (
      SELECT a.id AS a, b.id AS b
      FROM shingles a JOIN shingles b ON a.s = b.s AND a.id < b.id
      JOIN sizes x ON x.id = a.id JOIN sizes y ON y.id = b.id
      GROUP BY a.id, b.id, x.n, y.n
      HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
    ), {_reached("words", "links")}
    SELECT id AS doc_id, n AS n_shingles, root AS component_id, id = root AS kept
    FROM sizes JOIN roots ON node = id
"""

DECONTAMINATE = f"""
    WITH docs AS (
      SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents
    ), items AS (
      SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark
    ), item_windows AS (
      SELECT DISTINCT item, n, array_to_string(w[k : k + n - 1], ' ') AS win
      FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM items WHERE len(w) > 0)
    ), doc_windows AS (
      SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS win
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k
            FROM docs, (SELECT DISTINCT n FROM item_windows) WHERE len(w) >= n)
    ), hits AS (
      SELECT doc_id, n, k, item FROM doc_windows JOIN item_windows USING (n, win)
    ), hit_words AS (
      SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id
    ), hit_items AS (
      SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS named FROM hits GROUP BY doc_id
    )
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(named, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


def _escaped(column: str) -> str:
    """Length of a text after `chat.escape`: one more character per backslash and control string."""
    strings = ("\\", "<|", "<s>", "</s>", "|>", "[INST]", "[/INST]")
    more = " + ".join(f"(length({column}) - length(replace({column}, '{s}', ''))) // {len(s)}" for s in strings)
    return f"(length({column}) + {more})"


CHAT = f"""
    WITH turns AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL
      SELECT -7, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS added(turn, role)
    ), sized AS (
      SELECT *, 5 + {_escaped("role")} + {_escaped("text")} AS chars FROM turns
    ), placed AS (
      SELECT *, greatest(1, CAST(ceil(chars / 4) AS BIGINT)) AS tokens FROM sized
    ), summed AS (
      SELECT *, CAST(coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn, role, text
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM placed
    ), led AS (
      SELECT *, first_value(CASE WHEN role = 'system' THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY before) AS lead FROM summed
    ), sides AS (
      SELECT *, greatest(896 - lead, 448) AS body, body - body // 4 AS width FROM led
    ), owned AS (
      SELECT *, before // width AS stretch,
             2 * (before // width) + CASE WHEN before + tokens > (before // width) * width + body THEN 1 ELSE 0 END AS win FROM sides
    ), windows AS (
      SELECT conv_id, win, min(before) AS first, 1024 - sum(tokens) AS room, max(lead) AS lead,
             min(before) > 0 AND max(lead) > 0 AND max(lead) <= 1024 - sum(tokens) AS leads
      FROM owned GROUP BY conv_id, win
    ), copies AS (
      SELECT conv_id, win, chars, tokens FROM owned
      UNION ALL
      SELECT o.conv_id, w.win, chars, tokens FROM owned o JOIN windows w
        ON o.conv_id = w.conv_id AND (o.before > 0 OR o.lead = 0) AND o.before + o.tokens <= w.first
        AND o.before >= w.first - least(128, w.room - CASE WHEN leads THEN w.lead ELSE 0 END)
      UNION ALL
      SELECT o.conv_id, w.win, chars, tokens FROM owned o JOIN windows w ON o.conv_id = w.conv_id AND w.leads AND o.before = 0
    ), lengths AS (
      SELECT conv_id, CAST(sum(chars + 8) AS BIGINT) AS formatted_chars FROM copies GROUP BY conv_id
    ), told AS (
      SELECT conv_id, count(*) AS n_turns,
             sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
             coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss
      FROM turns GROUP BY conv_id
    )
    SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
    FROM told JOIN lengths USING (conv_id)
"""

EMBEDDINGS = f"""
    WITH RECURSIVE vectors AS (
      SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    ), usable AS (
      SELECT id, v FROM vectors
      WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(v, lambda x: x <> 0)) > 0
    ), links AS (
      SELECT a.id AS a, b.id AS b FROM usable a JOIN usable b ON a.id < b.id AND len(a.v) = len(b.v)
      WHERE list_cosine_similarity(a.v, b.v) >= 0.9
    ), {_reached("vectors", "links")}, degrees AS (
      SELECT a AS id, count(*) AS n FROM both_ways GROUP BY a
    )
    SELECT id AS vec_id, coalesce(n, 0) AS n_links, root AS component_id, id = root AS kept
    FROM vectors JOIN roots ON node = id LEFT JOIN degrees USING (id)
"""

SUBSTRINGS = f"""
    WITH docs AS (
      SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents
    ), words AS (
      SELECT doc_id, p, w[p] AS word, CASE WHEN p + 19 <= len(w) THEN array_to_string(w[p : p + 19], ' ') END AS win
      FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM docs)
    ), again AS (
      SELECT doc_id, p, word, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, p) > 1 AS again FROM words
    ), judged AS (
      SELECT doc_id, p, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
      FROM again
    ), kept AS (
      SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS text
      FROM judged GROUP BY doc_id
    )
    SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
    FROM docs LEFT JOIN kept USING (doc_id)
"""

URLS = """
    WITH RECURSIVE cut AS (
      SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
    ), parts AS (
      SELECT page_id,
             coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
      FROM cut
    ), rules(kind, rule_host, rule_path) AS (
      VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
             ('block', 'net', '/es/'), ('block', 'net', '/fr/')
    ), ruled AS (
      SELECT page_id, host, path, string_split(regexp_replace(path, '^/', ''), '/') AS seg,
             arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
             arg_max(kind, length(rule_host || rule_path)) AS told
      FROM parts LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
      GROUP BY page_id, host, path
    ), shaped AS (
      SELECT *, list_transform(seg, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '*' || regexp_extract(x, '([.][A-Za-z]+)$', 1) ELSE x END) AS shape
      FROM ruled
    ), patterns AS (
      SELECT host, shape, count(told) AS n, count(*) FILTER (told = 'block') AS k FROM shaped GROUP BY host, shape
    ), steps AS (
      SELECT host, shape, level, shape[level] AS segment, array_to_string(shape[1 : level - 1], '/') AS parent
      FROM (SELECT host, shape, unnest(range(1, len(shape) + 1)) AS level FROM patterns)
    ), broad AS (
      SELECT host, level, parent FROM steps GROUP BY host, level, parent HAVING count(DISTINCT segment) > 24
    ), templates AS (
      SELECT host, shape, list(CASE WHEN b.level IS NULL THEN segment ELSE '*' END ORDER BY s.level) AS part
      FROM steps s LEFT JOIN broad b USING (host, level, parent) GROUP BY host, shape
    ), nodes AS (
      SELECT host, shape, depth, CASE WHEN depth = 0 THEN '' ELSE '/' || array_to_string(part[1:depth], '/') END AS node, n, k
      FROM (SELECT *, unnest(range(0, len(part) + 1)) AS depth FROM templates JOIN patterns USING (host, shape))
    ), counts AS (
      SELECT host, node, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(k) AS DOUBLE) AS k FROM nodes GROUP BY host, node
    ), chain AS (
      SELECT host, shape, depth, c.n, c.k FROM nodes JOIN counts c USING (host, node)
    ), descend AS (
      SELECT host, shape, -1 AS depth, CAST(0.5 AS DOUBLE) AS score, CAST(0 AS DOUBLE) AS n, CAST(0 AS DOUBLE) AS k FROM patterns
      UNION ALL
      SELECT host, shape, depth, CASE WHEN alike THEN up_score ELSE (k + 4.0 * up_score) / (n + 4.0) END,
             CASE WHEN alike THEN up_n ELSE n END, CASE WHEN alike THEN up_k ELSE k END
      FROM (
        SELECT c.*, d.score AS up_score, d.n AS up_n, d.k AS up_k,
               CASE WHEN c.n = 0 THEN true WHEN d.n = 0 THEN false
                    ELSE abs(d.k / d.n - c.k / c.n)
                         <= 1.96 * sqrt((d.k + c.k) / (d.n + c.n) * (1 - (d.k + c.k) / (d.n + c.n)) * (1 / d.n + 1 / c.n)) END AS alike
        FROM descend d JOIN chain c ON c.host = d.host AND c.shape = d.shape AND c.depth = d.depth + 1
      )
    ), scored AS (
      SELECT host, shape, '/' || array_to_string(part, '/') AS template, score
      FROM descend JOIN templates USING (host, shape) WHERE depth = len(part)
    )
    SELECT page_id, host, path, rule, coalesce(told, CASE WHEN score >= 0.75 THEN 'block' ELSE 'allow' END) AS verdict,
           template, round(score, 6) AS score
    FROM shaped JOIN scored USING (host, shape)
"""

#: Table `crc_table` (v): the 256 steps of the CRC-32 with the reflected polynomial 0xEDB88320, a fixed value.
_CRC_TABLE = """
    crc_bits(i, k, c) AS (
      SELECT i, 0, CAST(i AS BIGINT) FROM range(256) t(i)
      UNION ALL
      SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END FROM crc_bits WHERE k < 8
    ), crc_table AS (SELECT list(c ORDER BY i) AS v FROM crc_bits WHERE k = 8)"""


def _crc32(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes; `crc_table` must be joined."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(4294967295, list_reduce({octets}, lambda a, b: xor(a >> 8, crc_table.v[(xor(a, b) & 255) + 1]), CAST(4294967295 AS BIGINT)))"


NEGATIVES = """
    WITH told AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS v
      FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), pairs AS (
      SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id AS id, b.label AS label,
             CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
      FROM told a JOIN told b ON a.vec_id % 100 = 0 AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
    ), positives AS (
      SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE label = anchor_label
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
    ), ranked AS (
      SELECT anchor_id, positive_id, positive_score, p.id AS negative_id, p.score AS negative_score,
             row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY p.score DESC, p.id) AS rank
      FROM positives JOIN pairs p USING (anchor_id)
      WHERE p.label <> p.anchor_label AND 30 * positive_score <= 100 * p.score AND 100 * p.score <= 90 * positive_score
    )
    SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""

SHARDS = f"""
    WITH RECURSIVE {_CRC_TABLE}, rows AS (
      SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 16 AS BIGINT) AS size,
             {_crc32("coalesce(text, '')")} AS text_crc32
      FROM documents, crc_table
    ), walk(doc_id, number, before, place, next) AS (
      SELECT DISTINCT doc_id, CAST(coalesce(doc_id, 0) AS HUGEINT) + CASE WHEN doc_id < 0 THEN 18446744073709551616 ELSE 0 END,
             CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT) FROM documents
      UNION ALL
      SELECT doc_id, number, place, next,
             CAST(floor((next + 1) * (CAST(2147483648 AS DOUBLE) / CAST(number // 8589934592 + 1 AS DOUBLE))) AS BIGINT)
      FROM (SELECT doc_id, (number * 2862933555777941757 + 1) % 18446744073709551616 AS number, place, next FROM walk WHERE next < 41)
    ), placed AS (
      SELECT doc_id, CAST(CASE WHEN place = 40 THEN before ELSE place END AS INT) AS shard, CAST(place AS INT) AS grown_shard FROM walk WHERE next >= 41
    )
    SELECT r.doc_id, size, text_crc32, 'key' AS law, shard,
           row_number() OVER (PARTITION BY shard ORDER BY r.doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
    FROM rows r JOIN placed p ON r.doc_id IS NOT DISTINCT FROM p.doc_id
"""

SPELLING = f"""
    WITH RECURSIVE {_CRC_TABLE}, runs AS (
      SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all({_LOWER}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents
    ), told AS (
      SELECT run, n, {_crc32("id || ':' || run")} AS h
      FROM (SELECT id, run, count(*) AS n FROM runs GROUP BY id, run), crc_table
    ), found AS (
      SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n
      FROM told
    ), words AS (
      SELECT word, CAST(sum(n) AS BIGINT) AS n FROM found WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
    ), cuts AS (
      SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS k FROM words)
    ), longer AS (
      SELECT DISTINCT w.word AS a, c.word AS b FROM words w JOIN cuts c ON c.rest = w.word
    ), near AS (
      SELECT a.word, b.word AS other FROM cuts a JOIN cuts b ON a.k = b.k AND a.rest = b.rest AND length(a.word) = length(b.word) AND a.word <> b.word
      UNION ALL SELECT a, b FROM longer
      UNION ALL SELECT b, a FROM longer
    ), best AS (
      SELECT e.word, count(*) OVER (PARTITION BY e.word) AS n_near, e.other, o.n AS other_n,
             row_number() OVER (PARTITION BY e.word ORDER BY o.n DESC, e.other) AS r
      FROM near e JOIN words o ON o.word = e.other
    ), formed AS (
      SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form, CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n
      FROM words w LEFT JOIN best b ON b.word = w.word AND r = 1
    ), follow(word, last, step) AS (
      SELECT word, word, 0 FROM formed
      UNION ALL
      SELECT f.word, g.form, step + 1 FROM follow f JOIN formed g ON g.word = f.last WHERE g.form IS NOT NULL
    ), ends AS (
      SELECT word, arg_max(last, step) AS root FROM follow GROUP BY word
    )
    SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""
