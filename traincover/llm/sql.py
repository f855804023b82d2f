"""What the queries return, in DuckDB's SQL, where SQL can express it. Nothing here is taken from the operators.

Left out: op1 (a trained model), op2 (folds by crc32, which the SQL lacks), op6 (a tokenizer), op10 (a classifier).
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"

_JACCARD = rf"""
WITH RECURSIVE tokens AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
    FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM tokens WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
    GROUP BY 1, 2
),
links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)
),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""

_CHAT = """
WITH turns AS (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
    UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
),
plain AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
        lag(coalesce(role, '')) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
        -- a backslash becomes two characters, <| becomes four; each of a role's line feeds too becomes two
        length(coalesce(text, '')) + length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(92), ''))
            + length(coalesce(text, '')) - length(replace(coalesce(text, ''), '<|', '')) AS escaped
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(escaped + CASE WHEN before = role THEN 10 ELSE 12 + length(role) + 1 + 11 END)::BIGINT AS formatted_chars
FROM plain GROUP BY conv_id
"""

_TOPK = """
WITH v AS (
    SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(64 * x)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM pairs QUALIFY rank <= 20
"""

_HARD = """
WITH v AS (
    SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
scored AS (
    SELECT a.k AS ak, a.vec_id AS anchor_id, a.label AS al, c.k, c.vec_id, c.label, list_inner_product(a.v, c.v)::BIGINT AS score
    FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.k <> a.k
),
positives AS (
    SELECT ak, anchor_id, al, vec_id AS positive_id, score AS positive_score FROM scored WHERE label = al
    QUALIFY row_number() OVER (PARTITION BY ak ORDER BY score DESC, vec_id NULLS LAST, k) <= 5
)
SELECT p.anchor_id, positive_id,
    row_number() OVER (PARTITION BY p.ak, positive_id ORDER BY s.score DESC, s.vec_id NULLS LAST, s.k)::INTEGER AS rank,
    s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.ak = p.ak AND s.label <> p.al
    AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY rank <= 5
"""

_MIX = rf"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size,
        md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS shuffle
    FROM documents
),
sources AS (
    SELECT source, sum(size)::BIGINT AS source_size,
        CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
    FROM sized GROUP BY source
),
-- the level at which sources of smaller size per weight are full: the greatest of all that try
levels AS (
    SELECT (1.5 * (SELECT sum(source_size) FROM sources)::DOUBLE - coalesce(sum(2 * f.source_size) FILTER (
            f.source_size / f.weight < s.source_size / s.weight), 0)::DOUBLE)
        / sum(f.weight) FILTER (f.source_size / f.weight >= s.source_size / s.weight) AS level
    FROM sources s JOIN sources f ON true GROUP BY s.source, s.source_size, s.weight
),
wanted AS (
    SELECT *, least(2.0::DOUBLE * source_size, (SELECT max(level) FROM levels) * weight)::DOUBLE AS target FROM sources
),
placed AS (
    SELECT doc_id, z.source, size, source_size, target, floor(target + 0.5)::BIGINT AS need,
        (sum(size) OVER (PARTITION BY z.source ORDER BY shuffle, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
    FROM sized z JOIN wanted w ON z.source IS NOT DISTINCT FROM w.source
)
SELECT doc_id, source, size, source_size, target,
    (greatest(least(start + size, need) - start, 0)
        + greatest(least(source_size + start + size, need) - source_size - start, 0))::BIGINT AS taken
FROM placed
"""

_EXACT = r"""
WITH plain AS (
    SELECT doc_id, length(coalesce(text, '')) AS points,
        sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
    FROM documents
),
best AS (
    SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST) AS keep_id,
        count(*) OVER (PARTITION BY text_sha256) AS group_size
    FROM plain
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM best
"""

_LINES = """
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
numbered AS (SELECT doc_id, unnest(lines) AS line, unnest(generate_series(1, len(lines))) AS i FROM cut),
hashed AS (SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h FROM numbered),
flagged AS (
    SELECT doc_id, line, i, i = 1 OR (h + 31 * coalesce(lag(h) OVER w, 0) + 961 * coalesce(lag(h, 2) OVER w, 0)) % 2147483647 % 4 = 0 AS starts
    FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)
),
placed AS (SELECT *, sum(starts::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS place FROM flagged),
chunks AS (SELECT doc_id, place, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk FROM placed GROUP BY doc_id, place),
ranked AS (SELECT *, n >= 2 AND row_number() OVER (PARTITION BY chunk ORDER BY doc_id, place) > 1 AS gone FROM chunks)
SELECT doc_id, sum(n)::BIGINT AS n_lines, coalesce(sum(n) FILTER (gone), 0)::BIGINT AS removed_lines,
    count(*) FILTER (gone) AS removed_chunks,
    sha256(coalesce(string_agg(chunk, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS text_sha256
FROM ranked GROUP BY doc_id
"""

EXPECTED = {
    "op3_jaccard_join": _JACCARD,
    "op4_chat_format": _CHAT,
    "op5_exact_topk": _TOPK,
    "op7_mix_sources": _MIX,
    "op8_line_dedup": _LINES,
    "op9_exact_dedup": _EXACT,
    "op11_hard_negatives": _HARD,
}
