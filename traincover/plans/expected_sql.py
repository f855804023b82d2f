"""What the queries of `on_tables` must return, in plain SQL over the same tables."""

from __future__ import annotations

from traincover.plans.on_tables import SHARDS, THRESHOLD, TOP_K

# Fixed values, spelled out here so that the SQL does not depend on the code it checks: white space, label and messages.
_WHITESPACE = [
    9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, 8192, 8193, 8194, 8195, 8196, 8197, 8198, 8199, 8200, 8201,
    8202, 8232, 8233, 8239, 8287, 12288,
]
EMPTY_LABEL = "(空)"
MESSAGE_NAME_BLANK = "实体名称为空（将无法作为文本检索目标）"
MESSAGE_ANNOTATION_BLANK = "打标结果（assistant 回答）为空"
MESSAGE_MODEL_BLANK = "打标模型名称为空"
MESSAGE_NO_IMAGE_PATH = "图像相对路径为空"

_CLASS = "".join(f"\\x{{{c:x}}}" for c in _WHITESPACE)
_SPACES = " || ".join(f"chr({c})" for c in _WHITESPACE)


def _strip(text: str) -> str:
    return f"trim({text}, {_SPACES})"


# Vectors and search

_IMAGE_ROWS = """
    image_rows AS (
        SELECT vec_id, embedding::DOUBLE[] AS v, 'v' || label AS version,
               coalesce('img/' || d.doc_id || '.jpg', '') AS image_path, coalesce(d.source, '') AS name,
               coalesce(d.text, '') AS annotation, coalesce(d.lang, '') AS lang
        FROM embeddings LEFT JOIN documents d ON d.doc_id = vec_id
    )"""

_IMAGE_SCORES = _IMAGE_ROWS + """,
    image_scores AS (
        SELECT q.vec_id AS sample_id, c.*, round(list_inner_product(q.v, c.v), 9) AS score
        FROM image_rows q JOIN benchmark ON item_id = q.vec_id CROSS JOIN image_rows c
    )"""

_TEXT_VECTORS = f"""
    words AS (
        SELECT 'doc' AS kind, doc_id AS id, unnest(regexp_extract_all(lower(text), '[^{_CLASS}]+')) AS word
        FROM documents
        UNION ALL
        SELECT 'item', item_id, unnest(regexp_extract_all(lower(text), '[^{_CLASS}]+')) FROM benchmark
    ),
    counts AS (
        SELECT kind, id, ('0x' || substr(md5(word), 1, 4))::INT % 1024 AS bucket, count(*)::DOUBLE AS n
        FROM words GROUP BY ALL
    ),
    weights AS (
        SELECT kind, id, bucket, (n / sqrt(sum(n * n) OVER (PARTITION BY kind, id)))::FLOAT AS w FROM counts
    )"""

_TEXT_MATCHES = _TEXT_VECTORS + f""",
    products AS (
        SELECT q.id AS sample_id, d.id AS doc_id, sum(q.w::DOUBLE * d.w::DOUBLE) AS score
        FROM weights q JOIN weights d ON q.bucket = d.bucket AND q.kind = 'item' AND d.kind = 'doc' GROUP BY ALL
    ),
    text_matches AS (
        SELECT item_id AS sample_id, d.doc_id AS index_id, round(coalesce(o.score, 0), 9) AS score,
               d.source AS name, d.lang, d.text AS annotation, 'img/' || d.doc_id || '.jpg' AS image_path,
               row_number() OVER (PARTITION BY item_id ORDER BY round(coalesce(o.score, 0), 9) DESC, d.doc_id)::INT AS rank
        FROM benchmark CROSS JOIN documents d
        LEFT JOIN products o ON o.sample_id = item_id AND o.doc_id = d.doc_id
        WHERE {_strip('d.text')} <> ''
        QUALIFY rank <= {TOP_K}
    )"""

_MATCHES = _IMAGE_SCORES + "," + _TEXT_MATCHES + f""",
    image_matches AS (
        SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, version, vec_id)::INT AS rank
        FROM image_scores WHERE vec_id <> sample_id QUALIFY rank <= {TOP_K}
    ),
    samples AS (SELECT item_id AS sample_id, text AS query_text FROM benchmark),
    matches AS (
        SELECT sample_id, 'image' AS channel, rank, score, image_path, name AS text, annotation,
               '[' || version || '] ' || lang AS source
        FROM image_matches
        UNION ALL
        SELECT sample_id, 'text', rank, score, image_path, name, annotation, lang FROM text_matches
    ),
    best AS (
        SELECT sample_id, query_text,
               coalesce(max(score) FILTER (channel = 'image'), 0) AS best_image,
               coalesce(max(score) FILTER (channel = 'text'), 0) AS best_text
        FROM samples LEFT JOIN matches USING (sample_id) GROUP BY ALL
    ),
    shared AS (
        SELECT DISTINCT i.sample_id, i.text, least(i.score, t.score) AS agree_at
        FROM matches i JOIN matches t ON i.sample_id = t.sample_id AND i.text = t.text
        WHERE i.channel = 'image' AND t.channel = 'text' AND i.text <> ''
    )"""


def _classified(threshold: str, source: str = "best") -> str:
    return f"""
        SELECT *,
               CASE WHEN a THEN 'agree' WHEN i AND t THEN 'both' WHEN i THEN 'image' WHEN t THEN 'text' ELSE 'none' END
                   AS category
        FROM (
            SELECT b.*, best_image >= {threshold} AS i, best_text >= {threshold} AS t,
                   EXISTS (SELECT 1 FROM shared s WHERE s.sample_id = b.sample_id AND s.agree_at >= {threshold}) AS a
            FROM {source} b
        )"""


_CLASSIFIED = _MATCHES + f", classified AS ({_classified(str(THRESHOLD))})"

_COUNTERS = "count(*) AS total" + "".join(
    f", count(*) FILTER ({condition}) AS {name}, count(*) FILTER ({condition}) * 100 // greatest(count(*), 1) AS {name}_pct"
    for name, condition in {
        "image_hits": "i", "text_hits": "t", "both_hits": "i AND t", "agree_hits": "a", "no_hits": "NOT i AND NOT t",
    }.items()
)


def _selected(name: str, versions: list[str] | None) -> str:
    order = " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(versions or []))
    place = f"CASE version {order} END" if versions else "version"
    where = f"WHERE version IN ({', '.join(repr(v) for v in versions)})" if versions else ""
    source = "lang" if versions and len(versions) == 1 else "'[' || version || '] ' || lang"
    return f"""
        SELECT '{name}' AS selection, sample_id,
               row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, {place}, vec_id)::INT AS rank,
               version, vec_id AS index_id, round(score, 6) AS score, image_path, name AS text, {source} AS source
        FROM image_scores {where} QUALIFY rank <= {TOP_K}"""


# Quality

_ANNOTATED = r"""
    annotated AS (
        SELECT d.doc_id AS global_id,
               CASE WHEN toxic = 1 THEN '' WHEN quality = 0 THEN source ELSE regexp_extract(text, '^\S+') END
                   AS entity_name,
               CASE WHEN toxic = 1 THEN '' ELSE text END AS annotation,
               CASE WHEN l.doc_id IS NULL THEN '' ELSE source || '/' || d.doc_id || '.jpg' END AS image_relative_path,
               source AS source_name,
               CASE WHEN quality IS NOT NULL THEN lang ELSE '' END AS model_name, lang AS source_dataset
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
    )"""

_ISSUES = _ANNOTATED + f""",
    lengths AS (
        SELECT *, {_strip('entity_name')} AS name, {_strip('annotation')} AS body, length(body) AS n FROM annotated
    ),
    issues AS (
        SELECT global_id, 'WARNING' AS severity, 'entity_name' AS field, '{MESSAGE_NAME_BLANK}' AS message, 1 AS place
        FROM lengths WHERE name = ''
        UNION ALL SELECT global_id, 'ERROR', 'annotation', '{MESSAGE_ANNOTATION_BLANK}', 2 FROM lengths WHERE n = 0
        UNION ALL SELECT global_id, 'WARNING', 'annotation', '打标结果过短 (' || n || ' 字符 < 50)', 3
        FROM lengths WHERE n > 0 AND n < 50
        UNION ALL SELECT global_id, 'WARNING', 'annotation', '打标结果过长 (' || n || ' 字符 > 20000)', 4
        FROM lengths WHERE n > 20000
        UNION ALL SELECT global_id, 'INFO', 'annotation', '打标结果中未出现实体名称「' || entity_name || '」', 5
        FROM lengths WHERE n > 0 AND name <> '' AND NOT contains(annotation, name)
        UNION ALL SELECT global_id, 'ERROR', 'image_relative_path', '{MESSAGE_NO_IMAGE_PATH}', 6
        FROM lengths WHERE coalesce(image_relative_path, '') = ''
        UNION ALL SELECT global_id, 'WARNING', 'model_name', '{MESSAGE_MODEL_BLANK}', 7
        FROM lengths WHERE {_strip('model_name')} = ''
    ),
    checked AS (
        SELECT a.*, count(severity) AS n_issues, coalesce(bool_or(severity = 'ERROR'), false) AS has_error
        FROM annotated a LEFT JOIN issues USING (global_id) GROUP BY ALL
    )"""


def _distribution(dimension: str, column: str) -> str:
    return f"""
        SELECT '{dimension}' AS dimension, coalesce(nullif({column}, ''), '{EMPTY_LABEL}') AS value, count(*) AS n,
               row_number() OVER (ORDER BY count(*) DESC, min(global_id))::INT AS rank
        FROM annotated GROUP BY value"""


# JSON

_RECORDS = """
    turns AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations QUALIFY place <= 2
    ),
    records AS (
        SELECT conv_id, max(role) FILTER (place = 1) AS opener, max(text) FILTER (place = 2) AS reply, count(*) AS n
        FROM turns GROUP BY conv_id
    )"""

_STATUSES = _RECORDS + f""",
    prose AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents),
    lines AS (
        SELECT CASE WHEN opener = 'user' AND n = 2 THEN 'ok' ELSE 'bad_record' END AS status FROM records
        UNION ALL SELECT CASE WHEN json_valid(props) THEN 'bad_record' ELSE 'bad_json' END FROM events
        UNION ALL
        SELECT CASE WHEN {_strip('line')} = '' THEN 'blank' WHEN json_valid(line) THEN 'bad_record' ELSE 'bad_json' END
        FROM prose
    )"""

_NUMBERED = """
    numbered AS (
        SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS global_id
        FROM documents
    )"""

EXPECTED = {
    "search_topk": f"""
        SELECT q.vec_id AS sample_id, c.vec_id AS index_id,
               round(list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS exact,
               round(exact, 6) AS score,
               row_number() OVER (PARTITION BY q.vec_id ORDER BY exact DESC, c.vec_id)::INT AS rank
        FROM embeddings q CROSS JOIN embeddings c QUALIFY rank <= {TOP_K}""",
    "ann_search": f"""
        WITH entries AS (
            SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS place FROM embeddings
        ), means AS (SELECT label, place, round(avg(x), 3) AS mean FROM entries GROUP BY label, place),
        centres AS (SELECT label, list(mean ORDER BY place) AS centre FROM means GROUP BY label),
        near AS (
            SELECT vec_id, embedding::DOUBLE[] AS v, c.label AS cell, row_number() OVER (
                PARTITION BY vec_id ORDER BY list_inner_product(embedding::DOUBLE[], centre) DESC, c.label) AS place
            FROM embeddings e CROSS JOIN centres c
        ), scores AS (
            SELECT q.vec_id AS sample_id, c.vec_id AS index_id, round(list_inner_product(q.v, c.v), 9) AS exact
            FROM near q JOIN near c ON q.cell = c.cell AND q.place <= 2 AND c.place = 1
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY exact DESC, index_id)::INT AS rank FROM scores
        )
        SELECT sample_id, rank, index_id, round(exact, 6) AS score FROM ranked WHERE rank <= {TOP_K}""",
    "search_versions": f"WITH {_IMAGE_SCORES} " + " UNION ALL ".join(
        f"SELECT * FROM ({_selected(name, versions)})"
        for name, versions in {"all": None, "some": ["v7", "v2"], "one": ["v3"]}.items()
    ),
    "versions": "SELECT 'v' || label AS version, count(*) AS n_image, 0::BIGINT AS n_text FROM embeddings GROUP BY label",
    "text_search": f"""WITH {_TEXT_MATCHES}
        SELECT sample_id, rank, index_id, round(score, 6) AS score, name AS text, lang AS source FROM text_matches""",
    "text_vectors": f"""WITH {_TEXT_VECTORS}
        SELECT id AS doc_id, bucket, round(w::DOUBLE, 6) AS weight FROM weights WHERE kind = 'doc'""",
    "l2_normalize": """
        WITH stretched AS (
            SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (label + 1)) AS v FROM embeddings
        ), places AS (
            SELECT vec_id, sqrt(list_inner_product(v, v)) AS norm, unnest(v) AS x,
                   unnest(range(len(v))) AS place
            FROM stretched
        )
        SELECT vec_id, place::INT AS place, round(x / norm, 6) AS value FROM places""",
    "score_bands": f"""WITH {_TEXT_MATCHES}
        SELECT CASE WHEN score > 0.9 THEN 'high' WHEN score > 0.7 THEN 'mid' ELSE 'low' END AS band, count(*) AS n
        FROM text_matches GROUP BY band""",
    "coverage_samples": f"""WITH {_CLASSIFIED}
        SELECT sample_id, round(best_image, 6) AS best_image, round(best_text, 6) AS best_text, category
        FROM classified""",
    "coverage_agree": f"""WITH {_MATCHES}
        SELECT sample_id, round(max(agree_at), 6) AS agree_at FROM shared GROUP BY sample_id""",
    "coverage_summary": f"WITH {_CLASSIFIED} SELECT {_COUNTERS} FROM classified",
    "coverage_sweep": f"""WITH {_MATCHES},
        at_each AS (SELECT best.*, n / 20.0::DOUBLE AS threshold FROM best CROSS JOIN range(21) steps(n)),
        classified AS ({_classified('threshold', 'at_each')})
        SELECT threshold, {_COUNTERS} FROM classified GROUP BY threshold""",
    "coverage_filter": f"""WITH {_CLASSIFIED}
        SELECT sample_id, 'all' AS filter FROM classified
        UNION ALL SELECT sample_id, 'image' FROM classified WHERE i
        UNION ALL SELECT sample_id, 'text' FROM classified WHERE t
        UNION ALL SELECT sample_id, 'both' FROM classified WHERE i AND t
        UNION ALL SELECT sample_id, 'agree' FROM classified WHERE category = 'agree'
        UNION ALL SELECT sample_id, 'none' FROM classified WHERE category = 'none'""",
    "overview": f"""WITH {_CLASSIFIED}
        SELECT sample_id AS stem, coalesce(nullif(query_text, ''), '-') AS text, round(best_image, 4) AS best_image,
               round(best_text, 4) AS best_text, category
        FROM classified""",
    "shown_hidden": f"""WITH {_CLASSIFIED},
        shown AS (SELECT sample_id, row_number() OVER (ORDER BY sample_id) AS position FROM classified WHERE t)
        SELECT position, sample_id, channel, count(*) FILTER (score >= {THRESHOLD}) AS n_shown,
               count(*) FILTER (score < {THRESHOLD}) AS n_hidden
        FROM shown LEFT JOIN matches USING (sample_id) GROUP BY ALL""",
    "detail_nested": f"""WITH {_CLASSIFIED}
        SELECT sample_id AS stem, category, channel, rank, round(score, 4) AS score, text, source, image_path
        FROM classified JOIN matches m USING (sample_id)""",
    "agree_bundle": f"""WITH {_CLASSIFIED},
        agreed AS (
            SELECT m.*, query_text, row_number() OVER (PARTITION BY sample_id ORDER BY rank) AS sequence
            FROM matches m JOIN classified USING (sample_id)
            WHERE channel = 'image' AND category = 'agree' AND score >= {THRESHOLD} AND m.text IN (
                SELECT t.text FROM matches t
                WHERE t.sample_id = m.sample_id AND t.channel = 'text' AND t.score >= {THRESHOLD} AND t.text <> '')
        )
        SELECT sample_id::VARCHAR AS query_sample, query_text, text AS matched_entity, round(score, 4) AS image_score,
               source, annotation, image_path,
               printf('%d/%s_%03d.jpg', sample_id, left(translate(text, '/\\', '__'), 60), sequence) AS image_file
        FROM agreed""",
    "qc_issues": f"WITH {_ISSUES} SELECT global_id, severity, field, message FROM issues",
    "qc_summary": f"""WITH {_ISSUES}
        SELECT count(*) AS total_samples, count(*) FILTER (n_issues = 0) AS clean_samples,
               count(*) FILTER (has_error) AS error_samples,
               count(*) FILTER (n_issues > 0 AND NOT has_error) AS warning_samples
        FROM checked""",
    "qc_distribution": f"WITH {_ANNOTATED} " + " UNION ALL ".join([
        f"SELECT * FROM ({_distribution('source', 'source_name')})",
        f"SELECT * FROM ({_distribution('model', 'model_name')})",
        f"SELECT * FROM ({_distribution('dataset', 'source_dataset')})",
    ]),
    "qc_issue_fields": f"""WITH {_ISSUES}
        SELECT field, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM annotated), 1)::DOUBLE AS percent,
               row_number() OVER (ORDER BY count(*) DESC, min(global_id * 10 + place))::INT AS rank
        FROM issues GROUP BY field""",
    "qc_problems": f"""WITH {_ISSUES},
        listed AS (SELECT * FROM checked WHERE n_issues > 0)
        SELECT global_id, CASE WHEN entity_name <> '' THEN entity_name ELSE image_relative_path END AS name,
               count(*)::INT AS n_issues, bool_or(severity = 'ERROR') AS is_error
        FROM listed JOIN issues USING (global_id) WHERE severity IN ('ERROR', 'WARNING')
        GROUP BY global_id, entity_name, image_relative_path""",
    "qc_top_sources": f"""WITH {_ANNOTATED}
        SELECT source_name AS value, count(*) AS n FROM annotated GROUP BY source_name
        ORDER BY n DESC, min(global_id) LIMIT 15""",
    "qc_lengths": f"WITH {_ANNOTATED} SELECT global_id, length({_strip('annotation')})::INT AS n_chars FROM annotated",
    "qc_consistency": f"""WITH {_ANNOTATED}
        SELECT global_id, contains(annotation, {_strip('entity_name')})::INT AS found FROM annotated
        WHERE {_strip('entity_name')} <> '' AND {_strip('annotation')} <> ''""",
    "qc_label": f"""WITH {_ANNOTATED}
        SELECT global_id, CASE WHEN entity_name <> '' THEN entity_name ELSE image_relative_path END AS name
        FROM annotated""",
    "nonblank_filter": f"""WITH {_ANNOTATED}
        SELECT global_id, entity_name FROM annotated WHERE {_strip('entity_name')} <> ''""",
    "first_turns": f"""WITH {_RECORDS}
        SELECT 'conv-' || conv_id AS data_uuid, 'turns/' || conv_id || '.jpg' AS image_relative_path,
               reply AS annotation, coalesce(d.source, '') AS entity_name, coalesce(d.lang, '') AS tags,
               coalesce(d.lang, '') AS source_name, 'annotator' AS model_name
        FROM records LEFT JOIN documents d ON d.doc_id = conv_id WHERE opener = 'user' AND n = 2""",
    "jsonl_decode": f"WITH {_STATUSES} SELECT status, count(*) AS n FROM lines GROUP BY status",
    "scan_stats": f"""WITH {_STATUSES}
        SELECT count(*) AS total, count(*) FILTER (status = 'ok') AS valid,
               count(*) FILTER (status LIKE 'bad%') AS skipped
        FROM lines""",
    "json_field": """
        SELECT conv_id, turn, role AS role_text, NULL::VARCHAR AS turn_text, turn AS turn_value,
               '-' AS missing_value, CASE WHEN role = 'user' THEN role END AS user_role,
               CASE WHEN role = 'assistant' THEN nullif(text, '') END AS assistant_answer
        FROM conversations""",
    "json_paths": f"""
        SELECT DISTINCT role || '[0].answer' AS path FROM conversations WHERE {_strip('text')} <> ''
        UNION SELECT role || '[0].roles[0]' FROM conversations UNION SELECT 'meta.role' FROM conversations
        UNION SELECT key FROM (SELECT props, unnest(json_keys(props)) AS key FROM events)
        WHERE json_type(props, '$.' || key) = 'VARCHAR'""",
    "list_keys": "SELECT DISTINCT role AS key FROM conversations",
    "field_preview": """
        SELECT printf('%012d-%06d', conv_id, turn) AS stem, text AS value
        FROM conversations WHERE role = 'assistant' AND text <> '' ORDER BY stem LIMIT 5""",
    "shard_pairs": r"""
        WITH shards AS (
            SELECT DISTINCT regexp_extract(url, '/(fr|en|de|es)/(\d+)', 1) AS source_dataset,
                   regexp_extract(url, '/(fr|en|de|es)/(\d+)', 2) AS tar_name
            FROM pages WHERE regexp_matches(url, '/(fr|en|de|es)/\d+')
        )
        SELECT source_dataset, tar_name, '/data/' || source_dataset || '/jsonl/' || tar_name || '.jsonl' AS jsonl_path,
               CASE WHEN doc_id IS NULL THEN 'missing'
                    ELSE '/data/' || source_dataset || '/images/' || tar_name || '.tar' END AS tar_path
        FROM shards LEFT JOIN documents ON lang = source_dataset AND doc_id::VARCHAR = tar_name""",
    "stem_pairing": """
        SELECT '/bench/' || lang AS dir, 'doc.' || doc_id || CASE lang WHEN 'es' THEN '.v2' ELSE '' END AS stem,
               dir || '/doc.' || doc_id || CASE lang WHEN 'en' THEN '.JPG' WHEN 'fr' THEN '.png' ELSE '.v2.tiff' END
                   AS image_path,
               dir || '/doc.' || doc_id || '.json' AS json_path
        FROM documents JOIN labels USING (doc_id) WHERE lang IN ('en', 'fr')""",
    "tar_uri": """
        SELECT page_id, 'tar:///data/' || page_id || '.tar::a::' || url AS uri, '/data/' || page_id || '.tar' AS archive,
               'a::' || url AS member, 1 AS is_uri
        FROM pages""",
    "dense_ids": f"""WITH {_NUMBERED},
        indexed AS (
            SELECT global_id, row_number() OVER (ORDER BY global_id % {SHARDS}, global_id) - 1 AS index_id
            FROM numbered WHERE doc_id IN (SELECT vec_id FROM embeddings)
        )
        SELECT doc_id, global_id, index_id FROM numbered LEFT JOIN indexed USING (global_id)""",
    "shard_sizes": f"WITH {_NUMBERED} SELECT global_id % {SHARDS} AS shard, count(*) AS n FROM numbered GROUP BY shard",
}

# The stored index answers as the one built in memory.
EXPECTED["ann_stored"] = EXPECTED["ann_search"]

# The inner score is needed for the ranking only.
EXPECTED["search_topk"] = f"SELECT sample_id, rank, index_id, score FROM ({EXPECTED['search_topk']})"
# Exact search through cells and bounds gives the exact ranking.
EXPECTED["bounded_topk"] = EXPECTED["search_topk"]
