"""SQL that states the results of the queries SQL can express over whole tables."""

from __future__ import annotations

_TRIM = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def _key(c: str) -> str:
    return f"nullif(lower({_TRIM.format(c=c)}), '')"


_LIST = rf"""coalesce(list_filter(list_transform(CASE WHEN json_valid(concepts) AND json_type(concepts) = 'ARRAY'
    THEN list_transform(list_filter(CAST(concepts AS JSON[]), lambda e: json_type(e) = 'VARCHAR'), lambda e: e->>'$')
    ELSE string_split(regexp_replace(concepts, '[\[\]"'']', '', 'g'), ',') END, lambda x: lower({_TRIM.format(c="x")})), lambda x: x <> ''), [])"""
_RECORDS = f"(SELECT id, arg_max(terms, at_) AS terms FROM (SELECT {_key('id')} AS id, {_LIST} AS terms, (indexed_at, concepts) AS at_ FROM oracle_documents) WHERE id IS NOT NULL GROUP BY id)"
_EDGES = f"(SELECT DISTINCT {_key('old_id')} AS a, {_key('new_id')} AS b FROM supersede_log WHERE {_key('old_id')} IS NOT NULL AND {_key('new_id')} IS NOT NULL)"
_NORMAL = r"trim(regexp_replace(lower({c}), '\s+', ' ', 'g'))"
_REDUCED = r"regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]+', '', 'g')"


def _long(table: str, c: str) -> str:
    return f"SELECT '{table}' AS src_table, {_key('id')} AS id, replace({c}, chr(13) || chr(10), chr(10)) AS body FROM {table} WHERE length({c}) > 2000"


#: Records that count in problem 1, and pairs of equal or similar texts; sets of problem 7, and pairs that share terms.
_P1 = rf"""WITH t AS (SELECT DISTINCT id, x FROM (SELECT {_key('id')} AS id, {_NORMAL.format(c='content')} AS x FROM oracle_documents UNION ALL
            SELECT {_key('input_id')}, {_NORMAL.format(c='pattern')} FROM learn_inputs) WHERE id IS NOT NULL AND length(x) >= 200),
        c AS (SELECT x, row_number() OVER (ORDER BY x) AS n FROM (SELECT DISTINCT x FROM t)),
        g AS (SELECT DISTINCT n, hash(substr(x, i, 16)) AS h FROM (SELECT n, x, unnest(range(1, length(x) - 14)) AS i FROM c)),
        s AS (SELECT n, count(*) AS size FROM g GROUP BY n),
        p AS (SELECT a.n AS a, b.n AS b, count(*) AS shared FROM g a JOIN g b ON a.h = b.h AND a.n <= b.n GROUP BY ALL)"""
_P1_PAIRS = """SELECT DISTINCT least(u.id, v.id) AS id_a, greatest(u.id, v.id) AS id_b FROM p JOIN s sa ON p.a = sa.n JOIN s sb ON p.b = sb.n JOIN c ca ON ca.n = p.a JOIN c cb ON cb.n = p.b
        JOIN t u ON u.x = ca.x JOIN t v ON v.x = cb.x WHERE shared >= 0.6 * (sa.size + sb.size - shared) AND u.id <> v.id"""
_P7 = rf"""WITH t AS (SELECT DISTINCT id, list_sort(list_distinct(terms)) AS terms FROM (SELECT {_key('id')} AS id, {_LIST} AS terms FROM oracle_documents UNION ALL
            SELECT {_key('id')}, list_filter(list_transform(concepts, lambda x: lower({_TRIM.format(c='x')})), lambda x: x IS NOT NULL AND x <> '') FROM api_docs) WHERE id IS NOT NULL AND len(list_distinct(terms)) >= 5),
        e AS (SELECT id, terms, unnest(terms) AS term FROM t),
        p AS (SELECT a.id AS a, b.id AS b, len(any_value(a.terms)) + len(any_value(b.terms)) AS sizes, count(*) AS shared FROM e a JOIN e b ON a.term = b.term AND a.id < b.id GROUP BY a.id, b.id)"""


SQL: dict[str, str] = {
    "p1_found": f"{_P1} {_P1_PAIRS}",
    "p1_groups": f"""{_P1.replace('WITH t', 'WITH RECURSIVE t', 1)}, q AS ({_P1_PAIRS}), e AS (SELECT id_a AS a, id_b AS b FROM q UNION SELECT id_b, id_a FROM q UNION SELECT id, id FROM t),
        r AS (SELECT DISTINCT id, id AS other FROM t UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other) SELECT id, min(other) AS group_id FROM r GROUP BY id""",
    "p2_found": f"""SELECT term, CASE WHEN n < 3 THEN 'rare' ELSE 'common' END AS mark FROM (SELECT term, count(DISTINCT id) AS n FROM (SELECT id, unnest(terms) AS term FROM {_RECORDS}) GROUP BY term)
        WHERE n < 3 OR n * 10 > (SELECT count(*) FROM {_RECORDS})""",
    "p2_counts": f"""WITH g AS (SELECT id, list_slice(terms, i, i + k - 1) AS gram FROM (SELECT id, terms, unnest(range(1, len(terms) + 1)) AS i FROM {_RECORDS}), (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(terms))
        SELECT array_to_string(gram, '|') AS gram, len(gram) AS n, count(*) AS occurrences, count(DISTINCT id) AS records,
        CASE WHEN count(DISTINCT id) < 3 THEN 'rare' WHEN count(DISTINCT id) * 10 > (SELECT count(*) FROM {_RECORDS}) THEN 'common' END AS mark FROM g GROUP BY g.gram""",
    "p4_found": f"""WITH RECURSIVE e AS (SELECT a, b FROM {_EDGES} UNION SELECT b, a FROM {_EDGES}), r AS (SELECT a AS id, a AS other FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other)
        SELECT id AS doc_id, min(other) AS group_id FROM r GROUP BY id""",
    "p5_found": rf"""SELECT DISTINCT src_table, id, CASE WHEN list_max(list_transform(string_split_regex(body, '\n(?:[ \t]*\n)+'), lambda x: length(x))) <= 2000 THEN 'paragraph'
        WHEN list_max(list_transform(string_split(body, chr(10)), lambda x: length(x))) <= 2000 THEN 'line' WHEN list_max(list_transform(string_split_regex(body, '\s+'), lambda x: length(x))) <= 2000 THEN 'word' ELSE 'hard' END AS boundary
        FROM ({_long('oracle_documents', 'content')} UNION ALL {_long('vector_documents', 'document')})""",
    "p6_found": f"""WITH v AS (SELECT DISTINCT model_key, {_key('id')} AS id, vector FROM vector_documents WHERE vector IS NOT NULL AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
        d AS (SELECT model_key, arg_max(d, (n, -d)) AS d FROM (SELECT model_key, len(vector) AS d, count(*) AS n FROM vector_documents WHERE vector IS NOT NULL GROUP BY ALL) GROUP BY model_key),
        u AS (SELECT v.*, CAST(vector AS DOUBLE[]) AS x FROM v JOIN d ON v.model_key = d.model_key AND len(vector) = d.d),
        s AS (SELECT a.model_key, a.id AS a, b.id AS b, list_cosine_similarity(a.x, b.x) AS score FROM u a JOIN u b ON a.model_key = b.model_key AND a.id <> b.id)
        SELECT DISTINCT model_key, least(a, b) AS id_a, greatest(a, b) AS id_b FROM (SELECT *, row_number() OVER (PARTITION BY model_key, a ORDER BY score DESC, b) AS rn FROM s) WHERE rn <= 10 AND score >= 0.9""",
    "p6_embeddings": """WITH u AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
        s AS (SELECT a.vec_id AS id, b.vec_id AS neighbour, list_cosine_similarity(a.x, b.x) AS score FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
        SELECT id, neighbour, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, neighbour) AS rank FROM s) WHERE rank <= 10""",
    "p7_found": f"{_P7} SELECT a AS id_a, b AS id_b FROM p WHERE shared * 4 >= 3 * (sizes - shared)",
    "p7_classes": f"""{_P7}, c AS (SELECT terms, min(id) AS class_id, row_number() OVER (ORDER BY terms) AS n FROM t GROUP BY terms), k AS (SELECT n, unnest(terms) AS term, len(terms) AS size FROM c),
        l AS (SELECT a.n AS a, b.n AS b FROM k a JOIN k b ON a.term = b.term AND a.n <> b.n GROUP BY a.n, b.n, a.size, b.size HAVING count(*) * 4 >= 3 * (a.size + b.size - count(*)))
        SELECT t.id, c.class_id, coalesce(x.links, 0) AS links FROM t JOIN c ON t.terms = c.terms LEFT JOIN (SELECT a, count(*) AS links FROM l GROUP BY a) x ON x.a = c.n""",
    "p8_found": f"""WITH i AS (SELECT item_id, {_REDUCED.format(c='text')} AS x FROM eval_items), d AS (SELECT doc_id, {_REDUCED.format(c='text')} AS x FROM documents WHERE text IS NOT NULL),
        g AS (SELECT DISTINCT item_id, substr(x, k, 50) AS s FROM (SELECT item_id, x, unnest(range(1, length(x) - 48)) AS k FROM i)),
        h AS (SELECT DISTINCT doc_id, substr(x, k, 50) AS s FROM (SELECT doc_id, x, unnest(range(1, length(x) - 48)) AS k FROM d))
        SELECT DISTINCT doc_id, item_id FROM h JOIN g ON h.s = g.s""",
    "p8_leaks": f"""WITH i AS (SELECT item_id, {_REDUCED.format(c='text')} AS x FROM eval_items), d AS (SELECT doc_id, {_REDUCED.format(c='text')} AS x FROM documents WHERE text IS NOT NULL),
        g AS (SELECT item_id, k, substr(x, k, 50) AS s FROM (SELECT item_id, x, unnest(range(1, length(x) - 48)) AS k FROM i)),
        h AS (SELECT doc_id, k, substr(x, k, 50) AS s FROM (SELECT doc_id, x, unnest(range(1, length(x) - 48)) AS k FROM d)),
        m AS (SELECT DISTINCT doc_id, item_id, h.k AS at_, h.k - g.k AS diagonal FROM h JOIN g ON h.s = g.s),
        r AS (SELECT *, at_ - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY at_) AS island FROM m)
        SELECT doc_id, item_id, CAST(max(n) + 49 AS INT) AS run FROM (SELECT doc_id, item_id, count(*) AS n FROM r GROUP BY doc_id, item_id, diagonal, island) GROUP BY doc_id, item_id""",
    # any common size measure gives the same cases, here a quarter of the bytes a token
    "p9_found": f"""WITH d AS (SELECT {_key('source')} AS source, strlen(coalesce(text, '')) / 4.0 AS tokens FROM documents),
        t AS (SELECT {_key('source')} AS source, target_share, max_repeats FROM mix_targets)
        SELECT t.source FROM t LEFT JOIN (SELECT source, sum(tokens) AS have FROM d GROUP BY source) h ON h.source = t.source
        WHERE coalesce(have, 0) * max_repeats < target_share * (SELECT sum(tokens) FROM d)""",
}
