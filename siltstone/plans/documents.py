"""Queries over records: filters, pages, counts, growth, roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import dates, scores, text
from siltstone.functions.keys import concept_list, norm_key
from siltstone.operators import ingest, merge, relational as rel
from siltstone.operators.orphans import millis
from siltstone.plans.registry import EVENTS_NOW, NOW, TODAY, Tables, query

#: Parts of SQL that several queries share.
_CONCEPTS = r"""list_filter(list_transform(CASE WHEN json_valid(concepts) AND json_type(concepts) = 'ARRAY'
    THEN list_transform(list_filter(CAST(concepts AS JSON[]), lambda e: json_type(e) = 'VARCHAR'), lambda e: e->>'$')
    ELSE string_split(regexp_replace(concepts, '[\[\]"'']', '', 'g'), ',') END,
    lambda x: lower(regexp_replace(x, '^\s+|\s+$', '', 'g'))), lambda x: x <> '')"""
_CORE_DOCS = f"(SELECT DISTINCT id, coalesce({_CONCEPTS}, []) AS terms FROM oracle_documents WHERE id IS NOT NULL)"


@query("SELECT id, type, project, indexed_at FROM oracle_documents WHERE type = 'learning'")
def docs_filter_type(t: Tables):
    return rel.by_type(t.oracle_documents, "learning").select("id", "type", "project", "indexed_at")


@query("SELECT id, project FROM oracle_documents WHERE lower(project) = 'forge.example/quillmoor/lantern' OR project IS NULL")
def docs_scope_project_or_null(t: Tables):
    return rel.in_scope(t.oracle_documents, "Forge.example/quillmoor/Lantern").select("id", "project")


@query("SELECT id, superseded_by FROM oracle_documents WHERE superseded_by IS NULL AND (created_by = 'indexer' OR created_by IS NULL)")
def docs_live_indexed(t: Tables):
    return t.oracle_documents.where("superseded_by is null and (created_by = 'indexer' or created_by is null)").select("id", "superseded_by")


@query("SELECT id, indexed_at FROM oracle_documents ORDER BY indexed_at DESC, id LIMIT 20 OFFSET 40")
def docs_list_page(t: Tables):
    return rel.page(t.oracle_documents.select("id", "indexed_at"), [F.desc("indexed_at"), F.asc("id")], 20, 40)


@query("""SELECT source_file, id, indexed_at FROM (SELECT source_file, id, indexed_at,
    row_number() OVER (PARTITION BY source_file ORDER BY indexed_at DESC, id DESC) AS rn FROM oracle_documents WHERE source_file IS NOT NULL) WHERE rn = 1""")
def docs_list_grouped_by_source(t: Tables):
    return rel.latest(t.oracle_documents.where("source_file is not null").select("source_file", "indexed_at", "id"), "source_file", ["indexed_at", "id"]).select("source_file", "id", "indexed_at")


@query("SELECT type, count(*) AS n FROM oracle_documents GROUP BY type")
def stats_by_type(t: Tables):
    return rel.counts_by(t.oracle_documents, "type")


@query("SELECT type, count(DISTINCT source_file) AS files FROM oracle_documents GROUP BY type")
def stats_distinct_sources(t: Tables):
    return t.oracle_documents.groupBy("type").agg(F.countDistinct("source_file").alias("files"))


@query(f"""SELECT max(indexed_at) AS last_indexed, round(({NOW} - max(indexed_at)) / 3600000.0, 1) AS age_hours,
    coalesce(({NOW} - max(indexed_at)) > 24 * 3600000, true) AS stale FROM oracle_documents""")
def stats_last_seen_age(t: Tables):
    last = t.oracle_documents.agg(F.max("indexed_at").alias("last_indexed"))
    return last.select("last_indexed", dates.age_hours(NOW, F.col("last_indexed")).alias("age_hours"), F.coalesce((F.lit(NOW) - F.col("last_indexed")) > 24 * 3600000, F.lit(True)).alias("stale"))


@query("SELECT id, list_filter([" + ", ".join(f"'{k}'" for k in text.KEYWORDS) + "], lambda k: contains(lower(content), k)) AS concepts FROM (SELECT DISTINCT id, content FROM oracle_documents WHERE content IS NOT NULL)")
def concept_extract(t: Tables):
    return t.oracle_documents.where("content is not null").select("id", "content").distinct().select("id", text.keyword_concepts(F.col("content")).alias("concepts"))


@query(f"SELECT concept, count(*) AS n FROM (SELECT unnest(terms) AS concept FROM {_CORE_DOCS}) GROUP BY concept ORDER BY n DESC, concept LIMIT 30")
def concept_counts_top(t: Tables):
    docs = t.oracle_documents.where("id is not null").select("id", concept_list(F.col("concepts")).alias("terms")).distinct()
    return rel.top_counts(docs.select(F.explode("terms").alias("concept")), "concept", 30)


@query(f"SELECT count(DISTINCT concept) AS n FROM (SELECT unnest(terms) AS concept FROM {_CORE_DOCS})")
def concept_distinct(t: Tables):
    return t.oracle_documents.where("id is not null").select(F.explode(concept_list(F.col("concepts"))).alias("concept")).agg(F.countDistinct("concept").alias("n"))


@query("""SELECT lower(project) AS project, count(*) AS docs, count(DISTINCT type) AS types, max(created_at) AS last_created
    FROM oracle_documents WHERE project IS NOT NULL GROUP BY lower(project)""")
def project_rollup(t: Tables):
    return t.oracle_documents.where("project is not null").groupBy(F.lower("project").alias("project")).agg(
        F.count("*").alias("docs"), F.countDistinct("type").alias("types"), F.max("created_at").alias("last_created")
    )


@query("""WITH legs AS (
    SELECT created_by AS identity, max(created_at) AS last_seen, count(*) AS actions, 'documents' AS source FROM oracle_documents WHERE created_by IS NOT NULL AND created_by <> 'unknown' GROUP BY created_by
    UNION ALL SELECT superseded_by, max(superseded_at), count(*), 'supersede' FROM supersede_log WHERE superseded_by IS NOT NULL AND superseded_by <> 'unknown' GROUP BY superseded_by
    UNION ALL SELECT source, max(created_at), count(*), 'learn' FROM learn_inputs WHERE source IS NOT NULL AND source <> 'unknown' GROUP BY source)
    SELECT identity, max(last_seen) AS last_seen, CAST(sum(actions) AS BIGINT) AS actions, arg_max(source, (last_seen, source)) AS source FROM legs GROUP BY identity""")
def identity_rollup_union(t: Tables):
    return rel.identity_rollup([
        (t.oracle_documents, F.col("created_by"), F.col("created_at"), "documents"),
        (t.supersede_log, F.col("superseded_by"), F.col("superseded_at"), "supersede"),
        (t.learn_inputs, F.col("source"), F.col("created_at"), "learn"),
    ])


@query(f"""SELECT (SELECT count(*) FROM oracle_documents WHERE created_at > {NOW} - 2592000000) AS docs,
    (SELECT count(*) FROM learn_inputs WHERE created_at > {NOW} - 2592000000) AS learned,
    (SELECT count(*) FROM supersede_log WHERE superseded_at > {NOW} - 2592000000) AS superseded""")
def activity_since(t: Tables):
    since = NOW - 30 * rel.DAY_MS
    count = lambda df, c, n: rel.after(df, c, since).agg(F.count("*").alias(n))
    return count(t.oracle_documents, "created_at", "docs").crossJoin(count(t.learn_inputs, "created_at", "learned")).crossJoin(count(t.supersede_log, "superseded_at", "superseded"))


@query(f"""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 4) AS avg_value, round(sum(value), 2) AS sum_value
    FROM events WHERE epoch_ms(ts) > {EVENTS_NOW} - 7 * 86400000 GROUP BY event_type""")
def session_counts(t: Tables):
    e = t.events.withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    return rel.after(e, "ms", EVENTS_NOW - 7 * rel.DAY_MS).groupBy("event_type").agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.avg("value"), 4).alias("avg_value"), F.round(F.sum("value"), 2).alias("sum_value")
    )


@query(f"""SELECT CAST(b.bucket AS INT) AS bucket, strftime(make_timestamp(({EVENTS_NOW} - (30 - b.bucket) * 86400000::BIGINT) * 1000), '%Y-%m-%d') AS day, coalesce(c.n, 0) AS n
    FROM range(30) b(bucket) LEFT JOIN (SELECT CAST(floor((epoch_ms(ts) - ({EVENTS_NOW} - 2592000000)) / 86400000) AS BIGINT) AS bucket, count(*) AS n FROM events
        WHERE epoch_ms(ts) >= {EVENTS_NOW} - 2592000000 AND epoch_ms(ts) < {EVENTS_NOW} GROUP BY 1) c ON b.bucket = c.bucket""")
def growth_daily_buckets(t: Tables):
    return rel.growth(t.events, F.unix_millis(F.col("ts").cast("timestamp")), EVENTS_NOW, 30)


@query(f"""SELECT CAST(b.bucket AS INT) AS bucket, strftime(make_timestamp(({NOW} - (400 - b.bucket) * 86400000::BIGINT) * 1000), '%Y-%m-%d') AS day, coalesce(c.n, 0) AS n
    FROM range(400) b(bucket) LEFT JOIN (SELECT CAST(floor((created_at - ({NOW} - 34560000000)) / 86400000) AS BIGINT) AS bucket, count(*) AS n FROM oracle_documents
        WHERE created_at >= {NOW} - 34560000000 AND created_at < {NOW} GROUP BY 1) c ON b.bucket = c.bucket""")
def growth_documents(t: Tables):
    return rel.growth(t.oracle_documents, F.col("created_at"), NOW, 400)


@query("""SELECT user_id, count(*) AS messages, arg_max(substr(props, 1, 100), (ts, event_id)) AS last_message, max(ts) AS last_at FROM events GROUP BY user_id""")
def thread_summary(t: Tables):
    return rel.thread_summary(t.events, "user_id", ["ts", "event_id"], "props")


@query("""SELECT user_id, event_id, from_end FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS from_end FROM events) WHERE from_end <= 3""")
def thread_last_n(t: Tables):
    return rel.last_n(t.events, "user_id", ["ts", "event_id"], 3).select("user_id", "event_id", "from_end")


@query(f"""SELECT user_id, ts, event_type, epoch_ms(ts) >= {EVENTS_NOW} - 3600000 AS active FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-30 00:00:00' ORDER BY ts DESC, event_id LIMIT 50""")
def feed_filter_sort_active(t: Tables):
    e = t.events.where((F.col("event_type") == "click") & (F.col("ts") >= F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")))
    return rel.page(e, [F.desc("ts"), F.asc("event_id")], 50).select("user_id", "ts", "event_type", (F.unix_millis(F.col("ts").cast("timestamp")) >= EVENTS_NOW - 3_600_000).alias("active"))


@query("SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_props_counts(t: Tables):
    return rel.counts_by(t.events.select(F.from_json("props", "k int")["k"].alias("k")), "k")


@query(f"SELECT id, terms FROM {_CORE_DOCS}")
def json_array_parse(t: Tables):
    return t.oracle_documents.where("id is not null").select("id", concept_list(F.col("concepts")).alias("terms")).distinct()


@query("""SELECT model_key, json_extract_string(metadata, '$.type') AS kind, count(*) AS n FROM vector_documents WHERE metadata IS NOT NULL GROUP BY ALL""")
def json_metadata_counts(t: Tables):
    m = t.vector_documents.where("metadata is not null").select("model_key", F.from_json("metadata", "map<string,string>")["type"].alias("kind"))
    return rel.counts_by(m, "model_key", "kind")


@query("""SELECT status, model_key, count(*) AS n FROM indexing_jobs GROUP BY status, model_key""")
def jobs_by_status(t: Tables):
    return rel.counts_by(t.indexing_jobs, "status", "model_key")


@query("""SELECT id, source_file, created_at FROM oracle_documents WHERE coalesce(content ILIKE '%handoff%', false) OR coalesce(source_file ILIKE '%handoff%', false)""")
def docs_keyword_like(t: Tables):
    return rel.any_like(t.oracle_documents, ["content", "source_file"], "handoff").select("id", "source_file", "created_at")


@query("""SELECT id, project FROM oracle_documents WHERE regexp_matches(lower(project), '^forge\\.example/quillmoor/.*n$')""")
def docs_project_glob(t: Tables):
    return t.oracle_documents.where(F.lower("project").rlike(text.glob_regex("forge.example/quillmoor/*n"))).select("id", "project")


@query(r"""SELECT DISTINCT d.id, d.type FROM oracle_documents d WHERE d.id IN (SELECT lower(regexp_replace(new_id, '^\s+|\s+$', '', 'g')) FROM supersede_log)""")
def docs_with_ids(t: Tables):
    ids = t.supersede_log.select(norm_key(F.col("new_id")).alias("id"))
    return rel.with_ids(t.oracle_documents.select("id", "type"), ids, "id").distinct()


@query("""WITH p AS (SELECT DISTINCT lower(regexp_extract(source_file, '[^/]+$', 0)) AS target, id AS source FROM oracle_documents WHERE source_file IS NOT NULL)
    SELECT p.target, p.source, g.n FROM p JOIN (SELECT target, count(*) AS n FROM p GROUP BY target HAVING count(*) > 1) g ON p.target = g.target""")
def overlap_detection(t: Tables):
    docs = t.oracle_documents.where("source_file is not null")
    return rel.overlaps(docs, F.element_at(F.split("source_file", "/"), -1), "id")


@query("""SELECT project, path, doc_id FROM (SELECT project, path, doc_id, row_number() OVER (PARTITION BY project ORDER BY path DESC, doc_id DESC) AS rn FROM documents WHERE project IS NOT NULL) WHERE rn > 10""")
def rotation_expired(t: Tables):
    d = t.documents.where("project is not null").withColumn("name", F.struct("path", "doc_id"))
    return rel.keep_newest(d, "project", "name", 10).select("project", "path", "doc_id")


@query("""SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS docs, count(DISTINCT project) AS projects, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM documents GROUP BY 1""")
def month_listing(t: Tables):
    return t.documents.groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("docs"), F.countDistinct("project").alias("projects"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")
    )


@query("""SELECT id, string_agg(content, chr(10) ORDER BY content) AS content FROM (SELECT DISTINCT id, content FROM oracle_documents WHERE content IS NOT NULL) GROUP BY id""")
def rebuild_texts(t: Tables):
    d = t.oracle_documents.where("content is not null").select("id", "content").distinct()
    return d.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("content")), "\n").alias("content"))


@query("""SELECT type, count(*) AS n, min(created_at) AS first_at, max(created_at) AS last_at, round(100.0 * count(superseded_by) / count(*), 0) AS superseded_percent FROM oracle_documents GROUP BY type""")
def supersede_share(t: Tables):
    return t.oracle_documents.groupBy("type").agg(
        F.count("*").alias("n"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), scores.percent(F.count("superseded_by"), F.count("*")).alias("superseded_percent")
    )


# text functions

_TEXTS = "(SELECT doc_id, text FROM documents WHERE text IS NOT NULL)"


@query(rf"""SELECT doc_id, CASE WHEN s = '' THEN text ELSE s END AS q FROM (SELECT doc_id, text, trim(regexp_replace(regexp_replace(text, '[?*+\-()^~"'':./]', ' ', 'g'), '\s+', ' ', 'g')) AS s
    FROM {_TEXTS})""")
def sanitize_tool(t: Tables):
    return t.documents.where("text is not null").select("doc_id", text.sanitize_query(F.col("text")).alias("q"))


@query(rf"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '[?*+\-()^~"'':;<>{{}}\[\]\\/]', ' ', 'g'), '\s+', ' ', 'g')) AS q FROM {_TEXTS}""")
def sanitize_http(t: Tables):
    return t.documents.where("text is not null").select("doc_id", text.sanitize_markup(F.col("text")).alias("q"))


@query(rf"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(substr(text, 1, 50)), '[^a-z0-9\s-]', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM {_TEXTS}""")
def slug_a(t: Tables):
    return t.documents.where("text is not null").select("doc_id", text.slug(F.col("text")).alias("slug"))


@query(rf"""SELECT doc_id, substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 50) AS slug FROM {_TEXTS}""")
def slug_b(t: Tables):
    return t.documents.where("text is not null").select("doc_id", text.slug_runs(F.col("text")).alias("slug"))


@query(f"SELECT doc_id, substr(split_part(text, chr(10), 1), 1, 80) AS title FROM {_TEXTS}")
def title_first_line(t: Tables):
    return t.documents.where("text is not null").select("doc_id", text.first_line(F.col("text")).alias("title"))


@query(r"""SELECT doc_id, coalesce(nullif(trim(regexp_extract(text, '(?m)^#[ \t]+([^\s][^\r\n]*)', 1)), ''), nullif(regexp_replace(regexp_extract(path, '[^/]*$', 0), '\.[^.]*$', ''), ''),
    nullif(trim(substr(regexp_replace(text, '\s+', ' ', 'g'), 1, 80)), ''), '(untitled)') AS title FROM documents""")
def title_derived(t: Tables):
    return t.documents.select("doc_id", text.derived_title(F.col("text"), F.col("path")).alias("title"))


@query("""SELECT id, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(id, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS h
    FROM (SELECT DISTINCT id FROM oracle_documents)""")
def fnv_hash(t: Tables):
    return t.oracle_documents.select("id").distinct().select("id", text.fnv1a(F.col("id")).alias("h"))


@query(r"""SELECT doc_id, list_filter(list_transform(string_split(regexp_extract(regexp_extract(text, '\A---\r?\n([\s\S]*?)\r?\n---', 1), '(?m)^tags:[ \t]*\[?([^\]\r\n]*)', 1), ','), lambda x: lower(trim(x))), lambda x: x <> '') AS tags FROM documents WHERE text IS NOT NULL""")
def front_matter_tags(t: Tables):
    return t.documents.where("text is not null").select("doc_id", text.front_matter_tags(F.col("text")).alias("tags"))


@query(r"""SELECT id, CASE WHEN regexp_matches(project, '^github\.com/[^/]+/[^/]+$') THEN lower(project) WHEN regexp_matches(project, 'https?://github\.com/[^/]+/[^/]+') THEN lower('github.com/' || regexp_replace(regexp_extract(project, 'https?://github\.com/([^/]+/[^/]+)', 1), '\.git$', ''))
    WHEN regexp_matches(project, 'github\.com/[^/]+/[^/]+') THEN lower(regexp_extract(project, 'github\.com/[^/]+/[^/]+', 0)) WHEN regexp_matches(project, '^[^/\s]+/[^/\s]+$') THEN lower('github.com/' || project) END AS project FROM (SELECT DISTINCT id, project FROM oracle_documents WHERE project IS NOT NULL)""")
def project_normalized(t: Tables):
    d = t.oracle_documents.where("project is not null").select("id", "project").distinct()
    return d.select("id", text.normalized_project(F.col("project")).alias("project"))


@query(r"""SELECT doc_id, CAST(i AS INT) AS line, kind, substr(trim(l), 1, 120) AS preview FROM (SELECT doc_id, i, l, CASE WHEN regexp_matches(l, '\b(ghp|gho|ghs|ghu|ghr)_[A-Za-z0-9]{20,}\b') THEN 'github-pat'
        WHEN regexp_matches(l, '\bAKIA[0-9A-Z]{16}\b') THEN 'aws-access-key' WHEN regexp_matches(l, '\bsk-[A-Za-z0-9_-]{20,}\b') THEN 'openai-key' WHEN regexp_matches(l, '-----BEGIN (RSA |EC |OPENSSH |DSA |PGP )?PRIVATE KEY-----') THEN 'private-key'
        WHEN regexp_matches(l, '(?i)\b(API[_-]?KEY|SECRET|TOKEN|PASSWORD|PASSWD)\s*[:=]\s*[''"]?[A-Za-z0-9_\-./+=]{16,}') THEN 'env-credential' END AS kind
    FROM (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS l FROM (SELECT doc_id, string_split_regex(text, '\r?\n') AS ls FROM documents WHERE text IS NOT NULL))) WHERE kind IS NOT NULL""")
def secret_scan(t: Tables):
    return ingest.secrets(t.documents.where("text is not null"), "doc_id", "text").withColumnRenamed("path", "doc_id")


_SHOWN = ("token ghp_{0}", "key AKIA{1}", "use sk-{0} here", "-----BEGIN EC PRIVATE KEY-----", "api-key = '{0}'", "password: short", "nothing")


@query(r"""SELECT doc_id, CAST(1 AS INT) AS line, CASE doc_id % 7 WHEN 0 THEN 'github-pat' WHEN 1 THEN 'aws-access-key' WHEN 2 THEN 'openai-key' WHEN 3 THEN 'private-key' ELSE 'env-credential' END AS kind FROM documents WHERE doc_id % 7 < 5""")
def secret_kinds(t: Tables):
    """One line of each kind of secret, and two that are none."""
    ways = F.array(*(F.lit(s.format("abcdefghij0123456789", "ABCDEFGHIJ012345")) for s in _SHOWN))
    lines = t.documents.select("doc_id", F.element_at(ways, (F.col("doc_id") % 7 + 1).cast("int")).alias("text"))
    return ingest.secrets(lines, "doc_id", "text").select(F.col("path").alias("doc_id"), "line", "kind")


@query(rf"""SELECT id, CASE WHEN regexp_matches(trim(created_at), '^\d{{4}}-\d{{2}}-\d{{2}}$') THEN trim(created_at) ELSE '{TODAY}' END AS day FROM api_docs WHERE created_at IS NOT NULL""")
def date_parse(t: Tables):
    return t.api_docs.where("created_at is not null").select("id", dates.parsed_date(F.col("created_at"), TODAY).alias("day"))


@query("""SELECT id, left(created_at, 10) AS day FROM api_docs WHERE CAST(left(created_at, 10) AS DATE) BETWEEN DATE '2025-01-01' AND DATE '2025-01-15' ORDER BY day, id""")
def range_window(t: Tables):
    d = t.api_docs.select("id", F.try_to_timestamp(F.substring("created_at", 1, 10), F.lit("yyyy-MM-dd")).cast("date").alias("day"))
    return d.where(F.col("day").between("2025-01-01", "2025-01-15")).orderBy("day", "id").select("id", F.col("day").cast("string").alias("day"))


@query("SELECT id, strftime(make_timestamp(created_at * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS created FROM (SELECT DISTINCT id, created_at FROM oracle_documents)")
def iso_times(t: Tables):
    return t.oracle_documents.select("id", "created_at").distinct().select("id", dates.iso_millis(F.col("created_at")).alias("created"))


# ingestion

_LINES = r"regexp_replace(regexp_replace(s, '^[^\n]*\n', ''), '^\s+|\s+$', '', 'g')"
_SECTIONS = rf"""(SELECT doc_id, i - 1 AS place, regexp_replace(split_part(s, chr(10), 1), '^\s+|\s+$', '', 'g') AS title, CASE WHEN contains(s, chr(10)) THEN {_LINES} ELSE '' END AS body FROM (
    SELECT doc_id, unnest(range(1, len(ss) + 1)) AS i, unnest(ss) AS s FROM (SELECT doc_id, list_filter(string_split_regex(text, '(?m)^##\s+'), lambda x: trim(x) <> '') AS ss FROM documents WHERE text IS NOT NULL)))"""


@query(f"SELECT doc_id, CAST(place AS INT) AS place, title, body FROM {_SECTIONS} WHERE body <> ''")
def chunk_sections(t: Tables):
    return ingest.sections(t.documents.where("text is not null"), "doc_id", "text", "##").withColumnsRenamed({"path": "doc_id", "at": "place"})


@query(f"SELECT concat_ws('_', 'retro', CAST(doc_id AS VARCHAR), CAST(place AS VARCHAR)) AS id, 'retro' AS type, title || ': ' || body AS content FROM {_SECTIONS} WHERE length(body) >= 50")
def chunk_min_length(t: Tables):
    return ingest.retrospectives(t.documents.where("text is not null").withColumn("doc_id", F.col("doc_id").cast("string")), "doc_id", "text")


@query("""SELECT doc_id, path FROM (SELECT doc_id, path, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""")
def dedup_content_hash(t: Tables):
    return ingest.first_of_content(t.documents.select("doc_id", "path", "text"), "text", ["doc_id"]).select("doc_id", "path")


@query("""SELECT path, CASE WHEN contains(path, '/resonance/') THEN 'principle' WHEN contains(path, '/learnings/') THEN 'learning' WHEN contains(path, '/retrospectives/') THEN 'retro' ELSE 'other' END AS kind FROM documents""")
def scan_classify(t: Tables):
    return t.documents.select("path", text.doc_kind(F.col("path")).alias("kind"))


# merging

@query("""SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.type ELSE o.type END AS type, CASE WHEN n.id IS NOT NULL THEN n.indexed_at ELSE o.indexed_at END AS indexed_at,
    CASE WHEN o.id IS NOT NULL THEN o.created_at ELSE n.created_at END AS created_at
    FROM (SELECT id, arg_max(type, indexed_at) AS type, max(indexed_at) AS indexed_at, arg_max(created_at, indexed_at) AS created_at FROM oracle_documents GROUP BY id) o
    FULL OUTER JOIN (SELECT input_id AS id, 'learning' AS type, 1772323200000 AS indexed_at, max(created_at) AS created_at FROM learn_inputs GROUP BY input_id
        UNION ALL SELECT id, 'retyped', 1772323200000, 0 FROM oracle_documents WHERE type = 'retro' GROUP BY id) n ON o.id = n.id""")
def upsert_merge(t: Tables):
    old = rel.latest(t.oracle_documents.select("id", "type", "indexed_at", "created_at"), "id", ["indexed_at"])
    now = F.lit(NOW).alias("indexed_at")
    new = t.learn_inputs.groupBy(F.col("input_id").alias("id")).agg(F.max("created_at").alias("created_at")).select("id", F.lit("learning").alias("type"), now, "created_at")
    again = t.oracle_documents.where("type = 'retro'").select("id").distinct().select("id", F.lit("retyped").alias("type"), now, F.lit(0).cast("long").alias("created_at"))
    return merge.upsert(old, new.unionByName(again), "id", keep=["created_at"])


@query("""WITH disk AS (SELECT source_file AS path, max(updated_at) AS mtime FROM oracle_documents WHERE source_file IS NOT NULL AND type <> 'principle' GROUP BY 1),
    idx AS (SELECT source_file AS path, max(indexed_at) AS indexed_at FROM oracle_documents WHERE source_file IS NOT NULL AND type <> 'pattern' GROUP BY 1)
    SELECT coalesce(d.path, i.path) AS path, CASE WHEN d.path IS NULL THEN 'orphaned' WHEN i.path IS NULL AND contains(d.path, 'a') THEN 'missing' WHEN i.path IS NULL THEN 'untracked'
    WHEN d.mtime > i.indexed_at THEN 'drifted' ELSE 'healthy' END AS status FROM disk d FULL OUTER JOIN idx i ON d.path = i.path""")
def verify_classify(t: Tables):
    d = t.oracle_documents.where("source_file is not null")
    disk = d.where("type <> 'principle'").groupBy(F.col("source_file").alias("path")).agg(F.max("updated_at").alias("mtime")).withColumn("tracked", F.contains("path", F.lit("a")))
    indexed = d.where("type <> 'pattern'").groupBy(F.col("source_file").alias("path")).agg(F.max("indexed_at").alias("indexed_at"))
    return merge.verify(disk, indexed)


@query("""WITH docs AS (SELECT DISTINCT id, md5(coalesce(content, '')) AS hash FROM oracle_documents WHERE type <> 'principle'), state AS (SELECT DISTINCT id, CASE WHEN type = 'retro' THEN 'old' ELSE md5(coalesce(content, '')) END AS hash FROM oracle_documents WHERE type <> 'pattern')
    SELECT d.id, CASE WHEN s.id IS NULL THEN 'create' WHEN d.hash = s.hash THEN 'skip-unchanged' ELSE 'update' END AS action FROM docs d LEFT JOIN state s ON d.id = s.id
    UNION ALL SELECT s.id, 'tombstone' FROM state s WHERE s.id NOT IN (SELECT id FROM docs)""")
def import_plan(t: Tables):
    d = t.oracle_documents.withColumn("hash", F.md5(F.coalesce("content", F.lit(""))))
    docs = d.where("type <> 'principle'").select("id", "hash").distinct()
    state = d.where("type <> 'pattern'").select("id", F.when(F.col("type") == "retro", "old").otherwise(F.col("hash")).alias("hash")).distinct()
    return merge.import_plan(docs, state)


@query("""WITH mine AS (SELECT id, source_file FROM oracle_documents WHERE created_by = 'indexer' OR created_by IS NULL),
    gone AS (SELECT * FROM mine WHERE source_file IS NULL OR source_file NOT IN (SELECT source_file FROM oracle_documents WHERE type <> 'principle' AND source_file IS NOT NULL))
    SELECT id, source_file, (SELECT count(*) FROM gone) <= 0.5 * (SELECT count(*) FROM mine) AS allowed FROM gone""")
def stale_delete_guard(t: Tables):
    d = t.oracle_documents.select("id", "source_file", "type", "created_by")
    owned = (F.col("created_by") == "indexer") | F.col("created_by").isNull()
    return merge.stale(d, d.where("type <> 'principle'").select("source_file"), "source_file", owned=owned).select("id", "source_file", "allowed")


@query(r"""SELECT id, concat_ws(',', id, type, CASE WHEN regexp_matches(coalesce(content, ''), '[",\n\r]') THEN '"' || replace(content, '"', '""') || '"' ELSE coalesce(content, '') END) AS line FROM (SELECT DISTINCT id, type, content FROM oracle_documents)""")
def export_csv(t: Tables):
    d = t.oracle_documents.select("id", "type", "content").distinct()
    return d.select("id", F.concat_ws(",", "id", "type", text.csv_field(F.col("content"))).alias("line"))


@query(f"""SELECT concept, created_at, id FROM (SELECT unnest(list_distinct(terms)) AS concept, id, created_at FROM (SELECT DISTINCT id, created_at, coalesce({_CONCEPTS}, []) AS terms FROM oracle_documents)) ORDER BY concept, created_at DESC, id""")
def export_concept_hubs(t: Tables):
    """The lines of every concept's hub, newest first; a range sort, so that a frequent concept spreads over tasks."""
    d = t.oracle_documents.select("id", "created_at", concept_list(F.col("concepts")).alias("terms")).distinct()
    return d.select(F.explode(F.array_distinct("terms")).alias("concept"), "created_at", "id").orderBy("concept", F.desc("created_at"), "id")


@query(r"""SELECT row_id, src_table, kind, period FROM (
    SELECT CAST(id AS VARCHAR) AS row_id, tab AS src_table, strftime(make_timestamp(ms * 1000), '%Y-%m') AS period,
        CASE WHEN c.k IS NOT NULL THEN CASE WHEN c.created > ms THEN 'late' END WHEN o.k IS NOT NULL THEN 'deleted' ELSE 'missing' END AS kind
    FROM (SELECT DISTINCT 'indexing_jobs' AS tab, id, lower(regexp_replace(doc_id, '^\s+|\s+$', '', 'g')) AS ref, CASE WHEN created_at < 100000000000 THEN created_at * 1000 ELSE created_at END AS ms FROM indexing_jobs
        UNION ALL SELECT DISTINCT 'supersede_log', CAST(id AS VARCHAR), lower(regexp_replace(new_id, '^\s+|\s+$', '', 'g')), superseded_at FROM supersede_log) r
    LEFT JOIN (SELECT lower(trim(id)) AS k, min(created_at) AS created FROM oracle_documents GROUP BY 1) c ON r.ref = c.k
    LEFT JOIN (SELECT DISTINCT lower(regexp_replace(old_id, '^\s+|\s+$', '', 'g')) AS k FROM supersede_log WHERE old_id IS NOT NULL) o ON r.ref = o.k
    WHERE ref IS NOT NULL AND ref <> '') WHERE kind IS NOT NULL""")
def p3_found(t: Tables):
    """References of both logs to records that are missing, deleted or were made only later."""
    from siltstone.operators.orphans import orphan_references

    jobs = t.indexing_jobs.select(F.lit("indexing_jobs").alias("src_table"), F.col("id").alias("row_id"), norm_key(F.col("doc_id")).alias("key"), millis(F.col("created_at")).alias("at"))
    log = t.supersede_log
    moves = log.select(F.lit("supersede_log").alias("src_table"), F.col("id").cast("string").alias("row_id"), norm_key(F.col("new_id")).alias("key"), millis(F.col("superseded_at")).alias("at"))
    parents = t.oracle_documents.select(norm_key(F.col("id")).alias("key"), millis(F.col("created_at")).alias("created"))
    return orphan_references(jobs.unionByName(moves), parents, log.select(norm_key(F.col("old_id")).alias("key")))
