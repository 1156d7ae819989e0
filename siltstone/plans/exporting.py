"""Queries over exports, feeds, front matter and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import markup, text
from siltstone.operators import embed, exports, merge
from siltstone.plans.registry import Tables, query
from siltstone.sources import files, sinks

_FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({s}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, 'u' || user_id AS oracle, event_type AS event, 's' || event_id AS session_id, props AS message FROM events""")
def feed_round_trip(t: Tables):
    """Events written as feed lines and read again."""
    e = t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"), F.concat(F.lit("u"), "user_id").alias("who"), F.lit("local").alias("host"), "event_type", F.lit("p").alias("project"),
                        F.concat(F.lit("s"), "event_id").alias("session"), "props")
    line = e.select("event_id", sinks.feed_line("time", "who", "host", "event_type", "project", "session", "props").alias("line"))
    return line.select("event_id", *files.feed_fields(F.col("line"))).select("event_id", "timestamp", "oracle", "event", "session_id", "message")


@query("""SELECT substr(day, 1, 7) AS month, 0 AS page, '## ' || substr(day, 1, 7) || chr(10) || string_agg('- ' || day || ': ' || id, chr(10) ORDER BY day, id) AS markdown
    FROM (SELECT left(created_at, 10) AS day, id FROM api_docs WHERE created_at IS NOT NULL) GROUP BY substr(day, 1, 7)""")
def schedule_by_month(t: Tables):
    d = t.api_docs.where("created_at is not null").select(F.substring("created_at", 1, 10).alias("day"), "id")
    return exports.schedule_markdown(d, "day", "id")


@query("""SELECT type, 0 AS page, '## ' || type || ' (' || count(*) || ')' || chr(10) || string_agg('- [' || id || '](' || source_file || ')', chr(10) ORDER BY id, source_file) AS markdown
    FROM (SELECT DISTINCT type, id, source_file FROM oracle_documents WHERE source_file IS NOT NULL) GROUP BY type""")
def export_index(t: Tables):
    d = t.oracle_documents.where("source_file is not null").select("type", "id", "source_file").distinct()
    return exports.index_markdown(d, "type", "id", "source_file")


@query("""SELECT path, CASE WHEN path = 'memory/plugin_docs' THEN 'exact' WHEN starts_with(path, 'memory/learnings/') THEN 'learn' WHEN starts_with(path, 'memory/r') THEN 'review' WHEN starts_with(path, 'memory/') THEN 'rest' END AS service FROM documents""")
def route_first_match(t: Tables):
    patterns = t.spark.createDataFrame([(1, "memory/plugin_docs", "exact"), (2, "memory/learnings/**", "learn"), (3, "memory/r*", "review"), (4, "memory/**", "rest")], "ord int, pattern string, service string")
    return exports.first_match(t.documents.select("path"), "path", patterns)


@query("""WITH i AS (SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) * 150 AS p FROM events), q AS (SELECT i.id, k.id AS parent_id FROM i LEFT JOIN i k ON i.p = k.id)
    SELECT q.id, q.parent_id, coalesce(c.n, 0) AS children FROM q LEFT JOIN (SELECT parent_id, count(*) AS n FROM q WHERE parent_id IS NOT NULL GROUP BY parent_id) c ON c.parent_id = q.id""")
def item_tree(t: Tables):
    items = t.events.select(F.col("event_id").alias("id"), (F.from_json("props", "k bigint")["k"] * 150).alias("parent"))
    return exports.tree(items, "id", "parent")


@query(f"SELECT id, h % 10000 / 10000.0 AS unit FROM (SELECT id, {_FNV.format(s='id')} AS h FROM (SELECT DISTINCT id FROM api_docs))")
def fnv_unit_hash(t: Tables):
    return t.api_docs.select("id").distinct().select("id", text.fnv_unit(F.col("id")).alias("unit"))


@query("""SELECT id, CASE WHEN rn = 1 THEN slug ELSE slug || '-' || id END AS slug FROM (SELECT id, slug, row_number() OVER (PARTITION BY slug ORDER BY id) AS rn
    FROM (SELECT DISTINCT id, regexp_replace(regexp_replace(lower(regexp_extract(source_file, '[^/]+$', 0)), '[^a-z]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM oracle_documents WHERE source_file IS NOT NULL))""")
def unique_slugs(t: Tables):
    stem = F.regexp_replace(F.regexp_replace(F.lower(F.element_at(F.split("source_file", "/"), -1)), "[^a-z]+", "-"), "^-+|-+$", "")
    d = t.oracle_documents.where("source_file is not null").select("id", stem.alias("slug")).distinct()
    return merge.unique_slugs(d, "slug", ["id"], F.col("id"))


@query(r"""SELECT doc_id, regexp_replace(text, '(?ms)\A---\r?\n.*?\r?\n---\r?\n*', '') AS body FROM documents WHERE text IS NOT NULL""")
def body_without_front_matter(t: Tables):
    return t.documents.where("text is not null").select("doc_id", F.regexp_replace("text", r"(?ms)\A---\r?\n.*?\r?\n---\r?\n*", "").alias("body"))


@query("""SELECT id, CASE WHEN starts_with(project, 'forge.example/quillmoor') THEN project || '/' || source_file END AS vault FROM (SELECT DISTINCT id, lower(project) AS project, source_file FROM oracle_documents WHERE project IS NOT NULL AND source_file IS NOT NULL)""")
def vault_paths(t: Tables):
    d = t.oracle_documents.where("project is not null and source_file is not null").select("id", F.lower("project").alias("project"), "source_file").distinct()
    own = F.startswith("project", F.lit("forge.example/quillmoor"))
    return d.select("id", F.when(own, markup.vault_path(F.col("source_file"), F.col("project"))).alias("vault"))


@query()
def front_matter_fields(t: Tables):
    """Front matter of every document as a map."""
    return t.documents.where("text is not null").select("doc_id", markup.front_matter_map(F.col("text")).alias("fields")).where("fields is not null")


@query()
def slug_c(t: Tables):
    """Slugs that keep letters whose accents fall away."""
    return t.documents.where("text is not null").select("doc_id", markup.ascii_slug(F.col("text")).alias("slug"))


@query()
def collection_rebuild(t: Tables):
    """Vectors of all current records by the offline embedder, merged into a collection."""
    each = t.oracle_documents.where("id is not null and content is not null").select("id", "content").distinct()
    docs = each.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("content")), "\n").alias("content"))  # an id's texts go into one vector
    new = embed.embedded(docs, "id", "content", "small")
    return embed.upserted(t.vector_documents.where("vector is not null").select("model_key", "id", "vector"), new)
