"""Queries over graphs, maps, the queue and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions.keys import concept_list, norm_key
from siltstone.operators import graph, layout, queue, relational as rel
from siltstone.plans.documents import _CONCEPTS
from siltstone.plans.registry import NOW, Tables, query
from siltstone.streaming import live

_EDGES = r"(SELECT DISTINCT lower(regexp_replace(old_id, '^\s+|\s+$', '', 'g')) AS src, lower(regexp_replace(new_id, '^\s+|\s+$', '', 'g')) AS dst FROM supersede_log WHERE trim(old_id) <> '' AND trim(new_id) <> '')"


def _edges(t: Tables):
    return t.supersede_log.select(norm_key(F.col("old_id")).alias("src"), norm_key(F.col("new_id")).alias("dst")).where("src is not null and dst is not null").distinct()


def _recursive(edges: str, start: str) -> str:
    """Every node a start leads to with its smallest depth, at any depth: one row a pair is kept and only a nearer one replaces it."""
    return f"""WITH RECURSIVE reach(root, id, depth) USING KEY (root, id) AS (SELECT id, id, 0 FROM ({start}) UNION SELECT r.root, e.dst, min(r.depth + 1)
        FROM reach r JOIN {edges} e ON e.src = r.id LEFT JOIN recurring.reach k ON k.root = r.root AND k.id = e.dst WHERE k.id IS NULL GROUP BY r.root, e.dst) SELECT root, id, CAST(depth AS INT) AS depth FROM reach"""


def _sample(n: int, seed: int) -> str:
    return f"(SELECT id, type FROM (SELECT id, type, row_number() OVER (PARTITION BY type ORDER BY md5('{seed}:' || id), id) AS rn FROM (SELECT DISTINCT id, type FROM oracle_documents)) WHERE rn <= {n})"


@query(f"""WITH each AS (SELECT id, unnest(terms) AS concept FROM (SELECT DISTINCT id, coalesce(list_distinct({_CONCEPTS}), []) AS terms FROM oracle_documents WHERE id IN (SELECT id FROM {_sample(310, 3)})))
    SELECT a.id AS id_a, b.id AS id_b, count(*) AS weight FROM each a JOIN each b ON a.concept = b.concept AND a.id < b.id GROUP BY ALL ORDER BY id_a, id_b LIMIT 5000""")
def concept_graph_edges(t: Tables):
    """The graph view: up to 310 records of every type, and the first 5,000 edges between records sharing a concept."""
    docs = t.oracle_documents.select("id", "type", concept_list(F.col("concepts")).alias("terms")).distinct()
    nodes = docs.join(rel.sample_per_group(docs.select("id", "type").distinct(), "type", "id", 310, seed=3).select("id"), "id", "left_semi")
    return graph.concept_edges(nodes, "id", "terms")


@query(f"""WITH each AS (SELECT id, unnest(terms) AS concept FROM (SELECT DISTINCT id, coalesce(list_distinct({_CONCEPTS}), []) AS terms FROM oracle_documents WHERE id IN (SELECT id FROM {_sample(310, 3)})))
    SELECT a.id AS id_a, b.id AS id_b, count(*) AS weight FROM each a JOIN each b ON a.concept = b.concept AND a.id < b.id GROUP BY ALL""")
def concept_graph_all_edges(t: Tables):
    """All edges between the graph view's records, without the view's cap."""
    docs = t.oracle_documents.select("id", "type", concept_list(F.col("concepts")).alias("terms")).distinct()
    nodes = docs.join(rel.sample_per_group(docs.select("id", "type").distinct(), "type", "id", 310, seed=3).select("id"), "id", "left_semi")
    return graph.concept_edges(nodes, "id", "terms", most=None)


@query(_recursive(_EDGES, f"SELECT DISTINCT src AS id FROM {_EDGES} WHERE src NOT IN (SELECT dst FROM {_EDGES})"))
def supersede_lineage(t: Tables):
    """Every record a root leads to, at any depth."""
    edges = _edges(t)
    roots = edges.select(F.col("src").alias("id")).distinct().join(edges.select(F.col("dst").alias("id")), "id", "left_anti")
    return graph.walk(edges, roots)


_TREE = "(SELECT CAST(event_id AS BIGINT) AS dst, CAST((event_id - 1) // 4 AS BIGINT) AS src FROM events WHERE event_id > 0)"


@query(_recursive(_TREE, "SELECT CAST(5 AS BIGINT) AS id"))
def trace_tree_down(t: Tables):
    edges = t.events.where("event_id > 0").select(F.floor((F.col("event_id") - 1) / 4).alias("src"), F.col("event_id").alias("dst"))
    return graph.walk(edges, t.spark.createDataFrame([(5,)], "id long"))


@query(_recursive("(SELECT dst AS src, src AS dst FROM " + _TREE + ")", "SELECT CAST(777 AS BIGINT) AS id"))
def trace_tree_up(t: Tables):
    edges = t.events.where("event_id > 0").select(F.col("event_id").alias("src"), F.floor((F.col("event_id") - 1) / 4).alias("dst"))
    return graph.walk(edges, t.spark.createDataFrame([(777,)], "id long"))


@query("""SELECT user_id, event_id AS id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS position FROM events""")
def linked_chain(t: Tables):
    """The chain of every identity's events with each one's true position: links are read, and followed from wherever a chain is entered."""
    from pyspark.sql import Window

    links = t.events.select("user_id", F.col("event_id").alias("id"), F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("next"))
    return graph.chains(links).join(links.select("user_id", "id"), "id").select("user_id", "id", F.col("position").cast("int").alias("position"))


@query("""SELECT o.id, o.type, o.superseded_by, o.superseded_at, n.type AS new_type, n.source_file AS new_file FROM (SELECT DISTINCT id, type, superseded_by, superseded_at FROM oracle_documents WHERE superseded_by IS NOT NULL) o
    LEFT JOIN (SELECT DISTINCT id, type, source_file FROM oracle_documents) n ON o.superseded_by = n.id""")
def supersede_list(t: Tables):
    return graph.supersede_pairs(t.oracle_documents)


@query(f"SELECT dst AS id, count(*) AS replaced, min(src) AS first_id FROM {_EDGES} GROUP BY dst")
def supersede_chain(t: Tables):
    return _edges(t).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("replaced"), F.min("src").alias("first_id"))


@query("""WITH f AS (SELECT source_file AS file, coalesce(lower(min(project)), '_default') AS grp FROM oracle_documents WHERE source_file IS NOT NULL GROUP BY 1),
    g AS (SELECT grp, row_number() OVER (ORDER BY grp) - 1 AS ord, count(*) OVER () AS total FROM (SELECT DISTINCT grp FROM f)),
    h AS (SELECT f.file, f.grp, ord * 1.618033988749895 * 2 * pi() AS ang, sqrt((ord + 0.5) / total) * 0.75 AS r,
        list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(f.file, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295) % 10000 / 10000.0 AS hx,
        list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(f.file || '_y', ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295) % 10000 / 10000.0 AS hy FROM f JOIN g ON f.grp = g.grp)
    SELECT file, grp, round(r * cos(ang) + (hx - 0.5) * 0.2, 6) AS x, round(r * sin(ang) + (hy - 0.5) * 0.2, 6) AS y FROM h""")
def map2d_layout(t: Tables):
    from pyspark.sql import Window

    files = t.oracle_documents.where("source_file is not null").groupBy(F.col("source_file").alias("file")).agg(F.coalesce(F.lower(F.min("project")), F.lit("_default")).alias("grp"))
    # projects are few; their numbering is the one place where they meet in one task
    groups = files.select("grp").distinct().withColumn("ord", F.row_number().over(Window.orderBy("grp")) - 1).withColumn("total", F.count("*").over(Window.partitionBy(F.lit(1))))
    return layout.sunflower(files, groups).select("file", "grp", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query()
def map3d_pca(t: Tables):
    """Documents on the first three principal axes of their embeddings."""
    return layout.map_3d(t.embeddings, "vec_id", "embedding")


@query("""SELECT label, place, round(avg(x), 5) AS m FROM (SELECT label, unnest(range(0, len(embedding))) AS place, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY label, place""")
def mean_vectors(t: Tables):
    means = layout.mean_vectors(t.embeddings, "label", "embedding")
    return means.select("label", F.posexplode("embedding").alias("at", "m")).select("label", F.col("at").cast("long").alias("place"), F.round("m", 5).alias("m"))


@query(f"SELECT id, type FROM {_sample(10, 42)}")
def reflect_random(t: Tables):
    """Ten records of every type, drawn by a seeded hash."""
    return rel.sample_per_group(t.oracle_documents.select("id", "type").distinct(), "type", "id", 10, seed=42)


@query("""SELECT model_key, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'claimed') AS claimed, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'error') AS error,
    count(*) FILTER (status IN ('pending', 'claimed')) AS depth FROM indexing_jobs GROUP BY model_key""")
def queue_status_counts(t: Tables):
    return queue.depth(t.indexing_jobs)


@query(f"""SELECT d.id AS doc_id, m.model_key, 'pending' AS status, 0 AS attempts, {NOW} AS created_at FROM (SELECT DISTINCT id FROM oracle_documents WHERE superseded_by IS NULL) d, (SELECT DISTINCT model_key FROM vector_documents) m""")
def queue_enqueue(t: Tables):
    docs = t.oracle_documents.where("superseded_by is null").select(F.col("id").alias("doc_id")).distinct()
    return queue.enqueue(docs, t.vector_documents.select("model_key").distinct(), NOW)


@query("""SELECT model_key, id, attempts + 1 AS attempts FROM (SELECT *, row_number() OVER (PARTITION BY model_key ORDER BY created_at, id) AS rn FROM (SELECT DISTINCT * FROM indexing_jobs WHERE status = 'pending')) WHERE rn <= 3""")
def queue_claim_next(t: Tables):
    return queue.claim_next(t.indexing_jobs, 3).select("model_key", "id", "attempts")


def _stream(t: Tables):
    schema = t.events.schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_growth_window(t: Tables):
    return live.drained(live.daily_growth(_stream(t)), "siltstone_growth")


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 1800000000 THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT user_id, us, sum(fresh) OVER (PARTITION BY user_id ORDER BY us) AS sess FROM e)
    SELECT user_id, min(us) // 1000 AS start_ms, (max(us) + 1800000000) // 1000 AS end_ms, count(*) AS n FROM s GROUP BY user_id, sess""")
def stream_sessions(t: Tables):
    return live.drained(live.sessions(_stream(t)), "siltstone_sessions")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY ALL")
def stream_growth_closed(t: Tables):
    """Days that the watermark has closed, appended to files as a live stream would."""
    from siltstone.storage import new_folder, new_state

    folder = new_folder(t.spark, "growth")
    new_state(t.spark, f"{folder}-state")
    growth = live.daily_growth(_stream(t))
    live.appended(growth, folder, f"{folder}-state").awaitTermination()
    return t.spark.read.schema(growth.schema).parquet(folder)


@query()
def map3d_files(t: Tables):
    """Files on the first three principal axes of their records' mean vectors, under the first model."""
    first = t.vector_documents.agg(F.min("model_key").alias("model_key"))
    d = t.vector_documents.agg(F.max(F.size("vector"))).first()[0]
    good = t.vector_documents.join(F.broadcast(first), "model_key").where((F.size("vector") == d) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    files = t.oracle_documents.where("source_file is not null").select("id", F.col("source_file").alias("file")).distinct()
    means = layout.mean_vectors(good.select(norm_key(F.col("id")).alias("id"), "vector").distinct().join(files, "id"), "file", "vector")
    return layout.map_3d(means, "file", "vector")
