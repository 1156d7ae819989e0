"""Queries over the state that people and tools write: traces, threads, logs, appointments, jobs, imports, index runs.

The test tables have no such state, so it is derived from what they have: events stand for traces and messages, jobs and logs for themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import dates, markup, text
from siltstone.functions.keys import concept_list, metadata_is, norm_key, string_map
from siltstone.operators import exports, graph, indexing, ingest, logs, merge, queue, relational as rel, schedule, search, threads, traces
from siltstone.plans.documents import _CONCEPTS
from siltstone.plans.registry import NOW, TODAY, Tables, query
from siltstone.sources import files, sinks
from siltstone.storage import new_folder


def _empty(t: Tables, schema: str) -> DataFrame:
    return t.spark.createDataFrame([], schema)


# traces

def _traces(t: Tables, linked: bool = False) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    own = F.col("event_id").cast("string")
    rows = t.events.select(
        own.alias("trace_id"), F.col("event_type").alias("query"), (F.col("event_id") % 7).cast("int").alias("depth"),
        F.when(F.col("event_id") > 0, F.floor((F.col("event_id") - 1) / 4).cast("string")).alias("parent_trace_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("created_at"),
        F.when(F.col("event_type") == "purchase", F.col("props")).alias("awakening"),
        *((F.lag(own).over(w).alias("prev_trace_id"), F.lead(own).over(w).alias("next_trace_id")) if linked else ()),
    )
    return _empty(t, traces.SCHEMA).unionByName(rows, allowMissingColumns=True)


_NEW = "(SELECT input_id AS id, CAST(min(created_at) % 20000 AS VARCHAR) AS parent FROM learn_inputs GROUP BY input_id)"


@query(f"""WITH n AS {_NEW}, e AS (SELECT CAST(event_id AS VARCHAR) AS id, event_id % 7 AS depth FROM events)
    SELECT e.id AS trace_id, CAST(e.depth AS INT) AS depth, coalesce(k.kids, 0) AS children, coalesce(k.kids, 0) > 0 AS touched, NULL AS status FROM e LEFT JOIN (SELECT parent, CAST(count(*) AS INT) AS kids FROM n GROUP BY parent) k ON k.parent = e.id
    UNION ALL SELECT n.id, CAST(coalesce(e.depth + 1, 0) AS INT), 0, true, 'raw' FROM n LEFT JOIN e ON n.parent = e.id""")
def trace_created(t: Tables):
    """Learning inputs as new traces below events: depths, and every parent's children."""
    new = t.learn_inputs.groupBy(F.col("input_id").alias("trace_id")).agg(F.min("pattern").alias("query"), (F.min("created_at") % 20000).cast("string").alias("parent_trace_id"))
    done = traces.created(_traces(t), new, NOW)
    return done.select("trace_id", "depth", F.size("child_trace_ids").alias("children"), (F.coalesce("updated_at", F.lit(0)) == NOW).alias("touched"), "status")


_WANTED = """(SELECT DISTINCT CAST(event_id AS VARCHAR) AS p, CAST(event_id + 5 AS VARCHAR) AS n FROM events UNION SELECT CAST(event_id AS VARCHAR), CAST(event_id + 6 AS VARCHAR) FROM events WHERE event_type = 'click')"""


@query(f"""WITH e AS (SELECT CAST(event_id AS VARCHAR) AS id FROM events), w AS {_WANTED}
    SELECT p AS prev_id, n AS next_id, CASE WHEN n NOT IN (SELECT id FROM e) THEN 'missing' WHEN count(*) OVER (PARTITION BY p) = 1 AND count(*) OVER (PARTITION BY n) = 1 THEN 'linked' ELSE 'taken' END AS outcome FROM w""")
def trace_linked(t: Tables):
    """Links between events five apart, some of which want the same side."""
    e = t.events.select(F.col("event_id"), "event_type")
    pair = lambda df, d: df.select(F.col("event_id").cast("string").alias("prev_id"), (F.col("event_id") + d).cast("string").alias("next_id"))
    return traces.linked(_traces(t), pair(e, 5).unionByName(pair(e.where("event_type = 'click'"), 6)), NOW)[1]


_LINKED = """(SELECT CAST(event_id AS VARCHAR) AS id, event_type, CAST(lag(event_id) OVER w AS VARCHAR) AS prev, CAST(lead(event_id) OVER w AS VARCHAR) AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


@query(f"""WITH l AS {_LINKED} SELECT l.id AS trace_id, CASE WHEN p.event_type = 'click' THEN NULL ELSE l.prev END AS prev_trace_id, CASE WHEN l.event_type = 'click' THEN NULL ELSE l.next END AS next_trace_id
    FROM l LEFT JOIN l p ON l.prev = p.id""")
def trace_unlinked(t: Tables):
    """Every click loses its link to the next event, on both sides."""
    clicks = t.events.where("event_type = 'click'").select(F.col("event_id").cast("string").alias("trace_id"))
    return traces.unlinked(_traces(t, linked=True), clicks, "next", NOW).select("trace_id", "prev_trace_id", "next_trace_id")


@query(f"SELECT CAST(event_id AS VARCHAR) AS trace_id, CASE WHEN event_type = 'signup' THEN 'distilled' END AS status, CASE WHEN event_type = 'signup' THEN 'seen' WHEN event_type = 'purchase' THEN props END AS awakening, CASE WHEN event_type = 'signup' THEN {NOW} END AS distilled_at FROM events")
def trace_distilled(t: Tables):
    said = t.events.where("event_type = 'signup'").select(F.col("event_id").cast("string").alias("trace_id"), F.lit("seen").alias("awakening"))
    return traces.distilled(_traces(t), said, NOW).select("trace_id", "status", "awakening", "distilled_at")


@query("""SELECT CAST(event_id AS VARCHAR) AS trace_id, event_type AS query, CAST(event_id % 7 AS INT) AS depth, 0 AS file_count, 0 AS commit_count, 'raw' AS status, event_type = 'purchase' AS has_awakening, (epoch_us(ts) // 1000) AS created_at
    FROM events WHERE event_id % 7 = 3 ORDER BY ts DESC, CAST(event_id AS VARCHAR) LIMIT 25 OFFSET 50""")
def trace_list(t: Tables):
    return traces.listed(_traces(t), depth=3, limit=25, offset=50)[0]


@query("SELECT count(*) AS total, 75 < count(*) AS has_more FROM events WHERE event_id % 7 = 3")
def trace_list_more(t: Tables):
    return traces.listed(_traces(t), depth=3, limit=25, offset=50)[1]


@query("""WITH RECURSIVE up(id, d) AS (SELECT CAST(777 AS BIGINT), 0 UNION ALL SELECT CAST((id - 1) // 4 AS BIGINT), d - 1 FROM up WHERE id > 0), down(id, d) AS (SELECT CAST(777 AS BIGINT), 0 UNION ALL
        SELECT CAST(e.event_id AS BIGINT), d + 1 FROM down JOIN events e ON e.event_id > 0 AND (e.event_id - 1) // 4 = down.id), f AS (SELECT * FROM up UNION SELECT * FROM down),
    g AS (SELECT CAST(f.id AS VARCHAR) AS id, d, event_id % 7 AS depth, event_type = 'purchase' AS awake FROM f JOIN events ON f.id = event_id)
    SELECT '777' AS root, list(id ORDER BY d, id) AS chain, CAST(max(depth) AS INT) AS total_depth, bool_or(awake) AS has_awakening, arg_max(id, (d, id)) FILTER (awake) AS awakening_trace_id FROM g""")
def trace_chain(t: Tables):
    """Ancestors, self and descendants of one trace, with the depth and the last awakening of the chain."""
    return traces.chain_report(_traces(t), t.spark.createDataFrame([("777",)], "id string"))


@query(f"""SELECT CAST(event_id AS VARCHAR) AS id, first_value(CAST(event_id AS VARCHAR)) OVER w AS head, row_number() OVER w - 1 AS position FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def trace_linked_chain(t: Tables):
    """Every event's place in its identity's chain, found by following links from wherever it is entered."""
    return graph.chains(_traces(t, linked=True).select(F.col("trace_id").alias("id"), F.col("next_trace_id").alias("next")))


# threads

def _threads(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("user_id").alias("id")).agg(
        F.concat(F.lit("thread "), F.max("user_id")).alias("title"), F.lit("user").alias("created_by"), F.lit("active").alias("status"), F.lit(None).cast("string").alias("project"),
        F.min(F.unix_millis(F.col("ts").cast("timestamp"))).alias("created_at"), F.max(F.unix_millis(F.col("ts").cast("timestamp"))).alias("updated_at"),
    )


def _messages(t: Tables) -> DataFrame:
    return t.events.select(F.col("user_id").alias("thread_id"), F.lit("human").alias("role"), F.col("props").alias("content"), F.lit("user").alias("author"), F.unix_millis(F.col("ts").cast("timestamp")).alias("created_at"))


def _posts(t: Tables) -> DataFrame:
    """Documents as messages: to an existing thread, to one that is not there, or opening one."""
    d = t.learn_inputs.where("pattern is not null").groupBy("pattern").agg(F.min("created_at").alias("at"), F.max("project").alias("project"))
    role = F.when(F.col("at") % 2 == 0, "human").otherwise("oracle")
    return d.select(F.when(F.col("at") % 3 > 0, F.col("at") % 1500).alias("thread_id"), role.alias("role"), F.col("pattern").alias("content"), "project")


_POSTS = """(SELECT CASE WHEN at_ % 3 > 0 THEN at_ % 1500 END AS thread_id, CASE WHEN at_ % 2 = 0 THEN 'human' ELSE 'oracle' END AS role, pattern AS content, project FROM (SELECT pattern, min(created_at) AS at_, max(project) AS project FROM learn_inputs WHERE pattern IS NOT NULL GROUP BY pattern))"""
_AUTHOR = "CASE WHEN role = 'human' THEN 'user' ELSE 'claude' END || CASE WHEN coalesce(project, '') <> '' THEN '@' || project ELSE '' END"


@query(f"""WITH p AS {_POSTS}, o AS (SELECT *, (SELECT max(user_id) FROM events) + row_number() OVER (ORDER BY content) AS id FROM p WHERE thread_id IS NULL),
    a AS (SELECT thread_id AS id, role FROM p WHERE thread_id IN (SELECT user_id FROM events))
    SELECT user_id AS id, 'thread ' || user_id AS title, 'user' AS created_by, CASE WHEN user_id IN (SELECT id FROM a WHERE role = 'human') THEN 'pending' ELSE 'active' END AS status,
        CASE WHEN user_id IN (SELECT id FROM a) THEN {NOW} ELSE max(epoch_us(ts) // 1000) END AS updated_at FROM events GROUP BY user_id
    UNION ALL SELECT id, substr(content, 1, 50) || CASE WHEN length(content) > 50 THEN '...' ELSE '' END, {_AUTHOR}, CASE WHEN role = 'human' THEN 'pending' ELSE 'active' END, {NOW} FROM o""")
def thread_posted(t: Tables):
    """Threads after many messages came in: new ones are opened, states and times follow."""
    return threads.posted(_threads(t), _messages(t), _posts(t), NOW)[0].select("id", "title", "created_by", "status", "updated_at")


@query(f"SELECT thread_id, role, content FROM {_POSTS} WHERE thread_id IS NOT NULL AND thread_id NOT IN (SELECT user_id FROM events)")
def thread_missing(t: Tables):
    """Messages to threads that do not exist."""
    return threads.posted(_threads(t), _messages(t), _posts(t), NOW)[2]


@query("""SELECT user_id AS thread_id, 'thread ' || user_id AS title, CASE WHEN user_id % 2 = 0 THEN 'closed' ELSE 'active' END AS status, count(*) AS messages, arg_max(substr(props, 1, 100), ((epoch_us(ts) // 1000), props)) AS last_message,
    CASE WHEN user_id % 2 = 0 THEN 1772323200000 ELSE max(epoch_us(ts) // 1000) END AS updated_at FROM events GROUP BY user_id""")
def thread_overview(t: Tables):
    """All threads with their last message, after some were closed."""
    closed = t.events.where("user_id % 2 = 0").select(F.col("user_id").alias("id"), F.lit("closed").alias("status")).distinct()
    return threads.overview(threads.with_status(_threads(t), closed, NOW), _messages(t))


@query("SELECT user_id AS thread_id, 'thread ' || user_id AS title, 'active' AS status, 'human' AS role, 'user' AS author, props AS content, (epoch_us(ts) // 1000) AS created_at FROM events")
def thread_read(t: Tables):
    return threads.full_thread(_threads(t), _messages(t), t.events.select(F.col("user_id").alias("id")))


# logs

def _results(t: Tables) -> DataFrame:
    return t.events.select(F.col("user_id").alias("search_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("rank"), F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("type"), F.col("value").alias("score"), F.col("props").alias("content"))


@query("""SELECT s.user_id AS search_id, coalesce(n, 0) AS results_count, top, snippets FROM (SELECT DISTINCT user_id FROM events) s LEFT JOIN (SELECT user_id, CAST(count(*) AS INT) AS n, list(CAST(event_id AS VARCHAR) ORDER BY ts, event_id)[1:5] AS top,
    list(substr(props, 1, 100) ORDER BY ts, event_id)[1:5] AS snippets FROM events GROUP BY user_id) r ON r.user_id = s.user_id""")
def log_search_rows(t: Tables):
    """Search log rows with the five best hits of each search."""
    searches = t.events.select(F.col("user_id").alias("search_id"), F.lit("q").alias("query"), F.lit("all").alias("type"), F.lit("fts").alias("mode"), F.lit(1).alias("search_time_ms"), F.lit("").alias("project")).distinct()
    rows = logs.search_rows(searches, _results(t), NOW)
    hits = F.from_json("results", "array<struct<id:string,type:string,score:double,snippet:string>>")
    return rows.select("search_id", "results_count", F.transform(hits, lambda h: h["id"]).alias("top"), F.transform(hits, lambda h: h["snippet"]).alias("snippets"))


@query(f"SELECT id AS document_id, 'read' AS access_type, {NOW} AS created_at, project FROM oracle_documents")
def log_access_rows(t: Tables):
    return logs.access_rows(t.oracle_documents, "read", NOW)


@query(f"""SELECT input_id AS document_id, substr(pattern, 1, 100) AS pattern_preview, coalesce(nullif(source, ''), 'learn') AS source, len(coalesce({_CONCEPTS}, [])) AS concepts, {NOW} AS created_at, project FROM learn_inputs""")
def log_learn_rows(t: Tables):
    learned = t.learn_inputs.select(F.col("input_id").alias("id"), "pattern", "source", concept_list(F.col("concepts")).alias("concepts"), "project")
    return logs.learn_rows(learned, NOW).withColumn("concepts", F.size(F.from_json("concepts", "array<string>")))


@query("SELECT count(*) AS searches, round(avg(CAST(round(value) AS BIGINT)), 4) AS avg_ms, CAST(sum(user_id) AS BIGINT) AS results FROM events")
def log_search_totals(t: Tables):
    return logs.search_totals(t.events.select(F.round("value").cast("long").alias("search_time_ms"), F.col("user_id").alias("results_count")))


@query("SELECT event_id, (epoch_us(ts) // 1000) AS created_at FROM events ORDER BY ts DESC, event_id LIMIT 20")
def log_recent(t: Tables):
    return logs.recent(t.events.select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("created_at")), 20, "event_id")


# appointments

_SPELLED = """CASE doc_id % 9 WHEN 0 THEN strftime(created_at, '%Y-%m-%d') WHEN 1 THEN day(created_at) || ' ' || strftime(created_at, '%b') WHEN 2 THEN strftime(created_at, '%B') || ' ' || day(created_at) || ', ' || year(created_at)
    WHEN 3 THEN day(created_at) || '/' || month(created_at) || '/' || year(created_at) WHEN 4 THEN day(created_at) || '-' || month(created_at) || '-' || substr(CAST(year(created_at) AS VARCHAR), 3) WHEN 5 THEN day(created_at) || ' มีค ' || year(created_at)
    WHEN 6 THEN 'marble ' || day(created_at) WHEN 7 THEN '45/13' ELSE 'Tomorrow ' END"""
_READ = f"""CASE WHEN created_at IS NULL AND doc_id % 9 NOT IN (7, 8) THEN NULL WHEN doc_id % 9 = 1 THEN '{TODAY[:4]}-' || strftime(created_at, '%m-%d') WHEN doc_id % 9 = 5 THEN year(created_at) || '-03-' || strftime(created_at, '%d') WHEN doc_id % 9 IN (6, 7) THEN '{TODAY}' WHEN doc_id % 9 = 8 THEN '2026-03-02' ELSE strftime(created_at, '%Y-%m-%d') END"""


def _spelled(t: Tables) -> DataFrame:
    at, d, m, y = F.col("created_at"), F.dayofmonth("created_at").cast("string"), F.month("created_at").cast("string"), F.year("created_at").cast("string")
    ways = [
        F.date_format(at, "yyyy-MM-dd"), F.concat(d, F.lit(" "), F.date_format(at, "MMM")), F.concat(F.date_format(at, "MMMM"), F.lit(" "), d, F.lit(", "), y), F.concat(d, F.lit("/"), m, F.lit("/"), y),
        F.concat(d, F.lit("-"), m, F.lit("-"), F.substring(y, 3, 2)), F.concat(d, F.lit(" มีค "), y), F.concat(F.lit("marble "), d), F.lit("45/13"), F.lit("Tomorrow "),
    ]
    return t.documents.select("doc_id", F.element_at(F.array(*ways), (F.col("doc_id") % 9 + 1).cast("int")).alias("spelled"))


@query(f"SELECT doc_id, {_SPELLED} AS spelled, {_READ} AS day FROM documents")
def date_spellings(t: Tables):
    """Dates in nine spellings, two of which are none."""
    return _spelled(t).select("doc_id", "spelled", dates.parsed_date(F.col("spelled"), TODAY).alias("day"))


def _appointments(t: Tables) -> DataFrame:
    d = t.documents.select(F.col("doc_id").alias("id"), F.concat_ws(" ", "source", "lang", F.lit("event")).alias("event"), F.when(F.col("doc_id") % 3 > 0, F.concat((F.col("doc_id") % 24).cast("string"), F.lit(":00"))).alias("time"), F.when(F.col("doc_id") % 11 == 0, F.lit("weekly")).alias("recurring"))
    new = d.join(_spelled(t).select(F.col("doc_id").alias("id"), F.col("spelled").alias("date")), "id")
    return schedule.added(_empty(t, schedule.SCHEMA), new, TODAY, NOW)


_APPOINTED = f"""(SELECT doc_id AS id, {_READ} AS date, {_SPELLED} AS date_raw, CASE WHEN doc_id % 3 > 0 THEN (doc_id % 24) || ':00' END AS time, concat_ws(' ', source, lang, 'event') AS event, CASE WHEN doc_id % 11 = 0 THEN 'weekly' END AS recurring FROM documents WHERE created_at IS NOT NULL OR doc_id % 9 IN (7, 8))"""


@query(f"SELECT id, date, time, event FROM {_APPOINTED} WHERE date BETWEEN '{TODAY}' AND '2026-03-15' ORDER BY date, time NULLS FIRST, id LIMIT 50")
def schedule_listed(t: Tables):
    """The next two weeks' appointments."""
    return schedule.listed(_appointments(t), TODAY).select("id", "date", "time", "event")


@query(f"SELECT id, date, CASE WHEN id % 5 = 0 THEN 'done' ELSE 'pending' END AS status, event, CASE WHEN id % 5 = 0 THEN 'kept' END AS notes FROM {_APPOINTED}")
def schedule_changed(t: Tables):
    """Every fifth appointment is done, with a note; what a patch leaves null stays."""
    patch = t.documents.where("doc_id % 5 = 0").select(F.col("doc_id").alias("id"), F.lit("done").alias("status"), F.lit("kept").alias("notes"), F.lit(None).cast("string").alias("event"))
    return schedule.changed(_appointments(t), patch, NOW).select("id", "date", "status", "event", "notes")


@query(f"""WITH a AS {_APPOINTED}, m AS (SELECT substr(date, 1, 7) AS section, '| ' || date_raw || ' | ' || coalesce(time, 'TBD') || ' | ' || event || CASE WHEN recurring IS NOT NULL THEN ' (weekly)' ELSE '' END || ' |  |' || chr(10) AS line, date, coalesce(time, '') AS tm, id FROM a)
    SELECT section, '## ' || strftime(CAST(section || '-01' AS DATE), '%B %Y') || chr(10) || chr(10) || '| Date | Time | Event | Notes |' || chr(10) || '|------|------|-------|-------|' || chr(10) || string_agg(line, '' ORDER BY date, tm, id) AS body FROM m GROUP BY section
    UNION ALL SELECT 'recurring', '## Recurring' || chr(10) || chr(10) || '| Day | Time | Event |' || chr(10) || '|-----|------|-------|' || chr(10) || string_agg('| weekly | ' || coalesce(time, 'TBD') || ' | ' || event || ' |' || chr(10), '' ORDER BY date, coalesce(time, ''), id)
    FROM a WHERE recurring IS NOT NULL""")
def schedule_markdown(t: Tables):
    """A table a month of all pending appointments, and one of those that recur."""
    return schedule.markdown(_appointments(t))


# jobs

_JOBS = "(SELECT DISTINCT * FROM indexing_jobs)"


@query(f"""SELECT id, CASE WHEN status = 'claimed' THEN CASE WHEN model_key LIKE '%a%' THEN 'error' ELSE 'done' END ELSE status END AS status, CASE WHEN status = 'claimed' THEN {NOW} ELSE finished_at END AS finished_at,
    CASE WHEN status = 'claimed' THEN CASE WHEN model_key LIKE '%a%' THEN 'failed' END ELSE error END AS error, attempts FROM {_JOBS}""")
def jobs_finished(t: Tables):
    """Claimed jobs end, those of some models with an error; rows and attempts stay."""
    jobs = t.indexing_jobs.distinct()
    ended = jobs.where("status = 'claimed'").select("id", F.when(F.contains("model_key", F.lit("a")), "failed").alias("error")).distinct()
    return queue.finished(jobs, ended, NOW).select("id", "status", "finished_at", "error", "attempts")


@query(f"SELECT id, CASE WHEN status = 'claimed' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'claimed' THEN NULL ELSE claimed_at END AS claimed_at FROM {_JOBS}")
def jobs_reclaimed(t: Tables):
    """All jobs asked to be reclaimed: only claimed ones are."""
    jobs = t.indexing_jobs.distinct()
    return queue.reclaimed(jobs, jobs.select("id")).select("id", "status", "claimed_at")


@query(f"SELECT id, status FROM {_JOBS} WHERE status <> 'pending' OR attempts > 0")
def jobs_cancelled(t: Tables):
    """Jobs never tried asked to be cancelled: only pending ones are."""
    jobs = t.indexing_jobs.distinct()
    return queue.cancelled(jobs, jobs.where("attempts = 0").select("id")).select("id", "status")


@query(r"""WITH j AS (SELECT DISTINCT id, model_key, lower(regexp_replace(doc_id, '^\s+|\s+$', '', 'g')) AS doc_id FROM indexing_jobs WHERE status = 'claimed'), d AS (SELECT lower(trim(id)) AS doc_id, max(content) AS text FROM oracle_documents GROUP BY 1)
    SELECT j.id, model_key, length(text) AS chars, CASE WHEN d.doc_id IS NULL THEN 'doc_missing' WHEN contains(model_key, 'a') AND contains(j.id, '7') THEN 'error' ELSE 'done' END AS event FROM j LEFT JOIN d ON j.doc_id = d.doc_id""")
def jobs_worked(t: Tables):
    """Claimed jobs beside their texts: a document that is gone is done, a failure stays with its own model."""
    claimed = t.indexing_jobs.where("status = 'claimed'").select("id", "model_key", norm_key(F.col("doc_id")).alias("doc_id")).distinct()
    docs = t.oracle_documents.groupBy(norm_key(F.col("id")).alias("doc_id")).agg(F.max("content").alias("text"))
    failed = claimed.where(F.contains("model_key", F.lit("a")) & F.contains("id", F.lit("7"))).select("id", F.lit("failed").alias("error"))
    return queue.worked(claimed, docs, failed).select("id", "model_key", F.length("text").alias("chars"), "event")


@query(f"""SELECT user_id AS id, status, n AS progress_current, total AS progress_total, rate AS docs_per_second, CAST(CASE WHEN rate > 0 THEN ceil((total - n) / rate) ELSE 0 END AS BIGINT) AS eta FROM (SELECT user_id, n, n + user_id % 3 AS total,
        CASE WHEN user_id % 5 = 0 THEN 'error' WHEN user_id % 2 = 0 THEN 'indexing' WHEN user_id % 3 = 0 THEN 'completed' ELSE 'idle' END AS status, round(n / ((1706745600000 - first_ms) / 1000.0) * 1000 / 1000, 1) AS rate
    FROM (SELECT user_id, count(*) AS n, max(epoch_us(ts) // 1000) - 1000 AS first_ms FROM events GROUP BY user_id))""")
def index_progress(t: Tables):
    """Index runs with their state, documents a second, and the seconds left."""
    runs = t.events.groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("progress_current"), (F.max(F.unix_millis(F.col("ts").cast("timestamp"))) - 1000).alias("started_at"))
    runs = runs.withColumns({"progress_total": F.col("progress_current") + F.col("id") % 3, "is_indexing": F.col("id") % 2 == 0, "error": F.when(F.col("id") % 5 == 0, "broken")})
    return queue.progress(runs, 1_706_745_600_000)


# index runs and imports

_LATEST = "(SELECT id, arg_max(source_file, (indexed_at, source_file)) AS source_file, arg_max(type, (indexed_at, source_file)) AS type, max(indexed_at) AS indexed_at, arg_max(created_at, (indexed_at, source_file)) AS created_at, min(created_by) AS created_by FROM oracle_documents GROUP BY id)"


def _latest(t: Tables) -> DataFrame:
    last = lambda c: F.max_by(c, F.struct("indexed_at", "source_file")).alias(c)
    return t.oracle_documents.groupBy("id").agg(last("source_file"), last("type"), F.max("indexed_at").alias("indexed_at"), last("created_at"), F.min("created_by").alias("created_by"))


@query(f"""WITH o AS {_LATEST}, k AS (SELECT * FROM o WHERE NOT ((created_by = 'indexer' OR created_by IS NULL) AND (source_file IS NULL OR source_file IN (SELECT source_file FROM oracle_documents WHERE type = 'retro' AND source_file IS NOT NULL)))),
    n AS (SELECT id, min(source_file) AS source_file, 'again' AS type, 0 AS created_at FROM oracle_documents WHERE type = 'learning' GROUP BY id)
    SELECT coalesce(k.id, n.id) AS id, CASE WHEN n.id IS NULL THEN k.type ELSE 'again' END AS type, CASE WHEN n.id IS NULL THEN k.indexed_at ELSE {NOW} END AS indexed_at, CASE WHEN k.id IS NULL THEN 0 ELSE k.created_at END AS created_at FROM k FULL OUTER JOIN n ON k.id = n.id""")
def index_run(t: Tables):
    """A run in which all retrospectives' files are gone and all learnings come again."""
    d = t.oracle_documents.where("source_file is not null")
    disk = d.select("source_file").distinct().join(d.where("type = 'retro'").select("source_file"), "source_file", "left_anti")
    again = t.oracle_documents.where("type = 'learning'").groupBy("id").agg(F.min("source_file").alias("source_file")).select("id", "source_file", F.lit("again").alias("type"), F.lit(0).cast("long").alias("created_at"))
    return indexing.run(_latest(t), again, disk, NOW, force=True).select("id", "type", "indexed_at", "created_at")


@query("""WITH d AS (SELECT DISTINCT id, source_file, content FROM oracle_documents), o AS (SELECT * FROM d WHERE source_file IS NULL OR source_file NOT IN (SELECT source_file FROM oracle_documents WHERE type <> 'learning' AND source_file IS NOT NULL)),
    f AS (SELECT regexp_extract(path, '[^/]*$', 0) AS name, min(path) AS source FROM documents WHERE path IS NOT NULL GROUP BY 1)
    SELECT o.id, CASE WHEN f.source IS NOT NULL THEN 'copy' WHEN trim(coalesce(content, ''), ' ') <> '' THEN 'regenerate' ELSE 'unrecoverable' END AS action, f.source FROM o LEFT JOIN f ON f.name = regexp_extract(o.source_file, '[^/]*$', 0)""")
def orphan_recovery(t: Tables):
    """How files that are gone could come back."""
    d = t.oracle_documents.select("id", "source_file", "content").distinct()
    disk = t.oracle_documents.where("type <> 'learning' and source_file is not null").select("source_file")
    return indexing.recovery(d, disk, t.documents.where("path is not null").select("path"))


@query(f"""WITH o AS (SELECT id, min(type) AS type, max(indexed_at) AS indexed_at FROM oracle_documents GROUP BY id), i AS (SELECT id, 'imported' AS type FROM api_docs UNION ALL SELECT DISTINCT id, 'retyped' FROM oracle_documents WHERE type = 'retro')
    SELECT coalesce(o.id, i.id) AS id, coalesce(i.type, o.type) AS type, CASE WHEN i.id IS NOT NULL THEN {NOW} ELSE o.indexed_at END AS indexed_at FROM o FULL OUTER JOIN i ON o.id = i.id""")
def import_applied(t: Tables):
    """The table after an import that changes all retrospectives and adds another vault's records."""
    old = t.oracle_documents.groupBy("id").agg(F.min("type").alias("type"), F.max("indexed_at").alias("indexed_at"))
    come = t.api_docs.select("id", F.lit("imported").alias("type")).unionByName(t.oracle_documents.where("type = 'retro'").select("id", F.lit("retyped").alias("type")).distinct())
    state = old.select("id", F.lit("was").alias("hash"))
    plan = merge.import_plan(come.select("id", F.lit("is").alias("hash")), state)
    return merge.apply_plan(old, plan, come, NOW).select("id", "type", "indexed_at")


@query("""WITH s AS (SELECT id, max(source_file) AS path, 'old' AS hash FROM oracle_documents WHERE source_file IS NOT NULL GROUP BY id), d AS (SELECT id, max((source_file, md5(id))) AS r FROM (SELECT id, source_file FROM oracle_documents WHERE type = 'retro' UNION ALL SELECT id, source_file FROM api_docs) GROUP BY id)
    SELECT * FROM s WHERE id NOT IN (SELECT id FROM d) UNION ALL SELECT id, r[1], r[2] FROM d""")
def vault_state(t: Tables):
    """A vault's state after an import: imported records have new entries, all others stay."""
    prior = t.oracle_documents.where("source_file is not null").groupBy("id").agg(F.max("source_file").alias("path")).withColumn("hash", F.lit("old"))
    docs = t.oracle_documents.where("type = 'retro'").select("id", "source_file").unionByName(t.api_docs.select("id", "source_file"))
    return merge.merged_state(prior, docs.select("id", F.col("source_file").alias("path"), F.md5("id").alias("hash"))).select("id", "path", "hash")


@query(f"""WITH o AS (SELECT id, arg_max(coalesce({_CONCEPTS}, []), (indexed_at, coalesce(concepts, ''))) AS concepts FROM oracle_documents GROUP BY id)
    SELECT id, CASE WHEN id IN (SELECT id FROM oracle_documents WHERE type = 'retro') THEN ['a', 'b'] ELSE concepts END AS concepts FROM o""")
def doc_patched(t: Tables):
    """All retrospectives get other concepts, which are lower-cased and made distinct."""
    own = t.oracle_documents.withColumn("c", concept_list(F.col("concepts"))).groupBy("id").agg(F.max_by("c", F.struct("indexed_at", F.coalesce("concepts", F.lit("")))).alias("concepts"))
    patch = t.oracle_documents.where("type = 'retro'").select("id").distinct().withColumn("concepts", F.array(F.lit("A"), F.lit("b"), F.lit("a"), F.lit("")))
    return merge.patched(own, patch, NOW)


@query("SELECT id FROM (SELECT DISTINCT id FROM oracle_documents) WHERE id IN (SELECT id FROM oracle_documents WHERE type = 'retro')")
def doc_conflicts(t: Tables):
    """New records whose id is taken."""
    docs = t.oracle_documents.select("id", "type").distinct()
    return merge.inserted(docs, docs.where("type = 'retro'").unionByName(t.api_docs.select("id", "type")))[1]


@query("SELECT project AS key, 'new' AS value FROM (SELECT DISTINCT project FROM api_docs WHERE project IS NOT NULL) UNION ALL SELECT DISTINCT project, 'old' FROM oracle_documents WHERE project IS NOT NULL AND project NOT IN (SELECT project FROM api_docs WHERE project IS NOT NULL)")
def settings_written(t: Tables):
    values = lambda df, v: df.where("project is not null").select(F.col("project").alias("key"), F.lit(v).alias("value")).distinct()
    return merge.settings(values(t.oracle_documents, "old"), values(t.api_docs, "new"))


@query("""WITH o AS (SELECT source_file AS path, min(type) AS label, bool_or(created_by IS NULL) AS mine, max(superseded_at) AS touched FROM oracle_documents WHERE source_file IS NOT NULL GROUP BY 1), s AS (SELECT source_file AS path, max(type) AS label FROM oracle_documents WHERE source_file IS NOT NULL GROUP BY 1 UNION ALL SELECT 'new/' || id, type FROM api_docs)
    SELECT s.path, CASE WHEN o.path IS NULL THEN 'inserted' WHEN NOT mine OR touched IS NOT NULL THEN 'preserved' WHEN s.label <> o.label THEN 'updated' ELSE 'unchanged' END AS outcome FROM s LEFT JOIN o ON s.path = o.path""")
def seed_merge(t: Tables):
    """A seed over a table that people have changed in part."""
    d = t.oracle_documents.where("source_file is not null").groupBy(F.col("source_file").alias("path"))
    old = d.agg(F.min("type").alias("label"), F.when(F.bool_or(F.col("created_by").isNull()), "seed").otherwise("people").alias("source"), F.max("superseded_at").alias("touched_at"))
    seed = d.agg(F.max("type").alias("label")).unionByName(t.api_docs.select(F.concat(F.lit("new/"), "id").alias("path"), F.col("type").alias("label")))
    return merge.seeded(old, seed, ["path"], NOW)[1]


# files and text

_FILES = f"(SELECT source_file, id, type, project, created_at, coalesce({_CONCEPTS}, []) AS terms, indexed_at FROM oracle_documents WHERE source_file IS NOT NULL)"


@query(f"""SELECT file, id, type, (SELECT count(DISTINCT c) FROM (SELECT unnest(flatten(all_terms)) AS c)) AS concepts, chunk_ids FROM (SELECT source_file AS file, arg_min(id, (indexed_at, id)) AS id, arg_min(type, (indexed_at, id)) AS type, list(terms ORDER BY indexed_at, id) AS all_terms, list(id ORDER BY indexed_at, id) AS chunk_ids FROM {_FILES} GROUP BY 1)""")
def map_files(t: Tables):
    """Files with the concepts and ids of all their records."""
    d = t.oracle_documents.withColumn("concepts", concept_list(F.col("concepts")))
    return rel.files_of(d, "source_file", ["indexed_at", "id"]).select("file", "id", "type", F.size("concepts").cast("long").alias("concepts"), "chunk_ids")


@query("SELECT source_file AS file, max(indexed_at) AS indexed_at, list_sort(list(DISTINCT id)) AS ids FROM oracle_documents WHERE source_file IS NOT NULL GROUP BY 1")
def files_indexed(t: Tables):
    return rel.last_indexed(t.oracle_documents, "source_file")


@query(r"""SELECT path, replace(replace(regexp_replace(regexp_extract(path, '[^/]*$', 0), '\.[^.]*$', ''), '-', ' '), '_', ' ') AS title FROM documents WHERE path IS NOT NULL""")
def path_titles(t: Tables):
    return t.documents.where("path is not null").select("path", text.path_title(F.col("path")).alias("title"))


@query("SELECT doc_id, regexp_matches(coalesce(text, ''), '[฀-๿]') AS thai FROM documents")
def thai_texts(t: Tables):
    return t.documents.select("doc_id", text.has_thai(F.col("text")).alias("thai"))


_NOTES = "(SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'learned from github.com/Acme/Tool today' WHEN 1 THEN 'rrr: Acme/Tool' WHEN 2 THEN 'see https://github.com/acme/tool.git' WHEN 3 THEN 'acme/tool' ELSE NULL END AS note FROM documents)"


@query(f"SELECT doc_id, CASE doc_id % 5 WHEN 2 THEN 'github.com/acme/tool.git' WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE 'github.com/acme/tool' END AS project FROM {_NOTES}")
def project_from_source(t: Tables):
    ways = F.array(*map(F.lit, ("learned from github.com/Acme/Tool today", "rrr: Acme/Tool", "see https://github.com/acme/tool.git", "acme/tool", None)))
    return t.documents.select("doc_id", text.project_of_source(F.element_at(ways, (F.col("doc_id") % 5 + 1).cast("int"))).alias("project"))


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'github.com/a/' || doc_id WHEN 1 THEN 'github.com/a/' || doc_id WHEN 2 THEN 'github.com/a/' || doc_id WHEN 3 THEN 'github.com/a/' || doc_id ELSE NULL END AS project FROM documents""")
def project_spellings(t: Tables):
    """Projects as URL, path, short and full name; two are none."""
    n = F.col("doc_id").cast("string")
    ways = F.array(F.concat(F.lit("https://github.com/A/"), n, F.lit(".git")), F.concat(F.lit("/home/x/github.com/A/"), n, F.lit("/src")), F.concat(F.lit("A/"), n), F.concat(F.lit("github.com/a/"), n), F.lit("a/b/c"), F.lit("no project"))
    return t.documents.select("doc_id", text.normalized_project(F.element_at(ways, (F.col("doc_id") % 6 + 1).cast("int"))).alias("project"))


@query(r"""SELECT doc_id, CASE WHEN h = '' THEN NULL WHEN regexp_matches(h, '(?m)^project:[ \t]*\S') THEN regexp_replace(trim(regexp_extract(h, '(?m)^project:[ \t]*(\S.*)$', 1)), '^"(.*)"$', '\1')
    WHEN regexp_matches(h, '(?m)^source:[ \t]*rrr:[ \t]*\S*/') THEN 'github.com/' || trim(regexp_extract(h, '(?m)^source:[ \t]*rrr:[ \t]*(\S.*)$', 1)) END AS project FROM (SELECT doc_id, regexp_extract(text, '\A---\n([\s\S]*?)\n---', 1) AS h FROM documents WHERE text IS NOT NULL)""")
def project_of_front_matter(t: Tables):
    return t.documents.where("text is not null").select("doc_id", text.front_matter_project(F.col("text")).alias("project"))


@query(r"""SELECT CASE WHEN contains(path, '/resonance/') THEN 'principle' WHEN contains(path, '/learnings/') THEN 'learning' WHEN contains(path, '/retrospectives/') THEN 'retro' ELSE 'other' END AS type, count(*) AS n FROM documents GROUP BY 1""")
def scan_counts(t: Tables):
    return files.classified(t.documents.select("path"))[1]


@query("SELECT count(*) FILTER (event_id % 7 IN (0, 1)) AS added, count(*) FILTER (event_id % 7 IN (4, 5)) AS modified, count(*) FILTER (event_id % 7 = 3) AS deleted FROM events")
def change_status(t: Tables):
    """Short status lines of a repository, counted by kind."""
    ways = F.array(*map(F.lit, ("A  new.md", "?? other.md", "", " D gone.md", " M here.md", "R  a.md -> b.md", "!! x")))
    return files.change_counts(t.events.select(F.element_at(ways, (F.col("event_id") % 7 + 1).cast("int")).alias("value")))


@query("""SELECT id, CASE WHEN r.content IS NOT NULL THEN 'disk' WHEN d.content IS NOT NULL THEN 'index' END AS source, length(coalesce(r.content, d.content)) AS chars FROM (SELECT id, min(source_file) AS source_file, min(content) AS content FROM oracle_documents GROUP BY id) d
    LEFT JOIN (SELECT source_file, min(content) AS content FROM oracle_documents WHERE type = 'learning' GROUP BY 1) r ON r.source_file = d.source_file""")
def read_with_fallback(t: Tables):
    """Texts from files where they are, else from the index."""
    wanted = t.oracle_documents.groupBy("id").agg(F.min("source_file").alias("source_file"))
    disk = t.oracle_documents.where("type = 'learning'").select("source_file", "content")
    return files.with_content(wanted, ("disk", disk), ("index", t.oracle_documents.select("id", "content"))).select("id", "source", F.length("content").alias("chars"))


@query("SELECT doc_id, path FROM documents WHERE contains(regexp_extract(path, '[^/]*$', 0), '2025-03')")
def files_of_day(t: Tables):
    return files.of_day(t.documents.select("doc_id", "path"), "2025-03")


@query("""SELECT id, CASE WHEN starts_with(project, 'forge') THEN 0 WHEN starts_with(project, 'git') THEN 1 ELSE 2 END AS place FROM (SELECT DISTINCT id, lower(project) AS project FROM oracle_documents WHERE type IN ('learning', 'both') OR type IS NULL)""")
def view_order(t: Tables):
    """Records of one view in a fixed order of groups."""
    d = rel.in_view(t.oracle_documents, "learning", "type").select("id", F.lower("project").alias("project")).distinct()
    host = F.when(F.startswith("project", F.lit("forge")), "forge").when(F.startswith("project", F.lit("git")), "git")
    return d.select("id", rel.enum_order(F.coalesce(host, F.lit("")), ["forge", "git"]).alias("place"))


@query(r"""SELECT 'session-summary_' || s AS id, 'memory/session-summaries/' || s || '.md' AS source_file, length(pattern) AS chars, CASE WHEN w <> '' THEN 3 ELSE 2 END AS concepts FROM (SELECT substr(regexp_replace(input_id, '[^a-zA-Z0-9._-]', '-', 'g'), 1, 120) AS s,
    substr(regexp_replace(coalesce(source, ''), '[^a-zA-Z0-9._-]', '-', 'g'), 1, 80) AS w, pattern FROM learn_inputs) WHERE s <> ''""")
def session_summaries(t: Tables):
    rows = sinks.session_summaries(t.learn_inputs.select(F.col("input_id").alias("session_id"), F.col("pattern").alias("summary"), F.col("source").alias("who")))
    return rows.select("id", "source_file", F.length("content").alias("chars"), F.size("concepts").alias("concepts"))


@query(r"""WITH n AS (SELECT input_id, pattern, '2026-03-01_10-00-00_' || coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(substr(pattern, 1, 50)), '[^a-z0-9\s-]', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g'), ''), 'handoff') AS stem FROM (SELECT DISTINCT input_id, pattern FROM learn_inputs WHERE trim(pattern, ' ') <> ''))
    SELECT CASE WHEN rn = 1 THEN stem || '.md' ELSE stem || '-' || rn || '.md' END AS name, length(pattern) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY input_id, pattern) AS rn FROM n)""")
def handoff_files(t: Tables):
    """Handoff notes with names of their own: texts that begin alike are numbered."""
    notes = t.learn_inputs.select(F.struct("input_id", "pattern").alias("ord"), F.col("pattern").alias("content"), F.lit("").alias("slug")).distinct()
    return sinks.handoffs(notes, _empty(t, "name string"), "2026-03-01_10-00-00").select("name", F.length("content").alias("chars"))


@query("""SELECT source_file AS path, sha256(max(coalesce(content, ''))) AS hash FROM oracle_documents WHERE source_file IS NOT NULL GROUP BY 1 HAVING max(coalesce(content, '')) <> min(coalesce(content, ''))""")
def vault_changes(t: Tables):
    """Files whose text is another than at the last export."""
    d = t.oracle_documents.where("source_file is not null").groupBy(F.col("source_file").alias("path"))
    last = d.agg(F.sha2(F.min(F.coalesce("content", F.lit(""))), 256).alias("hash"))
    changed, _ = sinks.changed_files(d.agg(F.max(F.coalesce("content", F.lit(""))).alias("content")), last)
    return changed.select("path", F.sha2("content", 256).alias("hash"))


@query("SELECT id, direction, other FROM (SELECT DISTINCT d.id, 'forward' AS direction, d.superseded_by AS other FROM oracle_documents d WHERE d.superseded_by IN (SELECT id FROM oracle_documents) UNION ALL SELECT DISTINCT d.superseded_by, 'reverse', d.id FROM oracle_documents d WHERE d.superseded_by IN (SELECT id FROM oracle_documents))")
def supersede_hops(t: Tables):
    """One hop each way of every record that replaces another or is replaced."""
    return graph.one_hop(t.oracle_documents)


@query(f"""SELECT concept, n FROM (SELECT unnest(list_distinct(terms)) AS concept, count(*) AS n FROM (SELECT DISTINCT id, coalesce({_CONCEPTS}, []) AS terms FROM oracle_documents) GROUP BY 1) ORDER BY n DESC, concept LIMIT 30""")
def vault_top_concepts(t: Tables):
    d = t.oracle_documents.select("id", concept_list(F.col("concepts")).alias("terms")).distinct()
    return rel.top_counts(d.select(F.explode(F.array_distinct("terms")).alias("concept")), "concept", 30)


# what is left of projections, maps and evaluations

@query("SELECT count(DISTINCT user_id) AS active FROM (SELECT * FROM events ORDER BY ts DESC, event_id LIMIT 200) WHERE epoch_us(ts) >= (SELECT max(epoch_us(ts)) FROM events) - 3600000000")
def feed_active(t: Tables):
    """Identities active in the hour before the last event, on the feed's page of 200."""
    last = t.events.agg(F.max("ts").alias("last"))
    page = t.events.orderBy(F.desc("ts"), "event_id").limit(200).crossJoin(F.broadcast(last))
    return page.where(F.unix_micros(F.col("ts").cast("timestamp")) >= F.unix_micros(F.col("last").cast("timestamp")) - 3_600_000_000).agg(F.countDistinct("user_id").alias("active"))


@query(f"SELECT id FROM (SELECT DISTINCT id, coalesce({_CONCEPTS}, []) AS terms FROM oracle_documents) WHERE len(terms) > 0")
def docs_with_concepts(t: Tables):
    return t.oracle_documents.select("id", concept_list(F.col("concepts")).alias("terms")).distinct().where(F.size("terms") > 0).select("id")


@query("SELECT list_sort(list(type || '=' || n)) AS by_type FROM (SELECT type, count(*) AS n FROM oracle_documents WHERE type IS NOT NULL GROUP BY type)")
def stats_map(t: Tables):
    """Counts by type as one map, shown as sorted entries."""
    counts = rel.counts_by(t.oracle_documents.where("type is not null"), "type")
    entries = counts.agg(F.map_from_entries(F.collect_list(F.struct("type", "n"))).alias("m"))
    return entries.select(F.sort_array(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))).alias("by_type"))


@query("""SELECT model_key, id, list_sort(list_transform(list_filter(json_keys(metadata), lambda k: json_type(metadata, '$."' || k || '"') = 'VARCHAR'), lambda k: k || '=' || json_extract_string(metadata, '$."' || k || '"'))) AS fields
    FROM (SELECT DISTINCT model_key, id, metadata FROM vector_documents WHERE metadata IS NOT NULL)""")
def metadata_strings(t: Tables):
    """The string fields of every vector's metadata."""
    d = t.vector_documents.where("metadata is not null").select("model_key", "id", "metadata").distinct()
    return d.select("model_key", "id", F.sort_array(F.transform(F.map_entries(string_map(F.col("metadata"))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))).alias("fields"))


@query("SELECT model_key, count(*) AS n FROM vector_documents WHERE json_extract_string(metadata, '$.type') = 'learning' GROUP BY model_key")
def metadata_filter(t: Tables):
    return rel.counts_by(t.vector_documents.where(metadata_is(F.col("metadata"), type="learning")), "model_key")


@query("SELECT DISTINCT id, strftime(make_timestamp(created_at * 1000) + INTERVAL 7 HOUR, '%Y-%m-%d') AS local_day, strftime(make_timestamp(created_at * 1000), '%Y-%m-%d') AS utc_day FROM oracle_documents")
def local_days(t: Tables):
    d = t.oracle_documents.select("id", "created_at").distinct()
    return d.select("id", dates.day_of(F.col("created_at"), "Asia/Bangkok").alias("local_day"), dates.day_of(F.col("created_at")).alias("utc_day")).distinct()


@query(f"""WITH p AS (SELECT old_id, min((new_id, reason)) AS p FROM supersede_log WHERE old_id <> new_id AND old_id IN (SELECT id FROM oracle_documents) AND new_id IN (SELECT id FROM oracle_documents) GROUP BY old_id)
    SELECT d.id, CASE WHEN p.old_id IS NOT NULL THEN p.p[1] ELSE d.superseded_by END AS superseded_by, CASE WHEN p.old_id IS NOT NULL THEN {NOW} ELSE d.superseded_at END AS superseded_at FROM (SELECT DISTINCT id, superseded_by, superseded_at, superseded_reason FROM oracle_documents) d LEFT JOIN p ON p.old_id = d.id""")
def supersede_written(t: Tables):
    """All pairs of the log written to the records they name exactly."""
    docs = t.oracle_documents.select("id", "superseded_by", "superseded_at", "superseded_reason").distinct()
    return merge.superseded(docs, t.supersede_log.select("old_id", "new_id", "reason"), NOW)[0].select("id", "superseded_by", "superseded_at")


@query(r"""WITH d AS (SELECT DISTINCT id, content FROM oracle_documents WHERE coalesce(project, '') = '') SELECT id, lower('github.com/' || min(regexp_extract(content, 'github\.com/([^/\s]+/[^/\s]+)', 1))) AS project, 'index' AS found_in FROM d WHERE regexp_matches(content, 'github\.com/[^/\s]+/[^/\s]+') GROUP BY id""")
def projects_repaired(t: Tables):
    """Projects found in the texts of records without one."""
    return merge.repaired_projects(t.oracle_documents.select("id", "source_file", "content", "project"), _empty(t, "source_file string, content string"))


_SIM = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"


@query(f"""WITH r AS (SELECT a.vec_id AS q, b.vec_id AS hit, a.label = b.label AS expected, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_SIM} DESC, b.vec_id) AS rn FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
    e AS (SELECT q, max(CAST(rn <= 1 AND expected AS INT)) AS one, max(CAST(rn <= 5 AND expected AS INT)) AS five, max(CAST(rn <= 3 AND coalesce(x.lang <> y.lang, false) AS INT)) AS cr FROM r LEFT JOIN documents x ON x.doc_id = q LEFT JOIN documents y ON y.doc_id = hit GROUP BY q)
    SELECT count(*) AS queries, round(avg(one), 4) AS recall_1, round(avg(five), 4) AS recall_5, round(avg(cr), 4) AS cross_language_3 FROM e""")
def retrieval_eval(t: Tables):
    """Recall at 1 and 5, and hits in another language among the first three."""
    e = t.embeddings
    links = search.similar_links(e, "vec_id", "embedding", e.where("vec_id % 20 = 0"), threshold=-2.0, most=5)
    ranked = links.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other")))
    side = lambda name, label: e.join(t.documents.select(F.col("doc_id").alias("vec_id"), "lang"), "vec_id", "left").select(F.col("vec_id").alias(name), F.col("label").alias(label), F.col("lang").alias(f"{label}_lang"))
    judged = ranked.join(side("id", "x"), "id").join(side("other", "y"), "other")
    return search.retrieval_scores(judged.select(F.col("id").alias("query"), "rank", (F.col("x") == F.col("y")).alias("expected"), F.coalesce(F.col("x_lang") != F.col("y_lang"), F.lit(False)).alias("other_language")))


@query("""SELECT type || '/_index.md' AS path, count(*) AS lines FROM (SELECT DISTINCT id, min(type) AS type FROM oracle_documents WHERE id IS NOT NULL GROUP BY id) WHERE type IS NOT NULL GROUP BY type""")
def vault_export(t: Tables):
    """The index files of a whole vault, with the number of records each lists."""
    d = t.oracle_documents.where("id is not null").groupBy("id").agg(F.min("type").alias("type"), F.min("content").alias("content"), F.min("project").alias("project"), F.min("created_at").alias("created_at"), F.min("concepts").alias("c"))
    d = d.where("type is not null").select("id", "type", F.col("id").alias("title"), "content", concept_list(F.col("c")).alias("concepts"), "project", "created_at")
    out = exports.vault_files(d, _empty(t, "id string, other string, score double")).where(F.endswith("path", F.lit("/_index.md")))
    return out.select("path", (F.size(F.split("content", "\n")) - 1).cast("long").alias("lines"))


# text functions and parsers over whole tables

_SOME = "(SELECT doc_id, text FROM documents WHERE text IS NOT NULL)"


def _texts(t: Tables) -> DataFrame:
    return t.documents.where("text is not null")


@query(rf"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '<[^>]*>', '', 'g'), '[\x00-\x1f]', '', 'g'), ' ') AS q FROM {_SOME}")
def sanitize_route(t: Tables):
    return _texts(t).select("doc_id", text.sanitize_param(F.col("text")).alias("q"))


@query(rf"SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(regexp_replace(regexp_replace(text, '```[\s\S]*?```', '', 'g'), '`[^`]*`', '', 'g'), '(?i)(?:^|\s)#([a-z0-9][a-z0-9_\-/]*)', 1), lambda x: lower(x)))) AS tags FROM {_SOME}")
def body_hashtags(t: Tables):
    return _texts(t).select("doc_id", F.array_sort(text.hashtags(F.col("text"))).alias("tags"))


@query(rf"SELECT doc_id, regexp_replace(text, '\A\s*#\s+.+?\s*(?:\r?\n|\z)', '') AS body FROM {_SOME}")
def body_without_title(t: Tables):
    return _texts(t).select("doc_id", text.without_leading_heading(F.col("text")).alias("body"))


@query("SELECT DISTINCT id, lower('gitlab.com/' || split_part(project, '/', 2) || '/' || split_part(project, '/', 3)) AS hosted, lower(project) AS nested FROM oracle_documents WHERE regexp_matches(project, '^[^/]+/[^/]+/[^/]+$')")
def path_projects(t: Tables):
    """Projects of paths: of a known host, or below the code folder."""
    d = t.oracle_documents.where(F.col("project").rlike("^[^/]+/[^/]+/[^/]+$"))
    part = lambda i: F.get(F.split("project", "/"), F.lit(i))
    hosted = F.concat(F.lit("/srv/gitlab.com/"), part(1), F.lit("/"), part(2), F.lit("/src/a.md"))
    return d.select("id", markup.inferred_project(hosted).alias("hosted"), markup.inferred_project(F.concat(F.lit("/home/Code/"), "project", F.lit("/x"))).alias("nested")).distinct()


@query(rf"""SELECT doc_id, CASE WHEN NOT regexp_matches(text, '\A---\n[\s\S]*?\n---') THEN '---' || chr(10) || 'project: o/r' || chr(10) || '---' || chr(10) || chr(10) || text WHEN regexp_matches(regexp_extract(text, '\A---\n([\s\S]*?)\n---', 1), '(?m)^project:\s') THEN text
    ELSE regexp_replace(text, '\A---\n([\s\S]*?)\n---', '---' || chr(10) || '\1' || chr(10) || 'project: o/r' || chr(10) || '---') END AS body FROM {_SOME}""")
def project_ensured(t: Tables):
    return _texts(t).select("doc_id", markup.with_project(F.col("text"), F.lit("o/r")).alias("body"))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(path, '^[A-Za-z0-9_./-]+( [A-Za-z0-9_./-]+)*$') AND NOT regexp_matches(path, '^[0-9.+-]+$') THEN path ELSE '"' || path || '"' END AS path, CASE WHEN regexp_matches(source, '^[A-Za-z0-9_./-]+( [A-Za-z0-9_./-]+)*$') THEN source ELSE '"' || source || '"' END AS source FROM documents WHERE path IS NOT NULL AND source IS NOT NULL""")
def yaml_values(t: Tables):
    d = t.documents.where("path is not null and source is not null")
    return d.select("doc_id", text.yaml_scalar(F.col("path")).alias("path"), text.yaml_scalar(F.col("source")).alias("source"))


@query("SELECT input_id, CASE WHEN created_at % 2 = 0 THEN 'user' ELSE coalesce(nullif(source, ''), 'claude') END || CASE WHEN coalesce(project, '') <> '' THEN '@' || project ELSE '' END AS author FROM learn_inputs")
def author_labels(t: Tables):
    role = F.when(F.col("created_at") % 2 == 0, "human").otherwise("claude")
    return t.learn_inputs.select("input_id", threads.author_label(role, F.col("source"), F.col("project")).alias("author"))


@query("SELECT DISTINCT substr(regexp_replace(path, '[^a-zA-Z0-9._-]', '-', 'g'), 1, 120) AS safe FROM documents WHERE path IS NOT NULL")
def safe_ids(t: Tables):
    return t.documents.where("path is not null").select(text.safe_id(F.col("path")).alias("safe")).distinct()


@query("SELECT doc_id, strftime(created_at, '%Y-%m-%dT%H:%M:00') AS at_ FROM documents")
def file_times(t: Tables):
    name = F.concat(F.date_format("created_at", "yyyy-MM-dd_HH-mm"), F.lit("_note.md"))
    return t.documents.select("doc_id", dates.file_timestamp(name).alias("at_"))


@query("SELECT id, array_to_string(list_filter(concepts, lambda x: x IS NOT NULL), ' ') AS joined, concepts[1:5] AS first_five, len(list_intersect(list_distinct(list_transform(concepts, lambda x: lower(x))), ['git', 'search', 'memory', 'index'])) AS shared FROM api_docs WHERE concepts IS NOT NULL")
def concept_arrays(t: Tables):
    """Concepts joined for the index, cut for a view, and shared with a list."""
    d = t.api_docs.where("concepts is not null")
    wanted = F.array(*map(F.lit, ("git", "search", "memory", "index")))
    return d.select("id", F.array_join("concepts", " ").alias("joined"), F.slice("concepts", 1, 5).alias("first_five"), F.size(F.array_intersect(F.transform("concepts", F.lower), wanted)).cast("long").alias("shared"))


_BODY = r"regexp_replace(regexp_replace(s, '^[^\n]*\n', ''), '^\s+|\s+$', '', 'g')"


def _cut(marker: str) -> str:
    return rf"""(SELECT doc_id, i - 1 AS place, regexp_replace(split_part(s, chr(10), 1), '^\s+|\s+$', '', 'g') AS title, CASE WHEN contains(s, chr(10)) THEN {_BODY} ELSE '' END AS body FROM (
        SELECT doc_id, unnest(range(1, len(ss) + 1)) AS i, unnest(ss) AS s FROM (SELECT doc_id, list_filter(string_split_regex(text, '(?m)^{marker}\s+'), lambda x: trim(x, ' ') <> '') AS ss FROM documents WHERE text IS NOT NULL)))"""


@query(rf"""WITH s AS (SELECT * FROM {_cut('###')} WHERE body <> ''), b AS (SELECT doc_id, place, title, unnest(range(0, len(items))) AS j, unnest(items) AS item FROM (SELECT doc_id, place, title, regexp_extract_all(body, '(?m)^[-*]\s+([^\r\n]+)\r?$', 1) AS items FROM s))
    SELECT concat_ws('_', 'resonance', CAST(doc_id AS VARCHAR), CAST(place AS VARCHAR)) AS id, 'principle' AS type, title || ': ' || body AS content FROM s UNION ALL SELECT concat_ws('_', 'resonance', CAST(doc_id AS VARCHAR), CAST(place AS VARCHAR), 'sub', CAST(j AS VARCHAR)), 'principle', title || ': ' || item FROM b""")
def parse_principles(t: Tables):
    """Sections of level three and their list items as records."""
    return ingest.principles(_texts(t).select(F.col("doc_id").cast("string").alias("doc_id"), "text"), "doc_id", "text")


@query(rf"""WITH s AS (SELECT * FROM {_cut('##')} WHERE body <> '' AND place > 0) SELECT concat_ws('_', 'learning', CAST(doc_id AS VARCHAR), CAST(place AS VARCHAR)) AS id, 'learning' AS type, 'T - ' || title || ': ' || body AS content FROM s
    UNION ALL SELECT concat_ws('_', 'learning', CAST(doc_id AS VARCHAR)), 'learning', text FROM documents WHERE trim(text, ' ') <> '' AND doc_id NOT IN (SELECT doc_id FROM s)""")
def parse_learnings(t: Tables):
    """Sections of level two as records, or the whole text where there is none."""
    return ingest.learnings(_texts(t).select(F.col("doc_id").cast("string").alias("doc_id"), "text"), "doc_id", "text", F.lit("T"))


@query("SELECT doc_id, list_sort(list_distinct(list_concat(list_filter([" + ", ".join(f"'{k}'" for k in text.KEYWORDS) + r"], lambda k: contains(lower(text), k)), list_filter(list_transform(string_split(regexp_extract(regexp_extract(text, '\A---\r?\n([\s\S]*?)\r?\n---', 1), '(?m)^tags:[ \t]*\[?([^\]\r\n]*)', 1), ','), lambda x: lower(trim(x))), lambda x: x <> '')))) AS concepts FROM documents WHERE text IS NOT NULL")
def concepts_merged(t: Tables):
    """Keywords of a text and tags of its front matter together."""
    return ingest.with_concepts(_texts(t).select("doc_id", "text"), "text", F.col("text")).select("doc_id", F.array_sort("concepts").alias("concepts"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, 'u' || user_id AS oracle, event_type AS event, 's' || event_id AS session_id, props AS message FROM events""")
def feed_files(t: Tables):
    """Events appended to feed files and read from them."""
    e = t.events.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"), F.concat(F.lit("u"), "user_id").alias("who"), F.lit("local").alias("host"), "event_type", F.lit("p").alias("project"), F.concat(F.lit("s"), "event_id").alias("session"), "props")
    folder = new_folder(t.spark, "feed")
    sinks.append_feed(e.select(sinks.feed_line("time", "who", "host", "event_type", "project", "session", "props").alias("line")), folder)
    return files.feed(t.spark, folder).select(F.substring("session_id", 2, 20).cast("long").alias("event_id"), "timestamp", "oracle", "event", "session_id", "message")


@query("SELECT count(*) AS documents, (SELECT count(*) FROM oracle_documents) AS in_envelope, count(DISTINCT id) AS ids FROM oracle_documents")
def export_json(t: Tables):
    """All records exported as JSON, and read again with their envelope."""
    folder = new_folder(t.spark, "export")
    sinks.json_export(t.oracle_documents, folder, "2026-03-01T00:00:00Z")
    back = t.spark.read.schema("id string").json(f"{folder}/documents").agg(F.count("*").alias("documents"), F.countDistinct("id").alias("ids"))
    return back.crossJoin(t.spark.read.schema("count long").json(f"{folder}/envelope").select(F.col("count").alias("in_envelope"))).select("documents", "in_envelope", "ids")


@query("SELECT DISTINCT model_key, id FROM vector_documents WHERE lower(trim(id)) <> ''")
def collection_written(t: Tables):
    """Vectors written to a model's collection twice: no id is there more than once."""
    from siltstone.operators.collections import Collection

    rows = t.vector_documents.where(F.trim("id") != "").groupBy("model_key", "id").agg(F.first("vector").alias("vector"))
    c = Collection(t.spark, new_folder(t.spark, "vectors"), "all")
    c.add(rows)
    c.add(rows)
    return c.rows().select("model_key", "id")
