"""State that people and tools write: traces, threads, logs, appointments, jobs, imports, index runs, files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from siltstone import storage
from siltstone.functions import markup
from siltstone.operators import indexing, logs, merge, queue, relational as rel, schedule, threads, traces
from siltstone.sources import files, sinks


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_traces(spark):
    empty = spark.createDataFrame([], traces.SCHEMA)
    one = traces.created(empty, spark.createDataFrame([("r", "root", ["f"], ["c1", "c2"])], "trace_id string, query string, found_files array<string>, found_commits array<string>"), 1)
    two = traces.created(one, spark.createDataFrame([("k", "kid", "r"), ("l", "lost", "nowhere")], "trace_id string, query string, parent_trace_id string"), 2)
    got = {r["trace_id"]: r for r in two.collect()}
    assert (got["r"]["file_count"], got["r"]["commit_count"], got["r"]["child_trace_ids"], got["r"]["updated_at"]) == (1, 2, ["k"], 2)
    assert got["k"]["depth"] == 1 and got["l"]["depth"] == 0 and got["k"]["scope"] == "project" and got["k"]["agent_count"] == 1
    links = spark.createDataFrame([("r", "k"), ("k", "l"), ("k", "r"), ("r", "gone")], "prev_id string, next_id string")
    table, outcome = traces.linked(two, links.where("next_id in ('k', 'l')"), 3)
    assert rows(outcome) == [("k", "l", "linked"), ("r", "k", "linked")]
    assert rows(traces.linked(table, links, 4)[1]) == [("k", "l", "taken"), ("k", "r", "taken"), ("r", "gone", "missing"), ("r", "k", "taken")]
    cut = traces.unlinked(table, spark.createDataFrame([("k",)], "trace_id string"), "prev", 5)
    assert rows(cut.select("trace_id", "prev_trace_id", "next_trace_id")) == [("k", None, "l"), ("l", "k", None), ("r", None, None)]
    told = traces.distilled(table, spark.createDataFrame([("k", "aha")], "trace_id string, awakening string"), 6)
    report = traces.chain_report(told, spark.createDataFrame([("k",), ("r",)], "id string"))
    assert rows(report) == [("k", ["r", "k"], 1, True, "k"), ("r", ["r", "k"], 1, True, "k")]
    page, more = traces.listed(told, limit=2)
    assert [r["trace_id"] for r in page.collect()] == ["k", "l"] and tuple(more.first()) == (3, True)


def test_threads(spark):
    t = spark.createDataFrame([], "id long, title string, created_by string, status string, project string, created_at long, updated_at long")
    m = spark.createDataFrame([], "thread_id long, role string, content string, author string, created_at long")
    new = spark.createDataFrame([(None, "human", "x" * 60, None), (None, "oracle", "hello", "o/r"), (9, "human", "lost", None)], "thread_id long, role string, content string, project string")
    t, m, lost = threads.posted(t, m, new, 5)
    assert rows(t.select("id", "title", "created_by", "status")) == [(1, "hello", "claude@o/r", "active"), (2, "x" * 50 + "...", "user", "pending")] and rows(lost) == [(9, "human", "lost")]
    t, m, _ = threads.posted(t, m, spark.createDataFrame([(1, "claude", "again", "opus")], "thread_id long, role string, content string, model string"), 7)
    assert rows(threads.overview(t, m)) == [(1, "hello", "pending", 2, "again", 7), (2, "x" * 50 + "...", "pending", 1, "x" * 60, 5)]
    assert threads.with_status(t, spark.createDataFrame([(2, "closed")], "id long, status string"), 8).where("status = 'closed' and updated_at = 8").count() == 1
    assert [r["content"] for r in threads.full_thread(t, m, spark.createDataFrame([(1,)], "id long")).collect()] == ["hello", "again"]


def test_logs(spark):
    searches = spark.createDataFrame([(1, "q", "all", "fts", 9, ""), (2, "r", "all", "fts", 4, "p")], "search_id int, query string, type string, mode string, search_time_ms long, project string")
    hits = spark.createDataFrame([(1, i, f"d{i}", "learning", 1.0 / i, "y" * 150) for i in range(1, 8)], "search_id int, rank int, id string, type string, score double, content string")
    got = {r["search_id"]: r for r in logs.search_rows(searches, hits, 5).collect()}
    top = json.loads(got[1]["results"])
    assert got[1]["results_count"] == 7 and [x["id"] for x in top] == [f"d{i}" for i in range(1, 6)] and len(top[0]["snippet"]) == 100
    assert got[2]["results"] is None and got[2]["results_count"] == 0 and got[1]["project"] is None
    log = logs.search_rows(searches, hits, 5)
    assert tuple(logs.search_totals(log).first()) == (2, 6.5, 7) and tuple(logs.search_totals(log.limit(0)).first()) == (0, None, 0)
    learned = spark.createDataFrame([("a", "p" * 200, None, ["x"], None)], "id string, pattern string, source string, concepts array<string>, project string")
    assert tuple(logs.learn_rows(learned, 3).first())[:4] == ("a", "p" * 100, "learn", '["x"]')
    assert tuple(rel.source_mix(spark.createDataFrame([("fts",), ("hybrid",), ("fts",)], "source string")).first()) == (2, 0, 1)


def test_schedule(spark):
    new = [(1, "5 Mar", "b", "9:00", None), (2, "2026-03-05", "a", None, "weekly"), (3, "1/5/2026", "far", None, None), (4, " ", "none", None, None)]
    t = schedule.added(spark.createDataFrame([], schedule.SCHEMA), spark.createDataFrame(new, "id long, date string, event string, time string, recurring string"), "2026-03-01", 1)
    assert [r["id"] for r in schedule.listed(t, "2026-03-01").collect()] == [2, 1]
    assert [r["id"] for r in schedule.listed(t, "2026-03-01", day="1 May").collect()] == [3] and schedule.listed(t, "2026-03-01", word="B").count() == 1
    done = schedule.changed(t, spark.createDataFrame([(1, "done")], "id long, status string"), 2)
    assert [r["id"] for r in schedule.listed(done, "2026-03-01").collect()] == [2] and done.where("updated_at = 2").count() == 1
    text = dict(rows(schedule.markdown(t)))
    assert text["2026-03"].startswith("## March 2026\n") and "| 2026-03-05 | TBD | a (weekly) |  |\n| 5 Mar | 9:00 | b |" in text["2026-03"] and "| weekly | TBD | a |" in text["recurring"]


def test_job_transitions(spark):
    jobs = spark.createDataFrame([("1", "m", "d1", "claimed", 1, 5, None, "old"), ("2", "m", "d2", "pending", 0, None, None, None), ("3", "n", "gone", "done", 1, 5, 6, None)], "id string, model_key string, doc_id string, status string, attempts int, claimed_at long, finished_at long, error string")
    ids = spark.createDataFrame([("1",), ("2",), ("3",)], "id string")
    done = queue.finished(jobs, spark.createDataFrame([("1", None)], "id string, error string"), 9)
    assert rows(done.where("id = '1'").select("status", "finished_at", "error", "attempts")) == [("done", 9, None, 1)]
    failed = queue.finished(jobs, spark.createDataFrame([("1", "bad")], "id string, error string"), 9)
    assert rows(failed.where("id = '1'").select("status", "error")) == [("error", "bad")] and failed.count() == 3
    assert rows(queue.reclaimed(jobs, ids).select("id", "status", "claimed_at")) == [("1", "pending", None), ("2", "pending", None), ("3", "done", 5)]
    assert rows(queue.cancelled(jobs, ids).select("id")) == [("1",), ("3",)]
    worked = queue.worked(jobs, spark.createDataFrame([("d1", "text"), ("d2", None)], "doc_id string, text string"), spark.createDataFrame([("2", "bad"), ("3", "bad")], "id string, error string"))
    assert rows(worked.select("id", "event", "error")) == [("1", "done", None), ("2", "error", "bad"), ("3", "doc_missing", None)]
    state = spark.createDataFrame([("a", True, 50, 100, 0, None), ("b", False, 9, 9, 0, None), ("c", False, 0, 9, None, None), ("d", True, 1, 2, 0, "x")], "id string, is_indexing boolean, progress_current long, progress_total long, started_at long, error string")
    assert rows(queue.progress(state, 10_000).select("id", "status", "docs_per_second", "eta")) == [("a", "indexing", 5.0, 10), ("b", "completed", 0.9, 0), ("c", "idle", 0.0, 0), ("d", "error", 0.1, 10)]
    row = spark.createDataFrame([(1, False, 0, 0, None, 7, None)], "id int, is_indexing boolean, progress_current int, progress_total int, started_at long, completed_at long, error string")
    running = queue.status_row(row, True, 1, 9, 100)
    assert tuple(running.first()) == (1, True, 1, 9, 100, None, None) and tuple(queue.status_row(running, False, 9, 9, 200).first()) == (1, False, 9, 9, 100, 200, None)


def test_index_run_and_its_guards(spark):
    schema = "id string, source_file string, content string, created_at long, created_by string, indexed_at long"
    old = spark.createDataFrame([("a", "a.md", "x", 1, "indexer", 1), ("b", "b.md", "y", 2, None, 1), ("c", "gone.md", "z", 3, "indexer", 1), ("p", "gone2.md", "w", 4, "people", 1)], schema)
    new = spark.createDataFrame([("a", "a.md", "x2", 99, "indexer"), ("n", "n.md", "new", 99, "indexer")], "id string, source_file string, content string, created_at long, created_by string")
    disk = spark.createDataFrame([("a.md",), ("b.md",), ("n.md",)], "source_file string")
    out = indexing.run(old, new, disk, 50)
    assert rows(out.select("id", "content", "created_at", "indexed_at")) == [("a", "x2", 1, 50), ("b", "y", 2, 1), ("n", "new", 99, 50), ("p", "w", 4, 1)]
    for kwargs in ({"source_exists": False}, {"records": new.limit(0)}, {"files": disk.where("source_file = 'a.md'")}):
        with pytest.raises(indexing.Refused):
            indexing.run(old, **({"records": new, "files": disk} | kwargs), now=50)
    assert indexing.run(old, new, disk.where("source_file = 'a.md'"), 50, force=True).count() == 3
    lost = spark.createDataFrame([("1", "x/n.md", "t"), ("2", "y/z.md", "t"), ("3", "y/e.md", " "), ("4", "here.md", "t")], "id string, source_file string, content string")
    found = indexing.recovery(lost, spark.createDataFrame([("here.md",)], "source_file string"), spark.createDataFrame([("b/n.md",), ("a/n.md",)], "path string"))
    assert rows(found) == [("1", "copy", "a/n.md"), ("2", "regenerate", None), ("3", "unrecoverable", None)]
    root, project = (spark.createDataFrame(x, "path string, content string") for x in ([("r1", "same"), ("r2", "same")], [("p1", "same"), ("p2", "same"), ("p3", "other")]))
    assert rows(indexing.collected(root, project, "content", ["path"]).select("path")) == [("p1",), ("p3",), ("r1",), ("r2",)]


def test_imports(spark):
    docs = spark.createDataFrame([("a", "t", ["x"], 1), ("b", "u", ["y"], 1)], "id string, content string, concepts array<string>, updated_at long")
    plan = spark.createDataFrame([("a", "update"), ("c", "create"), ("b", "tombstone"), (None, "skip-no-id")], "id string, action string")
    come = spark.createDataFrame([("a", "t2", ["Z", "z"]), ("c", "new", None), ("b", "never", None)], "id string, content string, concepts array<string>")
    assert rows(merge.apply_plan(docs, plan, come, 9)) == [("a", "t2", ["z"], 9), ("b", "u", ["y"], 1), ("c", "new", None, 9)]
    state = spark.createDataFrame([("a", "p", "1"), ("b", "q", "2")], "id string, path string, hash string")
    assert rows(merge.merged_state(state, spark.createDataFrame([("a", "p2", "9"), (None, "z", "0")], "id string, path string, hash string"))) == [("a", "p2", "9"), ("b", "q", "2")]
    seed = spark.createDataFrame([("/a", "A2"), ("/b", "B2"), ("/c", "C"), ("/d", "D")], "path string, label string")
    old = spark.createDataFrame([("/a", "A", "seed", None, 1), ("/b", "B", "seed", 5, 1), ("/d", "D", "seed", None, 1), ("/z", "Z", "people", None, 1)], "path string, label string, source string, touched_at long, updated_at long")
    table, outcome = merge.seeded(old, seed, ["path"], 7)
    assert rows(outcome) == [("/a", "updated"), ("/b", "preserved"), ("/c", "inserted"), ("/d", "unchanged")]
    assert rows(table.select("path", "label", "updated_at")) == [("/a", "A2", 7), ("/b", "B", 1), ("/c", "C", 7), ("/d", "D", 1), ("/z", "Z", 1)]
    assert rows(merge.settings(spark.createDataFrame([("k", "1"), ("l", "2")], "key string, value string"), spark.createDataFrame([("k", "3")], "key string, value string"))) == [("k", "3"), ("l", "2")]


def test_files(spark, tmp_path):
    status = spark.createDataFrame([("A  a",), ("?? b",), (" M c",), ("R  d -> e",), (" D f",), ("",), ("!! g",)], "value string")
    assert tuple(files.change_counts(status).first()) == (2, 2, 1)
    paths = spark.createDataFrame([("github.com/O/r/ψ/memory/x.md",), ("ψ/memory/learnings/gitlab.com/a/B/y.md",), ("ψ/other/z.md",)], "path string")
    assert [r[0] for r in paths.select(files.project_of_path(F.col("path"))).collect()] == ["github.com/o/r", "gitlab.com/a/b", None]
    assert files.project_folders("/v/")[0] == "/v/github.com/*/*/ψ"
    wanted = spark.createDataFrame([("1", "a.md"), ("2", "../b.md"), ("3", "c.md")], "id string, source_file string")
    disk = spark.createDataFrame([("a.md", "A"), ("../b.md", "secret")], "source_file string, content string")
    kept = spark.createDataFrame([("1", "old"), ("2", "B")], "id string, content string")
    assert rows(files.with_content(wanted, ("disk", disk), ("index", kept))) == [("1", "a.md", "A", "disk"), ("2", "../b.md", "B", "index"), ("3", "c.md", None, None)]
    assert files.or_empty(lambda: spark.read.parquet(str(tmp_path / "nowhere")), spark, "x int").count() == 0
    taken = spark.createDataFrame([("n.md",), ("n-2.md",)], "name string")
    free = sinks.free_name(taken, spark.createDataFrame([("n.md", 1), ("n.md", 2), ("m.md", 1), ("m.md", 2)], "name string, ord int"))
    assert rows(free) == [("m.md", 1, "m.md"), ("m.md", 2, "m-2.md"), ("n.md", 1, "n-3.md"), ("n.md", 2, "n-4.md")]
    out = spark.createDataFrame([("a/x.md", "one"), ("y.md", "two")], "path string, content string")
    changed, state = sinks.changed_files(out, spark.createDataFrame([], "path string, hash string"))
    assert sinks.write_files(changed, str(tmp_path / "vault")) == 2 and (tmp_path / "vault/a/x.md").read_text() == "one"
    assert rows(sinks.changed_files(out.withColumn("content", F.when(F.col("path") == "y.md", "three").otherwise(F.col("content"))), state)[0]) == [("y.md", "three")]
    assert sinks.json_export(out, str(tmp_path / "export"), "2026-03-01") == 2 and spark.read.json(str(tmp_path / "export/envelope")).first()["count"] == 2
    sinks.append_feed(spark.createDataFrame([("t | o | h | e | p | s » m",)], "line string"), str(tmp_path / "feed"))
    sinks.append_feed(spark.createDataFrame([("t | o | h | e | p | s",)], "line string"), str(tmp_path / "feed"))
    assert rows(files.feed(spark, str(tmp_path / "feed")).select("session_id", "message")) == [("s", ""), ("s", "m")]
    summary = sinks.session_summaries(spark.createDataFrame([("a b", "text", "w/x"), ("", "none", None)], "session_id string, summary string, who string"))
    assert rows(summary.select("id", "concepts")) == [("session-summary_a-b", ["session-summary", "session-a-b", "oracle-w-x"])]
    typed = spark.createDataFrame([("---\na: 1\nb: [x, \"y, z\"]\nc: true\nd: ~\ne: 'it''s'\nf: 1.5\n# no: no\n---\nrest",), ("none",)], "c string").select(markup.front_matter_json(F.col("c"))).collect()
    assert json.loads(typed[0][0]) == {"a": 1, "b": ["x", "y, z"], "c": True, "d": None, "e": "it's", "f": 1.5} and typed[1][0] is None


def test_views_and_paging(spark):
    d = spark.createDataFrame([("a", "x"), ("b", "both"), ("c", None), ("d", "y")], "id string, scope string")
    assert rows(rel.in_view(d, "x").select("id")) == [("a",), ("b",), ("c",)] and rel.in_view(d, "both").count() == 4
    assert [r["id"] for r in d.orderBy(rel.enum_order(F.col("scope"), ["y", "x"]), "id").collect()] == ["d", "a", "b", "c"]
    assert rel.clamped(None, 10, 1, 100) == 10 and rel.clamped(500, 10, 1, 100) == 100 and rel.clamped(-3, 10, 1, 100) == 1
    assert rel.in_scope(d, "X", "scope", lowered=True).count() == 2
    f = spark.createDataFrame([("f", "2", "t", None, 2, ["b", "a"]), ("f", "1", "t", None, 1, ["a"]), (None, "3", "t", None, 3, None)], "file string, id string, type string, project string, created_at long, concepts array<string>")
    assert rows(rel.files_of(f, "file", ["created_at", "id"])) == [("f", "1", "t", None, 1, ["a", "b"], ["1", "2"])]


def test_stored_tables_go_with_their_workspace(spark):
    with storage.workspace():
        kept = storage.stored(spark.range(3))
        path = storage._made[-1][1]
        assert kept.count() == 3
    assert all(p != path for _, p in storage._made)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path).count()


def test_collections(spark, tmp_path):
    from siltstone.operators.collections import Collection, health

    c = Collection(spark, f"file://{tmp_path}/vectors", "small")
    assert tuple(c.stats().first()) == ("small", False, 0, None) and health([c]).first()["status"] == "down"
    c.ensure()
    c.add(spark.createDataFrame([("small", "a", [1.0, 0.0]), ("small", "b", [0.6, 0.8])], c.SCHEMA))
    c.add(spark.createDataFrame([("small", "a", [0.0, 1.0])], c.SCHEMA))
    assert tuple(c.stats().first()) == ("small", True, 2, 2) and [r["id"] for r in c.query([0.0, 1.0], 5).collect()] == ["a", "b"] and [r["id"] for r in c.query_by_id("a", 5).collect()] == ["b"]
    assert health([c, Collection(spark, f"file://{tmp_path}/vectors", "large")]).first()["status"] == "degraded"
    c.delete()
    assert not c.exists()


def test_stream_control(spark, tmp_path):
    from siltstone.streaming import control

    told = []
    events = control.Events(lambda kind, fields: told.append(kind))
    spark.streams.addListener(events)
    query = spark.readStream.format("rate").option("rowsPerSecond", 5).load().writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    assert control.stopped(query) and not query.isActive
    spark.streams.removeListener(events)
    assert "started" in told
    now, made = [0.0], []
    kept = control.Kept(lambda: made.append(1) or spark.range(2), 60, lambda: now[0])
    assert kept().count() == 2 and kept().count() == 2 and len(made) == 1
    now[0] = 61
    assert kept().count() == 2 and len(made) == 2


def test_vault_and_repairs(spark):
    from siltstone.operators import exports

    d = spark.createDataFrame([("a", "learning", "Alpha", "text", ["x"], None, 1), ("b", "learning", "Beta", None, ["x", "y"], "o/r", 2)], "id string, type string, title string, content string, concepts array<string>, project string, created_at long")
    out = dict(rows(exports.vault_files(d, spark.createDataFrame([("a", "b", 0.9)], "id string, other string, score double"))))
    assert set(out) > {"learning/alpha-a.md", "learning/beta-b.md", "learning/_index.md"} and len(out) == 5
    assert "## Related\n\n- [Beta](learning/beta-b.md)" in out["learning/alpha-a.md"] and out["learning/beta-b.md"].startswith("---\nid: b\n")
    hub = next(v for k, v in out.items() if k.startswith("_concepts/x-"))
    assert hub.index("Beta") < hub.index("Alpha")  # the newest first
    lost = spark.createDataFrame([("1", "f.md", "see github.com/A/B", None), ("2", "g.md", "nothing", ""), ("3", "h.md", "rrr: c/d", None), ("4", "h.md", "github.com/x/y", "kept")], "id string, source_file string, content string, project string")
    found = merge.repaired_projects(lost, spark.createDataFrame([("f.md", "from github.com/q/r")], "source_file string, content string"))
    assert rows(found) == [("1", "github.com/q/r", "file"), ("3", "github.com/c/d", "index")]
    docs = spark.createDataFrame([("a", None, None, None), ("b", None, None, None)], "id string, superseded_by string, superseded_at long, superseded_reason string")
    table, log = merge.superseded(docs, spark.createDataFrame([("a", "b", "old"), ("b", "b", "self"), ("a", "zz", "lost")], "old_id string, new_id string, reason string"), 5)
    assert rows(table) == [("a", "b", 5, "old"), ("b", None, None, None)] and rows(log) == [("a", "b", "old", 5)]
