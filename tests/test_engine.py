from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.api import KnowledgeBase
from siltstone.functions import markup, scores
from siltstone.operators import embed, exports, fts, graph, ingest, layout, merge, queue, relational as rel, search
from siltstone.sources import files, sinks
from siltstone.streaming import live


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def docs(spark):
    data = [
        ("a", "learning", "memory/learnings/a.md", "git search index rules", ["git"], 1, None),
        ("b", "retro", "memory/retrospectives/b.md", "search search latency notes", ["git", "notes"], 2, "forge.example/o/r"),
        ("c", "principle", "memory/resonance/c.md", "nothing is deleted", ["notes"], 3, None),
    ]
    df = spark.createDataFrame(data, "id string, type string, source_file string, content string, concepts array<string>, indexed_at long, project string")
    return df.withColumns({"created_at": F.col("indexed_at"), "updated_at": F.col("indexed_at"), "superseded_by": F.lit(None).cast("string"), "created_by": F.lit("indexer")})


# full text

def test_queries_parse():
    p = fts.parse
    assert p("a b") == ("and", "a", "b") and p("A or B") == ("and", ("and", "a", "or"), "b")
    assert p("a b OR c") == ("or", ("and", "a", "b"), "c") and p("a NOT b c") == ("not", "a", ("and", "b", "c"))
    assert p("NOT a") == ("not", None, "a") and p("a OR") == "a" and p("AND") is None and p("") is None and p("a AND b OR c NOT d") == ("or", ("and", "a", "b"), ("not", "c", "d"))
    assert p("foo-bar") == ("and", "foo", "bar") and fts.words_of(p("a OR b NOT c")) == ["a", "b", "c"]


def test_match_and_rank(spark, tmp_path):
    index = fts.Index.build(docs(spark), "id", ["content"], str(tmp_path / "index"), buckets=4)
    found = lambda q: rows(index.scored(q).select("doc_id"))
    assert found("search") == [("a",), ("b",)] and found("git OR deleted") == [("a",), ("c",)] and found("search NOT git") == [("b",)]
    assert found("NOT search") == [("c",)] and found("absent") == [] and found("") == [] and found("git latency") == []
    assert [r["doc_id"] for r in fts.top_k(index.scored("search"), 5).collect()] == ["b", "a"]
    n, df, dl, avgdl, tf = 3, 2, 4, 11 / 3, 2
    score = np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))
    assert index.scored("search").where("doc_id = 'b'").first()["score"] == pytest.approx(score)
    plan = index.postings(["git"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan or "PartitionFilters: [bucket" in plan
    empty = fts.Index.build(docs(spark).limit(0), "id", ["content"], str(tmp_path / "none"), buckets=2)
    assert empty.scored("search").count() == 0


def test_stored_index(spark, tmp_path):
    index = fts.Index.build(docs(spark), "id", ["content", "concepts"], str(tmp_path / "index"), buckets=4, stem=True)
    assert rows(index.postings(["search", "git"]).select("term", "doc_id", "col", "tf")) == [("git", "a", "concepts", 1), ("git", "a", "content", 1), ("git", "b", "concepts", 1), ("search", "a", "content", 1), ("search", "b", "content", 2)]
    assert rows(index.scored("searching rule").select("doc_id")) == [("a",)] and rows(index.scored("note").select("doc_id")) == [("b",), ("c",)]
    change = docs(spark).where("id = 'a'").withColumn("content", F.lit("other words"))
    again = index.updated(change, "id", ["content", "concepts"], str(tmp_path / "next"), removed=spark.createDataFrame([("c",)], "doc_id string"))
    assert rows(again.scored("search").select("doc_id")) == [("b",)] and rows(again.scored("other git").select("doc_id")) == [("a",)] and again.documents().count() == 2


# fusion and agreement

def leg(spark, *pairs):
    return spark.createDataFrame(list(pairs), "id string, score double")


def test_fusion_profiles(spark):
    text, vector = leg(spark, ("x", 0.8), ("y", 0.4)), leg(spark, ("x", 0.9), ("z", 0.5))
    tool = {r["id"]: (round(r["score"], 6), r["source"]) for r in search.fuse_weighted(text, vector).collect()}
    assert tool == {"x": (0.935, "hybrid"), "y": (0.2, "fts"), "z": (0.25, "vector")}
    http = {r["id"]: (round(r["score"], 6), r["source"]) for r in search.fuse_best(text, vector).collect()}
    assert http == {"x": (1.0, "hybrid"), "y": (0.4, "fts"), "z": (0.5, "vector")}
    merged = {r["id"]: round(r["score"], 6) for r in search.merge_models(text, vector).collect()}
    assert merged == {"x": 0.95, "y": 0.4, "z": 0.5}


def test_rerank_loses_nothing(spark):
    ranked = spark.createDataFrame([(f"d{i}", i, "x" * i) for i in range(1, 7)], "id string, rank int, text string")
    out = search.rerank(ranked, lambda pdf: pdf["text"].str.len().where(pdf["rank"] != 2), head=4).orderBy("new_rank").collect()
    assert [r["id"] for r in out] == ["d4", "d3", "d1", "d2", "d5", "d6"]


def test_agreement(spark):
    ranked = search.rank_lists(spark.createDataFrame([("m", "a", 3.0), ("m", "b", 2.0), ("n", "a", 3.0), ("n", "c", 1.0), ("o", "c", 9.0), ("o", "a", 1.0)], "model string, id string, score double"))
    assert search.agreement_at(ranked, 1).first()[0] == 0.6667
    assert search.top_jaccard(ranked).first()[0] == 0.3333
    assert search.rank_shift(ranked).first()[0] == 1.0
    assert rows(search.shared_ids(ranked)) == [("a", 3), ("c", 2)]


@pytest.mark.parametrize("d", [384, 1024, 4096])
def test_nearest_in_many_dimensions(spark, d):
    rng = np.random.default_rng(d)
    x = rng.standard_normal((40, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    data = [("m", i, v.tolist()) for i, v in enumerate(x)] + [("m", 90, None), ("m", 91, [1.0] * (d - 1)), ("m", 92, [float("nan")] * d), ("n", 5, x[5].tolist()), ("n", 6, [0.0] * d)]
    v = spark.createDataFrame(data, "model string, id int, v array<float>")
    best = np.argsort(1 - x @ x[7], kind="stable")[1:6].tolist()
    assert [r["id"] for r in search.nearest(v.where("model = 'm'"), "id", "v", x[7].tolist(), 5, exclude=7).collect()] == best
    each = search.nearest_each(v, "model", "id", "v", {"m": x[7].tolist(), "n": x[5].tolist()}, 5, exclude=7)
    assert [r["id"] for r in each.where("model = 'm'").orderBy("rank").collect()] == best and rows(each.where("model = 'n'").select("id", F.round("score", 4))) == [(5, 1.0)]
    assert rows(search.settled(each, ["m", "n", "o"])) == [("m", 5, None), ("n", 1, None), ("o", 0, "no results")]
    one = spark.createDataFrame([(x[0].tolist(),)], "v array<double>").select(scores.dot_literal(F.col("v"), x[1].tolist())).first()[0]
    assert one == pytest.approx(float(x[0] @ x[1]))


def test_links_are_exact_in_cells_and_blocks(spark):
    rng = np.random.default_rng(4)
    x = np.repeat(rng.standard_normal((12, 16)), 30, axis=0) + rng.standard_normal((360, 16)) * 0.2
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, v array<float>")
    score = x.astype(float) @ x.T.astype(float)
    np.fill_diagonal(score, -2)
    for threshold, most in ((0.8, 400), (-2.0, 3)):
        got = {(a, b) for a, b, _ in rows(search.similar_links(v, "id", "v", v.where("id % 20 = 0"), threshold=threshold, most=most, block=16))}
        want = {(i, int(j)) for i in range(0, 360, 20) for j in np.argsort(-score[i], kind="stable")[:most] if score[i, j] >= threshold}
        assert got == want and len(want) > 50


def test_nearest_and_links(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.0, 1.0]), (4, None)], "id int, v array<float>")
    hits = search.nearest(v.where("v is not null"), "id", "v", [1.0, 0.0], 2, exclude=1).collect()
    assert [(r["id"], round(r["distance"], 5)) for r in hits] == [(2, 0.2), (3, 1.0)]
    with pytest.raises(KeyError):
        search.vector_of(v, "id", "v", 99)
    links = search.similar_links(v, "id", "v", v, threshold=0.5, most=1, block=2)
    assert [(a, b) for a, b, _ in rows(links)] == [(1, 2), (2, 1), (3, 2)]


# graphs and maps

def test_walk_of_wide_and_layered_graphs(spark):
    hub = spark.range(1, 1_200_001).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    assert graph.walk(hub, spark.createDataFrame([(0,)], "id long")).count() == 1_200_001
    layers = spark.createDataFrame([(2 * i + a, 2 * i + 2 + b) for i in range(21) for a in (0, 1) for b in (0, 1)], "src long, dst long")
    got = rows(graph.walk(layers, spark.createDataFrame([(0,)], "id long")))
    assert len(got) == 43 and max(d for *_, d in got) == 21


def test_chains(spark):
    links = [("a", "b"), ("b", "c"), ("c", None), ("x", "y"), ("y", "z"), ("z", "x"), ("alone", None), ("p", "gone"), ("q", "c"), ("s", "s")]
    got = dict((i, (h, n)) for i, h, n in rows(graph.chains(spark.createDataFrame(links, "id string, next string"))))
    assert got == {"a": ("a", 0), "b": ("a", 1), "c": ("a", 2), "x": ("x", 0), "y": ("x", 1), "z": ("x", 2), "alone": ("alone", 0), "p": ("p", 0), "q": ("q", 0), "s": ("s", 0)}
    long = spark.range(3000).select(F.col("id"), F.when(F.col("id") < 2999, F.col("id") + 1).alias("next"))
    assert graph.chains(long).where("head = 0 and position = id").count() == 3000
    assert graph.chains(spark.createDataFrame([], "id string, next string")).count() == 0


def test_walk_ends_in_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    assert rows(graph.walk(edges, spark.createDataFrame([("a",)], "id string"))) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 3)]


def test_walk_has_no_cap_and_keeps_the_shortest_way(spark):
    links = [(i, i + 1) for i in range(100)] + [(0, 90), (100, 0), (7, 200), (200, 7)]
    edges = spark.createDataFrame(links, "src long, dst long")
    start = spark.createDataFrame([(0,), (50,), (999,)], "id long")
    want = set()
    for root in (0, 50, 999):
        seen, level = {root: 0}, [root]
        while level:
            level = sorted({b for a, b in links if a in level} - set(seen))
            seen.update(dict.fromkeys(level, max(seen.values()) + 1))
        want |= {(root, i, d) for i, d in seen.items()}
    assert set(rows(graph.walk(edges, start))) == want and max(d for *_, d in want) > 80
    assert set(rows(graph.walk(edges, start, depth=10))) == {x for x in want if x[2] <= 10}


def test_supersede_lineage_is_whole(spark, tmp_path):
    from siltstone.plans.catalogue import queries

    log = [(f"n{i}", f"n{i + 1}") for i in range(60)]
    spark.createDataFrame(log, "old_id string, new_id string").write.parquet(str(tmp_path / "supersede_log.parquet"))
    assert rows(queries()["supersede_lineage"](spark, str(tmp_path))) == sorted(("n0", f"n{i}", i) for i in range(61))


def test_long_groups_render_whole_and_in_order(spark):
    data = [("t", f"r{i * 7919 % 2500:04}", f"p{i % 3}") for i in range(2500)] + [("u", "b", "q"), ("u", "a", "q")]
    got = rows(exports.index_markdown(spark.createDataFrame(data, "type string, id string, path string"), "type", "id", "path"))
    lines = "\n".join(f"- [{i}]({p})" for _, i, p in sorted(data) if _ == "t")
    assert got == [("t", 0, f"## t (2500)\n{lines}"), ("u", 0, "## u (2)\n- [a](q)\n- [b](q)")]
    days = spark.createDataFrame([(f"2026-01-{i % 28 + 1:02}", f"e{i:04}") for i in range(2500)] + [("2026-02-01", "x")], "day string, id string")
    (_, page, text), _ = rows(exports.schedule_markdown(days, "day", "id"))
    body = text.split("\n")[1:]
    assert page == 0 and len(body) == 2500 and body == sorted(body)


def test_whole_texts_are_embedded_unless_the_embedder_has_a_limit(spark):
    start, text = "alpha " * 400, "alpha " * 400 + "omega " * 400
    one = spark.createDataFrame([("x", text)], "id string, content string")
    own = embed.hashing_embedder(64)
    assert np.allclose(embed.embedded(one, "id", "content", "small").first()["vector"], own([text])[0])
    own.most_chars = len(start)
    assert np.allclose(embed.embedded(one, "id", "content", "small", own).first()["vector"], own([start])[0])


def test_concept_edges(spark):
    assert rows(graph.concept_edges(docs(spark), "id", "concepts")) == [("a", "b", 1), ("b", "c", 1)]


def test_principal_axes(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 5)) * [5, 3, 1, 0.1, 0.1]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, v array<float>")
    mean, axes, variance = layout.principal_axes(df, "v")
    values = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert np.allclose(variance, values[:3], rtol=1e-4) and np.allclose(mean, x.mean(0), atol=1e-5) and np.allclose(axes.T @ axes, np.eye(3), atol=1e-8)
    placed = layout.map_3d(df, "id", "v").toPandas()
    assert placed[["x", "y", "z"]].min().eq(-1).all() and placed[["x", "y", "z"]].max().eq(1).all()
    assert rows(layout.mean_vectors(spark.createDataFrame([("k", [1.0, 2.0]), ("k", [3.0, 4.0])], "k string, v array<float>"), "k", "v")) == [("k", [2.0, 3.0])]


# ingestion

def test_parsers(spark):
    f = spark.createDataFrame([("r.md", "intro\n### One\nbody line\n- first\n- second\n### Empty\n### Two\nmore")], "path string, content string")
    assert rows(ingest.principles(f, "path", "content")) == [
        ("resonance_r_1", "principle", "One: body line\n- first\n- second"), ("resonance_r_1_sub_0", "principle", "One: first"), ("resonance_r_1_sub_1", "principle", "One: second"), ("resonance_r_3", "principle", "Two: more"),
    ]
    g = spark.createDataFrame([("l.md", "x\n## A\nbody"), ("m.md", "no section"), ("n.md", "")], "path string, content string")
    assert rows(ingest.learnings(g, "path", "content", F.lit("T"))) == [("learning_l_1", "learning", "T - A: body"), ("learning_m", "learning", "no section")]
    h = spark.createDataFrame([("t.md", "## A\nshort\n## B\n" + "y" * 50)], "path string, content string")
    assert rows(ingest.retrospectives(h, "path", "content")) == [("retro_t_1", "retro", "B: " + "y" * 50)]
    s = spark.createDataFrame([("s.md", "fine\npassword: hunter2222\nPASSWD='abcdefghij012345'\n")], "path string, content string")
    assert rows(ingest.secrets(s, "path", "content")) == [("s.md", 3, "env-credential", "PASSWD='abcdefghij012345'")]


def test_markdown_tree(spark, tmp_path):
    for name, body in {"a.md": "# A", "sub/b.md": "B", ".git/c.md": "C", "node_modules/d.md": "D", "_index.md": "I", "e.txt": "E"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    found = files.markdown(spark, str(tmp_path))
    assert sorted((r["path"].rsplit("/", 1)[1], r["content"], r["size"]) for r in found.collect()) == [("a.md", "# A", 3), ("b.md", "B", 1)]
    assert files.file_stats(spark, str(tmp_path)).count() >= 2
    assert [r["name"] for r in files.inbox(found).collect()] == ["b.md", "a.md"]


def test_front_matter(spark):
    body = "---\ntags: [a, 'b c']\nproject: o/r\nlist:\n  - x\n  - y\n---\nrest"
    df = spark.createDataFrame([(body,), ("none",), (None,)], "c string")
    got = [r[0] for r in df.select(markup.front_matter_map(F.col("c"))).collect()]
    assert got == [{"tags": "a, b c", "project": "o/r", "list": "x, y"}, None, None]
    out = df.select(markup.with_project(F.col("c"), F.lit("p/q"))).collect()
    assert out[0][0] == body and out[1][0] == "---\nproject: p/q\n---\n\nnone"
    slugs = spark.createDataFrame([("Crème Brûlée!",), (None,)], "c string").select(markup.ascii_slug(F.col("c"))).collect()
    assert [r[0] for r in slugs] == ["creme-brulee", None]


# merging

def test_upsert_keeps_what_it_must(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, made int, body string")
    new = spark.createDataFrame([("b", 9, None), ("c", 3, "z")], "id string, made int, body string")
    merged = merge.upsert(old, new, "id", keep=["made"])
    assert sorted(map(tuple, merged.collect()), key=str) == [("a", 1, "x"), ("b", 2, None), ("c", 3, "z")]
    assert merged.count() == merge.upsert(merged, new, "id", keep=["made"]).count()


def test_plans_and_guards(spark):
    d = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), (None, "4")], "id string, hash string")
    s = spark.createDataFrame([("a", "1"), ("b", "x"), ("z", "0")], "id string, hash string")
    assert sorted(map(str, rows(merge.import_plan(d.where("id is not null"), s)))) == sorted(map(str, [("a", "skip-unchanged"), ("b", "update"), ("c", "create"), ("z", "tombstone")]))
    assert merge.import_plan(d, s).where("action = 'skip-no-id'").count() == 1
    indexed = spark.createDataFrame([("p",), ("q",), ("r",)], "path string")
    disk = spark.createDataFrame([("p",)], "path string")
    assert rows(merge.stale(indexed, disk, "path", owned=F.lit(True))) == [("q", False), ("r", False)]


def test_snapshots(spark, tmp_path):
    root = f"file://{tmp_path}/table"
    for n in range(4):
        sinks.write_snapshot(spark.range(n), root, keep=2)
    assert sinks.read_snapshot(spark, root).count() == 3
    assert len([p for p in (tmp_path / "table").iterdir() if p.name.startswith("v")]) == 2
    sinks.append(spark.range(2), f"{root}_log")
    sinks.append(spark.range(3), f"{root}_log")
    assert spark.read.parquet(f"{root}_log").count() == 5
    sinks.write_csv(spark.createDataFrame([('a"b', "c,d\ne")], "x string, y string"), f"{root}_csv")
    assert rows(spark.read.csv(f"{root}_csv", header=True, escape='"', multiLine=True)) == [('a"b', "c,d\ne")]
    sinks.write_json(spark.createDataFrame([(1, ["x"])], "i int, l array<string>"), f"{root}_json")
    assert [json.loads(r[0]) for r in spark.read.text(f"{root}_json").collect()] == [{"i": 1, "l": ["x"]}]


def test_queue(spark):
    jobs = spark.createDataFrame([("1", "m", "pending", 0, 5), ("2", "m", "pending", 0, 3), ("3", "n", "done", 1, 1), ("2", "m", "pending", 0, 3)], "id string, model_key string, status string, attempts int, created_at long")
    assert [tuple(r) for r in queue.claim_next(jobs).select("id", "status", "attempts").collect()] == [("2", "claimed", 1)]
    assert rows(queue.depth(jobs).select("model_key", "pending", "done", "depth")) == [("m", 3, 0, 3), ("n", 0, 1, 0)]
    assert queue.enqueue(spark.createDataFrame([("d",)], "doc_id string"), spark.createDataFrame([("m",), ("n",)], "model_key string"), 7).count() == 2


def test_queue_worker_handles_each_job_once(spark, tmp_path):
    schema = "id string, content string"
    source, target, done = str(tmp_path / "jobs"), str(tmp_path / "vectors"), []

    def work(batch, number):
        done.extend(r["id"] for r in batch.select("id").collect())
        sinks.append(embed.embedded(batch, "id", "content", "small"), target)

    for part in ([("a", "x"), ("b", None)], [("c", "y z")]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(source)
        live.queue_worker(spark.readStream.schema(schema).parquet(source), work, str(tmp_path / "check")).awaitTermination()
    assert sorted(done) == ["a", "b", "c"] and spark.read.parquet(target).count() == 3


def test_growth_has_empty_buckets(spark):
    df = spark.createDataFrame([(5,), (rel.DAY_MS * 2 + 1,)], "t long")
    assert [r["n"] for r in rel.growth(df, F.col("t"), rel.DAY_MS * 3, 3).orderBy("bucket").collect()] == [1, 0, 1]


def test_facade(spark):
    base = KnowledgeBase(spark, docs(spark))
    base = KnowledgeBase(spark, base.docs, base.embedded("small"))
    assert [r["id"] for r in base.list().collect()] == ["c", "b", "a"]
    assert {r["id"] for r in base.search("search git", limit=3).collect()} >= {"a"}
    assert [r["id"] for r in base.search("latency notes", mode="fts", profile="http").collect()] == ["b"]
    assert base.search("???", mode="fts").count() == 0
    assert base.similar("a", 2).count() == 2 and base.graph().count() == 2 and base.reflect(3).count() == 1
    assert base.concepts(1).first()["concept"] == "git" and base.stats(3).first()["docs"] == 3
    grown = KnowledgeBase(spark, base.learned("Write it down", 1_700_000_000_000, concepts="git, Notes"))
    assert grown.read("learning_2023-11-14_write-it-down").first()["concepts"] == ["git", "notes"]
    with pytest.raises(FileExistsError):
        grown.learned("Write it down", 1_700_000_000_000)
    broken = KnowledgeBase(spark, base.docs, spark.createDataFrame([("small", "a")], "model_key string, id string"))
    with pytest.warns(RuntimeWarning):
        assert {r["source"] for r in broken.search("search git").collect()} == {"fts"}
    assert {r["id"] for r in base.search("latency OR deleted", mode="fts").collect()} == {"b", "c"} and base.total("search", 1) == 2
    assert base.superseded("a", "b", 5).where("superseded_by = 'b'").count() == 1
    with pytest.raises(KeyError):
        base.superseded("a", "nope", 5)


def test_queries_and_sql_have_the_same_names():
    from siltstone.plans import catalogue

    assert set(catalogue.oracle_sql()) <= set(catalogue.queries()) and len(catalogue.queries()) > 80
