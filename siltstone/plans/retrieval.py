"""Queries over text and vectors: matching, ranking, nearest neighbours, fusion, agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import scores
from siltstone.functions.keys import concept_list, norm_key
from siltstone.operators import fts, relational as rel, search
from siltstone.plans.documents import _CONCEPTS
from siltstone.plans.registry import Tables, query
from siltstone.storage import new_folder, stored

#: Terms of the fixed text queries and the id of the fixed vector query.
TERMS = ["index", "search"]
VECTOR_ID = 7

_TOKENS = r"(SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}\p{M}]+'), lambda x: x <> '') AS toks FROM documents)"
_BM25 = f"""(WITH c AS (SELECT doc_id, len(toks) AS dl, len(list_filter(toks, lambda x: x = 'index')) AS a, len(list_filter(toks, lambda x: x = 'search')) AS b FROM {_TOKENS}),
    s AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM c)
    SELECT doc_id, ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / avgdl)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS score
    FROM c, s WHERE a > 0 AND b > 0)"""
_Q = f"(SELECT embedding FROM embeddings WHERE vec_id = {VECTOR_ID})"
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
_DISTANCE = "(1.0 - " + _DOT.format(a="embedding", b=_Q) + ")"
_TOP20 = f"(SELECT doc_id AS id, score FROM {_BM25} ORDER BY score DESC, doc_id LIMIT 20)"
_VEC20 = f"(SELECT vec_id AS id, {_DISTANCE} AS distance FROM embeddings WHERE vec_id <> {VECTOR_ID} ORDER BY distance, id LIMIT 20)"


_indexes: dict[tuple, fts.Index] = {}


def _index(t: Tables, name: str = "documents", stem: bool = False) -> fts.Index:
    """The stored index of a table, built once a session: searches read it, never the texts."""
    key = (t.spark.sparkContext.applicationId, t.folder, name, stem)
    if key not in _indexes:
        docs, key_col, cols = (t.documents, "doc_id", ["text"]) if name == "documents" else (_records(t), "id", ["content", "concepts"])
        _indexes[key] = fts.Index.build(docs, key_col, cols, new_folder(t.spark, f"fts-{name}"), buckets=16, stem=stem)
    return _indexes[key]


def _records(t: Tables) -> DataFrame:
    """Records with their texts and concepts, each once."""
    last = F.struct("indexed_at", "content")
    rows = t.oracle_documents.where("id is not null").groupBy("id").agg(F.max_by("content", last).alias("content"), F.max_by("concepts", last).alias("concepts"))
    return rows.select("id", "content", concept_list(F.col("concepts")).alias("concepts"))


def _ranked_text(t: Tables, k: int = 20) -> DataFrame:
    return fts.top_k(_index(t).scored(" ".join(TERMS)), k).select(F.col("doc_id").alias("id"), "score")


def _query_vector(t: Tables) -> list[float]:
    return search.vector_of(t.embeddings, "vec_id", "embedding", VECTOR_ID)


def _near(t: Tables, k: int = 20) -> DataFrame:
    return search.nearest(t.embeddings, "vec_id", "embedding", _query_vector(t), k, exclude=VECTOR_ID)


@query(f"SELECT term, count(*) AS docs, CAST(sum(tf) AS BIGINT) AS occurrences FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM {_TOKENS}) GROUP BY ALL) GROUP BY term")
def fts_postings(t: Tables):
    index = _index(t).postings()
    return index.groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("occurrences"))


@query(f"SELECT doc_id FROM {_TOKENS} WHERE list_contains(toks, 'index') AND list_contains(toks, 'search')")
def fts_match_and(t: Tables):
    return _index(t).scored("index AND search").select("doc_id")


@query(f"SELECT doc_id FROM {_TOKENS} WHERE list_contains(toks, 'ledger') OR list_contains(toks, 'archiv')")
def fts_match_or(t: Tables):
    return _index(t).scored("ledger OR archiv").select("doc_id")


@query(f"SELECT doc_id FROM {_TOKENS} WHERE list_contains(toks, 'index') AND NOT list_contains(toks, 'search')")
def fts_match_not(t: Tables):
    return _index(t).scored("index NOT search").select("doc_id")


@query(f"SELECT count(*) AS total FROM {_TOKENS} WHERE list_contains(toks, 'index') AND list_contains(toks, 'search')")
def fts_total(t: Tables):
    return _index(t).scored("index search").agg(F.count("*").alias("total"))


@query(f"SELECT doc_id, round(score, 6) AS score FROM {_BM25} ORDER BY score DESC, doc_id LIMIT 20")
def fts_bm25_topk(t: Tables):
    return _ranked_text(t).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"SELECT id, round(exp(-0.3 * abs(score)), 6) AS decayed, round(1 / (1 + abs(score)), 6) AS reciprocal, round(abs(score) / (1 + abs(score)), 6) AS monotone FROM {_TOP20}")
def fts_normalised(t: Tables):
    rank = -F.col("score")
    return _ranked_text(t).select("id", F.round(scores.rank_decay(rank), 6).alias("decayed"), F.round(scores.rank_reciprocal(rank), 6).alias("reciprocal"), F.round(scores.rank_monotone(rank), 6).alias("monotone"))


@query()
def fts_stemmed(t: Tables):
    """Postings of documents by Porter stem: stems with their documents and occurrences."""
    index = _index(t, stem=True).postings().withColumnRenamed("term", "stem")
    return index.groupBy("stem").agg(F.count("*").alias("docs"), F.sum("tf").alias("occurrences"))


#: Spellings that Porter's algorithm (1980) reduces to one stem each.
_FORMS = {"index": ("index", "indexed", "indexes", "indexing", "indexer", "indexers"), "note": ("note", "notes", "noted", "noting"), "deploy": ("deploy", "deploys", "deployed", "deploying", "deployment", "deployments")}
_RECORD_TOKENS = rf"""(SELECT id, list_filter(string_split_regex(lower(coalesce(content, '') || ' ' || array_to_string(terms, ' ')), '[^\p{{L}}\p{{N}}\p{{M}}]+'), lambda x: x <> '') AS toks
    FROM (SELECT id, arg_max(content, (indexed_at, content)) AS content, coalesce(arg_max({_CONCEPTS}, (indexed_at, content)), []) AS terms FROM oracle_documents WHERE id IS NOT NULL GROUP BY id))"""


def _form(stem: str) -> str:
    return "len(list_intersect(toks, [" + ", ".join(f"'{w}'" for w in _FORMS[stem]) + "])) > 0"


@query(f"SELECT id AS doc_id FROM {_RECORD_TOKENS} WHERE ({_form('index')} AND {_form('note')}) OR ({_form('deploy')} AND NOT {_form('note')})")
def fts_records(t: Tables):
    """Search by stems over contents and concepts, with all operators: words side by side, NOT and OR."""
    return _index(t, "records", stem=True).scored("indexing notes OR deployments NOT noted").select("doc_id")


@query(f"SELECT vec_id AS id, round({_DISTANCE}, 5) AS distance FROM embeddings WHERE vec_id <> {VECTOR_ID} ORDER BY {_DISTANCE}, vec_id LIMIT 10")
def knn_by_id(t: Tables):
    return _near(t, 10).select("id", F.round("distance", 5).alias("distance"))


@query(f"SELECT vec_id AS id, round({_DISTANCE}, 5) AS distance FROM embeddings WHERE label = 2 AND vec_id <> {VECTOR_ID} ORDER BY {_DISTANCE}, vec_id LIMIT 10")
def knn_filtered(t: Tables):
    return search.nearest(t.embeddings, "vec_id", "embedding", _query_vector(t), 10, where=F.col("label") == 2, exclude=VECTOR_ID).select("id", F.round("distance", 5).alias("distance"))


@query(f"SELECT v.id, round(greatest(0.0, 1 - v.distance / 2), 5) AS similarity, d.lang, d.project FROM {_VEC20} v LEFT JOIN documents d ON d.doc_id = v.id")
def similar_scored(t: Tables):
    docs = t.documents.select(F.col("doc_id").alias("id"), "lang", "project")
    hits = _near(t)
    return docs.join(F.broadcast(hits), "id", "right").select("id", F.round(scores.distance_similarity(F.col("distance"), "similar"), 5).alias("similarity"), "lang", "project")


@query("SELECT id, other, round(score, 5) AS score FROM (SELECT a.vec_id AS id, b.vec_id AS other, s.score, row_number() OVER (PARTITION BY a.vec_id ORDER BY s.score DESC, b.vec_id) AS rn FROM embeddings a, embeddings b, LATERAL (SELECT "
       + _DOT.format(a="a.embedding", b="b.embedding") + " AS score) s WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND s.score >= 0.2) WHERE rn <= 8")
def knn_allpairs_threshold(t: Tables):
    e = t.embeddings
    return search.similar_links(e, "vec_id", "embedding", e.where("vec_id % 20 = 0"), threshold=0.2, most=8).select("id", "other", F.round("score", 5).alias("score"))


@query(f"""SELECT coalesce(f.id, v.id) AS id, round(CASE WHEN f.id IS NOT NULL AND v.id IS NOT NULL THEN (0.5 * f.score + 0.5 * v.score) * 1.1 ELSE coalesce(0.5 * f.score, 0.5 * v.score) END, 5) AS score,
    CASE WHEN f.id IS NOT NULL AND v.id IS NOT NULL THEN 'hybrid' WHEN f.id IS NOT NULL THEN 'fts' ELSE 'vector' END AS source
    FROM (SELECT id, exp(-0.3 * abs(score)) AS score FROM {_TOP20}) f FULL OUTER JOIN (SELECT id, 1 - distance AS score FROM {_VEC20}) v ON f.id = v.id""")
def hybrid_tool(t: Tables):
    text_leg = _ranked_text(t).select("id", scores.rank_decay(F.col("score")).alias("score"))
    vector_leg = _near(t).select("id", scores.distance_similarity(F.col("distance"), "tool").alias("score"))
    return search.fuse_weighted(text_leg, vector_leg).select("id", F.round("score", 5).alias("score"), "source")


@query(f"""SELECT coalesce(f.id, v.id) AS id, round(CASE WHEN f.id IS NOT NULL AND v.id IS NOT NULL THEN least(1.0, greatest(f.score, v.score) + 0.1) ELSE coalesce(f.score, v.score) END, 5) AS score,
    CASE WHEN f.id IS NOT NULL AND v.id IS NOT NULL THEN 'hybrid' WHEN f.id IS NOT NULL THEN 'fts' ELSE 'vector' END AS source
    FROM (SELECT id, 1 / (1 + abs(score)) AS score FROM {_TOP20}) f FULL OUTER JOIN (SELECT id, 1 / (1 + distance / 100.0) AS score FROM {_VEC20}) v ON f.id = v.id""")
def hybrid_http(t: Tables):
    text_leg = _ranked_text(t).select("id", scores.rank_reciprocal(F.col("score")).alias("score"))
    vector_leg = _near(t).select("id", scores.distance_similarity(F.col("distance"), "http").alias("score"))
    return search.fuse_best(text_leg, vector_leg).select("id", F.round("score", 5).alias("score"), "source")


@query(f"""SELECT count(*) FILTER (v.id IS NULL) AS fts, count(*) FILTER (f.id IS NULL) AS vector, count(*) FILTER (f.id IS NOT NULL AND v.id IS NOT NULL) AS hybrid FROM (SELECT id FROM {_TOP20}) f FULL OUTER JOIN (SELECT id FROM {_VEC20}) v ON f.id = v.id""")
def hybrid_mix(t: Tables):
    """Where the hits of a fused page come from."""
    return rel.source_mix(hybrid_http(t))


@query(r"SELECT CAST(doc_id AS BIGINT) AS doc_id FROM documents WHERE lang = 'en' OR list_contains(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}\p{M}]+'), 'replaced')")
def fts_updated(t: Tables):
    """Search after all documents labelled 'en' were indexed again with another text."""
    change = t.documents.where("lang = 'en'").select("doc_id", F.lit("replaced words").alias("text"))
    return _index(t).updated(change, "doc_id", ["text"], new_folder(t.spark, "fts-updated")).scored("replaced").select("doc_id")


#: A vector is usable if it has its model's usual length and is finite and not zero.
_KEY = r"lower(regexp_replace(id, '^\s+|\s+$', '', 'g'))"
_USABLE = f"""(SELECT DISTINCT model_key AS model, {_KEY} AS id, CAST(vector AS DOUBLE[]) AS x FROM vector_documents JOIN (SELECT model_key AS m, arg_max(d, (n, -d)) AS d FROM (SELECT model_key, len(vector) AS d, count(*) AS n FROM vector_documents WHERE vector IS NOT NULL GROUP BY ALL) GROUP BY 1) u ON u.m = model_key AND len(vector) = u.d
    WHERE len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0)"""
#: The two models with the most records, and the first record that both have one vector of; no record has more than two models.
PAIR = ("fjord-base", "moss-small")
_ASKED = f"(SELECT min(id) FROM (SELECT id FROM {_USABLE} WHERE model IN {PAIR} GROUP BY id HAVING count(DISTINCT model) = 2 AND count(*) = 2))"


def _models(t: Tables, k: int = 20) -> DataFrame:
    """``(model, id, score, rank)``: the nearest records of one record under each of two models, in one scan."""
    usual = t.vector_documents.where("vector is not null").groupBy("model_key", F.size("vector").alias("d")).agg(F.count("*").alias("n")).groupBy("model_key").agg(F.max_by("d", F.struct("n", -F.col("d"))).alias("d"))
    usable = t.vector_documents.join(F.broadcast(usual), "model_key").where((F.size("vector") == F.col("d")) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0))
    usable = usable.where(F.col("model_key").isin(*PAIR)).select("model_key", norm_key(F.col("id")).alias("id"), "vector")
    both = usable.distinct().groupBy("id").agg(F.countDistinct("model_key").alias("m"), F.count("*").alias("n"), F.collect_list(F.struct("model_key", "vector")).alias("own")).where("m = 2 and n = 2")
    asked = both.orderBy("id").limit(1).collect()  # one row: the record asked for
    queries = {r["model_key"]: list(r["vector"]) for r in (asked[0]["own"] if asked else [])}
    return search.nearest_each(usable, "model_key", "id", "vector", queries, k, exclude=asked[0]["id"] if asked else None)


def _models_sql(k: int = 20) -> str:
    return f"""(WITH u AS {_USABLE}, q AS (SELECT * FROM u WHERE id = {_ASKED}) SELECT model, id, score, row_number() OVER (PARTITION BY model ORDER BY score DESC, id) AS rank FROM (
        SELECT u.model, u.id, max(list_cosine_similarity(u.x, q.x)) AS score FROM u JOIN q ON u.model = q.model AND u.id <> q.id GROUP BY u.model, u.id) QUALIFY rank <= {k})"""


@query(f"""WITH m AS {_models_sql(60)}, a AS (SELECT * FROM m WHERE model = '{PAIR[0]}'), b AS (SELECT * FROM m WHERE model = '{PAIR[1]}')
    SELECT coalesce(a.id, b.id) AS id, round(CASE WHEN b.score > a.score THEN least(1.0, b.score + 0.05) ELSE coalesce(a.score, b.score) END, 5) AS score,
    CASE WHEN b.score > a.score THEN 'hybrid' ELSE 'vector' END AS source FROM a FULL OUTER JOIN b ON a.id = b.id""")
def multi_model_merge(t: Tables):
    """The lists of two of the models put together."""
    lists = stored(_models(t, 60), "models")
    of = lambda m: lists.where(F.col("model") == m).select("id", "score")
    return search.merge_models(of(PAIR[0]), of(PAIR[1])).select("id", F.round("score", 5).alias("score"), "source")


_MODELS = _models_sql()


@query(f"SELECT m.model_key AS model, coalesce(results, 0) AS results, CASE WHEN results IS NULL THEN 'no results' END AS error FROM (SELECT unnest(['fjord-base', 'moss-small', 'absent']) AS model_key) m LEFT JOIN (SELECT model, count(*) AS results FROM {_MODELS} GROUP BY model) r ON r.model = m.model_key")
def compare_settled(t: Tables):
    """How each model asked for did, one of which does not exist."""
    return search.settled(_models(t), [*PAIR, "absent"])


@query(f"SELECT round(coalesce(max(n) / sum(n), 0), 4) AS agreement FROM (SELECT id, count(*) AS n FROM {_MODELS} WHERE rank = 1 GROUP BY id)")
def agree_top1(t: Tables):
    return search.agreement_at(_models(t), 1)


@query(f"SELECT round(coalesce(count(*) FILTER (m = 2) / nullif(count(*), 0), 0), 4) AS jaccard FROM (SELECT id, count(DISTINCT model) AS m FROM {_MODELS} WHERE rank <= 5 GROUP BY id)")
def agree_jaccard5(t: Tables):
    return search.top_jaccard(_models(t), 5)


@query(f"SELECT round(coalesce(avg(s), 0), 4) AS avg_shift FROM (SELECT max(rank) - min(rank) AS s FROM {_MODELS} GROUP BY id HAVING count(*) >= 2)")
def agree_rank_shift(t: Tables):
    return search.rank_shift(_models(t))


@query(f"SELECT id, count(DISTINCT model) AS models FROM {_MODELS} GROUP BY id HAVING count(DISTINCT model) >= 2")
def agree_shared_ids(t: Tables):
    return search.shared_ids(_models(t))


@query(f"""SELECT (SELECT round(coalesce(max(n) / sum(n), 0), 4) FROM (SELECT id, count(*) AS n FROM {_MODELS} WHERE rank = 1 GROUP BY id)) AS agreement,
    (SELECT round(coalesce(count(*) FILTER (m = 2) / nullif(count(*), 0), 0), 4) FROM (SELECT id, count(DISTINCT model) AS m FROM {_MODELS} WHERE rank <= 5 GROUP BY id)) AS jaccard,
    (SELECT round(coalesce(avg(s), 0), 4) FROM (SELECT max(rank) - min(rank) AS s FROM {_MODELS} GROUP BY id HAVING count(*) >= 2)) AS avg_shift""")
def compare_bundle(t: Tables):
    m = stored(_models(t), "models")
    return search.agreement_at(m, 1).crossJoin(search.top_jaccard(m)).crossJoin(search.rank_shift(m))


@query(f"""SELECT count(*) AS queries, round(avg(hit), 4) AS recall FROM (SELECT id, max(CAST(rn <= 5 AND expected AS INT)) AS hit FROM (
    SELECT a.vec_id AS id, a.label = b.label AS expected, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DOT.format(a="a.embedding", b="b.embedding")} DESC, b.vec_id) AS rn
    FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) GROUP BY id)""")
def recall_eval(t: Tables):
    e = t.embeddings
    links = search.similar_links(e, "vec_id", "embedding", e.where("vec_id % 20 = 0"), threshold=-2.0, most=5)
    label = e.select("vec_id", "label")
    judged = links.join(label.withColumnRenamed("vec_id", "id").withColumnRenamed("label", "x"), "id").join(label.withColumnRenamed("vec_id", "other").withColumnRenamed("label", "y"), "other")
    ranked = search.rank_lists(judged.select(F.col("id").alias("model"), F.col("other").alias("id"), "score", (F.col("x") == F.col("y")).alias("expected")))
    return search.recall_at(ranked.withColumnRenamed("model", "query"), 5)


@query(f"""SELECT r.id, CAST(row_number() OVER (ORDER BY CASE WHEN r.rank <= 10 THEN length(d.text) END DESC NULLS LAST, r.rank, r.id) AS INT) AS new_rank
    FROM (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM {_TOP20}) r JOIN documents d ON d.doc_id = r.id""")
def rerank_head(t: Tables):
    ranked = search.rank_lists(_ranked_text(t).withColumn("model", F.lit("fts"))).select("id", "rank")
    texts = t.documents.select(F.col("doc_id").alias("id"), "text")
    return search.rerank(texts.join(F.broadcast(ranked), "id"), lambda pdf: pdf["text"].str.len(), head=10).select("id", "new_rank")


@query("""SELECT r.id, d.superseded_by, d.superseded_by IS NOT NULL AS superseded FROM (SELECT DISTINCT id FROM oracle_documents WHERE contains(lower(content), 'handoff')) r
    LEFT JOIN (SELECT DISTINCT id, superseded_by FROM oracle_documents WHERE superseded_by IS NOT NULL) d ON r.id = d.id""")
def supersede_enriched(t: Tables):
    hits = t.oracle_documents.where(F.contains(F.lower("content"), F.lit("handoff"))).select("id").distinct()
    old = t.oracle_documents.where("superseded_by is not null").select("id", "superseded_by").distinct()
    return hits.join(old, "id", "left").select("id", "superseded_by", F.col("superseded_by").isNotNull().alias("superseded"))


@query("""SELECT model_key, count(*) AS vectors, count(DISTINCT id) AS ids, count(*) FILTER (vector IS NULL) AS empty FROM vector_documents GROUP BY model_key""")
def vector_stats(t: Tables):
    return t.vector_documents.groupBy("model_key").agg(F.count("*").alias("vectors"), F.countDistinct("id").alias("ids"), F.count_if(F.col("vector").isNull()).alias("empty"))


@query("""SELECT DISTINCT v.model_key, v.id, d.project FROM vector_documents v LEFT JOIN (SELECT DISTINCT id, project FROM oracle_documents) d ON lower(trim(v.id)) = d.id""")
def vector_enriched(t: Tables):
    docs = t.oracle_documents.select("id", "project").distinct()
    return t.vector_documents.select("model_key", norm_key(F.col("id")).alias("id")).join(docs, "id", "left").select("model_key", "id", "project").distinct()

