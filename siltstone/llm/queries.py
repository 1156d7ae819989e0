"""The registered queries of this subpackage, over the tables of one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.keys import concept_array, concept_list, norm_key
from siltstone.llm import chunking, components, knn, language, leakage, minhash, mixing, setjoin, terms
from siltstone.storage import stored


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# 1: near-duplicate records

def _texts(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "oracle_documents").select(norm_key(F.col("id")).alias("id"), F.col("content").alias("text"))
    return docs.unionByName(_table(spark, folder, "learn_inputs").select(norm_key(F.col("input_id")).alias("id"), F.col("pattern").alias("text")))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of records of both tables whose texts share at least 0.6 of their 16-character windows."""
    return minhash.expand_pairs(*minhash.near_duplicates(_texts(spark, folder), "id", "text"))


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    """One row a record that counts: the smallest id of its group, linked by equal or similar texts directly or through others."""
    members, pairs = minhash.near_duplicates(_texts(spark, folder), "id", "text")
    pairs = stored(pairs.select(F.col("class_a").alias("u"), F.col("class_b").alias("v")), "p1-pairs")
    several = members.groupBy("id").agg(F.min("class_id").alias("u"), F.collect_set("class_id").alias("all")).where(F.size("all") > 1)  # one id, several texts
    ties = components.components(pairs.unionByName(several.select("u", F.explode("all").alias("v"))))
    placed = stored(members.join(ties, F.col("class_id") == F.col("u"), "left").select("id", F.coalesce("v", "class_id").alias("root")).distinct(), "p1-roots")
    return placed.join(placed.groupBy("root").agg(F.min("id").alias("group_id")), "root").select("id", "group_id")


# 2: frequency of every concept

def _concepts(spark: SparkSession, folder: str) -> DataFrame:
    """One row an id: of several rows the one indexed last counts."""
    rows = _table(spark, folder, "oracle_documents").select(norm_key(F.col("id")).alias("id"), "concepts", "indexed_at").where("id is not null")
    last = F.max_by("concepts", F.struct(F.col("indexed_at"), F.col("concepts")))
    return rows.groupBy("id").agg(last.alias("concepts")).select("id", concept_list(F.col("concepts")).alias("terms"))


def _counts(spark: SparkSession, folder: str, most: int) -> DataFrame:
    records = stored(_concepts(spark, folder), "p2-records")
    counts = terms.ngram_counts(records, "terms", max_terms=most)
    return terms.marked_terms(counts, records.agg(F.count("*").alias("n_ids")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Concepts too rare or too common to help a search: the runs of one term among those of up to two."""
    return _counts(spark, folder, 2).where("n = 1 and mark is not null").select(F.col("gram")[0].alias("term"), "mark")


def p2_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Every run of up to three neighbouring concepts with its occurrences, records and mark."""
    return _counts(spark, folder, 3).select(F.array_join("gram", "|").alias("gram"), "n", "occurrences", "records", "mark")


# 4: consolidating links into groups

def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every id of a link and the smallest id of its group."""
    log = _table(spark, folder, "supersede_log").select(norm_key(F.col("old_id")).alias("old_id"), norm_key(F.col("new_id")).alias("new_id"))
    return components.group_ids(log, "old_id", "new_id")


# 5: splitting oversized texts

def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "oracle_documents").select(F.lit("oracle_documents").alias("src_table"), norm_key(F.col("id")).alias("id"), F.col("content").alias("text"))
    vectors = _table(spark, folder, "vector_documents").select(F.lit("vector_documents").alias("src_table"), norm_key(F.col("id")).alias("id"), F.col("document").alias("text"))
    return chunking.chunks(docs.unionByName(vectors).where("id is not null"), ["src_table", "id"], "text")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The oversized texts with the coarsest boundary at which they can be cut throughout."""
    return _chunks(spark, folder).where("piece_no = 0").select("src_table", "id", "boundary").distinct()


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every oversized text."""
    return _chunks(spark, folder)


# 6: most similar vectors

def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return knn.usable_vectors(_table(spark, folder, "vector_documents"), F.col("model_key"), norm_key(F.col("id")), F.col("vector"), distinct=False)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of records of one model of which one is among the ten most similar of the other, at 0.9 and more."""
    near = knn.most_similar(_vectors(spark, folder), k=10, min_score=0.9, recall=0.99, recall_sample=2000)
    return near.select(F.col("model").alias("model_key"), F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p6_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest of all embeddings for every embedding whose id is divisible by 20."""
    table = _table(spark, folder, "embeddings")
    vectors = knn.usable_vectors(table, F.lit("embeddings"), F.col("vec_id"), F.col("embedding"), distinct=False)
    asked = table.where(F.col("vec_id") % 20 == 0).select(F.lit("embeddings").alias("model"), F.col("vec_id").alias("id"))
    return knn.most_similar(vectors, asked, k=10, recall=1.0).select("id", "neighbour", F.round("score", 6).alias("score"), "rank")


# 7: all similar pairs of sets

def _sets(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "oracle_documents").select(norm_key(F.col("id")).alias("id"), concept_list(F.col("concepts")).alias("terms"))
    return docs.unionByName(_table(spark, folder, "api_docs").select(norm_key(F.col("id")).alias("id"), concept_array(F.col("concepts")).alias("terms")))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of records whose concept sets share at least three quarters of their distinct concepts."""
    return minhash.expand_pairs(*setjoin.similar_sets(_sets(spark, folder), "id", "terms"))


def p7_classes(spark: SparkSession, folder: str) -> DataFrame:
    """One row a record and set that counts: the smallest id with an equal set, and the number of other sets linked to it."""
    members, pairs = setjoin.similar_sets(_sets(spark, folder), "id", "terms")
    links = pairs.select(F.col("class_a").alias("class_id")).unionAll(pairs.select("class_b")).groupBy("class_id").agg(F.count("*").alias("links"))
    named = members.groupBy("class_id").agg(F.min("id").alias("first_id")).join(links, "class_id", "left")
    return members.join(named, "class_id").select("id", F.col("first_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


# 8: evaluation texts in the corpus

def p8_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the evaluation items they share a run of 50 letters and digits with."""
    return leakage.leaks(_table(spark, folder, "documents"), "doc_id", "text", _table(spark, folder, "eval_items"), "item_id", "text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """As p8_leaks, without the length of the run."""
    return p8_leaks(spark, folder).select("doc_id", "item_id")


# 9: mixing sources

def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(_table(spark, folder, "documents"), "doc_id", "text", "source", _table(spark, folder, "mix_targets"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sources whose records cannot reach their target share however often they may be repeated."""
    return _mix(spark, folder)[1].where("short").select("source")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and reached share of every source."""
    return _mix(spark, folder)[1]


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The mixture: how often each record is used."""
    return _mix(spark, folder)[0]


# 10: languages

_fitted: dict[tuple[str, str], language.Params | None] = {}


def _network(spark: SparkSession, docs: DataFrame, folder: str) -> language.Params | None:
    """The network of a folder's documents, fitted once a session."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _fitted:
        _fitted[key] = language.fit_sample(docs, "doc_id", "text", "lang")
    return _fitted[key]


def p10_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every language of every document with its share of the letters and a confidence."""
    docs = _table(spark, folder, "documents")
    return language.document_languages(docs, ["doc_id"], "text", _network(spark, docs, folder))


def p10_stretches(spark: SparkSession, folder: str) -> DataFrame:
    """Every stretch in one language with a confidence."""
    docs = _table(spark, folder, "documents")
    return language.stretches(docs, ["doc_id"], "text", _network(spark, docs, folder))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of the documents that have several, or whose label does not name their one."""
    docs = _table(spark, folder, "documents")
    labelled = docs.select("doc_id", "text", F.col("lang").alias("label"))
    own = language.document_languages(labelled, ["doc_id", "label"], "text", _network(spark, docs, folder))
    named = language.label_language(F.col("label"))
    return own.where(~F.coalesce((F.col("languages") == 1) & (named == F.col("lang")), F.lit(False))).select("doc_id", "lang")


def queries() -> dict:
    return {f.__name__: f for f in (
        p1_found, p1_groups, p2_found, p2_counts, p4_found, p5_found, p5_pieces, p6_found, p6_embeddings,
        p7_found, p7_classes, p8_found, p8_leaks, p9_found, p9_shares, p9_mixture, p10_found, p10_documents, p10_stretches,
    )}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express over whole tables."""
    from siltstone.llm.oracle import SQL

    return dict(SQL)
