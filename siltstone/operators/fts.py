"""Full-text search: tokens, postings, boolean matching and BM25 ranking."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.storage import stored

#: BM25's saturation and length parameters.
K1, B = 1.2, 0.75
_NOT_TOKEN = r"[^\p{L}\p{N}\p{M}]+"


def tokens(c: Column) -> Column:
    """Lower-case runs of letters, digits and marks (marks carry Thai vowels)."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), _NOT_TOKEN), lambda t: t != "")


def postings(docs: DataFrame, id_col: str, cols: list[str]) -> DataFrame:
    """``(term, doc_id, col, tf)`` of the given text columns: the inverted index."""
    text = lambda c: F.array_join(c, " ") if docs.schema[c].dataType.typeName() == "array" else F.col(c)
    tagged = lambda c: F.transform(tokens(text(c)), lambda t: F.struct(t.alias("term"), F.lit(c).alias("col")))
    parts = F.flatten(F.array(*map(tagged, cols)))
    exploded = docs.select(id_col, *cols).select(F.col(id_col).alias("doc_id"), F.explode(parts).alias("p")).select("doc_id", "p.term", "p.col")
    return exploded.groupBy("term", "doc_id", "col").agg(F.count("*").alias("tf"))


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


class Index:
    """A stored full-text index: postings by term bucket, document lengths, and one row of corpus statistics.

    A search reads only the folders and row groups of its own terms, never the documents.  A posting carries its document's length, so ranking joins
    nothing as large as the corpus.
    """

    def __init__(self, spark, path: str, buckets: int = 64, stem: bool = False, pieces: int = 4):
        self.spark, self.path, self.buckets, self.stem, self.pieces = spark, path, buckets, stem, pieces

    @classmethod
    def build(cls, docs: DataFrame, id_col: str, cols: list[str], path: str, *, buckets: int = 64, stem: bool = False, pieces: int = 4) -> Index:
        """Writes the index of the columns' texts (arrays count as their elements); ``stem`` reduces terms to Porter's stems.

        A bucket is written in ``pieces`` files by document, so that a term that very many documents hold is no single task's.
        """
        out = cls(docs.sparkSession, path, buckets, stem, pieces)
        index = stored(postings(docs, id_col, cols), "postings")
        index = stemmed(index).withColumnRenamed("stem", "term") if stem else index
        lengths = docs.select(F.col(id_col).alias("doc_id")).distinct().join(index.groupBy("doc_id").agg(F.sum("tf").alias("dl")), "doc_id", "left").select("doc_id", F.coalesce("dl", F.lit(0)).alias("dl"))
        out._write(index.select("term", "doc_id", "col", "tf"), lengths)
        return out

    def _write(self, index: DataFrame, lengths: DataFrame) -> None:
        lengths.write.mode("overwrite").parquet(f"{self.path}/docs")
        lengths = self.spark.read.parquet(f"{self.path}/docs")
        placed = index.join(lengths, "doc_id").withColumn("bucket", _bucket(F.col("term"), self.buckets))
        piece = F.pmod(F.xxhash64("doc_id"), F.lit(self.pieces))
        placed.repartition(self.buckets * self.pieces, F.col("bucket"), piece).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings")
        lengths.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl")).write.mode("overwrite").parquet(f"{self.path}/stats")

    def updated(self, docs: DataFrame, id_col: str, cols: list[str], path: str, *, removed: DataFrame | None = None) -> Index:
        """A new index below ``path`` in which ``docs`` replace what there was of their ids, and ``removed(doc_id)`` are gone."""
        out = Index(self.spark, path, self.buckets, self.stem, self.pieces)
        index = postings(docs, id_col, cols)
        index = stored(stemmed(index).withColumnRenamed("stem", "term") if self.stem else index, "postings")
        ids = docs.select(F.col(id_col).alias("doc_id")).distinct()
        old = ids if removed is None else ids.unionByName(removed.select("doc_id")).distinct()
        lengths = ids.join(index.groupBy("doc_id").agg(F.sum("tf").alias("dl")), "doc_id", "left").select("doc_id", F.coalesce("dl", F.lit(0)).alias("dl"))
        out._write(
            self.postings().select("term", "doc_id", "col", "tf").join(old, "doc_id", "left_anti").unionByName(index.select("term", "doc_id", "col", "tf")),
            self.documents().join(old, "doc_id", "left_anti").unionByName(lengths),
        )
        return out

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """All postings, or those of some terms: folders and row groups without them are not read."""
        kind = self.documents().schema["doc_id"].dataType.simpleString()  # an empty index has no file to tell
        rows = self.spark.read.schema(f"term string, doc_id {kind}, col string, tf long, dl long, bucket int").parquet(f"{self.path}/postings")
        if terms is None:
            return rows
        folders = self.spark.createDataFrame([(t,) for t in terms], "term string").select(_bucket(F.col("term"), self.buckets)).distinct().collect()  # at most one a term
        return rows.where(F.col("bucket").isin([r[0] for r in folders]) & F.col("term").isin(terms))

    def documents(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/docs")

    def term(self, word: str) -> str:
        return porter(word) if self.stem else word

    def scored(self, query: str | Query) -> DataFrame:
        """``(doc_id, score)`` of the documents that match, larger is better; an empty query matches none.

        BM25 over all indexed columns; idf is ln(1 + (N - df + 0.5) / (df + 0.5)).
        """
        parsed = parse(query) if isinstance(query, str) else query
        terms = sorted({self.term(w) for w in words_of(parsed)})
        if not terms:
            return self.documents().where(F.lit(False)).select("doc_id", F.lit(0.0).alias("score"))
        place = {t: i for i, t in enumerate(terms)}
        tf = [F.coalesce(F.sum(F.when(F.col("term") == t, F.col("tf"))), F.lit(0)).alias(f"tf_{i}") for i, t in enumerate(terms)]
        held = self.postings(terms).groupBy("doc_id").agg(F.first("dl").alias("dl"), *tf)
        if _holds(parsed, lambda w: False):  # documents without any of the terms match too
            names = [f"tf_{i}" for i in range(len(terms))]
            held = self.documents().join(held.drop("dl"), "doc_id", "left").fillna(0, names)
        df = held.agg(*(F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(terms))))
        stats = self.spark.read.parquet(f"{self.path}/stats").crossJoin(F.broadcast(df))  # one row
        score = F.lit(0.0)
        for i in range(len(terms)):
            idf = F.log(F.lit(1.0) + (F.col("n_docs") - F.col(f"df_{i}") + 0.5) / (F.col(f"df_{i}") + 0.5))
            n = F.col(f"tf_{i}").cast("double")
            score = score + idf * n * (K1 + 1) / (n + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        keep = _holds(parsed, lambda w: F.col(f"tf_{place[self.term(w)]}") > 0)
        return held.where(keep).crossJoin(F.broadcast(stats)).select("doc_id", score.alias("score"))


# queries: a word, or (operator, left, right); left is None where only a NOT is given

Query = str | tuple | None
_WORD = r"[\p{L}\p{N}\p{M}]+"


def parse(text: str) -> Query:
    """The tree of a query: words side by side belong together, then NOT, AND and OR in upper case bind in this order; operators without an operand are left out."""
    import regex

    parts = [w if w in ("AND", "OR", "NOT") else regex.findall(_WORD, w.lower()) for w in text.split()]
    groups: list = []  # runs of words, and operators
    for part in parts:
        if isinstance(part, str):
            groups.append(part)
        elif part:
            tree = _both(part)
            if groups and not isinstance(groups[-1], str):
                groups[-1] = [("and", groups[-1][0], tree)]
            else:
                groups.append([tree])

    def level(items: list, operators: tuple[str, ...]) -> Query:
        operator, *finer = operators
        pieces: list[list] = [[]]
        for item in items:
            if item == operator:
                pieces.append([])
            else:
                pieces[-1].append(item)
        if finer:
            trees = [t for t in (level(p, tuple(finer)) for p in pieces if p) if t is not None]
            return _joined(operator.lower(), trees)
        trees = [next((i[0] for i in p if isinstance(i, list)), None) for p in pieces]
        out, rest = trees[0], [t for t in trees[1:] if t is not None]
        for tree in rest:
            out = ("not", out, tree)
        return out

    return level(groups, ("OR", "AND", "NOT"))


def _both(words: list[str]) -> Query:
    return _joined("and", list(words))


def _joined(operator: str, trees: list) -> Query:
    out = trees[0] if trees else None
    for tree in trees[1:]:
        out = (operator, out, tree)
    return out


def words_of(query: Query) -> list[str]:
    if query is None:
        return []
    return [query] if isinstance(query, str) else words_of(query[1]) + words_of(query[2])


def _holds(query: Query, has):
    """The query's condition, given whether a word is there: a column, or plain booleans."""
    if isinstance(query, str):
        return has(query)
    operator, left, right = query
    a, b = True if left is None else _holds(left, has), _holds(right, has)
    negated = (not b) if isinstance(b, bool) else ~b
    if operator == "not":
        return negated if a is True else a & negated
    return a & b if operator == "and" else a | b


def top_k(scored: DataFrame, k: int, score: str = "score", key: str = "doc_id") -> DataFrame:
    return scored.orderBy(F.desc(score), key).limit(k)


# stemming

_VOWEL = re.compile(r"[aeiou]|(?<=[^aeiou])y")


def _shape(stem: str) -> str:
    """The stem as a string of c and v."""
    out = ""
    for i, ch in enumerate(stem):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("vc", re.sub(r"(.)\1+", r"\1", _shape(stem))))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _cvc(word: str) -> bool:
    return len(word) > 2 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


#: The suffix rules of Porter's algorithm (1980), steps 2 to 4.
_STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"),
    ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def porter(word: str) -> str:
    """Porter's stem of a lower-case English word; other words come back as they are."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        for suffix in ("ed", "ing"):
            stem = word[: -len(suffix)]
            if word.endswith(suffix) and "v" in _shape(stem):
                if stem.endswith(("at", "bl", "iz")):
                    word = stem + "e"
                elif _double(stem) and stem[-1] not in "lsz":
                    word = stem[:-1]
                else:
                    word = stem + "e" if _measure(stem) == 1 and _cvc(stem) else stem
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        for suffix, to in sorted(rules, key=lambda r: -len(r[0])):
            if word.endswith(suffix):
                word = word[: -len(suffix)] + to if _measure(word[: -len(suffix)]) else word
                break
    for suffix in sorted(_STEP4, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _cvc(word[:-1])):
            word = word[:-1]
    return word[:-1] if _double(word) and word.endswith("l") and _measure(word) > 1 else word


def stemmed(index: DataFrame) -> DataFrame:
    """Postings by stem; only distinct terms go through Python."""

    def stems(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(stem=[porter(t) for t in pdf["term"]])

    # few bytes but much work: over all cores, which adaptive execution would not give so small a table
    cores = index.sparkSession.sparkContext.defaultParallelism
    vocabulary = index.select("term").distinct().repartition(cores, "term").mapInPandas(stems, "term string, stem string")
    return index.join(vocabulary, "term").groupBy("stem", "doc_id", "col").agg(F.sum("tf").alias("tf"))
