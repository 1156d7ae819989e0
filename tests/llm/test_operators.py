"""Operators on small tables against brute force, with nulls, blanks, copies, ties, empty tables and extra columns."""

from __future__ import annotations

import json
import random
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siltstone.llm import chunking, components, knn, language, leakage, minhash, mixing, queries, setjoin, terms

WORDS = [f"w{i}x{i * 7 % 31}" for i in range(300)]


def rows(df):
    return {tuple(r) for r in df.collect()}


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# 1

def near_texts():
    rng = random.Random(7)
    out = [(None, prose(rng, 60)), ("null", None), ("blank", "  "), ("short", "abc")]
    hot = prose(rng, 70)
    out += [(f"hot{i}", hot) for i in range(12)]  # a third are copies
    for i in range(8):
        words = prose(rng, 80).split()
        out.append((f"a{i}", " ".join(words)))
        for j in range(3):
            changed = list(words)
            for at in rng.sample(range(80), 1 + 3 * j):
                changed[at] = "changed"
            out.append((f"a{i}v{j}", ("  " if j else "\t").join(changed).upper()))
    return [(k, t, "x", 1) for k, t in out + out[:3] + out[20:24]]


def test_near_duplicates(spark):
    data = near_texts()
    df = spark.createDataFrame(data, "id string, text string, class_id string, sig int")
    members, pairs = minhash.near_duplicates(df, "id", "text")
    norm = lambda t: re.sub(r"\s+", " ", t.lower()).strip()
    kept = {(k, norm(t)) for k, t, *_ in data if k and t and len(norm(t)) >= 200}
    expected = {(a, b) for a, x in kept for b, y in kept if a < b and minhash.window_jaccard(x, y, 16) >= 0.6}
    assert rows(minhash.expand_pairs(members, pairs)) == expected and len(expected) > 80
    assert members.count() == len(kept)
    assert all(a < b and s >= 0.6 for a, b, s in rows(pairs))


def test_near_duplicates_of_nothing(spark):
    members, pairs = minhash.near_duplicates(spark.createDataFrame([], "id string, text string"), "id", "text")
    assert members.count() == 0 and pairs.count() == 0


# 2

def brute_counts(lists, most):
    occurrences, records = Counter(), defaultdict(set)
    for n, terms_ in enumerate(lists):
        terms_ = [t for t in terms_ or [] if t is not None]
        for i in range(len(terms_)):
            for k in range(1, most + 1):
                if i + k <= len(terms_):
                    gram = tuple(terms_[i : i + k])
                    occurrences[gram] += 1
                    records[gram].add(n)
    return {(g, len(g), c, len(records[g])) for g, c in occurrences.items()}


@pytest.mark.parametrize("most", [1, 2, 4])
def test_ngram_counts(spark, most):
    rng = random.Random(most)
    lists = [[rng.choice(["hot", "hot", "a", "b", "c", "d", None]) for _ in range(rng.randrange(7))] for _ in range(200)] + [None, []]
    df = spark.createDataFrame([(x, "y") for x in lists], "terms array<string>, gram string")
    got = {(tuple(g), n, o, r) for g, n, o, r in (tuple(x) for x in terms.ngram_counts(df, "terms", max_terms=most).collect())}
    assert got == brute_counts(lists, most)


def test_marks_and_empty(spark):
    df = spark.createDataFrame([(["a", "a"],), (["a", "b"],), (["a"],)] + [([],)] * 9, "terms array<string>")
    marked = terms.marked_terms(terms.ngram_counts(df, "terms"), df.agg(F.count("*").alias("n_ids")))
    assert {(r["gram"][0], r["occurrences"], r["records"], r["mark"]) for r in marked.collect()} == {("a", 4, 3, "common"), ("b", 1, 1, "rare")}
    assert terms.ngram_counts(df.limit(0), "terms", max_terms=2).count() == 0


def test_suffixes_are_counted_by_the_stack(spark):
    df = spark.createDataFrame([(["a", "b", "a"],), (["b"],), (["a"],)] * 50, "terms array<string>").repartition(3)
    counts = terms.ngram_counts(df, "terms", max_terms=2)
    plan = counts._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("MapInPandas") == 1 and "keys=[suffix" not in plan  # no aggregation of suffixes beside the stack
    assert {("|".join(g), o, r) for g, _, o, r in counts.collect()} == {("a", 150, 100), ("b", 100, 100), ("a|b", 50, 50), ("b|a", 50, 50)}
    batches = [pd.DataFrame({"terms": [list(t)]}) for t in ("bab", "a")]
    held = [{("".join(s), n, f1, f2) for s, n, f1, f2 in f.itertuples(index=False)} for f in terms._suffixes(2, 2)(iter(batches))]
    assert held == [{("ba", 1, 1, 1), ("ab", 1, 1, 1), ("b", 1, 0, 0)}, {("a", 1, 1, 0)}]


# 4

@pytest.mark.parametrize("bounds", [{}, {"max_links": 60}, {"max_links": 12}])
def test_groups(spark, bounds):
    rng = random.Random(5)
    links = [(f"n{rng.randrange(150)}", f"n{rng.randrange(150)}") for _ in range(90)]
    links += [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)] + [("hub", f"s{i}") for i in range(60)] + [("self", "self"), (None, "x"), ("y", None)]
    links += links[:10]
    got = dict(rows(components.group_ids(spark.createDataFrame([(*x, 1) for x in links], "a string, b string, key int"), "a", "b", **bounds)))
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a and b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent}


def test_merging_in_levels(spark):
    """Chains in key order, disjoint pairs and a hub: several levels of bounded merges, nothing put into one task before it fits."""
    chains = [(100_000 + 50 * c + i, 100_000 + 50 * c + i + 1) for c in range(60) for i in range(49)]
    pairs = [(10 * i, 10 * i + 1) for i in range(3000)]
    hub = [(7, 1_000_000 + i) for i in range(2500)]
    links = chains + pairs + hub
    levels: list[int] = []
    got = dict(rows(components.components(spark.createDataFrame(links, "u long, v long").repartition(6), max_links=1000, levels=levels)))
    assert len(levels) >= 3 and levels[-1] == 1 and sorted(levels, reverse=True) == levels
    root = lambda x: got.get(x, x)
    assert all(root(a) == root(b) for a, b in links) and all(root(root(x)) == root(x) for x in got)
    assert len({root(x) for link in links for x in link}) == 60 + 3000 + 1
    assert len(got) == 60 * 49 + 3000 + 2500


def test_the_log_in_three_levels_and_in_one(spark):
    log = spark.read.parquet("/root/testdata/sf0.1/supersede_log.parquet").select(*(queries.norm_key(F.col(c)).alias(c) for c in ("old_id", "new_id")))
    pairs = {tuple(r) for r in log.where("old_id is not null and new_id is not null and old_id <> new_id").collect()}
    number = {k: i for i, k in enumerate(sorted({k for p in pairs for k in p}))}
    links = spark.createDataFrame([(number[a], number[b]) for a, b in sorted(pairs)], "u long, v long")
    levels: list[int] = []
    deep = dict(rows(components.components(links.repartition(60), max_links=60, levels=levels)))
    flat = dict(rows(components.components(links)))
    assert len(levels) >= 3 and levels[0] > 20 and deep == flat and len(deep) > 3000


def test_groups_of_nothing(spark):
    assert components.group_ids(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


# 5

def test_chunks(spark):
    data = [("a", "x\r\n" * 900, 1), ("a", "x\r\n" * 900, 2), ("b", "y" * 2001, 1), ("c", "z" * 2000, 1), ("d", None, 1), ("e", "", 1), (None, "w " * 1500, 1), ("f", ("p " * 900 + "\n\n") * 3, 1)]
    got = chunking.chunks(spark.createDataFrame(data, "id string, text string, piece int"), ["id"], "text").toPandas()
    bodies = {k: t.replace("\r\n", "\n") for k, t, _ in data if t and len(t) > 2000}
    assert {k if isinstance(k, str) else None for k in got["id"]} == set(bodies)
    for key, body in bodies.items():
        own = got[got["id"].isna() if key is None else got["id"] == key].sort_values("piece_no")
        assert "".join(body[n:e] for n, e in zip(own["new_from"], own["end"], strict=True)) == body
        assert all(p == body[s:e] and len(p) <= 2000 for s, e, p in zip(own["start"], own["end"], own["piece"], strict=True))
    assert dict(zip(got["id"].fillna("-"), got["boundary"], strict=True)) == {"a": "paragraph", "b": "hard", "-": "word", "f": "paragraph"}
    assert chunking.chunks(spark.createDataFrame([], "id string, text string"), ["id"], "text").count() == 0


# 6

def test_most_similar(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((40, 24))
    data = []
    for i in range(600):
        v = centres[i % 40] + rng.standard_normal(24) * 0.4
        data.append(("m" if i % 3 else "n", f"v{i:03}", (v * rng.uniform(0.5, 2)).astype(np.float32).tolist(), 1))
    data += [("m", f"copy{i:02}", data[1][2], 1) for i in range(30)] + data[:5]
    bad = [("m", "null", None, 1), ("m", "zero", [0.0] * 24, 1), ("m", "nan", [float("nan")] * 24, 1), ("m", "short", [1.0] * 12, 1), ("m", None, data[0][2], 1), (None, "x", data[0][2], 1)]
    df = spark.createDataFrame(data + bad, "model string, id string, vector array<float>, score int")
    usable = knn.usable_vectors(df, F.col("model"), F.col("id"), F.col("vector"))
    assert usable.count() == 630
    found = knn.most_similar(usable, k=10, block=64).collect()
    by = {(m, i): np.array(v, float) / np.linalg.norm(v) for m, i, v, _ in data}
    hits = total = 0
    got = defaultdict(list)
    for m, i, n, s, rank in found:
        assert s == pytest.approx(float(by[m, i] @ by[m, n]), abs=1e-6) and i != n
        got[m, i].append((rank, n))
    for (m, i), v in by.items():
        order = sorted(((-round(float(v @ w), 9), n) for (mm, n), w in by.items() if mm == m and n != i))[:10]
        hits += len({n for _, n in order} & {n for _, n in got[m, i]})
        total += 10
        assert [r for r, _ in sorted(got[m, i])] == list(range(1, len(got[m, i]) + 1))
    assert hits / total >= 0.97
    assert [n for _, n in sorted(got["m", "copy00"])] == [f"copy{i:02}" for i in range(1, 11)]


def test_embeddings_recall_on_the_table_itself(spark):
    folder = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    ids, x = table["vec_id"].to_numpy(), knn.unit(np.stack(table["embedding"].to_numpy()))
    got = defaultdict(set)
    for r in queries.p6_embeddings(spark, folder).collect():
        got[r["id"]].add(r["neighbour"])
    hits = total = 0
    for i in np.nonzero(ids % 20 == 0)[0]:
        score = x @ x[i]
        score[i] = -2
        hits += len(got[ids[i]] & set(ids[np.argsort(-score)[:10]]))
        total += 10
    print("recall", hits / total)
    assert total == 1000 and hits / total >= 0.95


def test_probes_grow_to_the_recall_asked_for(spark):
    rng = np.random.default_rng(5)
    x = knn.unit(rng.standard_normal((1500, 24)))  # no clusters at all
    x = np.concatenate([x, knn.unit(x[:500] + rng.standard_normal((500, 24)) * 0.13)])  # and near copies at about 0.84
    df = spark.createDataFrame([("m", i, v.tolist()) for i, v in enumerate(x)], "model string, id long, vector array<float>")
    score = x @ x.T
    np.fill_diagonal(score, -2)
    best = np.argsort(-score, axis=1)[:, :10]
    true = {(i, int(j)) for i in range(len(x)) for j in best[i] if score[i, j] >= 0.8}
    found = {k: {(i, j) for _, i, j, *_ in knn.most_similar(df, k=10, min_score=0.8, probes=2, **k_).collect()} for k, k_ in (("fixed", {}), ("measured", {"recall": 0.99, "recall_sample": 2000}))}
    assert len(true) > 500 and len(true & found["fixed"]) < 0.9 * len(true) and len(true & found["measured"]) >= 0.985 * len(true)


def test_few_vectors_with_very_many_copies(spark):
    """Five distinct vectors in 400,000 rows: cells are fitted on distinct vectors, and copies rank by id."""
    base = np.random.default_rng(3).standard_normal((5, 16)).round(3)
    table = spark.createDataFrame([(j, v.tolist()) for j, v in enumerate(base)], "j int, vector array<double>")
    df = spark.range(400_000).withColumn("j", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5).cast("int")).join(F.broadcast(table), "j").select(F.lit("m").alias("model"), "id", "vector")
    usable = knn.usable_vectors(df, F.col("model"), F.col("id"), F.col("vector"), distinct=False)
    asked = spark.createDataFrame([("m", 0), ("m", 1), ("m", 6)], "model string, id long")
    got = defaultdict(list)
    for r in knn.most_similar(usable, asked, k=10).collect():
        got[r["id"]].append((r["rank"], r["neighbour"], round(r["score"], 9)))
    home = lambda i: 0 if i % 3 == 0 else i % 5
    for i in (0, 1, 6):
        same = [j for j in range(200) if home(j) == home(i) and j != i][:10]
        assert sorted(got[i]) == [(n + 1, j, 1.0) for n, j in enumerate(same)]


def test_most_similar_of_nothing(spark):
    df = spark.createDataFrame([], "model string, id string, vector array<float>")
    assert knn.most_similar(knn.usable_vectors(df, F.col("model"), F.col("id"), F.col("vector"))).count() == 0


# 7

def test_similar_sets(spark):
    rng = random.Random(9)
    data = [(f"hot{i}", [f"t{j}" for j in range(6)], 0) for i in range(40)] + [("null", None, 0), (None, ["a", "b", "c", "d", "e"], 0), ("few", ["a", "b"], 0), ("rep", ["a", "a", "b", "c", "d", None], 0)]
    for i in range(60):
        base = [f"t{rng.randrange(25)}" for _ in range(rng.randrange(5, 12))]
        data.append((f"s{i}", base, 0))
        data.append((f"s{i}b", base[: rng.randrange(4, len(base))] + ["q"][: rng.randrange(2)], 0))
    data += data[:4]
    members, pairs = setjoin.similar_sets(spark.createDataFrame(data, "id string, terms array<string>, class_id int"), "id", "terms")
    sets = {(i, frozenset(t for t in x if t is not None)) for i, x, _ in data if i and x}
    sets = [(i, s) for i, s in sets if len(s) >= 5]
    expected = {(a, b) for a, x in sets for b, y in sets if a < b and 4 * len(x & y) >= 3 * len(x | y)}
    assert rows(minhash.expand_pairs(members, pairs)) == expected
    members, pairs = setjoin.similar_sets(spark.createDataFrame([], "id string, terms array<string>"), "id", "terms")
    assert members.count() == 0 and pairs.count() == 0


# 8

def test_leaks(spark):
    rng = random.Random(11)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(20)) if i % 2 else "".join(rng.choice("กขคงจฉชซ ") for _ in range(160)), "x") for i in range(12)]
    items += [(90, None, "x"), (None, items[0][1], "x"), (91, "tiny", "x"), items[1]]
    docs = [(1000, None, "x"), (1001, "", "x"), (1002, "aaaa" * 200, "x")]
    for d in range(150):
        body = prose(rng, 40)
        if d % 3 == 0:  # a third of all documents hold item 1
            body += "\n" + items[1][1].upper().replace(" ", " - ") + ", " + prose(rng, 10)
        if d % 7 == 0:
            own = items[rng.randrange(12)][1]
            cut = rng.randrange(20, 90)
            body = own[10 : 10 + cut] + body
        docs.append((d, body, "x"))
    docs += docs[5:8]

    def reduce(t):
        return "".join(c for c in t.lower() if unicodedata.category(c)[0] in "LN")

    grams = defaultdict(set)
    for i, t, _ in items:
        if i is not None and t:
            r = reduce(t)
            for j in range(len(r) - 49):
                grams[r[j : j + 50]].add(i)
    expected = {(d, i) for d, t, _ in docs if t for r in [reduce(t)] for j in range(len(r) - 49) for i in grams.get(r[j : j + 50], ())}
    c = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    e = spark.createDataFrame(items, "item_id long, text string, doc_id string")
    for bits in (1 << 28, 1 << 10):  # the second filter is far too small, which only costs work
        got = leakage.leaks(c, "doc_id", "text", e, "item_id", "text", filter_bits=bits)
        assert rows(got.select("doc_id", "item_id")) == expected
    texts, tests = defaultdict(list), defaultdict(list)
    for d, t, _ in docs:
        texts[d].append(reduce(t or ""))
    for i, t, _ in items:
        tests[i].append(reduce(t or ""))

    def longest(d, i):
        return max(n for x in texts[d] for y in tests[i] for j in range(len(y)) for n in range(len(y) - j + 1) if y[j : j + n] in x)

    for r in got.limit(15).collect():
        assert r["run"] == longest(r["doc_id"], r["item_id"])
    assert len(expected) > 50
    assert leakage.leaks(c.limit(0), "doc_id", "text", e, "item_id", "text").count() == 0
    assert leakage.leaks(c, "doc_id", "text", e.limit(0), "item_id", "text").count() == 0


# 9

def test_mixture(spark):
    rng = random.Random(13)
    docs = [(i, prose(rng, rng.randrange(1, 30)), rng.choice([" A", "a", "a", "B ", "c", None, "other"])) for i in range(400)]
    docs += [(500, None, "a"), (501, "", "b"), (502, prose(rng, 2000), "big")]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, source string, tokens int")
    targets = spark.createDataFrame([("a", 0.2, 2), ("b", 0.3, 3), ("C", 0.6, 2), ("none", 0.1, 5), ("big", 0.0, 1), ("a", 0.2, 2)], "source string, target_share double, max_repeats int")
    mixture, shares = mixing.mix(df, "doc_id", "text", "source", targets)
    sizes = {r["doc_id"]: r["tokens"] for r in mixing.token_counts(df.select("doc_id", "text"), "text", "tokens").collect()}
    total = sum(sizes.values())
    out = {r["source"]: r for r in shares.collect()}
    used = mixture.collect()
    most = {"a": 2, "b": 3, "c": 2, "none": 5, "big": 1}
    assert all(1 <= r["repeats"] <= most[r["source"]] for r in used)
    for s, share in {"a": 0.2, "b": 0.3, "c": 0.6, "none": 0.1, "big": 0.0}.items():
        own = [i for i, _, x in docs if x and x.strip().lower() == s]
        have = sum(sizes[i] for i in own)
        reached = sum(r["repeats"] * r["tokens"] for r in used if r["source"] == s)
        assert out[s]["reached"] == reached and out[s]["available"] == have
        assert out[s]["short"] == (have * most[s] < share * total)
        if out[s]["short"]:
            assert reached == have * most[s]
        else:  # short of the budget by less than one record
            assert 0 <= share * total - reached <= max(sizes[i] for i in own) + 1
    assert mixing.mix(df.limit(0), "doc_id", "text", "source", targets)[1].where("not short and target_share > 0").count() == 0


# 10

SENTENCES = {
    "en": "The small index keeps every record of the morning session. Nobody knew why the old list was lost. ",
    "de": "Das kleine Verzeichnis behält jeden Eintrag der Sitzung am Morgen. Niemand wusste, warum die alte Liste fehlte. ",
    "fr": "Le petit index garde chaque fiche de la séance du matin. Personne ne savait pourquoi la vieille liste manquait. ",
    "th": "ดัชนีขนาดเล็กเก็บทุกรายการของการประชุมตอนเช้า ไม่มีใครรู้ว่าทำไมรายการเก่าหายไป ",
}


def language_rows():
    rng = random.Random(17)

    def text(code, n):
        words = SENTENCES[code].split(" ")
        return " ".join(" ".join(rng.sample(words, len(words))) + "." for _ in range(n))

    data = []
    for i in range(240):
        code = list(SENTENCES)[i % 4]
        label = {0: code, 1: code.upper() + "-XX", 2: {"en": "English", "de": "deu", "fr": "French", "th": " tha "}[code]}.get(i % 12 // 4, code)
        data.append((i, text(code, 4), "fr" if i % 40 == 4 else label))
    mixed = [(1000 + i, text("en", 3) + "\n" + text("de", 3), "unknown") for i in range(6)]
    rest = [(2000, None, "en"), (2001, "", None), (2002, "short", "en"), (2003, text("de", 3) + "\n```\n" + text("en", 30) + "\n```\n", None)]
    return data, mixed, rest


def test_languages(spark):
    data, mixed, rest = language_rows()
    df = spark.createDataFrame([(*d, 1) for d in data + mixed + rest], "doc_id long, text string, label string, letters int")
    params = language.fit_sample(df, "doc_id", "text", "label")
    found = language.document_languages(df, ["doc_id"], "text", params).collect()
    own = defaultdict(set)
    for r in found:
        own[r["doc_id"]].add(r["lang"])
        assert 0 < r["confidence"] <= 1 and r["languages"] == sum(1 for x in found if x["doc_id"] == r["doc_id"])
    right = sum(own[i] == {list(SENTENCES)[i % 4]} for i, _, _ in data)
    assert right >= 0.97 * len(data)
    assert sum(own[i] == {"en", "de"} for i, _, _ in mixed) >= 5
    assert own[2003] == {"de"} and not own.keys() & {2000, 2001, 2002}
    parts = language.stretches(df.where("doc_id = 1000"), ["doc_id"], "text", params).orderBy("start").collect()
    assert all(a["end"] <= b["start"] for a, b in zip(parts, parts[1:], strict=False)) and parts[0]["lang"] == "en" and parts[-1]["lang"] == "de"


def test_planted_stretches(spark):
    """Texts that change language at known places: nearly every letter is in a stretch of its own language."""
    data, _, _ = language_rows()
    params = language.fit_sample(spark.createDataFrame(data, "doc_id long, text string, label string"), "doc_id", "text", "label")
    rng = random.Random(23)
    planted = {}
    for i in range(30):
        parts = [(code, SENTENCES[code] * rng.randrange(1, 4)) for code in rng.choices(list(SENTENCES), k=5)]
        planted[i] = parts
    df = spark.createDataFrame([(i, "".join(t for _, t in parts)) for i, parts in planted.items()], "doc_id long, text string")
    right = total = 0
    got = defaultdict(list)
    for r in language.stretches(df, ["doc_id"], "text", params).collect():
        got[r["doc_id"]].append((r["start"], r["end"], r["lang"]))
    for i, parts in planted.items():
        truth = [code for code, t in parts for _ in t]
        body = "".join(t for _, t in parts)
        said = [None] * len(body)
        for start, end, code in got[i]:
            said[start:end] = [code] * (end - start)
        right += sum(c.isalpha() and x == y for c, x, y in zip(body, said, truth, strict=True))
        total += sum(c.isalpha() for c in body)
    assert right >= 0.97 * total


def test_languages_without_labels(spark):
    df = spark.createDataFrame([(1, "text " * 50, None)], "doc_id long, text string, label string")
    params = language.fit_sample(df, "doc_id", "text", "label")
    assert params is None and language.document_languages(df, ["doc_id"], "text", params).count() == 0
    assert language.stretches(df, ["doc_id"], "text", params).count() == 0


def test_labels(spark):
    df = spark.createDataFrame([(x,) for x in ["EN", " en", "en-US", "eng", "English", "pt_br", "xx", "und", "", None, "german "]], "l string")
    assert [r[0] for r in df.select(language.label_language(F.col("l"))).collect()] == ["en"] * 5 + ["pt", None, None, None, None, "de"]


def test_registered_queries_state_their_sql():
    from siltstone.llm.queries import oracle_sql, queries

    assert set(oracle_sql()) <= set(queries()) and json.dumps(sorted(queries()))
