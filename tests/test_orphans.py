from __future__ import annotations

import random

from siltstone.operators.dictionary import encode_keys
from siltstone.operators.orphans import orphan_references

REFS = "src_table string, row_id string, key string, at long, extra string"
DAY = 86_400_000


def run(spark, refs, parents, deleted, **more):
    out = orphan_references(
        spark.createDataFrame([(*r, "x") for r in refs], REFS), spark.createDataFrame(parents, "key string, created long"), spark.createDataFrame([(d,) for d in deleted], "key string"), **more
    )
    return sorted(tuple(r) for r in out.collect())


def brute(refs, parents, deleted):
    from datetime import UTC, datetime

    made = {}
    for k, c in parents:
        if k is not None:
            made.setdefault(k, []).append(c)
    out = set()
    for table, row, key, at in refs:
        if key is None:
            continue
        if key not in made:
            kind = "deleted" if key in deleted else "missing"
        else:
            known = [c for c in made[key] if c is not None]
            if at is None or not known or min(known) <= at:
                continue
            kind = "late"
        out.add((table, row, kind, None if at is None else datetime.fromtimestamp(at / 1000, UTC).strftime("%Y-%m")))
    return sorted(out, key=lambda r: tuple(map(str, r)))


def test_against_brute_force(spark):
    rng = random.Random(1)
    keys = [f"k{i}" for i in range(300)]
    parents = [(k, rng.choice([None, rng.randrange(900 * DAY)])) for k in keys[:200]]
    parents += parents[:20]
    refs = [(rng.choice(["a", "b"]), str(i), rng.choice([*keys, None, "k7"]), rng.choice([None, rng.randrange(900 * DAY)])) for i in range(2000)]
    refs += [("a", f"hot{i}", "hot", i * DAY) for i in range(900)] + refs[:50]  # a third of all rows name one key
    deleted = keys[190:260]
    got = run(spark, refs, parents, deleted, per_range=20)
    assert sorted(got, key=lambda r: tuple(map(str, r))) == brute(refs, parents, deleted)


def test_same_month_is_compared_by_time(spark):
    assert run(spark, [("a", "1", "k", 5), ("a", "2", "k", 9)], [("k", 7)], []) == [("a", "1", "late", "1970-01")]


def test_empty_tables(spark):
    assert run(spark, [], [("k", 1)], ["d"]) == []
    assert run(spark, [("a", "1", "k", 5)], [], []) == [("a", "1", "missing", "1970-01")]


def test_dictionary_is_dense_and_stable(spark):
    df = spark.createDataFrame([(f"x{i % 500}",) for i in range(1500)] + [(None,)], "key string")
    one = {r["key"]: r["code"] for r in encode_keys(df, per_range=100).collect()}
    two = {r["key"]: r["code"] for r in encode_keys(df.repartition(7), per_range=100).collect()}
    assert one == two and len(one) == 500 == len(set(one.values()))
