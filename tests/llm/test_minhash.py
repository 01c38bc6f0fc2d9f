"""MinHash near-duplicates against all pairs, and components by alternating stars."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm import make, prose

from evigraph.llm import minhash
from evigraph.llm.components import star_components


def brute(texts, ids, percent=85):
    def shingled(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ")
        w = [x for x in w if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets, least = [shingled(t) for t in texts], list(range(len(texts)))

    def top(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if ids[i] is not None and ids[j] is not None and (ids[i] == ids[j] and sets[i] and sets[j] or common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common)):
                least[top(i)] = top(j)
    names = {}
    for i, d in enumerate(ids):
        if d is not None:
            names[top(i)] = min(names.get(top(i), d), d)
    out = [(d, len(sets[i]), names[top(i)] if d is not None and sets[i] else d) for i, d in enumerate(ids)]
    return sorted(((*x, None if x[0] is None else x[0] == x[2]) for x in out), key=str)


def edited(rnd, words, rate):
    return [f"new{rnd.randrange(10**6)}" if rnd.random() < rate else w for w in words]


@pytest.mark.parametrize("part", [256, 3])
def test_components_like_all_pairs(spark, monkeypatch, part):
    monkeypatch.setattr(minhash, "PART", part)
    rnd = random.Random(3)
    texts = []
    for _ in range(25):
        base = prose(rnd, rnd.choice((30, 120, 400))).split()
        texts += [" ".join(edited(rnd, base, rnd.choice((0, 0.003, 0.01, 0.015, 0.02, 0.05)))) for _ in range(rnd.choice((1, 2, 8, 14)))]
    # chains: each links with the next only
    chain = prose(rnd, 300).split()
    for _ in range(12):
        chain = edited(rnd, chain, 0.013)
        texts.append(" ".join(chain))
    passage = prose(rnd, 60)
    texts += [f"{prose(rnd, 15)} {passage} {prose(rnd, 15)}" for _ in range(40)]
    texts += [None, "", "  \n", "One two", "one TWO", "one three", "x " * 50, "x " * 60]
    ids = rnd.sample(range(1000), len(texts))
    got = minhash.components(make(spark, texts, ids).repartition(3)).collect()
    want = brute(texts, ids)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert sum(not w[3] for w in want) > 60


def test_rows_without_ids_of_one_id_and_no_rows(spark):
    rnd = random.Random(4)
    a, b, c = (prose(rnd, 40) for _ in range(3))
    texts, ids = [a, b, b, c, a, a, None, c, c], [1, 1, 2, 3, None, 4, 4, None, 3]
    docs = make(spark, texts, ids).withColumn("cid", F.lit("x")).withColumn("Drop", F.lit(1))
    got = minhash.components(docs).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(texts, ids)
    kept = minhash.keep_first(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "3", "3", "None", "None"]
    assert minhash.components(docs.limit(0)).collect() == []


def test_equal_digests_of_different_sets_are_told_apart(spark, monkeypatch):
    rnd = random.Random(5)
    texts = [prose(rnd, 30) for _ in range(6)]
    salts = []
    real = minhash.profiles

    def clash(docs, salt):
        salts.append(salt)
        rows = real(docs, salt)
        return rows.withColumn("cid", F.lit(1).cast("long")) if salt == 0 else rows

    monkeypatch.setattr(minhash, "profiles", clash)
    got = minhash.components(make(spark, texts)).collect()
    assert salts == [0, 1] and sorted((tuple(r) for r in got), key=str) == brute(texts, range(6))


def test_star_components(spark):
    rnd = random.Random(6)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1001 + i) for i in range(50)] + [(rnd.randrange(2000, 2100), rnd.randrange(2000, 2100)) for _ in range(70)] + [(5, 5), (7, 6), (7, 6)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        top[b] = a
    got = {r["node"]: r["comp"] for r in star_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for u, v in edges if u != v for x in (u, v)}
    assert star_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_minima_and_bounds():
    n, h, before = np.array([3, 0, 1]), np.array([5 << 32, 9 << 32, 2 << 32, 7 << 32], np.uint64), np.array([0, 3, 3, 4])
    a, b = minhash.universal_hashes()
    got = minhash.minima(n, h, before)
    for k in (0, 77, 149):
        values = [(int(x) * int(a[k]) + int(b[k])) % (1 << 32) for x in (5, 9, 2, 7)]
        assert got[0, k] == min(values[:3]) and got[2, k] == values[3]
    assert minhash.least_matches() < 0.85 * 150 - 5 * (150 * 0.85 * 0.15) ** 0.5


def test_likely_keeps_all_that_is_wanted(spark):
    rows, wanted = spark.range(20_000).withColumnRenamed("id", "rep"), spark.range(0, 20_000, 9).withColumnRenamed("id", "rep")
    near = minhash.likely(rows, wanted, "rep")
    assert near.join(wanted, "rep").count() == wanted.count() and near.count() < 1.1 * wanted.count()


def test_full_sets_count_distinct_shingles():
    (part,) = minhash.full_sets(pa.array(["a b c d e f", "a b c d e f a b c d e f", None, "x"]))
    assert part[1].tolist() == [2, 6, 0, 1]
