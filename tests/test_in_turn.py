"""Names resolved in turn, and properties written in turn, against plain loops."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from evigraph.operators import builder, resolve


def plain(uses, known):
    """The ids of mentions taken one by one: (doc, name, at) -> id, and the new ids of each document in order."""
    out, made, there = {}, [], {}
    for doc, ident, name, _ in sorted(known, key=lambda r: r[3]):
        there.setdefault(doc, []).append((name, ident))
    for doc, name, at in sorted(uses, key=lambda r: (r[2], r[1])):
        have, best = there.setdefault(doc, []), None
        q = name.lower().strip()
        for other, ident in have:
            k = other.lower().strip()
            score = 1.0 if q == k else SequenceMatcher(None, q, k).ratio()
            if score >= 0.85 and (best is None or score > best[0]):
                best = (score, ident)
        if best is None and "x" in q:
            ident = "n:" + q.replace(" ", "_")
            if ident not in [i for _, i in have]:
                have.append((name, ident))
                made.append((doc, ident, name, at))
            best = (1, ident)
        out[doc, name, at] = best and best[1]
    return out, made


def word(rnd):
    base = rnd.choice(["renal toxicity x", "renal toxin x", "xab", "xabc", "xabcd", "hepatic pain x", "no kind at all", "aa", "x", "bx y", "bx_y"])
    w = list(base)
    for _ in range(rnd.choice((0, 0, 1, 1, 2))):
        k = rnd.randrange(len(w) + 1)
        if rnd.random() < 0.5 and k < len(w):
            w[k] = rnd.choice("abcx ")
        else:
            w.insert(k, rnd.choice("abcxX"))
    out = "".join(w).strip()
    return out.upper() if rnd.random() < 0.2 else out or "x"


@pytest.mark.parametrize("seed", range(2))
def test_names_in_turn_like_a_loop(spark, seed):
    rnd = random.Random(seed)
    uses = [(doc, word(rnd), at) for doc in range(12) for at in range(rnd.randrange(1, 60))]
    known = [(doc, f"k{doc}_{i}", word(rnd), i) for doc in range(0, 12, 2) for i in range(3)]
    q = spark.createDataFrame(uses, "doc_id long, name string, at long")
    k = spark.createDataFrame(known, "doc_id long, id string, name string, seq long")
    low = F.lower(F.trim("name"))
    ids, new = resolve.resolve_in_turn(q, k, F.when(F.contains(low, F.lit("x")), "n"), F.concat(F.lit("n:"), F.replace(low, F.lit(" "), F.lit("_"))))
    want, made = plain(uses, known)
    assert {(r["doc_id"], r["name"], r["at"]): r["id"] for r in ids.collect()} == want
    assert sorted((r["doc_id"], r["id"], r["name"], r["at"]) for r in new.collect()) == sorted(made)
    assert len({n for _, n, *_ in made}) > 20


def test_names_in_turn_of_nothing(spark):
    q = spark.createDataFrame([(1, None, 0)], "doc_id long, name string, at long")
    k = spark.createDataFrame([], "doc_id long, id string, name string, seq long")
    ids, new = resolve.resolve_in_turn(q, k, F.lit("n"), F.col("name"))
    assert [r["id"] for r in ids.collect()] == [None] and new.count() == 0
    assert resolve.resolve_in_turn(q.limit(0), k, F.lit("n"), F.col("name"))[0].count() == 0


def test_similar_finds_all_pairs(spark):
    rnd = random.Random(9)
    names = sorted({word(rnd) for _ in range(150)})
    for threshold in (0.85, 0.7, 0.6):
        df = spark.createDataFrame([(n,) for n in names], "name string")
        got = {(r["name"], r["known"]): r["score"] for r in resolve.similar(df, df.withColumnRenamed("name", "known"), threshold).collect()}
        want = {}
        for a in names:
            for b in names:
                x, y = a.lower().strip(), b.lower().strip()
                score = SequenceMatcher(None, x, y).ratio()
                if score >= threshold:
                    want[a, b] = score
        assert got == want


def test_properties_in_turn(spark):
    nodes = spark.createDataFrame([(1, "a", "A", "Drug", {"p": "old", "q": ""}, 1)], "doc_id long, id string, name string, type string, properties map<string,string>, seq long")
    kind = "doc_id long, id string, key string, value string, adds boolean, at struct<stage: int, i: long>"
    rows = [("p", "1", True, 1), ("p", "2", True, 2), ("q", "x", True, 1), ("r", "1", False, 1), ("r", "2", False, 3), ("r", "3", True, 2), ("r", "4", True, 4), ("s", "1", True, 2), ("s", "0", True, 1)]
    got = builder._written(nodes, spark.createDataFrame([(1, "a", k, v, adds, (6, i)) for k, v, adds, i in rows], kind)).first()["properties"]
    assert got == {"p": "old; 1; 2", "q": "; x", "r": "2; 4", "s": "0; 1"}
