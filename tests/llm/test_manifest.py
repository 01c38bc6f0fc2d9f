"""Merkle manifest against a plain recursion, and its SQL."""

import random
import zlib
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from evigraph.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row)


def tree(leaves):
    """(top, the sibling digests of each leaf by level)."""
    paths, level, owners = [[] for _ in leaves], list(leaves), [[i] for i in range(len(leaves))]
    while len(level) > 1:
        up, up_owners = [], []
        for k in range(0, len(level), 16):
            run = level[k : k + 16]
            for j in range(len(run)):
                for i in owners[k + j]:
                    paths[i].append((run[:j], run[j + 1 :]))
            up.append(h(run))
            up_owners.append([i for o in owners[k : k + 16] for i in o])
        level, owners = up, up_owners
    return level[0], paths


def brute(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees, out = [], []
    for s in sources:
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees.append((own, *tree([leaf_of(r) for r in own])))
    root, top_paths = tree([t[1] for t in trees])
    for (own, subroot, paths), above in zip(trees, top_paths):
        for r, path in zip(own, paths):
            path = path + above
            now = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                now = (*r[:4], r[4].translate(str.maketrans(manifest.UPPER, manifest.LOWER)))
            folded = leaf_of(now)
            for left, right in path:
                folded = h([*left, folded, *right])
            out.append((r[0], leaf_of(r), subroot, root, h(x for left, right in path for x in left + right), folded, folded == root))
    return sorted(out, key=str)


def table(n, sources, seed):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice(sources), rnd.choice(["en", None]), rnd.choice([None, i]), rnd.choice([None, "", "Ünï", f"Text {i}", "no capitals"])) for i in range(n)]
    return rows + [(3, "b", "en", 1, "Other"), (3, "b", "en", 1, "Other"), (None, "b", None, None, None), (None, None, "x", 2, "A")]


@pytest.mark.parametrize("n,sources", [(0, ["b"]), (15, ["b"]), (300, ["b"]), (700, ["b", "c", "Z", "ä", None, ""]), (60, [f"s{i}" for i in range(40)])])
def test_manifest_like_recursion(spark, n, sources):
    rows = table(n, sources, n)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("leaf", F.lit(1)).withColumn("tree", F.lit("x"))
    got = sorted((tuple(r) for r in manifest.manifest(docs, manifest.lower_tampered()).collect()), key=str)
    want = brute(rows)
    assert got == want
    documents = spark.createDataFrame(rows, SCHEMA).toArrow()
    names = [f.split()[0] for f in manifest.RESULT.split(", ")]
    con = duckdb.connect()
    con.register("documents", documents)
    assert sorted(con.sql(manifest.ORACLE).select(*names).fetchall(), key=str) == want


def test_paths_prove_and_tampering_shows(spark):
    docs = spark.createDataFrame(table(50, ["a", "b"], 5), SCHEMA)
    rows = manifest.manifest(docs, with_path=True).collect()
    assert all(r["verified"] for r in rows)
    for r in rows:
        folded = r["leaf"]
        for side in r["path"]:
            folded = h([side["left"], folded, side["right"]])
        assert folded == r["root"]
    changed = manifest.manifest(docs, F.when(F.col("doc_id") == 7, F.lit("forged")).otherwise(F.col("text"))).collect()
    assert sorted(str(r["doc_id"]) for r in changed if not r["verified"]) == ["7"]


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(1, None, None, None, "x" * 3_000_000)], SCHEMA)
    (row,) = manifest.manifest(one).collect()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] and row["proof_sha256"] == sha256(b"").hexdigest()
    assert manifest.manifest(one.limit(0)).collect() == []


def test_a_run_that_lacks_a_child_is_an_error(spark):
    messages = spark.sparkContext.parallelize([((0, 0), (0, "a", 3, None)), ((0, 0), (2, "b", 3, None))])
    with pytest.raises(Exception, match="did not hear"):
        manifest._climb(messages, 2)[1].collect()
