"""Queries on small tables whose keys go beyond those of the smallest scale factors."""

import itertools

from evigraph.plans import catalogue


def stored(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_co_neighbors_takes_all_suppliers(spark, tmp_path):
    nations = [(n, n % 3) for n in range(7)]
    suppliers = [(k, k % 7) for k in (1, 5, 150, 200, 201, 202, 350, 999, 1000, 123456789)]
    d = stored(spark, tmp_path, nation=(nations, "n_nationkey int, n_regionkey int"), supplier=(suppliers, "s_suppkey long, s_nationkey int"))
    want = {(a, b, 1) for (a, x), (b, y) in itertools.combinations(suppliers, 2) if dict(nations)[x] == dict(nations)[y]}
    assert {tuple(r) for r in catalogue.QUERIES["co_neighbors"](spark, d).select("a", "b", "n").collect()} == want


def test_reference_resolve_takes_all_items_and_chunks(spark, tmp_path):
    items = [(1, "nothing"), (2, "see TABLE 48, table 48"), (3, "table 48"), (44, ""), (45, None), (46, "Table 48 table 48"), (199, "x")]
    turns = [(c, 0) for c in (1, 44, 45, 46, 47, 48, 98)]
    d = stored(spark, tmp_path, benchmark=(items, "item_id long, text string"), conversations=(turns, "conv_id long, turn long"))
    got = {r["conv_id"]: r["target"] for r in catalogue.QUERIES["reference_resolve"](spark, d).collect()}
    assert got == {1: 1, 44: 44, 45: 45, 46: 46, 47: None, 48: 2, 98: 2}
