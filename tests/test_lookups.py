"""Chunks by section and index, answers by query, glimpses of files."""

from evigraph.operators import resolve, retrieval
from evigraph.sources import tabular


def test_chunks_by_section_and_index(spark):
    chunks = spark.createDataFrame([(1, 0, "A"), (1, 1, "B"), (2, 0, None), (2, -1, "A"), (None, 1, "A")], "doc_id long, chunk_index int, section string")
    places = lambda df: sorted((r[0] or 0, r[1]) for r in df.collect())
    assert places(retrieval.by_section(chunks, "A")) == [(0, 1), (1, 0), (2, -1)] and retrieval.by_section(chunks, "a").count() == 0
    assert places(retrieval.by_index(chunks, 1)) == [(0, 1), (1, 1)] and retrieval.by_index(chunks, -1).count() == 0 and retrieval.by_index(chunks.limit(0), 0).count() == 0


def test_answers_by_query(spark):
    rows = spark.createDataFrame([(1, "  Which Drug?\n"), (2, "which drug"), (3, None), (1, "  Which Drug?\n")], "i int, query string")
    got = resolve.answered_queries(rows, {"which drug?": "drug", "WHICH DRUG? ": "other"})
    assert sorted((r["i"], r["field"]) for r in got.collect()) == [(1, "drug"), (1, "drug")]
    assert resolve.answered_queries(rows, {}).count() == 0


def test_glimpses(spark, tmp_path):
    (tmp_path / "a").write_text("x,y\n1,2\n3,4\n")
    (tmp_path / "b").write_text("x\ty\n1\t2\n")
    got = {r["file"].rsplit("/", 1)[1]: r for r in tabular.glimpses(spark, [str(tmp_path / f) for f in ("a", "b", "none")]).collect()}
    assert (got["a"]["method"], got["a"]["columns"], got["a"]["n"]) == ("csv", ["x", "y"], 2) and got["b"]["method"] == "tsv" and got["none"]["error"] and got["none"]["n"] is None
