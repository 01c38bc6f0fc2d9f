"""Services that fail: only what failed is asked again, what is refused never, and what stays failed has another way."""

import zlib
from pathlib import Path

import pytest

from evigraph import providers
from evigraph.functions import text as X


def service(log, fails, refuses=lambda r: False):
    """Answers with the row's text in capitals; each row asked about is a line of a file. ``fails`` is told the row and how often it was asked about."""

    def call(rows):
        out = []
        for r in rows:
            at = Path(log) / f"{r['id']}"
            n = len(at.read_text()) if at.exists() else 0
            at.write_text("x" * (n + 1))
            if refuses(r):
                raise ValueError("content_filter: no")
            if fails(r, n):
                raise RuntimeError("429 later")
            out.append(r["text"].upper())
        return out

    return call


def test_only_failed_rows_are_asked_again(spark, tmp_path):
    (tmp_path / "log").mkdir()
    df = spark.createDataFrame([(i, f"t{i}") for i in range(60)], "id long, text string").repartition(3)
    often = lambda i: zlib.crc32(str(i).encode()) % 4
    call, waits = service(tmp_path / "log", lambda r, n: n < often(r["id"]), lambda r: r["id"] % 20 == 7), []
    got = providers.driven(df, call, f"file://{tmp_path}/asked", size=1, tries=5, wait=2.0, sleep=waits.append)
    plain = {i: f"T{i}" for i in range(60) if i % 20 != 7}
    assert {r["id"]: r["response"] for r in got.answered.collect()} == plain
    assert sorted(r["id"] for r in got.refused.collect()) == [7, 27, 47] and got.failed.count() == 0
    asked = {i: len((tmp_path / "log" / str(i)).read_text()) for i in range(60)}
    assert asked == {i: 1 if i % 20 == 7 else often(i) + 1 for i in range(60)}
    assert len(waits) == 3 and all(2 * n <= w <= 2 * n + 1 for n, w in enumerate(waits, 1))
    # taken up again: nothing is asked about
    again = providers.driven(df, call, f"file://{tmp_path}/asked", size=1, sleep=waits.append)
    assert again.answered.count() == 57 and {i: len((tmp_path / "log" / str(i)).read_text()) for i in range(60)} == asked


def test_what_stays_failed(spark, tmp_path):
    (tmp_path / "log").mkdir()
    df = spark.createDataFrame([(i, "t") for i in range(6)], "id long, text string")
    got = providers.driven(df, service(tmp_path / "log", lambda r, n: r["id"] == 3), size=1, tries=2, sleep=lambda s: None)
    assert [r["id"] for r in got.failed.collect()] == [3] and got.answered.count() == 5
    assert providers.driven(df.limit(0), service(tmp_path / "log", lambda r, n: True), sleep=lambda s: None).answered.count() == 0


@pytest.mark.parametrize("bad", [None, 2])
def test_documents_without_vectors_are_cut_by_size(spark, bad):
    text = "\n\n".join(f"Paragraph {i} " + "word " * 150 for i in range(8))
    docs = spark.createDataFrame([(d, text) for d in (1, 2)], "doc_id long, text string")

    def embed(rows):
        if any(r["doc_id"] == bad and r["paragraph_index"] == 5 for r in rows):
            raise RuntimeError("down")
        return ["[1.0, 0.0]" if r["paragraph_index"] < 4 else "[0.0, 1.0]" for r in rows]

    got = providers.chunks(docs, "doc_id", "text", embed, size=1, tries=2, sleep=lambda s: None).collect()
    own = {d: sorted((r["chunk_index"], r["content"]) for r in got if r["doc_id"] == d) for d in (1, 2)}
    fixed = [(r["chunk_index"], r["content"]) for r in X.fixed_chunks(docs.where("doc_id = 2"), "doc_id", "text").orderBy("chunk_index").collect()]
    assert own[1] != fixed and (own[2] == (own[1] if bad is None else fixed))
