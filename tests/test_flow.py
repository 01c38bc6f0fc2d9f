"""Steps kept by content: what is there is read, what changed is done anew with all that needs it, a stopped run is taken up."""

import pytest
from pyspark.sql import functions as F

from evigraph.operators import documents, flow
from evigraph.operators.flow import Flow, Step


def made(f, run):
    return [(r["step"], r["status"]) for r in f.progress().where(F.col("session") == run).orderBy("at").collect()]


def steps(calls, fail=()):
    def run(name, work):
        def go(t):
            calls.append(name)
            if name in fail:
                raise RuntimeError("no service")
            return work(t)

        return go

    return [
        Step("sums", run("sums", lambda t: t["doubled"].join(t["names"], "k").groupBy("name").agg(F.sum("v").alias("v"))), ("doubled", "names")),
        Step("doubled", run("doubled", lambda t: t["rows"].select("k", (F.col("v") * 2).alias("v"))), ("rows",)),
        Step("split", run("split", lambda t: {"odd": t["rows"].where("v % 2 = 1"), "even": t["rows"].where("v % 2 = 0")}), ("rows",), outputs=("odd", "even")),
        Step("odd", run("odd", lambda t: t["split.odd"].select("v")), ("split.odd",)),
    ]


def test_only_what_changed_is_done_anew(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1), (2, 2), (1, 3)], "k int, v int")
    names, calls = spark.createDataFrame([(1, "a"), (2, "b")], "k int, name string"), []
    f = Flow(spark, steps(calls), f"file://{tmp_path}")
    out = f.run({"rows": rows, "names": names}, "one")
    assert sorted(map(tuple, out["sums"].collect())) == [("a", 8), ("b", 4)] and sorted(r[0] for r in out["odd"].collect()) == [1, 3]
    assert calls == ["doubled", "sums", "split", "odd"]
    assert made(f, "one") == [(s, x) for s in calls for x in ("running", "complete")]
    # the same rows in another order: all is read
    f.run({"rows": rows.orderBy(F.desc("v")), "names": names.repartition(3)}, "two")
    assert len(calls) == 4 and made(f, "two") == [(s, "read") for s in calls]
    # other names: only what needs them
    f.run({"rows": rows, "names": names.union(names.limit(1))}, "three")
    assert calls[4:] == ["sums"]
    # another version: that step and what needs it
    changed = [Step(s.name, s.run, s.needs, "2" if s.name == "split" else "1", outputs=s.outputs) for s in f.steps]
    Flow(spark, changed, f.root).run({"rows": rows, "names": names}, "four")
    assert calls[5:] == ["split", "odd"]


def test_a_stopped_run_is_taken_up(spark, tmp_path):
    src = {"rows": spark.createDataFrame([(1, 1)], "k int, v int"), "names": spark.createDataFrame([(1, "a")], "k int, name string")}
    calls, told = [], []
    bad = Flow(spark, steps(calls, fail=("split",)), f"file://{tmp_path}")
    with pytest.raises(RuntimeError):
        bad.run(src, "one", lambda *x: told.append(x[:2]))
    assert told[-1] == ("split", "error") and made(bad, "one")[-1] == ("split", "error")
    calls.clear()
    Flow(spark, steps(calls), bad.root).run(src, "two")
    assert calls == ["split", "odd"]


def test_order_names_and_keys(spark):
    step = lambda n, *needs: Step(n, lambda t: None, needs)
    assert [s.name for s in flow.in_order([step("c", "b"), step("b", "a"), step("a", "x")], ["x"])] == ["a", "b", "c"]
    for bad, message in (([step("a", "b"), step("b", "a")], "need each other"), ([step("a", "z")], "neither"), ([step("x", "x")], "differ")):
        with pytest.raises(ValueError, match=message):
            flow.in_order(bad, ["x"])
    df = spark.createDataFrame([(1, {"a": "b"}, None), (2, None, "x")], "i int, m map<string,string>, s string")
    assert flow.content_key(df) == flow.content_key(df.orderBy(F.desc("i"))) != flow.content_key(df.union(df))
    assert flow.content_key(df.limit(0)) != flow.content_key(df.drop("s").limit(0))


def test_documents_to_graph(spark, tmp_path):
    text = "# Safety\nNausea and rash were seen, nausea most.\n# Mechanism of action\nIt inhibits HDAC1.\n# Other\nnothing"
    docs = spark.createDataFrame([(1, text), (2, "plain words"), (3, None)], "doc_id long, text string")
    out = documents.to_graph(spark, docs, "Belix", f"file://{tmp_path}")
    nodes = {(r["doc_id"], r["id"]) for r in out["graph.nodes"].collect()}
    assert {i for d, i in nodes if d == 1} == {"study:unknown_study", "drug:belix", "ae:nausea", "ae:rash", "target:hdac1"}
    assert {i for d, i in nodes if d == 2} == {i for d, i in nodes if d == 3} == {"study:unknown_study", "drug:belix"}
    assert out["graph.edges"].where("doc_id = 1").count() == 6
    said = []
    again = Flow(spark, documents.steps("Belix"), f"file://{tmp_path}")
    again.run({"documents": docs}, on_step=lambda step, status, *_: said.append(status))
    assert said == ["read"] * 5
