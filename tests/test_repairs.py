"""Cases that once gave wrong results: allowed types as predicates, names by letters, diamonds and cycles, workbooks in another order."""

import io
import zipfile
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from evigraph.operators import graph as G
from evigraph.operators import resolve as R
from evigraph.sources import tabular


def test_predicates_that_are_types(spark):
    words = {"observed_in": "observed_in", "Tested in": "tested_in", "associated_with": "associated_with", "linked_to": "linked_to", "Metabolized by": "associated_with", " binds": "linked_to", "": "linked_to"}
    rows = spark.createDataFrame([(w,) for w in words] + [(None,)], "w string").select("w", G.predicate_type(F.col("w")).alias("t")).collect()
    assert {r["w"]: r["t"] for r in rows} == words | {None: "linked_to"}


def test_letters_cut_no_match(spark):
    names = ["anaemia", "Thrombocytopaenia", "hdac10", "grade 4 anemia", "naïve é", "aemian", "", "x"]
    known = ["Anemia", "Thrombocytopenia", "HDAC1", "Grade 3 anemia", "naive é", "naïve e", "Headache", "y"]
    got = R.resolve_fuzzy(spark.createDataFrame([(n,) for n in [*names, None, "anaemia"]], "name string"), spark.createDataFrame(list(zip(known, range(99))), "known string, seq int"), 0.8)
    want = {}
    for n in names:
        best = max((SequenceMatcher(None, n.lower(), k.lower()).ratio(), -i, k) for i, k in enumerate(known))
        if n and best[0] >= 0.8:
            want[n] = (best[2], round(best[0], 9))
    assert {r["name"]: (r["match"], round(r["score"], 9)) for r in got.collect()} == want and len(want) >= 5
    assert R.resolve_fuzzy(spark.createDataFrame([], "name string"), spark.createDataFrame([], "known string, seq int")).count() == 0


def test_ancestors_of_chains_diamonds_and_cycles(spark):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(100)]
    links = spark.createDataFrame([*chain, ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("x", "y"), ("y", "x"), ("a", "b"), (None, "q")], "child string, parent string")
    got = {(r["child"], r["ancestor"]): r["steps"] for r in tabular.ancestors(links).collect()}
    assert got["c0", "c100"] == 100 and sum(k[0].startswith("c") and k[0] != "c" and k[1] != "d" for k in got) == 5050
    assert {k: v for k, v in got.items() if k[0] in "axy"} == {("a", "b"): 1, ("a", "c"): 1, ("a", "d"): 2, ("x", "y"): 1, ("y", "x"): 1, ("x", "x"): 2, ("y", "y"): 2}
    assert tabular.ancestors(links.limit(0)).count() == 0


def test_sheets_by_their_links():
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheet = lambda v: f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="B1" t="inlineStr"><is><t>{v}</t></is></c></row></sheetData></worksheet>'
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="First" r:id="rId7"/><sheet name="Second" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId2" Target="worksheets/sheet1.xml"/><Relationship Id="rId7" Target="/xl/worksheets/sheet4.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", sheet("two"))
        z.writestr("xl/worksheets/sheet4.xml", sheet("one"))
    assert list(tabular.parse_workbook(raw.getvalue())) == [("First", 0, 1, "one"), ("Second", 0, 1, "two")]


def test_lists_by_key(spark):
    from evigraph.operators import merge as M

    rows = [(1, 2, "b"), (1, 1, "a"), (1, 3, "a"), (2, 1, None), (None, 1, "z"), (None, 0, "y"), (None, 0, "y")]
    df = spark.createDataFrame(rows, "k int, o int, v string")
    assert {r["k"]: r["v"] for r in M.distinct_by_key(df, ["k"], "v", "o").collect()} == {1: ["a", "b"], 2: [], None: ["y", "z"]}
    lists = spark.createDataFrame([(1, 2, ["c", "a"]), (1, 1, ["b", None, "a"]), (2, 1, None), (3, 1, [])], "k int, o int, v array<string>")
    assert {r["k"]: r["v"] for r in M.union_by_key(lists, ["k"], "v", "o").collect()} == {1: ["b", "a", "c"], 2: [], 3: []}
    assert M.distinct_by_key(df.limit(0), ["k"], "v", "o").count() == 0


def test_table_rows_are_matched_greedily(spark):
    import random

    from evigraph.operators import evaluate as E

    rnd = random.Random(5)
    cell = lambda: rnd.choice(["50 mg", "50", "A ", "a", "", None, "Not Found", "1.5", "x1.5", "."])
    rows = lambda n: [(k, i, *[cell() for _ in range(5)]) for k in range(4) for i in range(n)]
    fields, truth, found = list("abcde"), rows(12), rows(9)
    schema = "k int, i int, " + ", ".join(f"{c} string" for c in fields)
    got = {r[0]: tuple(r)[1:] for r in E.match_tables(spark.createDataFrame(truth, schema), spark.createDataFrame(found, schema), "k", "i", fields).collect()}
    norm = lambda v: "" if v is None or v.strip().lower() in ("", "not found") else v.strip().lower()
    number = lambda s: "".join(c for c in s if c in "0123456789.")
    same = lambda a, b: a == b or (a != "" and b != "" and any(c.isdigit() for c in a) and number(a) == number(b))
    for k in range(4):
        t, f = ([list(map(norm, r[2:])) for r in x if r[0] == k] for x in (truth, found))
        cells = full = 0
        for own in t:
            scores = [sum(map(same, own, o)) for o in f]
            if scores and max(scores) > 0:
                at = scores.index(max(scores))
                cells, full = cells + scores[at], full + (scores[at] >= 4)
                f.pop(at)
        assert got[k] == (len(t) * 5, cells, len(t), full, len(f) * 5)
