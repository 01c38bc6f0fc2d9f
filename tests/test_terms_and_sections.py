"""Terms and sections of whole texts: each text is lowered once, and the words are those of the plain patterns."""

import re

from pyspark.sql import functions as F

from evigraph.functions import rules
from evigraph.functions import text as X
from evigraph.operators import retrieval

TEXTS = ["Pain and ABDOMINAL PAIN", "painful", "kit_x", "kit-x (PD-1)", "PD-10", "", None, "x" * 5000 + " Rash", "a+b c", "aab c", "HDACé İ rash́", "drash\nrash"]


def test_terms_are_those_of_the_patterns(spark):
    words = {"EVENT": rules.KNOWN_EVENTS, "TARGET": rules.KNOWN_TARGETS, "PATTERN": ["a+b", "r[ai]sh", "k.t"]}
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    # the patterns one by one, by Spark's own rlike
    plain = [(k, w, F.lower("t").rlike(rf"\b{w.lower()}\b").alias(f"{k}|{w}")) for k, ws in words.items() for w in ws]
    want = {r["i"]: {(k, w) for k, w, _ in plain if r[f"{k}|{w}"]} for r in df.select("i", *[c for *_, c in plain]).collect()}
    got = {r["i"]: {(k, w) for k, ws in (r["entities"] or {}).items() for w in ws} for r in X.found_terms(df, "t", words).collect()}
    assert got == want and got[0] >= {("EVENT", "pain"), ("EVENT", "abdominal pain")} and ("EVENT", "rash") in got[7] and ("PATTERN", "a+b") in got[9]


def test_a_text_is_lowered_once(spark):
    df = spark.createDataFrame([(1, "# a", "A rash", 0)], "doc_id int, title string, content string, chunk_index int")
    for out, most in ((X.found_terms(df, "content", {"E": rules.KNOWN_EVENTS}), 1), (retrieval.classify_blocks(df), 2)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert len(re.findall(r"lower\(", plan)) <= most


def test_sections_look_at_the_first_characters(spark):
    long = "x" * 795
    rows = [("", long + " QTC"), ("", long + "xx QTC"), ("", "İ" * 400 + "QTC"), ("Liver", "qtc"), (None, "AUC"), ("", None), ("x", "Deaths. Fatal.")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, title string, content string")
    # the whole text lowered, then cut
    cut = F.substring(F.lower("content"), 1, 800)
    want = {r["i"]: r["s"] for r in df.select("i", F.when(X.header_section("title") != "Other", X.header_section("title")).otherwise(X.content_section(cut, lowered=True)).alias("s")).collect()}
    got = {r["i"]: r["section"] for r in retrieval.classify_blocks(df).collect()}
    assert got == want and [got[0], got[1], got[3], got[4]] == ["Cardiac Safety", "Other", "Hepatotoxicity", "Pharmacokinetics"]
    assert [r[0] for r in df.select(X.content_section("content")).collect()] == [r[0] for r in df.select(X.content_section(cut, lowered=True)).collect()]
