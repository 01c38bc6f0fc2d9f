from pyspark.sql import functions as F

from evigraph.functions import cleaning as C
from evigraph.functions import rules
from evigraph.functions import text as X


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_missing_values(spark):
    rows = spark.createDataFrame([(" a ",), ("nan",), ("",), (None,), ("-inf",)], "x string").select(C.clean_value("x"), C.not_found("x"), C.is_empty("x")).collect()
    assert [r[0] for r in rows] == ["a", None, None, None, None]
    assert [r[1] for r in rows][2:4] == ["Not Found"] * 2
    assert [r[2] for r in rows] == [False, False, True, True, False]


def test_fill_and_count(spark):
    df = spark.createDataFrame([(1, ("x", None), [None, "none", "b"], None)], "id int, s struct<a:string,b:string>, l array<string>, keep string")
    out = C.fill_not_found(df, ("keep",))
    row = out.first()
    assert row["s"]["b"] == "Not Found" and row["l"] == ["Not Found", "Not Found", "b"] and row["keep"] is None
    assert out.select(C.count_not_found(out.schema)).first()[0] == 3
    assert out.select(C.count_fields(out.drop("id").schema)).first()[0] == 2


def test_parsers(spark):
    r = one(spark, C.marker_value(F.lit("16.4***")), C.marker_label(F.lit("16.4***")), C.marker_value(F.lit("ND")), C.incidence(F.lit("3a 3b, 1c")), C.most_severe(F.lit("2p,1d")), C.safe_int(F.lit("-")))
    assert tuple(r) == (16.4, "p<0.001", None, 7, 4, 0)
    r = one(spark, *C.parameter_cycle(F.lit("ALT Cycle 2")), *C.parameter_cycle(F.lit("Recovery period")), *C.organ_lesion(F.lit("Liver – fatty - mild")))
    assert tuple(r) == ("ALT", "2", "Alanine Aminotransferase", "Recovery", "Liver", "fatty - mild")


def test_values(spark):
    r = one(spark, C.title(F.lit("palmar-plantar syndrome")), C.numeric_equal(F.lit("50 mg"), F.lit("50")), C.numeric_equal(F.lit("a"), F.lit("b")), C.lenient_json(F.lit('x ```json\n{"a": 1}\n``` y')), C.lenient_json(F.lit("no")))
    assert tuple(r) == ("Palmar-Plantar Syndrome", True, False, '{"a": 1}', None)
    r = one(spark, C.stable_id("drug", F.lit("x"), F.lit(""), F.lit("y")), C.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))), C.rule_score(20, 10, 90, F.lit(9)))
    import hashlib

    assert r[0] == "drug_" + hashlib.sha256(b"drug:x:y").hexdigest()[:16] and abs(r[1] - 0.5**0.5) < 1e-12 and r[2] == 90


def test_cascades(spark):
    texts = {
        "eligibility_anc_threshold": [("ANC ≥ 1.0 x 10^9/L", "≥1.0 × 10⁹/L"), ("ANC >= 1500/mm3", "≥1500/mm³"), ("none", None)],
        "eligibility_platelet_threshold": [("platelets >= 100,000/mm3", "≥100000 × 10⁹/L"), ("platelets ≥ 75 x 10^9/L", "≥75 × 10⁹/L")],
        "eligibility_creatinine_clearance": [("CrCl ≥ 45 mL/min", "≥45 mL/min")],
        "eligibility_bilirubin_threshold": [("total bilirubin ≤ 1.5 × ULN", "≤1.5 × ULN"), ("Bilirubin ≤ 2 mg/dL", "≤2 mg/dL")],
        "auc_value": [("AUC ranged from 21,057 to 31,358 ng·h/mL", "21,057 to 31,358 h·ng/mL")],
        "plasma_protein_binding": [("92.9% and 95.8% is bound to protein", "92.9-95.8%"), ("94% bound to plasma protein", "94%")],
        "volume_of_distribution": [("Vdss approached total body water", "Approaches total body water")],
    }
    for field, cases in texts.items():
        got = spark.createDataFrame([(t,) for t, _ in cases], "t string").select(X.extract_cascade("t", field)).collect()
        assert [g[0] for g in got] == [w for _, w in cases], field
    assert set(rules.CASCADES) | set(rules.RANGE_CASCADES) >= set(texts)


def test_sections_and_chunks(spark):
    df = spark.createDataFrame([(1, "# Liver safety\ntext\n## Unclear\nThe cmax was high\n\n\n# Table 3-1 of x\nsee Section 2.1 and table 3-1")], "doc_id int, t string")
    blocks = X.header_blocks(df, "doc_id", "t").collect()
    assert [(b["level"], b["title"]) for b in blocks] == [(1, "Liver safety"), (2, "Unclear"), (1, "Table 3-1 of x")]
    assert one(spark, X.header_section(F.lit("Liver safety")), X.content_section(F.lit("The Cmax was high")), X.content_section(F.lit("nothing here")))[0:3] == ("Hepatotoxicity", "Pharmacokinetics", "Other")
    assert one(spark, X.references(F.lit("see Section 2.1 and Table 3-1, table 3-1")))[0] == ["table 3-1", "section 2.1"]
    chunks = X.fixed_chunks(spark.createDataFrame([(1, "a" * 4500), (2, ""), (3, None)], "k int, t string"), "k", "t").collect()
    assert [len(c["content"]) for c in chunks] == [2000, 2000, 900]
    assert [p["paragraph"] for p in X.paragraphs(df, "doc_id", "t").collect()][1].startswith("# Table")
    assert one(spark, X.study_window(F.lit("A CLN-19 has inclusion of x. CLN-20 other"), "CLN-19"))[0].startswith("CLN-19 has") and "other" not in one(spark, X.study_window(F.lit("A CLN-19 has inclusion of x. CLN-20 other"), "CLN-19"))[0]


def test_semantic_chunks_match_a_plain_fold(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = [(d, i, "x" * int(rng.integers(50, 400)), (rng.normal(size=4) if d else np.ones(4)).tolist()) for d in range(3) for i in range(30)]
    got = {(r["d"], r["chunk_index"]): (r["source_paragraphs"], [round(x, 9) for x in r["embedding"]]) for r in X.semantic_chunks(spark.createDataFrame(rows, "d int, i int, t string, v array<double>"), "d", "i", "t", "v").collect()}
    want = {}
    for d in range(3):
        own, cur, run, n = [r for r in rows if r[0] == d], [], None, 0
        for _, i, t, v in own:
            v = np.array(v)
            if cur:
                size = sum(len(own[j][2]) for j in cur) + 2 * (len(cur) - 1)
                c = run @ v / np.linalg.norm(run) / np.linalg.norm(v)
                if (c < 0.75 and size > 500) or size > 2000:
                    want[d, n], cur, run, n = (cur, run.round(9).tolist()), [], None, n + 1
            run = v if run is None else (run + v) / 2
            cur.append(i)
        want[d, n] = cur, run.round(9).tolist()
    assert got == want and max(len(c) for c, _ in want.values()) > 5
