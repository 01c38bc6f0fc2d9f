import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from evigraph import providers
from evigraph.operators import builder, evaluate, harmonize, merge, preclinical, resolve, retrieval
from evigraph.operators import graph as G
from evigraph.sources import sinks, tabular

RECORD = """doc_id int, study_metadata struct<study_identifiers:array<string>,study_phase:string,study_status:string,sponsor_information:string>,
safety_data struct<adverse_events:array<struct<adverse_event_preferred_term:string,grade_3_4_ae_frequency:string,all_grades_frequency:string,serious_adverse_event_flag:boolean>>>,
pharmacokinetics struct<alp_alkaline_phosphatase:string,alt_alanine_aminotransferase:string,ast_aspartate_aminotransferase:string,tbil_total_bilirubin:string,cre_creatinine:string>,
preclinical_toxicology struct<toxicity_species:array<string>>, mechanism_of_action struct<molecular_targets:array<string>>,
semantic_relationships struct<relationships:array<struct<subject:string,predicate:string,object:string,confidence:string>>>"""


def record(spark, relations=(), events=(("Anemia", "10%", None, True), ("Thrombocytopenia", None, "5%", False))):
    return spark.createDataFrame([(1, (["CLN-19"], "Phase 2", None, "X"), (list(events),), ("120 U/L", "45 U/L", None, "", None), (["Rat", "Dog"],), (["HDAC"],), (list(relations),))], RECORD)


def test_strict_graph(spark):
    g = builder.build(record(spark), "Drugin")
    assert g.nodes.count() == 9 and g.edges.count() == 10
    kinds = {r["type"]: r["n"] for r in G.type_counts(g.nodes, "type").collect()}
    assert kinds == {"Drug": 1, "Clinical Study": 1, "Adverse Event": 2, "Biomarker": 2, "Animal Study": 2, "Target": 1}


def test_statements(spark):
    rel = [("Drugin", "inhibits", "HDAC", "High"), ("Drugin", "caused by", "Anaemia", None), ("Drugin", "used in", "Study Treatment", None), ("Drugin", "has_dose", "50 mg", None), ("Drugin", "causes", "Severe Unknown", None)]
    g = builder.build(record(spark, rel, [("Anemia", None, None, None), ("All deaths", "3%", None, None)]), "Drugin")
    nodes = {r["id"]: r for r in g.nodes.collect()}
    assert nodes["study:CLN-19"]["properties"]["study_statistic"] == "Study Treatment" and nodes["study:CLN-19"]["properties"]["All deaths"] == "3%"
    assert nodes["drug:drugin"]["properties"]["dose"] == "50 mg" and "severe unknown" not in str(nodes)
    edges = {(r["source_id"], r["target_id"], r["properties"].get("original_predicate"), r["type"]) for r in g.edges.collect()}
    assert ("drug:drugin", "target:hdac", "inhibits", "associated_with") in edges and ("drug:drugin", "ae:anemia", "caused by", "linked_to") in edges


def test_names_resolve_in_their_own_document(spark):
    names = spark.createDataFrame([(1, "Anaemia"), (1, "NAUSEA")], "doc_id int, name string")
    uses = names.withColumn("at", F.length("name").cast("long"))
    known = [(1, "ae:anemia", "Anemia", 0), (1, "ae:nausea", "Nausea", 2), (2, "ae:anaemia", "Anaemia", 0), (2, "ae:nausea", "nausea", 1)]
    got = builder._in_turn(uses, spark.createDataFrame(known, "doc_id int, id string, name string, seq int"), False, 6)[0].collect()
    assert {(r["doc_id"], r["name"], r["id"]) for r in got} == {(1, "Anaemia", "ae:anemia"), (1, "NAUSEA", "ae:nausea")}


def test_fuzzy_resolution_by_group(spark):
    names = spark.createDataFrame([(1, "Anaemia"), (2, "Anaemia"), (3, "Anaemia")], "doc_id int, name string")
    known = spark.createDataFrame([(1, "Anemia", 0), (2, "anaemia", 0), (2, "Anemia", 1), (4, "Anaemia", 0)], "doc_id int, known string, seq int")
    got = {(r["doc_id"], r["match"], round(r["score"], 3)) for r in resolve.resolve_fuzzy(names, known, by=("doc_id",)).collect()}
    assert got == {(1, "Anemia", 0.923), (2, "anaemia", 1.0)}


def test_expression_and_genes(spark):
    genes = spark.createDataFrame([(1, "HDAC", 2.0, 0.01, 0.02), (1, "Receptor A", -0.5, 0.01, None), (1, "HDAC1", 1.5, 0.9, 0.9), (2, "KIT gene", 3.0, 0.01, 0.1)], "doc_id int, symbol string, log2fc double, p_value double, padj double")
    g = builder.build(record(spark), "Drugin", genes)
    nodes = {r["id"]: r for r in g.nodes.collect()}
    assert nodes["target:hdac"]["properties"]["log2fc"] == "2.0" and nodes["target:receptor_a"]["type"] == "Target"
    assert g.edges.where("properties['source'] = 'Transcriptomics_Analysis'").select("type").collect()[0][0] == "linked_to"
    e = builder.enrich_genes(g, "Drugin")
    assert e.nodes.count() == g.nodes.count() + 11 and e.edges.where("type = 'inhibits'").count() == 11


def test_harmonized_graph(spark):
    meta = spark.createDataFrame(
        [(0, "s1", "Drugin", "A|B| ", "1uM", "MCF7", "Breast", "24h", "p", "1", "l", "st", None, "1"), (1, "s2", "Drugin", "B", "1uM", "MCF7", None, "24h", "p", "1", "l", "st", None, "nan")],
        "row int, SignatureId string, Perturbagen string, GeneTargets string, Concentration string, CellLine string, Tissue string, Time string, perturbagenID string, pubChemID string, lincspertid string, stitchID string, factor string, is_exemplar string",
    )
    sig = spark.createDataFrame([(s, f"G{i:02d}", float(i if i % 2 else -i), 0.1) for s in ("s1", "zz") for i in range(25)] + [("s1", "NAN", float("nan"), 0.1)], "signatureID string, Name_GeneSymbol string, Value_LogDiffExp double, Significance_pvalue double")
    info = harmonize.legacy_properties(spark.createDataFrame([(0, "A & B", "Field x", "1"), (1, "A & B", "Field x", "2"), (2, None, "f", None)], "row int, Category string, Field string, Value string"))
    safety = spark.createDataFrame([(0, "Dry skin", "5", None, "Yes", None), (1, "Dry skin", "6", None, None, None), (2, " ", "1", None, None, None)], "row int, term string, percent string, grade_3_4 string, sae string, teae string")
    g = harmonize.harmonize("None", meta, sig, info, safety)
    nodes = {r["id"]: r for r in g.nodes.collect()}
    assert nodes["Drugin"]["properties"]["A_and_B_Field_x"] == "2" and nodes["AdverseEvent_Dry_skin"]["type"] == "AdverseEvent"
    assert {"Target_A", "Target_B", "MCF7", "breast", "s1", "s2", "G24"} <= set(nodes) and "G04" not in nodes and "NAN" not in nodes
    edges = g.edges.collect()
    assert sum(e["relation"] == "associated_with" for e in edges) == 20 and next(e for e in edges if e["relation"] == "causes")["properties"] == {"frequency": "5", "is_sae": "Yes"}
    assert {r["metric"]: r["value"] for r in harmonize.validate(g).collect()}["dangling"] == 0


def test_preclinical(spark):
    design = spark.createDataFrame([("Rat", "2", s, 10.0, "5", "-", "3") for s in "MF"], "species string, group string, sex string, dose double, n_terminal string, n_recovery string, n_tk string")
    n, e = preclinical.animal_groups(design, "DRUG", "ST")
    row = n.where("sex = 'M'").first()
    assert row["node_id"] == "AG_RAT_M_10MG" and row["dose_mg_per_m2"] == 60.0 and row["n_recovery"] == 0 and e.count() == 4
    pk, links = preclinical.exposure(spark.createDataFrame([("Rat", "M", 10.0, 1, 1.0, 0.27), ("Rat", "M", 10.0, 151, 1.0, 0.71)], "species string, sex string, dose_mg_per_kg double, day int, cmax double, auc double"))
    assert pk.where("day = 151").first()["exposure_ratio"] == 2.63 and links.count() == 2
    lab, _ = preclinical.lab_events(spark.createDataFrame([("Rat", "M", 10.0, "WBC_change_pct", "-30"), ("Rat", "M", 10.0, "liver_severity", "2"), ("Dog", "F", 10.0, "ALT_change_pct", "5")], "species string, sex string, dose_mg_per_kg double, metric string, value string"))
    assert {r["node_type"]: r["node_id"] for r in lab.collect()}["Hematology_Event"] == "HEM_RAT_M_10MG_WBC_change_pct"
    cells = spark.createDataFrame([("s", 2, 0, "x"), ("s", 3, 0, "Liver - fat"), ("s", 3, 1, "2c,1d"), ("s", 4, 0, "Number of Animals"), ("s", 4, 1, "1a"), ("s", 5, 0, "r"), ("s", 6, 0, "Skin"), ("s", 6, 1, "1p")], "sheet string, row int, col int, value string")
    ot, edges = preclinical.microscopic_findings(cells, "Rat", [(1, 10, "M")], {2: "Terminal", 5: "Recovery"})
    got = {r["organ"]: (r["severity_grade"], r["incidence_count"], r["recovery_presence"]) for r in ot.collect()}
    assert got == {"Liver": (4, 3, "No"), "Skin": (0, 1, "Yes")} and edges.count() == 4
    cc, _ = preclinical.chemistry_matrix(spark.createDataFrame([("s", 3, 0, "ALT Cycle 2"), ("s", 3, 1, "25.5***"), ("s", 4, 0, "Recovery"), ("s", 4, 1, "ND")], "sheet string, row int, col int, value string"), [(1, 10, "M")])
    assert [(r["parameter"], r["percent_change"], r["statistical_significance"]) for r in cc.collect()] == [("ALT", "25.5", "p<0.001")]
    dead, _ = preclinical.mortality(spark.createDataFrame([("Rat", "M", 0.0, 1, 10), ("Rat", "M", 10.0, 0, 10)], "species string, sex string, dose_mg_per_kg double, deaths int, size int"))
    assert [r["mortality_percent"] for r in dead.collect()] == [10.0]


def test_fuzzy_resolution_matches_difflib(spark):
    rnd = random.Random(1)
    known = ["Anemia", "Thrombocytopenia", "hdac10", "grade 3 anemia", *{"".join(rnd.choice("abc") for _ in range(6)) for _ in range(40)}]
    names = ["anemia ", "Anaemia", "Headache", "hdac1", "grade 4 anemia", *{"".join(rnd.choice("abc") for _ in range(6)) for _ in range(40)}]
    k = spark.createDataFrame([(n, i) for i, n in enumerate(known)], "known string, seq int")
    got = {r["name"]: (r["match"], round(r["score"], 6)) for r in resolve.resolve_fuzzy(spark.createDataFrame([(n,) for n in names], "name string"), k).collect()}
    want = {}
    for n in names:
        q, best = n.strip().lower(), (None, 0.0)
        for c in known:
            s = 1.0 if q == c.strip().lower() else SequenceMatcher(None, q, c.strip().lower()).ratio()
            if s > best[1]:
                best = (c, s)
        if best[1] >= 0.85:
            want[n] = (best[0], round(best[1], 6))
    assert got == want and "Headache" not in got
    guarded = {r["name"] for r in resolve.resolve_fuzzy(spark.createDataFrame([("hdac1",), ("grade 4 anemia",)], "name string"), k, numeric_guard=True).collect()}
    assert not guarded


def test_grounding(spark):
    cases = [("Anemia", "Adverse Event", "Anemia", 1.0), ("severe anemia", "Adverse Event", "Anemia", 0.8), ("other", "Adverse Event", "other", 0.3), ("hdac", "Target", "HDAC", 1.0), ("zz", "Target", "zz", 0.4), ("zz", "Biomarker", "zz", 0.5), (None, "Target", None, 0.0)]
    for term, kind, want, conf in cases:
        r = resolve.ground(spark.createDataFrame([(term,)], "t string"), "t", kind).first()
        assert (r["grounded"], r["grounding_confidence"]) == (want, conf)


def test_merge(spark):
    rows = spark.createDataFrame([(1, 0, ("Not Found", None), [1, 2], False), (1, 1, ("x", 5), [2, 3], True), (1, 2, ("y", 6), None, None)], "k int, o int, s struct<a:string,b:int>, l array<int>, f boolean")
    r = merge.merge_records(rows, ["k"], "o").first()
    assert tuple(r["s"]) == ("x", 5) and r["l"] == [1, 2, 3] and r["f"] is True
    facts = spark.createDataFrame([(1, 0, "A", None, "S1", "x"), (1, 1, "B", "d", "S1", "y"), (1, 2, "A", "e", None, "x")], "k int, o int, section string, drug string, study_id string, event string")
    state = merge.prior_context(merge.scratchpad(facts, ["k"], "o")).first()
    assert (state["drug"], state["study_ids"], state["events"], state["sections"]) == ("d", ["S1"], ["x", "y"], ["A", "B"]) and "Drug: d" in state["context"]
    base = spark.createDataFrame([(1, ("a", "b"))], "k int, s struct<p:string,q:string>")
    by = spark.createDataFrame([(1, "new", "")], "k int, x string, y string")
    assert tuple(merge.overriding(base, by, "k", {"s.p": "x", "s.q": "y"}).first()["s"]) == ("new", "b")


def test_evaluation(spark):
    t = spark.createDataFrame([("t", 0, "a", "50 mg", "x"), ("t", 1, "b", "1", None)], "tbl string, row int, p string, q string, r string")
    f = spark.createDataFrame([("t", 0, "b", "2", None), ("t", 1, "A ", "50", "x"), ("t", 2, "z", "9", "q")], "tbl string, row int, p string, q string, r string")
    r = evaluate.match_tables(t, f, "tbl", "row", ["p", "q", "r"]).first()
    assert tuple(r) == ("t", 6, 5, 2, 1, 3)
    diff = evaluate.tree_diff(*(evaluate.flatten(x.drop("tbl"), "row") for x in (t, f)), ["row"])
    assert {r["status"] for r in diff.collect()} == {"mismatch", "fp", "fn"} or diff.count() == 9
    assert evaluate.prf(spark.createDataFrame([(1,)], "x int").where("x = 2"), [], F.lit(True), F.lit(True), F.lit(True)).first()["f1"] == 0.0


def test_graph_integrity(spark):
    nodes = spark.createDataFrame([("a", "A", "Drug", 1), ("a", "dup", "Drug", 2), ("b", "B", "Nope", 3)], "id string, name string, type string, seq int")
    kept = G.gate_nodes(nodes)
    assert [r["name"] for r in kept.collect()] == ["A"]
    edges = spark.createDataFrame([("a", "a", "weird", 1), ("a", "b", "tested_in", 2)], "source_id string, target_id string, type string, seq int")
    assert [r["type"] for r in G.gate_edges(edges, kept).collect()] == ["linked_to"]
    assert [r["missing_end"] for r in G.dangling_edges(edges, kept).collect()] == ["target"]
    allowed = spark.createDataFrame([("Drug", "Drug", "weird")], "source_type string, target_type string, type string")
    assert G.pairs_allowed(edges, kept, allowed, strict=True).count() == 1


def test_retrieval(spark):
    chunks = spark.createDataFrame([(1, 0, "A", "# Table 3 results\nliver liver"), (1, 1, "B", "see table 3 and section 9.9"), (1, 2, "A", "liver")], "doc_id int, chunk_index int, section string, content string")
    assert [(r["chunk_index"], r["target"]) for r in retrieval.expand_references(chunks).collect()] == [(1, 0)]
    assert [r["ref"] for r in retrieval.unresolved(chunks).collect()] == ["section 9.9"]
    assert [r["chunk_index"] for r in retrieval.by_keyword(chunks, "liver", 1).collect()] == [0]
    assert retrieval.summary_text(chunks).first()["summary"] == "A: 2 chunks (0-2)\nB: 1 chunks (1-1)"
    assert sorted(r["chunk_index"] for r in retrieval.adjacent(chunks, spark.createDataFrame([(1, 0)], "doc_id int, chunk_index int")).collect()) == [1]


def test_sinks(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "O'x", "Clinical Study", {"k y": "v", "b": None})], "id string, name string, type string, properties map<string,string>")
    edges = spark.createDataFrame([("a", "a", "tested in", 0.9, {"source": "s"})], "source_id string, target_id string, type string, confidence double, properties map<string,string>")
    assert nodes.select(sinks.cypher_node()).first()[0] == "CREATE (:`Clinical_Study` {id: 'a', name: 'O\\'x', `k_y`: 'v', `b`: null});"
    assert edges.select(sinks.cypher_edge()).first()[0] == "MATCH (a {id: 'a'}), (b {id: 'a'}) CREATE (a)-[:`TESTED_IN` {confidence: 0.9, `source`: 's'}]->(b);"
    assert sinks.nodes_wide(nodes).columns == ["id", "Label", "Type", "b", "k y"]
    for write in (sinks.write_cypher, sinks.write_csv, sinks.write_json):
        write(nodes, edges, str(tmp_path / write.__name__))
    assert sinks.view_elements(nodes, edges).count() == 2 and sinks.column_widths(nodes.select("id")).first()["width"] == 10


def test_sources(spark, tmp_path):
    import zipfile

    (tmp_path / "x.xls").write_text("Gene Name\tlog2FC\tP-Value\tadj\nA\t1\t0.1\t0.2\n")
    df = tabular.rename_headers(tabular.read_flexible(spark, str(tmp_path / "x.xls")))
    assert df.columns == ["Symbol", "Log2FoldChange", "PValue", "Padj"] and df.count() == 1
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S" sheetId="1"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Category</t></si><si><t>v</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>5</v></c></row></sheetData></worksheet>')
    cells = tabular.workbook_cells(spark, str(tmp_path / "b.xlsx"))
    assert sorted((r["row"], r["col"], r["value"]) for r in cells.collect()) == [(0, 0, "Category"), (1, 0, "v"), (1, 1, "5")]
    assert tabular.read_flexible(spark, str(tmp_path / "b.xlsx")).select("Category").first()[0] == "v" and not tabular.is_key_value(cells)
    other = cells.withColumn("file", F.lit("/q/other.xlsx"))
    assert {r["sheet"] for r in tabular.merge_workbooks(cells, other.unionByName(other.withColumn("file", F.lit("/r/other.xlsx")))).select("sheet").collect()} == {"S", "other_S", "other_S_1"}
    (tmp_path / "o.owl").write_text('<!DOCTYPE r [<!ENTITY o "http://o#">]><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#"><owl:Class rdf:about="&o;a"><rdfs:label>A</rdfs:label><rdfs:subClassOf rdf:resource="&o;b"/></owl:Class><owl:Class rdf:about="&o;b"><rdfs:subClassOf rdf:resource="&o;c"/></owl:Class></rdf:RDF>')
    classes, links = tabular.class_hierarchy(spark, str(tmp_path / "o.owl"))
    assert classes.count() == 2 and {(r["child"], r["ancestor"]) for r in tabular.ancestors(links).collect()} == {("http://o#a", "http://o#b"), ("http://o#b", "http://o#c"), ("http://o#a", "http://o#c")}


def test_providers(spark):
    df = spark.createDataFrame([(1, "ANC ≥ 1.0 x 10^9/L and HDAC with anemia"), (2, "bad")], "k int, content string")
    assert providers.extract_fields(df).where("k = 1").first()["eligibility_anc_threshold"] == "≥1.0 × 10⁹/L"
    assert providers.entities(df).where("k = 1").first()["entities"] == {"CHEMICAL": ["HDAC"], "DISEASE": ["anemia"]}

    def call(rows):
        if any(r["content"] == "bad" for r in rows):
            raise ValueError("no")
        return ["ok"] * len(rows)

    got = {r["k"]: (r["response"], r["error"]) for r in providers.batched(df, call, size=1).collect()}
    assert got == {1: ("ok", None), 2: (None, "ValueError: no")}
