"""The strict evidence graph from extracted records, and its enrichment.

Each producer gives nodes and edges with a ``seq`` that says in which order the sections are taken: metadata, safety,
pharmacokinetics, preclinical, mechanism, statements, expression. Of nodes with one id the first by seq stays; edges are a bag. Names in statements and expression tables are resolved in
turn: a new name is known to those after it.
All producers work on many documents at once: ``doc_id`` keeps their graphs apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigraph.functions import rules
from evigraph.operators import graph as G
from evigraph.operators.resolve import ground, resolve_in_turn
from evigraph.operators.store import kept

#: What edges from statements name as their source.
STATEMENT_SOURCE = "statements"
NODE = ["doc_id", "id", "name", "type", "properties", "seq"]
EDGE = ["doc_id", "source_id", "target_id", "type", "properties", "confidence", "seq"]
# Display name and field of the biomarkers that become nodes.
BIOMARKERS = [("ALP", "alp_alkaline_phosphatase"), ("ALT", "alt_alanine_aminotransferase"), ("AST", "ast_aspartate_aminotransferase"), ("Bilirubin", "tbil_total_bilirubin"), ("Creatinine", "cre_creatinine")]


def _map(**kv: Column) -> Column:
    return F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v.cast("string"))]) if kv else F.expr("cast(map() AS map<string,string>)")


def _node(df: DataFrame, stage: int, ident: Column, name: Column, kind: str, props: Column, order: Column | None = None) -> DataFrame:
    seq = F.lit(stage * G.BAND) + (order if order is not None else F.lit(0))
    return df.select("doc_id", ident.alias("id"), F.trim(name).alias("name"), F.lit(kind).alias("type"), props.alias("properties"), seq.cast("long").alias("seq"))


def _edge(df: DataFrame, stage: int, source: Column, target: Column, kind: Column | str, props: Column | None = None, order: Column | None = None) -> DataFrame:
    seq = F.lit(stage * G.BAND) + (order if order is not None else F.lit(0))
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    return df.select("doc_id", source.alias("source_id"), target.alias("target_id"), kind.alias("type"), (props if props is not None else _map()).alias("properties"), F.lit(1.0).alias("confidence"), seq.cast("long").alias("seq"))


def study_id(records: DataFrame) -> Column:
    return F.coalesce(F.get("study_metadata.study_identifiers", F.lit(0)), F.lit("unknown_study"))


def build(records: DataFrame, drug: str, expression: DataFrame | None = None, numeric_guard: bool = False) -> G.Graph:
    """The graph of records (doc_id, study_metadata, safety_data, pharmacokinetics, preclinical_toxicology, mechanism_of_action,
    semantic_relationships), each section a struct. ``expression`` (doc_id, symbol, log2fc, p_value, padj) is laid over its document's graph."""
    drug_id = F.lit(f"drug:{drug.lower()}")
    main = F.concat(F.lit("study:"), study_id(records))
    base = records.withColumn("_study", main)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    nodes = [
        _node(base, 1, F.col("_study"), study_id(records), "Clinical Study", _map(phase=text("study_metadata.study_phase"), status=text("study_metadata.study_status"), sponsor=text("study_metadata.sponsor_information"))),
        _node(base, 1, drug_id, F.lit(drug), "Drug", _map(type=F.lit("Small Molecule")), F.lit(1)),
    ]
    edges = [_edge(base, 1, drug_id, F.col("_study"), "tested_in")]

    # adverse events; sums of events are properties of the study
    events = base.select("doc_id", "_study", F.posexplode("safety_data.adverse_events").alias("_i", "e")).select("doc_id", "_study", "_i", "e.*").where("adverse_event_preferred_term <> ''")
    sums = events.where(G.is_summary(F.col("adverse_event_preferred_term")))
    more = sums.select("doc_id", F.col("_study").alias("id"), F.col("adverse_event_preferred_term").alias("key"), F.coalesce("grade_3_4_ae_frequency", "all_grades_frequency", F.lit("Present")).alias("value"), "_i")
    terms = ground(events.where(~G.is_summary(F.col("adverse_event_preferred_term"))), "adverse_event_preferred_term", "Adverse Event")
    ae = F.concat(F.lit("ae:"), F.replace(F.lower("grounded"), F.lit(" "), F.lit("_")))
    props = _map(grade_3_4=text("grade_3_4_ae_frequency"), serious=F.coalesce(F.col("serious_adverse_event_flag").cast("string"), F.lit("")), ontology_confidence=F.col("grounding_confidence"), original_term=F.col("adverse_event_preferred_term"))
    nodes.append(_node(terms, 2, ae, F.col("grounded"), "Adverse Event", props, F.col("_i")))
    edges.append(_edge(terms, 2, ae, F.col("_study"), "observed_in", None, F.col("_i") * 2))
    edges.append(_edge(terms, 2, drug_id, ae, "observed_in", _map(causality=F.lit("suspected")), F.col("_i") * 2 + 1))

    # biomarkers
    marks = F.array_compact(F.array(*[F.when(F.coalesce(F.col(f"pharmacokinetics.{f}"), F.lit("")) != "", F.struct(F.lit(i).alias("i"), F.lit(n).alias("n"), F.col(f"pharmacokinetics.{f}").alias("v"))) for i, (n, f) in enumerate(BIOMARKERS)]))
    bio = base.select("doc_id", "_study", F.explode(marks).alias("b"))
    bid = F.concat(F.lit("biomarker:"), F.lower("b.n"))
    nodes.append(_node(bio, 3, bid, F.col("b.n"), "Biomarker", _map(value=F.col("b.v")), F.col("b.i")))
    edges.append(_edge(bio, 3, bid, F.col("_study"), "observed_in", None, F.col("b.i")))

    # animal studies and targets
    animals = base.select("doc_id", F.posexplode("preclinical_toxicology.toxicity_species").alias("_i", "s")).where("s <> ''")
    aid = F.concat(F.lit("animal_study:"), F.lower("s"))
    nodes.append(_node(animals, 4, aid, F.concat("s", F.lit(" Toxicity Study")), "Animal Study", _map(species=F.col("s")), F.col("_i")))
    edges.append(_edge(animals, 4, drug_id, aid, "tested_in", None, F.col("_i")))
    targets = ground(base.select("doc_id", F.posexplode("mechanism_of_action.molecular_targets").alias("_i", "t")), "t", "Target").where("grounded IS NOT NULL")
    tid = F.concat(F.lit("target:"), F.lower("grounded"))
    nodes.append(_node(targets, 5, tid, F.col("grounded"), "Target", _map(ontology_confidence=F.col("grounding_confidence")), F.col("_i")))
    edges.append(_edge(targets, 5, drug_id, tid, "associated_with", None, F.col("_i")))

    known = kept(G.first_of(G.union_sparse(*nodes), ["doc_id", "id"], ["seq"]))
    sums = more.select("doc_id", "id", "key", "value", F.lit(False).alias("adds"), F.struct(F.lit(2).alias("stage"), F.col("_i").cast("long").alias("i")).alias("at"))
    made, linked, said = _statements(base, known, drug_id, numeric_guard)
    nodes, edges, writes = [known, made], [*edges, linked], sums.unionByName(said)
    if expression is not None:
        made, linked, said = _expression(base, kept(G.first_of(G.union_sparse(*nodes), ["doc_id", "id"], ["seq"])), expression, drug_id, numeric_guard)
        nodes, edges, writes = [*nodes, made], [*edges, linked], writes.unionByName(said)
    all_nodes = G.first_of(G.union_sparse(*nodes).where(F.col("type").isin(rules.NODE_TYPES)), ["doc_id", "id"], ["seq"])
    out = _written(all_nodes, writes)
    out = kept(out)
    ends = out.select("doc_id", "id")
    e = G.union_sparse(*edges)
    for end in ("source_id", "target_id"):
        e = e.join(ends.withColumnRenamed("id", end), ["doc_id", end], "left_semi")
    kind = F.when(F.col("type").isin(rules.EDGE_TYPES), F.col("type")).otherwise("linked_to")
    return G.Graph(out, e.withColumn("type", kind).select(*EDGE))


def _written(nodes: DataFrame, writes: DataFrame) -> DataFrame:
    """``nodes`` with their properties after all writes (doc_id, id, key, value, adds, at) in the order of ``at``: a write sets its
    property, or (``adds``) is put behind what is there, with a semicolon."""
    begun = nodes.select("doc_id", "id", F.explode("properties").alias("key", "value")).withColumn("adds", F.lit(False)).withColumn("at", F.struct(F.lit(0).alias("stage"), F.lit(0).cast("long").alias("i")))
    touched = writes.select("doc_id", "id", "key").distinct()
    rows = writes.unionByName(begun.join(touched, ["doc_id", "id", "key"], "left_semi"))
    entry = F.struct("at", "value")
    folded = rows.groupBy("doc_id", "id", "key").agg(F.max(F.when(~F.col("adds"), entry)).alias("s"), F.array_sort(F.collect_list(F.when(F.col("adds"), entry))).alias("a"))
    later = F.transform(F.filter("a", lambda x: F.col("s").isNull() | (x["at"] > F.col("s.at"))), lambda x: x["value"])
    value = F.array_join(F.concat(F.when(F.col("s").isNull(), F.array().cast("array<string>")).otherwise(F.array("s.value")), later), "; ")
    maps = folded.withColumn("value", value).groupBy("doc_id", "id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("_more"))
    out = nodes.join(maps, ["doc_id", "id"], "left")
    old = F.map_filter("properties", lambda k, _: ~F.coalesce(F.map_contains_key(F.col("_more"), k), F.lit(False)))
    return out.withColumn("properties", F.when(F.col("_more").isNull(), F.col("properties")).otherwise(F.map_concat(old, "_more"))).select(*NODE)


def _in_turn(uses: DataFrame, known: DataFrame, guard: bool, stage: int) -> tuple[DataFrame, DataFrame]:
    """(uses (doc_id, name, at) with id, nodes of the new names)."""
    kind = G.inferred_type(F.col("name"))
    ids, new = resolve_in_turn(uses, known, kind, G.node_id(kind, F.lower("name")), "doc_id", 0.85, guard)
    seq = (F.lit(stage * G.BAND) + F.col("at")).cast("long").alias("seq")
    return kept(ids), new.select("doc_id", "id", F.trim("name").alias("name"), F.col("kind").alias("type"), _map(source=F.lit("Inferred_Strict_Schema")).alias("properties"), seq)


def _statements(base: DataFrame, known: DataFrame, drug_id: Column, guard: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and writes of subject-predicate-object statements, in their order, subjects before objects."""
    rel = base.select("doc_id", "_study", F.posexplode("semantic_relationships.relationships").alias("_i", "r")).select("doc_id", "_study", "_i", "r.*").where("subject <> '' AND predicate <> '' AND object <> ''")
    rel = rel.withColumn("_m", G.merge_target(F.col("object")))
    at = F.struct(F.lit(6).alias("stage"), F.col("_i").cast("long").alias("i")).alias("at")
    owned = rel.where("_m IS NOT NULL").select("doc_id", F.when(F.col("_m.owner") == "study", F.col("_study")).otherwise(drug_id).alias("id"), F.col("_m.key").alias("key"), F.col("object").alias("value"), F.lit(True).alias("adds"), at)
    rest = rel.where("_m IS NULL")
    digit = F.col("object").rlike(r"^\d")
    turn = lambda k: (F.col("_i").cast("long") * 2 + k).alias("at")
    uses = rest.select("doc_id", F.col("subject").alias("name"), turn(0)).union(rest.where(~digit).select("doc_id", "object", turn(1)))
    ids, nodes = _in_turn(uses, known, guard, 6)
    s, o = (ids.where(F.col("at") % 2 == k).select("doc_id", F.floor(F.col("at") / 2).cast("int").alias("_i"), F.col("id").alias(c)) for k, c in ((0, "_s"), (1, "_o")))
    both = rest.join(s, ["doc_id", "_i"], "left").join(o, ["doc_id", "_i"], "left")
    numbers = both.where(digit & F.col("_s").isNotNull()).select("doc_id", F.col("_s").alias("id"), G.property_key(F.col("predicate")).alias("key"), F.col("object").alias("value"), F.lit(False).alias("adds"), at)
    conf = F.coalesce(F.col("confidence").cast("string"), F.lit("Inferred"))
    linked = both.where(~digit & F.col("_s").isNotNull() & F.col("_o").isNotNull())
    edges = _edge(linked, 6, F.col("_s"), F.col("_o"), G.predicate_type(F.col("predicate")), _map(source=F.lit(STATEMENT_SOURCE), confidence=conf, original_predicate=F.col("predicate")), F.col("_i"))
    return nodes, edges, owned.unionByName(numbers)


def _expression(base: DataFrame, known: DataFrame, expression: DataFrame, drug_id: Column, guard: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Significant genes become properties of their nodes; strong changes also edges from the drug. Rows are taken by ``row`` if the
    table has it, else by symbol and figures; of two symbols of one node the later writes its properties."""
    order = ["row"] if "row" in expression.columns else ["symbol", "log2fc", "p_value", "padj"]
    genes = expression.where("p_value < 0.05 AND symbol <> ''").withColumn("at", F.row_number().over(W.partitionBy("doc_id").orderBy(*order)).cast("long"))
    rows = kept(base.select("doc_id").join(genes, "doc_id"))
    ids, nodes = _in_turn(rows.select("doc_id", F.col("symbol").alias("name"), "at"), known, guard, 7)
    hit = rows.join(ids.select("doc_id", "at", "id"), ["doc_id", "at"]).where("id IS NOT NULL")
    props = F.array(*[F.struct(F.lit(k).alias("key"), F.coalesce(v.cast("string"), F.lit("")).alias("value")) for k, v in (("log2fc", F.col("log2fc")), ("p_value", F.col("p_value")), ("padj", F.col("padj")), ("transcriptomics_source", F.lit("External_Experiment")))])
    writes = hit.select("doc_id", "id", F.explode(props).alias("p"), F.struct(F.lit(7).alias("stage"), F.col("at").alias("i")).alias("at")).select("doc_id", "id", "p.key", "p.value", F.lit(False).alias("adds"), "at")
    kind = F.when(F.col("log2fc") > 0, "upregulates").otherwise("downregulates")
    edges = _edge(hit.where("abs(log2fc) > 1"), 7, drug_id, F.col("id"), kind, _map(source=F.lit("Transcriptomics_Analysis"), confidence=F.lit("High"), log2fc=F.col("log2fc")), F.col("at"))
    return nodes, edges, writes


def genes(spark) -> DataFrame:
    """(gene, chromosome, coordinates, length): the fixed dimension of eleven genes."""
    return spark.createDataFrame([(g, *v) for g, v in rules.GENES.items()], "gene string, chromosome string, coordinates string, length string")


def enrich_genes(g: G.Graph, drug: str) -> G.Graph:
    """Known genes get their place as properties and the type Target; missing ones are added, with an edge from the drug."""
    dim = F.broadcast(genes(g.nodes.sparkSession))
    have = g.nodes.join(dim, F.upper(F.col("name")) == F.col("gene"), "left")
    place = F.create_map(*[x for c in ("chromosome", "coordinates", "length") for x in (F.lit(c), F.col(c))])
    old = F.map_filter("properties", lambda k, _: ~k.isin("chromosome", "coordinates", "length"))
    hit = F.col("gene").isNotNull()
    nodes = have.select(*[c for c in g.nodes.columns if c not in ("type", "properties")], F.when(hit, "Target").otherwise(F.col("type")).alias("type"), F.when(hit, F.map_concat(old, place)).otherwise(F.col("properties")).alias("properties"))
    docs = g.nodes.select("doc_id").distinct()
    named = g.nodes.select("doc_id", F.upper("name").alias("gene"))
    every = docs.select("doc_id", F.explode(F.array(*map(F.lit, rules.GENES))).alias("gene"))
    lack = every.join(named, ["doc_id", "gene"], "left_anti").join(dim, "gene")
    tid = F.concat(F.lit("target:"), F.lower("gene"))
    made = lack.select("doc_id", tid.alias("id"), F.col("gene").alias("name"), F.lit("Target").alias("type"), F.map_concat(_map(source=F.lit("Manual_Enrichment")), place).alias("properties"), F.lit(8 * G.BAND).alias("seq"))
    links = _edge(lack, 8, F.lit(f"drug:{drug.lower()}"), tid, "inhibits", _map(source=F.lit("Inferred_Mechanism"), confidence=F.lit("High")))
    return G.Graph(nodes.unionByName(made), g.edges.unionByName(links))
