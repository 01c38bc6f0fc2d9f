"""The harmonized graph of signatures, drug facts, adverse events and expression.

Nodes (id, type, properties, source_file) and edges (source, target, relation, properties): the first of each id, and of each
source, relation and target, by seq.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions.cleaning import clean_value, drop_null_entries
from evigraph.operators import graph as G

TOP_GENES = 20


@dataclass
class Harmonized:
    nodes: DataFrame
    edges: DataFrame


def _props(**kv: Column) -> Column:
    return drop_null_entries(F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), clean_value(v))]))


_NONE = "cast(map() AS map<string,string>)"


def _node(df: DataFrame, ident: Column, kind: str, props: Column, source: str, seq: Column) -> DataFrame:
    return df.select(ident.alias("id"), F.lit(kind).alias("type"), props.alias("properties"), F.lit(source).alias("source_file"), seq.cast("long").alias("seq")).where("id IS NOT NULL")


def _edge(df: DataFrame, source: Column, target: Column, relation: str, seq: Column, props: Column | None = None) -> DataFrame:
    return df.select(source.alias("source"), target.alias("target"), F.lit(relation).alias("relation"), (props if props is not None else F.expr(_NONE)).alias("properties"), seq.cast("long").alias("seq")).where("source IS NOT NULL AND target IS NOT NULL")


def signature_graph(meta: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Drugs, signatures, cell lines, tissues and targets of signature metadata with a column ``row`` that orders it."""
    c = lambda n: clean_value(F.col(n))
    rows = meta.withColumn("sig", c("SignatureId")).withColumn("drug", c("Perturbagen")).where("sig IS NOT NULL AND drug IS NOT NULL")
    seq = F.col("row") * 10
    src = "meta_sigSearch"
    nodes = [
        _node(rows, F.col("drug"), "Drug", _props(lincspertid=F.col("lincspertid"), perturbagenID=F.col("perturbagenID"), pubChemID=F.col("pubChemID"), stitchID=F.col("stitchID")), src, seq),
        _node(rows, F.col("sig"), "Transcriptomic_Signature", _props(concentration=F.col("Concentration"), time=F.col("Time"), factor=F.col("factor"), is_exemplar=F.col("is_exemplar"), cell_line=F.col("CellLine"), tissue=F.col("Tissue"), gene_targets=F.col("GeneTargets"), lincspertid=F.col("lincspertid")), src, seq + 1),
        _node(rows, c("CellLine"), "CellLine", F.expr(_NONE), src, seq + 2),
        _node(rows.where(c("CellLine").isNotNull()), F.lower(c("Tissue")), "Tissue", _props(name=F.col("Tissue")), src, seq + 3),
    ]
    edges = [
        _edge(rows, F.col("drug"), F.col("sig"), "tested_in", seq),
        _edge(rows, F.col("sig"), c("CellLine"), "observed_in", seq + 1),
        _edge(rows, c("CellLine"), F.lower(c("Tissue")), "derived_from", seq + 2),
    ]
    targets = rows.select("drug", "row", F.explode(F.split(c("GeneTargets"), r"\|")).alias("t")).withColumn("t", F.trim("t")).where("t <> ''")
    tid = F.concat(F.lit("Target_"), "t")
    nodes.append(_node(targets, tid, "Target", _props(symbol=F.col("t")), src, F.col("row") * 10 + 4))
    edges.append(_edge(targets, F.col("drug"), tid, "targets", F.col("row") * 10 + 4))
    return nodes, edges


def main_drug(meta: DataFrame, default: str) -> str:
    """The drug of the last row that names one."""
    row = meta.select(clean_value("Perturbagen").alias("d"), clean_value("SignatureId").alias("s"), "row").where("d IS NOT NULL AND s IS NOT NULL").agg(F.max_by("d", "row")).first()
    return row[0] if row and row[0] else default


def legacy_properties(info: DataFrame) -> DataFrame:
    """(key, value) of rows (Category, Field, Value, row)."""
    c = lambda n: clean_value(F.col(n))
    key = F.replace(F.replace(F.concat(F.coalesce(c("Category"), F.lit("None")), F.lit("_"), c("Field")), F.lit(" "), F.lit("_")), F.lit("&"), F.lit("and"))
    return info.select(key.alias("key"), c("Value").alias("value"), "row").where("key IS NOT NULL AND value IS NOT NULL")


def tabular_properties(cells: DataFrame) -> DataFrame:
    """(key, value) of the first row of each sheet: cells (sheet, row, column, value), the first row below its headings."""
    first = G.first_of(cells.where("value IS NOT NULL"), ["sheet", "column"], ["row"]).join(cells.groupBy("sheet").agg(F.min("row").alias("row")), ["sheet", "row"], "left_semi")
    plain = F.replace(F.element_at(F.split("sheet", r"\. "), -1), F.lit(" "), F.lit("_"))
    sheet = F.when(F.contains("sheet", F.lit(". ")), F.replace(plain, F.lit("&"), F.lit("and"))).otherwise(plain)  # "&" stays in a name without a number
    key = F.replace(F.replace(F.replace(F.replace(F.concat(sheet, F.lit("_"), "column"), F.lit(" "), F.lit("_")), F.lit("(")), F.lit(")")), F.lit("/"), F.lit("_"))
    return first.select(key.alias("key"), clean_value("value").alias("value"), "row").where("value IS NOT NULL")


def event_graph(safety: DataFrame, drug: str) -> tuple[DataFrame, DataFrame]:
    """Events and ``causes`` edges of rows (term, percent, grade_3_4, sae, teae, row)."""
    rows = safety.withColumn("t", clean_value("term")).where("t IS NOT NULL")
    ident = F.concat(F.lit("AdverseEvent_"), F.replace("t", F.lit(" "), F.lit("_")))
    seq = F.lit(2 * G.BAND) + F.col("row")
    props = _props(frequency=F.col("percent"), grade_3_4_count=F.col("grade_3_4"), is_sae=F.col("sae"), is_teae=F.col("teae"))
    return _node(rows, ident, "AdverseEvent", _props(name=F.col("t")), "consolidated_AE", seq), _edge(rows, F.lit(drug), ident, "causes", seq, props)


def top_genes(expression: DataFrame, signatures: DataFrame, k: int = TOP_GENES) -> DataFrame:
    """The k genes of each known signature with the largest change; ties by symbol; rows without numbers are left out."""
    rows = expression.select(clean_value("signatureID").alias("sig"), clean_value("Name_GeneSymbol").alias("gene"), F.col("Value_LogDiffExp").cast("double").alias("lfc"), F.col("Significance_pvalue").cast("double").alias("p"))
    rows = G.known_only(rows.where("NOT isnan(lfc) AND lfc IS NOT NULL"), signatures, "sig", "id")
    return G.top_k(rows, ["sig"], [F.abs("lfc").desc(), "gene"], k)


def harmonize(default_drug: str, meta: DataFrame | None = None, expression: DataFrame | None = None, info: DataFrame | None = None, safety: DataFrame | None = None) -> Harmonized:
    """The graph of those inputs that are given; ``info`` is (key, value, row), the drug's properties."""
    given = next(d for d in (meta, expression, info, safety) if d is not None)
    nodes, edges = signature_graph(meta) if meta is not None else ([], [])
    drug = main_drug(meta, default_drug) if meta is not None else default_drug
    one = given.sparkSession.range(1)
    nodes.append(_node(one, F.lit(drug), "Drug", F.create_map(F.lit("name"), F.lit(drug)), "Inferred_Base", F.lit(G.BAND)))
    if safety is not None:
        n, e = event_graph(safety, drug)
        nodes.append(n)
        edges.append(e)
    known = G.first_of(G.union_sparse(*nodes), ["id"], ["seq"])
    if expression is not None:
        top = top_genes(expression, known.where("type = 'Transcriptomic_Signature'")).where("gene IS NOT NULL")
        seq = F.lit(3 * G.BAND) + F.col("rn")
        known = G.first_of(known.unionByName(_node(top, F.col("gene"), "Biomarker", _props(gene=F.col("gene"), source=F.lit("signature_top_20")), "", seq)), ["id"], ["seq"])
        edges.append(_edge(top, F.col("sig"), F.col("gene"), "associated_with", seq, F.create_map(F.lit("log_fold_change"), F.col("lfc").cast("string"), F.lit("p_value"), F.col("p").cast("string"))))
    if info is not None:
        last = info.groupBy("key").agg(F.max_by("value", "row").alias("value"))
        known = G.add_properties(known, last.select(F.lit(drug).alias("id"), "key", "value"))
    if not edges:
        edges = [_edge(one, F.lit(None).cast("string"), F.lit(None).cast("string"), "none", F.lit(0))]
    return Harmonized(known, G.first_of(G.union_sparse(*edges), ["source", "relation", "target"], ["seq"]))


def validate(g: Harmonized) -> DataFrame:
    """(metric, value): totals, drugs, dangling edges."""
    bad = G.dangling_edges(g.edges, g.nodes, "source", "target", "id")
    counts = [
        g.nodes.agg(F.lit("nodes").alias("metric"), F.count("*").alias("value")),
        g.edges.agg(F.lit("edges"), F.count("*")),
        g.nodes.where("type = 'Drug'").agg(F.lit("drugs"), F.count("*")),
        bad.agg(F.lit("dangling"), F.count("*")),
    ]
    return G.union_sparse(*[c.toDF("metric", "value") for c in counts])
