"""From documents to the evidence graph: blocks, sections, answers, records, graph, as steps that can be taken up again.

Documents are rows (doc_id, text) of markdown. What answers a block is a provider: by default the vocabulary terms that it names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigraph import providers
from evigraph.functions import text as X
from evigraph.operators import builder, nested, retrieval
from evigraph.operators.flow import Flow, Step

_TEXT, _LIST = T.StringType(), T.ArrayType(T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: The record that the graph is built from.
RECORD = _struct(
    study_metadata=_struct(study_identifiers=_LIST, study_phase=_TEXT, study_status=_TEXT, sponsor_information=_TEXT),
    safety_data=_struct(adverse_events=T.ArrayType(_struct(adverse_event_preferred_term=_TEXT, grade_3_4_ae_frequency=_TEXT, all_grades_frequency=_TEXT, serious_adverse_event_flag=T.BooleanType()))),
    pharmacokinetics=_struct(**{f: _TEXT for _, f in builder.BIOMARKERS}),
    preclinical_toxicology=_struct(toxicity_species=_LIST),
    mechanism_of_action=_struct(molecular_targets=_LIST),
    semantic_relationships=_struct(relationships=T.ArrayType(_struct(subject=_TEXT, predicate=_TEXT, object=_TEXT, confidence=_TEXT))),
)


def named_in(blocks: DataFrame) -> DataFrame:
    """Answers (doc_id, chunk_index, section, answer) by rule: the adverse events and the targets that a block names."""
    found = providers.entities(blocks)
    events, targets = (F.coalesce(F.col("entities")[k], F.array().cast("array<string>")) for k in ("DISEASE", "CHEMICAL"))
    terms = F.transform(events, lambda x: F.struct(x.alias("adverse_event_preferred_term")))
    safety = F.struct(F.lit("Safety and Adverse Events").alias("section"), F.to_json(F.struct(terms.alias("adverse_events"))).alias("answer"))
    target = F.struct(F.lit("Mechanism of Action").alias("section"), F.to_json(F.struct(targets.alias("molecular_targets"))).alias("answer"))
    said = F.array_compact(F.array(F.when(F.size(events) > 0, safety), F.when(F.size(targets) > 0, target)))
    return found.select("doc_id", "chunk_index", F.explode(said).alias("a")).select("doc_id", "chunk_index", "a.*")


def steps(drug: str, answer: Callable[[DataFrame], DataFrame] = named_in, version: str = "1", route: Callable[[DataFrame], DataFrame] | None = None) -> list[Step]:
    """The steps from ``documents`` to ``graph.nodes`` and ``graph.edges``; ``version`` is that of the provider of answers."""

    def graph(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
        # a document without an answer has a record of defaults
        g = builder.build(t["records"].select("doc_id", "record.*"), drug)
        return {"nodes": g.nodes, "edges": g.edges}

    def records(t: dict[str, DataFrame]) -> DataFrame:
        silent = t["documents"].select("doc_id").distinct().join(t["answers"].select("doc_id").distinct(), "doc_id", "left_anti")
        every = t["answers"].unionByName(silent.select("doc_id", F.lit(0).alias("chunk_index"), F.lit("Other").alias("section"), F.lit(None).cast("string").alias("answer")))
        return nested.nested_records(every, RECORD).drop("other")

    def blocks(t: dict[str, DataFrame]) -> DataFrame:
        # a file may be read in fewer tasks than there are, so the texts are dealt once
        docs = t["documents"]
        return X.header_blocks(docs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id"), "doc_id", "text")

    return [
        Step("blocks", lambda t: blocks(t).withColumnRenamed("block", "chunk_index"), ("documents",)),
        Step("sections", lambda t: retrieval.classify_blocks(t["blocks"], route), ("blocks",)),
        Step("answers", lambda t: answer(retrieval.worth_asking(t["sections"], 0)).select("doc_id", "chunk_index", "section", "answer"), ("sections",), version),
        Step("records", records, ("documents", "answers")),
        Step("graph", graph, ("records",), parameters={"drug": drug}, outputs=("nodes", "edges")),
    ]


def to_graph(spark: SparkSession, documents: DataFrame, drug: str, root: str | None = None, **options) -> dict[str, DataFrame]:
    """All tables of the flow over ``documents``; a given folder keeps them for the next run."""
    return Flow(spark, steps(drug, **options), root).run({"documents": documents.select("doc_id", "text")})
