"""Lookups among a document's labelled chunks (doc_id, chunk_index, section, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigraph.functions import text as X


def classify_blocks(blocks: DataFrame, route=None) -> DataFrame:
    """Headed blocks with ``section``: by the heading, then by the content, then by ``route`` (a provider) for what is left."""
    # each lowered once, not for each word
    low = blocks.withColumns({"_title": F.lower("title"), "_head": X.content_head("content")}).withColumn("_named", X.header_section("_title", lowered=True))
    named = F.coalesce("_named", F.lit("Other")) != "Other"
    out = low.withColumn("section", F.when(named, F.col("_named")).otherwise(X.content_section("_head", lowered=True))).drop("_title", "_head", "_named")
    if route is None:
        return out
    rest = route(out.where("section = 'Other'"))
    return out.where("section <> 'Other'").unionByName(rest)


def section_index(chunks: DataFrame) -> DataFrame:
    """(doc_id, section, n, first, last), in the order of first."""
    return chunks.groupBy("doc_id", "section").agg(F.count("*").alias("n"), F.min("chunk_index").alias("first"), F.max("chunk_index").alias("last"))


def by_section(chunks: DataFrame, section: str) -> DataFrame:
    """The chunks of a section by its exact name; none for a name that no chunk has."""
    return chunks.where(F.col("section") == section)


def by_index(chunks: DataFrame, index: int) -> DataFrame:
    """The chunk of each document at an index; documents that end before it, and indexes below 0, give none."""
    return chunks.where((F.col("chunk_index") == index) & (F.col("chunk_index") >= 0))


def summary_text(chunks: DataFrame) -> DataFrame:
    """(doc_id, summary): a line for each section, by first chunk."""
    line = F.format_string("%s: %d chunks (%d-%d)", F.col("section"), F.col("n"), F.col("first"), F.col("last"))
    rows = section_index(chunks).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first", line.alias("line")))).alias("l"))
    return rows.select("doc_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("summary"))


def reference_index(chunks: DataFrame) -> DataFrame:
    """(doc_id, ref, target): the first chunk whose heading defines a table or section."""
    rows = chunks.select("doc_id", "chunk_index", F.explode(X.reference_heads("content")).alias("ref"))
    return rows.groupBy("doc_id", F.lower("ref").alias("ref")).agg(F.min("chunk_index").alias("target"))


def by_keyword(chunks: DataFrame, word: str, k: int = 5) -> DataFrame:
    """The k chunks of each document that name the word most often."""
    hits = chunks.withColumn("hits", X.occurrences("content", word)).where("hits > 0")
    w = W.partitionBy("doc_id").orderBy(F.desc("hits"), "chunk_index")
    return hits.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def adjacent(chunks: DataFrame, wanted: DataFrame, window: int = 1) -> DataFrame:
    """Chunks within ``window`` of a wanted (doc_id, chunk_index), but not that one itself; another wanted one may bring it in."""
    around = F.array(*[F.col("chunk_index") + d for d in range(-window, window + 1) if d])
    near = wanted.select("doc_id", F.explode(around).alias("chunk_index")).distinct()
    return chunks.join(near, ["doc_id", "chunk_index"], "left_semi")


def expand_references(chunks: DataFrame, most: int = 2) -> DataFrame:
    """(doc_id, chunk_index, target): chunks that a chunk's first references point to, not itself."""
    refs = chunks.select("doc_id", "chunk_index", F.explode(F.slice(X.references("content"), 1, most)).alias("ref"))
    return refs.join(reference_index(chunks), ["doc_id", "ref"]).where("target <> chunk_index").select("doc_id", "chunk_index", "target").distinct()


def unresolved(chunks: DataFrame) -> DataFrame:
    """(doc_id, ref): references that no heading defines."""
    refs = chunks.select("doc_id", F.explode(X.references("content")).alias("ref")).distinct()
    return refs.join(reference_index(chunks), ["doc_id", "ref"], "left_anti")


def worth_asking(chunks: DataFrame, least: int = 300) -> DataFrame:
    """Chunks worth asking about: all but short ones of the section Other."""
    return chunks.where((F.col("section") != "Other") | (F.length("content") > least))
