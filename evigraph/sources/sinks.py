"""Exports of graphs and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Colour of a type in the graph view.
COLOURS = {"Drug": "#ff6b6b", "Target": "#4ecdc4", "Pathway": "#45b7d1", "Animal Study": "#96ceb4", "Clinical Study": "#feca57", "Adverse Event": "#ff9ff3", "Biomarker": "#54a0ff"}


def cypher_text(c: Column) -> Column:
    """A quoted literal; null for null."""
    safe = F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    return F.coalesce(F.concat(F.lit("'"), safe, F.lit("'")), F.lit("null"))


def cypher_key(c: Column) -> Column:
    return F.concat(F.lit("`"), F.translate(c, " -", "__"), F.lit("`"))


def _properties(c: Column) -> Column:
    return F.transform(F.map_entries(c), lambda e: F.concat(cypher_key(e["key"]), F.lit(": "), cypher_text(e["value"])))


def cypher_node() -> Column:
    """The statement that creates a node (id, name, type, properties)."""
    body = F.concat(F.array(F.concat(F.lit("id: "), cypher_text(F.col("id"))), F.concat(F.lit("name: "), cypher_text(F.col("name")))), F.coalesce(_properties(F.col("properties")), F.array().cast("array<string>")))
    return F.concat(F.lit("CREATE (:`"), F.replace(F.coalesce("type", F.lit("Entity")), F.lit(" "), F.lit("_")), F.lit("` {"), F.array_join(body, ", "), F.lit("});"))


def cypher_edge() -> Column:
    """The statement that creates an edge (source_id, target_id, type, confidence, properties)."""
    body = F.concat(F.array_compact(F.array(F.concat(F.lit("confidence: "), F.col("confidence").cast("string")))), F.coalesce(_properties(F.col("properties")), F.array().cast("array<string>")))
    kind = F.upper(F.translate(F.col("type"), " -", "__"))
    return F.concat(
        F.lit("MATCH (a {id: "), cypher_text(F.col("source_id")), F.lit("}), (b {id: "), cypher_text(F.col("target_id")), F.lit("}) CREATE (a)-[:`"), kind, F.lit("`"),
        F.when(F.size(body) > 0, F.concat(F.lit(" {"), F.array_join(body, ", "), F.lit("}"))).otherwise(""), F.lit("]->(b);"),
    )


def write_cypher(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes under ``path``/nodes, edges under ``path``/edges, a statement a line."""
    nodes.select(cypher_node().alias("value")).write.mode("overwrite").text(f"{path}/nodes")
    edges.select(cypher_edge().alias("value")).write.mode("overwrite").text(f"{path}/edges")


def nodes_wide(nodes: DataFrame) -> DataFrame:
    """id, Label, Type and a sorted column for each property; one pass finds the keys, which are few."""
    keys = [r[0] for r in nodes.select(F.explode(F.map_keys("properties")).alias("k")).distinct().orderBy("k").collect()]
    return nodes.select("id", F.col("name").alias("Label"), F.col("type").alias("Type"), *[F.col("properties")[k].alias(k) for k in keys])


def edges_flat(edges: DataFrame) -> DataFrame:
    return edges.select(
        F.col("source_id").alias("Source"), F.col("target_id").alias("Target"), F.col("type").alias("Type"), F.coalesce("confidence", F.lit(1.0)).alias("Confidence"), F.coalesce(F.col("properties")["source"], F.lit("LLM")).alias("Source_Tool")
    )


def write_csv(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes_wide(nodes).write.mode("overwrite").option("header", True).csv(f"{path}/nodes")
    edges_flat(edges).write.mode("overwrite").option("header", True).csv(f"{path}/edges")


def write_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def research_nodes(nodes: DataFrame) -> DataFrame:
    """The fixed columns in front, the rest sorted."""
    lead = ["node_id", "node_type"]
    return nodes.select(*lead, *sorted(c for c in nodes.columns if c not in lead))


def view_elements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(element): JSON of the nodes and edges of a graph view, with colours."""
    colour = F.coalesce(F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv])[F.col("type")], F.lit("#c8d6e5"))
    n = nodes.select(F.to_json(F.struct(F.struct("id", F.col("name").alias("label"), "type", colour.alias("color"), "properties").alias("data"))).alias("element"))
    e = edges.select(F.to_json(F.struct(F.struct(F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.col("type").alias("label")).alias("data"))).alias("element"))
    return n.union(e)


def dense_sheet(groups: DataFrame, section: str, order: list[str]) -> DataFrame:
    """(row, kind, a, b): a grouped sheet of (section, field, value): a banner before each section, then its fields."""
    from pyspark.sql import Window as W

    w = W.partitionBy(section).orderBy(*order)
    rows = groups.withColumn("_rn", F.row_number().over(w))
    banner = rows.where("_rn = 1").select(section, F.lit(0).alias("row"), F.lit("banner").alias("kind"), F.upper(section).alias("a"), F.lit(None).cast("string").alias("b"))
    return banner.unionByName(rows.select(section, F.col("_rn").alias("row"), F.lit("field").alias("kind"), F.col("field").alias("a"), F.col("value").alias("b")))


def column_widths(df: DataFrame, least: int = 10, most: int = 60) -> DataFrame:
    """(column, width): the longest text of each column, within bounds."""
    wide = df.agg(*[F.max(F.length(F.col(f"`{c}`").cast("string"))).alias(c) for c in df.columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.least(F.greatest(F.coalesce(F.col(f"`{c}`"), F.lit(0)), F.lit(len(c)), F.lit(least)), F.lit(most)).alias("width")) for c in df.columns])).alias("_r")
    return wide.select(rows).select("_r.*")
