"""Property graphs as two DataFrames, and the operators on them.

Nodes: id, name, type, properties map<string,string>, seq. Edges: source_id, target_id, type, properties, confidence, seq. ``seq``
is the order in which producers gave the rows: where the first or the last wins, it is by seq, never by the order of files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigraph.functions import rules
from evigraph.functions.text import cascade, contains_any
from evigraph.operators.store import kept

#: Room between the orders of two producers: more rows than any of them gives.
BAND = 10**15


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_k(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key, numbered in rn; Spark cuts groups to k before it exchanges them."""
    return df.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rn") <= k)


def last_value_of(df: DataFrame, keys: list[str], value: str, order: Column | str) -> DataFrame:
    """Each key's value in its last row; combined before the exchange."""
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def union_sparse(*parts: DataFrame) -> DataFrame:
    """All rows; columns that a part lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def known_only(df: DataFrame, dim: DataFrame, left: str, right: str) -> DataFrame:
    return df.join(dim.select(F.col(right).alias("_k")), F.col(left) == F.col("_k"), "left_semi")


def missing(df: DataFrame, dim: DataFrame, left: str, right: str) -> DataFrame:
    return df.join(dim.select(F.col(right).alias("_k")), F.col(left) == F.col("_k"), "left_anti")


def dangling_edges(edges: DataFrame, nodes: DataFrame, source: str = "source_id", target: str = "target_id", node: str = "id") -> DataFrame:
    """Edges of which an end is no node, with the end in ``missing_end`` (source before target)."""
    ids = nodes.select(F.col(node).alias("_k")).distinct()
    s = edges.join(ids.withColumnRenamed("_k", "_s"), F.col(source) == F.col("_s"), "left")
    both = s.join(ids.withColumnRenamed("_k", "_t"), F.col(target) == F.col("_t"), "left")
    end = F.when(F.col("_s").isNull(), "source").when(F.col("_t").isNull(), "target")
    return both.withColumn("missing_end", end).where("missing_end IS NOT NULL").drop("_s", "_t")


def with_known_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return known_only(known_only(edges, nodes, "source_id", "id"), nodes, "target_id", "id")


def gate_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes of an allowed type, the first of each id."""
    return first_of(nodes.where(F.col("type").isin(rules.NODE_TYPES)), ["id"], ["seq"])


def gate_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between known nodes; a type that is not allowed becomes linked_to. Repeated edges stay."""
    kind = F.when(F.col("type").isin(rules.EDGE_TYPES), F.col("type")).otherwise("linked_to")
    return with_known_ends(edges.withColumn("type", kind), nodes)


def edge_set(edges: DataFrame) -> DataFrame:
    """The first edge of each source, type and target."""
    return first_of(edges, ["source_id", "type", "target_id"], ["seq"])


def pairs_allowed(edges: DataFrame, nodes: DataFrame, allowed: DataFrame, strict: bool = False) -> DataFrame:
    """Edges with ``allowed``: their types of node may have this type of edge. With ``strict`` only those.

    ``allowed`` (source_type, target_type, type) is a fixed matrix, broadcast.
    """
    kind = nodes.select("id", F.col("type").alias("_type"))
    out = edges.join(kind.selectExpr("id AS source_id", "_type AS source_type"), "source_id", "left").join(kind.selectExpr("id AS target_id", "_type AS target_type"), "target_id", "left")
    out = out.join(F.broadcast(allowed.select("source_type", "target_type", "type", F.lit(True).alias("_ok"))), ["source_type", "target_type", "type"], "left")
    out = out.withColumn("allowed", F.coalesce("_ok", F.lit(False))).drop("_ok")
    return out.where("allowed") if strict else out


def predicate_type(c: Column) -> Column:
    """The type of edge of a predicate: itself where it is one, else what it maps to, else linked_to."""
    plain = F.replace(F.lower(c), F.lit(" "), F.lit("_"))
    named = {t: t for t in rules.EDGE_TYPES} | rules.PREDICATES
    return F.coalesce(F.create_map(*[F.lit(x) for kv in named.items() for x in kv])[plain], F.lit("linked_to"))


def inferred_type(c: Column) -> Column:
    """The type of node that a name suggests; null if it is no entity."""
    n = F.lower(c)
    generic = contains_any(n, rules.GENERIC_WORDS) & F.contains(n, F.lit("study")) & ~F.contains(n, F.lit("clinical"))
    return F.when(~generic, cascade(n, [(contains_any(n, words), kind) for kind, words in rules.TYPE_WORDS], F.lit(None)))


def node_id(kind: Column | str, name: Column) -> Column:
    plain = lambda c: F.replace(F.lower(c), F.lit(" "), F.lit("_"))
    return F.concat(plain(kind if isinstance(kind, Column) else F.lit(kind)), F.lit(":"), plain(F.trim(name)))


def merge_target(obj: Column) -> Column:
    """struct<owner, key> for an object that is a property of the study or the drug, else null."""
    o = F.lower(obj)
    stat = contains_any(o, rules.STUDY_STATISTIC_WORDS)
    drug = contains_any(o, rules.DRUG_PROPERTY_WORDS) & ~F.contains(o, F.lit("creatinine"))
    make = lambda owner, key: F.struct(F.lit(owner).alias("owner"), F.lit(key).alias("key"))
    return F.when(stat, make("study", "study_statistic")).when(drug, make("drug", "pk_dosing_info"))


def is_summary(term: Column) -> Column:
    return contains_any(F.lower(term), rules.SUMMARY_TERMS)


def property_key(predicate: Column) -> Column:
    """The property that a predicate with a number names: has_dose is dose."""
    p = F.lower(predicate)
    return F.replace(F.replace(p, F.lit("has_")), F.lit("is_"))


def concat_in_order(df: DataFrame, keys: list[str], value: str, order: list[str], sep: str = "; ") -> DataFrame:
    """Each key's values, in order, as one text."""
    one = F.struct(*order, F.col(value).alias("_v"))
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["_v"]), sep).alias(value))


def add_properties(nodes: DataFrame, more: DataFrame) -> DataFrame:
    """``nodes`` with properties from ``more`` (id, key, value): a key that is there is overwritten."""
    maps = more.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("_more"))
    out = nodes.join(maps, "id", "left")
    kept = F.map_filter("properties", lambda k, _: ~F.coalesce(F.map_contains_key(F.col("_more"), k), F.lit(False)))
    return out.withColumn("properties", F.when(F.col("_more").isNull(), F.col("properties")).otherwise(F.map_concat(kept, "_more"))).drop("_more")


def type_counts(df: DataFrame, kind: str) -> DataFrame:
    return df.groupBy(kind).agg(F.count("*").alias("n"))


def statistics(g: Graph) -> DataFrame:
    """One row: nodes, edges, drugs, properties of nodes."""
    n = g.nodes.select(F.lit(1).alias("n_nodes"), (F.col("type") == "Drug").cast("int").alias("n_drugs"), F.coalesce(F.size("properties"), F.lit(0)).alias("n_properties"), F.lit(0).alias("n_edges"))
    both = n.unionByName(g.edges.select(*[F.lit(int(c == "n_edges")).alias(c) for c in n.columns]))
    return both.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in n.columns])


def samples(df: DataFrame, kind: str, order: list, k: int) -> DataFrame:
    return top_k(df, [kind], order, k)


def neighbours(edges: DataFrame, start: DataFrame, source: str = "source_id", target: str = "target_id") -> DataFrame:
    """(start, neighbour): one step along edges in either direction, each once. ``start`` has a column id."""
    both = edges.select(F.col(source).alias("id"), F.col(target).alias("neighbour")).union(edges.select(F.col(target).alias("id"), F.col(source).alias("neighbour")))
    return both.join(start.select("id"), "id", "left_semi").where("neighbour <> id").distinct()


#: Sources with the same targets are dealt to blocks of so many in the mean; two blocks meet in one row, whose pairs a task may hold at once.
BLOCK = 512


def co_neighbours(edges: DataFrame, source: str = "source_id", target: str = "target_id") -> DataFrame:
    """(a, b, n): sources that share targets, a before b, with how many. Sources and targets count once each.

    Sources with the same targets (their number and two 64-bit sums of hashes) are one class, and shared targets are counted between
    classes, so what is exchanged are edges, pairs of classes and pairs of blocks of their members, not the pairs of sources."""
    e = kept(edges.select(F.col(source).alias("a"), F.col(target).alias("t")).dropna().distinct())
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), "t").cast("decimal(38,0)"))
    same = kept(e.groupBy("a").agg(F.count("*").alias("x"), total("a").alias("y"), total("b").alias("z")))
    classes = same.groupBy("x", "y", "z").agg(F.min("a").alias("c"), F.count("*").alias("size"))
    dealt = F.pmod(F.xxhash64("a"), F.ceil(F.col("size") / BLOCK)).alias("k")
    blocks = kept(same.join(classes, ["x", "y", "z"]).select("a", "c", dealt).groupBy("c", "k").agg(F.collect_list("a").alias("as")))

    # the first of a class stands for it
    r = e.join(blocks.select(F.col("c").alias("a")).distinct(), "a", "left_semi").select(F.col("a").alias("c"), "t")
    pairs = r.join(r.withColumnRenamed("c", "d"), "t").where("c <= d").groupBy("c", "d").agg(F.count("*").alias("n"))
    met = pairs.join(blocks, "c").join(blocks.select(F.col("c").alias("d"), F.col("k").alias("l"), F.col("as").alias("bs")), "d").where("c < d OR k <= l")
    spread = met.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "c", "k", "d", "l")
    every = spread.select("n", (F.struct("c", "k") == F.struct("d", "l")).alias("own"), "bs", F.explode("as").alias("x")).select("n", "own", "x", F.explode("bs").alias("y"))
    return every.where("NOT own OR x < y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "n")


def search(nodes: DataFrame, edges: DataFrame, word: str) -> DataFrame:
    """Nodes whose name holds the word, and those beside them."""
    hit = nodes.where(F.contains(F.lower("name"), F.lit(word.lower()))).select("id")
    ids = hit.union(neighbours(edges, hit).select(F.col("neighbour").alias("id"))).distinct()
    return nodes.join(ids, "id", "left_semi")
