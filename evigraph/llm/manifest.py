"""Merkle manifest of a table of documents, by supersteps over RDDs of messages.

Each row is a leaf, hashed over its length-prefixed fields. Leaves of one source, by doc_id, are cut into runs of ``FANOUT``; a run is a
vertex. Going up, children send their digest to their run; a run that has all that it awaits hashes them and forwards the digest to
its own parent, until one node is left: the subroot of the source. Subroots, by source, are the leaves of the last tree, whose top is the
root. Going down, the root's run sends every child the digests to its left and right; a run adds its own and sends them on, so one
message serves a whole run of leaves, and the lowest runs prove and verify their leaves.

A vertex gets at most ``FANOUT`` messages up and one down, whatever the source, so a source of a third of all rows is spread over all tasks.
Places in the order come from a range partitioning and counts by partition; nothing is collected but the number of nodes of the largest
trees. There are as many supersteps as levels, the logarithm of the rows, so the lineage stays short and starts at a table in the shared
folder: lost executors cost a recomputation from there.

Defined results: a null field is ``-``; a null source is a source of its own and comes first; null doc_ids come first in their source and
are never tampered with; rows of one doc_id stand by their leaf, equal rows are leaves of their own; a null or empty text is hashed as
such; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigraph.llm._spark import shuffle_partitions, stored

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
PATH = "array<struct<left: string, right: string>>"


def leaf_hash(*fields: Column) -> Column:
    """SHA-256 of the fields, each ``-`` if null, else its bytes in UTF-8 counted, a colon and the value."""
    as_text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in as_text]), 256)


def lower_tampered() -> Column:
    """The text as it is met again: A-Z in lower case where 5 divides the CRC of the id."""
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return F.when(hit, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))


def ranked(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with ``place`` (from 0, in its group) and ``among`` (rows of the group), without a task for a group."""
    names = [*rows.columns, "part", "nth"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            runs = pc.run_end_encode(b.column(names.index(group)))
            nth, start = np.empty(b.num_rows, np.int64), 0
            for end, value in zip(runs.run_ends.to_pylist(), runs.values.to_pylist()):
                seen = seen if value == last else 0
                nth[start:end] = np.arange(seen, seen + end - start)
                last, seen, start = value, seen + end - start, end
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part)), pa.array(nth)], names)

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", part long, nth long"
    by_range = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), group, *order).sortWithinPartitions(group, *order)
    numbered = stored(by_range.mapInArrow(number, kinds))
    counts = numbered.groupBy("part", group).agg(F.count("*").alias("many"))
    # a group has one row for each partition that it reaches
    earlier = W.partitionBy(group).orderBy("part")
    spans = counts.select("part", group, (F.sum("many").over(earlier) - F.col("many")).alias("before"), F.sum("many").over(W.partitionBy(group)).alias("among"))
    return numbered.join(spans, ["part", group]).withColumn("place", F.col("before") + F.col("nth")).drop("part", "nth", "before")


def _digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def _climb(messages: RDD, parts: int) -> tuple[RDD, RDD]:
    """One superstep up. Messages ((tree, run), (slot, digest, nodes of the level, payload)) become (runs, sent): vertices
    ((tree, run), (digests, payloads, nodes)) and what they send, ((tree, run), digest, nodes of the next level)."""

    def complete(vertex):
        (tree, run), inbox = vertex
        children = sorted(inbox, key=lambda m: m[0])
        nodes = children[0][2]
        if [m[0] for m in children] != list(range(min(FANOUT, nodes - FANOUT * run))):
            raise ValueError(f"run {run} of tree {tree} did not hear from all its children")
        return (tree, run), ([m[1] for m in children], [m[3] for m in children], nodes)

    runs = messages.groupByKey(parts).map(complete, preservesPartitioning=True)
    return runs, runs.map(lambda v: (v[0], _digest(v[1][0]), -(-v[1][2] // FANOUT)))


def _up(first: RDD, largest: int, parts: int) -> tuple[list[RDD], RDD]:
    """(runs by level, tops): tops are (tree, (digest, level of the top run)) of trees with more than one leaf."""
    levels, tops, messages = [], [], first
    while largest > 1:
        runs, sent = _climb(messages, parts)
        level = len(levels)
        tops.append(sent.filter(lambda s: s[2] == 1).map(lambda s, level=level: (s[0][0], (s[1], level))))
        messages = sent.filter(lambda s: s[2] > 1).map(lambda s: ((s[0][0], s[0][1] // FANOUT), (s[0][1] % FANOUT, s[1], s[2], None)))
        levels.append(runs)
        largest = -(-largest // FANOUT)
    return levels, first.context.union(tops) if tops else first.context.emptyRDD()


def _beside(digests: list[str], slot: int) -> tuple[str, str]:
    return "".join(digests[:slot]), "".join(digests[slot + 1 :])


def _down(levels: list[RDD], starts: RDD, parts: int) -> RDD:
    """From starts (tree, (level, state, path)) to ((tree, run), (digests, payloads, state, path)) of the lowest runs.

    A path lists what stands left and right of the node and of each node above it, lowest first."""

    def below(vertex):
        (tree, run), ((digests, _, _), (state, path)) = vertex
        return [((tree, FANOUT * run + k), (state, (_beside(digests, k), *path))) for k in range(len(digests))]

    inbox = None
    for level in range(len(levels) - 1, -1, -1):
        here = starts.filter(lambda s, level=level: s[1][0] == level).map(lambda s: ((s[0], 0), s[1][1:]))
        joined = levels[level].join(here if inbox is None else here.union(inbox), parts)
        inbox = joined.flatMap(below)
    return joined.map(lambda v: (v[0], (v[1][0][0], v[1][0][1], *v[1][1]))) if levels else starts.context.emptyRDD()


def _messages(rows: DataFrame) -> RDD:
    """Rows (tree, place, among, digest, payload columns ...) as the messages of leaves to their runs."""
    return rows.rdd.map(lambda r: ((r[0], r[1] // FANOUT), (r[1] % FANOUT, r[3], r[2], tuple(r[4:]))))


def manifest(docs: DataFrame, claimed: Column | None = None, with_path: bool = False) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256 (hash of the sibling path), folded_root (from ``claimed``, the text as it is met
    again, and that path), verified; with ``with_path`` also ``path``, the digests left and right of the node by level."""
    spark, parts = docs.sparkSession, shuffle_partitions(docs.sparkSession)
    now = F.col("text") if claimed is None else claimed
    fields = [F.col(c) for c in FIELDS]
    hashed = docs.select(
        F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit("")).alias("key"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf_hash(*fields).alias("leaf"),
        F.when(now.eqNullSafe(F.col("text")), F.lit(None)).otherwise(leaf_hash(*fields[:-1], now)).alias("met"),
    )
    leaves = ranked(hashed, "key", "doc_id", "leaf", "met")
    sources = leaves.where("place = 0").select(F.lit(0).alias("tree"), "key", "among")
    order = stored(ranked(sources.withColumnRenamed("among", "leaves"), "tree", "key").select("key", F.col("place").alias("source"), F.col("among").alias("sources")))
    rows = stored(leaves.join(order, "key").select("source", "place", "among", "leaf", "doc_id", "met", "sources"))
    top = rows.agg(F.max("among"), F.max("sources")).first()
    if top[0] is None:
        return spark.createDataFrame([], RESULT + (f", path {PATH}" if with_path else ""))
    levels, tops = _up(_messages(rows.where("among > 1").drop("sources")), top[0], parts)
    lone = rows.where("among = 1").rdd.map(lambda r: (r[0], (r[3], -1, r[4], r[5])))
    n_sources = top[1]
    subroots = tops.map(lambda t: (t[0], (*t[1], None, None))).union(lone)
    # the payload of a subroot is what its own tree needs on the way down
    last, roots = _up(subroots.map(lambda t: ((0, t[0] // FANOUT), (t[0] % FANOUT, t[1][0], n_sources, (t[0], *t[1])))), n_sources, parts)
    if last:
        heads = _down(last, roots.map(lambda t: (t[0], (t[1][1], t[1][0], ()))), parts)
        begin = heads.flatMap(lambda v: [(p, v[1][2], (_beside(v[1][0], k), *v[1][3])) for k, p in enumerate(v[1][1])])
    else:
        begin = subroots.map(lambda t: ((t[0], *t[1]), t[1][0], ()))  # one source: its subroot is the root

    def leaf_row(doc_id, leaf, met, state, path):
        subroot, root = state
        folded = reduce(lambda h, side: _digest([side[0], h, side[1]]), path, met or leaf)
        proof = _digest([s for side in path for s in side])
        row = (doc_id, leaf, subroot, root, proof, folded, folded == root)
        return (*row, [list(side) for side in path]) if with_path else row

    # begin: ((source, subroot, level, doc_id, met), root, path)
    alone = begin.filter(lambda b: b[0][2] < 0).map(lambda b: leaf_row(b[0][3], b[0][1], b[0][4], (b[0][1], b[1]), b[2]))
    starts = begin.filter(lambda b: b[0][2] >= 0).map(lambda b: (b[0][0], (b[0][2], (b[0][1], b[1]), b[2])))
    lowest = _down(levels, starts, parts)
    proved = lowest.flatMap(lambda v: [leaf_row(p[0], v[1][0][k], p[1], v[1][2], (_beside(v[1][0], k), *v[1][3])) for k, p in enumerate(v[1][1])])
    return spark.createDataFrame(alone.union(proved), RESULT + (f", path {PATH}" if with_path else ""), verifySchema=False)


def _oracle(levels: int = 6, top_levels: int = 4) -> str:
    """The same in SQL, for sources of at most 16 ** levels rows: the trees level by level, then each leaf's path through them."""

    def hashed(text: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(strlen({x}::VARCHAR)::VARCHAR || ':' || {x}::VARCHAR, '-')" for x in (*FIELDS[:-1], text)) + ")"

    def tree(name: str, first: str, n: int) -> str:
        """``name``k has the nodes of level k, ``name``s those with what stands left and right of them, ``name``t the tops."""
        out = f"{name}0 AS ({first})"
        for k in range(n):
            out += f", {name}{k + 1} AS (SELECT g, i // 16 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h, (n + 15) // 16 AS n FROM {name}{k} WHERE n > 1 GROUP BY g, i // 16, n)"
        side = "coalesce(string_agg(h, '') OVER (PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN {}), '')"
        sides = f"{side.format('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS a, {side.format('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS b"
        out += f", {name}s AS (" + " UNION ALL ".join(f"SELECT {k} AS k, g, i, {sides} FROM {name}{k} WHERE n > 1" for k in range(n)) + ")"
        return out + f", {name}t AS (" + " UNION ALL ".join(f"SELECT g, h FROM {name}{k} WHERE n = 1" for k in range(n + 1)) + ")"

    steps = "flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"
    met = f"CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN {hashed(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {hashed('text')} END"
    sql = f"WITH x AS (SELECT doc_id, coalesce('+' || source, '') AS g, {hashed('text')} AS leaf, {met} AS met FROM documents), "
    sql += "r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, met) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM x), "
    sql += tree("v", "SELECT g, i, leaf AS h, n FROM r", levels) + ", "
    sql += "o AS (SELECT g, h, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS n FROM vt), "
    sql += tree("w", "SELECT '' AS g, i, h, n FROM o", top_levels)
    # (p, f): the path as one string, the fold so far
    sql += ", f0 AS (SELECT r.doc_id, r.g, r.leaf, r.i, o.i AS j, o.h AS subroot, '' AS p, met AS f FROM r JOIN o USING (g))"
    last = "f0"
    for name, key, at, n in (("v", "g", "i", levels), ("w", "''", "j", top_levels)):
        for k in range(n):
            new = f"f{name}{k}"
            sql += f", {new} AS (SELECT y.* EXCLUDE (p, f), p || coalesce(a || b, '') AS p, CASE WHEN a IS NULL THEN f ELSE sha256(a || f || b) END AS f"
            sql += f" FROM {last} y LEFT JOIN {name}s s ON s.k = {k} AND s.g = {'y.g' if key == 'g' else key} AND s.i = y.{at} // {16**k})"
            last = new
    return sql + f" SELECT doc_id, leaf, subroot, t.h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = t.h AS verified FROM {last}, wt t"


ORACLE = _oracle()
