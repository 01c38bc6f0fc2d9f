"""Jaccard self-join on word shingles with a token-group matrix.

A document is its set of shingles. Documents with equal sets are one class. Of each class the first shingles in a global order
(rare before frequent) are exchanged, so many that two classes that link share a tenth of the smaller one there. Then:

1. Each class is verified against at most two leaders: of the classes that share the least shingle of an eighth of the hash
   space with it, those with the largest part of shared shingles, since an original has no words of its own and its copies do.
   What links so is a group of similar documents.
2. The token-group matrix has a row for each exchanged shingle and group that holds it. A class is a query to the groups whose
   rows hold so many of its shingles that a member of fitting size may link. Groups are dealt in parts of bounded size; a part keeps
   the union of its members' shingles, and only a part whose union holds enough of the query is opened and its members compared,
   until one links.

A row that many groups hold is crowded. What two sets can share there is bounded by the crowded rows that each has, and what they
must share by their sizes, so a crowded row is asked only where crowded rows alone may decide; others share a rarer row as well.
So a passage that thousands of documents hold leads to comparisons only among documents of little else.

Every pair of classes that links is in one group after step 1 or is compared in step 2. The order of shingles, the leaders and
``CROWD`` affect only the speed. Shingles are told apart by 48 bits of hash and sets by 64 (``n_shingles`` counts the former): a
set of 20,000 shingles holds two of one hash with a chance of 1e-6, and 10^9 different sets two of one digest with a chance of 3 %.

Defined results: null and empty texts have no shingles and link with nothing; rows with a null doc_id get a null component and
link with nothing; equal rows each get their row; rows of one doc_id and different texts are one document of several sets, whose
links all count; extra columns are ignored by ``components`` and kept by ``keep_first``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigraph.llm._spark import free_name, shuffle_partitions, stored
from evigraph.llm._text import TOKEN_BITS, U64, mix, shingle_sets, text_chunks
from evigraph.llm.components import connected_components

WIDTH = 5
PERCENT = 75
#: A document's place in a chunk and a shingle's place in the order share 64 bits.
ROWS = 1 << 15
#: Shingles in the list of frequent ones at most; beyond it the rest count as rare, which affects only the speed.
MOST_FREQUENT = 1 << 18
#: Groups in a row of the matrix beyond which it is left out where that loses no link.
CROWD = 8
#: A part of a group has about so many members.
PART = 128
MASK = (1 << TOKEN_BITS) - 1


def _sets(column: pa.Array):
    """(first row, set sizes, class ids, shingles, how many before each text) by chunk."""
    for r0, _, data, off in text_chunks(column, rows=ROWS):
        tok, before = shingle_sets(data, off, WIDTH)
        n = np.diff(before)
        total = np.concatenate((np.zeros(1, U64), np.cumsum(mix(tok + U64(0x9E3779B97F4A7C15)), dtype=U64)))
        cid = mix((total[before[1:]] - total[before[:-1]]) ^ (n.astype(U64) * U64(0xD6E8FEB86659FD93)))
        yield r0, n, cid.view(np.int64), tok, before


def _least(n: np.ndarray | int, percent: int):
    """Shingles of a set of n that a linked set has too, at least."""
    return -(-percent * n // 100)


def _shared(n: np.ndarray | int, percent: int):
    """Exchanged shingles that a set of n shares with a linked one that is no smaller, at least."""
    return np.minimum(-(-n // 10), _least(n, percent))


def profiles(docs: DataFrame) -> DataFrame:
    """(doc_id, n, cid, keys): set size and class of each row, and the least shingle in each eighth of the hash space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r0, n, cid, tok, before in _sets(b.column(1)):
                part = (tok >> U64(TOKEN_BITS - 3)).astype(np.int64) + 8 * np.repeat(np.arange(len(n)), n)
                least = np.concatenate((np.ones(min(1, len(part)), bool), part[1:] != part[:-1]))
                ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(least)))[before]
                keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tok[least].view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(r0, len(n)), pa.array(n, pa.int64()), pa.array(cid), keys], ["doc_id", "n", "cid", "keys"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, cid long, keys array<long>")


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles of many documents, by count: those that stand several times in a batch, counts added over all batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [tok for _, _, _, tok, _ in _sets(b.column(0))]
            if parts:
                tok, count = np.unique(np.concatenate(parts), return_counts=True)
                often = count >= 3
                yield pa.RecordBatch.from_arrays([pa.array(tok[often].view(np.int64)), pa.array(count[often])], ["tok", "count"])

    seen = docs.select("text").mapInArrow(run, "tok long, count long").groupBy("tok").agg(F.sum("count").alias("count")).where("count >= 12")
    most = seen.orderBy(F.desc("count"), "tok").limit(MOST_FREQUENT).toArrow()
    return most["tok"].to_numpy()[::-1].copy().view(U64)


def first_shingles(docs: DataFrame, frequent: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """(tok, cid): of each class the shingles of which a linked class has one; a frequent one has a salt above its 48 bits."""
    order = np.argsort(frequent)
    shared = docs.sparkSession.sparkContext.broadcast((frequent[order], order.astype(U64)))
    # a frequent shingle's documents are dealt to so many tasks
    salts = max(4, min(1 << 12, shuffle_partitions(docs.sparkSession) // 8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, rank = shared.value
        sent: set[int] = set()  # a class once for each task
        for b in batches:
            for _, n, cid, tok, before in _sets(b.column(0)):
                new = np.zeros(len(n), bool)
                for i, c in enumerate(cid.tolist()):
                    new[i] = c not in sent
                    sent.add(c)
                owner = np.repeat(np.arange(len(n)), n)
                tok, owner = tok[new[owner]], owner[new[owner]]
                n = np.where(new, n, 0)
                before = np.concatenate((np.zeros(1, np.int64), np.cumsum(n)))
                place = tok
                if len(often):
                    at = np.minimum(np.searchsorted(often, tok), len(often) - 1)
                    place = np.where(often[at] == tok, U64(1 << TOKEN_BITS) + rank[at], tok)
                key = np.sort((owner.astype(U64) << U64(TOKEN_BITS + 1)) | place)
                take = np.arange(len(key)) - before[owner] < (n - _least(n, percent) + _shared(n, percent))[owner]
                key, owner = key[take] & U64((1 << (TOKEN_BITS + 1)) - 1), owner[take]
                own = cid[owner]
                if len(often):
                    hot = key > U64(MASK)
                    by_rank = np.empty(len(often), U64)
                    by_rank[rank.astype(np.int64)] = often
                    key[hot] = by_rank[(key[hot] - U64(1 << TOKEN_BITS)).astype(np.int64)]
                    key[hot] |= (own[hot].view(U64) % U64(salts) + U64(1)) << U64(TOKEN_BITS)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(own)], ["tok", "cid"])

    return docs.select("text").mapInArrow(run, "tok long, cid long")


def shared_shingles(first: DataFrame) -> DataFrame:
    """(tok, cid): first shingles that two classes have, without salt."""
    by_tok, whole = W.partitionBy("tok").orderBy("cid"), W.partitionBy("tok")
    seen = first.select("tok", "cid", F.lag("cid").over(by_tok).alias("prev"), F.min("cid").over(whole).alias("least"), F.max("cid").over(whole).alias("most"))
    return seen.where(f"(prev IS NULL OR prev <> cid) AND (least <> most OR tok > {MASK})").select(F.expr(f"tok & {MASK}").alias("tok"), "cid")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Shingles in both of two ordered sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = _common(a, b)
    return 100 * common >= percent * (len(a) + len(b) - common)


def _open_groups(docs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) from rows (grp, part, query, cid, rep): the texts of rep are fetched, and each part opened by its queries."""

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r0, n, cid, tok, before in _sets(b.column(4)):
                # a doc_id may have several texts
                keep = np.flatnonzero(cid == b.column(3).slice(r0, len(n)).to_numpy())
                own = [b.column(i).slice(r0, len(n)).take(pa.array(keep)) for i in range(4)]
                yield pa.RecordBatch.from_arrays([*own, pa.array([tok[before[i] : before[i + 1]].tobytes() for i in keep], pa.binary())], ["grp", "part", "query", "cid", "toks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, members, union, out = None, [], None, []
        for b in batches:
            grp, part, query, cid = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            for i, raw in enumerate(b.column(4)):
                toks = np.frombuffer(raw.as_buffer(), U64)
                if (grp[i], part[i]) != at:
                    at, members, union = (grp[i], part[i]), [], None
                if not query[i]:
                    members.append((int(cid[i]), toks))
                    continue
                if not members:
                    continue
                if union is None:
                    union = members[0][1] if len(members) == 1 else np.unique(np.concatenate([m for _, m in members]))
                if 100 * _common(toks, union) < percent * len(toks):
                    continue
                for c, own in members:
                    if c != cid[i] and _linked(toks, own, percent):
                        out.append((int(cid[i]), c))
                        break
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    n = shuffle_partitions(rows.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").where("rep IS NOT NULL").join(rows, "rep")
    sets = texts.select("grp", "part", "query", "cid", "text").mapInArrow(shingle, "grp long, part int, query int, cid long, toks binary")
    return sets.repartition(n, "grp", "part").sortWithinPartitions("grp", "part", "query").mapInArrow(run, "a long, b long")


def _dealt(members: DataFrame, queries: DataFrame, reps: DataFrame, spread: DataFrame, most: int) -> DataFrame:
    """Rows for ``_open_groups`` of members and queries (grp, cid): each group in parts by the size of ``spread``, one of the
    two, of which a row goes to one part and a row of the other to all."""
    sizes = spread.groupBy("grp").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    one, all_ = F.pmod(F.xxhash64("cid"), "parts").cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = [x.join(sizes, "grp").select("grp", (one if x is spread else all_).alias("part"), F.lit(q).alias("query"), "cid") for q, x in enumerate((members, queries))]
    return rows[0].unionByName(rows[1]).join(reps.select("cid", "rep"), "cid")


def components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the least doc_id that links reach)."""
    rows = stored(profiles(docs))
    classes = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("cid").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"))
    entries = stored(shared_shingles(first_shingles(docs, frequent_shingles(docs), percent)))
    several = entries.groupBy("cid").agg(F.count("*").alias("have"))
    # a linked set may be smaller, and share less
    classes = stored(classes.join(several, "cid").where(f"have >= {_shared_sql(_least_sql('n', percent), percent)}"))
    labels = _labels(docs, rows, entries, classes, percent)
    best = labels.join(classes, labels["node"] == classes["cid"]).groupBy("comp").agg(F.min("rep").alias("least"))
    by_class = labels.join(best, "comp").select(F.col("node").alias("cid"), "least")
    copies = rows.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("first"))
    least = copies.join(by_class, "cid", "left").select("cid", F.least("first", "least").alias("least"))
    own = rows.join(least, "cid", "left")
    return own.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("least"))).otherwise(F.col("doc_id")).alias("component_id"))


def _least_sql(n: str, percent: int) -> str:
    return f"(({percent} * {n} + 99) div 100)"


def _shared_sql(n: str, percent: int) -> str:
    return f"least(({n} + 9) div 10, {_least_sql(n, percent)})"


def _labels(docs: DataFrame, rows: DataFrame, entries: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(node, comp) over classes that link; classes: (cid, rep, n, have)."""
    pairs = stored(_leaders(rows, classes, percent))
    heads = pairs.select("grp").distinct().select("grp", F.col("grp").alias("cid"))
    groups = connected_components(stored(_open_groups(docs, _dealt(heads, pairs, classes, pairs, 4 * PART), percent)))
    group_of = stored(classes.join(groups, classes["cid"] == groups["node"], "left").select("cid", "rep", "n", F.coalesce("comp", "cid").alias("grp")))
    queries = stored(_queries(entries, group_of, percent))
    members = group_of.join(queries.select("grp").distinct(), "grp", "left_semi").select("grp", "cid")
    found = _open_groups(docs, _dealt(members, queries, group_of, members, PART), percent)
    # members of a group reach each other, so links between groups are enough
    between = found.join(group_of.selectExpr("cid AS a", "grp AS ga"), "a").join(group_of.selectExpr("cid AS b", "grp AS gb"), "b")
    joined = connected_components(stored(between.select(F.col("ga").alias("a"), F.col("gb").alias("b")).distinct()))
    last = group_of.join(joined, group_of["grp"] == joined["node"], "left").select(F.col("cid").alias("node"), F.coalesce("comp", "grp").alias("comp"))
    return stored(last)


def _leaders(rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(grp, cid): for each class the two classes with which it shares most keys, of those that lead a key."""
    first = f"(n - {_least_sql('n', percent)} + {_shared_sql('n', percent)})"
    own = classes.select("cid", "rep", F.expr(f"CAST(1000 * have / {first} AS INT)").alias("common"))
    keyed = rows.select(F.col("doc_id").alias("rep"), "cid", F.explode("keys").alias("key")).join(own, ["rep", "cid"]).select("key", "cid", "common").distinct()
    lead = keyed.groupBy("key").agg(F.max_by("cid", F.struct("common", "cid")).alias("grp"), F.count("*").alias("many")).where("many > 1").select("key", "grp")
    pairs = keyed.join(lead, "key").where("cid <> grp").groupBy("cid", "grp").agg(F.count("*").alias("keys")).where("keys > 1")
    best = W.partitionBy("cid").orderBy(F.desc("keys"), "grp")
    return pairs.withColumn("place", F.row_number().over(best)).where("place <= 2").select("grp", "cid")


def _queries(entries: DataFrame, group_of: DataFrame, percent: int) -> DataFrame:
    """(grp, cid): the groups that a class may link with, of rows (tok, cid) and classes (cid, n, grp).

    A class asks groups with members no larger than itself. Sets of x and y <= x shingles that link share at least
    ``ceil(percent * (x + y) / (100 + percent)) - least(x) + shared(x)`` rows, less one where rounding makes ``least - shared`` fall
    somewhere (never at 75 percent). Of these at most as many are crowded as either has, so a crowded row is asked only where y is
    small enough for crowded rows alone to do.
    """
    least, shared = _least_sql("n", percent), f"({_shared_sql('n', percent)} - {int(percent != 75)})"
    named = stored(entries.join(group_of.select("cid", "n", "grp"), "cid"))
    several = named.groupBy("tok").agg(F.min("grp").alias("a"), F.max("grp").alias("b")).where("a <> b").select("tok")
    named = named.join(several, "tok", "left_semi")
    enough = named.groupBy("cid").agg(F.count("*").alias("have"), F.min("n").alias("n")).where(f"have >= {_shared_sql(least, percent)}").select("cid")
    named = stored(named.join(enough, "cid", "left_semi"))
    crowds = named.select("tok", "grp").distinct().groupBy("tok").agg(F.count("*").alias("groups")).where("groups > 1")
    crowds = crowds.select("tok", (F.col("groups") > CROWD).alias("crowd"))
    named = named.join(crowds, "tok").withColumn("q", F.sum(F.col("crowd").cast("long")).over(W.partitionBy("cid")))
    # the largest partner for which crowded rows alone may do
    named = stored(named.withColumn("reach", F.expr(f"{100 + percent} * (q + {least} - {shared}) div {percent} - n")))
    matrix = named.groupBy("tok", "grp", "crowd").agg(F.min("n").alias("smallest"), F.max("n").alias("largest"), F.max("q").alias("most_q"))
    matrix = matrix.select("tok", F.col("grp").alias("other"), "smallest", "largest", "most_q")
    asking = named.where(f"NOT crowd OR reach >= {least}")
    must = f"(({percent} * (n + greatest(smallest, {least})) + {99 + percent}) div {100 + percent} - {least} + {shared})"
    pairs = asking.join(matrix, "tok").where(f"grp <> other AND smallest <= n AND 100 * largest >= {percent} * n AND (NOT crowd OR (smallest <= reach AND {must} <= most_q))")
    pairs = pairs.groupBy("other", "cid").agg(F.count_if(~F.col("crowd")).alias("rare"), F.min("n").alias("n"), F.min("smallest").alias("smallest"), F.min(F.least("q", "most_q")).alias("crowded"), F.max(F.least("q", "most_q")).alias("most"))
    return pairs.where(f"rare + most >= {must}").select(F.col("other").alias("grp"), "cid")


def keep_first(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component, that of the least doc_id; texts without a word all stay, as do rows without
    a doc_id and all rows of a doc_id that stays."""
    drop = free_name(docs, "drop")
    found = components(docs, percent).where("component_id <> doc_id").select(F.col("doc_id").alias(drop)).distinct()
    return docs.join(found, docs["doc_id"].cast("long") == found[drop], "left_anti")


#: The same by comparing all pairs that share a shingle: for small tables.
ORACLE = """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM g), u AS (SELECT doc_id, unnest(s) AS x FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b USING (x) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r(d, o) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.d, e.b FROM r JOIN e ON r.o = e.a)
SELECT doc_id, n AS n_shingles, least AS component_id FROM n JOIN (SELECT d, min(o) AS least FROM r GROUP BY d) m ON m.d = n.doc_id"""
