"""Near-duplicates by MinHash: universal hash minima, bands, verified links, and components by alternating stars.

A document is its set of word shingles; documents of equal sets are one class (told apart by 128 bits). Each class has ``ROWS * BANDS`` minima
of universal hash functions, and each band of ``ROWS`` minima puts it in a bucket. Buckets of one class drop out. Then:

1. Each class is compared with the leader of each of its buckets: the class whose bands are shared most widely, since an original shares
   all of them and its copies share what they kept. Links so found make components.
2. Only buckets that hold several components may hide more links. A class there that has too many shingles of its own, which no other such
   class holds, links with nothing and leaves (an exact bound). The rest of a bucket is dealt in parts of bounded size, and what is outside
   the bucket's largest component is compared with each part, a pair only in the first band that it shares.

A comparison starts with the signatures (``least_matches``) and confirms on the full sets, so each link is exact. Two sets of the least linked
likeness share no bucket with a chance of 2e-8 and fail the signatures with one below 1e-6; more alike ones far less. No pairs
are listed within a bucket: what is copied to the parts of a bucket is its classes outside the largest component, without a cap.

Defined results: null and empty texts, and those without a word, have no shingles and link with nothing; rows with a null doc_id get a null component
and link with nothing; equal rows each get their row; rows of one doc_id and different texts are one document of several sets, whose
links all count; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm import ngram_join
from evigraph.llm._spark import free_name, shuffle_partitions, stored
from evigraph.llm._text import U64, mix, shingles, text_chunks
from evigraph.llm.components import star_components

WIDTH = 5
PERCENT = 85
ROWS, BANDS = 5, 30
#: Bits of the map of wanted keys: 8 MB.
SPOTS = 1 << 26
#: Classes of a part of a bucket in the mean, and of the followers of a leader.
PART = 256


def universal_hashes(n: int = ROWS * BANDS, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and addends of n functions x -> a * x + b modulo 2 ** 32."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def least_matches(percent: int = PERCENT, n: int = ROWS * BANDS) -> int:
    """Equal minima below which a pair is not compared: 5.5 deviations below what the least linked likeness gives."""
    p = percent / 100
    return max(0, int(n * p - 5.5 * (n * p * (1 - p)) ** 0.5))


def full_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, set sizes, distinct 64-bit shingle hashes by text in order, how many before each text) by chunk."""
    for r0, _, data, off in text_chunks(column):
        h, owner = shingles(data, off, WIDTH)
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        first = np.concatenate((np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])))
        n = np.bincount(owner[first], minlength=len(off) - 1)
        yield r0, n, h[first], np.concatenate(([0], np.cumsum(n)))


def class_ids(n: np.ndarray, h: np.ndarray, before: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set."""
    out = []
    for k in (2 * salt + 1, 2 * salt + 2):
        total = np.concatenate((np.zeros(1, U64), np.cumsum(mix(h ^ mix(np.full(1, k, U64))), dtype=U64)))
        out.append(mix((total[before[1:]] - total[before[:-1]]) ^ (n.astype(U64) * U64(0xD6E8FEB86659FD93))).view(np.int64))
    return out[0], out[1]


def minima(n: np.ndarray, h: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Of each set the least value of each hash function."""
    a, b = universal_hashes()
    out = np.zeros((len(n), len(a)), np.uint32)
    some = np.flatnonzero(n)
    x, start = (h >> U64(32)).astype(np.uint32), before[:-1][some]
    if len(some):
        for k in range(len(a)):
            out[some, k] = np.minimum.reduceat(x * a[k] + b[k], start)
    return out


def profiles(docs: DataFrame, salt: int) -> DataFrame:
    """(doc_id, n, cid, more, minima): set size and class of each row; the minima once for each class of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for b in batches:
            for r0, n, h, before in full_sets(b.column(1)):
                cid, more = class_ids(n, h, before, salt)
                ids = b.column(0).slice(r0, len(n))
                out = []
                for c, size, doc, row in zip(cid.tolist(), n.tolist(), ids.to_pylist(), minima(n, h, before)):
                    new = size and doc is not None and c not in sent
                    out.append(row.tobytes() if new else None)
                    if new:
                        sent.add(c)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(cid), pa.array(more), pa.array(out, pa.binary())], ["doc_id", "n", "cid", "more", "minima"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, cid long, more long, minima binary")


def bands(rows: DataFrame) -> DataFrame:
    """(bucket, band, cid): the buckets of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(b.num_rows, BANDS, ROWS).astype(U64)
            key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64), (b.num_rows, BANDS)).copy()
            for k in range(ROWS):
                key = mix(mix(key) ^ sig[:, :, k])
            cols = [key.ravel().view(np.int64), np.tile(np.arange(BANDS, dtype=np.int32), b.num_rows), np.repeat(b.column(0).to_numpy(), BANDS)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["bucket", "band", "cid"])

    return rows.where("minima IS NOT NULL").select("cid", "minima").mapInArrow(run, "bucket long, band int, cid long")


def shared_buckets(rows: DataFrame) -> DataFrame:
    """(bucket, band, cid, size) of buckets with several classes; ``size`` may count a class more than once."""
    every = bands(rows)
    several = every.groupBy("bucket").agg(F.min("cid").alias("a"), F.max("cid").alias("b"), F.count("*").alias("size")).where("a <> b")
    return stored(every.join(several.select("bucket", "size"), "bucket").groupBy("bucket", "cid").agg(F.min("band").alias("band"), F.min("size").alias("size")))


def likely(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose key is not wanted, before they are exchanged: by a bitmap of ``SPOTS`` hashed keys, which
    bounds what is broadcast."""
    spot = F.pmod(F.xxhash64(key), F.lit(SPOTS))
    bits = wanted.select(spot.alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("_bits"))
    at = F.bitmap_bit_position(spot)
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    near = rows.join(F.broadcast(bits), F.bitmap_bucket_number(spot) == F.col("_bucket"))
    return near.where(byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0).select(*rows.columns)


def sets_of(docs: DataFrame, rows: DataFrame, members: DataFrame, salt: int) -> DataFrame:
    """(cid, n, minima, toks): the full sets of the classes that share a bucket, each from its text of the least doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r0, n, h, before in full_sets(b.column(1)):
                # a doc_id may have several texts
                keep = np.flatnonzero(class_ids(n, h, before, salt)[0] == b.column(0).slice(r0, len(n)).to_numpy())
                toks = pa.array([h[before[i] : before[i + 1]].tobytes() for i in keep], pa.binary())
                sig = pa.array([row.tobytes() for row in minima(n, h, before)[keep]], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(r0, len(n)).take(pa.array(keep)), pa.array(n[keep], pa.int64()), sig, toks], ["cid", "n", "minima", "toks"])

    known = stored(rows.where("doc_id IS NOT NULL").select("doc_id", "cid").join(members.select("cid").distinct(), "cid").groupBy("cid").agg(F.min("doc_id").alias("rep")))
    texts = likely(docs.select(F.col("doc_id").cast("long").alias("rep"), "text").where("rep IS NOT NULL"), known, "rep").join(known, "rep").select("cid", "text")
    return stored(texts.mapInArrow(run, "cid long, n long, minima binary, toks binary").dropDuplicates(["cid"]))


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = _common(a, b)
    return 100 * common >= percent * (len(a) + len(b) - common)


def verified(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) from rows (grp, part, band, query, cid, comp, most): in each part queries are compared with members of other components.

    ``most`` bounds the shingles that a class shares with any other; with a band, a pair is compared only where that is its first shared one."""
    matches = least_matches(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, members, stacked, out = None, [], None, []
        for b in batches:
            grp, part, band, query, cid, comp, most = (b.column(k).to_numpy(zero_copy_only=False) for k in range(7))
            for i in range(b.num_rows):
                sig, toks = (np.frombuffer(b.column(k)[i].as_buffer(), t) for k, t in ((7, np.uint32), (8, U64)))
                if (grp[i], part[i]) != at:
                    at, members, stacked = (grp[i], part[i]), [], None
                if not query[i]:
                    members.append((cid[i], comp[i], most[i], sig, toks))
                    continue
                if not members:
                    continue
                if stacked is None:
                    ids, comps, mosts = (np.array([m[k] for m in members]) for k in range(3))
                    sizes = np.array([len(m[4]) for m in members])
                    stacked = np.stack([m[3] for m in members])
                equal = stacked == sig
                n, least = len(toks), np.minimum(mosts, most[i])
                fit = (comps != comp[i]) & (equal.sum(1) >= matches) & (100 * least >= percent * (n + sizes - least))
                if band[i] >= 0:
                    fit &= equal.reshape(len(ids), BANDS, ROWS).all(2).argmax(1) == band[i]
                done = set()
                for j in np.flatnonzero(fit).tolist():
                    if comps[j] not in done and _linked(toks, members[j][4], percent):
                        done.add(comps[j])
                        out.append((int(cid[i]), int(ids[j])))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    whole = rows.join(sets, "cid").select("grp", "part", "band", "query", "cid", "comp", F.coalesce("most", "n").alias("most"), "minima", "toks")
    dealt = whole.repartition(shuffle_partitions(rows.sparkSession), "grp", "part").sortWithinPartitions("grp", "part", "query")
    return dealt.mapInArrow(run, "a long, b long")


def to_leaders(members: DataFrame) -> DataFrame:
    """Rows for ``verified``: each class as a query of the leaders of its buckets."""
    central = members.groupBy("cid").agg(F.sum(F.log2("size") + 1).alias("shared"))
    lead = members.join(central, "cid").groupBy("bucket").agg(F.max_by("cid", F.struct("shared", "cid")).alias("grp"))
    pairs = stored(members.join(lead, "bucket").where("cid <> grp").select("grp", "cid").distinct())
    parts = pairs.groupBy("grp").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    asking = pairs.join(parts, "grp").select("grp", F.pmod(F.xxhash64("cid"), "parts").cast("int").alias("part"), F.lit(1).alias("query"), "cid")
    leading = parts.select("grp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("query"), F.col("grp").alias("cid"))
    return asking.unionByName(leading).select("grp", "part", F.lit(-1).alias("band"), "query", "cid", F.col("cid").alias("comp"), F.lit(None).cast("long").alias("most"))


def shared_shingles(sets: DataFrame) -> DataFrame:
    """(cid, n, most): how many shingles of each set stand in another one too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, cid in enumerate(b.column(0).to_pylist()):
                toks = np.frombuffer(b.column(1)[i].as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(toks), pa.array(np.full(len(toks), cid))], ["tok", "cid"])

    held = sets.select("cid", "toks").mapInArrow(run, "tok long, cid long").groupBy("tok").agg(F.min("cid").alias("cid"), F.max("cid").alias("other"))
    own = held.where("cid = other").groupBy("cid").agg(F.count("*").alias("own"))
    return sets.select("cid", "n").join(own, "cid", "left").select("cid", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("most"))


def _mixed(members: DataFrame) -> DataFrame:
    """The members of buckets with several components."""
    several = members.groupBy("bucket").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("bucket")
    return members.join(several, "bucket")


def left_open(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Rows for ``verified``: in buckets of several components, the classes outside the largest one as queries of all."""
    named = members.join(labels, members["cid"] == labels["node"], "left").select("bucket", "band", "cid", F.coalesce("comp", "cid").alias("comp"))
    named = stored(_mixed(named))
    bound = shared_shingles(sets.join(named.select("cid").distinct(), "cid")).where(f"100 * most >= {percent} * n").select("cid", "most")
    named = stored(_mixed(named.join(stored(bound), "cid")))
    sizes = named.groupBy("bucket", "comp").agg(F.count("*").alias("many")).groupBy("bucket").agg(F.max_by("comp", F.struct("many", "comp")).alias("base"), F.ceil(F.sum("many") / PART).cast("int").alias("parts"))
    every = named.join(stored(sizes), "bucket")
    one = every.select(F.col("bucket").alias("grp"), F.pmod(F.xxhash64("cid"), "parts").cast("int").alias("part"), "band", F.lit(0).alias("query"), "cid", "comp", "most")
    loose = every.where("comp <> base").select(F.col("bucket").alias("grp"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "band", F.lit(1).alias("query"), "cid", "comp", "most")
    return one.unionByName(loose)


def components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the least doc_id that links reach), kept (whether it is that document)."""
    salt = 0
    while True:
        rows = stored(profiles(docs, salt))
        # equal first digests of different sets: with another salt they differ
        if rows.groupBy("cid").agg(F.min("more").alias("a"), F.max("more").alias("b")).where("a <> b").isEmpty():
            break
        salt += 1
    members = shared_buckets(rows)
    sets = sets_of(docs, rows, members, salt)
    links = stored(verified(to_leaders(members), sets, percent))
    more = stored(verified(left_open(members, star_components(links), sets, percent), sets, percent))
    # the sets of one doc_id are one document
    named = rows.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "cid")
    several = named.groupBy("doc_id").agg(F.min("cid").alias("a"), F.max("cid").alias("b")).where("a <> b").select("doc_id", "a")
    labels = star_components(links.union(more).union(named.join(several, "doc_id").select("a", "cid")))
    classes = rows.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("first")).join(labels, F.col("cid") == F.col("node"), "left")
    classes = stored(classes.select("cid", "first", F.coalesce("comp", "cid").alias("comp")))
    least = classes.join(classes.groupBy("comp").agg(F.min("first").alias("least")), "comp").select("cid", "least")
    own = rows.join(least, "cid", "left").withColumn("component_id", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("least")).otherwise(F.col("doc_id")))
    return own.select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def keep_first(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` without those whose component has a document of a lesser doc_id; rows without an id stay."""
    drop = free_name(docs, "drop")
    found = components(docs, percent).where("NOT kept").select(F.col("doc_id").alias(drop)).distinct()
    return docs.join(found, docs["doc_id"].cast("long") == found[drop], "left_anti")


#: The same by comparing all pairs that share a shingle: for small tables.
ORACLE = ngram_join.ORACLE.replace("100 * c >= 75 *", f"100 * c >= {PERCENT} *").replace("least AS component_id FROM", "least AS component_id, doc_id = least AS kept FROM")
