"""Similarity digests of improbable features.

Every window of ``WINDOW`` bytes has an entropy, here the collision entropy: how many pairs of its bytes are equal. The farther
that is from what prose has, the rarer the window ranks, but windows of hardly any entropy rank last. A window that ranks first in
some neighbourhood of ``NEAR`` positions is a feature. Features are hashed into a chain of Bloom filters of ``BITS`` bits, at most
``PER_FILTER`` in each. Two digests are compared filter by filter: the overlap of the bits, less what chance gives, over the most
that the fuller of two filters of their weights could share; each filter of the shorter chain takes its best match, and the mean counts.
Short texts have all strings of ``SHORT`` bytes as features too, very short ones those of 2 bytes or 1.

A digest is the hexadecimal of its filters, each with the count of its features in front. It depends on the text alone.

Defined results: null is an empty text, whose digest is empty; two empty digests have likeness 1, an empty and another 0. Rows with
one doc_id follow each other in the order of their texts; a single document is its own successor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm._spark import shuffle_partitions
from evigraph.llm._text import U64, prefix_hash, text_chunks, window_hash

WINDOW = 24
NEAR = 32
SHORT = 6
#: Texts with fewer bytes have short features too; with fewer than the least, only those.
SHORT_BELOW, LONG_FROM = 256, 96
BITS = 2048
HASHES = 4
PER_FILTER = 160
#: Filters of a chain that are compared at once.
BLOCK = 512
#: Equal pairs in a window of prose, about, and the most in a window that is no feature for lack of entropy.
USUAL, WEAK = 18, 70
POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def equal_pairs(data: np.ndarray, width: int) -> np.ndarray:
    """How many pairs of bytes of each window are equal."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    # a window's next has the pairs of the byte that comes and lacks those of the one that goes
    back, ahead = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for lag in range(1, width):
        same = (data[lag:] == data[:-lag]).view(np.uint8)
        back[lag:] += same
        ahead[:-lag] += same
    out = np.empty(n, np.int64)
    out[0] = back[:width].sum()
    np.cumsum(back[width : width + n - 1].astype(np.int64) - ahead[: n - 1], out=out[1:])
    out[1:] += out[0]
    return out


def _rolling_min(x: np.ndarray, width: int) -> np.ndarray:
    size, out = 1, x
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def features(data: np.ndarray) -> np.ndarray:
    """Hashes of the features of a text, once each, in the order of their places."""
    n = len(data)
    if not n:
        return np.zeros(0, U64)
    p, found = prefix_hash(data), []
    if n >= LONG_FROM:
        h = _windows(p, n, WINDOW)
        pairs = equal_pairs(data, WINDOW)
        rank = np.where(pairs > WEAK, 0x7FFF, 0x3FFF - np.abs(pairs - USUAL)).astype(U64)
        key = (rank << U64(48)) | (h >> U64(16))
        least = _rolling_min(key, min(NEAR, len(key)))
        # a place is first in its neighbourhood if some window's least is its own
        first = np.concatenate(([True], least[1:] != least[:-1]))
        found.append(least[first] & U64((1 << 48) - 1))
    for width, least, below in ((SHORT, 2 * SHORT, SHORT_BELOW), (2, 2, 4 * SHORT), (1, 0, 4)):
        if least <= n < below:
            found.append((_windows(p, n, width) >> U64(16)) ^ U64(width))
    out = np.concatenate(found)
    _, at = np.unique(out, return_index=True)
    return out[np.sort(at)]


def _windows(p: np.ndarray, n: int, width: int) -> np.ndarray:
    h = window_hash(p, width)
    return h if len(h) == n - width + 1 else np.concatenate([h, window_hash(p[n - width :] - p[n - width], width)])[: n - width + 1]


class Digest:
    """A chain of Bloom filters: rows of BITS / 8 bytes, and the features in each."""

    def __init__(self, data: np.ndarray):
        f = features(data)
        n = -(-len(f) // PER_FILTER)
        # filters of even weight
        own = np.arange(len(f)) * n // max(1, len(f))
        bits = np.zeros((n, BITS), bool)
        x = f * U64(0x9E3779B97F4A7C15)
        for k in range(HASHES):
            bits[own, ((x >> U64(11 * k + 8)) % U64(BITS)).astype(np.int64)] = True
        self.filters = np.packbits(bits, axis=1)
        self.counts = np.bincount(own, minlength=n)

    def text(self) -> str:
        return "".join(f"{c:04x}{row.tobytes().hex()}" for c, row in zip(self.counts, self.filters))

    def likeness(self, other: Digest) -> float:
        """0 to 1."""
        a, b = sorted((self, other), key=lambda d: (len(d.counts), d.text() if len(self.counts) == len(other.counts) else ""))
        if not len(a.counts):
            return float(not len(b.counts))
        best = np.zeros(len(a.counts))
        # blocks of filters, however long the chains
        for j in range(0, len(b.counts), BLOCK):
            y = np.unpackbits(b.filters[j : j + BLOCK], axis=1).astype(np.float32)
            for i in range(0, len(a.counts), BLOCK):
                x = np.unpackbits(a.filters[i : i + BLOCK], axis=1).astype(np.float32)
                common = x @ y.T
                wa, wb = x.sum(axis=1)[:, None], y.sum(axis=1)[None, :]
                chance = wa * wb / BITS
                like = np.clip((common - chance) / np.maximum(np.minimum(wa, wb) - chance, 1e-9), 0, 1)
                best[i : i + BLOCK] = np.maximum(best[i : i + BLOCK], like.max(axis=1))
        return float((best * a.counts).sum() / a.counts.sum())


def digest(text: str | bytes | None) -> Digest:
    raw = (text or "").encode() if not isinstance(text, bytes) else text
    return Digest(np.frombuffer(raw, np.uint8))


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as many characters from the start of the following text, or all."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def in_order(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows (part, doc_id, text, extra) with parts by descending doc_id, and in each part, as extra, the row that follows its last.

    The parts are ranges between quantiles of doc_id, at most as many as shuffle partitions. The first row of each part is found
    by an aggregate and goes to the part before as well; after the last part comes the first.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = rows.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else []
    cuts = sorted(set(cuts or []), reverse=True)
    # null ids come last
    part = F.lit(0)
    if cuts:
        part = F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(F.size(F.filter(F.lit(cuts), lambda c: c >= F.col("doc_id"))))
    rows = rows.withColumn("part", part.cast("int"))
    # only what an edit can take of it: as much as the row before needs, so the whole text
    order = F.struct((F.col("doc_id").isNull()).alias("none"), F.bitwise_not("doc_id").alias("down"), F.col("text"))
    heads = rows.groupBy("part").agg(F.min(order).alias("head")).select("part", F.col("head.none").alias("none"), F.bitwise_not("head.down").alias("doc_id"), F.col("head.text").alias("text"))
    parts = sorted(r[0] for r in heads.select("part").collect())
    before = {p: parts[i - 1] for i, p in enumerate(parts)}
    to = F.create_map(*[F.lit(x) for p in before.items() for x in p]) if before else F.create_map(F.lit(0), F.lit(0))
    extra = heads.select("doc_id", "text", F.element_at(to, F.col("part")).alias("part"), F.lit(1).alias("extra"))
    both = rows.withColumn("extra", F.lit(0)).select("part", "doc_id", "text", "extra").unionByName(extra)
    return both.repartitionById(max(n, len(cuts) + 1), "part").sortWithinPartitions(F.col("part"), F.col("extra"), F.col("doc_id").desc_nulls_last(), F.col("text")), n


def with_next(docs: DataFrame) -> DataFrame:
    """Per document: its digest, that of its edited text, and their likeness and that of the next document's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = None, []  # the row before: part, doc_id, text, digest
        for b in batches:
            for part, doc, text, extra in zip(*(b.column(i).to_pylist() for i in range(4))):
                d = digest(text)
                if held and held[0] == part:
                    own_id, own, own_d = held[1:]
                    new = edited(own, text)
                    e = digest(new)
                    out.append((own_id, len(own), hashlib.sha256(new.encode()).hexdigest(), own_d.text(), e.text(), own_d.likeness(e), own_d.likeness(d)))
                held = None if extra else (part, doc, text, d)
                if len(out) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    rows, _ = in_order(docs)
    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
