"""Removal of byte strings that an earlier document holds: sampled anchors, and one doubling of the length that is compared.

This is not prefix doubling over all suffixes: built so, it went beyond the disk that the check tool allows (README has the figures). The
suffixes that are sorted here are a sample that no repeat escapes: of each window of ``SPAN`` bytes the ``HALF``-byte strings with
the least hash are its anchors, so equal windows have equal anchors at equal places. Ranks are hashes (of 48 and 64 bits, whose
bytes are not compared again), and there is one step of doubling:

1. Each anchor is ranked by its first ``HALF`` bytes (its hash), ranks are sorted in buckets, and an anchor whose rank no other
   document has is unique and drops out.
2. The anchors that are left are compared again at the doubled length: the old rank, and the bytes at the offset of half a span before and after.
   The pairs are sorted in buckets; for each of the windows that hold the anchor the least doc_id of equal ones comes out. The
   strings are as long as the threshold then, and ranking ends.

Texts are packed in blocks of about a megabyte, and anchors are exchanged as packed arrays. What a block holds several times it
sends once, with its least doc_id, so a string that stands everywhere sends one entry a block.

Defined results: null is an empty text; texts shorter than a span lose nothing; a null doc_id comes after all others; rows with
one doc_id are not earlier than each other; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm._spark import shuffle_partitions, stored
from evigraph.llm._text import U64, mix, prefix_hash, text_chunks, window_hash

SPAN = 50
HALF = SPAN // 2
#: Places of a window that holds an anchor.
PLACES = SPAN - HALF + 1
BLOCK_BYTES = 1 << 20
KEY_BITS = 48
#: Entries in a bucket, about.
BUCKET = 1 << 18
#: Entries whose windows are compared at once, about.
RUN = 1 << 14
NO_ID = np.iinfo(np.int64).max


def blocks(docs: DataFrame) -> DataFrame:
    """(ids, known, ends, body): runs of documents, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            for r0, r1, data, off in text_chunks(b.column(1), BLOCK_BYTES):
                own = b.column(0).slice(r0, r1 - r0)
                ids = own.fill_null(NO_ID).to_numpy()
                known = own.is_valid().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], pa.binary()) for x in (ids.tobytes(), known.tobytes(), off.astype(np.int64).tobytes(), pack.compress(data.tobytes()))] + [pa.array([len(data)], pa.int64())],
                    ["ids", "known", "ends", "body", "n_bytes"],
                )

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "ids binary, known binary, ends binary, body binary, n_bytes long")
    return out.withColumn("block", F.monotonically_increasing_id())


class Block:
    def __init__(self, ids: bytes, known: bytes, ends: bytes, body: bytes):
        self.ids, self.known = np.frombuffer(ids, np.int64), np.frombuffer(known, bool)
        self.off = np.frombuffer(ends, np.int64)
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
        self._anchors()

    def _anchors(self) -> None:
        """Positions of the anchors, their keys, documents, and the bytes of the document before and after them, HALF at most."""
        n = len(self.data)
        self.pos = np.zeros(0, np.int64)
        if n >= SPAN:
            h = window_hash(prefix_hash(self.data), HALF)
            if len(h) < n - HALF + 1:
                h = np.concatenate([h, np.zeros(n - HALF + 1 - len(h), U64)])
            least = _rolling(h, PLACES, np.minimum)
            lens = np.diff(self.off)
            # windows within one document only
            edge = np.zeros(n + 1, np.int64)
            full = lens >= SPAN
            np.add.at(edge, self.off[:-1][full], 1)
            np.add.at(edge, self.off[1:][full] - SPAN + 1, -1)
            least = np.where(np.cumsum(edge)[: len(least)] > 0, least, U64(0))
            pad = np.zeros(PLACES - 1, U64)
            most = _rolling(np.concatenate([pad, least, pad]), PLACES, np.maximum)
            self.pos = np.flatnonzero((most == h) & (most > 0))
            self.key = h[self.pos] >> U64(64 - KEY_BITS)
        else:
            self.key = np.zeros(0, U64)
        self.doc = np.searchsorted(self.off, self.pos, "right") - 1
        self.left = np.minimum(self.pos - self.off[self.doc], HALF)
        self.right = np.minimum(self.off[self.doc + 1] - self.pos - HALF, HALF)

    def only(self, keys: np.ndarray) -> None:
        """Keeps the anchors with these keys, and those that two documents of the block have."""
        if not len(self.pos):
            return
        keep = np.isin(self.key, keys)
        order = np.lexsort((self.doc, self.key))
        k, d = self.key[order], self.doc[order]
        two = k[1:][(k[1:] == k[:-1]) & (d[1:] != d[:-1])]
        keep |= np.isin(self.key, two)
        for name in ("pos", "key", "doc", "left", "right"):
            setattr(self, name, getattr(self, name)[keep])

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """(bytes before, bytes after) of each anchor, the nearest first; 0 beyond the document."""
        step = np.arange(HALF)
        padded = np.concatenate([np.zeros(HALF, np.uint8), self.data, np.zeros(HALF, np.uint8)])
        before = padded[self.pos[:, None] + (HALF - 1 - step)]
        after = padded[self.pos[:, None] + (2 * HALF + step)]
        before[step >= self.left[:, None]] = 0
        after[step >= self.right[:, None]] = 0
        return before, after

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(identity of each anchor's entry, the entries' first anchors, their identities, their least doc_id, contexts)."""
        before, after = self.contexts()
        ident = _identity(self.key, before, after, self.left, self.right)
        ids = self.ids[self.doc]
        order = np.lexsort((ids, ident))
        first = np.ones(len(order), bool)
        first[1:] = ident[order][1:] != ident[order][:-1]
        at = order[first]
        return ident, at, ident[at], ids[at], np.hstack([before, after])[at]


def _identity(key, before, after, left, right) -> np.ndarray:
    words = np.ascontiguousarray(np.hstack([before, after, left[:, None].astype(np.uint8), right[:, None].astype(np.uint8), np.zeros((len(key), 4), np.uint8)])).view(U64)
    out = mix(key + U64(1))
    for c in range(words.shape[1]):
        out = mix(out ^ words[:, c]) * U64(0x9E3779B97F4A7C15)
    return out


def _rolling(x: np.ndarray, width: int, best) -> np.ndarray:
    """The best of each run of ``width`` values."""
    size, out = 1, x
    while 2 * size <= width:
        out = best(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return best(out[:-rest], out[rest:]) if rest else out


def _bucket(key: np.ndarray, n: int) -> np.ndarray:
    """Ranges of keys: ordered keys have ordered buckets."""
    return ((key >> U64(16)) * U64(n) >> U64(KEY_BITS - 16)).astype(np.int64)


def _split(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    cut = np.flatnonzero(np.diff(bucket)) + 1
    for a, z in zip(np.concatenate(([0], cut)), np.concatenate((cut, [len(bucket)]))):
        if z > a:
            yield int(bucket[a]), slice(a, z)


def _pack_keys(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack_keys(raw: bytes) -> np.ndarray:
    x = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    out = np.zeros((len(x), 8), np.uint8)
    out[:, :6] = x
    return out.view(U64).ravel()


def _by_bucket(batches, columns: int):
    """Rows of a partition ordered by bucket, a bucket at a time."""
    at, rows = None, []
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(columns))):
            if row[0] != at:
                if rows:
                    yield at, rows
                at, rows = row[0], []
            rows.append(row)
    if rows:
        yield at, rows


def _grouped(df: DataFrame, n: int) -> DataFrame:
    return df.repartition(n, "bucket").sortWithinPartitions("bucket", "block")


def first_ranks(packed: DataFrame, n_buckets: int) -> DataFrame:
    """(bucket, block, keys): each block's anchors, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, *parts in zip(*(b.column(i).to_pylist() for i in range(5))):
                keys = np.unique(Block(*parts).key)
                rows = [(k, block, _pack_keys(keys[s])) for k, s in _split(_bucket(keys, n_buckets))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["bucket", "block", "keys"])

    return packed.select("block", "ids", "known", "ends", "body").mapInArrow(run, "bucket long, block long, keys binary")


def shared_ranks(ranks: DataFrame, partitions: int) -> DataFrame:
    """(block, keys): each block's anchors that another block has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_bucket(batches, 3):
            own = [_unpack_keys(r[2]) for r in rows]
            every = np.concatenate(own)
            order = np.argsort(every)
            key = every[order]
            twice = np.zeros(len(key), bool)
            twice[1:] = key[1:] == key[:-1]
            twice[:-1] |= twice[1:]
            keep = np.zeros(len(key), bool)
            keep[order[twice]] = True
            ends = np.cumsum([len(k) for k in own])
            out = [(r[1], _pack_keys(k[keep[z - len(k) : z]])) for r, k, z in zip(rows, own, ends)]
            out = [x for x in out if x[1]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["block", "keys"])

    return _grouped(ranks, partitions).mapInArrow(run, "block long, keys binary").groupBy("block").agg(F.collect_list("keys").alias("keys"))


def _all_keys(parts: list[bytes] | None) -> np.ndarray:
    return np.concatenate([_unpack_keys(p) for p in parts]) if parts else np.zeros(0, U64)


#: Key, least doc_id, how many bytes before and after, and those bytes.
ENTRY = np.dtype([("key", "<u8"), ("doc", "<i8"), ("left", "u1"), ("right", "u1"), ("bytes", "u1", 2 * HALF)])


def second_ranks(packed: DataFrame, n_buckets: int) -> DataFrame:
    """(bucket, block, entries): the anchors that are left, with the bytes around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            for block, *parts, keys in zip(*(b.column(i).to_pylist() for i in range(6))):
                x = Block(*parts)
                x.only(_all_keys(keys))
                if not len(x.pos):
                    continue
                _, at, _, doc, around = x.entries()
                order = np.argsort(x.key[at], kind="stable")
                at, doc, around = at[order], doc[order], around[order]
                key = x.key[at]
                rows = []
                for k, s in _split(_bucket(key, n_buckets)):
                    # by columns, which compress better
                    cols = [_pack_keys(key[s]), doc[s].tobytes(), x.left[at[s]].astype(np.uint8).tobytes(), x.right[at[s]].astype(np.uint8).tobytes(), around[s].tobytes()]
                    rows.append((k, block, s.stop - s.start, pack.compress(b"".join(cols))))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["bucket", "block", "n", "entries"])

    return packed.select("block", "ids", "known", "ends", "body", "keys").mapInArrow(run, "bucket long, block long, n long, entries binary")


def _entries_of(n: int, raw: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    out = np.zeros(n, ENTRY)
    out["key"] = _unpack_keys(raw[: 6 * n])
    out["doc"] = np.frombuffer(raw, np.int64, n, 6 * n)
    out["left"] = np.frombuffer(raw, np.uint8, n, 14 * n)
    out["right"] = np.frombuffer(raw, np.uint8, n, 15 * n)
    out["bytes"] = np.frombuffer(raw, np.uint8, 2 * HALF * n, 16 * n).reshape(n, 2 * HALF)
    return out


def earlier_windows(e: np.ndarray) -> np.ndarray:
    """A bit for each place of a window around each entry: an equal window has a smaller doc_id."""
    n = len(e)
    before = np.zeros((HALF + 1, n), U64)
    after = np.zeros((HALF + 1, n), U64)
    for i in range(HALF):
        before[i + 1] = mix(before[i] * U64(0x9E3779B97F4A7C15) + e["bytes"][:, i] + U64(1))
        after[i + 1] = mix(after[i] * U64(0xC2B2AE3D27D4EB4F) + e["bytes"][:, HALF + i] + U64(1))
    mask = np.zeros(n, np.uint32)
    for o in range(PLACES):
        valid = np.flatnonzero((e["left"] >= HALF - o) & (e["right"] >= o))
        if len(valid) < 2:
            continue
        h = mix(e["key"][valid] ^ before[HALF - o][valid]) * U64(0xD6E8FEB86659FD93) ^ after[o][valid]
        doc = e["doc"][valid]
        order = np.argsort(h, kind="stable")
        start = np.concatenate(([0], np.flatnonzero(h[order][1:] != h[order][:-1]) + 1))
        least = np.minimum.reduceat(doc[order], start)
        group = np.zeros(len(order), np.int64)
        group[start[1:]] = 1
        group = np.cumsum(group)
        hit = least[group] < doc[order]
        mask[valid[order[hit]]] |= np.uint32(1 << o)
    return mask


def repeated_windows(ranks: DataFrame, partitions: int) -> DataFrame:
    """(block, hits): identity and places of each block's entries of which some window stands in an earlier document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for _, rows in _by_bucket(batches, 4):
            parts = [_entries_of(r[2], r[3]) for r in rows]
            every = np.concatenate(parts)
            owner = np.repeat(np.arange(len(rows)), [len(p) for p in parts])
            order = np.argsort(every["key"], kind="stable")
            key = every["key"][order]
            again = np.zeros(len(key), bool)
            again[1:] = key[1:] == key[:-1]
            again[:-1] |= again[1:]
            some, key = order[again], key[again]
            # runs of whole keys, so that the work for a run stays small
            cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
            cuts = [*cuts[np.unique(cuts // RUN, return_index=True)[1]].tolist(), len(key)]
            found = [(some[a:z][m > 0], m[m > 0]) for a, z in zip(cuts[:-1], cuts[1:]) for m in [earlier_windows(every[some[a:z]])]]
            out = []
            if found:
                some, mask = (np.concatenate(x) for x in zip(*found))
                e = every[some]
                ident = _identity(e["key"], e["bytes"][:, :HALF], e["bytes"][:, HALF:], e["left"], e["right"])
                turn = np.argsort(owner[some], kind="stable")
                some, mask, ident = some[turn], mask[turn], ident[turn]
                for r, s in _split(owner[some]):
                    out.append((rows[r][1], pack.compress(ident[s].tobytes() + mask[s].tobytes())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["block", "hits"])

    return _grouped(ranks, partitions).mapInArrow(run, "block long, hits binary").groupBy("block").agg(F.collect_list("hits").alias("hits"))


def covered(x: Block, hits: list[bytes] | None) -> np.ndarray:
    """Which bytes of the block go."""
    out = np.zeros(len(x.data) + 1, np.int64)
    if len(x.pos):
        ident, _, own, least, _ = x.entries()
        at = np.searchsorted(own, ident)
        mask = np.zeros(len(own), np.uint32)
        for raw in hits or []:
            raw = zstandard.ZstdDecompressor().decompress(raw)
            k = len(raw) // 12
            mask[np.searchsorted(own, np.frombuffer(raw, U64, k))] |= np.frombuffer(raw, np.uint32, k, 8 * k)
        every = x.ids[x.doc] > least[at]
        for o in range(PLACES):
            hit = ((mask[at] >> np.uint32(o)) & 1).astype(bool) | every
            hit &= (x.left >= HALF - o) & (x.right >= o)
            start = x.pos[hit] - HALF + o
            np.add.at(out, start, 1)
            np.add.at(out, start + SPAN, -1)
    return np.cumsum(out)[:-1] > 0


def _cut(packed: DataFrame, texts: bool) -> DataFrame:
    """A row for each document; with ``texts`` also what is kept."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for *parts, keys, hits in zip(*(b.column(i).to_pylist() for i in range(6))):
                x = Block(*parts)
                x.only(_all_keys(keys))
                gone = covered(x, hits)
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                inner = x.off[:-1][np.diff(x.off) > 0]
                begins[inner] = gone[inner]
                total, spans = (np.concatenate(([0], np.cumsum(v))) for v in (gone, begins))
                kept = x.data[~gone].tobytes()
                ends = x.off - total[x.off]
                own = [kept[a:z] for a, z in zip(ends[:-1], ends[1:])]
                cols = [
                    pa.array(x.ids, mask=~x.known),
                    pa.array(np.diff(x.off)),
                    pa.array(np.diff(total[x.off])),
                    pa.array(np.diff(spans[x.off])),
                    pa.array([hashlib.sha256(k).hexdigest() for k in own], pa.string()),
                ] + [pa.array(own, pa.binary())] * texts
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    return packed.select("ids", "known", "ends", "body", "keys", "hits").mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, texts: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes if ``texts``."""
    packed = stored(blocks(docs), "none")
    n = shuffle_partitions(docs.sparkSession)
    total = packed.agg(F.sum("n_bytes")).first()[0] or 0
    n_buckets = max(4 * n, int(total * 0.08 / BUCKET) + 1)
    shared = stored(shared_ranks(first_ranks(packed, n_buckets), n))
    both = packed.join(shared, "block", "left")
    hits = repeated_windows(second_ranks(both, n_buckets), n)
    return _cut(packed.join(shared, "block", "left").join(hits, "block", "left"), texts)
