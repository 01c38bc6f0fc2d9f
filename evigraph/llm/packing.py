"""Packing token sequences by best-fit decreasing.

Every text is tokenized whole and cut into full windows; what is left over is a piece shorter than a window. Best-fit decreasing
then puts each piece, longest first, into the open window with the least room that still holds it. Pieces of one length are
interchangeable, so the placement needs only how many pieces there are of each length: a segment tree over remaining capacity
finds the tightest open windows, and as many equal pieces as fit are placed at once. The plan has a few runs for each length;
executors look their pieces up in it by length and rank. Ranks come from counts by (length, salt), so no length gathers in a task;
full windows, most pieces of a large corpus, have as many salts as there are shuffle partitions.

Defined results: a null or empty text is the closing id 0 alone; equal rows get pieces of their own; an empty table gives none.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigraph.llm._spark import shuffle_partitions, stored
from evigraph.llm._tokens import Encoder

WINDOW = 1024
MOST_SALTS = 256
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class CapacityTree:
    """Segment tree over capacities 0 to n: which have open windows; ``tightest(need)`` is the least of them >= need."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.any = [False] * (2 * self.size)

    def mark(self, capacity: int, on: bool) -> None:
        i = capacity + self.size
        self.any[i] = on
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        i = need + self.size
        if self.any[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def plan(counts: dict[int, int], window: int = WINDOW) -> tuple[list[tuple[int, int, int, int]], int]:
    """(runs, windows): a run (length, first rank, first sequence, offset) places ranks onward in sequences onward."""
    tree = CapacityTree(window)
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # capacity -> runs (first sequence, how many)
    runs, n_seq = [], 0

    def put(length: int, rank: int, seq: int, many: int, room: int, each: int) -> int:
        """``each`` pieces into each of ``many`` windows of this room."""
        for j in range(each):
            runs.append((length, rank + j * many, seq, window - room + j * length))
        left = room - each * length
        if left:
            rooms[left].append((seq, many))
            tree.mark(left, True)
        return rank + many * each

    for length in sorted(counts, reverse=True):
        rank, total = 0, counts[length]
        while rank < total:
            room = tree.tightest(length)
            if room is None:
                room = window
                each = window // length
                many = max(1, (total - rank) // each)
                seq, n_seq = n_seq, n_seq + many
            else:
                each = room // length
                seq, have = rooms[room].pop()
                many = min(have, max(1, (total - rank) // each))
                if have > many:
                    rooms[room].append((seq + many, have - many))
                tree.mark(room, bool(rooms[room]))
            rank = put(length, rank, seq, many, room, min(each, total - rank))
    return runs, n_seq


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """The windows and the rest of each document: doc_id, start, length, ids_crc32, doc_tokens (and ids, if kept)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder.at(tokenizer).encode
        for b in batches:
            for r0 in range(0, b.num_rows, 1000):
                part = b.slice(r0, 1000)
                rows = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = encode(text or "") + b"\0\0\0\0"
                    n = len(ids) // 4
                    for start in range(0, n, window):
                        own = ids[4 * start : 4 * (start + window)]
                        rows.append((doc, start, len(own) // 4, zlib.crc32(own), n, *([own] if keep_ids else [])))
                cols = list(zip(*rows))
                arrays = [pa.array(c, pa.int64()) for c in cols[:5]] + [pa.array(c, pa.binary()) for c in cols[5:]]
                if rows:
                    yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if keep_ids else [])])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES + (", ids binary" if keep_ids else ""))


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """The pieces with sequence_id and offset."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    full = shuffle_partitions(docs.sparkSession)
    salts = min(MOST_SALTS, full)
    salt = lambda n: F.pmod(F.xxhash64("doc_id", "start"), F.lit(n)).cast("int")
    cut = stored(pieces(docs, tokenizer, window, keep_ids)).withColumn("_salt", F.when(F.col("length") == window, salt(full)).otherwise(salt(salts)))
    # at most window * salts + full rows, whatever the input
    counted = cut.groupBy("length", "_salt").count().collect()
    base, tops = np.zeros((window, salts + 1), dtype=np.int64), np.zeros((1, full + 1), dtype=np.int64)
    for length, k, n in counted:
        (tops[0] if length == window else base[length])[k + 1] = n
    base, tops = base.cumsum(axis=1), tops.cumsum(axis=1)
    counts = {int(k): int(base[k, -1]) for k in np.flatnonzero(base[:, -1])} | ({window: int(tops[0, -1])} if tops[0, -1] else {})
    runs, n_seq = plan(counts, window)
    runs.sort()
    table = np.array(runs, dtype=np.int64).reshape(-1, 4)
    key = (table[:, 0] << 44) + table[:, 1]
    names = cut.columns + ["_rn"]
    ranked = cut.withColumn("_rn", F.row_number().over(W.partitionBy("length", "_salt").orderBy("doc_id", "start", "ids_crc32")))
    # ranks before a salt, by length and salt, full windows last
    before, at_length = np.concatenate((base[:, :-1].ravel(), tops[0, :-1])), np.arange(window + 1) * salts

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = lambda c: b.column(names.index(c)).to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: E731, B023
            length = col("length")
            rank = before[at_length[length] + col("_salt")] + col("_rn") - 1
            at = np.searchsorted(key, (length << 44) + rank, side="right") - 1
            seq, offset = table[at, 2] + rank - table[at, 1], table[at, 3]
            keep = [b.column(names.index(c)) for c in names if c not in ("_salt", "_rn")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(seq), pa.array(offset)], [*[c for c in names if c not in ("_salt", "_rn")], "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECES + (", ids binary" if keep_ids else "") + ", sequence_id long, offset long")


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """(sequence_id, n_tokens, ids): the sequences of pieces packed with their ids, padded unless the length is a power of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(1).to_pylist()
            full = [x if x & (x - 1) == 0 else window for x in n]
            ids = [np.frombuffer(b"".join(p["ids"] for p in parts), np.uint32) for parts in b.column(2).to_pylist()]
            out = [np.concatenate([i, np.full(f - len(i), pad_id, np.uint32)]).astype(np.int32).tolist() for i, f in zip(ids, full)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int32()))], ["sequence_id", "n_tokens", "ids"])

    own = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return own.mapInArrow(run, "sequence_id long, n_tokens long, ids array<int>")
