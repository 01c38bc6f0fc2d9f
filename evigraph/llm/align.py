"""Alignment of two tokenizers over a corpus, by distinct segments.

A text, with a space before it, is cut before runs of white space where neither vocabulary can merge across: no token of either holds a
character that is not white space followed by the run's first one (``safe_cuts`` reads both vocabularies). So a text's tokens are those of
its segments, and no group of aligned tokens crosses a cut. Then:

1. Documents are gathered in blocks of some megabytes; a block is the list of its distinct segments and its texts as numbers in it.
2. The segments of all blocks are dealt by hash. A task meets equal segments of all blocks together, tokenizes and aligns each distinct one
   once, and sends the alignments back, one packed row for each block: a frequent segment costs a place in a row, not a row of its own.
3. Blocks compose their documents from the alignments and list the linked pairs of ids with the number of their documents that hold them.
   These are added over all blocks, joined back to the blocks, and summed over each document's links.

What a task holds is bounded by ``BLOCK_BYTES`` (or one longer text) and by ``BUCKET_BYTES`` of segments. Nothing comes to the driver but the
number of buckets. Each step reads a table in the shared folder, so a lost executor costs the rest of a step.

Defined results: a null or empty text, and one whose tokens do not spell it out (a text with U+2581, which one vocabulary takes for a space),
has no tokens: zeros and an empty digest, and it counts for no pair. Equal rows are documents of their own, null doc_ids stay; strings of special
tokens are plain text; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm._spark import shuffle_partitions, stored
from evigraph.llm._tokens import Encoder, _byte_of

BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 4 << 20
#: Characters that some regular expression takes for white space: never cut behind one.
SPACES = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f" + "".join(map(chr, [0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
#: Runs may be cut off before these.
FIRST = "\t\n\x0b\x0c\r "
MARK = "▁"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class ByteTokens:
    """Ids and lengths in bytes of a byte-level vocabulary of the tokenizers library."""

    def __init__(self, path: str):
        self.encoder = Encoder.at(path)
        of, vocab = _byte_of(), self.encoder.tokenizer.get_vocab(with_added_tokens=False)
        self.token = {i: bytes(of[c] for c in t) for t, i in vocab.items() if all(c in of for c in t)}

    def vocabulary(self) -> list[bytes]:
        return list(self.token.values())

    def encode(self, segment: str) -> list[int]:
        return self.encoder.plain(segment)


class PieceTokens:
    """The same of a sentencepiece model, which puts a space before what it is given."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        byte = re.compile("<0x([0-9A-F]{2})>")
        self.token = {}
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.token[i] = bytes([int(byte.fullmatch(piece)[1], 16)])
            elif not self.model.is_control(i) and not self.model.is_unknown(i):
                self.token[i] = piece.replace(MARK, " ").encode()

    def vocabulary(self) -> list[bytes]:
        return list(self.token.values())

    def encode_all(self, segments: list[str]) -> list[list[int]]:
        """A space that the segment does not begin with is the first token alone, since no token merges across; it is left out. Nothing is
        put before an empty text, so a single space is encoded with a line feed behind it."""
        found = self.model.encode(["\n" if s == " " else s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        return [ids[:1] if s == " " else ids if s[0] == " " else ids[1:] for s, ids in zip(segments, found)]


@lru_cache(maxsize=2)
def _tokenizers(a: str, b: str) -> tuple[ByteTokens, PieceTokens]:
    return ByteTokens(a), PieceTokens(b)


def safe_cuts(*vocabularies: list[bytes]) -> str:
    """The characters of ``FIRST`` before which a run of white space may be cut off: in no token one follows a character that is no white
    space, nor, but for the space, a space (which is put before a segment)."""
    spaces = [s.encode() for s in SPACES if s not in FIRST]
    joined = set()
    for tokens in vocabularies:
        for t in tokens:
            for s in spaces:
                t = t.replace(s, b"\t")
            joined.update(re.findall(rb"[^\t\n\x0b\x0c\r ]([\t\n\x0b\x0c\r ])", t) + re.findall(rb" ([\t\n\x0b\x0c\r])", t))
    return "".join(c for c in FIRST if c.encode() not in joined)


def segmenter(safe: str):
    """Cuts a text that begins with white space into segments that begin with a character of ``safe``, but for the first."""
    other = re.escape("".join(s for s in SPACES if s not in safe))
    space = re.escape(SPACES)
    return re.compile(f"[{space}]*[^{space}]+(?:[{other}][{space}]*[^{space}]*)*|[{space}]+").findall


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of non-negative integers below 2 ** 32, the bytes of one rank together, compressed."""
    planes = [np.array([len(arrays), *map(len, arrays)], np.uint32).tobytes()]
    planes += [np.ascontiguousarray(x.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes() for x in arrays]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(planes))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n = int(raw[:4].view("<u4")[0])
    at, out = 4 * (n + 1), []
    for length in raw[4:at].view("<u4").tolist():
        out.append(np.ascontiguousarray(raw[at : at + 4 * length].reshape(4, -1).T).view("<u4").ravel().astype(np.int64))
        at += 4 * length
    return out


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, ``counts`` long."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class Alignment:
    """Tokens of segments: by segment how many of A and B (-1 where they do not spell it out), their ids and lengths one after another."""

    def __init__(self, n_a, n_b, a, b, a_len, b_len):
        self.arrays = [np.asarray(x, np.int64) for x in (n_a, n_b, a, b, a_len, b_len)]

    @classmethod
    def of(cls, segments: list[str], first: ByteTokens, second: PieceTokens) -> Alignment:
        rows: list[list[int]] = [[], [], [], [], [], []]
        for s, b in zip(segments, second.encode_all(segments)):
            a, data = first.encode(s), s.encode()
            at, bt = [first.token.get(i, b"") for i in a], [second.token.get(i, b"") for i in b]
            if b"".join(at) != data or b"".join(bt) != data:
                a, b, at, bt = [], [], [], []  # no segment is empty, so no tokens tell it
            for row, new in zip(rows, ([len(a)], [len(b)], a, b, map(len, at), map(len, bt))):
                row.extend(new)
        return cls(*rows)

    @classmethod
    def joined(cls, parts: list[Alignment]) -> Alignment:
        return cls(*[np.concatenate(x) for x in zip(*[p.arrays for p in parts])]) if parts else cls(*[[]] * 6)

    def take(self, at: np.ndarray) -> Alignment:
        n_a, n_b, a, b, a_len, b_len = self.arrays
        ia, ib = (ragged((np.cumsum(n) - n)[at], n[at]) for n in (n_a, n_b))
        return Alignment(n_a[at], n_b[at], a[ia], b[ib], a_len[ia], b_len[ib])

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """(pair of each link as A id << 32 | B id, links by segment, groups by segment, tokens (A, B), groups as text by segment).

        Between two neighbouring ends of tokens just one A and one B token overlap, so each link is one stretch between ends."""
        n_a, n_b, a, b, a_len, b_len = self.arrays
        a_end, b_end = np.cumsum(a_len), np.cumsum(b_len)
        ends = np.union1d(a_end, b_end)
        ia, ib = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)
        pair = (a[ia] << 32) | b[ib] if len(ends) else np.zeros(0, np.int64)
        owner_a = np.repeat(np.arange(len(n_a)), n_a)
        links = np.bincount(owner_a[ia], minlength=len(n_a))
        both = (a_end[ia] == ends) & (b_end[ib] == ends) if len(ends) else np.zeros(0, bool)
        groups = np.bincount(owner_a[ia[both]], minlength=len(n_a))
        cut_a, cut_b = set(ia[both].tolist()), set(ib[both].tolist())
        write = lambda ids, cut: "".join(f"{x};" if i in cut else f"{x}," for i, x in enumerate(ids.tolist())).split(";")
        text = [f"{x}|{y}" for x, y in zip(write(a, cut_a), write(b, cut_b))]
        stop = np.cumsum(groups).tolist()
        return pair, links, groups, (n_a, n_b), [";".join(text[e - g : e]) for e, g in zip(stop, groups.tolist())]


def cut(docs: DataFrame, safe: str) -> DataFrame:
    """(block, ids, sizes, order, segs, bytes): a block's distinct segments by hash, and its documents as numbers of segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, nth, part = segmenter(safe), 0, TaskContext.get().partitionId()
        ids, sizes, order, number, size = [], [], [], {}, 0

        def block() -> pa.RecordBatch:
            segs = list(number)
            hashed = np.fromiter(map(zlib.crc32, map(str.encode, segs)), np.uint32, len(segs))
            by_hash = np.argsort(hashed, kind="stable")
            at = np.empty(len(segs), np.int64)
            at[by_hash] = np.arange(len(segs))
            used = np.fromiter(order, np.int64, len(order))
            often = np.argsort(-np.bincount(used, minlength=len(segs)), kind="stable")  # small numbers for frequent segments
            code = np.empty(len(segs), np.int64)
            code[often] = np.arange(len(segs))
            segs = [segs[i] for i in by_hash.tolist()]
            row = [[part << 32 | nth], [ids], [sizes], [pack(code[used], at[often])], [segs], [sum(len(s) for s in segs) + 8 * len(segs)]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds)], names)

        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.string()), pa.int64()]
        names = ["block", "ids", "sizes", "order", "segs", "bytes"]
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                found = split(" " + text) if text else []
                ids.append(doc)
                sizes.append(len(found))
                for s in found:
                    order.append(number.setdefault(s, len(number)))
                size += 64 + len(text or "")
                if size >= BLOCK_BYTES:
                    yield block()
                    ids, sizes, order, number, size, nth = [], [], [], {}, 0, nth + 1
        if ids:
            yield block()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "block long, ids array<long>, sizes array<int>, order binary, segs array<string>, bytes long")


def deal(blocks: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, segs): each block's segments by bucket, in the block's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, segs in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = np.fromiter(map(zlib.crc32, map(str.encode, segs)), np.uint64, len(segs)) * np.uint64(buckets) >> np.uint64(32)
                first = np.flatnonzero(np.concatenate((np.ones(min(1, len(own)), bool), own[1:] != own[:-1])))
                rows = [segs[i:j] for i, j in zip(first, [*first[1:], len(segs)])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[first].astype(np.int32)), pa.array(np.full(len(first), block, np.int64)), pa.array(rows, pa.list_(pa.string()))], ["bucket", "block", "segs"]
                )

    return blocks.select("block", "segs").mapInArrow(run, "bucket int, block long, segs array<string>")


def align_segments(dealt: DataFrame, a: str, b: str) -> DataFrame:
    """(block, bucket, aligned): rows by bucket, whose distinct segments are tokenized and aligned once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = _tokenizers(a, b)
        bucket, number, parts = None, {}, []
        for batch in batches:
            buckets, whole = batch.column(0).to_pylist(), batch.column(2)
            cuts = [0, *[i for i in range(1, len(buckets)) if buckets[i] != buckets[i - 1]], len(buckets)]
            for i, j in zip(cuts, cuts[1:]):
                if buckets[i] != bucket:
                    bucket, number, parts = buckets[i], {}, []
                rows = whole.slice(i, j - i).to_pylist()
                new = list(dict.fromkeys(s for row in rows for s in row if s not in number))
                number.update(zip(new, range(len(number), len(number) + len(new))))
                parts = [Alignment.joined([*parts, Alignment.of(new, first, second)])]
                out = [pack(*parts[0].take(np.fromiter((number[s] for s in row), np.int64, len(row))).arrays) for row in rows]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), batch.column(0).slice(i, j - i), pa.array(out, pa.binary())], ["block", "bucket", "aligned"])

    return dealt.mapInArrow(run, "block long, bucket int, aligned binary")


COMPOSED = "ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digests array<string>, texts array<string>, matrix binary, pairs array<long>, holders array<long>"


def compose(blocks: DataFrame, aligned: DataFrame, keep_groups: bool) -> DataFrame:
    """A row for each block: its documents' figures, its linked pairs with how many of its documents hold them, and the links of each
    document by pair (``matrix``)."""

    def block(order: bytes, sizes: list[int], parts: list[bytes]) -> list:
        code, at = unpack(order)
        pair, links, groups, (n_a, n_b), text = Alignment.joined([Alignment(*unpack(p)) for p in parts]).links()
        used, sizes = at[code], np.array(sizes, np.int64)
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        good = (sizes > 0) & ~np.isin(np.arange(len(sizes)), owner[n_a[used] == 0])
        add = lambda x: np.where(good, np.bincount(owner, weights=x[used], minlength=len(sizes)), 0).astype(np.int64).tolist()
        texts = [";".join(map(text.__getitem__, used[e - n : e].tolist())) if g else "" for e, n, g in zip(ends.tolist(), sizes.tolist(), good.tolist())]
        digests = [sha256(t.encode()).hexdigest() if g else "" for t, g in zip(texts, good.tolist())]
        # links by document and pair
        names, name = np.unique(pair, return_inverse=True)
        keep = good[owner]
        key, times = np.unique(owner[keep] << 32 | used[keep], return_counts=True)
        doc, seg = key >> 32, key & 0xFFFFFFFF
        held = name[ragged((np.cumsum(links) - links)[seg], links[seg])]
        cell, at_cell = np.unique(np.repeat(doc, links[seg]) << 32 | held, return_inverse=True)
        many = np.bincount(at_cell, weights=np.repeat(times, links[seg]), minlength=len(cell))
        doc, held = cell >> 32, cell & 0xFFFFFFFF
        matrix = pack(np.bincount(doc, minlength=len(sizes)), held, many)
        holders = np.bincount(held, minlength=len(names))
        return [add(n_a), add(n_b), add(groups), add(links), digests, texts if keep_groups else [None] * len(sizes), matrix, names.tolist(), holders.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), *[(n, pa.list_(pa.int64())) for n in ("n_a", "n_b", "n_groups", "n_links")]])
        for n, t in (("digests", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("matrix", pa.binary()), ("pairs", pa.list_(pa.int64())), ("holders", pa.list_(pa.int64()))):
            schema = schema.append(pa.field(n, t))
        at, head, parts = None, None, []

        def done() -> pa.RecordBatch:
            ids, sizes, order = head
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, [at, ids, *block(order, sizes, parts)]))], schema)

        for b in batches:
            for i, number in enumerate(b.column(0).to_pylist()):
                if number != at:
                    if head:
                        yield done()
                    at, head, parts = number, [b.column(k)[i].as_py() for k in (2, 3, 4)], []
                else:
                    parts.append(b.column(5)[i].as_py())
        if head:
            yield done()

    heads = blocks.selectExpr("block", "-1 AS bucket", "ids", "sizes", "order", "CAST(null AS BINARY) AS aligned")
    rows = heads.unionByName(aligned, allowMissingColumns=True).repartition(shuffle_partitions(blocks.sparkSession), "block").sortWithinPartitions("block", "bucket")
    return rows.mapInArrow(run, "block long, " + COMPOSED)


def add_counts(composed: DataFrame, counts: DataFrame, keep_groups: bool) -> DataFrame:
    """The documents' rows with the sums of their links' counts. counts: (block, at, count, best), ``at`` the pair's place in its block."""
    figures = ["ids", "n_a", "n_b", "n_groups", "n_links", "digests", "texts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, head, counts = None, None, []

        def done() -> Iterator[pa.RecordBatch]:
            per_doc, held, many = unpack(head[-1])
            place, count, best = (np.concatenate([c[k] for c in counts]) if counts else np.zeros(0, np.int64) for k in range(3))
            sums, tops = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
            sums[place], tops[place] = count, best
            total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[np.concatenate(([0], np.cumsum(per_doc)))])
            ids, n_a, n_b, n_groups, n_links, digests, texts = head[:-1]
            cols = [ids, n_a, n_b, n_groups, n_links, pa.array(total(many * tops[held])), pa.array(total(many * sums[held])), digests, *([texts] if keep_groups else [])]
            yield pa.RecordBatch.from_arrays(cols, [*[f.split()[0] for f in RESULT.split(", ")], *(["groups"] if keep_groups else [])])

        for b in batches:
            number = b.column(0).to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(number[1:] != number[:-1]) + 1, [len(number)]))
            for i, j in zip(cuts[:-1], cuts[1:]):
                if number[i] != at:
                    if head:
                        yield from done()
                    at, counts = number[i], []
                    head = [b.column(k)[i].values for k in range(2, 2 + len(figures))] + [b.column(2 + len(figures))[i].as_py()]
                    i += 1
                if j > i:
                    counts.append([b.column(k).slice(i, j - i).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, -2, -1)])
        if head:
            yield from done()

    heads = composed.selectExpr("block", "-1L AS at", *figures, "matrix", "CAST(null AS BIGINT) AS count", "CAST(null AS INT) AS best")
    rows = heads.unionByName(counts, allowMissingColumns=True).repartition(shuffle_partitions(composed.sparkSession), "block").sortWithinPartitions("block", "at")
    return rows.mapInArrow(run, RESULT + (", groups string" if keep_groups else ""))


def align(docs: DataFrame, byte_bpe: str | None = None, piece_bpe: str | None = None, keep_groups: bool = False) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; with ``keep_groups`` also the groups as text."""
    if byte_bpe is None or piece_bpe is None:
        import public_tokenizers

        byte_bpe, piece_bpe = byte_bpe or public_tokenizers.path("byte_bpe_50k.json"), piece_bpe or public_tokenizers.path("piece_bpe_32k.model")
    safe = safe_cuts(*[t.vocabulary() for t in _tokenizers(byte_bpe, piece_bpe)])
    blocks = stored(cut(docs, safe))
    buckets = 1 + int(blocks.agg(F.sum("bytes")).first()[0] or 0) // BUCKET_BYTES
    tasks = max(buckets, shuffle_partitions(docs.sparkSession))
    dealt = deal(blocks, buckets).repartition(tasks, "bucket").sortWithinPartitions("bucket", "block")
    composed = stored(compose(blocks, align_segments(dealt, byte_bpe, piece_bpe), keep_groups))
    listed = composed.select("block", F.posexplode(F.arrays_zip("pairs", "holders")).alias("at", "x")).selectExpr("block", "CAST(at AS BIGINT) AS at", "x.pairs AS pair", "x.holders AS holders")
    counted = listed.groupBy("pair").agg(F.sum("holders").alias("count"))
    most = counted.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("count").alias("most"))
    known = counted.withColumn("a", F.shiftright("pair", 32)).join(most, "a").selectExpr("pair", "count", "CAST(count = most AS INT) AS best")
    return add_counts(composed, listed.join(known, "pair").select("block", "at", "count", "best"), keep_groups)
