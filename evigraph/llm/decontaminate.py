"""Benchmark decontamination by spaced-seed hashing.

Fixed masks pick some of the token positions of a short span and ignore the others, so a hit survives substituted words. The
hashes of all masks at all positions of the benchmark are joined with those of every position of the documents; around each hit
the two texts are laid side by side and the best overlap, mismatches allowed, is measured. The masks miss no overlap that counts:
no run of tokens with the matches and the rate below avoids all of them (the tests prove it).

An item of fewer than ``SHORT`` tokens leaves no room for substitutions: it is found where it stands word for word, and one of
fewer than ``LEAST`` tokens only where it is a whole document, since two or three words stand in any text.

The benchmark is taken in blocks of at most ``BLOCK_TOKENS`` tokens, each of which goes to all tasks; the documents are read once
for each block (one, unless the benchmark is very large). Tokens are case-folded runs of letters and digits.

Defined results: null or empty texts and items match nothing; equal rows and equal items each give their rows; a null id is a
null in the result. ``overlaps`` ignores extra columns; ``clean`` judges each row by its text alone, so rows without an id and
rows of one id are kept or go on their own, and keeps columns of any name. An empty table gives an empty one, an empty benchmark
removes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm._text import NOT_WORD, U64, fold_case, mix, prefix_hash, span_hash, text_chunks, words

#: 1: the token counts; 0: it is ignored.
MASKS = ("11111", "111011", "11010011", "1100001011")
SHORT = 8
LEAST = 5
BLOCK_TOKENS = 2_000_000
#: An overlap counts with so many matching tokens (or this share of a shorter item) at this rate of matches.
MIN_MATCHED = 10
MIN_SHARE = 0.8
MIN_RATE = 0.75
#: Tokens of shifted items that are compared at once.
CELLS = 1 << 21
_WEIGHTS = [U64(mix(np.array([k + 1], U64) * U64(0x9E3779B97F4A7C15))[0] | U64(1)) for k in range(max(map(len, MASKS)))]


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each token, starts, ends, tokens before each text)."""
    low = fold_case(data)
    starts, ends, before = words(low, offsets, NOT_WORD)
    return span_hash(prefix_hash(low), starts, ends), starts, ends, before


def seeds(h: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """The hash of the mask laid at each position; fewer than ``h`` by the mask's length less one."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, U64)
    s = np.full(n, salt + 1, U64)
    for k, c in enumerate(mask):
        if c == "1":
            s += (h[k : k + n] ^ (h[k : k + n] >> U64(31))) * _WEIGHTS[k]
    return mix(s)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, ``counts`` long."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """The distinct pairs (a, b) in order, which of them each is, and how often each stands. a is not negative, b within 31 bits of 0."""
    key, own, times = np.unique((a.astype(np.int64) << 32) + (b + (1 << 31)), return_inverse=True, return_counts=True)
    return (key >> 32, (key & 0xFFFFFFFF) - (1 << 31)), own, times


class SeedIndex:
    """The seeds of a block of benchmark items, and the items' tokens."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.ids = [i for i, _ in items]
        text = pa.array([t for _, t in items], pa.string())
        hs, befores, base = [], [np.zeros(1, np.int64)], 0
        for _, _, data, off in text_chunks(text):
            h, _, _, before = tokens(data, off)
            hs.append(h)
            befores.append(before[1:] + base)
            base += len(h)
        self.h = np.concatenate(hs) if hs else np.zeros(0, U64)
        self.before = np.concatenate(befores)
        owner = np.repeat(np.arange(len(items)), np.diff(self.before))
        keys, places = [], []
        for m, mask in enumerate(MASKS):
            s = seeds(self.h, mask, m)
            if not len(s):
                continue
            ok = (owner[: len(s)] == owner[len(mask) - 1 :]) & (np.diff(self.before)[owner[: len(s)]] >= SHORT)
            keys.append(s[ok])
            places.append(np.flatnonzero(ok))
        self.key = np.concatenate(keys) if keys else np.zeros(0, U64)
        self.place = np.concatenate(places) if places else np.zeros(0, np.int64)
        order = np.argsort(self.key, kind="stable")
        self.key, self.place = self.key[order], self.place[order]
        self.owner = owner
        # by length: the hashes of short items as a whole, in order, and their numbers
        self.short = {}
        n_tokens = np.diff(self.before)
        for n in range(1, SHORT):
            own = np.flatnonzero(n_tokens == n)
            if len(own):
                whole = seeds(self.h, "1" * n, len(MASKS) + n)[self.before[own]]
                order = np.argsort(whole, kind="stable")
                self.short[n] = whole[order], own[order]
        self.bits = max(16, min(27, int(len(self.key) * 32).bit_length()))
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[(self.key >> U64(64 - self.bits)).astype(np.int64)] = True

    def hits(self, h: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(text, item, shifts) of texts with the tokens ``h``: where the item, laid so many tokens into the text, has an equal seed. A pair
        with more equal seeds than shifts, as repeated words make, gets all its shifts, since no overlap that counts lacks a seed."""
        keys, places = [], []
        for m, mask in enumerate(MASKS):
            s = seeds(h, mask, m)
            if len(s) and len(self.key):
                at = np.flatnonzero(self.seen[(s >> U64(64 - self.bits)).astype(np.int64)])
                keys.append(s[at])
                places.append(at)
        if not keys:
            return
        key, place = np.concatenate(keys), np.concatenate(places)
        lo, hi = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        place, lo, n = place[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        text = np.searchsorted(before, place, "right") - 1
        # equal seeds of one text count once for each place in the benchmark
        (text, lo), own, times = _distinct(text, lo)
        n = n[np.argsort(own, kind="stable")[np.concatenate(([0], np.cumsum(times)[:-1]))]] if len(own) else n
        sizes, width = np.diff(before), np.diff(self.before)
        places = np.split(place[np.argsort(own, kind="stable")], np.cumsum(times)[:-1]) if len(own) else []
        for t in np.unique(text):
            groups = np.arange(*np.searchsorted(text, (t, t + 1)))
            to = self.place[ragged(lo[groups], n[groups])]
            item, of = self.owner[to], np.repeat(groups, n[groups])
            pairs = np.bincount(item, weights=times[of], minlength=len(self.ids))
            many = pairs > sizes[t] + width
            for i in np.flatnonzero(many).tolist():
                yield int(t), i, np.arange(1 - width[i], sizes[t])
            few = np.flatnonzero(~many[item])
            k = times[of[few]]
            at = np.concatenate([places[g] for g in of[few]]) if len(few) else np.zeros(0, np.int64)
            to = np.repeat(to[few], k)
            (found, shift), _, _ = _distinct(self.owner[to], (at - before[t]) - (to - self.before[self.owner[to]]))
            cut = np.flatnonzero(np.diff(found)) + 1
            for first, shifts in zip(np.split(found, cut), np.split(shift, cut)):
                if len(shifts):
                    yield int(t), int(first[0]), shifts

    def word_for_word(self, h: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, item, token) where a short item stands as it is."""
        size = np.diff(before)
        for n, (whole, own) in self.short.items():
            s = seeds(h, "1" * n, len(MASKS) + n)
            if not len(s):
                continue
            at = np.flatnonzero(np.isin(s, whole))
            text = np.searchsorted(before, at, "right") - 1
            ok = (at + n <= before[text + 1]) & ((n >= LEAST) | (size[text] == n))
            for t, a in zip(text[ok].tolist(), at[ok].tolist()):
                for i in own[np.searchsorted(whole, s[a], "left") : np.searchsorted(whole, s[a], "right")].tolist():
                    if (h[a : a + n] == self.h[self.before[i] : self.before[i + 1]]).all():
                        yield t, i, a


def best_overlap(same: np.ndarray, need: float, least: int = 0) -> tuple[int, int, int] | None:
    """(start, end, matches) of the run with the largest sum (a match 1, a mismatch -1.5) among all runs of at least ``need``
    matches at ``MIN_RATE``, or None if there is none or none has ``least`` matches; ends at matches. Of equal sums the first end, then the shortest."""
    n = len(same)
    m = np.concatenate([[0], np.cumsum(same)])
    p = m - MIN_RATE * np.arange(n + 1)
    # a run from s to e has the rate where p[s] <= p[e]; the first such s has most matches
    first = np.searchsorted(-np.minimum.accumulate(p), -p, "left")
    if (m - m[first]).max() < need:
        return None
    if (m - m[first]).max() < least:
        return None
    # the run with the largest sum before each match starts at the last least sum
    total = 2.5 * m - 1.5 * np.arange(n + 1)
    low = np.minimum.accumulate(total)
    start = np.maximum.accumulate(np.where(total == low, np.arange(n + 1), 0))
    ends = np.flatnonzero(same) + 1
    e = int(ends[np.argmax(total[ends] - low[ends - 1])])
    out = int(start[e - 1]), e
    s, e = out
    if p[s] > p[e] or m[e] - m[s] < need:
        s, e = _best_at_rate(same, m, p, need)
    return s, e, int(m[e] - m[s])


def best_shift(h: np.ndarray, item: np.ndarray, shifts: np.ndarray, need: float) -> tuple[int, int, int] | None:
    """(matched, start, end) in ``h`` of the best overlap over all shifts: most matches, then the shortest, then the first.

    The equal tokens of a shift bound its matches, so shifts are taken by them until no other can be better."""
    n, m = len(h), len(item)
    bound, first = np.empty(len(shifts), np.int64), np.empty(len(shifts), np.int64)
    step = max(1, CELLS // m)
    for k in range(0, len(shifts), step):
        at = shifts[k : k + step, None] + np.arange(m)
        same = (at >= 0) & (at < n)
        same &= h[np.clip(at, 0, n - 1)] == item
        bound[k : k + step], first[k : k + step] = same.sum(1), same.argmax(1) + shifts[k : k + step]
    best = None
    order = np.lexsort((first, -bound))
    for k in order[bound[order] >= need].tolist():
        if best and (bound[k] < best[0] or (bound[k] == best[0] == best[2] - best[1] and first[k] >= best[1])):
            if bound[k] < best[0]:
                break
            continue
        shift = int(shifts[k])
        lo, hi = max(0, -shift), min(m, n - shift)
        run = best_overlap(h[shift + lo : shift + hi] == item[lo:hi], need, best[0] if best else 0)
        if run is not None:
            x = (run[2], shift + lo + run[0], shift + lo + run[1])
            best = max(best or x, x, key=lambda y: (y[0], y[1] - y[2], -y[1]))
    return best


def _best_at_rate(same: np.ndarray, m: np.ndarray, p: np.ndarray, need: float) -> tuple[int, int]:
    """(start, end) where the run with the largest sum lacks the rate or the matches: the least prefix sum over starts that are
    far enough before and have no larger ``p``, from a tree of minima over the ranks of ``p``."""
    total = (2.5 * m - 1.5 * np.arange(len(m))).tolist()
    rank = (np.unique(p, return_inverse=True)[1] + 1).tolist()
    size, m, at = max(rank) + 1, m.tolist(), np.flatnonzero(same).tolist()
    tree: list[tuple[float, int]] = [(np.inf, 0)] * size
    best, out, k = -np.inf, (0, 0), 0
    for e in (i + 1 for i in at):
        while k < len(at) and m[e] - m[at[k]] >= need:
            x, r = (total[at[k]], -at[k]), rank[at[k]]
            while r < size:
                tree[r] = min(tree[r], x)
                r += r & -r
            k += 1
        low, r = (np.inf, 0), rank[e]
        while r:
            low = min(low, tree[r])
            r -= r & -r
        if total[e] - low[0] > best:
            best, out = total[e] - low[0], (-low[1], e)
    return out


def _blocks(benchmark: DataFrame, text: str, item: str) -> Iterator[Broadcast]:
    """The benchmark's indices, one of each block."""
    items = benchmark.select(F.col(item).cast("long").alias("item_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total // (2 * BLOCK_TOKENS)))
    for block in range(n_blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).collect()
        own = sorted(((r[0], r[1]) for r in own), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        yield benchmark.sparkSession.sparkContext.broadcast(SeedIndex(own))


def overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """A row for each document and item that overlap: doc_id, item_id, matched, length (tokens), item_tokens, start, end (bytes)."""
    out = None
    for index in _blocks(benchmark, text, item):
        found = docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(_matcher(index), "doc_id long, item_id long, matched int, length int, item_tokens int, start long, end long")
        out = found if out is None else out.unionByName(found)
    return out


def _found(index: SeedIndex, texts: pa.Array) -> dict[tuple[int, int], tuple[int, int, int, int, int]]:
    """By row and item: (matched, length, item's tokens, start, end) of the overlap with most matches, then the shortest and first."""
    best: dict[tuple[int, int], tuple[int, int, int, int, int]] = {}
    for r0, _, data, off in text_chunks(texts):
        h, starts, ends, before = tokens(data, off)

        def put(d: int, i: int, matched: int, first: int, end: int) -> None:
            x = (matched, end - first, int(index.before[i + 1] - index.before[i]), int(starts[first] - off[d]), int(ends[end - 1] - off[d]))  # noqa: B023
            k = (r0 + d, i)  # noqa: B023
            best[k] = max(best.get(k, x), x, key=lambda y: (y[0], -y[1], -y[3]))

        for d, i, shifts in index.hits(h, before):
            item = index.h[index.before[i] : index.before[i + 1]]
            if (run := best_shift(h[before[d] : before[d + 1]], item, shifts, min(MIN_MATCHED, MIN_SHARE * len(item)))) is not None:
                put(d, i, run[0], before[d] + run[1], before[d] + run[2])
        for d, i, a in index.word_for_word(h, before):
            n = int(index.before[i + 1] - index.before[i])
            put(d, i, n, a, a + n)
    return best


def _matcher(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            best = _found(index, b.column(1))
            if best:
                rows = sorted(best)
                cols = [pa.array([best[k][c] for k in rows], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))]
                ids = [b.column(0).take(pa.array([r for r, _ in rows])), pa.array([index.ids[i] for _, i in rows], pa.int64())]
                yield pa.RecordBatch.from_arrays([*ids, *cols], ["doc_id", "item_id", "matched", "length", "item_tokens", "start", "end"])

    return run


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id") -> DataFrame:
    """``docs`` without the rows that overlap an item."""
    at = docs.columns.index(text)

    def keep(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                stays = np.ones(b.num_rows, bool)
                stays[[row for row, _ in _found(shared.value, b.column(at))]] = False
                yield b.filter(pa.array(stays))

        return run

    schema = docs.schema
    for index in _blocks(benchmark, text, item):
        docs = docs.mapInArrow(keep(index), schema)
    return docs
