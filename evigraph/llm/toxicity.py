"""Toxicity by a convolutional text classifier in numpy.

A word is the sum of hashed embeddings (itself and three prefixes); filters of several widths slide over the words, the largest
answer of each is kept (max pooling) and a logistic layer scores them. The first dimension of an embedding starts at the log odds
of its bucket in toxic documents and the filters of one word start at 1 there, the rest at random; all are trained from there. The
network is trained on ``PER_CLASS`` labelled documents of each class in the mean (all, where there are fewer), those whose hash of
doc_id is below a bound and whose text has at most ``LONGEST`` characters, so the sample has a bounded size; a quarter of them calibrates a threshold for each language, which is guessed from the words of the text. A
language with fewer than 15 documents of a class in that quarter has the threshold of all of them, and where these are fewer too,
the network's own. A score is shifted by that threshold, so 0.5 decides in every language.

Whole texts are scored. Defined results: null and empty texts are scored as texts without words; without labels of both classes
every score is 0; several labels of one document count as toxic if one is; equal rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm._text import NOT_WORD, U64, fold_case, prefix_hash, span_hash, text_chunks, words

BUCKETS = 1 << 16
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
PREFIXES = (4, 5, 6)
PER_CLASS = 2000
#: Characters of a text that may be learned from: the sample of labelled texts is in the driver's memory. Longer ones are scored whole.
LONGEST = 50_000
EPOCHS = 4
#: Words whose windows are in memory at once.
CHUNK = 1 << 19
N_OUT = sum(WIDTHS) * FILTERS


def word_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the embedding for each word, words before each text)."""
    low = fold_case(data)
    starts, ends, before = words(low, offsets, NOT_WORD)
    p = prefix_hash(low)
    cols = [span_hash(p, starts, ends)] + [span_hash(p, starts, np.minimum(ends, starts + k)) for k in PREFIXES]
    return np.stack([(c >> U64(64 - 16)).astype(np.int32) for c in cols], axis=1), before


def _padded(before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each word, first place of each text), with room for the widest filter behind each text."""
    room = max(WIDTHS)
    n = np.diff(before)
    first = before[:-1] + room * np.arange(len(n))
    return np.arange(before[-1]) + room * np.repeat(np.arange(len(n)), n), first


@dataclass
class Network:
    embed: np.ndarray
    filters: np.ndarray  # DIM x N_OUT: by width, then place in the window
    bias: np.ndarray  # one for each width and filter
    out: np.ndarray
    out_bias: float
    lang_log: np.ndarray | None = None  # BUCKETS x languages
    langs: list[str] = field(default_factory=list)
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def _pooled(self, answers: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the largest answer of each filter in each text, its place) from the answers of words to each part of a filter."""
        place, first = _padded(before)
        total = before[-1] + max(WIDTHS) * (len(before) - 1)
        full = np.zeros((total + max(WIDTHS), N_OUT), np.float32)
        full[place] = answers
        tops, at, col = [], [], 0
        ends = np.append(first[1:], total)
        # one window without a word counts in each text; those behind it would reach into the next text
        behind = (first + np.diff(before))[:, None] + np.arange(1, max(WIDTHS))
        for k, w in enumerate(WIDTHS):
            c = full[:total, col : col + FILTERS].copy()
            for o in range(1, w):
                c += full[o : total + o, col + o * FILTERS : col + (o + 1) * FILTERS]
            c += self.bias[k * FILTERS : (k + 1) * FILTERS]
            c[behind.ravel()] = -np.inf
            tops.append(np.maximum.reduceat(c, first, axis=0) if len(first) else np.zeros((0, FILTERS), np.float32))
            if self._places:
                at.append(np.stack([a + c[a:z].argmax(axis=0) for a, z in zip(first, ends)]))
            col += w * FILTERS
        return np.hstack(tops), np.hstack(at) if at else np.zeros(0)

    _places = False

    def logits(self, rows: np.ndarray, before: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
        table = self.table() if table is None else table
        answers = table[rows[:, 0]]
        for k in range(1, rows.shape[1]):
            answers = answers + table[rows[:, k]]
        tops, _ = self._pooled(answers, before)
        # by row, so that equal texts have the same sum wherever they stand
        return (np.maximum(tops, 0) * self.out).sum(axis=1) + self.out_bias

    def table(self) -> np.ndarray:
        return (self.embed @ self.filters).astype(np.float32)

    def language(self, rows: np.ndarray, before: np.ndarray) -> np.ndarray:
        n = len(before) - 1
        if self.lang_log is None or len(self.langs) < 2:
            return np.zeros(n, np.int64)
        log = np.vstack([self.lang_log[rows[:, 0]].astype(np.float64), np.zeros((1, len(self.langs)))])
        total = np.add.reduceat(log, before[:-1], axis=0) if n else np.zeros((0, len(self.langs)))
        total[np.diff(before) == 0] = 0.0
        return np.argmax(total, axis=1)

    def scores(self, rows: np.ndarray, before: np.ndarray, table: np.ndarray) -> np.ndarray:
        z = self.logits(rows, before, table) - self.threshold[self.language(rows, before)]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _batch(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    rows, befores = [], [np.zeros(1, np.int64)]
    for _, _, data, off in text_chunks(pa.array(texts, pa.string())):
        r, b = word_rows(data, off)
        befores.append(b[1:] + befores[-1][-1])
        rows.append(r)
    return np.concatenate(rows), np.concatenate(befores)


def fit(texts: list[str], toxic: np.ndarray, langs: list[str | None], weight: np.ndarray, seed: int = 3) -> Network:
    """A network from labelled texts; ``weight`` is how many documents each stands for."""
    rng = np.random.default_rng(seed)
    y = toxic.astype(np.float64)
    rows, before = _batch(texts)
    check = np.arange(len(texts)) % 4 == 3
    # how much more often a bucket stands in toxic documents starts the first dimension
    n1, n0 = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for d in np.flatnonzero(~check):
        (n1 if y[d] else n0)[np.unique(rows[before[d] : before[d + 1]])] += 1
    s1, s0 = max(1, y[~check].sum()), max(1, (1 - y[~check]).sum())
    odds = np.log((n1 / s1 + 2 / (s1 + s0)) / (n0 / s0 + 2 / (s1 + s0)))
    net = Network(
        embed=(rng.normal(0, 0.05, (BUCKETS, DIM))).astype(np.float32),
        filters=rng.normal(0, 0.2, (DIM, N_OUT)).astype(np.float32),
        bias=np.zeros(len(WIDTHS) * FILTERS, np.float32),
        out=rng.normal(0.2, 0.1, len(WIDTHS) * FILTERS).astype(np.float32),
        out_bias=-1.0,
    )
    net.embed[:, 0] = odds / rows.shape[1]
    net.filters[0, :FILTERS] = 1.0
    net._places = True
    starts = np.cumsum([0, *[w * FILTERS for w in WIDTHS]])
    grads = {k: np.zeros_like(getattr(net, k)) for k in ("embed", "filters", "bias", "out")}  # squares, for step sizes
    learn = np.flatnonzero(~check)
    # each class weighs the same while training
    cost = np.where(y > 0, 0.5 / max(1, y[learn].sum()), 0.5 / max(1, (1 - y[learn]).sum())) * len(learn)

    def step(name: str, g: np.ndarray, rate: float) -> None:
        grads[name] += g * g
        getattr(net, name)[...] -= rate * g / (np.sqrt(grads[name]) + 1e-6)

    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(learn), max(1, len(learn) // 32)):
            own = [rows[before[d] : before[d + 1]] for d in part]
            b = np.concatenate(([0], np.cumsum([len(o) for o in own])))
            r = np.concatenate(own)
            x = net.embed[r].sum(axis=1)
            place, first = _padded(b)
            tops, at = net._pooled(x @ net.filters, b)
            act = np.maximum(tops, 0)
            p = 1 / (1 + np.exp(-np.clip(act @ net.out + net.out_bias, -30, 30)))
            g = ((p - y[part]) * cost[part] / len(part)).astype(np.float32)
            g_act = g[:, None] * net.out[None, :] * (tops > 0)
            word_at = np.full(b[-1] + max(WIDTHS) * (len(b)), -1)
            word_at[place] = np.arange(len(r))
            g_filters, g_x = np.zeros_like(net.filters), np.zeros_like(x)
            for k, w in enumerate(WIDTHS):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                for o in range(w):
                    word = word_at[at[:, cols] + o]
                    ok = word >= 0
                    d, f = np.nonzero(ok)
                    ga = g_act[:, cols][d, f]
                    c = starts[k] + o * FILTERS + f
                    np.add.at(g_filters.T, c, ga[:, None] * x[word[d, f]])
                    np.add.at(g_x, word[d, f], ga[:, None] * net.filters[:, c].T)
            step("out", g @ act, 0.05)
            step("bias", g_act.sum(axis=0), 0.02)
            step("filters", g_filters, 0.03)
            net.out_bias -= 0.1 * float(g.sum())
            hit = np.flatnonzero(np.abs(g_x).sum(axis=1))
            if len(hit):
                flat, pos = np.unique(r[hit].ravel(), return_inverse=True)
                g_e = np.zeros((len(flat), DIM), np.float32)
                np.add.at(g_e, pos.ravel(), np.repeat(g_x[hit], r.shape[1], axis=0))
                grads["embed"][flat] += g_e * g_e
                net.embed[flat] -= 0.02 * g_e / (np.sqrt(grads["embed"][flat]) + 1e-6)
    net._places = False
    # the language of a text from its words
    known = sorted({v for v in langs if v is not None})
    lang = np.array([known.index(v) if v is not None else -1 for v in langs])
    if len(known) >= 2:
        counts = np.full((BUCKETS, len(known)), 0.5)
        for d in np.flatnonzero(lang >= 0):
            counts[:, lang[d]] += np.bincount(rows[before[d] : before[d + 1], 0], minlength=BUCKETS)
        net.lang_log, net.langs = np.log(counts / counts.sum(axis=0)).astype(np.float32), known
    table, z, guess = net.table(), [], []
    for a in range(0, len(texts), 64):
        b = before[a : a + 65]
        own = rows[b[0] : b[-1]]
        z.append(net.logits(own, b - b[0], table))
        guess.append(net.language(own, b - b[0]))
    z, guess = np.concatenate(z), np.concatenate(guess)
    whole = _threshold(z[check], y[check], weight[check], 0.0)
    net.threshold = np.array([_threshold(z[s], y[s], weight[s], whole) for s in (check & (guess == i) for i in range(max(1, len(net.langs))))])
    return net


def _threshold(z: np.ndarray, y: np.ndarray, weight: np.ndarray, other: float) -> float:
    """The cut with the best F1, midway between the scores beside it; ``other`` if there is too little to tell."""
    if y.sum() < 15 or (1 - y).sum() < 15:
        return other
    order = np.argsort(-z)
    tp, fp = np.cumsum((y * weight)[order]), np.cumsum(((1 - y) * weight)[order])
    f1 = 2 * tp / (tp + fp + (y * weight).sum())
    i = int(np.argmax(f1))
    return float((z[order[i]] + z[order[min(i + 1, len(z) - 1)]]) / 2)


def fold(key: str = "doc_id", by: int = 5):
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(by))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Network | None:
    """A network from labels outside the held-out fifth; None without both classes."""
    spark = docs.sparkSession
    own = labels.where(F.col("toxic").isNotNull() & (fold() != 0)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    count = {int(r[0] > 0): r[1] for r in own.groupBy((F.col("toxic") > 0).cast("int")).count().collect()}
    if len(count) < 2:
        return None
    # a hash below a bound that takes so many in the mean
    share = {k: min(1.0, per_class / n) for k, n in count.items()}
    bound = F.when(F.col("toxic") > 0, F.lit(share[1])).otherwise(F.lit(share[0]))
    taken = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < bound * (1 << 20)).select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic")).collect()
    if not taken:
        return None
    ids = F.broadcast(spark.createDataFrame([(r[0], r[1]) for r in taken], "_id long, toxic int"))
    able = docs.where(F.coalesce(F.length("text") <= LONGEST, F.lit(True)))
    rows = able.select(F.col("doc_id").cast("long").alias("_id"), "text", "lang").join(ids, "_id").select("_id", "text", "lang", "toxic").collect()
    rows = sorted({(r[0], r[1] or "", r[2] or "", r[3]) for r in rows})
    y = np.array([r[3] for r in rows])
    if not 0 < y.sum() < len(y):
        return None
    # in another order than that of the ids, which may follow the sources
    order = np.random.default_rng(1).permutation(len(rows))
    rows, y = [rows[i] for i in order], y[order]
    return fit([r[1] for r in rows], y, [r[2] or None for r in rows], np.where(y > 0, 1 / share[1], 1 / share[0]))


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((net, net.table() if net else None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = shared.value
        for b in batches:
            for r0, r1, data, off in text_chunks(b.column(1), rows=4096):
                if model is None:
                    s = np.zeros(r1 - r0)
                else:
                    rows, before = word_rows(data, off)
                    s = model.scores(rows, before, table).astype(np.float64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(r0, r1 - r0), pa.array(s)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    out = score(docs, train(docs, labels))
    return out.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
