"""Language identification by hierarchical discrimination.

A linear support vector machine for each pair of language families decides the family; one-versus-one machines then separate
the languages within it. Features are hashed byte n-grams of the case-folded text (square roots of counts, unit length), so
every byte of a text counts. The machines are trained with dual coordinate descent in numpy on a bounded sample: ``per_lang``
labelled documents of each language in the mean (all, where there are fewer), those whose hash of doc_id is below a bound.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text if there is nothing to learn
from. Repeated rows get equal answers and count once in training. ``annotate`` keeps extra columns and replaces those with the
names it gives, lang_pred and score unless others are named.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm._text import NOT_WORD, U64, fold_case, text_chunks

DIM = 1 << 12
PER_LANG = 400
#: Values of the hash that the sample's bound is laid on.
SPAN = 1 << 30
#: Texts whose features are in memory at once.
ROWS = 256
UNKNOWN = "und"
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "af"),
    "romance": ("fr", "es", "it", "pt", "ca", "ro", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr"),
}


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), lang)


def features(data: np.ndarray, offsets: np.ndarray, dim: int = DIM) -> np.ndarray:
    """A row of unit length for each text: its bigrams and trigrams of bytes, hashed; all but letters is one space."""
    n = len(offsets) - 1
    low = fold_case(data)
    low[NOT_WORD[low] | ((low >= 48) & (low <= 57))] = 32
    # a space before each text and after the last keeps grams within texts
    at = offsets[:-1] + np.arange(n)
    body = np.full(len(low) + n + 1, 32, dtype=np.uint8)
    keep = np.ones(len(body), bool)
    keep[at] = keep[-1] = False
    body[keep] = low
    owner = np.repeat(np.arange(n), np.diff(offsets) + 1)
    x = body.astype(np.uint32)
    two = (x[:-1] * np.uint32(0x9E3779B1)) ^ (x[1:] * np.uint32(0x85EBCA6B))
    out = np.zeros(n * dim, dtype=np.float32)
    for gram, who in ((two, owner), (two[:-1] ^ (x[2:] * np.uint32(0xC2B2AE35)), owner[: len(two) - 1])):
        cell = ((gram * np.uint32(0x27D4EB2F)) >> np.uint32(20)) & np.uint32(dim - 1)
        out += np.bincount(who * dim + cell[: len(who)], minlength=n * dim).astype(np.float32)
    rows = np.sqrt(out.reshape(n, dim))
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
    return rows


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ascii_letter = np.zeros(256, bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True
    total = np.concatenate(([0], np.cumsum(ascii_letter[data])))
    out = np.diff(total[offsets]) > 0
    for i in np.flatnonzero(~out):
        part = data[offsets[i] : offsets[i + 1]]
        if (part > 127).any():
            out[i] = any(c.isalpha() for c in part.tobytes().decode("utf-8", "replace"))
    return out


def train_svm(x: np.ndarray, y: np.ndarray, use: np.ndarray | None = None, c: float = 10.0, epochs: int = 30, seed: int = 7) -> np.ndarray:
    """Weights, bias last, of a linear machine with squared hinge loss; y is -1 or 1. Dual coordinate descent over the rows ``use``."""
    use = np.arange(len(x)) if use is None else use
    y = y[use].astype(np.float64)
    alpha, w, bias = np.zeros(len(use)), np.zeros(x.shape[1]), 0.0
    # the rarer side weighs as much as the other
    cost = np.where(y > 0, c * len(y) / (2 * max(1, (y > 0).sum())), c * len(y) / (2 * max(1, (y < 0).sum())))
    diag = 1 / (2 * cost)
    q = np.array([float(x[i] @ x[i]) for i in use]) + 1 + diag
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(use)):
            row = x[use[i]]
            g = y[i] * (w @ row + bias) - 1 + diag[i] * alpha[i]
            new = max(0.0, alpha[i] - g / q[i])
            if new != alpha[i]:
                most = max(most, abs(new - alpha[i]))
                step = (new - alpha[i]) * y[i]
                w += step * row
                bias += step
                alpha[i] = new
        if most < 1e-3:
            break
    return np.append(w, bias).astype(np.float32)


@dataclass
class Model:
    """pairs: (a, b, weights), a decision above 0 is for a; by name "" the families, else the languages of a family."""

    members: dict[str, list[str]] = field(default_factory=dict)
    pairs: dict[str, list[tuple[int, int, np.ndarray]]] = field(default_factory=dict)

    def _choose(self, name: str, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the member with most wins, the mean of its win probabilities)."""
        n = len(self.members[name])
        wins, prob = np.zeros((len(x), n)), np.zeros((len(x), n))
        for a, b, w in self.pairs[name]:
            p = 1 / (1 + np.exp(-2.0 * np.clip(x @ w[:-1] + w[-1], -30, 30)))
            wins[:, a] += p > 0.5
            wins[:, b] += p <= 0.5
            prob[:, a] += p
            prob[:, b] += 1 - p
        prob = prob / max(1, n - 1) if n > 1 else np.ones_like(prob)
        best = np.argmax(wins + prob * 1e-3, axis=1)
        return best, prob[np.arange(len(x)), best]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lang, score = np.full(len(x), UNKNOWN, dtype=object), np.zeros(len(x))
        if not self.members:
            return lang, score
        fam, p = self._choose("", x)
        for i, f in enumerate(self.members[""]):
            rows = np.flatnonzero(fam == i)
            if len(rows):
                k, q = self._choose(f, x[rows])
                lang[rows] = np.array(self.members[f], dtype=object)[k]
                score[rows] = p[rows] * q
        return lang, score


def fit(x: np.ndarray, langs: list[str]) -> Model:
    model, langs = Model(), np.array(langs, dtype=object)
    if not len(langs):
        return model
    fams = np.array([family_of(v) for v in langs], dtype=object)
    groups = {"": (sorted(set(fams)), fams)} | {f: (sorted(set(langs[fams == f])), langs) for f in sorted(set(fams))}
    for name, (members, of) in groups.items():
        model.members[name] = members
        model.pairs[name] = []
        for (i, a), (j, b) in combinations(enumerate(members), 2):
            model.pairs[name].append((i, j, train_svm(x, np.where(of == a, 1.0, -1.0), np.flatnonzero((of == a) | (of == b)))))
    return model


def fold(key: str = "doc_id", by: int = 3):
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(by))


def train(docs: DataFrame, per_lang: int = PER_LANG, key: str = "doc_id", held: int = 1) -> Model:
    """A model from ``per_lang`` documents of each language with a label, in the mean, outside the held-out third."""
    able = docs.select(F.col(key).cast("long").alias("k"), "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(key) != held))
    share = {r[0]: min(1.0, per_lang / r[1]) for r in able.groupBy("lang").count().collect()}
    if not share:
        return Model()
    bound = F.create_map(*[F.lit(v) for lang, part in share.items() for v in (lang, int(part * SPAN))])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r0, r1, data, off in text_chunks(b.column(2), rows=ROWS):
                x = features(data, off).astype(np.float16)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(r0, r1 - r0), b.column(1).slice(r0, r1 - r0), pa.array([v.tobytes() for v in x], pa.binary())], ["k", "lang", "x"])

    sample = able.where(F.pmod(F.xxhash64("k"), F.lit(SPAN)) < F.element_at(bound, F.col("lang"))).mapInArrow(vectors, "k long, lang string, x binary")
    rows = sample.distinct().toArrow().sort_by([("k", "ascending"), ("lang", "ascending"), ("x", "ascending")])
    if not rows.num_rows:
        return Model()
    x = np.empty((rows.num_rows, DIM), np.float32)
    for i, v in enumerate(rows["x"]):
        x[i] = np.frombuffer(v.as_buffer(), np.float16)
    return fit(x, rows["lang"].to_pylist())


def annotate(docs: DataFrame, model: Model, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the language as string and its score as double."""
    base = docs.drop(lang_pred, score)
    names, schema = base.columns, base.schema
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = [], []
            for _, _, data, off in text_chunks(b.column(at), rows=ROWS):
                lang, p = model.predict(features(data, off))
                none = ~has_letter(data, off)
                lang[none], p[none] = UNKNOWN, 0.0
                langs.append(lang)
                scores.append(p)
            cat = lambda v, t: pa.array(np.concatenate(v) if v else [], t)
            yield pa.RecordBatch.from_arrays([*b.columns, cat(langs, pa.string()), cat(scores, pa.float64())], [*names, lang_pred, score])

    from pyspark.sql import types as T

    return base.mapInArrow(run, T.StructType([*schema.fields, T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType())]))


def identify(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score; learned from the other two thirds."""
    out = annotate(docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "lang_pred", F.col("score").cast("double"))
