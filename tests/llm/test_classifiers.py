"""The two classifiers against plain versions and by held-out recall, with long texts, repeated rows and clashing columns."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evigraph.llm import langid, toxicity

WORDS = [a + b for a in ("ta", "ko", "mi", "re", "su", "na", "lo", "vi") for b in ("n", "r", "st", "l", "m", "x")]


def plain_logit(net, rows):
    """The logit of one text from the rows of its words, window by window."""
    n, words = len(rows), [net.embed[r].sum(axis=0) for r in rows]
    tops, col = [], 0
    for k, w in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            answers = []
            for i in range(n + max(toxicity.WIDTHS)):
                inside = sum(float(words[i + o] @ net.filters[:, col + o * toxicity.FILTERS + f]) for o in range(w) if i + o < n)
                answers.append(inside + float(net.bias[k * toxicity.FILTERS + f]))
            tops.append(max(answers))
        col += w * toxicity.FILTERS
    return float(np.maximum(tops, 0) @ net.out + net.out_bias)


def test_network_equals_plain_windows():
    rng = np.random.default_rng(4)
    n_pooled = len(toxicity.WIDTHS) * toxicity.FILTERS
    net = toxicity.Network(
        embed=rng.normal(0, 0.5, (toxicity.BUCKETS, toxicity.DIM)).astype(np.float32), filters=rng.normal(0, 0.5, (toxicity.DIM, toxicity.N_OUT)).astype(np.float32),
        bias=rng.normal(0, 0.5, n_pooled).astype(np.float32), out=rng.normal(0, 0.5, n_pooled).astype(np.float32), out_bias=0.25,
    )
    texts = ["", "one", "one two", "A longer text, with more words than the widest filter.", " ", "one two one two one two", "é ü 漢字"]
    rows, before = toxicity._batch(texts)
    got = net.logits(rows, before)
    want = [plain_logit(net, rows[a:z]) for a, z in zip(before, before[1:])]
    assert np.allclose(got, want, atol=1e-3)
    alone = [net.logits(*toxicity._batch([t]))[0] for t in texts]
    assert np.allclose(got, alone, atol=1e-4)


@pytest.fixture(scope="module")
def marked(spark):
    rnd = random.Random(11)
    rows, labels = [], []
    for i in range(1500):
        words = [rnd.choice(WORDS) for _ in range(rnd.randint(20, 60))]
        if i % 10 == 3:
            for _ in range(2):
                words[rnd.randrange(len(words))] = rnd.choice(("vile", "foul", "grim")) + rnd.choice(("est", "ing", "", "ed", "s"))
        rows.append((i, " ".join(words), "en" if i % 2 else "fr"))
        labels.append((i, int(i % 10 == 3)))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def held_out(got, n):
    held = [i for i in range(n) if zlib.crc32(str(i).encode()) % 5 == 0]
    bad = [i for i in held if i % 10 == 3]
    recall = np.mean([got[i] for i in bad])
    alarms = np.mean([got[i] for i in held if i % 10 != 3])
    return recall, alarms


def test_toxicity_recall_and_training(marked, monkeypatch):
    rows, docs, labels = marked
    run = lambda: held_out({r["doc_id"]: r["predicted"] for r in toxicity.classify(docs, labels).collect()}, len(rows))
    recall, alarms = run()
    assert recall >= 0.9 and alarms <= 0.02
    # without training, from the start by log odds alone
    monkeypatch.setattr(toxicity, "EPOCHS", 0)
    start, _ = run()
    assert recall >= start - 0.05


def test_toxicity_of_long_and_repeated_texts(spark, marked):
    rows, docs, labels = marked
    net = toxicity.train(docs, labels)
    long = " ".join(WORDS[i % len(WORDS)] for i in range(40_000))
    extra = spark.createDataFrame([(5000, long, 1), (5001, long + " vilest foulest", 1), (5002, rows[0][1], 2), (5002, rows[0][1], 3), (None, None, 4)], "doc_id long, text string, score int")
    got = sorted(((r["doc_id"] or -1, r["score"]) for r in toxicity.score(extra, net).collect()))
    by = dict(got)
    assert len(got) == 5 and by[5000] < 0.5 <= by[5001] and got[-1][1] == got[-2][1] and 0 <= by[-1] <= 1
    # texts that are too long to be learned from change nothing, though they are labelled
    more = docs.unionByName(spark.createDataFrame([(9001, "vilest " * 20_000, "en"), (9002, "mir " * 40_000, "en")], docs.schema))
    again = toxicity.train(more, labels)
    assert np.array_equal(net.embed, again.embed) and np.array_equal(net.out, again.out)


def test_language_of_long_and_repeated_texts(spark):
    rnd = random.Random(7)
    sounds = {"en": ("th", "er", "and", "ing"), "de": ("sch", "ung", "ein", "tz"), "fr": ("eau", "tion", "é", "ou")}
    text = lambda lang, n: " ".join("".join(rnd.choice(sounds[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(n))
    rows = [(i, text(lang, 40), lang, 1) for i, lang in enumerate(list(sounds) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, held_out int")
    model = langid.train(docs)
    probes = [(5000, text("de", 60_000), "x", 0), (5001, rows[0][1], "y", 0), (5001, rows[0][1], "z", 0), (5002, "1 2 3 " * 100_000, "y", 0), (None, text("fr", 40), None, None)]
    got = langid.annotate(spark.createDataFrame(probes, docs.schema), model).orderBy("doc_id", "lang").collect()
    assert [r["lang_pred"] for r in got] == ["fr", "de", "en", "en", "und"] and got[2]["score"] == got[3]["score"] and [r["lang"] for r in got] == [None, "x", "y", "z", "y"]
    # each text alone has the prediction that it has in a batch
    for i, t, *_ in rows[:12]:
        data, off = next((d, o) for _, _, d, o in langid.text_chunks(pa.array([t]), rows=8))
        alone = langid.features(data, off)
        lang, p = model.predict(alone)
        both = langid.annotate(docs.where(F.col("doc_id") == i), model).first()
        assert (both["lang_pred"], round(both["score"], 5)) == (lang[0], round(float(p[0]), 5))


@pytest.mark.parametrize("empty", [True, False])
def test_language_without_labels(spark, empty):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    got = langid.identify(docs.limit(0) if empty else docs).collect()
    assert [r["lang_pred"] for r in got] == ([] if empty else ["und"])
