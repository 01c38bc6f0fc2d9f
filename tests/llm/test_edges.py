"""Proofs and brute force for the seeds, and the cases that once lost rows or crashed: null and repeated ids, clashing columns,
cycles, very long runs and chains, empty tables."""

import random
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm import DOCS, brute_links, brute_overlap, make, prose

from evigraph.llm import chat, decontaminate, fingerprints, ngram_join, secret_scan
from evigraph.llm._spark import stored
from evigraph.llm._tokens import Encoder


def test_no_overlap_that_counts_avoids_all_masks():
    masks, width = [int(m, 2) for m in decontaminate.MASKS], max(map(len, decontaminate.MASKS))
    most = {0: 0}  # last tokens -> matches, over all runs without a hit
    for n in range(1, 100):
        after = {}
        for last, matches in most.items():
            for bit in (0, 1):
                now = (last << 1 | bit) & ((1 << width) - 1)
                if all(now & m != m for m in masks):
                    after[now] = max(after.get(now, 0), matches + bit)
        most = after
        best = max(most.values())
        for item in (n, max(n, 13)):
            counts = best >= min(decontaminate.MIN_MATCHED, decontaminate.MIN_SHARE * item) and best >= decontaminate.MIN_RATE * n
            assert n < decontaminate.SHORT or not counts, (n, best)


def test_decontamination_like_brute_force(spark):
    rnd = random.Random(21)
    items = [prose(rnd, n).split() for n in (8, 9, 10, 12, 13, 14, 17, 20, 37, 60)]
    texts = []
    for i in range(300):
        w = list(rnd.choice(items))
        rate = rnd.choice((0.05, 0.15, 0.2, 0.25, 0.3))
        w = ["new" + str(rnd.randrange(10**6)) if rnd.random() < rate else x for x in w]
        texts.append(prose(rnd, rnd.randrange(6)).split() + w[rnd.randrange(3) :] + prose(rnd, rnd.randrange(6)).split())
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(make(spark, [" ".join(w) for w in texts]), bench).collect()}
    want = set()
    for d, t in enumerate(texts):
        for i, w in enumerate(items):
            for shift in range(-len(w), len(t)):
                same = [t[shift + k] == w[k] for k in range(len(w)) if 0 <= shift + k < len(t)]
                if sum(same) > 4 and brute_overlap(same, min(10, 0.8 * len(w))):
                    want.add((d, i))
    assert got == want and len(want) > 100


def test_short_items_are_found_word_for_word(spark):
    items = ["one two three four five six seven", "alpha beta gamma delta epsilon", "yes", "the of"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = ["x One two, three four five six SEVEN y", "one two three four five six eight", "alpha beta gamma delta epsilon", "yes", "yes it is the of", "The of", None]
    got = sorted((r["doc_id"], r["item_id"], r["matched"]) for r in decontaminate.overlaps(make(spark, texts), bench).collect())
    assert got == [(0, 0, 7), (2, 1, 5), (3, 2, 1), (5, 3, 2)]


def test_decontamination_judges_rows(spark):
    rnd = random.Random(22)
    item = prose(rnd, 20)
    bench = spark.createDataFrame([(1, item), (1, item), (None, prose(rnd, 20))], "item_id long, text string")
    docs = make(spark, [item, item, prose(rnd, 30), item, prose(rnd, 30), prose(rnd, 30)], [5, 5, 5, None, None, 7]).withColumn("_bad", F.lit(1)).withColumn("Drop", F.lit(2))
    for parts in (1, 3):
        own = docs.repartition(parts)
        assert sorted((r["doc_id"] is None, r["item_id"]) for r in decontaminate.overlaps(own, bench).collect()) == [(False, 1)] * 4 + [(True, 1)] * 2
        kept = decontaminate.clean(own, bench)
        assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["5", "7", "None"]
    assert decontaminate.clean(docs, bench.limit(0)).count() == 6 and decontaminate.clean(docs.limit(0), bench).count() == 0
    many = decontaminate.SeedIndex([(0, "the " * 400)])
    h, _, _, before = decontaminate.tokens(np.frombuffer(b"the " * 6000, np.uint8), np.array([0, 24000]))
    ((text, item, shifts),) = many.hits(h, before)
    assert (text, item, len(shifts)) == (0, 0, 6000 + 400 - 1)


def test_decontamination_of_repetitive_texts(spark):
    """Texts of few different words have an equal seed on every shift; the work stays in proportion to tokens times items."""
    rnd = random.Random(24)
    items = ["w " * 400] * 20
    began = time.time()
    found = decontaminate._found(decontaminate.SeedIndex(list(enumerate(items))), pa.array(["w " * 20_000]))
    assert time.time() - began < 10
    assert found == {(0, i): (400, 400, 400, 0, 799) for i in range(20)}
    items = [" ".join(rnd.choice("ab") for _ in range(n)) for n in (8, 12, 20)]
    texts = [" ".join(rnd.choice("ab") for _ in range(60)) for _ in range(30)] + ["a b " * 30, "a " * 9]
    found = decontaminate._found(decontaminate.SeedIndex(list(enumerate(items))), pa.array(texts))
    for d, t in enumerate(texts):
        for i, w in enumerate(items):
            t_, w_, most = t.split(), w.split(), None
            for shift in range(1 - len(w_), len(t_)):
                lo, hi = max(0, -shift), min(len(w_), len(t_) - shift)
                run = brute_overlap([t_[shift + k] == w_[k] for k in range(lo, hi)], min(10, 0.8 * len(w_)))
                if run:
                    x = (run[2], run[0] - run[1], -(shift + lo + run[0]))
                    most = max(most or x, x)
            got = found.get((d, i))
            assert (most and (most[0], -most[1], -most[2] * 2)) == (got and (got[0], got[1], got[3]))


def test_extra_columns_of_any_name(spark):
    rnd = random.Random(23)
    text = prose(rnd, 30)
    names = ["_drop", "drop", "_key", "key", "_rules", "RULES", "_spans", "spans", "_bad", "cid", "score"]
    docs = make(spark, [text, text + " token=abcdef123", prose(rnd, 30), None]).select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    kept, marked = ngram_join.keep_first(docs), secret_scan.redact(docs)
    assert kept.columns == marked.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3]
    rows = {r["doc_id"]: r for r in marked.collect()}
    assert rows[1]["text"].endswith("[secret]") and rows[0]["text"] == text and all(r["_spans"] == 6 and r["spans"] == 7 for r in rows.values())


def test_ngram_join_with_a_hub_and_copies(spark, monkeypatch):
    """Copies of an original that link with it and not with each other, copies of one text, a passage with little else around it."""
    monkeypatch.setattr(ngram_join, "PART", 8)
    monkeypatch.setattr(ngram_join, "CROWD", 3)
    rnd = random.Random(24)
    base, passage = prose(rnd, 120).split(), prose(rnd, 40)
    texts = [" ".join(base)]
    for _ in range(60):
        w = list(base)
        for _ in range(rnd.randint(1, 6)):
            w[rnd.randrange(120)] = rnd.choice(WORD) + str(rnd.randrange(99))
        texts.append(" ".join(w))
    texts += [texts[0]] * 200 + [passage + " " + prose(rnd, rnd.randint(0, 20)) for _ in range(60)] + [prose(rnd, 3)] * 3
    rnd.shuffle(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.components(make(spark, texts).repartition(5)).collect()}
    assert got == brute_links(list(enumerate(texts)))


WORD = ["zan", "kor", "mul"]


def test_very_long_runs_are_tokenized():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    for text in (" " * 300_000, "\n" * 200_000 + "a"):
        want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
        assert np.frombuffer(Encoder.at(path).encode(text), "<u4").tolist() == want


def test_likeness_from_the_digests_alone(monkeypatch):
    """In plain Python, from the hexadecimal digests; in blocks or whole."""
    rnd = random.Random(25)
    texts = [prose(rnd, n) for n in (3, 40, 400, 9000)]
    texts += [texts[2][:1500] + texts[3][:1500], ""]

    def chain(d):
        s, size = d.text(), 4 + fingerprints.BITS // 4
        return [(int(s[i : i + 4], 16), int(s[i + 4 : i + size], 16)) for i in range(0, len(s), size)]

    def like(x, y):
        x, y = sorted((x, y), key=lambda d: (len(chain(d)), d.text() if len(chain(x)) == len(chain(y)) else ""))
        x, y = chain(x), chain(y)
        if not x:
            return float(not y)
        out = 0.0
        for n, a in x:
            best = 0.0
            for _, b in y:
                chance = a.bit_count() * b.bit_count() / fingerprints.BITS
                most = min(a.bit_count(), b.bit_count())
                best = max(best, min(1.0, ((a & b).bit_count() - chance) / max(most - chance, 1e-9)))
            out += n * best
        return out / sum(n for n, _ in x)

    digests = [fingerprints.digest(t) for t in texts]
    for block in (512, 1, 3):
        monkeypatch.setattr(fingerprints, "BLOCK", block)
        for a in digests:
            for b in digests:
                assert a.likeness(b) == pytest.approx(like(a, b), abs=1e-5)


def test_fingerprints_of_extreme_ids(spark):
    ids = [-(2**63), 2**63 - 1, 0]
    got = {r["doc_id"]: r["near_next"] for r in fingerprints.with_next(make(spark, ["a b c d e f", "a b c d e f", "zzz"], ids)).collect()}
    assert set(got) == set(ids) and got[-(2**63)] == 1.0


def test_reply_trees_with_cycles(spark):
    nodes = [(1, 1, 1, "user", "own parent", 0.0), (2, 1, None, "user", "q", 0.0), (2, 2, 1, "assistant", "a", 1.0), (2, 3, 4, "user", "c", 0.0), (2, 4, 3, "user", "d", 0.0), (2, 5, 4, "user", "e", 0.0), (3, 1, 9, "user", "no parent", 0.0)]
    tree = spark.createDataFrame(nodes, "conv_id long, node long, parent long, role string, text string, score double")
    got = {(r["conv_id"], r["leaf"]): [t for _, t in chat.read_back(r["formatted"])] for r in chat.format_paths(tree).collect()}
    assert got == {(2, 2): ["q", "a"], (3, 1): ["no parent"]}


def test_pipeline_of_empty_and_repeated_rows(spark):
    import corpus_pipeline

    rnd = random.Random(26)
    text = prose(rnd, 60)
    some = make(spark, [text, text, prose(rnd, 60), None, ""], [1, 1, None, 4, 5]).withColumn("score", F.lit(7))
    for docs, left in ((some, [1, 1, None]), (some.limit(0), [])):
        for name, stage in corpus_pipeline.STAGES[:4]:
            docs = stored(stage(spark, docs, "/root/testdata/sf0.001"))
            assert docs.columns == [*[c.split()[0] for c in DOCS.split(", ")], "score"], name
        assert sorted((r["doc_id"] for r in docs.collect()), key=str) == left and {r["score"] for r in docs.collect()} <= {7}
        assert stored(corpus_pipeline.STAGES[4][1](spark, docs, "/root/testdata/sf0.001")).count() == len(left)


def test_fingerprints_of_many_rows_without_an_id(spark):
    rnd = random.Random(25)
    texts = [prose(rnd, 5) for _ in range(1200)]
    got = fingerprints.with_next(make(spark, texts, [None] * 1200).coalesce(1)).collect()
    assert len(got) == 1200 and all(r["doc_id"] is None for r in got)
