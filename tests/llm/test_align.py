"""Alignment of two tokenizers against whole texts tokenized at once."""

import random
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from evigraph.llm import align
from evigraph.llm._tokens import _byte_of

BITS = ["a", "b", " ", "  ", "\n", "\n\n", "\t", "\r", "\r\n", "\xa0", "　", "▁", "é", "à", "'s", "<|endoftext|>", "</s>", "<s>", "word", "the", " ", "\x0b", "\x1f", "12", "🙂", ";", "{", "�"]


def brute(rows):
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second, of = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), _byte_of()
    found, held = [], Counter()
    for _, text in rows:
        found.append(None)
        if not text:
            continue
        whole = first.encode(" " + text, add_special_tokens=False)
        a, a_bytes = whole.ids, [bytes(of[c] for c in t) for t in whole.tokens]
        b = second.encode(text)
        b_bytes = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, map(second.id_to_piece, b))]
        if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            continue
        spans = [[(sum(map(len, x[:k])), sum(map(len, x[: k + 1]))) for k in range(len(x))] for x in (a_bytes, b_bytes)] if len(text) < 300 else None
        ends = [np.cumsum([len(t) for t in x]).tolist() for x in (a_bytes, b_bytes)]
        if spans:
            links = [(x, y) for x, (s, e) in zip(a, spans[0]) for y, (s2, e2) in zip(b, spans[1]) if max(s, s2) < min(e, e2)]
        else:
            both = sorted(set(ends[0]) | set(ends[1]))
            links = [(a[i], b[j]) for i, j in zip(np.searchsorted(ends[0], both), np.searchsorted(ends[1], both))]
        groups, i, j = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            i2, j2 = ends[0].index(end) + 1, ends[1].index(end) + 1
            groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
            i, j = i2, j2
        held.update(set(links))
        found[-1] = (a, b, groups, links)
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    out = []
    for (doc, _), f in zip(rows, found):
        if f is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = f
        best, count = sum(held[x] == top[x[0]] for x in links), sum(held[x] for x in links)
        out.append((doc, len(a), len(b), len(groups), len(links), best, count, sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1 << 20, 3000])
def test_alignment_like_whole_texts(spark, monkeypatch, block):
    monkeypatch.setattr(align, "BLOCK_BYTES", block)
    monkeypatch.setattr(align, "BUCKET_BYTES", block)
    rnd = random.Random(1)
    rows = [(i, "".join(rnd.choice(BITS) for _ in range(rnd.randrange(40)))) for i in range(600)]
    rows += [(None, None), (None, "ab cd"), (7, "the the"), (7, "the the"), (8, " "), (9, "x" * 5000), (10, " " * 3000 + "y"), (11, "a\n" * 1000), (12, "<|endoftext|> </s>")]
    got = align.align(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_groups_tables_and_columns(spark):
    docs = spark.createDataFrame([(1, "unbelievable things", 3, "x")], "doc_id long, text string, block long, segs string")
    (row,) = align.align(docs, keep_groups=True).collect()
    assert sha256(row["groups"].encode()).hexdigest() == row["groups_sha256"] and row["groups"].count("|") == row["n_groups"]
    assert align.align(docs.limit(0)).collect() == []
    (row,) = align.align(docs.selectExpr("doc_id", "CAST(null AS STRING) AS text")).collect()
    assert tuple(row) == (1, 0, 0, 0, 0, 0, 0, "")


def test_safe_cuts():
    assert align.safe_cuts([b"a", b" a", b"  ", b"\n\n"]) == "\t\n\x0b\x0c\r "
    assert "\r" not in align.safe_cuts([b";\r"]) and "\n" not in align.safe_cuts([b" \n"]) and " " not in align.safe_cuts([b"of the"])
    assert " " in align.safe_cuts(["\xa0 ".encode()])


def test_arrays_come_back():
    arrays = [np.array([], np.int64), np.array([0, 1, 255, 256, 70_000, (1 << 32) - 1])]
    assert [x.tolist() for x in align.unpack(align.pack(*arrays))] == [x.tolist() for x in arrays]
