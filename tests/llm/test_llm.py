"""The training-data operators against brute force, with nulls, empty texts, ties, repeated rows, extra columns and empty tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evigraph.llm import chat, decontaminate, fingerprints, langid, ngram_join, packing, repeats, secret_scan, toxicity, warc_store
from evigraph.llm._text import shingle_sets, text_chunks
from evigraph.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ta", "ko", "mi", "re", "su", "na", "lo", "vi") for b in ("n", "r", "st", "l", "m", "x")]


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def make(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def collected(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


@pytest.fixture(scope="module")
def near_texts():
    rnd = random.Random(5)
    passage = prose(rnd, 40)
    out = [None, "", " \t", "One", "one", "a b c", "A  b\nc", passage]
    for _ in range(12):
        base = prose(rnd, rnd.randint(6, 120)).split()
        out.append(" ".join(base))
        for edits in (0, 1, 2, 4, 8):
            w = list(base)
            for _ in range(min(edits, len(w) // 6)):
                w[rnd.randrange(len(w))] = "ZZ" + rnd.choice(WORDS)
            out.append(" ".join(w).upper() if edits == 1 else " ".join(w))
    for _ in range(30):
        out.append(prose(rnd, rnd.randint(5, 30)) + " " + passage)
    return out


# 6


def brute_links(rows):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in sets}


def test_ngram_join(spark, near_texts):
    docs = make(spark, near_texts).withColumn("cid", F.lit(1)).withColumn("tok", F.lit("x"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.components(docs).collect()}
    want = brute_links(list(enumerate(near_texts)))
    assert got == want and len({c for _, c in want.values()}) < len(want) - 10
    kept = {r["doc_id"] for r in ngram_join.keep_first(docs).collect()}
    assert kept == {d for d, (_, c) in want.items() if c == d}


def test_ngram_join_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PART", 4)
    monkeypatch.setattr(ngram_join, "CROWD", 1)
    rnd = random.Random(9)
    base = prose(rnd, 60).split()
    texts = []
    for _ in range(80):
        w = list(base)
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(60)] = rnd.choice(WORDS) + "q"
        texts.append(" ".join(w))
    texts += [prose(rnd, 20) for _ in range(20)] + [None]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.components(make(spark, texts)).collect()}
    assert got == brute_links(list(enumerate(texts)))


def test_ngram_join_edges(spark):
    assert ngram_join.components(make(spark, [])).count() == 0
    rows = ngram_join.components(make(spark, ["a b c d e f", "a b c d e f", "x"], [None, 3, 3])).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None) == [(3, 1, 3), (3, 2, 3)]
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None]


def test_components(spark):
    rnd = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(100 + rnd.randrange(30), 100 + rnd.randrange(30)) for _ in range(25)]
    got = {r["node"]: r["comp"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[a] == got[b] for a, b in links if a != b) and {got[i] for i in range(41)} == {0}


# 9


def brute_repeats(rows):
    first = {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            f = first[b[i : i + 50]]
            if f is not None and (d is None or f < d):
                gone[i : i + 50] = b"\1" * 50
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_repeats(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(repeats, "RUN", 50)
    rnd = random.Random(4)
    passage = prose(rnd, 30)
    texts = [None, "", "x" * 49, "x" * 50, "x" * 200, "ab" * 60]
    for _ in range(40):
        t = prose(rnd, rnd.randint(3, 60))
        k = rnd.randint(20, len(passage))
        texts += [t + passage[:k] + "é" * rnd.randint(0, 30) + t, t[: len(t) // 2] + passage[-k:]]
    texts += [texts[8], texts[8]]
    ids = [None, *rnd.sample(range(1000), len(texts) - 1)]
    ids[-1] = ids[-2]
    got = sorted((tuple(r) for r in repeats.remove_repeats(make(spark, texts, ids).withColumn("block", F.lit(0))).collect()), key=str)
    assert got == brute_repeats(list(zip(ids, texts)))
    assert repeats.remove_repeats(make(spark, [])).count() == 0


# 10


def brute_secrets(text):
    text, base = text or "", []
    for kind, p, ok in (
        ("assign", r"""(?ia:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ):
        base += [(m.start(), k, m.end()) for k in [("assign", "access", "hex").index(kind)] for m in re.finditer(p, text) if ok(m)]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(base))


SECRETS = [
    None, "", "nothing", "PassWord = 'abcdef12'", "token: token: abcdefg", "token=abc secret:abcdef", "é🙂 api_key=" + "Zz9_-" * 4, "AKIA" + "Q" * 15, "AKIA" + "Q" * 16 + "AKIA" + "1" * 30,
    "x" + "0123456789abcdef" * 3 + "g" + "f" * 23, "tokentoken=abcdefgh token = xyzxyz", "ghp_" + "aZ" * 18, "-----BEGIN RSA PRIVATE KEY-----", "secret=" + "ab" * 20 + " passwd:123456",
]


def test_secret_scan(spark):
    got = {r["doc_id"]: r for r in secret_scan.scan(make(spark, SECRETS).withColumn("_rules", F.lit(1))).collect()}
    for i, t in enumerate(SECRETS):
        want = brute_secrets(t)
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), t
        assert set(filter(None, want.split(","))) <= set(got[i]["spans"].split(","))
    assert got[11]["spans"].endswith("github:0:40") and got[12]["spans"] == "private_key:0:31"
    red = {r["doc_id"]: r["text"] for r in secret_scan.redact(make(spark, SECRETS)).collect()}
    assert red[2] == "nothing" and red[3] == "[secret]'" and red[0] is None and "abab" not in red[13]
    assert secret_scan.scan(make(spark, [])).count() == 0
    same = secret_scan.scan(make(spark, ["token=abcdef", "x"], [None, None])).collect()
    assert sorted(r["n_assign"] for r in same) == [0, 1]


def test_trigram_queries_hold_for_every_match():
    for rule in secret_scan.RULES:
        clauses = secret_scan.trigram_query(rule.pattern)
        for t in filter(None, SECRETS):
            for m in re.finditer(rule.pattern, t):
                low = m[0].lower()
                assert any(all(g in low for g in c) for c in clauses)
    assert secret_scan.trigram_query("[0-9a-f]{24,}") == [frozenset()]


# 2


def test_trigram_query_of_repeated_sets():
    for pattern, texts in (("[xy]{2}tok", ("xxtok", "xytok", "yxtok", "yytok")), ("(ab|c){1,2}key", ("abkey", "cabkey", "abckey", "cckey")), ("[a-h]{2}tok", ("ahtok",))):
        clauses = secret_scan.trigram_query(pattern)
        for t in texts:
            assert re.fullmatch(pattern, t) and any(all(g in t for g in c) for c in clauses), (pattern, t)


def test_decontamination(spark):
    rnd = random.Random(7)
    items = [prose(rnd, 30), prose(rnd, 20), "too short item", None]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    w = items[0].split()
    for i in (4, 11, 18, 25):
        w[i] = "SUBST"
    texts = [prose(rnd, 300), prose(rnd, 50) + ", " + items[0].upper().replace(" ", ", ") + " " + prose(rnd, 50), " ".join(w), " ".join(items[1].split()[:12]), None, "", " ".join(items[0].split()[:5])]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(make(spark, texts), bench).collect()}
    assert got == {(1, 0), (2, 0), (3, 1)}
    assert {r["doc_id"] for r in decontaminate.clean(make(spark, texts), bench).collect()} == {0, 4, 5, 6}
    assert decontaminate.overlaps(make(spark, texts), bench.limit(0)).count() == 0
    assert decontaminate.overlaps(make(spark, []), bench).count() == 0


def brute_overlap(same, need):
    found = [
        (m - 1.5 * (e - s - m), -e, s, m)
        for s in range(len(same)) if same[s]
        for e in range(s + 1, len(same) + 1) if same[e - 1] and (m := sum(same[s:e])) >= need and 4 * m >= 3 * (e - s)
    ]
    return (lambda x: (x[2], -x[1], x[3]))(max(found)) if found else None


def test_best_overlap_is_that_of_all_runs():
    rnd = random.Random(11)
    for k in range(1500):
        same = [rnd.random() > (0.1, 0.2, 0.25, 0.3, 0.4, 0.6)[k % 6] for _ in range(rnd.choice((0, 1, 8, 13, 30, 60)))]
        need = rnd.choice((10, 6.4, 8.8))
        assert decontaminate.best_overlap(np.array(same, bool), need) == brute_overlap(same, need)


def test_decontamination_over_edited_stretches(spark):
    rnd = random.Random(8)
    w = prose(rnd, 46).split()
    bench = spark.createDataFrame([(0, " ".join(w))], "item_id long, text string")
    for i in range(10, 46, 6):
        w[i], w[i + 1] = "SUBST", "SUBST"
    got = decontaminate.overlaps(make(spark, [" ".join(w), " ".join(w[:10])]), bench).collect()
    assert {r["doc_id"] for r in got} == {0, 1} and all(4 * r["matched"] >= 3 * r["length"] for r in got)


# 3


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(3)
    texts = [None, "", "it's  \n\n ünï “x” 漢字 <|endoftext|> \x1c y"] + [prose(rnd, rnd.choice((3, 50, 400, 2000))) for _ in range(60)]
    docs = make(spark, texts + texts[-3:], [*range(len(texts)), 500, 500, None])
    packed = packing.pack(docs, keep_ids=True)
    rows = packed.collect()
    by_seq = collections.defaultdict(list)
    for r in rows:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(by_seq) == list(range(len(by_seq)))
    for parts in by_seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
    for i, t in enumerate(texts):
        own = sorted((r["start"], r["ids"]) for r in rows if r["doc_id"] == i)
        ids = np.frombuffer(b"".join(x for _, x in own), "<u4").tolist()
        assert ids == [*tok.encode(t or "", add_special_tokens=False).ids, 0]
    total = sum(r["length"] for r in rows)
    assert len(by_seq) <= total / 1024 * 1.3 + 1
    seqs = packing.sequences(packed).collect()
    assert sum(r["n_tokens"] for r in seqs) == total and all(len(r["ids"]) in (1024, r["n_tokens"]) for r in seqs)
    assert packing.pack(make(spark, [])).count() == 0


def test_best_fit_plan():
    import bisect

    rnd = random.Random(1)
    for _ in range(20):
        lens = [rnd.choice((1, 5, rnd.randint(1, 100), 100, 60)) for _ in range(300)]
        rooms, n = [], 0
        for x in sorted(lens, reverse=True):
            i = bisect.bisect_left(rooms, x)
            if i == len(rooms):
                left, n = 100, n + 1
            else:
                left = rooms.pop(i)
            if left - x:
                bisect.insort(rooms, left - x)
        runs, m = packing.plan(collections.Counter(lens), 100)
        assert m == n and sum(1 for _ in runs) >= len(set(lens))


# 4


def test_warc_store(spark):
    big = "<p>" + "x" * 1000
    rows = [(1, "http://a", big), (9, "http://b", big), (4, None, big), (5, "u", None), (6, "u", ""), (7, "u\r\nX: y", "é\r\n\r\n" * 300), (8, "v", "small"), (8, "v", "small"), (None, "w", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha256", F.lit(""))
    got = collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc_store.archive(pages).collect())
    want = collections.Counter()
    for p, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 1000 and h == big and p != 9
        want[(p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", 9 if again else None)] += 1
    assert got == want
    assert warc_store.archive(pages.limit(0)).count() == 0


def test_warc_records_come_back(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "é" * 700), (2, "http://b", "é" * 700)], "page_id long, url string, html string")
    warc_store.write_archive(pages, f"file://{tmp_path}/w")
    assert spark.read.parquet(f"file://{tmp_path}/w/payloads").count() == 1
    full = [bytes(r["record"]) for r in warc_store.reconstruct(spark, f"file://{tmp_path}/w", full=True).collect()]
    assert all(r.endswith(("é" * 700).encode() + b"\r\n\r\n") for r in full) and any(b"WARC-Refers-To: <urn:page:2>" in r for r in full)


# 5


def test_chat_round_trip():
    rnd = random.Random(8)
    bits = [*chat.CONTROL, "\\", "a", "\n", "<", "|", ">", "🙂", "<\\|"]
    for _ in range(300):
        turns = [(rnd.choice(("user", "assistant", "system", "", "x\ny%")), "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 8)))) for _ in range(rnd.randint(0, 4))]
        text, mask = chat.render(turns)
        assert chat.read_back(text) == turns
        assert [chat.unescape(text[a:z]) for a, z in mask] == [t for r, t in turns if r == "assistant"]
        assert text.count(chat.TURN) == len(turns)


def test_chat_format(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (1, 1, "assistant", "b\\"), (None, 0, None, "x"), (2, 5, "system", "s")]
    got = collected(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), "conv_id")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("user\na\nassistant\n\nassistant\nb\\\n") and got[1]["loss_chars"] == 2 and got[1]["n_turns"] == 3
    assert got[-7]["loss_sha256"] == sha("</s>[INST] ok [/INST]") and got[None]["turns_sha256"] == sha("\nx\n") and got[2]["loss_chars"] == 0


def test_reply_tree_branches(spark):
    nodes = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "good", 5.0), (1, 3, 1, "assistant", "bad", 1.0), (1, 4, 3, "user", "more", 0.0)]
    tree = spark.createDataFrame(nodes, "conv_id long, node long, parent long, role string, text string, score double")
    got = {r["leaf"]: (r["rank"], [t for _, t in chat.read_back(r["formatted"])]) for r in chat.format_paths(tree).collect()}
    assert got == {2: (1, ["q", "good"]), 4: (2, ["q", "bad", "more"])}
    assert [r["leaf"] for r in chat.format_paths(tree, best=1).collect()] == [2]


# 7


def lang_rows():
    rnd = random.Random(6)
    sounds = {"en": ("th", "er", "ou", "and", "ing"), "de": ("sch", "ung", "ein", "ich", "tz"), "fr": ("eau", "tion", "é", "ou", "le"), "es": ("ción", "os", "rr", "ll", "que")}
    return [(i, " ".join("".join(rnd.choice(s) for _ in range(rnd.randint(1, 4))) for _ in range(40)), lang) for i, (lang, s) in enumerate(list(sounds.items()) * 60)]


def test_language_id(spark):
    rows = lang_rows()
    extra = [(900, None, "en"), (901, "123 !!", "en"), (902, "", None), (None, rows[0][1], "en")]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string").withColumn("score", F.lit(9))
    got = langid.identify(docs).collect()
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (900, 901, 902)) and by[None]["lang_pred"] == "en"
    held = [r for r in got if r["held_out"]]
    truth = {i: v for i, _, v in rows}
    assert np.mean([by[r["doc_id"]]["lang_pred"] == truth[r["doc_id"]] for r in held if r["doc_id"] in truth]) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None)
    assert langid.identify(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# 1


def test_toxicity(spark):
    rnd = random.Random(3)
    rows, labels = [], []
    for i in range(700):
        toxic = i % 5 == 0
        w = [rnd.choice(WORDS) for _ in range(40)]
        if toxic:
            for _ in range(3):
                w[rnd.randrange(40)] = "vilest" + rnd.choice(("er", "ing", "", "ed", "s"))
        rows.append((i, " ".join(w), "en" if i % 2 else "fr", "s", 0))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (9000, None, None, None, None), (9001, "", "en", "s", 0)], DOCS)
    marks = spark.createDataFrame([*labels, (5, 1), (6, None)], "doc_id long, toxic int")
    got = collected(toxicity.classify(docs, marks))
    held = [i for i in range(700) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] for i in held) and 0 <= got[9000]["score"] <= 1 and got[9000]["score"] == got[9001]["score"]
    assert np.mean([got[i]["predicted"] == int(i % 5 == 0) for i in held]) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    assert {r["score"] for r in toxicity.classify(docs, marks.where("toxic = 0")).collect()} == {0.0}


# 8


def test_fingerprints(spark):
    rnd = random.Random(2)
    texts = [prose(rnd, n) for n in (2, 5, 30, 60, 400, 3000)] + [None, "", "é", "same text here and there", "same text here and there"]
    got = {r["doc_id"]: r for r in fingerprints.with_next(make(spark, texts)).collect()}
    plain = [t or "" for t in texts]
    n = len(texts)
    for i in range(n):
        new = fingerprints.edited(plain[i], plain[(i - 1) % n])
        d, e, x = (fingerprints.digest(t) for t in (plain[i], new, plain[(i - 1) % n]))
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(plain[i]), hashlib.sha256(new.encode()).hexdigest(), d.text(), e.text())
        assert r["near_edited"] == pytest.approx(d.likeness(e)) and r["near_next"] == pytest.approx(d.likeness(x)) and 0 <= r["near_edited"] <= 1
    assert got[9]["fingerprint"] == got[10]["fingerprint"] and got[10]["near_next"] == 1.0
    assert all(got[i]["near_edited"] > 0.35 > got[i]["near_next"] for i in (3, 4, 5))
    assert fingerprints.with_next(make(spark, [])).count() == 0
    one = fingerprints.with_next(make(spark, ["abc def"])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert fingerprints.with_next(make(spark, ["a", "b", "c"], [None, 1, 1])).count() == 3


def test_equal_pairs():
    rnd = random.Random(1)
    data = np.array([rnd.randrange(5) for _ in range(200)], np.uint8)
    want = [sum(data[i + a] == data[i + b] for b in range(24) for a in range(b)) for i in range(200 - 23)]
    assert fingerprints.equal_pairs(data, 24).tolist() == want


# kernels and the pipeline


def test_shingle_sets_count_like_python(near_texts):
    want = [n for n, _ in (brute_links([(0, t)])[0] for t in near_texts)]
    got = []
    for _, _, data, off in text_chunks(pa.array(near_texts, pa.string()), 500, 7):
        got += np.diff(shingle_sets(data, off)[1]).tolist()
    assert got == want


def test_pipeline(spark):
    import corpus_pipeline

    rows = lang_rows()[:80]
    bench = "/root/testdata/sf0.001"
    item = spark.read.parquet(f"{bench}/benchmark.parquet").first()["text"]
    texts = [t for _, t, _ in rows] + [rows[0][1], "12345", None, rows[1][1] + " " + item, rows[2][1] + " token=abcdef123"]
    langs = [v for _, _, v in rows] + ["en", None, "en", "en", "en"]
    docs = spark.createDataFrame([(i, t, v, "s", len(t or "")) for i, (t, v) in enumerate(zip(texts, langs))], DOCS)
    steps = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "packing"]
    kept = []
    for name, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, bench)
        if name != "packing":
            assert docs.columns == [c.split()[0] for c in DOCS.split(", ")]
        docs = corpus_pipeline.stored(docs)
        kept.append({r["doc_id"] for r in docs.collect()})
    n = len(rows)
    assert kept[0] == set(range(n + 5)) - {n + 1, n + 2}
    assert n not in kept[1] and n + 3 not in kept[2] and set(range(n)) - {1, 2} <= kept[2] and kept[4] == kept[2] and steps
