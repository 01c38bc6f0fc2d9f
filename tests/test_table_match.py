"""Row alignment of tables against a plain loop, in whole groups and in turns."""

import random

import pytest

from evigraph.operators import evaluate

SCHEMA = "tbl string, row long, a string, b string, c string"
EMPTY = {"", "not found", "null", "none", "[]", "{}"}


def plain(truth, found):
    """Per table: what the greedy alignment counts, row by row."""

    def text(v):
        v = "" if v is None else v.strip().lower()
        return "" if v in EMPTY else v

    def equal(x, y):
        x, y = text(x), text(y)
        digits = ["".join(ch for ch in v if ch.isdigit() or ch == ".") for v in (x, y)]
        return x == y or any(ch.isdigit() for ch in x) and any(ch.isdigit() for ch in y) and digits[0] == digits[1]

    def key(r):
        return tuple((v is None, v if v is not None else 0) for v in r[1:])

    out = {}
    for t in {r[0] for r in truth + found}:
        own, free = (sorted((r for r in side if r[0] == t), key=key) for side in (truth, found))
        n, cells, right = len(own), 0, 0
        for r in own:
            scores = [sum(equal(x, y) for x, y in zip(r[2:], f[2:])) for f in free]
            if scores and max(scores):
                cells += max(scores)
                right += max(scores) == 3
                free.pop(scores.index(max(scores)))
        out[t] = (n * 3, cells, n, right, len(free) * 3)
    return out


def rows(rng, tables, n):
    cell = lambda: rng.choice([None, " ", "x", "X ", "y", "5 mg", "5", "7", "none", "z"])
    return [(rng.choice(tables), rng.choice([None, rng.randrange(60)]), cell(), cell(), cell()) for _ in range(n)]


def run(spark, truth, found, **sizes):
    t, f = (spark.createDataFrame(side, SCHEMA) for side in (truth, found))
    return {r[0]: tuple(r)[1:] for r in evaluate.match_tables(t, f, "tbl", "row", ["a", "b", "c"], **sizes).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_both_ways_equal_the_plain_loop(spark, seed):
    rng = random.Random(seed)
    truth, found = rows(rng, ["hot"] * 4 + ["p", "q", None], 90), rows(rng, ["hot"] * 4 + ["p", "r", None], 80)
    want = plain(truth, found)
    assert run(spark, truth, found) == want
    assert run(spark, truth, found, whole=8, turn=7, block=5) == want


def test_turns_where_every_row_is_the_same(spark):
    same = [("k", i, "x", "5 mg", None) for i in range(40)]
    assert run(spark, same, same[:25], whole=4, turn=8, block=6) == {"k": (120, 75, 40, 25, 0)}
    assert run(spark, same[:25], same, whole=4, turn=8, block=6) == {"k": (75, 75, 25, 25, 45)}


def test_empty_and_one_sided_tables(spark):
    one = [("k", 1, "x", "y", "z")]
    assert run(spark, [], []) == {}
    assert run(spark, one, []) == {"k": (3, 0, 1, 0, 0)}
    assert run(spark, [], one * 2, whole=1) == {"k": (0, 0, 0, 0, 6)}


def test_columns_whose_names_clash(spark):
    t = spark.createDataFrame([("k", 1, "x", "n", 3)], "_table string, _at long, _n string, _score string, extra int")
    got = evaluate.match_tables(t, t, "_table", "_at", ["_n", "_score"], whole=0).collect()
    assert [tuple(r) for r in got] == [("k", 2, 2, 1, 1, 0)]


def test_tables_share_groups(spark, monkeypatch):
    rng = random.Random(9)
    truth, found = (rows(rng, [f"t{i}" for i in range(60)] + [None], 700) for _ in range(2))
    calls = []
    whole = evaluate._match_whole
    monkeypatch.setattr(evaluate, "_match_whole", lambda *a: calls.append(a[-1]) or whole(*a))
    monkeypatch.setattr(evaluate, "GROUP", 300)
    assert run(spark, truth, found) == plain(truth, found)
    assert calls == [5]  # 61 tables in five groups, one for each before
    assert evaluate._compared("1²") == "#1²" and evaluate._compared(" #. ") == "#." and evaluate._compared("[]") == ""
