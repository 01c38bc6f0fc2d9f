"""Running context, digests and the ledger, against plain loops over the sections of a document."""

import json
import random


from evigraph.operators import context as C

SECTIONS = ["Efficacy Outcomes", "Safety and Adverse Events", "Pharmacokinetics", "Dosing Regimen", "Other", "Drug Overview", "Hepatotoxicity"]
FIELDS = ["study_id", "adverse_event", "adverse_event", "orr", "dose_level", "sponsor", "indication", "metabolism_pathway"]


def table(seed, docs=12):
    rnd = random.Random(seed)
    sections, facts = [], []
    for d in range(docs):
        for at in range(rnd.randrange(1, 25)):
            s = rnd.choice(SECTIONS)
            sections.append((d, at, s))
            facts += [(d, at, s, f, rnd.choice([None, " ", f"{f}{rnd.randrange(14)}"])) for f in rnd.sample(FIELDS, rnd.randrange(4))]
    return sections, facts


def plain(sections, facts):
    out = {}
    for d, at, s in sections:
        ids, events, first = [], [], {}
        for _, _, _, f, v in sorted((x for x in facts if x[0] == d and x[1] < at and (x[4] or "").strip()), key=lambda x: (x[1], x[4])):
            if f == "study_id" and v not in ids:
                ids.append(v)
            elif f == "adverse_event" and v not in events:
                events.append(v)
            elif f not in C.LISTS:
                first.setdefault(f, v)
        done = []
        for _, _, x in sorted((x for x in sections if x[0] == d and x[1] < at), key=lambda x: x[1]):
            if x not in done:
                done.append(x)
        lines = ["Drug: Belix (class unknown)"]
        lines += [f"Indication: {first['indication']}"] if "indication" in first else []
        lines.append("Studies so far: " + (", ".join(ids) or "none yet"))
        lines += [f"Sponsor: {first['sponsor']}"] if "sponsor" in first else []
        if s in C.EVENTS_TOLD and events:
            lines.append("Adverse events so far: " + ", ".join(events[:10]))
        told = C.CONFIRMED.get(s, {})
        lines += [f"Confirmed {told[f]}: {first[f]}" for f in sorted(told) if f in first]
        lines += ["Sections done: " + ", ".join(done[-5:])] if done else []
        out[d, at] = "\n".join(lines)
    return out


def test_context_before_each_section(spark):
    sections, facts = table(1)
    s, f = spark.createDataFrame(sections, "doc_id long, at long, section string"), spark.createDataFrame(facts, C.FACT)
    got = C.running_context(s, f.union(f.limit(9)), "Belix").collect()
    assert {(r["doc_id"], r["at"]): r["context"] for r in got} == plain(sections, facts)
    assert C.running_context(s.limit(0), f, "Belix").count() == 0
    assert C.running_context(s, f.limit(0), "Belix").count() == len(sections)


def test_digests_keep_to_their_budget(spark):
    rnd = random.Random(2)
    facts = [(d, at, "s", f, f'{f}"{rnd.randrange(50)}' * rnd.choice((1, 1, 30))) for d in range(20) for at in range(40) for f in ("orr", "sponsor", "adverse_event")]
    df = spark.createDataFrame([*facts, (99, 0, "s", "orr", "x" * 900), (98, 0, "s", "else", "y")], C.FACT)
    for budget in (60, 300, 8000):
        rows = {r["doc_id"]: r for r in C.digests(df, ["sponsor", "orr"], budget=budget).collect()}
        assert len(rows) == 22 and all(len(r["digest"]) <= budget for r in rows.values())
        for d in range(20):
            got = json.loads(rows[d]["digest"])
            own = [x for x in facts if x[0] == d]
            first = {f: next(x[4] for x in own if x[3] == f) for f in ("sponsor", "orr")}
            events = list(dict.fromkeys(x[4] for x in own if x[3] == "adverse_event"))[:20]
            if budget == 8000 and rows[d]["entries"] == 2 + len(events):
                assert got == {**first, "adverse_events": events}
            assert got == {"fallback": True} or all(got[k] == first[k] for k in got if k != "adverse_events") and got.get("adverse_events", []) == events[: len(got.get("adverse_events", []))]
        assert rows[98]["digest"] == '{"fallback":true}' and (budget == 8000) == ("orr" in rows[99]["digest"])
    told = C.told_by(C.digests(spark.createDataFrame([(5, 0, "s", "sponsor", "S")], C.FACT), ["sponsor"])).first()["context"]
    assert told == "Prior document: 5\nsponsor: S"


def test_a_stopped_ledger_is_taken_up(spark, tmp_path):
    sections, facts = table(3, 5)
    s, f = spark.createDataFrame(sections, "doc_id long, at long, section string"), spark.createDataFrame(facts, C.FACT)
    asked = []

    def ask(now):
        asked.extend((r["doc_id"], r["at"], r["context"]) for r in now.collect())
        return f.join(now.select("doc_id", "at"), ["doc_id", "at"])

    whole, broken = C.Ledger(spark, f"file://{tmp_path}/a"), C.Ledger(spark, f"file://{tmp_path}/b")
    whole.run(s, ask, "Belix", at_once=5)
    want, first = sorted(map(str, whole.facts().collect())), list(asked)
    asked.clear()
    assert broken.run(s, ask, "Belix", at_once=5, rounds=2) == 2 and broken.version() == 2
    # a table that was not committed does not count
    spark.createDataFrame([(0, 99, "x", "orr", "lost")], C.FACT).write.parquet(f"file://{tmp_path}/b/part=000002")
    (tmp_path / "b" / "part=000002" / "_SUCCESS").unlink()
    C.Ledger(spark, broken.root).run(s, ask, "Belix", at_once=5)
    assert sorted(map(str, broken.facts().collect())) == want and sorted(asked) == sorted(first) and len({x[:2] for x in asked}) == len(sections)
    assert broken.snapshot(1).count() == whole.snapshot(1).count() < len(want)
    assert broken.run(s, ask, "Belix") == 0
    # the first section of a round knows all before it
    assert all(c == plain(sections, facts)[d, at] for d, at, c in first if at % 5 == 0)
