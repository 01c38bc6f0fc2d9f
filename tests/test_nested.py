"""Nested records from answers, against a plain merge of JSON objects."""

import json
import random

from pyspark.sql import types as T

from evigraph.functions import rules
from evigraph.operators import nested

text, whole = T.StringType(), T.LongType()
SCHEMA = T.StructType([
    T.StructField("study_metadata", T.StructType([T.StructField("sponsor", text), T.StructField("phase", text, metadata={"default": "unknown"}), T.StructField("protocol_ids", T.ArrayType(text))])),
    T.StructField("safety_data", T.StructType([
        T.StructField("adverse_events", T.ArrayType(T.StructType([T.StructField("term", text), T.StructField("grade", whole)]))),
        T.StructField("serious", T.BooleanType()), T.StructField("deaths", whole),
        T.StructField("liver", T.StructType([T.StructField("alt", T.DoubleType()), T.StructField("marks", T.ArrayType(text)), T.StructField("signs", T.ArrayType(text))])),
    ])),
    T.StructField("preclinical_toxicology", T.StructType([T.StructField("species", text)])),
    T.StructField("genotoxicity", T.StructType([T.StructField("genotoxicity_in_vitro", text), T.StructField("genotoxicity_in_vivo", text)])),
    T.StructField("summary", text),
    T.StructField("semantic_relationships", T.StructType([T.StructField("relationships", T.ArrayType(T.StructType([T.StructField("subject", text), T.StructField("object", text)])))])),
])


def blank(kind):
    if isinstance(kind, T.StructType):
        return {f.name: f.metadata.get("default") or blank(f.dataType) for f in kind.fields}
    return [] if isinstance(kind, T.ArrayType) else None


def plain(answers):
    """doc -> record, merged answer by answer."""
    out = {}
    for doc, _, section, answer in sorted(answers, key=lambda a: (a[0], a[1], a[2], a[3] or "")):
        base = out.setdefault(doc, blank(SCHEMA) | {"seen": set()})
        try:
            got = json.loads((answer or "").replace("```json", "").replace("```", ""))
        except ValueError:
            continue
        rel = got.pop("semantic_relationships", None)
        key = rules.SECTION_KEYS.get(section)
        new = got
        if key:
            new = {key: {k: v for k, v in got.items() if section != "Nonclinical Toxicology" or k not in rules.NONCLINICAL_FIELDS}}
            if section == "Nonclinical Toxicology":
                for part in set(rules.NONCLINICAL_FIELDS.values()):
                    own = {k: v for k, v in got.items() if rules.NONCLINICAL_FIELDS.get(k) == part}
                    if any(v is not None and v != "Not Found" for v in own.values()):
                        new[part] = own
        if rel:
            new["semantic_relationships"] = {"relationships": rel["relationships"] if isinstance(rel, dict) else rel}
        merge(base, new, (), base["seen"])
    for r in out.values():
        r.pop("seen")
    return out


def merge(base, new, path, seen):
    for k, v in new.items():
        here = (*path, k)
        if v is None or k not in base:
            continue
        if isinstance(v, list) and isinstance(base[k], list):
            base[k] += [x for i, x in enumerate(v) if x not in base[k] and x not in v[:i]]
        elif isinstance(v, dict) and isinstance(base[k], dict):
            merge(base[k], v, here, seen)
        elif isinstance(base[k], (list, dict)):
            continue
        elif isinstance(v, bool):
            base[k] = bool(base[k]) or v
        else:
            empty = lambda x: x is None or str(x).strip() in ("", "Not Found")
            if empty(base[k]) or here not in seen:  # a default gives way
                if not (here in seen and empty(v) and not empty(base[k])):
                    base[k] = v
            seen.add(here)


def answer(rnd):
    pick = lambda *x: rnd.choice(x)
    section = pick("Drug Overview", "Safety and Adverse Events", "Hepatotoxicity", "Nonclinical Toxicology", "Other")
    if section == "Drug Overview":
        got = {"sponsor": pick(None, "", "Not Found", "A", "B"), "phase": pick(None, "Not Found", "2"), "protocol_ids": [pick("P1", "P2", "P3") for _ in range(rnd.randrange(4))]}
    elif section == "Nonclinical Toxicology":
        got = {"species": pick("Rat", "Not Found"), "genotoxicity_in_vitro": pick("Not Found", "Negative", None), "genotoxicity_in_vivo": pick("Not Found", "Not Found", "Positive")}
    elif section == "Other":
        got = {"summary": pick("", "S", "T"), "unknown": 1, "safety_data": {"deaths": pick(None, 3, 4), "liver": {"alt": pick(1.5, 2.5)}}}
    else:
        got = {"adverse_events": [{"term": pick("Rash", "Nausea"), "grade": pick(1, 2)} for _ in range(rnd.randrange(3))], "serious": pick(None, True, False, False), "deaths": pick(None, 0, 7), "liver": pick({}, {"marks": [pick("x", "y")], "signs": ["z", "z"]}, {"alt": 0.5})}
    if rnd.random() < 0.4:
        rel = [{"subject": pick("a", "b"), "object": pick("c", "d")} for _ in range(2)]
        got["semantic_relationships"] = pick(rel, {"relationships": rel})
    got = {k: v for k, v in got.items() if rnd.random() < 0.8}
    out = json.dumps(got)
    return section, pick(out, out, f"```json\n{out}\n```", "no object", None)


def test_records_like_a_plain_merge(spark):
    rnd = random.Random(2)
    rows = [(doc, i, *answer(rnd)) for doc in range(40) for i in range(rnd.randrange(1, 9))]
    got = nested.nested_records(spark.createDataFrame(rows, "doc_id long, chunk_index long, section string, answer string").repartition(5), SCHEMA)
    assert got.schema["record"].dataType.simpleString() == SCHEMA.simpleString()
    assert {r["doc_id"]: r["record"].asDict(recursive=True) for r in got.collect()} == plain(rows)
    others = {k for r in got.collect() for k in r["other"]}
    assert others == {"unknown"}


def test_records_of_odd_values(spark):
    rows = [(1, 0, "Drug Overview", '{"sponsor": {"a": [1]}, "phase": 2, "protocol_ids": "P1", "extra": null}'), (1, 1, "Safety and Adverse Events", '{"deaths": "many", "serious": "yes", "liver": [1]}'), (2, 0, None, "[1]")]
    got = {r["doc_id"]: r["record"] for r in nested.nested_records(spark.createDataFrame(rows, "doc_id long, chunk_index long, section string, answer string"), SCHEMA).collect()}
    assert got[1]["study_metadata"].asDict() == {"sponsor": '{"a":[1]}', "phase": "2", "protocol_ids": []}
    assert got[1]["safety_data"]["deaths"] is None and got[1]["safety_data"]["liver"]["marks"] == []
    assert got[2].asDict(recursive=True) == blank(SCHEMA)
    empty = spark.createDataFrame([], "doc_id long, chunk_index long, section string, answer string")
    assert nested.nested_records(empty, SCHEMA).collect() == []


def test_answers_are_taken_apart_once(spark, monkeypatch):
    calls = []
    kept = nested.kept
    monkeypatch.setattr(nested, "kept", lambda df: calls.append(df) or kept(df))
    rows = [(1, 0, "Other", '{"a": {"x": 1, "y": null, "z": [2]}, "b": 5, "c": null, "d": {}, "e": []}'), (2, 1, "Other", "none")]
    got = nested.nested_records(spark.createDataFrame(rows, "doc_id long, chunk_index long, section string, answer string"), SCHEMA)
    assert {r["doc_id"]: r["other"] for r in got.collect()} == {1: {"a.x": "1", "a.z": "[2]", "b": "5", "e": "[]"}, 2: {}}
    assert len(calls) == 1 and "Union" not in calls[0]._jdf.queryExecution().optimizedPlan().toString()
