"""Fields of a record from answers, against a plain loop, and what the query moves for them."""

import json
import random

from evigraph.functions import rules
from evigraph.operators import records as A
from evigraph.plans.catalogue import QUERIES

SCHEMA = "doc_id long, chunk_index int, section string, answer string"


def plain(rows):
    """All rows are read, then it is settled by (document, chunk, key) which nonclinical fields go anywhere."""
    found, full = set(), set()
    for doc, chunk, section, answer in rows:
        text = (answer or "").replace("```json", "").replace("```", "")
        if "{" not in text or "}" not in text[text.index("{") :]:
            continue
        for field, value in json.loads(text[text.index("{") : text.rindex("}") + 1]).items():
            if value is None or field == "semantic_relationships":
                continue
            value = value if isinstance(value, str) else json.dumps(value, separators=(",", ":"))
            own = rules.NONCLINICAL_FIELDS.get(field) if section == "Nonclinical Toxicology" else None
            found.add((doc, chunk, section, field, value, own))
            if own and value != "Not Found" and doc is not None and chunk is not None:
                full.add((doc, chunk, own))
    best = {}
    for doc, chunk, section, field, value, own in found:
        if own and (doc, chunk, own) not in full:
            continue
        at = (doc, own or rules.SECTION_KEYS.get(section, ""), field)
        rank = (value.strip(" ") == "" or value == "Not Found", chunk is not None, chunk or 0, value)
        best[at] = min(best.get(at, rank), rank)
    return {at: rank[-1] for at, rank in best.items()}


def got(spark, rows, parts=3):
    out = A.record_fields(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()
    assert len({tuple(r)[:3] for r in out}) == len(out)
    return {(r["doc_id"], r["key"], r["field"]): r["value"] for r in out}


def test_fields_equal_the_plain_loop(spark):
    rnd = random.Random(3)
    fields = ["genotoxicity_in_vitro", "genotoxicity_in_vivo", "genotoxicity_conclusion", "carcinogenicity_results", "reproductive_warnings", "species", "free", "semantic_relationships"]
    values = ["Not Found", "Not Found", "Not Found", "", "  ", "Negative", "Å", None, 3, {"a": [1, "x"]}]
    sections = ["Nonclinical Toxicology"] * 4 + ["Genotoxicity", "Drug Overview", "Other", None]
    rows = []
    for _ in range(600):
        said = json.dumps({f: rnd.choice(values) for f in rnd.sample(fields, rnd.randint(0, 4))}, ensure_ascii=False)
        answer = rnd.choice([said, said, f"Here: ```json\n{said}\n``` done", "no answer", None])
        # few documents and chunks, so several answers are about one chunk
        rows.append((rnd.choice([*range(12), None]), rnd.choice([0, 1, 2, 3, None]), rnd.choice(sections), answer))
    want = plain(rows)
    assert got(spark, rows + rows[:50]) == want and len(want) > 100


def test_an_answer_lets_in_what_another_of_its_chunk_leaves_open(spark):
    part = "Nonclinical Toxicology"
    silent, says = '{"genotoxicity_in_vivo": "Not Found"}', '{"genotoxicity_in_vitro": "Negative"}'
    rows = [(1, 0, part, silent), (1, 0, part, says), (2, 0, part, silent), (2, 1, part, says), (3, 0, part, silent), (3, 0, "Genotoxicity", says)]
    rows += [(4, 0, part, '{"genotoxicity_in_vivo": null, "genotoxicity_in_vitro": "Negative"}'), (4, 0, part, silent)]
    in_vitro, in_vivo = (("genotoxicity", f"genotoxicity_in_{x}") for x in ("vitro", "vivo"))
    assert got(spark, rows) == {(d, *in_vitro): "Negative" for d in (1, 2, 3, 4)} | {(d, *in_vivo): "Not Found" for d in (1, 4)} == plain(rows)
    assert got(spark, []) == {}


def test_answers_are_read_once_and_only_keys_are_moved(spark):
    plan = QUERIES["record_fields"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == plan.count("FileScan") == plan.count("Exchange ") == 1
    # one sort serves both aggregates, nothing is joined
    assert plan.count("+- Sort [") == 1 and "Join" not in plan
    rows = spark.createDataFrame([(1, 0, "Other", '{"a": 1}')], SCHEMA)
    plan = A.record_fields(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 1 and plan.count("Exchange ") == 2 and "Join" not in plan
