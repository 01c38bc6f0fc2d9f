"""Questions, prompts and judging: what is sent, what comes back, and defaults for what does not."""

import json

from evigraph.operators import asking
from evigraph.operators.records import judge_rates

DOCS = "id long, text string, task string"


def test_questions(spark):
    docs = spark.createDataFrame([(1, "a" * 20_000, "x"), (None, None, "y")], DOCS)
    rows = asking.questions(docs, "id", "text").collect()
    assert len(rows) == 14 and len({r["system"] for r in rows}) == 7
    sent = {r["task"]: r["user"].count("aa" * 500) * 1000 for r in rows if r["id"] == 1}
    assert sent["dose_reductions"] == 6000 and sent["study_metadata"] == 4000 and sent["preclinical_safety"] == 12_000
    assert asking.questions(docs.limit(0), "id", "text").count() == 0


def service():
    import json

    def call(rows):
        out = []
        for r in rows:
            if r["id"] == 3:
                raise ValueError("content_filter")
            told = {"dose_reductions": '```json\n{"dose_reduction_schedule": ["10 mg", "5 mg"]}```', "treatment_delays": "nothing", "supportive_care": '{"supportive_care_requirements": "no list"}'}
            out.append(told.get(r["task"], json.dumps({"sponsor_information": r["user"].split("\n")[1]})))
        return out

    return call


def test_answers_of_a_service(spark):
    docs = spark.createDataFrame([(1, "S1", ""), (1, "S1", ""), (3, "S3", ""), (None, "S0", "")], DOCS)
    got = {r["id"]: r for r in asking.ask(docs, "id", "text", service(), size=1, sleep=lambda s: None).collect()}
    assert set(got) == {1, 3, None} and got[1]["dose_reduction_schedule"] == ["10 mg", "5 mg"] and got[1]["sponsor_information"] == "S1"
    assert got[1]["treatment_delay_rules"] is None and got[1]["supportive_care_requirements"] == [] and got[None]["sponsor_information"] == "S0"
    assert got[3]["dose_reduction_schedule"] == [] and got[3]["sponsor_information"] is None


def test_rules(spark):
    text = "Start at 1000 mg/m². First reduction: 750 mg/m2. Second reduction to 562.5 mg/m2 or 1000 mg. Delay the cycle if ANC is low. Permanently discontinue at grade 4! Give ondansetron."
    docs = spark.createDataFrame([(1, text, ""), (2, None, "")], DOCS)
    got = {r["id"]: r for r in asking.answered_fields(asking.by_rules(docs, "id", "text"), docs, "id").collect()}
    assert got[1]["dose_reduction_schedule"] == ["1000 mg", "750 mg/m2", "562.5 mg/m2"]
    assert got[1]["treatment_delay_rules"] == "Delay the cycle if ANC is low." and got[1]["toxicity_stopping_criteria"] == "Permanently discontinue at grade 4!"
    assert got[1]["supportive_care_requirements"] == ["ondansetron"] and got[2]["dose_reduction_schedule"] == [] and got[2]["treatment_delay_rules"] is None


def test_section_prompts(spark):
    modules = {"Other": {"fields": "any", "instructions": "all", "examples": "none"}, "Pharmacokinetics": {"fields": "auc", "instructions": "exact", "examples": "AUC 5"}}
    df = spark.createDataFrame([("Pharmacokinetics", "known"), ("Strange", " "), (None, None)], "section string, prior string")
    pk, strange, none = (r[0] for r in df.select(asking.section_prompt("section", modules, "prior")).collect())
    assert "<prior_context>\nknown\n</prior_context>" in pk and "Key Fields to Extract: auc" in pk and pk.index("<examples>") < pk.index("<constraints>") < pk.index("<output_format>")
    assert "prior_context" not in strange and "Section Type: Strange\nKey Fields to Extract: any" in strange and "Section Type: Other" in none


def test_judging(spark):
    rows = spark.createDataFrame([(1, "f", "50 mg", "Given 50  MG daily", "50"), (1, "g", "70 mg", "Given 70 daily", "7"), (1, "h", None, "x", "x"), (None, "f", "z", None, None)], "id long, field string, value string, context string, truth string")
    score = lambda task: {(r["id"], r["field"]): r["score"] for r in asking.judge_by_rules(rows, "id", task).collect()}
    assert score("hallucination") == {(1, "f"): 1.0, (1, "g"): 0.0, (1, "h"): None, (None, "f"): 0.0}
    assert score("reference_free_audit") == {(1, "f"): 1.0, (1, "g"): 0.5, (1, "h"): None, (None, "f"): 0.0}
    assert score("semantic") == {(1, "f"): 1.0, (1, "g"): 0.0, (1, "h"): None, (None, "f"): 0.0}
    every = asking.judge_by_rules(rows, "id", "hallucination").unionByName(asking.judge_by_rules(rows, "id", "faithfulness"))
    assert {r["id"]: (r["hallucination_rate"], r["faithfulness"]) for r in judge_rates(every, "id").collect()} == {1: (0.5, 0.5), None: (1.0, 0.0)}
    asked = asking.judge_questions(rows, "id", "semantic").collect()
    assert asked[0]["user"] == "Field: f\nValue: 50 mg\nTruth: 50" and "Context" in asking.judge_questions(rows, "id", "hallucination").first()["user"]


def test_judged_answers(spark):
    rows = spark.createDataFrame([(1, "t", "f", "v" * 300, '{"score": 0.5, "explanation": "e"}'), (1, "t", "g", "v", "so so"), (1, "t", "h", "v", '{"score": 7}'), (1, "t", "i", None, '{"reason": "r"}')], "id long, task string, field string, value string, response string")
    got = {r["field"]: (r["score"], r["reason"]) for r in asking.judged(rows, "id").collect()}
    assert got == {"f": (0.5, "e"), "g": (0.0, "No answer that can be read"), "h": (1.0, "Verified against context"), "i": (0.0, "r")}
    assert max(len(r["value"] or "") for r in asking.judged(rows, "id").collect()) == 200
