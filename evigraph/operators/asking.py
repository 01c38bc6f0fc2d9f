"""Questions to a service as rows: micro-questions about a text, the prompt of a section, and the judging of what was found.

A question is (key, task, system, user). ``providers.driven`` asks about the rows and gives ``response``; the rules of this module
give one offline. Answers become fields with defaults, so a document has the same columns whether a call failed or not.

Defined results: null texts are empty; a text longer than its task's limit is cut there (the limit is the question's, the text stays);
an answer without a JSON object, or of another shape, gives the defaults; documents that stand twice are asked about twice and
answered once, by the least answer of each task; a null key is a document; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph import providers
from evigraph.functions.cleaning import digits, lenient_json, numeric_equal
from evigraph.operators import records

TEXT, LIST = "string", "array<string>"


@dataclass(frozen=True)
class Task:
    """One question about a text: what is looked for, the fields of the answer with their types, how much text is sent."""

    name: str
    goal: str
    fields: dict[str, str]
    most: int = 6_000


# The fields of each answer and the characters that are sent.
TASKS = [
    Task("dose_reductions", "Find the steps by which the dose is reduced and give the doses from high to low.", {"dose_reduction_schedule": LIST}),
    Task("treatment_delays", "Find when a cycle is delayed and sum up all the rules briefly.", {"treatment_delay_rules": TEXT}),
    Task("stopping_criteria", "Find when treatment ends for good and sum up the rules briefly.", {"toxicity_stopping_criteria": TEXT}),
    Task("supportive_care", "Find the medicines that must be given in support and list them.", {"supportive_care_requirements": LIST}),
    Task("pharmacokinetics", "Find the pharmacokinetic values, exactly and with their units.", {"auc_value": TEXT, "cmax_value": TEXT, "plasma_protein_binding": TEXT, "volume_of_distribution": TEXT, "metabolism_pathway": TEXT}),
    Task("study_metadata", "Find who sponsors the study, when it begins and ends, and where it takes place.", {"sponsor_information": TEXT, "study_start_date": TEXT, "study_end_date": TEXT, "participating_countries": LIST}, 4_000),
    Task("preclinical_safety", "Find what studies in animals say of toxicity.", {"single_dose_toxicity": TEXT, "repeat_dose_toxicity": TEXT, "toxicity_species": LIST, "target_organs": LIST, "noael_value": TEXT, "maximum_tolerated_dose": TEXT}, 12_000),
]

#: Medicines that support treatment, for the rules.
SUPPORTIVE = ["ondansetron", "granisetron", "dexamethasone", "filgrastim", "pegfilgrastim", "allopurinol", "antiemetic", "growth factor"]


def _shape(task: Task) -> str:
    return "{" + ", ".join(f'"{f}": ' + ('["..."]' if kind == LIST else '"..."') for f, kind in task.fields.items()) + "}"


def questions(docs: DataFrame, key: str, text: str, tasks: list[Task] = TASKS) -> DataFrame:
    """(key, task, system, user): every task about every text."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    one = [
        F.struct(F.lit(t.name).alias("task"), F.lit(f"{t.goal} Say only what the text says; null or an empty list if it says nothing.").alias("system"), F.concat(F.lit("Text:\n"), F.substring(whole, 1, t.most), F.lit(f"\nAnswer with JSON: {_shape(t)}")).alias("user"))
        for t in tasks
    ]
    return docs.select(F.col(f"`{key}`").alias("_key"), F.explode(F.array(*one)).alias("q")).select(F.col("_key").alias(key), "q.*")


def answered_fields(answers: DataFrame, docs: DataFrame, key: str, tasks: list[Task] = TASKS) -> DataFrame:
    """(key, a column for each field of the tasks) of all documents; answers are (key, task, response)."""
    cols, response = [], lenient_json("response")
    for t in tasks:
        own = F.when(F.col("task") == t.name, F.from_json(response, ", ".join(f"`{f}` {kind}" for f, kind in t.fields.items())))
        cols.append(F.min(own).alias(t.name))
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.lit(None).cast("string").alias("task"), F.lit(None).cast("string").alias("response"))
    every = rows.unionByName(answers.select(F.col(f"`{key}`").alias("_key"), "task", "response")).groupBy("_key").agg(*cols)
    fields = [(F.coalesce(F.col(t.name)[f], F.array().cast(LIST)) if kind == LIST else F.col(t.name)[f]).alias(f) for t in tasks for f, kind in t.fields.items()]
    return every.select(F.col("_key").alias(key), *fields)


def ask(docs: DataFrame, key: str, text: str, call: Callable[[list[dict]], list[str]], tasks: list[Task] = TASKS, root: str | None = None, **options) -> DataFrame:
    """The fields of all documents from a service; questions that stay failed or are refused leave the defaults. ``root`` keeps the
    answers, so a run that stopped goes on where it was."""
    asked = providers.driven(questions(docs, key, text, tasks), call, root, **options)
    return answered_fields(asked.answered, docs, key, tasks)


def _sentences(text: Column, *words: str) -> Column:
    """The sentences that hold one of the words, as one text; null for none."""
    parts = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s.rlike("(?i)" + "|".join(words)))
    return F.when(F.size(parts) > 0, F.array_join(parts, " "))


def by_rules(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, task, response): answers to the four tasks about treatment without a service, from the sentences that name them."""
    t = F.substring(F.coalesce(F.col(f"`{text}`"), F.lit("")), 1, 6_000)
    doses = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(_sentences(t, "reduc"), F.lit("")), F.lit(r"(\d+(?:\.\d+)?\s?mg(?:/m²|/m2|/kg)?)"), F.lit(1)), lambda d: F.trim(d)))
    number = lambda d: F.regexp_extract(d, r"^(\d+(?:\.\d+)?)", 1).try_cast("double")
    doses = F.transform(F.array_sort(F.transform(doses, lambda d: F.struct((-number(d)).alias("n"), d.alias("d")))), lambda x: x["d"])
    care = F.filter(F.array(*[F.lit(w) for w in SUPPORTIVE]), lambda w: F.contains(F.lower(t), w))
    said = {"dose_reductions": doses, "treatment_delays": _sentences(t, "delay", "postpon"), "stopping_criteria": _sentences(t, "permanently discontinu", "withdrawn? from"), "supportive_care": care}
    fields = {task.name: next(iter(task.fields)) for task in TASKS}
    one = F.array(*[F.struct(F.lit(n).alias("task"), F.to_json(F.struct(v.alias(fields[n]))).alias("response")) for n, v in said.items()])
    return docs.select(F.col(f"`{key}`").alias("_key"), F.explode(one).alias("a")).select(F.col("_key").alias(key), "a.*")


# The prompt of a section

BACKGROUND = "<background>\nYou read reports of clinical and preclinical studies and take down what they state about a drug and the liver.\n</background>"
CONSTRAINTS = "<constraints>\nTake values as they stand, with units. Do not infer. Write Not Found where the text is silent.\n</constraints>"
OUTPUT = "<output_format>\nOne JSON object with the key fields.\n</output_format>"


def section_prompt(section: Column | str, modules: dict[str, dict[str, str]], prior: Column | str | None = None) -> Column:
    """The prompt of a section: background, what is known before it (if anything), its fields, instructions and examples.

    ``modules`` has fields, instructions and examples of each section, and ``Other`` for the rest; a section's other names are known."""
    label = F.col(section) if isinstance(section, str) else section
    asked = records.asked_as(label, list(modules))
    part = lambda name: F.create_map(*[F.lit(x) for s, m in modules.items() for x in (s, m.get(name, ""))])[asked]
    known = F.col(prior) if isinstance(prior, str) else F.lit("") if prior is None else prior
    known = F.coalesce(known, F.lit(""))
    before = F.when(F.trim(known) != "", F.concat(F.lit("<prior_context>\n"), known, F.lit("\n</prior_context>\n\n"))).otherwise("")
    return F.concat(
        F.lit(BACKGROUND + "\n\n"), before, F.lit("<active_section>\nSection Type: "), F.coalesce(label, F.lit("Other")), F.lit("\nKey Fields to Extract: "), part("fields"),
        F.lit("\n</active_section>\n\n<extraction_instructions>\n"), part("instructions"), F.lit("\n</extraction_instructions>\n\n<examples>\n"), part("examples"),
        F.lit(f"\n</examples>\n\n{CONSTRAINTS}\n\n{OUTPUT}"),
    )


# Judging

# The tasks of a judge and the characters of context that it is sent.
JUDGE = {
    "semantic": "Do the two values mean the same? 1.0 for the same meaning, 0.5 for related values that differ in detail or unit, 0.0 otherwise.",
    "hallucination": "Does the context state the value, or does it follow directly? 1.0 if so, 0.0 if not.",
    "faithfulness": "Which share of the facts does the context support, with exact numbers and terms?",
    "reference_free_audit": "Does the context support the value? 1.0 if it does in full, 0.5 in part, 0.0 if it says otherwise or nothing.",
}
CONTEXT, SHOWN = 100_000, 200


def judge_questions(fields: DataFrame, key: str, task: str) -> DataFrame:
    """(key, task, field, value, system, user) of rows (key, field, value, and truth for ``semantic``, else context)."""
    against = F.concat(F.lit("\nTruth: "), F.coalesce("truth", F.lit(""))) if task == "semantic" else F.concat(F.lit("\nContext:\n"), F.substring(F.coalesce("context", F.lit("")), 1, CONTEXT))
    user = F.concat(F.lit("Field: "), F.coalesce("field", F.lit("")), F.lit("\nValue: "), F.coalesce("value", F.lit("")), against)
    return fields.select(key, F.lit(task).alias("task"), "field", "value", F.lit(JUDGE[task] + ' Answer with JSON: {"score": 0.0, "explanation": "..."}').alias("system"), user.alias("user"))


def judged(answers: DataFrame, key: str) -> DataFrame:
    """(key, task, field, value, score, reason) of answers (key, task, field, value, response): a score is between 0 and 1, an answer
    without one is 0; of a value the first 200 characters are shown."""
    said = F.from_json(lenient_json("response"), "score double, explanation string, reason string")
    rows = answers.withColumn("_said", said)
    score = F.least(F.greatest(F.coalesce(F.col("_said.score"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    reason = F.coalesce("_said.explanation", "_said.reason", F.when(F.col("_said.score").isNotNull(), "Verified against context").otherwise("No answer that can be read"))
    return rows.select(key, "task", "field", F.substring("value", 1, SHOWN).alias("value"), score.alias("score"), reason.alias("reason"))


def judge_by_rules(fields: DataFrame, key: str, task: str) -> DataFrame:
    """(key, task, field, score) without a service: the same but for case, space and units (``semantic``); in the context without case
    and space (``hallucination``, ``faithfulness``), for the audit also 0.5 if its digits stand there. Values that are null have no score."""
    plain = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", ""))
    if task == "semantic":
        score = numeric_equal("truth", "value").cast("double")
    else:
        number, context = digits(F.col("value")), plain(F.col("context"))
        score = F.contains(context, plain(F.col("value"))).cast("double")
        if task == "reference_free_audit":
            score = F.when(score == 1, 1.0).when((number != "") & F.contains(context, number), 0.5).otherwise(0.0)
    return fields.select(key, F.lit(task).alias("task"), "field", F.when(F.col("value").isNotNull(), score).alias("score"))
