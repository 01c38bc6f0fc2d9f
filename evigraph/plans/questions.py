"""Queries of questions about texts, their answers by rule, and judged values, over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.operators import asking, resolve, retrieval
from evigraph.operators.records import judge_rates
from evigraph.plans.catalogue import Tables, query


@query(
    """SELECT doc_id, task, md5(substring(coalesce(text, ''), 1, most)) AS sent FROM documents, (VALUES ('dose_reductions', 6000), ('treatment_delays', 6000), ('stopping_criteria', 6000), ('supportive_care', 6000),
('pharmacokinetics', 6000), ('study_metadata', 4000), ('preclinical_safety', 12000)) v(task, most)"""
)
def text_questions(t: Tables) -> DataFrame:
    """The text that each question about a document carries."""
    sent = F.regexp_extract("user", r"(?s)\AText:\n(.*)\nAnswer with JSON: [^\n]*\z", 1)
    return asking.questions(t.documents, "doc_id", "text").select("doc_id", "task", F.md5(sent).alias("sent"))


_TREATED = "'Delay cycle ' || doc_id % 7 || ' if counts are low. The dose is reduced to ' || doc_id % 90 || ' mg or 12.5 mg/kg! ' || coalesce(text, '')"


@query(
    f"""WITH d AS (SELECT doc_id, substring({_TREATED}, 1, 6000) AS t FROM documents),
s AS (SELECT doc_id, t, list_transform(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')) AS parts FROM d),
p AS (SELECT doc_id, t, list_filter(parts, lambda x: regexp_matches(x, 'reduc', 'i')) AS r, list_filter(parts, lambda x: regexp_matches(x, 'delay|postpon', 'i')) AS w, list_filter(parts, lambda x: regexp_matches(x, 'permanently discontinu|withdrawn? from', 'i')) AS e FROM s),
x AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(array_to_string(r, ' '), '(\\d+(?:\\.\\d+)?\\s?mg(?:/m²|/m2|/kg)?)', 1)) AS dose FROM p),
o AS (SELECT doc_id, string_agg(dose, '|' ORDER BY regexp_extract(dose, '^(\\d+(?:\\.\\d+)?)', 1)::DOUBLE DESC, dose) AS doses FROM x GROUP BY doc_id)
SELECT doc_id, coalesce(doses, '') AS doses, CASE WHEN len(w) > 0 THEN md5(array_to_string(w, ' ')) END AS delays, CASE WHEN len(e) > 0 THEN md5(array_to_string(e, ' ')) END AS stops,
array_to_string(list_filter(['ondansetron', 'granisetron', 'dexamethasone', 'filgrastim', 'pegfilgrastim', 'allopurinol', 'antiemetic', 'growth factor'], lambda c: contains(lower(t), c)), '|') AS care FROM p LEFT JOIN o USING (doc_id)"""
)
def treatment_answers(t: Tables) -> DataFrame:
    """What rules find about treatment in each document, before which two sentences of treatment are put."""
    docs = t.documents.select("doc_id", F.expr(_TREATED).alias("text"))
    fields = asking.answered_fields(asking.by_rules(docs, "doc_id", "text"), docs, "doc_id")
    return fields.select("doc_id", F.array_join("dose_reduction_schedule", "|").alias("doses"), F.md5("treatment_delay_rules").alias("delays"), F.md5("toxicity_stopping_criteria").alias("stops"), F.array_join("supportive_care_requirements", "|").alias("care"))


@query(
    """WITH f AS (SELECT doc_id, unnest([lang, source, string_split(trim(text, ' '), ' ')[2]]) AS v, lower(regexp_replace(coalesce(text, ''), '\\s+', '', 'g')) AS c FROM documents),
s AS (SELECT doc_id, contains(c, lower(regexp_replace(v, '\\s+', '', 'g')))::INT AS score FROM f WHERE v IS NOT NULL), d AS (SELECT DISTINCT doc_id FROM documents)
SELECT doc_id, CASE WHEN count(score) > 0 THEN round(count(*) FILTER (score = 0) / count(score), 3) ELSE 0 END::DOUBLE AS hallucination_rate, CASE WHEN count(score) > 0 THEN round(sum(score * 100) / (count(score) * 100), 3) ELSE 1 END::DOUBLE AS faithfulness
FROM d LEFT JOIN s USING (doc_id) GROUP BY doc_id"""
)
def judged_documents(t: Tables) -> DataFrame:
    """Rates of three values of each document, judged by rule against its text: its language, its source and its second word."""
    values = F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in (("lang", F.col("lang")), ("source", F.col("source")), ("word", F.get(F.split(F.trim("text"), " "), F.lit(1))))])
    fields = t.documents.select("doc_id", F.col("text").alias("context"), F.explode(values).alias("v")).select("doc_id", "context", "v.*")
    return judge_rates(asking.judge_by_rules(fields, "doc_id", "hallucination").unionByName(asking.judge_by_rules(fields, "doc_id", "faithfulness")), "doc_id")


@query("SELECT source, count(*)::BIGINT AS n, min(doc_id) AS first FROM documents WHERE lang = 'en' GROUP BY source")
def chunks_of_section(t: Tables) -> DataFrame:
    """Documents as chunks of their source, with the language as section."""
    chunks = t.documents.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("chunk_index"), F.col("lang").alias("section"))
    return retrieval.by_section(chunks, "en").groupBy(F.col("doc_id").alias("source")).agg(F.count("*").alias("n"), F.min("chunk_index").alias("first"))


@query(
    """SELECT event_id, CASE event_type WHEN 'purchase' THEN 'bought' WHEN 'error' THEN 'failed' END AS field FROM events WHERE event_type IN ('purchase', 'error')"""
)
def answered_queries(t: Tables) -> DataFrame:
    """Events as answers to queries that come back in other case and with white space around."""
    rows = t.events.select("event_id", F.concat(F.lit(" \t"), F.upper("event_type"), F.lit("\n")).alias("query"))
    return resolve.answered_queries(rows, {"Purchase ": "bought", " ERROR": "failed", "error": "never"}).select("event_id", "field")
