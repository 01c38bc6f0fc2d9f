"""What is known of a document before each of its sections, as text; what is known at the end, as a digest of bounded size; and a ledger of the
sections that are done, so that a stopped run is taken up.

Facts are rows (doc_id, at, section, field, value): the section at place ``at`` says that a field has a value. Of a plain field the first value
counts, of a list (``LISTS``) each value once in the order in which it first came. Nulls and blanks say nothing.

Defined results: facts of equal place are taken by value; a section's own facts are not known before it; a section without earlier facts has only the lines
that are always there; documents without facts are known with defaults; equal rows count once; no rows give no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigraph.streaming.progress import shared_dir

LISTS = ("study_id", "adverse_event")
#: Plain fields that every section is told, with the words before them.
ALWAYS = {"indication": "Indication", "pivotal_study": "Pivotal study", "sponsor": "Sponsor"}
#: Plain fields that some sections are told.
CONFIRMED = {
    "Efficacy Outcomes": {"orr": "Response rate", "median_pfs": "Median PFS", "median_os": "Median OS"},
    "Safety and Adverse Events": {"dose_level": "Dose"},
    "Hepatotoxicity": {"dose_level": "Dose"},
    "Deaths and Serious Adverse Events": {"dose_level": "Dose"},
    "Pharmacokinetics": {"elimination_half_life": "Half-life", "plasma_protein_binding": "Protein binding", "metabolism_pathway": "Metabolism"},
    "Dose Modifications": {"dose_level": "Dose", "dose_schedule": "Schedule"},
    "Dosing Regimen": {"dose_level": "Dose", "dose_schedule": "Schedule"},
}
#: Sections that are told the adverse events so far.
EVENTS_TOLD = ("Safety and Adverse Events", "Hepatotoxicity", "Deaths and Serious Adverse Events")
MOST_EVENTS, MOST_SECTIONS = 10, 5
DIGEST_EVENTS, DIGEST_CHARACTERS = 20, 8000
FACT = "doc_id long, at long, section string, field string, value string"


def _said(facts: DataFrame) -> DataFrame:
    return facts.where("value IS NOT NULL AND trim(value) <> ''")


def first_appearances(facts: DataFrame, most: int = MOST_EVENTS) -> DataFrame:
    """(doc_id, study_ids, events): lists of (at, value) in the order in which they came; of events the first ``most``."""
    first = _said(facts).where(F.col("field").isin(*LISTS)).groupBy("doc_id", "field", "value").agg(F.min("at").alias("at"))
    place = W.partitionBy("doc_id", "field").orderBy("at", "value")
    kept = first.withColumn("rn", F.row_number().over(place)).where((F.col("field") != "adverse_event") | (F.col("rn") <= most))
    listed = lambda f: F.array_sort(F.collect_list(F.when(F.col("field") == f, F.struct("at", "value"))))
    return kept.groupBy("doc_id").agg(listed("study_id").alias("study_ids"), listed("adverse_event").alias("events"))


def first_values(facts: DataFrame, fields: list[str]) -> DataFrame:
    """(doc_id, a struct (at, value) for each field): where each plain field was first said."""
    rows = _said(facts).where(F.col("field").isin(*fields))
    return rows.groupBy("doc_id").agg(*[F.min(F.when(F.col("field") == f, F.struct("at", "value"))).alias(f) for f in fields])


def running_context(sections: DataFrame, facts: DataFrame, drug: str, drug_class: str = "class unknown") -> DataFrame:
    """(doc_id, at, section, context): of each section (doc_id, at, section) what the facts of earlier ones say, as lines of text.

    A document's lists and first values are gathered once and each section takes the part that stands before it, so nothing is gathered for
    each section."""
    fields = sorted({*ALWAYS, *(f for told in CONFIRMED.values() for f in told)})
    done = sections.groupBy("doc_id", "section").agg(F.min("at").alias("at"))
    done = done.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", F.col("section").alias("value")))).alias("done"))
    known = sections.select("doc_id", "at", "section").distinct()
    for state in (first_appearances(facts), first_values(facts, fields), done):
        known = known.join(state, "doc_id", "left")

    def before(c: str) -> Column:
        return F.transform(F.filter(F.coalesce(F.col(c), F.array().cast("array<struct<at: bigint, value: string>>")), lambda x: x["at"] < F.col("at")), lambda x: x["value"])

    def line(words: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{words}: "), value))

    def plain(f: str, words: str) -> Column:
        return line(words, F.when(F.col(f)["at"] < F.col("at"), F.col(f)["value"]))

    ids = F.array_join(before("study_ids"), ", ")
    lines = [F.lit(f"Drug: {drug} ({drug_class})"), plain("indication", ALWAYS["indication"]), F.concat(F.lit("Studies so far: "), F.when(ids != "", ids).otherwise("none yet"))]
    lines += [plain(f, ALWAYS[f]) for f in ("pivotal_study", "sponsor")]
    lines.append(F.when(F.col("section").isin(*EVENTS_TOLD), line("Adverse events so far", F.array_join(F.slice(before("events"), 1, MOST_EVENTS), ", "))))
    for f in fields:
        told = [s for s, own in CONFIRMED.items() if f in own]
        if told:
            words = next(own[f] for own in CONFIRMED.values() if f in own)
            lines.append(F.when(F.col("section").isin(*told), plain(f, f"Confirmed {words}")))
    earlier = before("done")
    lines.append(line("Sections done", F.array_join(F.slice(earlier, F.greatest(F.size(earlier) - MOST_SECTIONS + 1, F.lit(1)), MOST_SECTIONS), ", ")))
    return known.select("doc_id", "at", "section", F.concat_ws("\n", *lines).alias("context"))


def digests(facts: DataFrame, wanted: list[str], most_events: int = DIGEST_EVENTS, budget: int = DIGEST_CHARACTERS) -> DataFrame:
    """(doc_id, digest, entries): a JSON object of at most ``budget`` characters for each document: the first values of the wanted fields
    in that order, then its first events, as far as they fit; where not even the first fits, an object that says so."""
    said = _said(facts)
    plain = said.where(F.col("field").isin(*wanted)).groupBy("doc_id", "field").agg(F.min(F.struct("at", "value")).alias("x"))
    rank = F.array_position(F.array(*map(F.lit, wanted)), F.col("field"))
    entry = F.concat(F.to_json(F.array("field")).substr(F.lit(2), F.length(F.to_json(F.array("field"))) - 2), F.lit(":"), F.to_json(F.array("x.value")).substr(F.lit(2), F.length(F.to_json(F.array("x.value"))) - 2))
    events = said.where("field = 'adverse_event'").groupBy("doc_id", "value").agg(F.min("at").alias("at")).withColumn("rn", F.row_number().over(W.partitionBy("doc_id").orderBy("at", "value"))).where(F.col("rn") <= most_events)
    quoted = F.to_json(F.array("value"))
    rows = plain.select("doc_id", F.lit(False).alias("event"), rank.cast("long").alias("rank"), entry.alias("text")).unionByName(
        events.select("doc_id", F.lit(True).alias("event"), (F.col("rn") + len(wanted)).cast("long").alias("rank"), quoted.substr(F.lit(2), F.length(quoted) - 2).alias("text"))
    )
    frame = len('{,"adverse_events":[]}')
    order = W.partitionBy("doc_id").orderBy("rank")
    fits = rows.withColumn("size", F.sum(F.length("text") + 1).over(order)).where(F.col("size") + frame <= budget)
    part = lambda event: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("event") == event, F.struct("rank", "text")))), lambda x: x["text"]), ",")
    made = fits.groupBy("doc_id").agg(part(False).alias("p"), part(True).alias("e"), F.count("*").alias("entries"))
    digest = F.concat(F.lit("{"), "p", F.when((F.col("p") != "") & (F.col("e") != ""), ",").otherwise(""), F.when(F.col("e") != "", F.concat(F.lit('"adverse_events":['), "e", F.lit("]"))).otherwise(""), F.lit("}"))
    out = facts.select("doc_id").distinct().join(made, "doc_id", "left")
    return out.select("doc_id", F.coalesce(digest, F.lit('{"fallback":true}')).alias("digest"), F.coalesce("entries", F.lit(0).cast("long")).alias("entries"))


def told_by(digest: DataFrame) -> DataFrame:
    """(doc_id, context): a digest as lines for the next document's sections."""
    fields = F.map_entries(F.from_json("digest", "map<string,string>"))
    lines = F.transform(fields, lambda x: F.concat(F.replace(x["key"], F.lit("_"), F.lit(" ")), F.lit(": "), F.coalesce(x["value"], F.lit(""))))
    return digest.select("doc_id", F.concat(F.lit("Prior document: "), F.col("doc_id").cast("string"), F.lit("\n"), F.array_join(lines, "\n")).alias("context"))


class Ledger:
    """The facts of the sections that are done, as numbered tables in a folder: a table counts once Spark has committed it.

    A run takes the next sections of every document, with what is known before them, and writes their facts and that they are done as one
    table; so a run that stopped leaves whole tables, and the next one takes what they lack."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root or f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"

    def _tables(self) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        found = [s.getPath() for s in fs.listStatus(path)]
        return sorted(str(p) for p in found if p.getName().startswith("part=") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _rows(self) -> DataFrame:
        tables = self._tables()
        return self.spark.read.schema(FACT).parquet(*tables) if tables else self.spark.createDataFrame([], FACT)

    def facts(self) -> DataFrame:
        return self._rows().where("field IS NOT NULL")

    def done(self) -> DataFrame:
        return self._rows().select("doc_id", "at").distinct()

    def version(self) -> int:
        """How many tables there are; a snapshot is the first so many."""
        return len(self._tables())

    def snapshot(self, version: int) -> DataFrame:
        """The facts of the first tables."""
        tables = self._tables()[:version]
        return self.spark.read.schema(FACT).parquet(*tables).where("field IS NOT NULL") if tables else self.facts().limit(0)

    def run(self, sections: DataFrame, ask: Callable[[DataFrame], DataFrame], drug: str, at_once: int = 8, rounds: int | None = None) -> int:
        """Asks for the facts of what is left of ``sections`` (doc_id, at, section, ...), ``at_once`` sections of each document in a round; ``ask``
        gets them with ``context`` and gives facts. Returns how many rounds it took; ``rounds`` ends it early."""
        taken = 0
        while rounds is None or taken < rounds:
            left = sections.join(self.done(), ["doc_id", "at"], "left_anti")
            now = left.withColumn("_rn", F.row_number().over(W.partitionBy("doc_id").orderBy("at"))).where(F.col("_rn") <= at_once).drop("_rn")
            if now.isEmpty():
                break
            told = running_context(sections, self.facts(), drug).drop("section")
            found = ask(now.join(told, ["doc_id", "at"])).selectExpr("doc_id", "at", "section", "field", "value")
            marks = now.selectExpr("doc_id", "at", "section", "CAST(null AS STRING) AS field", "CAST(null AS STRING) AS value")
            found.unionByName(marks).write.mode("overwrite").parquet(f"{self.root}/part={self.version():06d}")
            taken += 1
        return taken
