"""Answers about sections merged into one nested record a document, shaped and filled by a schema.

Answers are rows (doc_id, chunk_index, section, answer), the answer a JSON object with or without a fence. Each field goes to the part of the
record that its section fills (``rules.SECTION_KEYS``; some nonclinical fields to a part of their own, if one of that part says something; those of
a section without a part to the record itself). Fields are kept as variants until the schema says what they are.

Defined results, field by field over a document's answers in the order of chunk_index, section and answer: lists are united, each entry once, in the
order in which they came; a boolean is true if one is; of other values the first that says something stays, and if none does the last that is
there (blank or Not Found); structs are merged field by field. A value that the schema's type can't hold is left out, but a text field takes any as JSON.
What no answer gives is the field's default: its metadata ``default``, an empty list, or null. Fields that the schema doesn't name are in
``other``, by path. A document whose answers hold no object is all defaults; null answers count as such; no rows give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigraph.functions import rules
from evigraph.functions.cleaning import NOT_FOUND, lenient_json
from evigraph.operators.store import kept

RELATIONS = "semantic_relationships"


@dataclass(frozen=True)
class Leaf:
    """A field of the record that holds a value or a list: its part, its field there (None: the part is the field), and the path below."""

    part: str
    field: str | None
    below: tuple[str, ...]
    kind: T.DataType
    default: object

    @property
    def name(self) -> str:
        return ".".join([self.part, *([self.field] if self.field else []), *self.below])

    @property
    def path(self) -> str:
        return "$" + "".join(f"['{b}']" for b in self.below)

    def here(self) -> Column:
        return (F.col("part") == self.part) & (F.col("field") == self.field if self.field else F.col("field").isNull())


def leaves(schema: T.StructType) -> list[Leaf]:
    out: list[Leaf] = []

    def walk(names: tuple[str, ...], f: T.StructField) -> None:
        if isinstance(f.dataType, T.StructType):
            for g in f.dataType.fields:
                walk((*names, g.name), g)
        else:
            out.append(Leaf(names[0], names[1] if len(names) > 1 else None, names[2:], f.dataType, f.metadata.get("default")))

    for f in schema.fields:
        walk((f.name,), f)
    return out


def _mapped(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def _says(v: Column) -> Column:
    return v.isNotNull() & ~F.is_variant_null(v) & (F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("{}")) != NOT_FOUND)


def parts(answers: DataFrame) -> DataFrame:
    """(doc_id, at, part, field, value): where each field of each answer goes; value is a variant, at the place in the order."""
    read = answers.select("doc_id", F.struct("chunk_index", "section", "answer").alias("at"), "section", F.from_json(lenient_json("answer"), "map<string,variant>").alias("m"))
    own = lambda k: F.when(F.col("section") == "Nonclinical Toxicology", _mapped(k, rules.NONCLINICAL_FIELDS))
    full = F.transform(F.filter(F.map_entries("m"), lambda e: _says(e["value"])), lambda e: own(e["key"]))
    # first of each answer, then of its fields
    read = read.withColumn("full", F.when(F.col("section") == "Nonclinical Toxicology", full))
    rows = read.select("doc_id", "at", "section", "full", F.explode("m").alias("name", "value")).where(F.col("value").isNotNull() & ~F.is_variant_null("value"))
    rows = rows.withColumn("own", own(F.col("name"))).where("own IS NULL OR array_contains(full, own)")
    related = F.col("name") == RELATIONS
    part = F.when(related, F.lit(RELATIONS)).otherwise(F.coalesce("own", _mapped(F.col("section"), rules.SECTION_KEYS)))
    # relations come as a list or as an object with one
    listed = F.coalesce(F.try_variant_get("value", "$.relationships", "variant"), F.col("value"))
    field = F.when(related, F.lit("relationships")).otherwise(F.col("name"))
    named = rows.select("doc_id", "at", part.alias("part"), field.alias("field"), F.when(related, listed).otherwise(F.col("value")).alias("value"))
    # what has no part is one itself, an object its fields; all of it in one pass over the answers
    named = named.withColumn("m", F.when(F.col("part").isNull(), F.try_variant_get("value", "$", "map<string,variant>")))
    place = lambda p, f, v: F.struct(p.alias("part"), f.alias("field"), v.alias("value"))
    below = F.transform(F.map_entries("m"), lambda e: place(F.col("field"), e["key"], e["value"]))
    alone = F.array(place(F.coalesce("part", "field"), F.when(F.col("part").isNotNull(), F.col("field")), F.col("value")))
    out = named.select("doc_id", "at", F.explode(F.coalesce(below, alone)).alias("p")).select("doc_id", "at", "p.*")
    return out.where(F.col("value").isNotNull() & ~F.is_variant_null("value"))


def _scalar(leaf: Leaf) -> Column:
    kind = leaf.kind.simpleString()
    got = F.try_variant_get("value", leaf.path, kind)
    return F.coalesce(got, F.to_json(F.try_variant_get("value", leaf.path, "variant"))) if kind == "string" else got


def _any(found: list[Leaf]) -> Column:
    out = F.lit(False)
    for x in found:
        out |= x.here()
    return out


def nested_records(answers: DataFrame, schema: T.StructType) -> DataFrame:
    """(doc_id, record, other): one record of the schema for each document."""
    # read three times below, so the answers are taken apart once
    found, every = kept(parts(answers)), leaves(schema)
    names = {leaf: f"v{i}" for i, leaf in enumerate(every)}
    lists = [x for x in every if isinstance(x.kind, T.ArrayType)]
    scalars = [x for x in every if not isinstance(x.kind, T.ArrayType)]

    # values: one aggregate over all fields, combined before the exchange
    seen = found.where(_any(scalars)).select("doc_id", "at", *[F.when(x.here(), _scalar(x)).alias(names[x]) for x in scalars])
    aggs = []
    for x in scalars:
        c = F.col(names[x])
        if isinstance(x.kind, T.BooleanType):
            aggs.append(F.bool_or(c).alias(names[x]))
        else:
            real = c.isNotNull() & ~F.trim(c.cast("string")).isin("", NOT_FOUND)
            aggs.append(F.coalesce(F.min_by(F.when(real, c), F.when(real, F.col("at"))), F.max_by(c, F.when(c.isNotNull(), F.col("at")))).alias(names[x]))
    out = answers.select("doc_id").distinct()
    if aggs:
        out = out.join(seen.groupBy("doc_id").agg(*aggs), "doc_id", "left")

    # lists: entries as JSON, repeats dropped before they are gathered
    if lists:
        wanted = [F.struct(F.lit(x.name).alias("leaf"), F.when(x.here(), F.try_variant_get("value", x.path, "array<variant>")).alias("items")) for x in lists]
        entries = found.where(_any(lists)).select("doc_id", "at", F.explode(F.filter(F.array(*wanted), lambda x: x["items"].isNotNull())).alias("l")).select("doc_id", "at", "l.leaf", F.posexplode("l.items").alias("pos", "item"))
        entries = entries.select("doc_id", "leaf", F.struct("at", "pos").alias("o"), F.coalesce(F.to_json("item"), F.lit("null")).alias("item"))
        first = entries.groupBy("doc_id", "leaf", "item").agg(F.min("o").alias("o"))
        out = out.join(first.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("o", "leaf", "item"))).alias("lists")), "doc_id", "left")

    def built(names_: tuple[str, ...], f: T.StructField) -> Column:
        if isinstance(f.dataType, T.StructType):
            return F.struct(*[built((*names_, g.name), g).alias(g.name) for g in f.dataType.fields])
        leaf = next(x for x in every if x.name == ".".join(names_))
        if isinstance(f.dataType, T.ArrayType):
            own = F.filter("lists", lambda x: x["leaf"] == leaf.name)
            text = F.concat(F.lit("["), F.array_join(F.transform(own, lambda x: x["item"]), ","), F.lit("]"))
            return F.coalesce(F.from_json(text, f.dataType), F.array().cast(f.dataType))
        return F.coalesce(F.col(names[leaf]), F.lit(leaf.default).cast(f.dataType))

    # what the schema has no place for
    name = F.concat_ws(".", "part", "field")
    rest = found.where(~F.coalesce(_any(every), F.lit(False))).groupBy("doc_id", name.alias("name")).agg(F.min_by(F.to_json("value"), "at").alias("text"))
    rest = rest.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "text")))).alias("other"))
    record = F.struct(*[built((f.name,), f).alias(f.name) for f in schema.fields])
    return out.join(rest, "doc_id", "left").select("doc_id", record.alias("record"), F.coalesce("other", F.create_map().cast("map<string,string>")).alias("other"))
