"""Merging partial records in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigraph.functions.cleaning import NOT_FOUND


def first_value(value: str, order: str, unless: Column | None = None) -> Column:
    """Aggregate: the value of the first row where it says something."""
    v = F.col(value)
    blank = v.isNull() if unless is None else v.isNull() | F.coalesce(unless, F.lit(False))
    return F.min_by(F.when(~blank, v), F.when(~blank, F.col(order)))


def union_in_order(value: str, order: str) -> Column:
    """Aggregate: the entries of lists, each once, in the order of their first rows."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.col(value).alias("_v"))))
    return F.array_distinct(F.flatten(F.transform(F.filter(rows, lambda x: x["_v"].isNotNull()), lambda x: x["_v"])))


def distinct_in_order(value: str, order: str) -> Column:
    """Aggregate: the values, each once, in the order in which they first came."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.col(value).alias("_v"))))
    return F.array_distinct(F.transform(F.filter(rows, lambda x: x["_v"].isNotNull()), lambda x: x["_v"]))


def distinct_by_key(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """(*keys, value): the values of each key as a list, each once, in the order in which they first came; nulls are left out.
    Repeats are dropped before anything is collected, so a key gathers its distinct values, not its rows."""
    first = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(order).alias("_o"))
    listed = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_o", F.col(value).alias("_v")))).alias("_l"))
    every = df.select(*keys).distinct().alias("k").join(listed.alias("l"), [F.col(f"k.{k}").eqNullSafe(F.col(f"l.{k}")) for k in keys], "left")
    return every.select(*[F.col(f"k.{k}").alias(k) for k in keys], F.coalesce(F.transform("_l", lambda x: x["_v"]), F.array().cast(f"array<{dict(df.dtypes)[value]}>")).alias(value))


def union_by_key(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """(*keys, value): the entries of each key's lists, each once, by the order of their lists (of one order, by the lists) and their
    places in them."""
    entries = df.select(*keys, F.col(order).alias("_r"), F.col(value).alias("_s"), F.posexplode_outer(value).alias("_i", value))
    return distinct_by_key(entries.select(*keys, value, F.struct("_r", "_s", "_i").alias("_p")), keys, value, "_p")


def merge_records(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One record of each key from partial ones, field by field, from the schema alone.

    Lists are united in order without repeats; booleans are true if one is; of other values the first that is not null, blank or
    Not Found stays; structs are merged field by field.
    """
    names: list[tuple[str, T.DataType]] = [(f.name, f.dataType) for f in df.schema.fields if f.name not in [*keys, order]]
    flat, aggs, back = [], [], []

    def walk(path: str, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            return F.struct(*[walk(f"{path}.{f.name}", f.dataType).alias(f.name) for f in kind.fields])
        name = f"_v{len(flat)}"
        flat.append(F.col(path).alias(name))
        if isinstance(kind, T.ArrayType):
            aggs.append(union_in_order(name, order).alias(name))
        elif isinstance(kind, T.BooleanType):
            aggs.append(F.bool_or(name).alias(name))
        elif isinstance(kind, T.StringType):
            aggs.append(first_value(name, order, (F.trim(name) == "") | (F.col(name) == NOT_FOUND)).alias(name))
        else:
            aggs.append(first_value(name, order).alias(name))
        return F.col(name)

    for name, kind in names:
        back.append(walk(name, kind).alias(name))
    return df.select(*keys, order, *flat).groupBy(*keys).agg(*aggs).select(*keys, *back)


def overriding(base: DataFrame, by: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """``base`` with each field of ``fields`` (path in base -> column of ``by``) replaced where ``by`` says something."""
    b = by.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(fields.values())])
    out = base.join(b, F.col(key) == F.col("_key"), "left")
    for i, path in enumerate(fields):
        new = F.when(F.col(f"_o{i}").cast("string") != "", F.col(f"_o{i}"))
        top, _, rest = path.partition(".")
        value = F.coalesce(new, F.col(path))
        out = out.withColumn(top, F.col(top).withField(rest, value) if rest else value)
    return out.drop("_key", *[f"_o{i}" for i in range(len(fields))])


def scratchpad(facts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The state after all rows (section, study_id, drug, event): first drug, distinct ids and events in order, rows and sections."""
    return facts.groupBy(*keys).agg(
        first_value("drug", order, F.trim("drug") == "").alias("drug"),
        distinct_in_order("study_id", order).alias("study_ids"),
        distinct_in_order("event", order).alias("events"),
        distinct_in_order("section", order).alias("sections"),
        F.count("*").alias("rows"),
    )


def last_entries(c: Column, k: int) -> Column:
    """The last k entries of a list, all of a shorter one."""
    return F.slice(c, F.greatest(F.size(c) - k + 1, F.lit(1)), k)


def prior_context(state: DataFrame) -> DataFrame:
    """``state`` with ``context``: what is known, as text for the next section."""
    line = lambda head, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{head}: "), c))
    return state.withColumn(
        "context",
        F.concat_ws(
            "\n",
            line("Drug", F.col("drug")),
            line("Studies", F.array_join("study_ids", ", ")),
            line("Adverse events", F.array_join(F.slice("events", 1, 10), ", ")),
            line("Recent sections", F.array_join(last_entries(F.col("sections"), 5), ", ")),
        ),
    )
