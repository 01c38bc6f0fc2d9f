"""Missing values, parsing of messy cells, and small value expressions. All are functions of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigraph.functions import rules

NOT_FOUND = "Not Found"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_value(c: Column | str) -> Column:
    """Trimmed text, or null for null, blank, nan and infinite values."""
    t = F.trim(col(c).cast("string"))
    return F.when(~F.lower(t).isin("", "nan", "inf", "-inf", "infinity", "-infinity"), t)


def drop_null_entries(m: Column | str) -> Column:
    """A map without entries whose value is null."""
    return F.map_filter(col(m), lambda _, v: v.isNotNull())


def is_empty(c: Column | str) -> Column:
    """Whether a value counts as empty when results are compared."""
    return F.coalesce(F.lower(F.trim(col(c).cast("string"))), F.lit("")).isin(rules.EMPTY_TEXTS)


def not_found(c: Column | str) -> Column:
    """``Not Found`` for null, blank and "none"."""
    t = col(c).cast("string")
    return F.when(t.isNull() | F.lower(F.trim(t)).isin("", "none"), F.lit(NOT_FOUND)).otherwise(t)


def fill_not_found(df: DataFrame, keep_null: tuple[str, ...] = ()) -> DataFrame:
    """Every string leaf of every column, in structs and arrays too, by ``not_found``, but for fields in ``keep_null``."""

    def walk(c: Column, kind: T.DataType, name: str) -> Column:
        if name in keep_null:
            return c
        if isinstance(kind, T.StringType):
            return not_found(c)
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[walk(c[f.name], f.dataType, f.name).alias(f.name) for f in kind.fields]))
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: walk(x, kind.elementType, name))
        return c

    return df.select(*[walk(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) for f in df.schema.fields])


def leaves(schema: T.StructType, depth: int = 5) -> list[tuple[str, T.DataType]]:
    """Paths of the fields that are no struct, ``depth`` levels deep."""
    out = []
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType) and depth > 1:
            out += [(f"{f.name}.{p}", k) for p, k in leaves(f.dataType, depth - 1)]
        else:
            out.append((f.name, f.dataType))
    return out


def has_content(path: str, kind: T.DataType) -> Column:
    """Whether a leaf holds something: lists and maps with entries, texts that are not blank or Not Found."""
    c = F.col(path)
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    if isinstance(kind, T.StringType):
        return F.coalesce((F.trim(c) != "") & (c != NOT_FOUND), F.lit(False))
    return c.isNotNull()


def count_fields(schema: T.StructType, depth: int = 5) -> Column:
    """How many leaves of a row hold something."""
    return sum((has_content(p, k).cast("int") for p, k in leaves(schema, depth)), F.lit(0))


def count_not_found(schema: T.StructType) -> Column:
    """How many leaves of a row are Not Found, entries of lists included."""
    one = lambda p, k: (
        F.coalesce(F.size(F.filter(F.col(p), lambda x: x == NOT_FOUND)), F.lit(0))
        if isinstance(k, T.ArrayType) and isinstance(k.elementType, T.StringType)
        else F.coalesce((F.col(p) == NOT_FOUND).cast("int"), F.lit(0))
    )
    return sum((one(p, k) for p, k in leaves(schema, 99) if isinstance(k, (T.StringType, T.ArrayType))), F.lit(0))


def digits(c: Column | str) -> Column:
    """The digits and points of a text, null if none."""
    d = F.regexp_replace(col(c), "[^0-9.]", "")
    return F.when(d != "", d)


def numeric_equal(a: Column | str, b: Column | str) -> Column:
    """Equal without case and space around, or with the same digits: 50 mg is 50."""
    x, y = (F.lower(F.trim(F.coalesce(col(v).cast("string"), F.lit("")))) for v in (a, b))
    return (x == y) | F.coalesce((x != "") & (y != "") & (digits(x) == digits(y)), F.lit(False))


def safe_int(c: Column | str) -> Column:
    """The integer, or 0 for anything else."""
    return F.coalesce(F.try_cast(col(c), "int") if hasattr(F, "try_cast") else col(c).try_cast("int"), F.lit(0))


def marker_value(c: Column | str) -> Column:
    """The number before significance stars; null if there is none."""
    return F.regexp_replace(F.trim(col(c).cast("string")), r"\*+$", "").try_cast("double")


def marker_label(c: Column | str) -> Column:
    """What the stars say."""
    t = F.trim(col(c).cast("string"))
    return F.when(t.endswith("***"), "p<0.001").when(t.endswith("**"), "p<0.01").when(t.endswith("*"), "p<0.05").otherwise("")


def severity_pairs(c: Column | str) -> Column:
    """array<struct<count, grade>> of notations such as ``2c,1d``; a to d are 1 to 4, p (present) is 0."""
    p = F.lit(r"(\d+)\s*([a-dp])")
    pairs = F.arrays_zip(F.regexp_extract_all(col(c), p, F.lit(1)).alias("n"), F.regexp_extract_all(col(c), p, F.lit(2)).alias("g"))
    return F.transform(pairs, lambda x: F.struct(x["n"].cast("int").alias("count"), F.when(x["g"] == "p", 0).otherwise(F.ascii(x["g"]) - 96).alias("grade")))


def incidence(c: Column | str) -> Column:
    return F.aggregate(severity_pairs(c), F.lit(0), lambda a, x: a + x["count"])


def most_severe(c: Column | str) -> Column:
    return F.array_max(F.transform(severity_pairs(c), lambda x: x["grade"]))


def parameter_cycle(c: Column | str, recovered: str = "Alanine Aminotransferase") -> tuple[Column, Column]:
    """(parameter, cycle) of ``ALT Cycle 2``; a row of the recovery period is of ``recovered`` in the cycle Recovery."""
    t = F.trim(col(c))
    p = r"^(.+?)\s+Cycle\s+(\d+)"
    name, cycle = F.regexp_extract(t, p, 1), F.regexp_extract(t, p, 2)
    recovery = F.contains(t, F.lit("Recovery"))
    return (
        F.when(name != "", F.trim(name)).when(recovery, F.lit(recovered)).otherwise(t),
        F.when(cycle != "", cycle).when(recovery, F.lit("Recovery")).otherwise(""),
    )


def organ_lesion(c: Column | str) -> tuple[Column, Column]:
    """(organ, lesion) split at the first dash."""
    parts = F.split(F.trim(col(c)), r"\s*[-–]\s*", 2)
    return parts[0], F.coalesce(F.get(parts, F.lit(1)), parts[0])


def dose_per_area(dose: Column | str, species: Column | str) -> Column:
    """mg/m2 from mg/kg, to one decimal."""
    factor = F.create_map(*[F.lit(x) for kv in rules.KM_FACTORS.items() for x in kv])
    return half_up(col(dose) * factor[col(species)], 1)


def half_up(c: Column, places: int) -> Column:
    """Rounded half up, in the same way in every engine."""
    f = 10**places
    return F.floor(c * f + 0.5) / f


def joined(c: Column | str, kind: T.DataType) -> Column:
    """A dense text of a value: lists by commas, maps as ``key: value`` without empty ones."""
    c = col(c)
    if isinstance(kind, T.ArrayType):
        return F.array_join(F.transform(c, lambda x: x.cast("string")), ", ")
    if isinstance(kind, T.MapType):
        full = F.map_entries(F.map_filter(c, lambda _, v: ~is_empty(v)))
        return F.array_join(F.transform(full, lambda e: F.concat(e["key"], F.lit(": "), e["value"].cast("string"))), ", ")
    return c.cast("string")


def title(c: Column | str) -> Column:
    """Capitals after every character that is no letter, as in Palmar-Plantar."""
    parts = F.regexp_extract_all(F.lower(col(c)), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))), "")


def pretty_header(c: Column | str, names: dict[str, str] | None = None) -> Column:
    """A column's heading: its display name, else its words with capitals."""
    plain = title(F.replace(col(c), F.lit("_"), F.lit(" ")))
    if not names:
        return plain
    return F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[col(c)], plain)


def lenient_json(c: Column | str) -> Column:
    """The JSON object of an answer, with or without a fence and words around it; null if there is none."""
    plain = F.when(F.contains(col(c), F.lit("```")), F.regexp_replace(col(c), r"```(?:json)?", "")).otherwise(col(c))
    return F.nullif(F.regexp_extract(plain, r"(?s)(\{.*\})", 1), F.lit(""))


def stable_id(kind: str, *keys: Column | str) -> Column:
    """``kind_`` and 16 hex digits of the SHA-256 of kind and the keys that are not blank."""
    parts = [F.when(col(k).cast("string") != "", col(k).cast("string")) for k in keys]
    return F.concat(F.lit(f"{kind}_"), F.substring(F.sha2(F.concat_ws(":", F.lit(kind), *parts).cast("binary"), 256), 1, 16))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity of two arrays of numbers; 0 for a vector of length 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    a, b = col(a), col(b)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.when(a.isNotNull() & b.isNotNull(), 0.0))


def mean_vector(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: (x + y) / 2)


def token_estimate(c: Column | str) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(col(c)) / 4)


def override(base: Column | str, by: Column | str) -> Column:
    """``by`` where it says something, else ``base``."""
    b = col(by).cast("string")
    return F.coalesce(F.when(b != "", b), col(base).cast("string"))


def rule_score(start: int, step: int, most: int, n: Column | str) -> Column:
    """start + step * n, at most ``most``."""
    return F.least(F.lit(start) + F.lit(step) * col(n), F.lit(most))


def field_rate(fields: Column | str, sections: Column | str) -> Column:
    """Fields over four for each section, at most 1."""
    return F.least(F.lit(1.0), col(fields) / (F.greatest(F.lit(1), col(sections)) * 4))


def negative_to_null(c: Column | str) -> Column:
    return F.when(col(c) >= 0, col(c))
