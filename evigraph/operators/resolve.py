"""Entity resolution and grounding in vocabularies."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigraph.functions import rules
from evigraph.functions.cleaning import title
from evigraph.operators.store import kept

_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 -"


def _letters(c: str) -> Column:
    """How often each character stands in a text; all others count as one."""
    t = F.col(c)
    counts = [F.length(t) - F.length(F.replace(t, F.lit(x), F.lit(""))) for x in _LETTERS]
    return F.array(*counts, F.length(F.translate(t, _LETTERS, "")))


def resolve_exact(names: DataFrame, known: DataFrame, name: str = "name", by: tuple[str, ...] = ()) -> DataFrame:
    """``names`` with the known name that is the same without case and space around (the first by seq), or null. Columns ``by`` agree."""
    k = known.groupBy(*by, F.lower(F.trim("known")).alias("_k")).agg(F.min_by("known", "seq").alias("match"))
    return names.withColumn("_k", F.lower(F.trim(name))).join(k, [*by, "_k"], "left").drop("_k")


def _indexed(names: DataFrame, text: str, threshold: float, by: tuple[str, ...], counts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(postings, counts): for each text its rarest pairs of neighbouring characters, enough that two texts with the ratio share one.

    Matches are th * T / 2 of the T characters of both at least, in blocks that an unmatched character parts, so T * (1.5 th - 1) - 1 pairs
    of characters are common; repeats of a pair are numbered. Texts too short for one common pair are posted under an empty one as well."""
    t = F.col(text)
    pairs = F.when(F.length(t) > 1, F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: t.substr(i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    numbered = F.transform(pairs, lambda x, i: F.concat(x, F.size(F.filter(F.slice(pairs, F.lit(1), i + 1), lambda y: y == x)).cast("string")))
    least = F.ceil(F.length(t) * (1 + threshold / (2 - threshold)) * (1.5 * threshold - 1) - 1 - 1e-9)
    own = names.select(*by, text).distinct().withColumn("_p", numbered).withColumn("_need", F.size("_p") - F.greatest(least, F.lit(1)) + 1).withColumn("_short", least < 1)
    every = own.select(*by, text, "_need", F.explode(F.when(F.col("_short"), F.concat("_p", F.array(F.lit("")))).otherwise(F.col("_p"))).alias("_g"))
    counts = every.groupBy("_g").agg(F.count("*").alias("_many")) if counts is None else counts
    rare = W.partitionBy(*by, text).orderBy(F.col("_g") != "", F.coalesce("_many", F.lit(0)), "_g")
    ranked = every.join(counts, "_g", "left").withColumn("_rn", F.row_number().over(rare))
    return ranked.where("_rn <= _need OR _g = ''").select(*by, text, "_g"), counts


def _scored(q: DataFrame, k: DataFrame, threshold: float, numeric_guard: bool, by: tuple[str, ...]) -> DataFrame:
    """(*by, q, k, score) of texts q and other texts k, lower-cased and trimmed, with at least the threshold."""
    listed, counts = _indexed(k, "k", threshold, by)
    asked, _ = _indexed(q, "q", threshold, by, counts)
    pairs = asked.join(listed, [*by, "_g"]).where("q <> k").select(*by, "q", "k").distinct()
    far = threshold / (2 - threshold)
    near = pairs.where((F.length("k") >= F.length("q") * far - 1e-9) & (F.length("q") >= F.length("k") * far - 1e-9))
    if numeric_guard:
        near = near.where(F.regexp_replace("q", "[^0-9]", "") == F.regexp_replace("k", "[^0-9]", ""))
    common = F.aggregate(F.zip_with(_letters("q"), _letters("k"), lambda a, b: F.least(a, b)), F.lit(0), lambda a, x: a + x)
    near = near.where(2 * common >= threshold * (F.length("q") + F.length("k")) - 1e-9)

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            s = []
            for a, b in zip(p["q"], p["k"]):
                m = SequenceMatcher(None, a, b)
                s.append(m.ratio() if m.real_quick_ratio() >= threshold and m.quick_ratio() >= threshold else 0.0)
            yield p.assign(score=s).query("score >= @threshold")

    kinds = dict(q.dtypes)
    return near.mapInPandas(score, "".join(f"`{c}` {kinds[c]}, " for c in by) + "q string, k string, score double")


def _plain(c: str) -> Column:
    return F.lower(F.trim(c))


def similar(names: DataFrame, known: DataFrame, threshold: float = 0.85, numeric_guard: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, name, known, score): all pairs of a name and a known one with at least ``threshold``; the same but for case and space around is 1."""
    q = names.select(*by, "name", _plain("name").alias("q")).where("q IS NOT NULL").distinct()
    k = known.select(*by, "known", _plain("known").alias("k")).where("k IS NOT NULL").distinct()
    same = q.join(k.withColumn("q", F.col("k")), [*by, "q"]).select(*by, "name", "known", F.lit(1.0).alias("score"))
    found = _scored(q.select(*by, "q").distinct(), k.select(*by, "k").distinct(), threshold, numeric_guard, by)
    return same.unionByName(q.join(found, [*by, "q"]).join(k, [*by, "k"]).select(*by, "name", "known", "score"))


def resolve_fuzzy(names: DataFrame, known: DataFrame, threshold: float = 0.85, numeric_guard: bool = False, name: str = "name", by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, name, match, score): each distinct name's best known name of at least ``threshold``, exact ones with 1. Names meet
    only known names with equal columns ``by``, such as those of their document.

    The score is that of difflib's SequenceMatcher on lower-cased, trimmed names; ties go to the smaller seq. Candidates share one of
    the rare pairs of characters that two names of that score must share, and have lengths and characters that allow it; they
    are scored in Arrow batches. With ``numeric_guard`` names with different digits never match.
    """
    q = names.select(*by, F.col(name).alias("name")).where(F.col("name").isNotNull()).distinct()
    exact = resolve_exact(q, known, by=by)
    done = exact.where("match IS NOT NULL").select(*by, "name", "match", F.lit(1.0).alias("score"))
    rest = exact.where("match IS NULL").select(*by, "name", _plain("name").alias("q"))
    k = known.groupBy(*by, _plain("known").alias("k")).agg(F.min_by("known", "seq").alias("known"), F.min("seq").alias("seq"))
    found = _scored(rest.select(*by, "q").distinct(), k.select(*by, "k"), threshold, numeric_guard, by).join(k, [*by, "k"])
    best = found.groupBy(*by, "q").agg(F.max_by("known", F.struct("score", -F.col("seq"))).alias("match"), F.max("score").alias("score"))
    return done.unionByName(rest.join(best, [*by, "q"]).select(*by, "name", "match", "score"))


def resolve_in_turn(uses: DataFrame, known: DataFrame, new_kind: Column, new_id: Column, by: str = "doc_id", threshold: float = 0.85, numeric_guard: bool = False) -> tuple[DataFrame, DataFrame]:
    """Names resolved one after another, where a name that nothing resembles becomes known to those after it.

    ``uses`` (by, name, at) are mentions in the order of ``at``, ``known`` (by, id, name, seq) what is there before them; ``new_kind`` and
    ``new_id`` say of a column ``name`` which kind and id a new one has (no kind: it becomes nothing). A mention takes the best known name
    of at least ``threshold`` (1 where they are the same but for case and space around; of equal ones the first that came); if there is
    none, it is its new id, and known from then on unless that id is.

    Returns (uses with id, made): made (by, id, name, kind, at) are the new ones. All keys meet at once: of the names that may be new, those
    without an earlier one they resemble are, what resembles them is not, and the rest is looked at again, so the rounds are as many as the
    longest chain of names that resemble the next. Null names have no id; mentions of one place are taken by name.
    """
    first = kept(uses.where("name IS NOT NULL").groupBy(by, "name").agg(F.min("at").alias("first")).withColumn("kind", new_kind).withColumn("new", F.when(F.col("kind").isNotNull(), new_id)))
    there = known.groupBy(by, "name").agg(F.min_by("id", "seq").alias("id"), F.min("seq").alias("seq"))
    words = there.select(by, F.col("name").alias("known")).union(first.where("kind IS NOT NULL").select(by, "name")).distinct()
    alike = kept(similar(first.select(by, "name"), words, threshold, numeric_guard, (by,)))
    old = kept(alike.join(there.withColumnRenamed("name", "known"), [by, "known"]).select(by, "name", "score", "id", "seq"))
    open_ = first.where("kind IS NOT NULL").join(old.select(by, "name").distinct(), [by, "name"], "left_anti")
    open_ = kept(open_.join(known.select(by, F.col("id").alias("new")).distinct(), [by, "new"], "left_anti").select(by, "name", "first", "kind", "new"))
    # pairs of which the second can't be new if the first is
    a, b = open_.alias("a"), open_.alias("b")
    earlier = F.struct("a.first", "a.name") < F.struct("b.first", "b.name")
    close = alike.alias("x").join(a, (F.col(f"x.{by}") == F.col(f"a.{by}")) & (F.col("x.known") == F.col("a.name"))).join(b, (F.col(f"x.{by}") == F.col(f"b.{by}")) & (F.col("x.name") == F.col("b.name")))
    same = a.join(b, (F.col(f"a.{by}") == F.col(f"b.{by}")) & (F.col("a.new") == F.col("b.new")))
    pairs = kept(close.where(earlier).select(F.col(f"a.{by}").alias(by), F.col("a.name").alias("head"), F.col("b.name").alias("name")).union(same.where(earlier).select(f"a.{by}", "a.name", "b.name")).distinct())
    made, left = [], open_
    while True:
        heads = kept(left.join(pairs.select(by, "name").distinct(), [by, "name"], "left_anti"))
        made.append(heads)
        if pairs.isEmpty():
            break
        gone = pairs.join(heads.select(by, F.col("name").alias("head")), [by, "head"], "left_semi").select(by, "name").distinct()
        left = kept(left.join(heads.select(by, "name").union(gone), [by, "name"], "left_anti"))
        stays = left.select(by, "name")
        pairs = kept(pairs.join(stays, [by, "name"], "left_semi").join(stays.withColumnRenamed("name", "head"), [by, "head"], "left_semi"))
    new = made[0]
    for more in made[1:]:
        new = new.unionByName(more)
    new = kept(new.select(by, F.col("new").alias("id"), "name", "kind", F.col("first").alias("at")))
    # what a mention may take: the known, and the new ones from before it
    late = alike.join(new.select(by, F.col("name").alias("known"), "id", F.col("at").alias("since")), [by, "known"]).select(by, "name", "score", "id", F.col("since").alias("seq"), "since")
    choices = old.withColumn("since", F.lit(None).cast(dict(uses.dtypes)["at"])).withColumn("fresh", F.lit(0)).unionByName(late.withColumn("fresh", F.lit(1)))
    taken = uses.join(choices, [by, "name"]).where("since IS NULL OR since < at").groupBy(by, "name", "at").agg(F.min_by("id", F.struct(-F.col("score"), "fresh", "seq", "id")).alias("id"))
    out = uses.join(taken, [by, "name", "at"], "left").join(first.select(by, "name", "new"), [by, "name"], "left")
    return out.withColumn("id", F.coalesce("id", "new")).drop("new"), new


def answered_queries(answers: DataFrame, fields: dict[str, str], query: str = "query") -> DataFrame:
    """``answers`` with field: that of the first asked query (in the order of ``fields``, query -> field) which is the same but for case
    and white space around; answers to other queries, and null ones, are left out."""
    plain = lambda c: F.lower(F.trim(c, F.lit(" \t\n\r\x0b\x0c")))
    first: dict[str, str] = {}
    for asked, field in fields.items():
        first.setdefault(asked.strip().lower(), field)
    if not first:
        return answers.withColumn("field", F.lit(None).cast("string")).limit(0)
    names = F.create_map(*[F.lit(x) for kv in first.items() for x in kv])
    return answers.withColumn("field", names[plain(F.col(query))]).where("field IS NOT NULL")


def ground(df: DataFrame, term: str, category: str) -> DataFrame:
    """``df`` with grounded and grounding_confidence.

    Events: exact 1.0, a known term inside 0.8 (the longest, then the first by alphabet), else 0.3. Targets: 1.0 or 0.4. Biomarkers:
    1.0 or 0.5. Anything else 0.5. Null terms stay null with 0.
    """
    low, up = F.lower(F.trim(term)), F.upper(F.trim(term))
    raw = F.col(term)
    inside = None
    for w in sorted(rules.KNOWN_EVENTS, key=lambda x: (-len(x), x)):
        hit = F.contains(low, F.lit(w))
        inside = F.when(hit, F.lit(w)) if inside is None else inside.when(hit, F.lit(w))
    if category == "Adverse Event":
        known = low.isin(rules.KNOWN_EVENTS)
        grounded, conf = F.when(known, title(low)).when(inside.isNotNull(), title(inside)).otherwise(raw), F.when(known, 1.0).when(inside.isNotNull(), 0.8).otherwise(0.3)
    elif category == "Target":
        known = up.isin(rules.KNOWN_TARGETS)
        grounded, conf = F.when(known, up).otherwise(raw), F.when(known, 1.0).otherwise(0.4)
    elif category == "Biomarker":
        known = low.isin(rules.KNOWN_BIOMARKERS)
        grounded, conf = F.when(known, up).otherwise(raw), F.when(known, 1.0).otherwise(0.5)
    else:
        grounded, conf = raw, F.lit(0.5)
    blank = raw.isNull() | (raw == "")
    return df.withColumn("grounded", F.when(~blank, grounded)).withColumn("grounding_confidence", F.when(blank, 0.0).otherwise(conf))


def ground_in(df: DataFrame, term: str, vocabulary: list[str]) -> Column:
    """The longest entry of a fixed list that stands in the term, then the first by alphabet; null if none does."""
    out = None
    for w in sorted(vocabulary, key=lambda x: (-len(x), x)):
        hit = F.contains(F.lower(F.col(term)), F.lit(w))
        out = F.when(hit, F.lit(w)) if out is None else out.when(hit, F.lit(w))
    return out


def lookup_chain(df: DataFrame, key: str, index: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """``df`` with target: by the exact key, else by the key without white space, else the chunk that holds the key most often (the
    smallest target of equal ones); ``index`` has ref and target, ``chunks`` target and content. Blank keys find no chunk."""
    exact = index.groupBy(F.col("ref").alias("_r")).agg(F.min("target").alias("_t1"))
    plain = index.groupBy(F.regexp_replace("ref", r"\s+", "").alias("_p")).agg(F.min("target").alias("_t2"))
    k = F.lower(F.trim(key))
    out = df.join(exact, k == F.col("_r"), "left").join(plain, F.regexp_replace(k, r"\s+", "") == F.col("_p"), "left")
    out = out.withColumn("target", F.coalesce("_t1", "_t2")).drop("_r", "_p", "_t1", "_t2")
    if chunks is None:
        return out
    best = _most_named(out.where("target IS NULL").select(F.lower(key).alias("_w")).where("trim(_w) <> ''").distinct(), chunks)
    out = out.join(best, F.lower(key) == F.col("_w"), "left")
    return out.withColumn("target", F.coalesce("target", "_t3")).drop("_w", "_t3")


def _most_named(words: DataFrame, chunks: DataFrame) -> DataFrame:
    """(_w, _t3): the chunk with most occurrences of each word. Candidates share the word's last three characters (or all it has)."""
    low = chunks.select(F.col("target").alias("_t3"), F.lower("content").alias("_c"))
    grams = [low.where(F.length("_c") >= n).select("_t3", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("_c") - (n - 1)), lambda i, n=n: F.col("_c").substr(i, F.lit(n))))).alias("_g")) for n in (1, 2, 3)]
    posts = grams[0].union(grams[1]).union(grams[2])
    near = words.withColumn("_g", F.expr("right(_w, 3)")).join(posts, "_g").select("_w", "_t3").distinct()
    n = (F.length("_c") - F.length(F.replace("_c", F.col("_w"), F.lit("")))) / F.length("_w")
    found = near.join(low, "_t3").select("_w", "_t3", n.alias("_n")).where("_n > 0")
    return found.groupBy("_w").agg(F.min_by("_t3", F.struct(-F.col("_n"), "_t3")).alias("_t3"))


def uniquify(df: DataFrame, name: str, order: list[str], width: int = 31, room: int = 25) -> DataFrame:
    """``df`` with sheet: the name cut to ``width``; the second and later of one name are cut to ``room`` and get a number."""
    cut = F.substring(F.col(name), 1, width)
    rn = F.row_number().over(W.partitionBy(cut).orderBy(*order))
    return df.withColumn("sheet", F.when(rn == 1, cut).otherwise(F.concat(F.substring(F.col(name), 1, room), F.lit("_"), (rn - 1).cast("string"))))
