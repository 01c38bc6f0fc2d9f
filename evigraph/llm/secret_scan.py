"""Secret scans with a trigram inverted index, in DataFrame functions only.

Each rule is a regular expression. A Boolean query over lower-cased trigrams is derived from it: every match contains the
trigrams of one of the query's clauses. The index holds a posting (document, trigram) for each trigram that some query names;
the postings of a document are intersected as a bitmap, and only documents that satisfy a rule's query are verified with the
expression itself. A rule without a mandatory trigram (``hex``) scans every text.

Defined results: a null text is empty; an empty text has no spans; rows with one doc_id (or null) are each judged on their own
text; extra columns are ignored by ``scan`` and kept by ``redact``. Spans are code points, end exclusive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.llm._spark import free_name


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: A match counts if this group has so many characters.
    group: int = 0
    least: int = 1


ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The base kinds in their order. For access and hex the least length is part of the expression: it selects the same matches.
BASE = (
    Rule("assign", ASSIGN, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: What the index adds to them.
EXTRA = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)
RULES = BASE + EXTRA
#: Strings that a part of an expression may stand for, before it counts as any string.
MOST_STRINGS = 64


def _finite(nodes) -> set[str] | None:
    """The strings that the nodes match, lower-cased, if they are few."""
    out = {""}
    for op, arg in nodes:
        if op is sre.LITERAL:
            part = {chr(arg).lower()}
        elif op is sre.IN:
            part = set()
            for kind, x in arg:
                if kind is sre.LITERAL:
                    part.add(chr(x).lower())
                elif kind is sre.RANGE and x[1] - x[0] < 8:
                    part |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    return None
        elif op is sre.SUBPATTERN:
            part = _finite(arg[3])
        elif op is sre.BRANCH:
            parts = [_finite(x) for x in arg[1]]
            part = None if None in parts else set().union(*parts)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] is not sre.MAXREPEAT and arg[1] <= 2:
            one = _finite(arg[2])
            part, power = (None, set()) if one is None else (set(), {""})
            for n in range(arg[1] + 1):
                if part is None or len(power) > MOST_STRINGS:
                    part = None
                    break
                if n >= arg[0]:
                    part |= power
                power = {a + b for a in power for b in one}
        elif op is sre.AT:
            continue
        else:
            return None
        if part is None or len(part) * len(out) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in part}
    return out


def _both(a: list[frozenset], b: list[frozenset]) -> list[frozenset]:
    both = {x | y for x in a for y in b}
    return a if len(both) > MOST_STRINGS else sorted((x for x in both if not any(y < x for y in both)), key=sorted)


def _of_strings(strings: set[str]) -> list[frozenset]:
    clauses = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    return [frozenset()] if frozenset() in clauses else sorted(clauses, key=sorted)


def _clauses(nodes) -> list[frozenset]:
    out, run = [frozenset()], []
    for node in [*nodes, None]:
        if node is not None and _finite([*run, node]) is not None:
            run.append(node)
            continue
        if run:
            out = _both(out, _of_strings(_finite(run)))
            run = []
        if node is None:
            break
        op, arg = node
        if _finite([node]) is not None:
            run = [node]
        elif op is sre.SUBPATTERN:
            out = _both(out, _clauses(arg[3]))
        elif op is sre.BRANCH:
            parts = [c for x in arg[1] for c in _clauses(x)]
            out = _both(out, [frozenset()] if frozenset() in parts else parts)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
            out = _both(out, _clauses(arg[2]))
    return out


def trigram_query(pattern: str) -> list[frozenset]:
    """The clauses of the query: a match contains all trigrams of one of them. [frozenset()]: no trigram is mandatory."""
    return _clauses(list(sre_parse.parse(pattern)))


def trigrams(rules=RULES) -> list[str]:
    return sorted({g for r in rules for c in trigram_query(r.pattern) for g in c})


def postings(docs: DataFrame, grams: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, gram): the inverted index, a posting for each of ``grams`` that a text holds in either case."""
    low = docs.select(F.col(key), F.lower(F.col(text)).alias("_low"))
    held = F.array_compact(F.array(*[F.when(F.contains(F.col("_low"), F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]))
    return low.select(key, F.explode(held).alias("gram"))


def candidates(docs: DataFrame, rules=RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_key, _rules): the rules whose trigram query the postings of a document satisfy, for documents with one at least."""
    grams = trigrams(rules)
    at = {g: i for i, g in enumerate(grams)}
    width = 62
    words = range((len(grams) + width - 1) // width)
    post = postings(docs, grams, key, text)
    masks = [F.bit_or(F.when(F.floor(F.col("gram") / width) == w, F.expr(f"shiftleft(1L, gram % {width})")).otherwise(F.lit(0).cast("long"))).alias(f"_m{w}") for w in words]
    bits = post.groupBy(F.col(key).alias("_key")).agg(*masks)
    named = []
    for r in rules:
        clauses = trigram_query(r.pattern)
        if clauses == [frozenset()]:
            continue
        any_of = F.lit(False)
        for c in clauses:
            all_of = F.lit(True)
            for w in words:
                need = sum(1 << (at[g] % width) for g in c if at[g] // width == w)
                if need:
                    all_of = all_of & (F.col(f"_m{w}").bitwiseAND(F.lit(need)) == need)
            any_of = any_of | all_of
        named.append(F.when(any_of, F.lit(r.kind)))
    found = bits.select("_key", F.array_compact(F.array(*named)).alias("_rules"))
    return found.where(F.size("_rules") > 0)


def _spans(rule: Rule, order: int, text: Column) -> Column:
    """array<struct<s, k, e>>: the rule's matches; starts from the lengths of the gaps between them."""
    p = F.lit(rule.pattern)
    pairs = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, p, F.lit(0)), F.length).alias("len"),
        F.transform(F.regexp_extract_all(text, p, F.lit(rule.group)), F.length).alias("val"),
    )
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    start = lambda acc, x: acc["at"] + x["gap"]
    return F.aggregate(
        pairs,
        F.struct(F.lit(0).alias("at"), none.alias("found")),
        lambda acc, x: F.when(
            x["len"].isNotNull(),
            F.struct(
                (start(acc, x) + x["len"]).alias("at"),
                F.when(x["val"] >= rule.least, F.concat(acc["found"], F.array(F.struct(start(acc, x).alias("s"), F.lit(order).alias("k"), (start(acc, x) + x["len"]).alias("e"))))).otherwise(acc["found"]).alias("found"),
            ),
        ).otherwise(acc),
        lambda acc: acc["found"],
    )


def with_spans(docs: DataFrame, rules=RULES, key: str = "doc_id", text: str = "text", spans: str = "_spans") -> DataFrame:
    """``docs`` and the column ``spans``, array<struct<s, k, e>> by start, then kind."""
    found = candidates(docs, rules, key, text).select(F.col("_key").alias(free_name(docs, "key")), F.col("_rules").alias(free_name(docs, "rules")))
    of, kinds = found.columns
    both = docs.join(found, docs[key].eqNullSafe(found[of]), "left").drop(of)
    body = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    parts = []
    for i, r in enumerate(rules):
        has = F.lit(True) if trigram_query(r.pattern) == [frozenset()] else F.array_contains(F.col(kinds), r.kind)
        # a cheap test first: most texts have no match
        parts.append(F.when(has & body.rlike(r.pattern), _spans(r, i, body)).otherwise(none))
    return both.withColumn(spans, F.array_sort(F.concat(*parts))).drop(kinds)


def _joined(spans: Column, rules) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"], x["e"])), ",")


def scan(docs: DataFrame, rules=RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    n_base = len(BASE)
    found = with_spans(docs.select(key, text), rules, key, text)
    base = F.filter("_spans", lambda x: x["k"] < n_base)
    counts = [F.expr(f"cast(size(filter(_spans, x -> x.k = {i})) as bigint) AS n_{r.kind}") for i, r in enumerate(BASE)]
    return found.select(F.col(key), *counts, F.sha2(_joined(base, rules), 256).alias("base_sha256"), _joined(F.col("_spans"), rules).alias("spans"))


def redact(docs: DataFrame, rules=RULES, mark: str = "[secret]", key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with each run of overlapping spans replaced by ``mark``; documents without a span stay as they are."""
    spans = free_name(docs, "spans")
    found = with_spans(docs, rules, key, text, spans)
    none = F.array().cast("array<string>")
    left = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), none.alias("kept")),
        lambda acc, x: F.when(x["s"] < acc["at"], F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["kept"].alias("kept"))).otherwise(
            F.struct(x["e"].alias("at"), F.concat(acc["kept"], F.array(F.substring(F.col(text), acc["at"] + 1, x["s"] - acc["at"]), F.lit(mark))).alias("kept"))
        ),
        lambda acc: F.concat(acc["kept"], F.array(F.substring(F.col(text), acc["at"] + 1, F.length(F.col(text))))),
    )
    return found.withColumn(text, F.when(F.size(spans) > 0, F.array_join(left, "")).otherwise(F.col(text))).drop(spans)


def _duck(rule: Rule) -> str:
    p = "'" + rule.pattern.replace("'", "''") + "'"
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, {p}, 0)) + 1), lambda i: {{
  's': list_sum(list_transform(regexp_split_to_array(t, {p})[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(regexp_extract_all(t, {p}, 0)[1:i - 1], lambda x: length(x))), 0)::BIGINT,
  'k': {{k}}, 'n': length(regexp_extract_all(t, {p}, 0)[i]), 'v': length(regexp_extract_all(t, {p}, {rule.group})[i])}}), lambda x: x.v >= {rule.least})"""


def oracle(rules=RULES) -> str:
    lists = ",\n".join(f"CASE WHEN regexp_matches(t, '{r.pattern.replace(chr(39), chr(39) * 2)}') THEN {_duck(r).replace('{k}', str(i))} ELSE [] END AS l{i}" for i, r in enumerate(rules))
    kinds = "[" + ", ".join(f"'{r.kind}'" for r in rules) + "]"
    text = f"array_to_string(list_transform(list_sort(%s), lambda x: {kinds}[x.k + 1] || ':' || x.s || ':' || (x.s + x.n)), ',')"
    cat = lambda n: "list_concat(" * (n - 1) + "l0" + "".join(f", l{i})" for i in range(1, n))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS (SELECT doc_id, {lists} FROM d)
SELECT doc_id, len(l0)::BIGINT AS n_assign, len(l1)::BIGINT AS n_access, len(l2)::BIGINT AS n_hex,
  sha256({text % cat(len(BASE))}) AS base_sha256, {text % cat(len(rules))} AS spans FROM m"""
