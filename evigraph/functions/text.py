"""Chunks, section labels, regular-expression cascades and references in texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions import rules
from evigraph.functions.cleaning import col


def contains_any(c: Column | str, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(col(c), F.lit(w))
    return out


def cascade(c: Column, choices: list[tuple[Column, str]], default: Column | str | None) -> Column:
    """The label of the first condition that holds."""
    out = F.when(choices[0][0], choices[0][1])
    for cond, label in choices[1:]:
        out = out.when(cond, label)
    return out.otherwise(default)


def header_section(c: Column | str, lowered: bool = False) -> Column:
    """The section that a heading names, ``Other`` if none; ``lowered`` headings are taken as they are."""
    t = col(c) if lowered else F.lower(col(c))
    return cascade(t, [(F.contains(t, F.lit(w)), s) for w, s in rules.HEADER_RULES], "Other")


def content_head(c: Column | str) -> Column:
    """The first 800 characters in lower case. Lowering never makes a text shorter, so the rest of a long text is left alone."""
    return F.substring(F.lower(F.substring(col(c), 1, 800)), 1, 800)


def content_section(c: Column | str, lowered: bool = False) -> Column:
    """The section that the first 800 characters suggest, ``Other`` if none; ``lowered`` is a column of ``content_head``."""
    t = col(c) if lowered else content_head(c)
    every = []
    for groups, label in rules.CONTENT_RULES:
        cond = F.lit(True)
        for g in groups:
            cond = cond & contains_any(t, g)
        every.append((cond, label))
    return cascade(t, every, "Other")


def fuzzy_label(c: Column | str, labels: list[str]) -> Column:
    """The first label that holds the answer or stands in it, without case; ``Other`` if none."""
    t = F.lower(F.trim(col(c)))
    return cascade(t, [(F.contains(t, F.lit(x.lower())) | (F.contains(F.lit(x.lower()), t) & (t != "")), x) for x in labels], "Other")


def first_match(c: Column | str, patterns: list[str], group: int = 1) -> Column:
    """The group in the first pattern that matches; null if none does."""
    found = [F.regexp_extract(col(c), f"(?iu){p}", group) for p in patterns]
    return F.coalesce(*[F.when(x != "", x) for x in found])


def extract_cascade(c: Column | str, field: str) -> Column:
    """The field's text from the first of its patterns that matches; null if none does."""
    if field in rules.RANGE_CASCADES:
        out = []
        for p, form in rules.RANGE_CASCADES[field]:
            one, two = (F.regexp_extract(col(c), f"(?iu){p}", g) if f"{{{g}}}" in form or g == 1 else F.lit("") for g in (1, 2))
            text = F.lit(form)
            text = F.replace(F.replace(text, F.lit("{1}"), one), F.lit("{2}"), two)
            out.append(F.when(one != "", text))
        return F.coalesce(*out)
    patterns, (word, with_word, without) = rules.CASCADES[field]
    out = []
    for p in patterns:
        whole, value = (F.regexp_extract(col(c), f"(?iu){p}", g) for g in (0, 1))
        value = F.replace(value, F.lit(","), F.lit(""))
        form = F.when(F.contains(whole, F.lit(word)), F.lit(with_word)).otherwise(F.lit(without))
        out.append(F.when(whole != "", F.replace(form, F.lit("{}"), value)))
    return F.coalesce(*out)


def study_window(c: Column | str, study: str) -> Column:
    """From the study's name to the next study, table, figure or heading, if criteria stand there; else the whole text."""
    p = rf"(?isu)({study}.*?(?:inclusion|eligibility|criteria).*?)(?={study.split('-')[0]}-\d|Table|Figure|##|$)"
    found = F.regexp_extract(col(c), p, 1)
    return F.when(found != "", found).otherwise(col(c))


def fixed_chunks(df: DataFrame, key: str, text: str, size: int = 2000, overlap: int = 200) -> DataFrame:
    """(key, chunk_index, content): windows of ``size`` characters, each ``overlap`` before the end of the last."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step))
    out = df.where(F.length(text) > 0).select(key, text, F.posexplode(starts).alias("chunk_index", "_at"))
    return out.select(key, "chunk_index", F.substring(F.col(text), F.col("_at") + 1, F.lit(size)).alias("content"))


def paragraphs(df: DataFrame, key: str, text: str, sep: str = r"\n\s*\n") -> DataFrame:
    """(key, paragraph_index, paragraph): trimmed, without empty ones."""
    parts = F.filter(F.transform(F.split(text, sep), lambda x: F.trim(x, F.lit(" \n\r\t"))), lambda x: x != "")
    return df.select(key, F.posexplode(parts).alias("paragraph_index", "paragraph"))


def header_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block, level, title, content): a markdown text cut at its headings."""
    parts = F.split(F.concat(F.lit("\n"), text), r"\n(?=#{1,6}\s+)")
    out = df.select(key, F.posexplode(parts).alias("block", "content")).where(F.trim("content") != "")
    head = r"^\s*(#{1,6})\s+([^\n]*)"
    return out.select(key, "block", F.length(F.regexp_extract("content", head, 1)).alias("level"), F.trim(F.regexp_extract("content", head, 2)).alias("title"), "content")


def occurrences(c: Column | str, word: str) -> Column:
    t = F.lower(col(c))
    return ((F.length(t) - F.length(F.replace(t, F.lit(word.lower()), F.lit("")))) / len(word)).cast("int")


def references(c: Column | str) -> Column:
    """Keys such as ``table 3-1`` or ``section 2.1`` that a text refers to, each once, in order."""
    t = F.lower(col(c))
    table = F.transform(F.regexp_extract_all(t, F.lit(r"table\s*(\d+[\-\.]\d+|\d+)"), F.lit(1)), lambda x: F.concat(F.lit("table "), x))
    section = F.transform(F.regexp_extract_all(t, F.lit(r"section\s*(\d+[\.\d]+)"), F.lit(1)), lambda x: F.concat(F.lit("section "), x))
    return F.array_distinct(F.concat(table, section))


def reference_heads(c: Column | str) -> Column:
    """Keys that a text's headings define."""
    return F.array_compact(
        F.concat(
            F.transform(F.regexp_extract_all(col(c), F.lit(r"(?im)^#{1,6}\s+Table\s+([\d.\-]+)"), F.lit(1)), lambda x: F.concat(F.lit("table "), x)),
            F.transform(F.regexp_extract_all(col(c), F.lit(r"(?im)^#{1,6}\s+Section\s+([\d.]+)"), F.lit(1)), lambda x: F.concat(F.lit("section "), x)),
            F.transform(F.regexp_extract_all(col(c), F.lit(r"(?m)^#{1,6}\s+([\d.]+)\s"), F.lit(1)), lambda x: F.concat(F.lit("section "), F.rtrim(x, F.lit(".")))),
        )
    )


def schemas_for(c: Column | str) -> Column:
    """Schemas whose word stands in a section's label, each once."""
    t = F.lower(col(c))
    return F.array_distinct(F.flatten(F.array_compact(F.array(*[F.when(F.contains(t, F.lit(w)), F.array(*map(F.lit, s))) for w, s in rules.SECTION_SCHEMAS.items()]))))


def semantic_chunks(df: DataFrame, key: str, order: str, text: str, vector: str, similar: float = 0.75, least: int = 500, most: int = 2000) -> DataFrame:
    """(key, chunk_index, content, source_paragraphs, semantic_size, embedding): paragraphs joined while they stay similar.

    A chunk ends before a paragraph whose cosine with the running vector is below ``similar`` once the chunk has more than ``least``
    characters, or once it has more than ``most``. The running vector, the chunk's embedding, is the mean of itself and each
    paragraph's, so later ones weigh more. The fold is sequential within a document; documents go to tasks by their key.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        out, run, ids, parts = [], None, [], []

        def close() -> None:
            content = "\n\n".join(parts)
            out.append((rows[key].iloc[0], len(out), content, list(ids), len(content), run.tolist()))

        for i, t, v in zip(rows[order], rows[text], rows[vector]):
            v = np.asarray(v, dtype=np.float64)
            if parts:
                size = len("\n\n".join(parts))
                norm = np.linalg.norm(run) * np.linalg.norm(v)
                cos = float(run @ v / norm) if norm else 0.0
                if (cos < similar and size > least) or size > most:
                    close()
                    run, ids, parts = None, [], []
            run = v if run is None else (run + v) / 2
            ids.append(int(i))
            parts.append(t)
        if parts:
            close()
        return pd.DataFrame(out, columns=[key, "chunk_index", "content", "source_paragraphs", "semantic_size", "embedding"])

    kind = dict(df.dtypes)[key]
    return df.select(key, order, text, vector).groupBy(key).applyInPandas(fold, f"{key} {kind}, chunk_index int, content string, source_paragraphs array<bigint>, semantic_size int, embedding array<double>")


def found_terms(df: DataFrame, text: str, vocabulary: dict[str, list[str]]) -> DataFrame:
    """``df`` with a map of category to the terms of a vocabulary that the text names, each once, in order of the alphabet."""
    low = F.col("_low")

    def named(term: str) -> Column:
        whole = low.rlike(rf"\b{term.lower()}\b")
        # most texts don't hold most terms; without signs of a pattern that is seen sooner
        return whole if set(term) & set(r"\.^$*+?{}[]()|") else F.contains(low, F.lit(term.lower())) & whole

    kinds = []
    for kind, terms in vocabulary.items():
        hits = F.array_compact(F.array(*[F.when(named(t), F.lit(t)) for t in sorted(terms)]))
        kinds += [F.lit(kind), hits]
    # lowered once, not for each term
    return df.withColumn("_low", F.lower(F.col(text))).withColumn("entities", F.map_filter(F.create_map(*kinds), lambda _, v: F.size(v) > 0)).drop("_low")


def batches(items: Iterator, size: int) -> Iterator[list]:
    """Lists of ``size`` items, for providers that take several at once."""
    out = []
    for x in items:
        out.append(x)
        if len(out) == size:
            yield out
            out = []
    if out:
        yield out
