"""Quality of extracted records against a truth. Metrics are always those that were measured."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigraph.functions import rules
from evigraph.functions.cleaning import half_up, is_empty, leaves, numeric_equal
from evigraph.operators.store import kept


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def prf(df: DataFrame, keys: list[str], tp: Column, fp: Column, fn: Column) -> DataFrame:
    """tp, fp, fn, precision, recall and F1 of each key, to four decimals."""
    flag = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0))
    out = df.groupBy(*keys).agg(flag(tp).alias("tp"), flag(fp).alias("fp"), flag(fn).alias("fn"))
    t, p, n = (F.col(c) for c in ("tp", "fp", "fn"))
    return out.select(*keys, "tp", "fp", "fn", half_up(ratio(t, t + p), 4).alias("precision"), half_up(ratio(t, t + n), 4).alias("recall"), half_up(ratio(2 * t, 2 * t + p + n), 4).alias("f1"))


def weight_of(field: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in rules.FIELD_WEIGHTS.items() for x in kv])[field], F.lit(1))


def weighted_accuracy(score: Column, weight: Column) -> Column:
    """Aggregate: the weighted mean of scores."""
    return ratio(F.sum(score * weight), F.sum(weight))


def list_overlap(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """(tp, fp, fn) of a list against the truth ``a``."""
    return F.size(F.array_intersect(a, b)), F.size(F.array_except(b, a)), F.size(F.array_except(a, b))


def score_buckets(score: Column) -> Column:
    return F.when(score >= 0.8, "correct").when(score >= 0.3, "partial").otherwise("wrong")


def estimated_misses(n: Column) -> Column:
    """What a check without truth takes for missed: a twentieth, at least 1."""
    return F.greatest(F.lit(1), F.floor(n * 0.05))


def flatten(df: DataFrame, key: str) -> DataFrame:
    """(key, path, value): the leaves of every record as text; lists and maps as JSON."""
    text = lambda p, k: F.to_json(F.col(p)) if isinstance(k, (T.ArrayType, T.MapType)) else F.col(p).cast("string")
    rows = [F.struct(F.lit(p).alias("path"), text(p, k).alias("value")) for p, k in leaves(df.drop(key).schema, 99)]
    return df.select(key, F.explode(F.array(*rows)).alias("_r")).select(key, "_r.path", "_r.value")


def tree_diff(truth: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Leaves (keys, path, value) of two trees side by side with status tp, fp, fn or both empty, and ok."""
    t = truth.select(*keys, "path", F.col("value").alias("truth"))
    f = found.select(*keys, "path", F.col("value").alias("found"))
    both = t.join(f, [*keys, "path"], "full_outer")
    no_t, no_f = is_empty("truth"), is_empty("found")
    same = numeric_equal("truth", "found")
    status = F.when(no_t & no_f, "empty").when(no_t, "fp").when(no_f, "fn").when(same, "tp").otherwise("mismatch")
    return both.withColumn("status", status)


#: Tables of at most ``WHOLE`` rows a side are matched whole, so many at once that a group has ``GROUP`` rows in the mean; of larger ones
#: ``TURN`` truth rows at a time meet ``BLOCK`` found rows.
WHOLE, GROUP, TURN, BLOCK = 4_096, 16_384, 1_024, 8_192

_EMPTY, _NOT_DIGITS = frozenset(rules.EMPTY_TEXTS), {i: None for i in range(128) if chr(i) not in ".0123456789"}


def _compared(v: str | None) -> str:
    """What stands for a cell: its digits and points behind a #, if it has digits (so two such cells are equal where these are), else its text."""
    s = v.strip().lower() if isinstance(v, str) else ""
    if s in _EMPTY:
        return ""
    digits = s.translate(_NOT_DIGITS) if s.isascii() else "".join(c for c in s if c.isdigit() or c == ".")
    return "#" + digits if digits.strip(".") else s


def _codes(cells: pa.Array) -> np.ndarray:
    """Numbers of a column's cells: equal cells have equal ones."""
    seen: dict[str, int] = {}
    texts = cells.dictionary_encode(null_encoding="encode")
    numbers = np.array([seen.setdefault(_compared(v), len(seen)) for v in texts.dictionary.to_pylist()], np.int32)
    return numbers[texts.indices.to_numpy()]


def _joined(a: pa.Table, b: pa.Table, column: str) -> pa.Array:
    return pa.concat_arrays([*a[column].chunks, *b[column].chunks])


def _match_whole(truth: DataFrame, found: DataFrame, kind: str, fields: list[str], groups: int) -> DataFrame:
    """(_table, _score) of each pair that is taken. A group holds many whole tables, whose i-th truth rows choose at once."""

    def match(t: pa.Table, f: pa.Table) -> pa.Table:
        none = pa.table({"_table": (t if len(t) else f)["_table"].slice(0, 0), "_score": pa.array([], pa.int64())})
        if not len(t) or not len(f):
            return none
        tables, split = _joined(t, f, "_table").dictionary_encode(null_encoding="encode"), len(t)
        number = tables.indices.to_numpy()
        n, m = (np.bincount(x, minlength=len(tables.dictionary)) for x in (number[:split], number[split:]))
        # tables of both sides go first, those with most truth rows before others, so the tables that still have one are always a prefix
        rank = np.argsort(-np.where(m > 0, n, 0), kind="stable")[: int(((n > 0) & (m > 0)).sum())]
        if not len(rank):
            return none
        place = np.full(len(n), len(rank))
        place[rank] = np.arange(len(rank))
        n, m, sides = n[rank], m[rank], []
        codes = np.stack([_codes(_joined(t, f, c)) for c in fields])
        for x, own, at, size in ((t, codes[:, :split], place[number[:split]], n.sum()), (f, codes[:, split:], place[number[split:]], m.sum())):
            keyed = x.append_column("_place", pa.array(at))
            order = pc.sort_indices(keyed, sort_keys=[(c, "ascending") for c in ("_place", "_row", *fields)], null_placement="at_end")
            sides.append(own[:, order.to_numpy()[:size]])
        own, other = sides
        first, ends = np.cumsum(n) - n, np.cumsum(m)
        begins, longest = ends - m, int(m.max())
        # the larger, the earlier in its table: added to a score it decides between equal ones
        early = longest - 1 - (np.arange(ends[-1]) - np.repeat(begins, m))
        free, taken, scores = np.ones(ends[-1], bool), [], []
        for i in range(n[0]):
            left = int(np.searchsorted(-n, -i))
            end = ends[left - 1]
            same = np.zeros(end, np.int64)
            for a, b in zip(own, other):
                same += np.repeat(a[first[:left] + i], m[:left]) == b[:end]
            best = np.maximum.reduceat(same * free[:end] * longest + early[:end], begins[:left])
            score = best // longest
            hit = score > 0
            free[(begins[:left] + longest - 1 - best % longest)[hit]] = False
            taken.append(np.flatnonzero(hit))
            scores.append(score[hit])
        return pa.table({"_table": tables.dictionary.take(pa.array(rank[np.concatenate(taken)])), "_score": pa.array(np.concatenate(scores))})

    dealt = lambda df: df.select("_table", "_row", *fields, F.pmod(F.xxhash64("_table"), F.lit(groups)).alias("_group")).groupBy("_group")
    return dealt(truth).cogroup(dealt(found)).applyInArrow(match, f"_table {kind}, _score long")


def _placed(df: DataFrame, fields: list[str]) -> DataFrame:
    """``df`` with _at: each row's place in its table, from 0. Places come from range partitions, so no task holds a table."""
    order = [F.col(c).asc_nulls_last() for c in ("_row", *fields)]
    parts = kept(df.repartitionByRange(F.col("_table"), *order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_table", "_part").agg(F.count("*").alias("_size"))
    earlier = W.partitionBy("_table").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(F.col("_table").alias("_t"), F.col("_part").alias("_p"), F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    own = parts.withColumn("_own", F.row_number().over(W.partitionBy("_table", "_part").orderBy(*order)))
    both = own.join(sizes, F.col("_table").eqNullSafe(F.col("_t")) & (F.col("_part") == F.col("_p")))
    return both.withColumn("_at", F.col("_before") + F.col("_own") - 1).drop("_part", "_own", "_t", "_p", "_before")


def _match_in_turns(truth: DataFrame, found: DataFrame, kind: str, fields: list[str], turn: int, block: int) -> DataFrame:
    """(_table, _score) of each pair that is taken, for tables of any size; both sides carry _n and _m, the rows of their table.

    The next ``turn`` truth rows of every table meet the blocks of found rows at once. The q-th of them can lose at most q - 1 choices to
    those before it in this turn, so q candidates of each block, and then q of all, are enough; they are settled in order. What earlier
    turns took is sent to the blocks as marks."""

    def candidates(key, t: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        truths, places, scores = [], [], []
        f = f[~f["_at"].isin(f.loc[f["_gone"], "_at"])].sort_values("_at")
        if len(t) and len(f):
            codes = np.stack([_codes(pa.array([*t[c], *f[c]], pa.string(), from_pandas=True)) for c in fields])
            own, other, there = codes[:, : len(t)], codes[:, len(t) :], f["_at"].to_numpy()
            for i, at in enumerate(t["_at"]):
                same = (other == own[:, i, None]).sum(axis=0)
                best = np.argsort(-same, kind="stable")[: at % turn + 1]
                best = best[same[best] > 0]
                truths += [at] * len(best)
                places += there[best].tolist()
                scores += same[best].tolist()
        return pd.DataFrame({"_table": pd.Series([key[0]] * len(truths), dtype=object), "_truth": truths, "_found": places, "_score": scores})

    def settle(key, c: pd.DataFrame) -> pd.DataFrame:
        gone, busy, out = set(), None, []
        for t, f, s in c.sort_values(["_truth", "_score", "_found"], ascending=[True, False, True])[["_truth", "_found", "_score"]].itertuples(index=False):
            if t != busy and f not in gone:
                busy = t
                gone.add(f)
                out.append((key[0], f, s))
        return pd.DataFrame(out, columns=["_table", "_at", "_score"])

    rows = kept(_placed(truth, fields))
    there = kept(_placed(found, fields).select("_table", *fields, "_at", "_n", F.lit(False).alias("_gone")))
    taken: list[DataFrame] = []
    for k in range(-(-rows.agg(F.max("_n")).first()[0] // turn)):
        blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_m") - 1) / block))
        asked = rows.where(F.floor(F.col("_at") / turn) == k).withColumn("_block", F.explode(blocks))
        free = there.where(F.col("_n") > k * turn).drop("_n")
        for done in taken:
            free = free.unionByName(done.select("_table", "_at", F.lit(True).alias("_gone")), allowMissingColumns=True)
        free = free.withColumn("_block", F.floor(F.col("_at") / block))
        pairs = asked.groupBy("_table", "_block").cogroup(free.groupBy("_table", "_block")).applyInPandas(candidates, f"_table {kind}, _truth long, _found long, _score long")
        first = F.row_number().over(W.partitionBy("_table", "_truth").orderBy(F.desc("_score"), "_found"))
        few = pairs.withColumn("_rn", first).where((F.col("_rn") <= turn) & (F.col("_rn") <= F.col("_truth") % turn + 1))
        taken.append(kept(few.groupBy("_table").applyInPandas(settle, f"_table {kind}, _at long, _score long")))
    out = taken[0]
    for more in taken[1:]:
        out = out.unionByName(more)
    return out.select("_table", "_score")


def match_tables(truth: DataFrame, found: DataFrame, table: str, row: str, fields: list[str], whole: int = WHOLE, turn: int = TURN, block: int = BLOCK) -> DataFrame:
    """Per table: cells_total, cells_correct, rows_total, rows_correct, fp. Each truth row in turn takes the best free found row.

    Rows go by ``row`` (null last), equal ones by their cells; of found rows that are equally good the first is taken, one without an
    equal cell never. Cells are compared as texts without case and space around, all empty ones are equal, and so are those with the same
    digits. A row is correct if all its cells are, or from five fields on four fifths of them. A null table is a table; one that stands
    on one side only has nothing correct. Other columns are ignored. Tables of more than ``whole`` rows on a side are settled in turns of
    bounded groups, with the same result, so no task holds a table whatever its size.
    """
    cells, kind = [f"_c{i}" for i in range(len(fields))], truth.schema[table].dataType.simpleString()
    side = lambda df: df.select(F.col(f"`{table}`").alias("_table"), F.col(f"`{row}`").alias("_row"), *[F.col(f"`{f}`").cast("string").alias(c) for f, c in zip(fields, cells)])
    t, f = side(truth), side(found)
    rows = t.groupBy("_table").agg(F.count("*").alias("_n")).withColumn("_m", F.lit(0)).unionByName(f.groupBy("_table").agg(F.count("*").alias("_m")).withColumn("_n", F.lit(0)))
    sizes = kept(rows.groupBy("_table").agg(F.sum("_n").alias("_n"), F.sum("_m").alias("_m")))
    large = sizes.where((F.greatest("_n", "_m") > whole) & (F.least("_n", "_m") > 0)).withColumnRenamed("_table", "_l")
    every, most = sizes.agg(F.coalesce(F.sum(F.col("_n") + F.col("_m")), F.lit(0)), F.max(F.when(F.least("_n", "_m") > 0, F.greatest("_n", "_m")))).first()
    groups = every // GROUP + 1
    if (most or 0) <= whole:
        pairs = _match_whole(t, f, kind, cells, groups)
    else:
        same = F.col("_table").eqNullSafe(F.col("_l"))
        parts = [(x.join(large, same, "left_anti"), x.join(large, same).drop("_l")) for x in (t, f)]
        pairs = _match_whole(parts[0][0], parts[1][0], kind, cells, groups).unionByName(_match_in_turns(parts[0][1], parts[1][1], kind, cells, turn, block))
    right = (F.col("_score") == len(fields)) | F.lit(len(fields) >= 5) & (F.col("_score") / len(fields) >= 0.8)
    taken = pairs.groupBy("_table").agg(F.sum("_score").alias("_cells"), F.count_if(right).alias("_right"), F.count("*").alias("_taken"))
    both = sizes.unionByName(taken, allowMissingColumns=True).groupBy("_table").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("_n", "_m", "_cells", "_right", "_taken")])
    return both.select(
        F.col("_table").alias(table), (F.col("_n") * len(fields)).alias("cells_total"), F.col("_cells").alias("cells_correct"), F.col("_n").alias("rows_total"),
        F.col("_right").alias("rows_correct"), ((F.col("_m") - F.col("_taken")) * len(fields)).alias("fp"),
    )


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, filled, total, percent): how many values are not empty, percent rounded down."""
    aggs = [F.count_if(~is_empty(c)).alias(c) for c in columns]
    wide = df.agg(F.count("*").alias("_total"), *aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("filled")) for c in columns])).alias("_r")
    out = wide.select("_total", rows).select("_r.column", "_r.filled", F.col("_total").alias("total"))
    return out.withColumn("percent", F.when(F.col("total") > 0, F.floor(100 * F.col("filled") / F.col("total"))).otherwise(F.lit(0)))


def prune_empty(df: DataFrame) -> DataFrame:
    """``df`` without columns that are empty in every row: one pass over it decides."""
    row = df.agg(*[F.max((~is_empty(f"`{c}`")).cast("int")).alias(c) for c in df.columns]).first()
    return df.select(*[f"`{c}`" for c in df.columns if row[c]])
