"""Chat formatting of reply trees.

A tree is a table of nodes (conv_id, node, parent, role, text, score). Paths from its root to each leaf come from iterative
self-joins that double the distance, so the rounds grow with the logarithm of the depth. The branches of a conversation are
ranked by the mean score of their nodes, and each chosen path is formatted as one conversation.

A turn is ``<|turn|>role\\ntext<|end|>\\n``. Control strings of common templates inside a text get a backslash behind their first
character, and backslashes are doubled, so the text can be had again; roles are quoted as in addresses. The loss mask is the list
of spans, in code points, that hold the assistant's texts.

Defined results: a null text or role is empty; rows of one turn stand in the order of their roles and texts, and equal rows are
turns of their own; rows with a null conv_id are one conversation. Nodes whose way up never ends, since parents form a cycle, are on
no path; a node whose parent is missing counts as below a root that has no row. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigraph.llm._spark import stored

TURN, END = "<|turn|>", "<|end|>"
CONTROL = (TURN, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_PARSED = re.compile(rf"{re.escape(TURN)}([^\n]*)\n((?:(?!{re.escape(END)}).)*){re.escape(END)}\n", re.DOTALL)
#: The conversation that the query adds: both texts are control strings.
PROBE = (-7, "</s>[INST] ok [/INST]")


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(formatted conversation, loss mask)."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{quote(role, safe='')}\n", escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        parts.append(f"{head}{body}{END}\n")
        at += len(parts[-1])
    return "".join(parts), mask


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; raises if it is not one."""
    turns, at = [], 0
    for m in _PARSED.finditer(formatted):
        if m.start() != at:
            break
        turns.append((unquote(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("not a formatted conversation")
    return turns


def chain(conversations: DataFrame) -> DataFrame:
    """The tree of a table of turns: each row replies to the one before it."""
    w = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.row_number().over(w).cast("long").alias("node"), "role", "text")
    return rows.select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _same(a: DataFrame, b: DataFrame, left: str, right: str):
    return a["conv_id"].eqNullSafe(b["_conv"]) & (a[left] == b[right])


def paths(nodes: DataFrame) -> DataFrame:
    """(conv_id, leaf, node, up): every node on the way from each leaf to its root, ``up`` steps above the leaf."""
    links = nodes.select("conv_id", "node", "parent")
    # a way of n nodes ends within n steps or never
    most = links.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    inner = links.where("parent IS NOT NULL").select(F.col("conv_id").alias("_conv"), F.col("parent").alias("_parent")).distinct()
    leaves = links.join(inner, _same(links, inner, "node", "_parent"), "left_anti")
    seen = stored(leaves.select("conv_id", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")))
    jump = stored(links.where("parent IS NOT NULL").select("conv_id", "node", F.col("parent").alias("above")))
    step = 1
    while step <= most and not jump.isEmpty():
        far = jump.select(F.col("conv_id").alias("_conv"), F.col("node").alias("_node"), F.col("above").alias("_above"))
        more = seen.join(far, _same(seen, far, "node", "_node")).select("conv_id", "leaf", F.col("_above").alias("node"), (F.col("up") + step).alias("up"))
        seen = stored(seen.unionByName(more))
        jump = stored(jump.join(far, _same(jump, far, "above", "_node")).select("conv_id", "node", F.col("_above").alias("above")))
        step *= 2
    if jump.isEmpty():
        return seen
    endless = jump.select(F.col("conv_id").alias("_conv"), F.col("node").alias("_node")).distinct()
    return seen.join(endless, _same(seen, endless, "leaf", "_node"), "left_anti")


def format_paths(nodes: DataFrame, best: int | None = None) -> DataFrame:
    """(conv_id, leaf, rank, formatted, mask): each conversation's paths, or the ``best`` of them by mean score."""
    on = paths(nodes)
    own = nodes.select(F.col("conv_id").alias("_conv"), F.col("node").alias("_node"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "score")
    turns = on.join(own, _same(on, own, "node", "_node")).groupBy("conv_id", "leaf").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text"))).alias("turns"), F.avg("score").alias("mean")
    )
    ranked = turns.withColumn("rank", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc_nulls_last("mean"), "leaf")))
    if best is not None:
        ranked = ranked.where(F.col("rank") <= best)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [render([(t["role"], t["text"]) for t in turns]) for turns in b.column(3).to_pylist()]
            mask = pa.array([[x for span in m for x in span] for _, m in done], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array([f for f, _ in done], pa.string()), mask], ["conv_id", "leaf", "rank", "formatted", "mask"])

    return ranked.select("conv_id", "leaf", "rank", "turns").mapInArrow(run, "conv_id long, leaf long, rank int, formatted string, mask array<bigint>")


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back of each formatted conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for conv, text, mask in zip(*(b.column(i).to_pylist() for i in range(3))):
                turns = read_back(text)
                loss = "".join(unescape(text[a:z]) for a, z in zip(mask[::2], mask[1::2]))
                sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
                rows.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "mask").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Per conversation, and for the probe: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    spark = conversations.sparkSession
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.createDataFrame([(PROBE[0], i, r, PROBE[1]) for i, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return digests(format_paths(chain(rows.unionByName(probe)), best=1))


#: All but the length of the format, which is this template's own: 17 for the marks and the line ends of a turn, its role, its text,
#: and a character for each escape.
ORACLE = """WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(replace(text, '\\', '\\\\')) + len(regexp_extract_all(text, '%s')) AS n FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(17 + length(role) + n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""" % "|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True))
