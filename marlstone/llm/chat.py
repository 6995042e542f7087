"""Chat formatting of reply trees.

Messages form trees: each names its parent. Iterative self-joins find every message's ancestors at
distances 1, 2, 4, ... and from these all root-to-leaf paths, so a path of n messages takes about
2 log2(n) joins on (tree, message), never one join a level and no window over a tree. Paths are
ranked by the mean score of their messages; each chosen path is formatted as one conversation.

Template: ``<s>role[INST]text</s>`` for each turn. Inside roles and texts the control strings
``<s> </s> [INST] [/INST]`` are broken by a backslash after their first character and backslashes
are doubled; this is undone exactly by ``unescape``. The loss mask is a list of [start, end) spans
of code points that cover the assistants' texts.

Defined cases: null texts and roles are empty; a message whose parent is missing is a root; a null
tree id is a tree of its own; messages on a cycle have no root and raise ValueError; ties between
paths go to the smaller leaf; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm import common

BEGIN, MIDDLE, END = "<s>", "[INST]", "</s>"
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
MAX_DOUBLINGS = 40


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for c in CONTROLS:
        text = text.replace(c, c[0] + "\\" + c[1:])
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[int], list[int]]:
    """The formatted conversation and the starts and ends of its loss spans."""
    parts, at, starts, ends = [], 0, [], []
    for role, text in turns:
        head, body = BEGIN + escape(role) + MIDDLE, escape(text)
        if role == "assistant":
            starts.append(at + len(head))
            ends.append(at + len(head) + len(body))
        parts += (head, body, END)
        at += len(head) + len(body) + len(END)
    return "".join(parts), starts, ends


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns = []
    for piece in formatted.split(END)[:-1]:
        role, text = piece.removeprefix(BEGIN).split(MIDDLE)
        turns.append((unescape(role), unescape(text)))
    return turns


def paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, up, msg_id): every message of every root-to-leaf path; ``up`` counts from the leaf.

    messages: tree string, msg_id long, parent_id long, unique by (tree, msg_id)."""
    nodes = messages.select("tree", F.col("msg_id").alias("node"))
    links = messages.where("parent_id is not null").select("tree", F.col("msg_id").alias("node"), F.col("parent_id").alias("anc"))
    known = nodes.withColumnRenamed("node", "anc")
    level = common.materialise(links.join(known, ["tree", "anc"], "left_semi").select("tree", "node", "anc"), "jump0")
    leaves = nodes.join(level.select("tree", F.col("anc").alias("node")), ["tree", "node"], "left_anti")
    jumps = []
    while not level.isEmpty():
        if len(jumps) == MAX_DOUBLINGS:
            raise ValueError("messages reply to each other in a circle")
        jumps.append(level)
        up = level.select("tree", F.col("node").alias("anc"), F.col("anc").alias("top"))
        level = common.materialise(level.join(up, ["tree", "anc"]).select("tree", "node", F.col("top").alias("anc")), f"jump{len(jumps)}")
    reached = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    for k in reversed(range(len(jumps))):
        here = F.struct("node", "up")
        there = F.struct(F.col("anc").alias("node"), (F.col("up") + 2**k).alias("up"))
        both = F.when(F.col("anc").isNull(), F.array(here)).otherwise(F.array(here, there))
        reached = reached.join(jumps[k], ["tree", "node"], "left").select("tree", "leaf", F.explode(both).alias("x")).select("tree", "leaf", "x.node", "x.up")
    return reached.select("tree", "leaf", "up", F.col("node").alias("msg_id"))


def best_paths(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, score, turns): the best ``branches`` paths of each tree, all if None."""
    full = paths(messages).join(messages.select("tree", "msg_id", "role", "text", "score"), ["tree", "msg_id"])
    turn = F.struct((-F.col("up")).alias("at"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    each = full.groupBy("tree", "leaf").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("score"), F.sort_array(F.collect_list(turn)).alias("turns"))
    each = each.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    return each if branches is None else each.where(F.col("rank") <= branches)


def format_paths(chosen: DataFrame) -> DataFrame:
    """(tree, leaf, rank, formatted, loss_start, loss_end) of best_paths' rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [format_turns(list(zip(r, t))) for r, t in zip(b["roles"], b["texts"])]
            yield pd.DataFrame({"tree": b["tree"], "leaf": b["leaf"], "rank": b["rank"], "formatted": [x[0] for x in rows], "loss_start": [x[1] for x in rows], "loss_end": [x[2] for x in rows]})

    flat = chosen.select("tree", "leaf", "rank", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))
    return flat.mapInPandas(run, "tree string, leaf long, rank int, formatted string, loss_start array<long>, loss_end array<long>")


def read_back(formatted: DataFrame) -> DataFrame:
    """What a reader gets out of formatted conversations: turns and the text under the loss mask, as digests."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text, starts, ends in zip(b["formatted"], b["loss_start"], b["loss_end"]):
                turns = parse(text)
                loss = "".join(unescape(text[s:e]) for s, e in zip(starts, ends))
                sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                rows.append((len(turns), sha, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            out = pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            out.insert(0, "tree", b["tree"].to_numpy())
            yield out

    return formatted.select("tree", "formatted", "loss_start", "loss_end").mapInPandas(run, "tree string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def chains(conversations: DataFrame) -> DataFrame:
    """Conversations stored as rows by turn, as reply trees without branches. Rows of equal turns go by role and text."""
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    rows = conversations.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("tree"), at.alias("msg_id"), "role", "text")
    return rows.withColumn("parent_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1)).withColumn("score", F.lit(1.0))
