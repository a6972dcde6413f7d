"""Chat formatting: reply trees to formatted conversations.

Messages form trees by (tree, node, parent). Self-joins that double their
reach enumerate each leaf's path to the root: after k rounds a leaf knows its
2^k nearest messages, so a path of any depth takes a logarithmic number of
rounds. Paths of a tree are ranked by their messages' total score, and each
chosen path is formatted as one conversation.

Template: [INST]role NEWLINE text[/INST] for all roles but the one that is
learnt, <s>role NEWLINE text</s> for that one. Inside roles and texts, the
first character of a control string becomes a backslash escape, and a
backslash two, so that reading back gives every text again. The loss mask
covers the learnt role's texts alone.

Defined results: null text or role is empty. A parent that is null or missing
makes its message a root; messages on or below a cycle have no root and are
left out. Of equal scores, the smallest leaf wins. Messages with equal tree
and node are one node's duplicates and not expected; linear_messages() numbers
tied rows by role and text instead. A null tree is a tree of its own. An empty
table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch

LEARNT = "assistant"
#: The template's control strings, and the escapes of their first characters.
OPEN, CLOSE, OPEN_LEARNT, CLOSE_LEARNT = "[INST]", "[/INST]", "<s>", "</s>"
ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\b", "\n": "\\n"}
_controls = re.compile(r"\\|<(?=/?s>)|\[(?=/?INST\])")
_role_controls = re.compile(r"\\|\n|<(?=/?s>)|\[(?=/?INST\])")
_escaped = re.compile(r"\\(.)")
_turns = re.compile(r"\[INST\](.*?)\n(.*?)\[/INST\]|<s>(.*?)\n(.*?)</s>", re.DOTALL)
_plain = {v[1]: k for k, v in ESCAPES.items()}


def escape(text: str) -> str:
    return _controls.sub(lambda m: ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return _escaped.sub(lambda m: _plain[m[1]], text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(text, loss spans in code points) of (role, text) turns."""
    out, spans, at = [], [], 0
    for role, text in turns:
        learnt = role == LEARNT
        lead = (OPEN_LEARNT if learnt else OPEN) + _role_controls.sub(lambda m: ESCAPES[m[0]], role) + "\n"
        body = escape(text)
        if learnt:
            spans.append((at + len(lead), at + len(lead) + len(body)))
        piece = lead + body + (CLOSE_LEARNT if learnt else CLOSE)
        out.append(piece)
        at += len(piece)
    return "".join(out), spans


def read_turns(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    return [(unescape(m[1] if m[1] is not None else m[3]), unescape(m[2] if m[2] is not None else m[4])) for m in _turns.finditer(text)]


def linear_messages(rows: DataFrame, tree: str = "conv_id", order: str = "turn") -> DataFrame:
    """Plain conversations as trees without branches: each row answers the one before it by order, then role and text."""
    place = F.row_number().over(Window.partitionBy(tree).orderBy(F.col(order).asc_nulls_first(), "role", "text")).cast("long")
    out = rows.select(F.col(tree).alias("tree"), place.alias("node"), "role", "text")
    return out.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _tied(a: str, b: str):
    return F.col(f"{a}.tree").eqNullSafe(F.col(f"{b}.tree"))


def branches(messages: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(own, leaves, jumps): each message's score; tree, leaf, total score of each root-to-leaf path; each message's 2^k-th ancestor.

    Messages on or below a cycle are the ones that still have an ancestor when a
    round has ended no path: each round ends the paths of the least depth that
    are left.
    """
    messages = messages.select("tree", "node", "parent", "score")
    there = messages.select("tree", "node")
    state = messages.alias("m").join(there.alias("p"), _tied("m", "p") & (F.col("m.parent") == F.col("p.node")), "left").select("m.tree", "m.node", F.col("p.node").alias("to"), F.coalesce("m.score", F.lit(0.0)).alias("total"))
    first = state = scratch.save(state)
    jumps, before = [], None
    while (left := state.where("to is not null").count()) and left != before:
        jumps.append(state.where("to is not null").select("tree", "node", "to"))
        before = left
        # Only messages that still have an ancestor move; each ancestor is a message, so none is lost.
        moved = state.where("to is not null").alias("a").join(state.alias("b"), _tied("a", "b") & (F.col("a.to") == F.col("b.node"))).select("a.tree", "a.node", "b.to", (F.col("a.total") + F.col("b.total")).alias("total"))
        state = moved.union(state.where("to is null").select("tree", "node", "to", "total"))
        state = scratch.save(state)
    answered = first.where("to is not null").select("tree", F.col("to").alias("node")).distinct()
    leaves = state.where("to is null").alias("m").join(answered.alias("a"), _tied("m", "a") & (F.col("m.node") == F.col("a.node")), "left_anti").select("tree", F.col("node").alias("leaf"), "total")
    return first.select("tree", "node", F.col("total").alias("score")), leaves, jumps


def best_leaves(leaves: DataFrame) -> DataFrame:
    """tree, leaf of each tree's path with the highest total score; the smallest leaf wins ties."""
    return leaves.groupBy("tree").agg(F.max_by("leaf", F.struct("total", -F.col("leaf"))).alias("leaf"))


def paths(messages: DataFrame, scratch: Scratch, best_only: bool = False) -> DataFrame:
    """tree, leaf, node, up (steps from the leaf), score of every message on every root-to-leaf path, or on each tree's best."""
    own, leaves, jumps = branches(messages, scratch)
    leaves = best_leaves(leaves) if best_only else leaves
    known = scratch.save(leaves.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up")))
    for k, jump in enumerate(jumps):
        further = known.alias("k").join(jump.alias("j"), _tied("k", "j") & (F.col("k.node") == F.col("j.node"))).select("k.tree", "k.leaf", F.col("j.to").alias("node"), (F.col("k.up") + (1 << k)).alias("up"))
        known = known.union(scratch.save(further))
    known = scratch.save(known)  # the next join would be pushed into each branch of the union
    return known.alias("k").join(own.alias("s"), _tied("k", "s") & (F.col("k.node") == F.col("s.node"))).select("k.tree", "k.leaf", "k.node", "k.up", "s.score")


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [format_turns([(x["role"] or "", x["text"] or "") for x in turns]) for turns in batch.column("turns").to_pylist()]
        spans = pa.array([[{"start": a, "stop": b} for a, b in s] for _, s in done], type=pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
        yield pa.RecordBatch.from_arrays([batch.column("tree"), pa.array([t for t, _ in done], type=pa.string()), spans], names=["tree", "formatted", "loss"])


def formatted(messages: DataFrame, scratch: Scratch, best_only: bool = True) -> DataFrame:
    """tree, formatted, loss (spans of code points) of each tree's best path, or of all paths.

    messages: tree, node (long), parent, role, text, score.
    """
    found = paths(messages, scratch, best_only)
    said = found.alias("k").join(messages.alias("m"), F.col("k.tree").eqNullSafe(F.col("m.tree")) & (F.col("k.node") == F.col("m.node"))).select("k.tree", "k.leaf", (-F.col("k.up")).alias("place"), "m.role", "m.text")
    turns = said.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))
    kind = messages.schema["tree"].dataType.simpleString()
    return turns.select("tree", "turns").mapInArrow(_formatted, f"tree {kind}, formatted string, loss array<struct<start:bigint,stop:bigint>>")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from hashlib import sha256

    for batch in batches:
        rows = []
        for text, loss in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist()):
            turns = read_turns(text)
            learnt = "".join(unescape(text[x["start"] : x["stop"]]) for x in loss)
            rows.append((len(turns), sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(learnt), sha256(learnt.encode()).hexdigest(), len(text)))
        columns = list(zip(*rows)) if rows else [()] * 5
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("tree"), *(pa.array(c, type=k) for c, k in zip(columns, kinds))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digests(conversations: DataFrame) -> DataFrame:
    """What reading formatted conversations back gives, as counts and digests."""
    return conversations.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
