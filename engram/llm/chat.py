"""Chat formatting as prefix trees.

Conversations that share initial turns are merged: every distinct first turn is
the root of a tree, and a tree is one training sequence in which each shared
turn stands once, depth first. A token is a code point of the formatted text. A
conversation's tokens are then not one stretch, so each turn has the position
that its first token would have in the conversation by itself, and the
intervals of the sequence that its ancestors fill: a token attends to these and
to what precedes it in its own chain.

The tree is the one of owned chains (``trie``). A chain stands in one piece;
what hangs on it follows, the deepest place first and smaller conversations
first, which is depth-first order. A chain's place is its parent's place, the
parent's length and the sizes of the subtrees before it; sizes run up the tree
and places down by pointer doubling, and no tree is ever in one task.

A turn is ``<s>[INST]role[/INST]text</s>``. Control strings in roles and texts get a
backslash after their first character, and a backslash is doubled, so that
marks are found only where turns begin and end and every text can be had back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.common import discard, materialize, parallelism, running
from engram.llm.trie import Trie, subtree_sums, turns_of

OPEN, MIDDLE, CLOSE = "<s>[INST]", "[/INST]", "</s>"
#: Strings that no text may hold as they are.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
LEARNT = "assistant"


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def formatted(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escaped(role), F.lit(MIDDLE), escaped(text), F.lit(CLOSE))


def parsed(turn: str) -> tuple[str, str, int, int]:
    """Role and text of a formatted turn, and where in it the text lies."""
    at = turn.index(MIDDLE)
    start, end = at + len(MIDDLE), len(turn) - len(CLOSE)
    return unescaped(turn[len(OPEN) : at]), unescaped(turn[start:end]), start, end


def format_chats(conversations: DataFrame, **columns: str) -> tuple[DataFrame, DataFrame]:
    """Written tables of turns and of conversations.

    Turns, each distinct sequence of first turns once: ``tree_id`` (its root's
    smallest conversation), ``conv_id`` (its own smallest one), ``depth``,
    ``start, end`` (in the tree's sequence, end exclusive), ``position`` (of its
    first token; the others count on), ``attends`` (intervals of its ancestors'
    tokens and of its own chain up to its end), ``loss_start, loss_end`` (the
    assistant's own text within the sequence, else null), ``text`` (formatted).

    Conversations: ``conv_id, n_turns, tree_id`` and ``pieces``, what of the
    sequence it consists of, in order: ``conv_id, first, last`` (chain and
    depths) and ``start, end``. Equal conversations have equal pieces.

    Turns are ordered as in ``turns_of``; null roles and texts are empty, rows
    without an id take no part, other columns are not read, and an empty table
    gives empty ones. A conversation's list of pieces grows with how often its
    path changes chains, at most once a turn.
    """
    turns = turns_of(conversations, keep_text=True, **columns)
    trie = Trie(turns.drop("role", "text"), turns.select("conv_id"))
    chains = trie.convs.where(F.col("first") <= F.col("n"))
    whole = formatted(F.col("role"), F.col("text"))
    size = (F.length(whole)).cast("long")
    owned = turns.join(chains.select("conv_id", "first"), "conv_id").where("depth >= first").select("conv_id", "depth", size.alias("size"))
    spans, cut = running(owned, ["conv_id"], [F.col("depth")], {"chain_end": (F.sum, F.col("size"))})
    spans = materialize(spans, "spans")
    discard(cut)
    lengths = spans.groupBy("conv_id").agg(F.sum("size").alias("length"))
    laid = _layout(materialize(chains.join(lengths, "conv_id"), "lengths"), spans)
    own = F.struct("conv_id", "first", F.col("n").alias("last"), "start", (F.col("start") + F.col("length")).alias("end"))
    path = F.col("path")
    before = F.aggregate(path, F.lit(0).cast("long"), lambda s, p: s + p["end"] - p["start"])
    tree = F.when(F.size(path) > 0, path[0]["conv_id"]).otherwise(F.col("conv_id"))
    placed = laid.select("conv_id", tree.alias("tree_id"), F.col("start").alias("chain_start"), before.alias("before"), path.alias("path"))
    end = F.col("chain_start") + F.col("chain_end")
    start = end - F.col("size")
    attends = F.concat(F.transform("path", lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"))), F.array(F.struct(F.col("chain_start").alias("start"), end.alias("end"))))
    in_place = spans.join(placed, "conv_id").select("tree_id", "conv_id", "depth", start.alias("start"), end.alias("end"), (F.col("before") + start - F.col("chain_start")).alias("position"), attends.alias("attends"))
    learnt = F.col("role") == LEARNT
    head = F.length(escaped(F.col("role"))) + len(OPEN) + len(MIDDLE)
    nodes = in_place.join(turns.select("conv_id", "depth", "role", whole.alias("text")), ["conv_id", "depth"]).select(
        "tree_id", "conv_id", "depth", "start", "end", "position", "attends", F.when(learnt, F.col("start") + head).alias("loss_start"), F.when(learnt, F.col("end") - len(CLOSE)).alias("loss_end"), "text"
    )
    nodes = materialize(nodes, "chat-turns")
    whole_chain = laid.select("conv_id", F.col("n").alias("n_turns"), tree.alias("tree_id"), F.concat(path, F.array(own)).alias("pieces"))
    # A conversation without a chain of its own ends on another one's.
    copies = trie.convs.where("first > n").select(F.col("conv_id").alias("copy"), F.col("n").alias("depth"), F.col("parent").alias("conv_id"))
    ending = copies.join(spans.select("conv_id", "depth", "chain_end"), ["conv_id", "depth"]).join(laid, "conv_id")
    end_piece = F.struct("conv_id", "first", F.col("depth").alias("last"), "start", (F.col("start") + F.col("chain_end")).alias("end"))
    on_others = ending.select(F.col("copy").alias("conv_id"), F.col("depth").alias("n_turns"), tree.alias("tree_id"), F.concat(path, F.array(end_piece)).alias("pieces"))
    members = materialize(whole_chain.unionByName(on_others), "chats")
    trie.discard()
    discard(turns, spans, laid)
    return nodes, members


_PATH = "array<struct<conv_id:bigint,first:bigint,last:bigint,start:bigint,end:bigint>>"


def _layout(chains: DataFrame, spans: DataFrame) -> DataFrame:
    """``chains`` (``conv_id, n, first, parent, length``) with ``start`` in its tree's sequence and ``path``, the pieces of its ancestors; ``chains`` is discarded."""
    sizes = subtree_sums(chains.select(F.col("conv_id").alias("id"), "parent", "length"), "length")
    hung = chains.where("parent is not null").join(sizes.select(F.col("id").alias("conv_id"), F.col("length").alias("size")), "conv_id").select("conv_id", "parent", (F.col("first") - 1).alias("hook"), "size")
    before, cut = running(hung, ["parent"], [F.col("hook").desc(), F.col("conv_id")], {"upto": (F.sum, F.col("size"))})
    above = chains.select(F.col("conv_id").alias("parent"), F.col("first").alias("_first"), F.col("length").alias("_length"))
    ends = spans.select(F.col("conv_id").alias("parent"), F.col("depth").alias("hook"), "chain_end")
    piece = F.array(F.struct(F.col("parent").alias("conv_id"), F.col("_first").alias("first"), F.col("hook").alias("last"), F.lit(0).cast("long").alias("start"), F.col("chain_end").alias("end")))
    placed = before.join(above, "parent").join(ends, ["parent", "hook"]).select("conv_id", F.col("parent").alias("jump"), (F.col("_length") + F.col("upto") - F.col("size")).alias("start"), piece.cast(_PATH).alias("path"))
    roots = chains.where("parent is null").select("conv_id", F.lit(None).cast("long").alias("jump"), F.lit(0).cast("long").alias("start"), F.array().cast(_PATH).alias("path"))
    state = materialize(placed.unionByName(roots), "layout")
    discard(cut, sizes)
    while not state.where("jump is not null").isEmpty():
        up = state.select(F.col("conv_id").alias("jump"), F.col("jump").alias("_jump"), F.col("start").alias("_start"), F.col("path").alias("_path"))
        moved = F.transform("path", lambda p: F.struct(p["conv_id"].alias("conv_id"), p["first"].alias("first"), p["last"].alias("last"), (p["start"] + F.col("_start")).alias("start"), (p["end"] + F.col("_start")).alias("end")))
        stepped = state.where("jump is not null").join(up, "jump").select("conv_id", F.col("_jump").alias("jump"), (F.col("start") + F.col("_start")).alias("start"), F.concat("_path", moved).alias("path"))
        nearer = materialize(stepped.unionByName(state.where("jump is null")), "layout")
        discard(state)
        state = nearer
    out = materialize(chains.join(state.select("conv_id", "start", "path"), "conv_id"), "laid")
    discard(state, chains)
    return out


def tokens(nodes: DataFrame) -> DataFrame:
    """``tree_id, start, token_ids, position_ids, loss_mask`` of each turn of ``format_chats``: an entry for each token."""
    schema = "tree_id bigint, start bigint, token_ids array<int>, position_ids array<bigint>, loss_mask array<boolean>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tree, start, position, low, high, text = (c.to_pylist() for c in b.columns)
            ids = [np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.int32) for t in text]
            places = [p + np.arange(len(i)) for p, i in zip(position, ids, strict=True)]
            masks = [np.zeros(len(i), bool) for i in ids]
            for m, s, lo, hi in zip(masks, start, low, high, strict=True):
                if lo is not None:
                    m[lo - s : hi - s] = True
            yield pa.RecordBatch.from_arrays(
                [pa.array(tree, pa.int64()), pa.array(start, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(places, pa.list_(pa.int64())), pa.array(masks, pa.list_(pa.bool_()))],
                names=["tree_id", "start", "token_ids", "position_ids", "loss_mask"],
            )

    return nodes.select("tree_id", "start", "position", "loss_start", "loss_end", "text").mapInArrow(run, schema)


_DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def read_back(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` of each conversation, from the sequences.

    A conversation's turns are fetched through its pieces, put in order and
    digested one after the other, so none is held whole.
    """
    p = F.col("p")
    # Rows of the conversations' ids and places only, until texts are joined.
    places = members.select("conv_id", F.explode("pieces").alias("p")).select(F.col("conv_id").alias("member"), p["conv_id"].alias("conv_id"), F.explode(F.sequence(p["first"], p["last"])).alias("depth"))
    texts = places.join(nodes.select("conv_id", "depth", "text", "start", "loss_start", "loss_end"), ["conv_id", "depth"])
    n = parallelism(nodes.sparkSession)
    own = texts.select("member", "depth", "text", (F.col("loss_start") - F.col("start")).alias("low"), (F.col("loss_end") - F.col("start")).alias("high"))
    ordered = own.repartition(n, "member").sortWithinPartitions("member", "depth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        conv, turns, loss, counts = None, None, None, [0, 0, 0]

        def close() -> None:
            done.append((conv, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]))

        for b in batches:
            for member, _, text, low, high in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if member != conv:
                    if turns:
                        close()
                    conv, turns, loss, counts = member, hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
                role, plain, _, _ = parsed(text)
                turns.update(f"{role}\n{plain}\n".encode())
                counts[0] += 1
                counts[2] += len(text)
                if low is not None:
                    learnt = unescaped(text[low:high])
                    loss.update(learnt.encode())
                    counts[1] += len(learnt)
            if done:
                yield _batch(done)
                done.clear()
        if turns:
            close()
            yield _batch(done)

    return ordered.mapInArrow(run, _DIGEST)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
