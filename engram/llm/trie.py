"""A prefix trie over conversations, built from owned chains.

A prefix of a conversation is a node of the trie and belongs to the smallest
conversation that starts with it, its owner. Who owns a prefix owns all longer
ones of its own, so each conversation owns one chain: the depths from its first
owned one to its end. That depth is found by binary search: in each round every
open conversation asks for one depth, all in one join with the prefix digests'
minima. Chains hang on each other and form a tree; sums over subtrees run up
this tree by pointer doubling, in as many rounds as its height has binary
digits, and are then spread over the nodes of each chain.

Texts are replaced by hashes before anything is shuffled. A prefix's digest is
the exclusive or of its turns' hashes, each hashed with its depth: 128 bits in
two longs. Whatever runs along a conversation, or along the children of one
parent, is cut into blocks by ranges first (``running``), so a conversation with
a third of all turns, or a first turn that a third of all conversations share,
is no task's own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.common import discard, materialize, parallelism, running, text_or_empty

#: Conversations share at most so many first turns when they are rebuilt.
MOST_SHARED = 5


def turns_of(
    conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", keep_text: bool = False
) -> DataFrame:
    """``conv_id, depth, x, chars``, written: each turn's place from 1, its hash and its length in code points.

    Turns are ordered by ``turn``, null first; equal turns by role, then by
    hash. Null roles and texts count as empty; rows without an id take no part.
    With ``keep_text``, ``role`` and ``text`` follow.
    """
    role, text = text_or_empty(role_col), text_or_empty(text_col)
    hashed = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"),
        F.col(turn_col).alias("turn"),
        role.alias("role"),
        F.sha2(F.concat_ws("\n", F.length(role).cast("string"), role, text), 256).alias("x"),
        F.length(text).cast("long").alias("chars"),
        *([text.alias("text")] if keep_text else []),
    )
    numbered, cut = running(hashed, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("x")], {"depth": (F.sum, F.lit(1).cast("long"))})
    out = materialize(numbered.select("conv_id", "depth", "x", "chars", *(["role", "text"] if keep_text else [])), "turns")
    discard(cut)
    return out


def rebuilt(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, x, chars`` of conversations that start like the first one of their hundred.

    Conversation ``c`` has the first ``h`` turns of conversation ``c - c % 100``,
    as many as there are, and its own turns after its first ``h``; ``h`` is the
    checksum of its number modulo 6.
    """
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    c = F.col("conv_id")
    asked = convs.select("conv_id", (c - c % 100).alias("base"), (F.crc32(c.cast("string").cast("binary")) % (MOST_SHARED + 1)).alias("h"))
    based = asked.join(convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left")
    based = based.select("conv_id", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("taken"))
    heads = turns.where(F.col("depth") <= MOST_SHARED).select(F.col("conv_id").alias("base"), "depth", "x", "chars")
    first = based.join(heads, "base").where("depth <= taken").select("conv_id", "depth", "x", "chars")
    rest = turns.join(based, "conv_id").where("depth > h").select("conv_id", (F.col("depth") - F.col("h") + F.col("taken")).alias("depth"), "x", "chars")
    return first.unionByName(rest)


class Trie:
    """Owned chains of conversations.

    ``prefixes`` has ``conv_id, depth, a, b, chars`` of every prefix but the
    empty one, ``nodes`` has ``depth, a, b, owner, n_convs, chars`` of every
    distinct one, ``convs`` has ``conv_id, n, first, parent``: its length, first
    owned depth (``n + 1``: it owns none) and the owner of the prefix before
    that (null before the first turn). All are written tables.
    """

    def __init__(self, turns: DataFrame, ids: DataFrame) -> None:
        at = ["depth", "a", "b"]
        salted = turns.withColumn("_a", F.xxhash64("depth", "x")).withColumn("_b", F.xxhash64("x", "depth", F.lit(1)))
        summed, cut = running(salted.drop("x"), ["conv_id"], [F.col("depth")], {"a": (F.bit_xor, F.col("_a")), "b": (F.bit_xor, F.col("_b"))})
        self.prefixes = materialize(summed.select("conv_id", *at, "chars"), "prefixes")
        discard(cut)
        self.nodes = materialize(self.prefixes.groupBy(*at).agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.min("chars").alias("chars")), "nodes")
        lengths = self.prefixes.groupBy("conv_id").agg(F.max("depth").alias("n"))
        self.convs = self._searched(ids.select("conv_id").distinct().join(lengths, "conv_id", "left").select("conv_id", F.coalesce("n", F.lit(0)).cast("long").alias("n")))

    def _owners(self, asked: DataFrame) -> DataFrame:
        """``asked`` (``conv_id, depth`` and more) with the owner of that prefix."""
        digests = self.prefixes.drop("chars").join(asked, ["conv_id", "depth"])
        return digests.join(self.nodes.select("depth", "a", "b", "owner"), ["depth", "a", "b"]).drop("a", "b")

    def _searched(self, convs: DataFrame) -> DataFrame:
        state = materialize(convs.select("conv_id", "n", F.lit(1).cast("long").alias("low"), (F.col("n") + 1).alias("high")), "search")
        while state.agg(F.max(F.col("high") - F.col("low"))).first()[0]:
            asked = state.where("low < high").withColumn("depth", F.floor((F.col("low") + F.col("high")) / 2))
            found = self._owners(asked).withColumn("mine", F.col("owner") == F.col("conv_id"))
            low, high = F.when(F.col("mine"), F.col("low")).otherwise(F.col("depth") + 1), F.when(F.col("mine"), F.col("depth")).otherwise(F.col("high"))
            narrowed = found.select("conv_id", "n", low.alias("low"), high.alias("high"))
            nearer = materialize(narrowed.unionByName(state.where("low >= high")), "search")
            discard(state)
            state = nearer
        found = state.select("conv_id", "n", F.col("low").alias("first"))
        hung = self._owners(found.where("first > 1").withColumn("depth", F.col("first") - 1)).select("conv_id", "n", "first", F.col("owner").alias("parent"))
        out = materialize(hung.unionByName(found.where("first <= 1").withColumn("parent", F.lit(None).cast("long"))), "chains")
        discard(state)
        return out

    def discard(self) -> None:
        discard(self.prefixes, self.nodes, self.convs)


def subtree_sums(chains: DataFrame, *values: str) -> DataFrame:
    """``id`` and the sums of ``values`` over its subtree, written; ``chains`` has ``id, parent`` (null: a root) and the values.

    After a round each row has the sum of its descendants less than ``2**k``
    levels below, and ``jump`` is its ancestor ``2**k`` levels above.
    """
    state = materialize(chains.select("id", F.col("parent").alias("jump"), *values), "sums")
    while not state.where("jump is not null").isEmpty():
        below = state.where("jump is not null").groupBy("jump").agg(*(F.sum(v).alias(f"_{v}") for v in values)).withColumnRenamed("jump", "id")
        above = state.where("jump is not null").select(F.col("id").alias("jump"), F.col("jump").alias("_next"))
        summed = state.join(below, "id", "left").select("id", "jump", *((F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values))
        nearer = materialize(summed.join(above, "jump", "left").select("id", F.col("_next").alias("jump"), *values), "sums")
        discard(state)
        state = nearer
    return state


#: Code points of numbers that are hashed as one row.
_CHUNK = 1 << 16


def list_digests(rows: DataFrame) -> DataFrame:
    """``owner, depth, ends_sha256`` of ``owner, depth, conv_id``: the digest of each group's numbers, ascending, joined by commas.

    Numbers are first joined to pieces where their range of the order lies; then
    each group's pieces are hashed one after the other, and none is held whole.
    """
    n = parallelism(rows.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size = None, [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"owner": key[0], "depth": key[1], "least": held[0], "piece": ",".join(map(str, held))}], schema=_PIECES)

        for b in batches:
            for owner, depth, conv in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (key != (owner, depth) or size >= _CHUNK):
                    yield flush()
                    held, size = [], 0
                key = (owner, depth)
                held.append(conv)
                size += len(str(conv)) + 1
        if held:
            yield flush()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        done: list[dict] = []
        for b in batches:
            for owner, depth, _, piece in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key == (owner, depth):
                    digest.update(b",")
                else:
                    if key:
                        done.append({"owner": key[0], "depth": key[1], "ends_sha256": digest.hexdigest()})
                    key, digest = (owner, depth), hashlib.sha256()
                digest.update(piece.encode())
            if len(done) >= 1024:
                yield pa.RecordBatch.from_pylist(done, schema=_DIGESTS)
                done = []
        if key:
            done.append({"owner": key[0], "depth": key[1], "ends_sha256": digest.hexdigest()})
        yield pa.RecordBatch.from_pylist(done, schema=_DIGESTS)

    ordered = rows.select("owner", "depth", "conv_id").repartitionByRange(n, "owner", "depth", "conv_id").sortWithinPartitions("owner", "depth", "conv_id")
    joined = ordered.mapInArrow(pieces, "owner bigint, depth bigint, least bigint, piece string")
    return joined.repartition(n, "owner", "depth").sortWithinPartitions("owner", "depth", "least").mapInArrow(digests, "owner bigint, depth bigint, ends_sha256 string")


_PIECES = pa.schema([("owner", pa.int64()), ("depth", pa.int64()), ("least", pa.int64()), ("piece", pa.string())])
_DIGESTS = pa.schema([("owner", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
_NOTHING = hashlib.sha256(b"").hexdigest()


def trie_nodes(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """A row for each node of the trie over ``turns`` (``conv_id, depth, x, chars``), the root included.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null for the
    root), ``n_convs``, ``n_children``, ``n_leaves`` (childless nodes of its
    subtree), ``saved_tokens`` (over its subtree, each node's members but one
    times its last text's code points), ``ends_sha256`` (of the members that end
    here). ``ids`` names all conversations by ``conv_id``, those without turns
    too: they end at the root. No ids give no rows, not even a root. Turns with
    the same hash ``x`` are equal; a very long text counts whole.
    """
    least, total = ids.agg(F.min("conv_id"), F.countDistinct("conv_id")).first()
    trie = Trie(turns, ids)
    long = lambda v: F.lit(v).cast("long")
    is_root = F.col("conv_id") == F.lit(least).cast("long")
    parent = F.when(~is_root, F.coalesce("parent", long(least)))
    convs = trie.convs.select("conv_id", "n", F.when(is_root, 0).otherwise(F.col("first")).alias("first"), parent.alias("parent"))
    chains = convs.where(F.col("first") <= F.col("n"))
    hooks = ["owner", "depth"]
    hung = chains.where("parent is not null").select("conv_id", F.col("parent").alias("owner"), (F.col("first") - 1).alias("depth"))
    nodes = trie.nodes.select("owner", "depth", "n_convs", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    nodes = nodes.unionByName(trie.nodes.sparkSession.range(1 if total else 0).select(long(least).alias("owner"), long(0).alias("depth"), long(total).alias("n_convs"), long(0).alias("saved")))
    saved = nodes.groupBy("owner").agg(F.sum("saved").alias("saved")).withColumnRenamed("owner", "conv_id")
    busy = hung.select(*hooks).distinct().select(F.col("owner").alias("conv_id"), F.col("depth").alias("n"), F.lit(True).alias("_busy"))
    own = chains.join(saved, "conv_id").join(busy, ["conv_id", "n"], "left")
    sums = subtree_sums(own.select(F.col("conv_id").alias("id"), "parent", F.when(F.col("_busy"), 0).otherwise(1).cast("long").alias("leaves"), "saved"), "leaves", "saved")
    at = hung.join(sums.withColumnRenamed("id", "conv_id"), "conv_id").groupBy(*hooks).agg(F.count("*").alias("kids"), F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
    whole = nodes.join(convs.withColumnRenamed("conv_id", "owner"), "owner").join(at, hooks, "left")
    last = F.col("depth") == F.col("n")
    kids = F.coalesce("kids", F.lit(0))
    each = whole.select(
        *hooks,
        F.when(F.col("depth") > F.col("first"), F.col("owner")).otherwise(F.col("parent")).alias("parent_conv_id"),
        "n_convs",
        (kids + F.when(last, 0).otherwise(1)).alias("n_children"),
        (F.coalesce("_leaves", F.lit(0)) + F.when(last & (kids == 0), 1).otherwise(0)).cast("long").alias("_l"),
        (F.col("saved") + F.coalesce("_saved", F.lit(0))).alias("_s"),
    )
    up, cut = running(each, ["owner"], [F.col("depth").desc()], {"n_leaves": (F.sum, F.col("_l")), "saved_tokens": (F.sum, F.col("_s"))})
    ends = convs.select(F.when(F.col("first") <= F.col("n"), F.col("conv_id")).otherwise(F.col("parent")).alias("owner"), F.col("n").alias("depth"), "conv_id")
    out = materialize(
        up.join(list_digests(ends), hooks, "left").select(
            F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NOTHING)).alias("ends_sha256")
        ),
        "trie",
    )
    trie.discard()
    discard(sums, cut)
    return out


def conversation_trie(conversations: DataFrame, *, rebuild: bool = False, **columns: str) -> DataFrame:
    """The trie of all ``conversations``, or of what ``rebuilt`` makes of them; see ``trie_nodes`` and ``turns_of``.

    Only the four columns named (``id_col, turn_col, role_col, text_col``) are
    read, so other columns may have any names. An empty table has no trie.
    """
    turns = turns_of(conversations, **columns)
    ids = turns.select("conv_id")
    out = trie_nodes(rebuilt(turns) if rebuild else turns, ids)
    discard(turns)
    return out
