"""The conversation trie and chat formatting against brute force, in every shape of input."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from engram.llm.chat import CONTROLS, format_chats, parsed, read_back, tokens
from engram.llm.common import running
from engram.llm.queries import op11_trie, op12_chat
from engram.llm.trie import conversation_trie, list_digests, subtree_sums

SCHEMA = "conv_id long, turn long, role string, text string"


def grouped(rows):
    """conv_id -> its turns in order, as the operators order them (equal turns are equal rows here, or differ in role)."""
    out = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            out[c].append((-1 if t is None else t, role or "", text or ""))
    return {c: [(r, x) for _, r, x in sorted(v)] for c, v in out.items()}


def rebuild(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + own[h:]
    return out


def brute_force(convs):
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    done = {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        below = [done[k] for k in kids[p]]
        done[p] = (sum(b[0] for b in below) or 1, own + sum(b[1] for b in below))
    rows = set()
    for p, who in members.items():
        ends = ",".join(str(c) for c in who if len(convs[c]) == len(p))
        rows.add((who[0], len(p), members[p[:-1]][0] if p else None, len(who), len(kids[p]), *done[p], hashlib.sha256(ends.encode()).hexdigest()))
    return rows


NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie(df, **options):
    found = [tuple(r[n] for n in NAMES) for r in conversation_trie(df, **options).collect()]
    assert len(found) == len(set(found))
    return set(found)


def chats(rng, n, words=6):
    """Conversations that share beginnings, copies of whole ones and one of many turns."""
    rows = []
    for c in range(n):
        base = random.Random(c % 7)
        shared = [base.choice("abc") * base.randrange(1, 4) for _ in range(8)]
        k = rng.randrange(0, 6)
        texts = shared[:k] + ["".join(rng.choice("xyz") for _ in range(rng.randrange(words))) for _ in range(rng.randrange(0, 4))]
        rows += [(c * 3, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(texts)]
    rows += [(1000, i, "user", f"t{i}") for i in range(300)]
    rows += [(1001 + j, i, "user", f"t{i}") for j in range(40) for i in range(j + 1)]
    return rows


ODD = [(None, 0, "user", "lost"), (5, None, "user", "first"), (5, 1, None, None), (5, 1, "user", "tie"), (5, 1, "user", "tie"), (7, 0, "user", ""), (8, 0, "system", "x" * 200_000), (9, 0, "user", "é\U0001f600\n")]


@pytest.mark.parametrize("again", [False, True])
def test_trie(spark, again):
    rows = chats(random.Random(4), 120) + ODD
    convs = grouped(rows)
    want = brute_force(rebuild(convs) if again else convs)
    assert trie(spark.createDataFrame(rows, SCHEMA).repartition(5), rebuild=again) == want


def test_trie_of_one_hot_turn_and_of_copies(spark):
    rows = [(c, 0, "system", "the same") for c in range(600)] + [(c, 1, "user", f"{c % 50}") for c in range(0, 600, 2)]
    rows += [(c, i, "user", f"copy {i}") for c in range(1000, 1400) for i in range(4)]
    random.Random(1).shuffle(rows)
    assert trie(spark.createDataFrame(rows, SCHEMA)) == brute_force(grouped(rows))


def test_turnless_conversations_end_at_the_root(spark):
    # Without their first turns some conversations have none at all.
    rows = [(c, 0, "user", f"{c}") for c in range(101, 160)]
    found = trie(spark.createDataFrame(rows, SCHEMA), rebuild=True)
    assert found == brute_force(rebuild(grouped(rows))) and any(r[1] == 0 and r[3] > r[5] for r in found)


def test_names_and_empty_tables(spark):
    rows = chats(random.Random(5), 20)
    plain = spark.createDataFrame(rows, SCHEMA)
    names = "depth x chars owner n n_convs first parent _block a b low high role_ conv n_turns start end position piece least size".split()
    wide = plain.withColumns({n: F.lit("mine") for n in names}).withColumnsRenamed({"conv_id": "ID", "text": "Body"})
    columns = {"id_col": "ID", "text_col": "Body"}
    assert trie(wide, **columns) == trie(plain) == brute_force(grouped(rows))
    assert sorted(map(str, read_back(*format_chats(wide, **columns)).collect())) == sorted(map(str, read_back(*format_chats(plain)).collect()))
    none = plain.limit(0)
    assert conversation_trie(none).count() == 0 and conversation_trie(plain.withColumn("conv_id", F.lit(None).cast("long"))).count() == 0
    nodes, members = format_chats(none)
    assert nodes.count() == members.count() == read_back(nodes, members).count() == tokens(nodes).count() == 0


def test_running_over_one_group_in_many_ranges(spark):
    rows = spark.range(5000).select((F.col("id") % 3 == 0).cast("int").alias("g"), F.col("id").alias("o"), (F.col("id") % 7).alias("v"))
    rows = rows.withColumn("g", F.when(F.col("g") == 1, F.col("g")))
    found, _ = running(rows, ["g"], [F.col("o")], {"total": (F.sum, F.col("v")), "mixed": (F.bit_xor, F.col("o"))})
    want, sums = {}, {0: [0, 0], 1: [0, 0]}
    for o in range(5000):
        s = sums[int(o % 3 == 0)]
        s[0], s[1] = s[0] + o % 7, s[1] ^ o
        want[o] = tuple(s)
    assert {r["o"]: (r["total"], r["mixed"]) for r in found.collect()} == want


def test_subtree_sums_of_a_long_chain(spark):
    chain = spark.range(200).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit(1).cast("long").alias("v"))
    assert {r["id"]: r["v"] for r in subtree_sums(chain, "v").collect()} == {i: 200 - i for i in range(200)}


def test_digest_of_a_long_list(spark):
    rows = spark.range(60_000).select((F.col("id") % 100 == 0).cast("long").alias("owner"), F.lit(2).cast("long").alias("depth"), F.col("id").alias("conv_id"))
    for r in list_digests(rows).collect():
        ids = [i for i in range(60_000) if (i % 100 == 0) == bool(r["owner"])]
        assert r["ends_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def digests(convs):
    out = {}
    for c, turns in convs.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for r, x in turns)
        out[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chats_can_be_read_back(spark):
    rows = chats(random.Random(6), 80) + ODD
    rows += [(2000 + i, j, ("user", "assistant")[j % 2], f"{c}\\{c[:2]}\\\\{c[0]}\\{c[1:]} {c}{c}" + "\\" * j) for i, c in enumerate(CONTROLS) for j in range(3)]
    rows += [(3000, 0, "<s>[INST]", "role with marks"), (3000, 1, "[/INST]\\", "</s>")]
    nodes, members = format_chats(spark.createDataFrame(rows, SCHEMA).repartition(5))
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in read_back(nodes, members).collect()}
    convs = grouped(rows)
    assert got == digests(convs)

    # Each distinct beginning stands once, trees are whole and depth first.
    turns = nodes.collect()
    assert len(turns) == len({tuple(t[: d + 1]) for t in convs.values() for d in range(len(t))})
    trees = defaultdict(list)
    for r in turns:
        assert r["end"] - r["start"] == len(r["text"])
        trees[r["tree_id"]].append(r)
    for own in trees.values():
        own.sort(key=lambda r: r["start"])
        at, open_ = 0, []
        for r in own:
            assert r["start"] == at
            at = r["end"]
            del open_[r["depth"] - 1 :]  # depth first: a turn's parents are the last ones before it
            open_.append(r)
            assert len(open_) == r["depth"] and r["position"] == sum(len(x["text"]) for x in open_[:-1])
            seen = [i for a in r["attends"] for i in range(a["start"], a["end"])]
            assert seen == [i for x in open_ for i in range(x["start"], x["end"])]
    # Read token by token, a conversation is its formatted text.
    text = {}
    for r in tokens(nodes).collect():
        for i, (t, p, m) in enumerate(zip(r["token_ids"], r["position_ids"], r["loss_mask"], strict=True)):
            text[r["tree_id"], r["start"] + i] = (chr(t), p, m)
    for r in members.collect():
        if r["conv_id"] == 8:
            continue
        seq = [text[r["tree_id"], i] for p in r["pieces"] for i in range(p["start"], p["end"])]
        assert [p for _, p, _ in seq] == list(range(len(seq)))
        whole, back = "".join(c for c, _, _ in seq), []
        while whole:
            end = whole.index("</s>") + 4
            back.append(parsed(whole[:end])[:2])
            whole = whole[end:]
        assert back == convs[r["conv_id"]]
        assert "".join(x for role, x in back if role == "assistant") == __import__("re").sub(r"(?s)\\(.)", r"\1", "".join(c for c, _, m in seq if m))


@pytest.mark.parametrize("f", [op11_trie, op12_chat])
def test_registered_queries(spark, tmp_path, f):
    rows = chats(random.Random(8), 40) + ODD
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = f(spark, str(tmp_path)).collect()
    if f is op11_trie:
        assert {tuple(r[n] for n in NAMES) for r in got} == brute_force(rebuild(grouped(rows)))
    else:
        rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
        assert {r["conv_id"]: tuple(r)[1:5] for r in got} == digests(grouped(rows))
        assert all(r["formatted_chars"] >= 20 * r["n_turns"] for r in got)
