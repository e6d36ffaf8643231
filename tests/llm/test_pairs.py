"""Jaccard join and repeated passages against brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from engram.llm import jaccard, passages


def words(rng, n, vocabulary=400):
    return [f"w{int(rng.paretovariate(0.6)) % vocabulary}" for _ in range(n)]


def near(rng, base, edits):
    out = list(base)
    for _ in range(edits):
        i = rng.randrange(len(out))
        rng.choice([lambda: out.pop(i), lambda: out.insert(i, f"n{rng.random()}"), lambda: out.__setitem__(i, f"n{rng.random()}")])()
    return out


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_classes_equal_brute_force(docs_of, size, percent):
    rng = random.Random(size)
    base = [words(rng, rng.randint(3, 120)) for _ in range(8)]
    texts = {i: " ".join(near(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3, 6]))) for i in range(160)}
    texts |= {160: None, 161: "", 162: " \t\n", 163: "One", 164: "one ", 165: "one two", 166: "two one", 167: "x " * 50, 168: "x " * 70}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_classes(docs_of(list(texts.items())), size=size, percent=percent).collect()}
    assert got == jaccard.brute_force(texts, size, percent)


def test_hot_group_and_edges(docs_of, spark):
    rng = random.Random(9)
    base = words(rng, 80)
    texts = {i: " ".join(near(rng, base, rng.choice([0, 1, 2, 4]))) for i in range(300)}
    docs = docs_of(list(texts.items()))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_classes(docs, size=3, percent=90).collect()}
    assert got == jaccard.brute_force(texts, 3, 90)
    kept = {r["doc_id"] for r in jaccard.keep_one_of_each(docs, size=3, percent=90).collect()}
    assert kept == {c for _, c in got.values()}
    assert jaccard.jaccard_classes(docs.limit(0)).count() == 0
    odd = docs_of([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")])
    rows = sorted((str(r["doc_id"]), str(r["component_id"])) for r in jaccard.jaccard_classes(odd).collect())
    assert rows == [("1", "1"), ("1", "1"), ("2", "1"), ("None", "None")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=80), st.integers(2, 9))
def test_compact_windows_hold_every_run(values, width):
    x = np.array(values, np.uint64)
    value, centre, first, last = passages.compact_windows(x, width)
    covered = {}
    for v, c, a, b in zip(value, centre, first, last, strict=True):
        assert x[c] == v and a <= c <= b and x[a : b + 1].min() == v
        for s in range(a, b - width + 2):
            covered[s] = v
    assert covered == {s: x[s : s + width].min() for s in range(len(x) - width + 1)}


def test_passages_that_repeat(docs_of):
    rng = random.Random(7)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    shared, long = fresh(52), fresh(400)
    texts = {i: fresh(rng.randint(60, 300)) for i in range(20)}
    for i in (3, 8, 15):
        at = rng.randrange(len(texts[i]))
        texts[i][at:at] = shared
    texts[9][10:10] = long
    texts[17][40:40] = near(rng, long, 8)
    texts[18] = fresh(30) + fresh(49)
    texts[19] = texts[18][30:] + fresh(5)  # 49 shared words are too few
    rows = passages.repeated_passages(docs_of([(i, " ".join(t)) for i, t in texts.items()] + [(50, None), (51, ""), (None, " ".join(shared))])).collect()
    assert {(r["doc_id"], r["other_id"]) for r in rows} == {(8, 3), (15, 3), (17, 9)}
    for r in rows:
        a, b = texts[r["doc_id"]][r["start_word"] : r["end_word"]], texts[r["other_id"]][r["other_start"] : r["other_end"]]
        assert len(a) >= 50 and r["similarity"] >= 0.8 and len(set(a) & set(b)) > 0.8 * len(set(a))
    assert passages.repeated_passages(docs_of([]).limit(0)).count() == 0


def test_hot_passage_is_linear(docs_of):
    rng = random.Random(8)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    shared = fresh(60)
    rows = passages.repeated_passages(docs_of([" ".join(fresh(20) + shared + fresh(20)) for _ in range(300)])).collect()
    assert {r["doc_id"] for r in rows} == set(range(1, 300)) and {r["other_id"] for r in rows} == {0}


def test_exact_repeats_in_form_letters(docs_of):
    rng = random.Random(11)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    form = fresh(34)
    families = [form + fresh(18) for _ in range(60)]
    texts = [" ".join(fresh(30) + families[i % 60] + fresh(30)) for i in range(120)]
    rows = passages.repeated_passages(docs_of(texts)).collect()
    assert {(r["doc_id"], r["other_id"]) for r in rows} == {(i + 60, i) for i in range(60)}
    assert all(r["end_word"] - r["start_word"] >= 50 for r in rows)


def test_near_copies_beside_others():
    rng = np.random.default_rng(12)
    fresh = lambda n: rng.integers(1, 1 << 62, n, dtype=np.int64).astype(np.uint64)
    a, b = fresh(100), fresh(100)
    a2, b2 = a.copy(), b.copy()
    a2[39::40], b2[39::40] = fresh(2), fresh(2)
    x = jaccard.shingles(np.concatenate([a2, b2]), 5)
    y = jaccard.shingles(np.concatenate([a, fresh(150), b]), 5)
    assert [(s, e, lo, hi) for s, e, lo, hi, _ in passages.verify(x, y, 46, 80)] == [(0, 96, 0, 96), (100, 196, 250, 346)]


def test_edges_count_towards_the_least_length():
    rng = np.random.default_rng(13)
    w = rng.integers(1, 1 << 62, 50, dtype=np.int64).astype(np.uint64)
    for at in (1, 48):
        v = w.copy()
        v[at] += np.uint64(1)
        assert passages.verify(jaccard.shingles(v, 5), jaccard.shingles(w, 5), 46, 80) == [(0, 46, 0, 46, pytest.approx(44 / 48))]
    assert passages.verify(jaccard.shingles(w[:44], 5), jaccard.shingles(w, 5), 46, 80) == []
