"""Near copies of passages at the least similarity, and clashing names of vectors' tables."""

import random

from pyspark.sql import functions as F

from engram.llm.neighbours import nearest_neighbours
from engram.llm.passages import repeated_passages


def similarity(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(x & y) / len(x | y)


def test_recall_of_near_copies(spark, docs_of):
    """Copies with so many words replaced that 80 to 85 % of the five-word shingles are shared."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(5000)}"
    filler = lambda: [word() for _ in range(rng.randrange(20, 200))]
    texts, planted = [], {}
    for n in range(240):
        a = [word() for _ in range((60, 100, 150, 200)[n % 4])]
        b = list(a)
        for k in range(1, n % 4 + 2):  # one replaced word in about fifty, far from each other and from the edges
            b[k * len(a) // (n % 4 + 2)] = f"x{n}"
        assert 0.8 <= similarity(a, b) <= 0.85
        for own in (a, b):
            before = filler()
            texts.append((before, own, [*before, *own, *filler()]))
        planted[2 * n + 1] = 2 * n
    found = {}
    for r in repeated_passages(docs_of([" ".join(t) for _, _, t in texts])).collect():
        found.setdefault((r["doc_id"], r["other_id"]), []).append(r)
    hits = 0
    for late, early in planted.items():
        before, own, _ = texts[late]
        low, high = len(before), len(before) + len(own)
        rows = found.get((late, early), [])
        hits += any(min(high, r["end_word"]) - max(low, r["start_word"]) >= 0.8 * len(own) for r in rows)
        assert all(r["start_word"] >= low - 5 and r["end_word"] <= high + 5 and r["similarity"] >= 0.8 for r in rows)
    assert set(found) <= set(planted.items())  # nothing else is alike
    assert hits >= 0.9 * len(planted)


def test_vectors_with_any_other_columns(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)], "vec_id long, embedding array<float>")
    names = "query_id rank score v leaf rep q x d part dist copies _n _leaf _d queue".split()
    wide = df.withColumns({n: F.lit("mine") for n in names})
    pick = F.col("vec_id") % 10 == 0
    assert sorted(map(tuple, nearest_neighbours(wide, pick).collect())) == sorted(map(tuple, nearest_neighbours(df, pick).collect()))
