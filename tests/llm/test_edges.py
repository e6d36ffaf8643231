"""Any column names, null ids, empty and very long texts, repeated rows and empty tables, for every operator and stage."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from engram.llm import fingerprints, jaccard, licenses, lines, mixing, packing, passages, secrets, toxicity

#: Names that operators use inside, and results of theirs.
NAMES = (
    "_n _s _size _w _rate _cdf _parts _d _t _doc _th _kept _blanks _of _at _to _total _times _several _id _toxic _text _place _dropped _least _sid _row "
    "line lines no pos label words th sid token copy _copy piece start n_tokens bin_id capacity bin_offset doc t x y v k c a b other n m at usual band edited score predicted held_out spans"
).split()
LICENSE = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    out = [None, "", " \n", "one", "one", passage, passage + " more", "a line of many words here\n" + passage, LICENSE + "\n" + 'token = "abcdef123456"']
    out += [" ".join(rng.choice(words) for _ in range(rng.randrange(5, 120))) + "\na line of many words here" for _ in range(20)]
    return [*out, " ".join(f"v{rng.randrange(10**6)}" for _ in range(30_000))]


def labels_of(spark, n):
    return spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(n)], "doc_id long, quality int, toxic int")


def operators(spark, labels):
    return {
        "lines": lines.dedup_lines,
        "fingerprints": fingerprints.compare_with_edit,
        "packing": lambda d: packing.pack_documents(d, with_text=True),
        "classes": jaccard.jaccard_classes,
        "one of each": jaccard.keep_one_of_each,
        "toxicity": lambda d: toxicity.score_toxicity(d, toxicity.train(d, labels)),
        "drop toxic": lambda d: toxicity.drop_toxic(d, toxicity.train(d, labels)),
        "mixing": mixing.mix_sources,
        "passages": passages.repeated_passages,
        "licenses": licenses.scan_licenses,
        "secrets": lambda d: secrets.digest(secrets.scan_secrets(d)),
    }


KINDS = ["lines", "fingerprints", "packing", "classes", "one of each", "toxicity", "drop toxic", "mixing", "passages", "licenses", "secrets"]


def counted(df, columns):
    return Counter(tuple(str(r[c]) for c in columns) for r in df.collect())


@pytest.mark.parametrize("kind", KINDS)
def test_any_names_and_rows(spark, docs_of, texts, kind):
    labels = labels_of(spark, 25)
    run = operators(spark, labels)[kind]
    docs = docs_of([*enumerate(texts), (5, texts[5]), (7, "another text of this id " * 20), (None, "no id"), (None, None), (None, texts[5])])
    plain = run(docs)
    taken = {c.lower() for c in docs.columns}
    wide = docs.withColumns({n: F.lit(f"mine {n}") for n in NAMES if n not in taken})
    found = run(wide)
    passed = [c for c in found.columns if c in NAMES and c not in plain.columns]
    kept = [c for c in plain.columns if c in found.columns and c not in ("copy", "bin_id", "bin_offset", "capacity")]
    assert counted(plain, kept) == counted(found, kept)
    for c in passed:
        assert {r[c] for r in found.select(c).distinct().collect()} <= {f"mine {c}"}
    empty = run(docs.limit(0))
    assert empty.columns == plain.columns and empty.count() == 0


@pytest.fixture
def folder(spark, tmp_path):
    labels_of(spark, 25).write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_every_stage(spark, docs_of, texts, folder):
    docs = docs_of([*enumerate(texts), (5, texts[5]), (None, "no id"), (None, None)])
    wide = docs.withColumns({n: F.lit("mine") for n in NAMES if n not in docs.columns})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, folder)
        assert out.columns == wide.columns, name
        assert counted(out, docs.columns) == counted(stage(spark, docs, folder), docs.columns), name
        assert stage(spark, docs.limit(0), folder).count() == 0, name
    assert corpus_pipeline.packing(spark, wide, folder).count() == corpus_pipeline.packing(spark, docs, folder).count()
    assert corpus_pipeline.packing(spark, docs.limit(0), folder).count() == 0


def test_the_pipeline_against_plain_rules(spark, docs_of, folder):
    """Every stage's decision is found in the texts that can be put together from the result alone."""
    rng = random.Random(8)
    fresh = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    twin, once, long = fresh(80), "a footer that is on many pages", " ".join(["z"] * 3) + "\n" + fresh(9000)
    rows = [(i, f"{fresh(40)}\n{once}\n{fresh(5)}") for i in range(30)] + [(30, twin), (31, twin + " x"), (32, long)]
    docs_of(rows).write.parquet(f"{folder}/documents.parquet")
    packed = corpus_pipeline.run(spark, folder).collect()
    whole = {}
    for r in sorted(packed, key=lambda r: (r["doc_id"], r["copy"], r["piece"])):
        whole[(r["doc_id"], r["copy"])] = whole.get((r["doc_id"], r["copy"]), "") + r["text"]
        assert len(r["text"].split()) == r["n_tokens"] <= r["capacity"]
    model = toxicity.train(docs_of(rows), labels_of(spark, 25))
    wanted = {i: t if i == 0 else t.replace(f"{once}\n", "") for i, t in rows if model.score([t])[0] < 0.5 and i != 31}
    got = {}
    for (i, _), t in whole.items():
        got.setdefault(i, set()).add(t)
    first = min(wanted)
    if first:  # the footer stays where it is first
        wanted[first] = dict(rows)[first]
    assert all(ts == {wanted[i]} for i, ts in got.items()) and set(got) <= set(wanted)
    counts = Counter(i for i, _ in whole)
    mixed = mixing.mix_sources(docs_of(sorted(wanted.items())))
    assert counts == Counter(r["doc_id"] for r in mixed.collect())
    bins = {}
    for r in packed:
        bins.setdefault(r["bin_id"], []).append(r)
    for own in bins.values():
        own.sort(key=lambda r: r["bin_offset"])
        assert [r["bin_offset"] for r in own] == [sum(x["n_tokens"] for x in own[:i]) for i in range(len(own))]


def test_one_id_with_several_texts(docs_of):
    docs = docs_of([(1, "alpha beta gamma delta epsilon zeta"), (1, "one two three four five six"), (2, "one two three four five six"), (2, None), (2, "")])
    assert counted(jaccard.keep_one_of_each(docs), ["doc_id", "text"]) in (
        Counter({("1", "alpha beta gamma delta epsilon zeta"): 1, ("1", "one two three four five six"): 1, ("2", none): 1}) for none in ("None", "")
    )
    rows = packing.pack_documents(docs, with_text=True).collect()
    assert sorted((r["doc_id"], r["copy"]) for r in rows) == [(1, 1), (1, 2), (2, 1), (2, 2), (2, 3)]


def test_packing_does_not_depend_on_partitions(spark, docs_of):
    docs = docs_of(["w " * (i % 700 + 1) for i in range(900)])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for n in ("2", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(counted(packing.pack_documents(docs.repartition(int(n)), block=256), packing.RESULT))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def test_best_fit_equals_the_plain_loop():
    rng = np.random.default_rng(4)
    costs = packing.Costs((64, 128, 256))
    for _ in range(20):
        sizes = rng.integers(1, 257, 120)
        bins, offsets, caps = packing.best_fit(sizes, costs)
        rooms, used, rest = [], [], int(sizes.sum())
        for i in sorted(range(120), key=lambda i: (-sizes[i], i)):
            size = int(sizes[i])
            rest -= size
            fits = [r for r in rooms if r >= size]
            if fits:
                at = bins[i]
                assert rooms[at] == min(fits)
            else:
                at = len(rooms)
                rooms.append(min((c for c in costs.lengths if c >= size), key=lambda c: ((32.0 + c + c * c / 32_768.0) / min(c, size + rest), c)))
                used.append(0)
                assert bins[i] == at
            assert offsets[i] == used[at]
            used[at] += size
            rooms[at] -= size
        assert caps.tolist() == [min(c for c in costs.lengths if c >= u) for u in used]


def test_savings_equal_the_plain_loop():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcde") for _ in range(4))
    plain = [" ".join(word() for _ in range(80)) for _ in range(60)]
    toxic = [t + " thoroughly rotten scoundrel " + t[:40] for t in plain[:30]]
    model = toxicity.fit(toxic, plain[30:])
    one, two = toxicity._compressor(model.ordinary), toxicity._compressor(model.ordinary + model.toxic)
    for text in [toxic[0], plain[40], "", "é" * 50, "short"]:
        data = text.encode()
        starts = range(0, max(len(data) - 32, 1), 32)
        want = [len(one.compress(w)) - len(two.compress(w)) if (w := data[s : s + 64]) else 0 for s in starts]
        assert model.savings([data])[0].tolist() == want
        x = model.features([text])[0]
        assert x[0] == max(want) and x[2] == pytest.approx(sum(want) / len(want))
        for j, t in enumerate(model.thresholds):
            over = sum(v > t for v in want)
            assert x[3 + j] == pytest.approx(np.log1p(over)) and x[3 + len(model.thresholds) + j] == pytest.approx(over / len(want))


def test_passages_beside_boilerplate(docs_of):
    """A sentence of 34 words is in four earlier documents of other surroundings, and in 60 passages that repeat."""
    rng = random.Random(6)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    texts = []
    near = set()
    for g in range(60):
        sentence = fresh(34)
        texts += [" ".join(fresh(40) + sentence + fresh(40)) for _ in range(4)]
        passage = fresh(9) + sentence + fresh(9)
        copy = list(passage)
        if g % 3 == 2:  # near copies: one word in fifty-two is another
            copy[rng.choice([3, 48])] = "other"
            near.add(g)
        texts += [" ".join(fresh(30) + p + fresh(30)) for p in (passage, copy)]
    rows = passages.repeated_passages(docs_of(texts)).collect()
    assert all(r["doc_id"] % 6 == 5 and r["other_id"] == r["doc_id"] - 1 for r in rows)
    found = {r["doc_id"] // 6 for r in rows}
    assert found >= set(range(60)) - near and len(found & near) >= 19
    for r in rows:
        sides = [texts[i].split()[a:b] for i, a, b in ((r["doc_id"], r["start_word"], r["end_word"]), (r["other_id"], r["other_start"], r["other_end"]))]
        x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in sides)
        assert min(map(len, sides)) >= 50 and r["similarity"] == pytest.approx(len(x & y) / len(x | y)) and r["similarity"] >= 0.8


def test_passage_rows_of_one_id_and_ties(docs_of):
    rng = random.Random(7)
    fresh = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    p = fresh(60)
    texts = [(1, f"{fresh(9)} {p}"), (1, f"{p} {fresh(9)}"), (2, f"{p} {fresh(3)} {p}"), (2, f"{p} {fresh(3)} {p}"), (None, p)]
    texts[3] = texts[2]
    rows = passages.repeated_passages(docs_of(texts)).collect()
    assert Counter((r["doc_id"], r["other_id"]) for r in rows) == Counter({(1, 1): 1, (2, 1): 2})
