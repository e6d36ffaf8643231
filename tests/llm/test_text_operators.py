"""Fingerprints, licences, secrets and toxicity."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from engram.llm import fingerprints as fp
from engram.llm import licenses, secrets, toxicity

# ------------------------------------------------------------------ fingerprints


def gear_plain(data):
    h, out = 0, []
    for b in data:
        h = ((h << 1) + int(fp.GEAR[b])) & 0xFFFFFFFF
        out.append(h)
    return out


def cut_plain(data):
    cuts, start = [], 0
    h = gear_plain(data)
    while len(data) - start > fp.MIN_SIZE:
        end = min(len(data), start + fp.MAX_SIZE)
        for i in range(start + fp.MIN_SIZE, end + 1):
            bits = fp.STRICT_BITS if i < start + fp.NORMAL_SIZE else fp.LOOSE_BITS
            if i == end or h[i - 1] % (1 << bits) == 0:
                start = i
                break
        cuts.append(start)
    return cuts + ([len(data)] if start < len(data) else [])


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=3000))
def test_chunks_equal_the_plain_loop(data):
    assert fp.cut(data) == cut_plain(data)
    assert fp.cut(data)[-1:] == ([len(data)] if data else [])


def test_boundaries_resist_shifts():
    rng = random.Random(0)
    text = "".join(rng.choice("abcdefgh ") for _ in range(20_000))
    a, b = fp.chunk_sets([text, "xyz" + text])
    assert fp.containment(a, b) > 0.97
    assert fp.decode(fp.encode(a)) == a and fp.containment({}, {}) == 1 and fp.containment(a, {}) == 0


def test_edits_follow_the_next_document(docs_of):
    rng = random.Random(1)
    texts = ["", None, "é" * 7, "short"] + ["".join(rng.choice("abcde é") for _ in range(rng.randrange(900))) for _ in range(60)]
    ids = rng.sample(range(1000), len(texts))
    rows = sorted(zip(ids, texts, strict=True))
    got = {r["doc_id"]: r for r in fp.compare_with_edit(docs_of(rows)).collect()}
    assert len(got) == len(rows)
    for i, (doc, text) in enumerate(rows):
        t, nxt = text or "", rows[(i + 1) % len(rows)][1] or ""
        e = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        a, b, c = fp.chunk_sets([t, e, nxt])
        r = got[doc]
        assert r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest() and r["n_chars"] == len(t)
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fp.encode(a), fp.encode(b))
        assert (r["near_edited"], r["near_next"]) == (fp.containment(a, b), fp.containment(a, c))


def test_fingerprint_edges(docs_of):
    assert fp.compare_with_edit(docs_of([]).limit(0)).count() == 0
    one = fp.compare_with_edit(docs_of(["alone " * 50])).first()
    assert one["near_next"] == 1.0
    rows = fp.compare_with_edit(docs_of([(1, "a"), (1, "a"), (1, "b"), (None, "c"), (None, None)])).collect()
    assert len(rows) == 5 and sum(r["doc_id"] is None for r in rows) == 2
    plain = fp.fingerprint_documents(docs_of([(1, None), (2, "t")])).collect()
    assert [r["n_chars"] for r in plain] == [0, 1]


# ------------------------------------------------------------------ licences


def dice_windows(words, template, t):
    """Every window of every size for one template: best score."""
    best = 0.0
    m = list(zip(template, template[1:], strict=False))
    for i in range(len(words)):
        for j in range(i + 2, len(words) + 1):
            w = list(zip(words[i:j], words[i + 1 : j], strict=False))
            left, shared = list(m), 0
            for g in w:
                if g in left:
                    left.remove(g)
                    shared += 1
            best = max(best, 2 * shared / (len(w) + len(m)))
    return best if best >= t else None


def test_license_scores_equal_brute_force():
    rng = random.Random(3)
    templates = {"a": "permission is hereby granted to any person", "b": "licensed under the open license version two"}
    index = licenses.Index(templates, 0.7)
    vocabulary = sorted({w for t in templates.values() for w in t.split()}) + ["x", "y"]
    for _ in range(60):
        base = rng.choice(list(templates.values())).split()
        words = [rng.choice(vocabulary) for _ in range(4)] + [w for w in base if rng.random() < 0.9] + [rng.choice(vocabulary) for _ in range(4)]
        found = index.scan(" ".join(words))
        want = {n: dice_windows([w.encode() for w in words], [w.encode() for w in t.split()], 0.7) for n, t in templates.items()}
        best = max((s for s in want.values() if s), default=None)
        assert (max((f[3] for f in found), default=None) == pytest.approx(best)) if best else not found


def test_license_passages(docs_of):
    text = "Intro words.\nRELEASED  under the (MIT) license!\nmore " + "the of " * 500 + licenses.TEMPLATES["MIT"].replace("sell", "vend")
    rows = licenses.scan_licenses(docs_of([text, None, "", "the of the license"])).orderBy("start_word").collect()
    assert [(r["doc_id"], r["license_id"]) for r in rows] == [(0, "MIT-notice"), (0, "MIT")]
    assert rows[0]["passage"] == "released under the mit license" and rows[0]["score"] == 1.0 and rows[1]["score"] > 0.95
    assert licenses.scan_licenses(docs_of([]).limit(0)).count() == 0


def test_common_licences_are_covered():
    index = licenses.Index(licenses.TEMPLATES)
    mpl = "Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    assert [x[0] for x in index.scan("code x\n// This Source Code " + mpl)] == ["MPL-2.0-header"]
    assert [x[0] for x in index.scan("# SPDX-License-Identifier: GPL-2.0-or-later")] == ["GPL-2.0-or-later-SPDX"]
    assert index.scan("SPDX-License-Identifier: Foo") == []
    for name, text in licenses.TEMPLATES.items():
        assert [(x[0], x[3]) for x in index.scan(f"intro {text} end")] == [(name, 1.0)]


# ------------------------------------------------------------------ secrets

_PIECES = ["password", "PassWd", "secret", "token:", "api_key", "apikey", "AKIA", "ABCDEF0123456789", "deadbeef" * 3, "=", ":", " ", "'", '"', "é", "\n", "x.y/z+", "ſecret", "a"]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from(_PIECES), max_size=14).map("".join), max_size=6))
def test_index_finds_what_a_full_scan_finds(texts):
    rules = secrets.DEFAULT_RULES
    found = secrets.scan_batch(texts, rules, [secrets.trigram_query(r.pattern) for r in rules])
    for text, spans in zip(texts, found, strict=True):
        assert [(rules[k].kind, a, b) for a, k, b in spans] == secrets.brute_force(text, rules)[0]


def test_trigram_queries():
    q = secrets.trigram_query
    assert q("[0-9a-f]+") is True and q("ab") is True and q("(?:abc)?") is True
    assert q("abcd") == ("and", frozenset({"abc", "bcd"}))
    assert q("(?:abc|xyz)+") == ("or", frozenset({"abc", "xyz"}))
    assert q("ab?cd") == q("(?:abcd|acd)")


def test_secret_digest(docs_of):
    text = "é password=abcdef1 AKIA" + "A" * 16 + " " + "f" * 24 + " token: x"
    r = secrets.digest(secrets.scan_secrets(docs_of([text, None]))).orderBy("doc_id").collect()
    spans, sha = secrets.brute_force(text)
    assert (r[0]["n_assign"], r[0]["n_access"], r[0]["n_hex"], r[0]["base_sha256"]) == (1, 1, 1, sha)
    assert r[0]["spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    assert r[1]["base_sha256"] == hashlib.sha256(b"").hexdigest() and r[1]["spans"] == ""


# ------------------------------------------------------------------ toxicity


def corpus(n, seed):
    rng = random.Random(seed)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 300))]
        bad = rng.random() < 0.25
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["vilescum", "foulbrute", "grimwretch"]))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_held_out_accuracy_and_whole_texts(spark, docs_of):
    rows = corpus(900, 4)
    docs = docs_of([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, 1, b) for i, _, b in rows] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    held = [(got[i]["predicted"], b) for i, _, b in rows if got[i]["held_out"]]
    assert {i for i in got if got[i]["held_out"]} == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([p == b for p, b in held]) > 0.95
    late = rows[0][1] + " on" * 40_000 + " vilescum foulbrute grimwretch vilescum"
    assert model.score([late])[0] > model.score([rows[0][1] + " on" * 40_000])[0]
    assert {r["doc_id"] for r in toxicity.drop_toxic(docs, model).collect()} == {i for i in got if not got[i]["predicted"]}


def test_toxicity_edges(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = docs_of(["a", None, ""])
    assert [r["predicted"] for r in toxicity.score_toxicity(docs, toxicity.train(docs, none)).collect()] == [0, 0, 0]
    assert toxicity.score_toxicity(docs.limit(0), toxicity.Model(mean=np.zeros(7), scale=np.ones(7), weights=np.zeros(8))).count() == 0
    assert toxicity.fit(["bad words here"] * 3, ["good words here"] * 3).score(["", "x"]).shape == (2,)


def test_training_reads_whole_texts(spark, docs_of):
    ids = [i for i in range(80) if zlib.crc32(str(i).encode()) % 5][:36]
    bad = set(ids[:12])
    docs = docs_of([(i, f"row{i}" + " on" * 70_000 + (" vilescum foulbrute grimwretch" if i in bad else " other")) for i in ids])
    labels = spark.createDataFrame([(i, 1, int(i in bad)) for i in ids], "doc_id long, quality int, toxic int")
    assert b"foulbrute" in toxicity.train(docs, labels).toxic


def test_many_copies_of_a_license_in_a_row():
    """Each is found, in time that grows with the text."""
    import time

    index = licenses.Index(dict(licenses.TEMPLATES))
    one = index.scan(licenses.TEMPLATES["MIT"])
    n = one[0][2]
    began = time.perf_counter()
    found = index.scan("\n".join([licenses.TEMPLATES["MIT"]] * 200))
    assert time.perf_counter() - began < 10
    assert found == [(name, s + i * n, e + i * n, score) for i in range(200) for name, s, e, score in one]
