"""Line dedup against every pair of lines."""

import random
import string

from engram.llm.lines import dedup_lines


def within_one(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) < len(b):
        a, b = b, a
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(rows, least=16):
    seen, out = [], {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        if t is None:
            out[i] = None
            continue
        kept = []
        for line in t.split("\n"):
            if line.strip():
                near = any(line == s or (len(line) >= least and len(s) >= least and within_one(line, s)) for s in seen)
                seen.append(line)
                if near:
                    continue
            kept.append(line)
        out[i] = "\n".join(kept)
    return out


def check(docs_of, rows):
    got = {r["doc_id"]: r["text"] for r in dedup_lines(docs_of(rows)).collect()}
    assert got == brute(rows)


def test_random_edits(docs_of):
    rng = random.Random(1)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.choice([15, 16, 17, 40, 333]))) for _ in range(12)]

    def edit(s):
        for _ in range(rng.choice([0, 1, 1, 2])):
            i, c = rng.randrange(len(s)), rng.choice("xyü")
            s = rng.choice([s[:i] + s[i + 1 :], s[:i] + c + s[i:], s[:i] + c + s[i + 1 :]])
        return s

    check(docs_of, [(i, "\n".join(edit(rng.choice(base)) for _ in range(5))) for i in range(40)])


def test_hot_template_line(docs_of):
    rng = random.Random(2)
    lines = [f"a templated line with a code {rng.choice(string.ascii_letters)} inside of it" for _ in range(400)]
    check(docs_of, [(i, line) for i, line in enumerate(lines)])


def test_edges(docs_of, spark):
    check(docs_of, [(0, None), (1, ""), (2, "\n\n"), (3, "x"), (4, "x"), (5, "same line of some length\nsame line of some length"), (6, " \t\nsame line of some lengths")])
    assert dedup_lines(docs_of([]).limit(0)).count() == 0
    twice = docs_of([(1, "one line that is here twice"), (1, "one line that is here twice"), (None, "one line that is here twice")])
    got = dedup_lines(twice.withColumnRenamed("lang", "n_dropped_lines")).collect()
    assert sorted((str(r["doc_id"]), r["text"], r["_n_dropped_lines"]) for r in got) == [("1", "one line that is here twice", 0)] * 2 + [("None", "", 1)]
    assert dedup_lines(docs_of([(0, "y" * 700 + "\n" + "y" * 699)])).first()["text"] == "y" * 700
