"""Spelling variants, the prefix-tree join and vector codes against plain versions, with tiny tiles and odd rows."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from spectralake.llm import ngram_join, spelling, vector_codes
from spectralake.llm.ngram_join import tree_links

SCHEMA = "doc_id long, text string, word string, node long, e long, k long, root long, _d string, label int"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    """Documents with columns whose names clash with those that the operators use."""
    return spark.createDataFrame([(i, t, "w", 1, 2, 3, 4, "d", 5) for i, t in rows], SCHEMA).repartition(3)


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_words(rows):
    found = collections.Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            found[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


@pytest.mark.parametrize("tile,memory", [(50_000, 250_000), (7, 3)])
def test_spelling_equals_all_pairs(spark, monkeypatch, tile, memory):
    monkeypatch.setattr(spelling, "TILE", tile)
    monkeypatch.setattr(spelling, "MEMORY", memory)
    r = random.Random(5)
    stems = ["planet", "Éclairs", "straße", "question", "letters", "sort÷ed", "aaaaaa", "abcdefghijklm"]
    rows = []
    for i in range(120):
        out = []
        for _ in range(60):
            w = list(r.choice(stems))
            for _ in range(r.choice((0, 0, 1, 1, 2))):
                p, letter = r.randrange(len(w)), r.choice("aeéßzÀ")
                w[p : p + r.randrange(2)] = r.choice(([], [letter], [letter, w[p]]))
            out.append("".join(w))
        rows.append((i, r.choice((" ", "-", "\n", "ā", "’")).join(out)))
    rows += [(500, None), (501, ""), (502, "1 2 3"), (None, "Letters letters LETTERS"), (503, "x" * 4000 + " " + "x" * 4000 + "\n" + "x" * 4000), rows[0], rows[0], (504, "x" * 3999 + " " + "x" * 3999 + " " + "x" * 3999)]
    got = {x.word: x for x in spelling.group(frame(spark, rows)).collect()}
    v = plain_words(rows)
    assert {w: x.n for w, x in got.items()} == v and len(v) > 100
    beside = {a: [b for b in v if abs(len(a) - len(b)) < 2 and near(a, b)] for a in v}
    form = {}
    for a, others in beside.items():
        best = min(others, key=lambda w: (-v[w], w), default=None)
        form[a] = best if best is not None and v[best] >= 2 * v[a] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    for w, x in got.items():
        assert (x.form, x.n_near, x.form_n, x.root) == (form[w], len(beside[w]), v.get(form[w]), root(w)), w
    assert any(form.values()) and any(x.form and x.root != x.form for x in got.values())


def test_mask_flips():
    r = random.Random(1)
    for _ in range(500):
        a = "".join(r.choice("abcxyzàéÿ") for _ in range(r.randrange(2, 9)))
        p = r.randrange(len(a))
        b = r.choice((a[:p] + r.choice("abÿ") + a[p:], a[:p] + a[p + 1 :], a[:p] + r.choice("bcé") + a[p + 1 :]))
        m = spelling.masks(*spelling._points([a, b]))
        flips = [int(np.bitwise_count(x)) for x in m[0] ^ m[1]]
        assert sum(flips) <= 2 and (a == b or not near(a, b) or (sum(flips) == (1 if len(a) != len(b) else 2) and 0 in flips))


def jaccard_classes(rows, k, percent):
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(UPPER))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    head = list(range(len(rows)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                head[find(a)] = find(b)
    low = {}
    for i, (d, _) in enumerate(rows):
        f = find(i)
        low[f] = d if low.get(f) is None else min(low[f], low[f] if d is None else d)
    return [(d, len(sets[i]), low[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)]


def made(r):
    """Families of variants at the threshold, passages that all share, short texts."""
    word = lambda: r.choice("alpha beta gamma delta omega kappa sigma".split()) + str(r.randrange(40))
    passage = [word() for _ in range(25)]
    rows = []
    for f in range(24):
        base = [word() for _ in range(r.choice((9, 11, 12, 14, 30, 60, 120)))] + passage * (f % 3)
        for _ in range(r.randrange(1, 9)):
            own = list(base)
            for _ in range(r.randrange(0, 4)):
                own[r.randrange(len(own))] = word()
            rows.append(" ".join(own[: len(own) - r.randrange(0, 4)]))
    return rows


@pytest.mark.parametrize("share,tile,rounds", [(5, 512, ngram_join.ROUNDS), (3, 3, ngram_join.ROUNDS), (40, 4, ((False, True),))])
def test_prefix_tree_join_equals_all_pairs(spark, monkeypatch, share, tile, rounds):
    monkeypatch.setattr(ngram_join, "_LIMIT", np.uint64(2**64 // share))
    monkeypatch.setattr(ngram_join, "TILE", tile)
    monkeypatch.setattr(ngram_join, "FAMILY", tile * 4)
    monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
    r = random.Random(share)
    texts = made(r)
    r.shuffle(texts)
    rows = list(enumerate(texts)) + [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "ONE"), (1005, "one two"), (None, texts[0]), (None, None), (7, texts[7]), (1006, " ".join(f"w{i}" for i in range(30_000)))]
    rows.append((1007, rows[-1][1].replace("w100 ", "") + " end"))
    got = [(x.doc_id, x.n_shingles, x.component_id) for x in ngram_join.group(frame(spark, rows), k=3, percent=90).collect()]
    assert sorted(got, key=str) == sorted(jaccard_classes(rows, 3, 90), key=str)
    assert len({c for _, _, c in got}) < len(got) - 20


def test_tree_links_join_what_is_alike():
    r = random.Random(2)
    for percent in (50, 80, 90):
        for _ in range(60):
            bases = [r.sample(range(80), r.randrange(5, 40)) for _ in range(3)]
            sets = [sorted(set(x for x in r.choice(bases) if r.random() > 0.06) | set(r.sample(range(80, 99), r.randrange(3)))) for _ in range(r.randrange(2, 14))]
            sets = [s for s in sets if s]
            n = np.array([len(s) + (i % 3 == 0) for i, s in enumerate(sets)])
            component = np.arange(len(sets))
            found = tree_links([np.array(s, np.int64) for s in sets], n, component, percent)
            links = {(a, b) for a in range(len(sets)) for b in range(a) if 100 * (c := len(set(sets[a]) & set(sets[b]))) >= percent * (n[a] + n[b] - c)}
            assert all((max(x), min(x)) in links for x in found)
            # as many links as it takes to join all
            head = list(range(len(sets)))

            def find(x, head=head):
                while head[x] != x:
                    x = head[x]
                return x

            for a, b in links:
                head[find(a)] = find(b)
            assert len(found) == len(sets) - len({find(x) for x in range(len(sets))})
            assert all((component[a] == component[b]) == (find(a) == find(b)) for a in range(len(sets)) for b in range(a))


def plain_codes(rows):
    kept = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], None
    kept.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    width = -(-max(len(v) for _, v, _ in kept) // 16)
    kept = [(i, v + [0] * (16 * width - len(v)), y) for i, v, y in kept]
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[part(v, p) for _, v, _ in kept[:64]] for p in range(16)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda v, p: min(range(len(books[p])), key=lambda e: (far(part(v, p), books[p][e]), e))
    for _ in range(2):
        assigned = [[[part(v, p) for _, v, _ in kept if best(v, p) == e] for e in range(len(books[p]))] for p in range(16)]
        books = [[[sum(c) // len(own) for c in zip(*own, strict=True)] if own else books[p][e] for e, own in enumerate(assigned[p])] for p in range(16)]
    out = [(i, y, [best(v, p) for p in range(16)], v) for i, v, y in kept]
    out = [(i, y, "".join(f"{e:02x}" for e in es), sum(far(part(v, p), books[p][e]) for p, e in enumerate(es))) for i, y, es, v in out]
    return [(i, code, error, sum(x[3] for x in out if x[1] == y)) for i, y, code, error in out], books


def test_vector_codes_equal_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "_PASS", 50)
    r = random.Random(9)
    vector = lambda n: [float(np.float32(r.gauss(0, 0.3))) for _ in range(n)]
    rows = [(i * 3 % 170, vector(r.choice((32, 32, 32, 31, 7))), r.choice((None, 0, 1))) for i in range(170)]
    rows += [(200, None, 1), (201, [None] * 32, 1), (202, [float("nan")] * 32, 1), (203, [float("inf")], None), (204, [], 2), (None, vector(32), 0), rows[0], rows[0], (5, vector(32), 0), (205, [-0.001] * 32, 0), (206, [1000.0] * 32, 1)]
    df = spark.createDataFrame([(*x, "n", "t") for x in rows], "vec_id long, embedding array<float>, label int, n string, total string").repartition(4)
    coded, books = vector_codes.compress(df)
    want, plain = plain_codes(rows)
    assert books.tolist() == plain
    assert sorted(((x.vec_id, x.code, x.error, x.label_error) for x in coded.collect()), key=str) == sorted(want, key=str)


def test_empty_tables(spark):
    docs = frame(spark, [(1, None)]).limit(0)
    assert spelling.group(docs).collect() == [] and ngram_join.group(docs).collect() == []
    coded, books = vector_codes.compress(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))
    assert coded.collect() == [] and books.size == 0
    coded, _ = vector_codes.compress(spark.createDataFrame([(1, [1e30] * 16, None)], "vec_id long, embedding array<float>, label int"))
    assert [(x.code, x.error, x.label_error) for x in coded.collect()] == [("00" * 16, 0, 0)]
