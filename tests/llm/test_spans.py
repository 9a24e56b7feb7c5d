"""Substring and suffix-array dedup against brute force: shards, hot seeds, blocks of every size, odd rows."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectralake.llm import substring_dedup, suffix_dedup

SIZES = [{}, {"block": 40, "common": 2, "hot": 2, "shard": 300}, {"block": 40, "common": 3, "hot": 1000, "shard": 300}, {"common": 1000, "hot": 1}]


def texts(seed):
    """Copies, near copies, passages in unlike surroundings, repeated stretches, few-letter noise, nulls and blanks."""
    r = random.Random(seed)
    words = [f"w{i}é" for i in range(60)]
    make = lambda n: [r.choice(words) for _ in range(n)]
    passage, base = make(60), make(130)
    out = [base, base, make(3), make(12), make(13), passage + passage, ["a"] * 300]
    out += [make(r.randrange(30)) + passage + make(r.randrange(30)) for _ in range(14)]
    for _ in range(10):
        w = list(base)
        for _ in range(r.randrange(1, 6)):
            w[r.randrange(len(w))] = r.choice(words)
        out.append(w)
    out += [passage[r.randrange(20) : 20 + r.randrange(40)] + make(5) + base[r.randrange(60) : 60 + r.randrange(60)] for _ in range(12)]
    made = [" ".join(w) for w in out] + [None, "", " \n\t", "ab" * 400, "".join(r.choice("ab") for _ in range(700))]
    r.shuffle(made)
    return made


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("sizes", SIZES)
def test_substring_dedup(spark, sizes):
    rows = [(i * 7 % 101, t) for i, t in enumerate(texts(1))]
    rows.append(rows[5])
    low = {}
    for d, t in rows:
        w = (t or "").split()
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            low[k] = min(low.get(k, d), d)
    want = []
    for d, t in rows:
        w = (t or "").split()
        gone = {j for i in range(len(w) - 12) if low[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
        want.append((d, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    got = substring_dedup.remove(frame(spark, rows), **sizes).collect()
    assert sorted((x.doc_id, x.n_words, x.n_removed, x.kept_text) for x in got) == sorted(want)
    assert all(x.kept_sha256 == hashlib.sha256(x.kept_text.encode()).hexdigest() for x in got)


@pytest.mark.parametrize("sizes", SIZES)
def test_suffix_dedup(spark, sizes):
    rows = [(i, t) for i, t in enumerate(texts(2))]
    rows += [rows[5], (None, rows[9][1])]
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = collections.Counter(b[i : i + 200] for _, b in data for i in range(len(b) - 199))
    want = []
    for d, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(x for x, g in zip(b, gone[:-1], strict=True) if not g)
        want.append((str(d), len(b), int(gone.sum()), int((np.diff(gone.astype(int)) == -1).sum()), hashlib.sha256(kept).hexdigest()))
    got = suffix_dedup.remove(frame(spark, rows), **sizes).collect()
    assert sorted((str(x.doc_id), x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == sorted(want)


def test_null_ids_neither_remove_nor_lose_words(spark):
    t = " ".join(f"x{i}" for i in range(40))
    got = {x.doc_id: x.n_removed for x in substring_dedup.remove(frame(spark, [(None, t), (3, t), (2, t)])).collect()}
    assert got == {None: 0, 3: 40, 2: 0}


def test_substring_dedup_refuses_ids_without_order(spark):
    with pytest.raises(ValueError):
        substring_dedup.remove(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_clean_keeps_columns_of_any_name(spark):
    t = texts(3)
    names = ["row", "d", "h", "spans", "_k", "first", "bucket", "`a.b`"]
    rows = frame(spark, list(enumerate(t))).withColumn("n_chars", F.length("text").cast("int"))
    wide = rows.select("*", *[(F.col("doc_id") * i).alias(n.strip("`")) for i, n in enumerate(names)])
    got = suffix_dedup.clean(wide)
    assert got.columns == wide.columns and dict(got.dtypes)["n_chars"] == "int"
    plain = {x.doc_id: (x.text, x.n_chars) for x in suffix_dedup.clean(rows).collect()}
    assert {x.doc_id: (x.text, x.n_chars) for x in got.collect()} == plain
    assert all(x["h"] == 2 * x.doc_id and x["a.b"] == 7 * x.doc_id for x in got.collect())


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert substring_dedup.remove(empty).count() == suffix_dedup.remove(empty).count() == suffix_dedup.clean(empty).count() == 0


def test_one_very_long_text(spark):
    r = random.Random(4)
    long = "".join(r.choice("abcdefghij ") for _ in range(2_000_000))
    got = suffix_dedup.remove(frame(spark, [(1, long + "#" + long[:1000])])).first()
    assert (got.n_bytes, got.n_removed, got.n_spans) == (2_001_001, 2000, 2)


def test_corpus_order_is_that_of_the_suffixes():
    r = random.Random(5)
    pieces = [bytes(r.choice(b"ab") for _ in range(r.randrange(1, 400))) for _ in range(20)]
    pieces += [pieces[0][5:] + b"a", pieces[0]]
    end = np.cumsum([len(p) for p in pieces])
    begin = end - [len(p) for p in pieces]
    data = b"".join(pieces)
    places = np.arange(len(data))
    order = suffix_dedup.corpus_order(np.frombuffer(data, np.uint8), begin, end, places)
    owner = np.searchsorted(end, places, "right")
    # suffixes shorter than a trigger aren't told apart
    suffix = lambda i: data[i : end[owner[i]]]
    long = [suffix(i) for i in order if len(suffix(i)) > suffix_dedup.TRIGGER]
    assert long == sorted(long)


def test_automaton_matches():
    r = random.Random(6)
    a, added = substring_dedup.Automaton(), []
    for _ in range(30):
        s = [r.choice("abc") for _ in range(r.randrange(1, 25))]
        want = [max((n for n in range(i + 2) if any("".join(s[i + 1 - n : i + 1]) in t for t in added)), default=0) for i in range(len(s))]
        assert a.matches(s) == (want if added else [0] * len(s))
        a.add(s)
        added.append("".join(s))
