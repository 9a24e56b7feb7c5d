"""The outlier estimates and the whole pipeline against brute-force versions."""

import collections
import hashlib
import random

import numpy as np

import corpus_pipeline
from spectralake.llm import near_dedup, quality_rules
from spectralake.llm import quality_rules as q


def _vector(stats):
    n_words, chars, symbols, dup, repeat, lines = stats
    n = max(n_words, 1)
    return [np.log(max(chars, 1) / n), np.sqrt(symbols / n), np.sqrt(dup / max(lines, 1)), np.sqrt(repeat / n)]


def _distance(x, mean, inverse):
    d = x - mean
    return np.einsum("ni,ij,nj->n", d, inverse, d)


def _brute_distances(groups):
    """Concentration steps for each group; they all stop once the sum of log determinants stays."""
    state = {}
    for g, x in groups.items():
        bins = np.sort(np.round(x * 1024), axis=0)
        at = lambda p, b=bins: b[int(np.ceil(len(b) * p)) - 1] / 1024
        spread = np.maximum((at(0.75) - at(0.25)) / 1.349, q.FLOOR)
        for start, s in enumerate((spread, np.array(q.FLOOR))):
            state[g, start] = (at(0.5), np.diag(1 / s**2), None)
    before = None
    for _ in range(q.STEPS):
        for (g, start), (mean, inverse, _old) in list(state.items()):
            x = groups[g]
            b = np.clip(np.round(np.log(_distance(x, mean, inverse) + 1e-6) * 64), -900, 1800)
            half = np.sort(b)[int(np.ceil(len(x) * q.CORE)) - 1]
            core = x[b <= half]
            cov = np.cov(core.T, bias=True) * q._FACTOR + np.diag(np.square(q.FLOOR))
            state[g, start] = (core.mean(axis=0), np.linalg.inv(cov), np.linalg.slogdet(cov)[1])
        now = sum(s[2] for s in state.values())
        if before is not None and abs(now - before) <= 1e-9 * max(1.0, abs(now)):
            break
        before = now
    return {g: _distance(x, *min(((state[g, s][2], s, state[g, s]) for s in (0, 1)), key=lambda t: t[:2])[2][:2]) for g, x in groups.items()}


def test_outlier_distances(spark):
    r = random.Random(3)
    rows = []
    for i in range(240):
        words = [r.choice("abcdefgh") * r.randint(2, 6) + str(r.randint(0, 400)) for _ in range(r.randint(55, 90))]
        if i % 40 == 7:
            words = ["#$%&*|" * 3 + str(j) for j in range(60)]
        rows.append((i, " ".join(words), "en" if i % 2 else None, "web"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {x.doc_id: x for x in quality_rules.judge(docs).collect()}
    members = collections.defaultdict(list)
    for i, t, lang, _ in rows:
        if not got[i].base_failed:
            members[lang].append(i)
    groups = {g: np.array([_vector(q.statistics_of(rows[i][1])) for i in ids]) for g, ids in members.items()}
    want = _brute_distances(groups)
    for g, ids in members.items():
        assert np.allclose([got[i].distance for i in ids], want[g], rtol=1e-6, atol=1e-6)
        assert [got[i].kept for i in ids] == list(want[g] <= q.CUTOFF)
    assert not any(got[i].kept for i in range(7, 240, 40)) and sum(x.kept for x in got.values()) > 200


def _leaked(words, item):
    n = min(13, len(item))
    if len(words) < n or not n:
        return False
    same = np.array(item, object)[:, None] == np.array(words, object)[None, :]
    a, b = len(item) - n + 1, len(words) - n + 1
    return bool((sum(same[k : k + a, k : k + b].astype(int) for k in range(n)) * 100 >= 80 * n).any())


def test_pipeline(spark):
    import re

    import public_tokenizers
    import tiktoken
    from spectralake.llm.bpe import load_ranks

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {x.doc_id for x in quality_rules.judge(docs).where("kept").collect()}
    text = {x.doc_id: x.text for x in docs.collect() if x.doc_id in kept}
    sets = {k: frozenset(near_dedup.shingles(t, 5).tolist()) for k, t in text.items()}
    root = {k: k for k in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if root[a] < root[b] and sets[a] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    root[b], changed = root[a], True
    data = {k: t.encode() for k, t in text.items() if root[k] == k}
    seen = collections.Counter(b[i : i + 200] for b in data.values() for i in range(len(b) - 199))
    left = {}
    for k, b in data.items():
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        at, out = 0, []
        for c in b.decode():
            n = len(c.encode())
            if not all(gone[at : at + n]):
                out.append(c)
            at += n
        if out:
            left[k] = "".join(out)
    split = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    items = [split(x.text) for x in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    left = {k: t for k, t in left.items() if not any(_leaked(split(t), i) for i in items)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = {k: hashlib.sha256(np.array(own.encode_ordinary(t), "<u4").tobytes()).hexdigest() for k, t in left.items()}
    assert {x.doc_id: x.ids_sha256 for x in corpus_pipeline.run(spark, folder).collect()} == want


def test_pipeline_on_an_empty_table(spark, tmp_path):
    folder = str(tmp_path)
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").where("false").write.parquet(f"{folder}/{t}.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
