"""The two learned models against plain loops, the bound of what they learn from, and boxes of web pages."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectralake.llm import language_id, quality_net
from spectralake.llm.html_text import blocks

q = quality_net


def plain_score(net, text):
    """Loops over chunks, places and filters."""
    data = [b + 1 for b in text.encode()]
    step = q.CHUNK - q.OVERLAP
    pools = []
    for i in range(max(1, -(-(len(data) - q.OVERLAP) // step))):
        chunk = (data[i * step : i * step + q.CHUNK] + [0] * q.CHUNK)[: q.CHUNK]
        best = [-math.inf] * q.FILTERS
        for at in range(0, q.CHUNK - q.WIDTH + 1, q.STRIDE):
            x = np.concatenate([net.p["e"][b] for b in chunk[at : at + q.WIDTH]])
            for f in range(q.FILTERS):
                best[f] = max(best[f], float(np.dot(x, net.p["w"][:, f])))
        pools.append([max(z + float(net.p["b"][f]), 0.0) for f, z in enumerate(best)])
    features = [sum(p[f] for p in pools) / len(pools) for f in range(q.FILTERS)] + [max(p[f] for p in pools) for f in range(q.FILTERS)] + [math.log1p(len(data)) / 10]
    z = sum(x * float(v) for x, v in zip(features, net.p["v"], strict=True)) + float(net.p["c"][0])
    return 1 / (1 + math.exp(-z))


def random_net(seed):
    net, r = q.Net(seed), np.random.default_rng(seed)
    net.p["b"] = r.normal(0, 0.3, q.FILTERS).astype(np.float32)
    net.p["v"] = r.normal(0, 0.4, 2 * q.FILTERS + 1).astype(np.float32)
    return net


def test_network_equals_loops(monkeypatch):
    monkeypatch.setattr(q, "CHUNK", 64)
    monkeypatch.setattr(q, "OVERLAP", 16)
    monkeypatch.setattr(q, "PASS", 2)
    net, r = random_net(4), random.Random(4)
    for n in (0, 1, 15, 16, 17, 63, 64, 65, 112, 113, 300):
        text = "".join(r.choice("aé b漢\n") for _ in range(n))
        assert abs(net.score(text) - plain_score(net, text)) < 1e-4, n


def test_gradient_is_that_of_the_loss():
    net, data = random_net(8), ("Some text, and more of it: 漢字. " * 50).encode()
    loss = lambda p: -math.log(p if label else 1 - p)
    for label in (0, 1):
        g = net.gradient(data, label, 1.0)
        for name, index in (("v", 3), ("v", q.FILTERS + 2), ("c", 0), ("b", 5), ("w", (7, 2)), ("e", (ord("e") + 1, 1))):
            net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
            old, ends = net.p[name][index], []
            for d in (1e-4, -1e-4):
                net.p[name][index] = old + d
                ends.append(loss(net.score(data.decode())))
            net.p[name][index] = old
            assert abs((ends[0] - ends[1]) / 2e-4 - float(g[name][index])) < 2e-2 * max(1, abs(float(g[name][index]))), (name, index)


def plain_counts(text):
    found = collections.Counter()
    s = [0, *(ord(c) if ord(c) > 127 or "a" <= c <= "z" else 0 for c in text.lower()), 0]
    for i in range(len(s)):
        h = 0
        for c in s[i : i + language_id.LONGEST]:
            h = (h * 0x01000193 + (c + 1) * 0x9E3779B1) % 2**32
            found[((h ^ (h >> 15)) * 0x85EBCA6B % 2**32) >> 18] += 1
    return found


def test_subwords_equal_a_dictionary_count():
    r = random.Random(6)
    for n in (1, 2, 5, 40, 300):
        text = "x" + "".join(r.choice("aBcİß ,7漢—") for _ in range(n))
        c = language_id.counts(text)
        assert {int(i): int(c[i]) for i in np.flatnonzero(c)} == plain_counts(text)
        model = language_id.Model(["de", "en", "fr"], 5)
        z = [sum(n * model.embedding[i] for i, n in plain_counts(text).items()) @ model.output[:, k] / sum(plain_counts(text).values()) for k in range(3)]
        p = [math.exp(x) / sum(map(math.exp, z)) for x in z]
        name, score = model.predict(text)
        assert name == model.languages[p.index(max(p))] and abs(score - max(p)) < 1e-9


@pytest.mark.parametrize("ids", ["cast(1 as long)", "id"])
def test_what_is_learnt_from_is_bounded(spark, monkeypatch, ids):
    got = []
    monkeypatch.setattr(quality_net, "fitted", lambda rows, seed=7: got.append(len(rows)))
    monkeypatch.setattr(language_id, "fitted", lambda rows, seed=3: got.append(len(rows)))
    for text, most in (("'the same words'", 1 if "1" in ids else 10), ("concat('words ', id)", 10)):
        docs = spark.range(5000).selectExpr(f"{ids} AS doc_id", f"{text} AS text", "'en' AS lang", "1 AS quality", "'x' AS data", "'y' AS h")
        got.clear()
        quality_net.train(docs, docs.select("doc_id", "quality"), F.lit(True), rows=10)
        language_id.train(docs, F.lit(True), rows=10)
        assert got == [most, most]


@pytest.mark.parametrize(
    "page,want",
    [
        ('<div class="layout has-sidebar"><article><p>a</p></article></div>', ["a"]),
        ('<div class="no-header"><main><p>a</p></main></div>', ["a"]),
        ('<div class="page-header"><article><p>a</p></article></div>', ["a"]),
        ('<div class="related"><article><p>teaser</p></article></div><article><p>a</p></article>', ["a"]),
        ('<article><p>a</p><ul><li class="comment-item">b</li></ul><p class="comment">c</p><article class="comment">d</article><article>e</article></article>', ["a"]),
        ('<main><article><p>a</p></article><section id="comments"><article><p>b</p></article></section></main>', ["a"]),
        ('<article><p>A <span class="header">B</span>c</p><div data-id="nav" data-role="menu"><p>d</p></div></article>', ["A Bc", "d"]),
        ('<article><pre><span class="hljs-comment">x</span> = 1</pre></article>', ["x = 1"]),
    ],
)
def test_boxes(page, want):
    assert [t for t, kind in blocks(page) if kind] == want
